"""A posting table for English full text.

A posting is (stem, id, tf, n): how often a stem occurs in a row, and the row's
number of words that are no stop words. Every row has one posting of the empty
stem besides, so the number of rows and their mean length come from the same
table. Written out, postings are dealt by hash to files that are sorted by (stem,
id): a query reads the few row groups of each file that hold its stems, and a
frequent stem is spread over all files. Words are dealt once, as postings: a word
that is frequent finds its stem in a small table, any other is stemmed where it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import english

SCHEMA = "stem string, id string, tf long, n int"
#: Words that are stemmed once, at most, and about how many rows tell which.
STEMMED, STEMMED_ROWS = 1 << 17, 8192


def _stems(rows: DataFrame) -> DataFrame:
    """(word, stem) of words that are frequent in some rows, a table of bounded size. Only which words it holds follows from those rows: all others are stemmed where they occur."""
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows.count() // STEMMED_ROWS))) == 0)
    counted = some.select(F.explode(english.content_words(F.col("content"))).alias("word")).where(F.octet_length("word") <= 64).groupBy("word").count()
    return counted.orderBy(F.col("count").desc(), "word").limit(STEMMED).select("word", english.stem("word").alias("known"))


def stemmed(rows: DataFrame) -> DataFrame:
    """(id, n, stem): a row for each content word of (id, content), with the row's number of them, and one of the empty stem for each row."""
    words = rows.select("id", F.coalesce(english.content_words(F.col("content")), F.array().cast("array<string>")).alias("words"))
    each = words.select("id", F.size("words").alias("n"), F.explode(F.concat(F.array(F.lit("")), F.col("words"))).alias("word"))
    return each.join(F.broadcast(_stems(rows)), "word", "left").select("id", "n", F.coalesce("known", english.stem("word")).alias("stem"))


def postings(rows: DataFrame) -> DataFrame:
    """Postings of (id, content); a null content is an empty text."""
    return stemmed(rows).groupBy("stem", "id", "n").agg(F.when(F.col("stem") == "", 0).otherwise(F.count("*")).alias("tf")).select("stem", "id", "tf", "n")


@dataclass
class Index:
    """Postings and a row (docs, mean)."""

    postings: DataFrame
    stats: DataFrame

    @staticmethod
    def of(rows: DataFrame) -> Index:
        """Not written: postings are made by each query anew."""
        p = postings(rows)
        return Index(p, _stats(p))

    @staticmethod
    def build(rows: DataFrame, path: str) -> Index:
        """Write the index of (id, content)."""
        postings(rows).sortWithinPartitions("stem", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        written = rows.sparkSession.read.schema(SCHEMA).parquet(f"{path}/postings")
        scratch.save(_stats(written), f"{path}/stats")
        return Index.open(rows.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.schema(SCHEMA).parquet(f"{path}/postings"), spark.read.schema("docs long, mean double").parquet(f"{path}/stats"))


def _stats(p: DataFrame) -> DataFrame:
    return p.where("stem = ''").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))


def hits(index: Index, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of rows that hold the stems of all query words; a query of stop words only finds nothing."""
    stems = english.query_stems(index.postings.sparkSession, query)
    return scored(index, stems, k1, b) if stems else index.postings.select("id", F.lit(0.0).alias("score")).where(F.lit(False))


def scored(index: Index, stems: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of rows that hold all of some distinct stems."""
    own = index.postings.where(F.col("stem").isin(*stems))
    found = own.groupBy("stem").agg(F.count("*").alias("df"))  # a row a query stem
    rows = own.join(F.broadcast(found), "stem").join(F.broadcast(index.stats))  # stats is one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return rows.groupBy("id").agg(F.count("*").alias("_met"), F.round(F.sum(score), 6).alias("score")).where(F.col("_met") == len(stems)).select("id", "score")
