"""A corpus pipeline out of the training-data operators.

Documents that score as toxic go, one document of each group of near copies
stays, contaminated documents go, sources are mixed to their target weights (a
document taken twice or thrice is a row twice or thrice), and what is left is
written as token ids and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramix.llm import common, decontaminate, jaccard_join, mixing, queries, token_files, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rows that do not score as toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of documents whose 5-word shingles overlap to 80 %, the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs, 5, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows that benchmark windows do not cover to 5 %."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows as often as the mix takes them."""
    return mixing.remix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, start, n_tokens and ids_crc32 of every row, from the files."""
    folder = common.shared_dir(spark)
    return token_files.read(spark, folder, token_files.write(docs, folder, queries.tokenizer_path()), docs.select("doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: Toxicity and token ids have no SQL form. Every stage and the chain are tested against brute-force versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = common.save(stage(spark, docs, sf_dir), f"{folder}/stage{i}")
    return docs
