"""Registration of queries with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch, views
from ..operators import fulltext, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_NOW = f"TIMESTAMP '{views.NOW}'"


def now() -> Column:
    """The reference time. A function, as columns cannot be made before a session is."""
    return F.lit(views.NOW).cast("timestamp")


#: Full-text indexes of this process: (application, directory, state of its files) to folder.
_INDEXES: dict[tuple, str] = {}


class Tables:
    """Logical views and raw tables of one directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)

    def text_index(self) -> fulltext.Index:
        """Open the index of the searchable memories, written once for each state of the files."""
        files = self.spark.read.format("binaryFile").load([f"{self.sf_dir}/{n}.parquet" for n in views.VIEWS["memories"][0]])
        state = files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38, 0)"))).first()[0]
        key = (self.spark.sparkContext.applicationId, self.sf_dir, str(state))
        if key not in _INDEXES:
            path = scratch.folder(self.spark)
            fulltext.Index.build(search.searchable(self.memories), path)
            _INDEXES[key] = path
        return fulltext.Index.open(self.spark, _INDEXES[key])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, views_used: str = ""):
    """Register ``f(tables) -> DataFrame``; ``sql`` is DuckDB SQL over the views named."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = views.oracle(sql.replace("$NOW", SQL_NOW), *views_used.split())
        return f

    return add


def epoch(column: str):
    """Seconds, so that results do not depend on how an engine prints times."""
    return F.unix_timestamp(column)
