"""Registered queries: each reads whole driver tables and, where SQL can say it, carries its equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlake.session import read_table

#: Rows of an Arrow batch: Spark's own number, and one for queries that hand whole texts to Python, where a worker holds a few batches.
BATCH_ROWS, TEXT_BATCH_ROWS = 10_000, 256
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = read_table(self.spark, f"{self.sf_dir}/{name}.parquet")
        return self._seen[name]

    def stream(self, name: str) -> DataFrame:
        """The table as a stream, be it one file or a folder of files; a pattern is the one path that a stream takes for both."""
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def query(name: str, sql: str | None = None, batch_rows: int = BATCH_ROWS):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The SQL side reads timestamps as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
            return fn(Tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
