"""Ranking helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_LIMIT_MAX = 1000  # spark.sql.optimizer.windowGroupLimitThreshold


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = "rank") -> DataFrame:
    """First ``k`` rows per key.

    Spark plans ``row_number() <= k`` as a group limit before the shuffle, so every task sends at most
    ``k`` rows per key. Beyond the size Spark does that for, a salted first pass does the same.
    """
    name = rank or "__rank"
    if k > GROUP_LIMIT_MAX:
        salted = Window.partitionBy(*keys, "__part").orderBy(*order)
        df = df.withColumn("__part", F.spark_partition_id()).withColumn("__local", F.row_number().over(salted))
        df = df.where(F.col("__local") <= k).drop("__part", "__local")
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. ``order`` must be total over the rows of a key."""
    return top_k(df, keys, order, 1, rank=None)
