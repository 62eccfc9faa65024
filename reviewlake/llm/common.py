"""What the corpus operators share: safe column selection, stored steps, size checks before broadcasts, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.session import shared_dir

#: Rows of one Arrow batch. Texts may be very long, so batches stay small.
BATCH_ROWS = 256
#: A table is broadcast only if a count has shown that it has at most so many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches for the session, as every later plan may carry whole texts, and UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types, whatever else the table holds.

    Columns are taken by exact name and position, so others that differ in case only, or repeat a name, do no harm.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(name)}").cast(kind).alias(name) for name, kind in columns.items()))


_COLLECTING: list[list[DataFrame]] = []


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables stored inside the block, for a caller that deletes them once what it made of them is written."""
    _COLLECTING.append([])
    try:
        yield _COLLECTING[-1]
    finally:
        _COLLECTING.pop()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and its shuffle files go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/reviewlake/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for tables in _COLLECTING:
        tables.append(out)
    return out


ROW_KEY = "row_key__"


def keyed(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` stored with a key of its own for every row, so that rows with null or repeated ids stay apart.

    The file's columns are numbered, as names that differ in case only can't be written.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    table = stored(plain.withColumn(ROW_KEY, F.monotonically_increasing_id()), label)
    out = table.toDF(*docs.columns, ROW_KEY)
    out.stored_at = table.stored_at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing later reads: what was made from them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if it is shown to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hash_sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of the ``most`` rows of each label that come first by a hash of the id, as a stored table.

    Counts per label come first: of a large label only hashes that can be among the first are ranked (about twice as many as
    asked for), so no task sees a label's rows all together.
    """
    space = 1 << 52
    ids = rows.select("doc_id", F.col(label).alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(space)).alias("place"))
    counts = small(stored(ids.groupBy("label").agg(F.count("*").alias("n")), "label-counts"))
    near = ids.join(counts, "label").where(F.col("place") < F.lit(float(space)) * F.least(F.lit(1.0), F.lit(2.0 * most + 100) / F.col("n")))
    first = W.partitionBy("label").orderBy("place", "doc_id")
    return stored(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).select("doc_id", "label"), "label-sample")


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a fixed number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` neighbouring words, by polynomial and final mixing."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= _BASE
        out += hashes[i:i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def batches(source: Iterable[pa.RecordBatch], rows, schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Run the generator function ``rows`` over each batch; its tuples leave in batches of at most ``size``."""
    kept: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*kept))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in source:
        for row in rows(batch):
            kept.append(row)
            if len(kept) >= size:
                yield flush()
                kept.clear()
    if kept:
        yield flush()


def ascii_lower_word(word: Column) -> Column:
    """A-Z to a-z and nothing else. The plain lower() is right, and much faster, for words that are all ASCII."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, letters, letters.lower()))
