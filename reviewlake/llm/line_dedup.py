"""Removal of lines that other documents hold too.

Lines are normalised and hashed, distinct documents are counted per hash, and lines over the threshold go from all documents
but the one with the smallest id; what stays is put together again by position. Only hashes are shuffled (128 bits, so that
no two keys of a corpus are taken for one), and a document sends each key once, however often it repeats the line. A key that
every document holds is counted by map-side aggregates; its rows are joined from a stored table, which a skewed join splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import discard, load, pick, stored, utf8
from reviewlake.llm.registry import query

MIN_CHARS = 10
MIN_DOCUMENTS = 2
_SPACE = b" \t\n\x0b\x0c\r"
_KEY = ["k0", "k1"]
_LONGS = pa.list_(pa.int64())


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the line without outer ASCII white space, A-Z lower-cased; None below ``min_chars`` code points."""
    key = line.strip(_SPACE).lower()
    # Continuation bytes are no code points of their own; most lines are long enough in any case.
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k0, k1): each distinct key of each row."""
    def run(source):
        for batch in source:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {line_key(line, min_chars) for line in utf8(text or "").split(b"\n")} - {None}
                if keys:
                    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                    ids = np.full(len(keys), doc_id, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", *_KEY])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, k0 long, k1 long")


def common_keys(hashes: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(k0, k1, low): keys of at least ``min_documents`` documents, and the smallest id that holds them."""
    low = F.min("doc_id").alias("low")
    if min_documents == 2:
        # Two documents hold a key exactly if its ids differ; this needs no set of ids.
        return hashes.groupBy(*_KEY).agg(low, F.max("doc_id").alias("high")).where("low < high").drop("high")
    return hashes.groupBy(*_KEY).agg(low, F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_documents).drop("n")


def lost_keys(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    """(doc_id, k0s, k1s), a stored table: the keys whose lines a document loses."""
    hashes = stored(line_hashes(docs, min_chars), "line-hashes")
    common = stored(common_keys(hashes, min_documents), "line-common")
    later = hashes.join(common.hint("shuffle_hash"), _KEY).where("doc_id > low").select("doc_id", F.struct(*_KEY).alias("key"))
    # A set: rows that repeat an id send their keys twice.
    lost = stored(later.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).select(
        "doc_id", *(F.col(f"keys.{k}").alias(f"{k}s") for k in _KEY)), "line-lost")
    discard(hashes, common)
    return lost


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines (before dropping), n_dropped, kept_sha256, and kept_text if asked for.

    A line goes if its key has at least ``min_chars`` code points and stands in at least ``min_documents`` documents, unless the
    row has the smallest id of them; all its repetitions inside the document go with it. A null or empty text is one empty line,
    which stays. A row with a null id is no document: it neither counts nor loses lines. Rows that repeat an id are one document,
    and lose the same keys. Very long texts are worked whole, one text at a time; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    plain = pick(docs, doc_id="long", text="string")
    lost = lost_keys(plain, min_chars, min_documents)
    kinds = {"doc_id": "long", "n_lines": "long", "n_dropped": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if keep_text else {})

    def keys_of(row: pa.Scalar) -> np.ndarray:
        return row.values.to_numpy(zero_copy_only=False)

    def run(source):
        for batch in source:
            rows = []
            for text, first, second in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                lines = utf8(text or "").split(b"\n")
                kept = lines
                if first.is_valid:
                    raw = np.stack([keys_of(first), keys_of(second)], axis=1).tobytes()
                    gone = {raw[i:i + 16] for i in range(0, len(raw), 16)}
                    kept = [line for line in lines if line_key(line, min_chars) not in gone]
                joined = b"\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            counts, dropped, sha, texts = zip(*rows)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    # Joined by a shuffle at every size; the lists, not the texts, are what a task holds. Rows without an id would meet in one task.
    found = plain.where("doc_id is not null").join(lost.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "k0s", "k1s")
    none = F.lit(None).cast("array<bigint>")
    joined = found.unionByName(plain.where("doc_id is null").select("doc_id", "text", none.alias("k0s"), none.alias("k1s")))
    return joined.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


OP13_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(doc_id > low, false) AS gone FROM keyed k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op13_line_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(load(spark, sf_dir, "documents"), keep_text=False)
