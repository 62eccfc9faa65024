"""Removal of repeated passages by windows on winnowed anchors.

Seeds are five-word shingles. Every window of the threshold length has one anchor, the least shingle hash inside it, so
equal windows always share their anchor. On anchors that occur in two documents or more the windows around them are hashed and
grouped, and a window goes if a document with a smaller id has it too; overlapping windows make up the passages. No match is
extended from a pair of documents: a frequent anchor is only ever compared through minima, never as pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import WordHashes, discard, gram_hashes, load, pick, stored, utf8
from reviewlake.llm.registry import query

SEED_WORDS = 5
MIN_WORDS = 13

_LONGS = pa.list_(pa.int64())


def window_anchors(hashes: np.ndarray, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> np.ndarray:
    """The anchor of every window: the least shingle hash inside it."""
    low, span, need = gram_hashes(hashes, seed_words), 1, min_words - seed_words + 1
    while span < need:
        step = min(span, need - span)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        span += step
    return low


def _longs(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))


def _unsigned(scalar_list: pa.Scalar) -> np.ndarray:
    return scalar_list.values.to_numpy(zero_copy_only=False).view(np.uint64)


def seeds(docs: DataFrame) -> DataFrame:
    """Per row with an id: the distinct anchors of its windows."""
    def run(source):
        known = WordHashes()
        for batch in source:
            found = [np.unique(window_anchors(known.of(utf8(t or "").split()))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(found)], ["doc_id", "anchors"])

    return docs.where("doc_id is not null").mapInArrow(run, "doc_id long, anchors array<long>")


def windows(docs: DataFrame) -> DataFrame:
    """Per row: anchor and hash of each of its windows that lies on one of the given anchors."""
    def run(source):
        known = WordHashes()
        for batch in source:
            anchors, hashes = [], []
            for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = known.of(utf8(text or "").split())
                own = window_anchors(words)
                hit = np.isin(own, _unsigned(wanted))
                anchors.append(own[hit])
                hashes.append(gram_hashes(words, MIN_WORDS)[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs(anchors), _longs(hashes)], ["doc_id", "anchors", "windows"])

    return docs.mapInArrow(run, "doc_id long, anchors array<long>, windows array<long>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, repeats): hashes of the windows whose words also start in a document with a smaller id.

    A window is known by 128 bits, its anchor's hash and its own. Whether it is a repeat depends on the id alone, so rows
    that share an id may share their list.
    """
    sown = stored(seeds(docs), "repeat-seeds")
    anchors = sown.select("doc_id", F.explode("anchors").alias("anchor"))
    # Stored before the join: the minima's shuffle is gone by then, and a frequent key's rows can be split.
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = stored(shared, "repeat-shared")
    wanted = stored(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("wanted")), "repeat-anchors")
    discard(sown, shared)
    around = stored(windows(docs.join(wanted, "doc_id").select("doc_id", "text", "wanted")), "repeat-windows")
    discard(wanted)
    each = around.select("doc_id", F.explode(F.arrays_zip("anchors", "windows")).alias("w")).select(
        "doc_id", F.col("w.anchors").alias("anchor"), F.col("w.windows").alias("window"))
    first = each.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    first = stored(first.drop("high"), "repeat-first")
    later = each.join(first, ["anchor", "window"]).where("doc_id > low")
    found = stored(later.groupBy("doc_id").agg(F.collect_set("window").alias("repeats")), "repeat-found")
    discard(around, first)
    return found


def covered(words: np.ndarray, repeats: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Mask of the words inside a repeated window."""
    starts = np.isin(gram_hashes(words, min_words), repeats)
    depth = np.zeros(len(words) + 1, np.int64)
    depth[:len(starts)] += starts
    depth[min_words:min_words + len(starts)] -= starts
    return np.cumsum(depth)[:len(words)] > 0


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    Words are runs without ASCII white space. A window of 13 words goes if it also starts in a document with a smaller id;
    all windows are judged on the input. A null text has no words. A row with a null id neither removes nor loses words.
    Rows that repeat an id don't remove each other's words; equal rows give equal results.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    plain = pick(docs, doc_id="long", text="string")
    found = repeated_windows(plain)
    kinds = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if keep_text else {})

    def run(source):
        known, none = WordHashes(), np.empty(0, np.uint64)
        for batch in source:
            rows = []
            for text, repeats in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = utf8(text or "").split()
                kept = words
                if repeats.is_valid:
                    gone = covered(known.of(words), _unsigned(repeats) if len(repeats) else none)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            counts, removed, sha, texts = zip(*rows)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    joined = plain.join(found, "doc_id", "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 12), 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM windows) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
marked AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT m.doc_id, string_agg(word, ' ' ORDER BY m.p) AS t, count(*) AS n
  FROM marked m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.p = g.p WHERE g.p IS NULL GROUP BY m.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), keep_text=False)
