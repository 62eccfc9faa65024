"""Product quantisation by Lloyd's rounds that look at active entries only.

Vectors become integers and are cut into parts; every part position has a codebook of its own. A part whose assigned entry did not
move since the last round keeps its stored distance, which is exact, and is compared with the moved entries only: the entries
that stayed were no better before and are no better now. A part whose own entry moved is compared with all of them. Equal
distances go to the lower index either way, so the codes are those of full scans.

State is a table: each round reads vectors with code and distance, and writes them anew. Only the codebooks and the sums per entry,
whose sizes are parameters, reach the driver. All arithmetic is in 64-bit integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import discard, load, pick, small, stored
from reviewlake.llm.registry import query

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components from this size on are left out like non-finite ones: their squares would not fit into 64 bits.
MAX_COMPONENT = 65_536.0
#: Into how many keys a label is split when the sums of labels are too many to broadcast.
SALTS = 16
_BLOCK = 1024


def part_slices(length: int, parts: int) -> list[slice]:
    """Consecutive parts of equal length; if the length is no multiple, the first ones are longer by one."""
    ends = np.cumsum([length // parts + (i < length % parts) for i in range(parts)]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has components, all of them finite numbers below ``MAX_COMPONENT``."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MAX_COMPONENT))
    return rows.where(F.coalesce((F.size("embedding") > 0) & fine, F.lit(False)))


def scaled(rows: DataFrame, length: int, scale: int) -> DataFrame:
    """``vector``: the integers floor(scale * x) of the vectors of this length."""
    return rows.where(F.size("embedding") == length).select(
        "vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("vector"))


def distances(block: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``block`` to every entry."""
    gap = block[:, None, :] - entries[None, :, :]
    return np.einsum("nej,nej->ne", gap, gap)


def assign(part: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray | None, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its distance, ties to the lower index. ``code`` and ``held``: those before ``moved`` entries moved."""
    if code is None:
        all_of = distances(part, entries)
        code = all_of.argmin(axis=1)
        return code, all_of[np.arange(len(part)), code]
    code, held = code.copy(), held.copy()
    lost = np.flatnonzero(moved[code])
    fixed = np.flatnonzero(~moved[code])
    active = np.flatnonzero(moved)
    if len(fixed) and len(active):
        near = distances(part[fixed], entries[active])
        at = near.argmin(axis=1)  # the first of equal ones, which has the lower index
        best, index = near[np.arange(len(fixed)), at], active[at]
        better = (best < held[fixed]) | ((best == held[fixed]) & (index < code[fixed]))
        code[fixed[better]], held[fixed[better]] = index[better], best[better]
    if len(lost):
        all_of = distances(part[lost], entries)
        code[lost] = all_of.argmin(axis=1)
        held[lost] = all_of[np.arange(len(lost)), code[lost]]
    return code, held


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def assigned(state: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None, slices: list[slice]) -> DataFrame:
    """``state`` with codes and distances (``held``) for these codebooks. ``moved`` is None in the first round, which has no codes."""
    width = slices[-1].stop

    def run(source):
        for batch in source:
            for at in range(0, batch.num_rows, _BLOCK):
                block = batch.slice(at, _BLOCK)
                vectors = _matrix(block.column(2), width)
                before = [None, None] if moved is None else [_matrix(block.column(i), len(slices)) for i in (3, 4)]
                code, held = np.empty((2, len(vectors), len(slices)), np.int64)
                for p, cut in enumerate(slices):
                    code[:, p], held[:, p] = assign(
                        vectors[:, cut], books[p], None if moved is None else moved[p], *(None if b is None else b[:, p] for b in before))
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:3], _lists(code, pa.int16()), _lists(held, pa.int64())], ["vec_id", "label", "vector", "code", "held"])

    return state.mapInArrow(run, "vec_id long, label long, vector array<int>, code array<smallint>, held array<long>")


def entry_sums(state: DataFrame, entries: int, slices: list[slice]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Per part and used entry: how many parts it has, and their componentwise sum. Summed in each task before the shuffle."""
    width = slices[-1].stop

    def run(source):
        counts = np.zeros((len(slices), entries), np.int64)
        sums = [np.zeros((entries, s.stop - s.start), np.int64) for s in slices]
        for batch in source:
            vectors, code = _matrix(batch.column(0), width), _matrix(batch.column(1), len(slices))
            for p, cut in enumerate(slices):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], vectors[:, cut])
        part, entry = np.nonzero(counts)
        totals = [np.concatenate([[counts[p, e]], sums[p][e]]) for p, e in zip(part, entry)]
        at = [np.arange(len(t)) for t in totals]
        sizes = [len(t) for t in totals]
        none = [np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part, sizes), pa.int32()), pa.array(np.repeat(entry, sizes), pa.int32()),
            pa.array(np.concatenate(none + at), pa.int32()), pa.array(np.concatenate(none + totals), pa.int64())], ["part", "entry", "place", "total"])

    rows = state.select("vector", "code").mapInArrow(run, "part int, entry int, place int, total long")
    out: dict[tuple[int, int], dict[int, int]] = {}
    # parts x entries x (1 + length of a part) numbers.
    for part, entry, place, total in rows.groupBy("part", "entry", "place").agg(F.sum("total")).collect():
        out.setdefault((part, entry), {})[place] = total
    return {key: (totals[0], [totals[i] for i in range(1, len(totals))]) for key, totals in out.items()}


def train(vectors: DataFrame, books: list[np.ndarray], slices: list[slice], rounds: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Assign and replace the entries ``rounds`` times, then assign once more: the final state (stored) and codebooks."""
    state = stored(assigned(vectors, books, None, slices), "codes-0")
    for turn in range(1, rounds + 1):
        sums = entry_sums(state, len(books[0]), slices)
        after = [book.copy() for book in books]
        for (part, entry), (n, total) in sums.items():
            after[part][entry] = [t // n for t in total]
        moved = [(old != new).any(axis=1) for old, new in zip(books, after)]
        books = after
        if any(m.any() for m in moved):
            last, state = state, stored(assigned(state, books, moved, slices), f"codes-{turn}")
            discard(last)
    return state, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``label_error``: the error summed over equal labels, nulls together."""
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    side = small(sums)
    if side is sums:
        # A label may hold most of the rows; sums are one row a label, so it is these that are repeated.
        coded = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        side = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    side = side.withColumnRenamed("label", "of_label")
    on = F.col("label").eqNullSafe(F.col("of_label"))
    if "salt" in side.columns:
        side = side.withColumnRenamed("salt", "of_salt")
        on = on & (F.col("salt") == F.col("of_salt"))
    return coded.join(side, on).drop("of_label", "salt", "of_salt")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per usable row: vec_id, code, error, label_error, codebooks_sha256, label.

    Rows are left out whose vector is null or empty, holds a null, non-finite or too large component, or has another length than
    that of the smallest vec_id. The codebooks start from the rows of the smallest vec_ids (nulls last, equal ids by their
    vectors); with fewer rows there are fewer entries. Rows that repeat an id are rows of their own. An empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    plain = usable(pick(rows, vec_id="long", label="long", embedding="array<float>"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = plain.orderBy(*order).limit(1).collect()
    length = len(first[0].embedding) if first else parts
    slices = part_slices(length, parts)
    vectors = scaled(plain, length, scale)
    # ``entries`` rows.
    start = np.array([r.vector for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()], np.int64)
    start = start.reshape(-1, length)
    if not len(start):
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                              F.lit(digest([])).alias("codebooks_sha256"), "label")
    state, books = train(vectors, [start[:, cut] for cut in slices], slices, rounds)
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    coded = state.select("vec_id", "label", code.alias("code"), F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by full scans, a pair of common table expressions a round."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM cut
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for k in range(rounds + 1):
        steps.append(f"""
code{k} AS MATERIALIZED (
  SELECT vec_id, p, x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT vec_id, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM cut JOIN book{k} USING (p)) GROUP BY vec_id, p, x)""")
        if k < rounds:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM code{k}, range(1, len(x) + 1) t(i) GROUP BY p, best.e, i) GROUP BY p, e) m
  USING (p, e))""")
    return "WITH" + ",".join(steps) + f""",
told AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM code{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM told JOIN kept USING (vec_id)"""


@query("op11_vector_codes", oracle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(load(spark, sf_dir, "embeddings")).drop("label")
