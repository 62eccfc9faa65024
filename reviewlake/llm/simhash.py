"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked if they differ in at most two bits. Bits are grouped into parts so that correlated bits
stand together; dynamic programming gives each part a threshold of its own from the candidates it is expected to cause; a
part with threshold t is probed with every key within t bits. Any two fingerprints within two bits then meet in a part.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import discard, load, pick, stored, utf8
from reviewlake.llm.registry import query

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
#: A bucket with more fingerprints is divided further before its pairs are compared.
BUCKET = 64
#: Into how many parts the bits of fingerprints in crowded buckets are divided, step by step; the last leaves six bits open.
FINER = (6, 12, 24)
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values; 0 without words."""
    words = utf8(text or "").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle_words + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[-n:] - 1).tolist()
    starts = [0, *ends[:n - 1].tolist()]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, carry: dict[str, str], text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The carried columns and ``fp`` (64 bits as a long) of every row."""
    rows = pick(docs, **carry, **{text: "string"})
    out = rows.drop(text).schema.add("fp", "long")

    def run(source):
        for batch in source:
            values = [_signed(fingerprint(t, shingle_words)) for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carry)], pa.array(values, pa.int64())], [*carry, "fp"])

    return rows.mapInArrow(run, out)


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them bits i and j (of 64) are both set."""
    def run(source):
        total = np.zeros((64, 64), np.int64)
        for batch in source:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1).astype(np.float32)[:, ::-1]
            total += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(4096) // 64, pa.int32()), pa.array(np.arange(4096) % 64, pa.int32()), pa.array(total.ravel())], ["i", "j", "n"])

    both = np.zeros((64, 64), np.int64)
    for i, j, n in fps.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = n
    return fps.count(), both


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for size in [len(x) for x in np.array_split(np.arange(64), parts)]:
        part = [max(left, key=lambda b: (corr[b, left].max(initial=0), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (corr[b, part].sum(), -b)))
            left.remove(part[-1])
        out.append(sorted(part))
    return out


def expected_cost(n: int, p: np.ndarray, bits: list[int], threshold: int) -> float:
    """Candidate pairs that agree in these bits up to ``threshold``, if bits were independent, plus the keys probed."""
    if threshold < 0:
        return 0.0
    ways = np.zeros(threshold + 1)
    ways[0] = 1
    for b in bits:
        same = p[b] ** 2 + (1 - p[b]) ** 2
        ways[1:] = ways[1:] * same + ways[:-1] * (1 - same)
        ways[0] *= same
    probes = sum(len(list(combinations(range(len(bits)), t))) for t in range(threshold + 1))
    return float(n) * n / 2 * float(ways.sum()) + float(n) * probes


def allocate(costs: list[list[float]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = distance + 1 and the least cost. costs[i][t + 1] is the cost of t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for take in range(min(len(row) - 1, distance + 1 - used) + 1):
                new = (cost + row[take], [*chosen, take - 1])
                if used + take not in step or new < step[used + take]:
                    step[used + take] = new
        best = step
    return best[distance + 1]


def plan_parts(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least expected cost among divisions into one to distance + 1 parts; unused parts fall out."""
    p, found = np.diag(both) / max(n, 1), []
    for m in range(1, distance + 2):
        groups = correlated_parts(n, both, m)
        cost, chosen = allocate([[expected_cost(n, p, g, t) for t in range(-1, distance + 1)] for g in groups], distance)
        found.append((cost, m, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(found)[2]


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _keys(bits: list[int], threshold: int) -> Column:
    """The part of ``fp``, and every value within ``threshold`` bits of it."""
    own = F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long"))
    flips = [_mask(list(c)) for t in range(threshold + 1) for c in combinations(bits, t)]
    return F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), lambda x: own.bitwiseXOR(x))


def _masks(order: list[int], parts: int, distance: int) -> list[int]:
    """The bits outside every choice of ``distance`` of the parts: two linked fingerprints agree in one of these masks."""
    groups = [[int(b) for b in g] for g in np.array_split(order, parts)]
    return [_mask([b for i, g in enumerate(groups) if i not in out for b in g]) for out in combinations(range(parts), distance)]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most ``distance`` bits; each pair at least once.

    A bucket of many fingerprints is never compared whole: its members, with those that probe it, go on to finer parts, of
    which a linked pair agrees in all but ``distance``. At the last step a key leaves so few bits open that a bucket can
    hold no more than a few dozen distinct fingerprints.
    """
    n, both = _bit_counts(fps)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    plan = plan_parts(n, both, distance)
    order = [b for bits, _ in plan for b in bits]
    order += [b for b in range(64) if b not in order]
    found: list[DataFrame] = []
    index = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("key"))
                      for k, (bits, _) in enumerate(plan)))
    probed = [(k, bits, t) for k, (bits, t) in enumerate(plan) if t]
    step, members = 0, fps
    while True:
        keys = stored(members.select("fp", F.explode(index).alias("i")).select("fp", "i.part", "i.key"), f"simhash-keys-{step}")
        sizes = stored(keys.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), f"simhash-buckets-{step}")
        last = step == len(FINER)
        fine = sizes if last else sizes.where(F.col("n") <= BUCKET)
        plain = keys.join(fine.select("part", "key"), ["part", "key"])
        found.append(plain.withColumnRenamed("fp", "a").join(plain.withColumnRenamed("fp", "b"), ["part", "key"])
                     .where((F.col("a") < F.col("b")) & close).select("a", "b"))
        hot = sizes.where(F.col("n") > BUCKET).select("part", "key")
        crowded = keys.join(hot, ["part", "key"], "left_semi").select("fp")
        if step == 0:
            for k, bits, t in probed:
                # Every key within t bits against the exact keys; probes of crowded keys go on with those they hit.
                probe = members.select("fp", F.lit(k).alias("part"), F.explode(_keys(bits, t)).alias("key"))
                exact = keys.where(F.col("part") == k).join(hot, ["part", "key"], "left_anti")
                found.append(probe.withColumnRenamed("fp", "a").join(exact.withColumnRenamed("fp", "b"), ["part", "key"]).where("a != b")
                             .where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
                crowded = crowded.union(probe.join(hot, ["part", "key"], "left_semi").select("fp"))
        if last or hot.limit(1).count() == 0:
            break
        members = stored(crowded.distinct(), f"simhash-crowded-{step}")
        index = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                          for k, m in enumerate(_masks(order, FINER[step], distance))))
        step += 1
    out = found[0]
    for frame in found[1:]:
        out = out.union(frame)
    return stored(out.distinct(), "simhash-links")


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``pairs`` (a, b): root is the least node reachable.

    Alternating star operations on stored tables. Each round hooks a node's neighbours to its least neighbour, so rounds
    grow with the logarithm of the longest chain; the stars' minima are aggregated before they are shuffled. The result reads the
    last round's table, which ``discard`` deletes.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star-edges")
    before = None
    while True:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "star-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, stored(small.select("e.u", "e.v").where("u != v").distinct(), "star-edges")
        discard(last, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
    out.stored_at = edges.stored_at
    return out


def components(rows: DataFrame, id_column: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """``rows`` (a stored table with ``fp``) with ``component_id``: the least id among all rows reachable over links."""
    groups = stored(rows.groupBy("fp").agg(F.min(id_column).alias("low")), "simhash-distinct")
    member = stored(connected(links(groups.select("fp"), distance)), "simhash-members")
    rooted = groups.join(member, groups.fp == member.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id.

    A null or blank text has fingerprint zero and is linked like any other. Rows that repeat an id each give a row. A row
    with a null id takes part in the links; its component is named by the least other id, null if there is none.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    rows = stored(fingerprints(docs, {id_column: "long"}, text), "simhash-rows")
    return components(rows, id_column).select(
        id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_simhash_components")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
