"""Mixing sources to target weights. DataFrame operations only.

Each source's share of tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The
exponent is the smallest one that keeps a limit: no source is repeated more often than allowed, or the weights' entropy is at
most a target. It is found by bisection, several halvings in each pass over the per-source totals. The weights times a token
budget give every source its tokens: whole passes over its documents, each in an order of its own, and part of another. A
pass is cut into blocks of a token budget, and the blocks of all sources are dealt out in one random order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.llm.common import load, pick, small, stored
from reviewlake.llm.registry import query

#: Tokens are counted as runs without white space.
_TOKEN = r"[^\x20\x09-\x0D]+"
#: Halvings in one pass, and passes.
_LEVELS, _PASSES = 8, 5


@dataclass(frozen=True)
class Mix:
    """budget_share: tokens asked for, as a share of all tokens. repeat_limit: passes over a source at most.
    entropy: if given, the weights' entropy (nats) at most, instead of the limit on passes."""

    budget_share: float = 1.0
    repeat_limit: float = 1.25
    entropy: float | None = None
    block_tokens: int = 1 << 16
    seed: str = "mix-1"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def _measure(mix: Mix) -> Column:
    """What the limit is about, for sources with ``p`` and ``tokens`` under exponent ``a``: it falls as the exponent grows for
    the passes, and rises with evenness for the entropy; either way the exponent must be large enough."""
    weight = F.pow("p", "a")
    if mix.entropy is not None:
        norm = F.sum(weight)
        return F.log(norm) - F.sum(weight * F.log("p") * F.col("a")) / norm
    return F.max(weight / F.col("p")) / F.sum(weight) * mix.budget_share


def find_exponent(shares: DataFrame, mix: Mix) -> float:
    """The smallest exponent in 0..1 that keeps the limit; 1 if none does. Each pass tries 2 ** _LEVELS - 1 places at once, the
    same that many single halvings could come to, and takes back one row for each: a fixed number, whatever the sources."""
    limit = mix.entropy if mix.entropy is not None else mix.repeat_limit
    low, high = 0.0, 1.0
    for _ in range(_PASSES):
        n = 1 << _LEVELS
        grid = [low + (high - low) * i / n for i in range(n + 1)]
        tried = shares.select("p", F.explode(F.array(*(F.lit(a) for a in grid))).alias("a")).groupBy("a").agg(_measure(mix).alias("m"))
        kept = sorted(r.a for r in tried.where(F.col("m") <= limit).collect())
        if not kept:
            return 1.0
        if kept[0] == low:
            return low
        high = kept[0]
        low = grid[grid.index(high) - 1]
    return high


def source_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source_key, tokens, weight, quota) from rows of (source_key, tokens)."""
    totals = stored(rows.groupBy("source_key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"), "mix-sources")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(total or 1)))
    exponent = find_exponent(shares, mix)
    raw = F.pow("p", F.lit(exponent))
    norm = shares.agg(F.sum(raw)).first()[0] or 1.0
    weight = raw / F.lit(norm)
    return stored(shares.select("source_key", "tokens", "docs", weight.alias("weight"), F.round(weight * mix.budget_share * total).cast("long").alias("quota")), "mix-plan")


def _order_key(mix: Mix, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(mix.seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document and pass taken: doc_id, source, tokens, epoch, block, draw.

    ``epoch`` is the pass (0 first), ``block`` the block of that source and pass, ``draw`` the random key by which blocks of
    all sources are ordered (documents of a block by ``rank``). A source gets whole passes while its quota lasts, then the
    documents of one more pass, in its order, of which the tokens before are below what is left. A null source is a source
    of its own; a text without a token is never drawn; equal rows are drawn each. Ties in the order fall to the id, then text.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    rows = pick(docs, doc_id="long", text="string", source="string")
    rows = rows.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), F.md5(F.col("text").cast("binary")).alias("text_key"),
                       token_count(F.col("text")).alias("tokens")).where("tokens > 0")
    rows = stored(rows, "mix-rows")
    plan = source_plan(rows.select("source_key", "tokens"), mix)
    passes = small(plan.select("source_key", F.col("tokens").alias("size"), "quota", "docs"))
    each = rows.join(passes, "source_key").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("size")))))
    each = each.where("quota > 0").withColumn("left", F.col("quota") - F.col("epoch") * F.col("size")).withColumn("rank", _order_key(mix, "epoch", "doc_id", "text_key"))
    # Running totals in two steps: a pass is cut by the leading digits of its order into about as many parts as a part has rows,
    # so that no source, however large, is added up in one task.
    digits = F.greatest(F.lit(1), F.ceil(F.log("docs") / F.log(F.lit(16.0)) / 2)).cast("int")
    each = each.withColumn("part", F.substring("rank", 1, digits))
    parts = each.groupBy("source_key", "epoch", "part").agg(F.sum("tokens").alias("part_tokens"))
    ahead = W.partitionBy("source_key", "epoch").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0))).select("source_key", "epoch", "part", "ahead")
    inside = W.partitionBy("source_key", "epoch", "part").orderBy("rank", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, -1)
    placed = each.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, ["source_key", "epoch", "part"])
    placed = placed.withColumn("before", F.col("ahead") + F.col("inside")).where("before < left")
    placed = placed.withColumn("block", F.floor(F.col("before") / mix.block_tokens))
    return placed.select("doc_id", "source", "tokens", "epoch", "block", _order_key(mix, "source_key", "epoch", "block").alias("draw"), "rank")


OP2_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS source_key, md5(text) AS text_key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
totals AS (SELECT source_key, sum(tokens)::BIGINT AS tokens FROM rows WHERE tokens > 0 GROUP BY source_key),
shares AS (SELECT *, tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS p FROM totals),
bisect(n, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT n + 1,
    CASE WHEN (SELECT max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) FROM shares) <= 1.25 THEN low ELSE (low + high) / 2 END,
    CASE WHEN (SELECT max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) FROM shares) <= 1.25 THEN (low + high) / 2 ELSE high END
  FROM bisect WHERE n < 40),
exponent AS (
  SELECT CASE WHEN (SELECT 1 / min(p) / count(*) FROM shares) <= 1.25 THEN 0.0 ELSE (SELECT high FROM bisect WHERE n = 40) END AS a),
plan AS (
  SELECT source_key, tokens AS size, round(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, exponent) * (SELECT sum(tokens) FROM totals))::BIGINT AS quota
  FROM shares, exponent),
each AS (
  SELECT rows.*, size, quota, unnest(range(0, ((quota - 1) // size + 1)::BIGINT)) AS epoch FROM rows JOIN plan USING (source_key) WHERE tokens > 0 AND quota > 0),
ranked AS (SELECT *, md5(concat_ws('|', 'mix-1', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''), text_key)) AS rank FROM each),
placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source_key, epoch ORDER BY rank, doc_id, text_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM ranked)
SELECT doc_id, source, tokens, epoch::BIGINT AS epoch, (before // 65536)::BIGINT AS block,
  md5(concat_ws('|', 'mix-1', source_key, epoch::VARCHAR, (before // 65536)::BIGINT::VARCHAR)) AS draw, rank
FROM placed WHERE before < quota - epoch * size
"""


@query("op2_source_mixture", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))
