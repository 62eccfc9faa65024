"""Key-file discovery: shallow candidates, category searches, quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions import predicates as B
from reviewlake.functions.paths import path_depth
from reviewlake.functions.text import contains_any
from reviewlake.operators.corpus import content_by_path
from reviewlake.operators.topk import top_k

KEYS = ["project_path", "path"]


def shallowest_distinct(files: DataFrame, limit: int = K.TERM_SEARCH_CANDIDATES) -> DataFrame:
    """The ``limit`` shallowest different paths per project, metadata only."""
    meta = files.groupBy(*KEYS).agg(F.min("name").alias("name"))
    return top_k(meta.withColumn("depth", path_depth("path")), ["project_path"], [F.col("depth"), F.col("path")], limit, "place")


def term_search(files: DataFrame) -> DataFrame:
    """Files any category search finds: ``category`` of the last search that hit, ``rank`` in scan order.

    Term searches look at the shallow candidates only, and only those have their content read.
    """
    near = shallowest_distinct(files)
    content = content_by_path(files.join(near.select(*KEYS), KEYS, "left_semi"))
    cand = near.join(content, KEYS)
    texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("content", "path", "name")]
    hits, named = [], None
    for order, (category, matcher, terms, likes, limit) in enumerate(K.KEY_FILE_SEARCHES):
        fits = B.matches_file_type("path", "name", matcher)
        if terms:
            found = reduce(lambda a, b: a | b, (contains_any(t, terms) for t in texts))
            hits.append(F.when(found & fits, F.lit(order)))
        else:
            like = reduce(lambda a, b: a | b, (F.col(c).like(p) for c, p in likes))
            meta = files.where(like).groupBy(*KEYS).agg(F.min("name").alias("name")).withColumn("depth", path_depth("path"))
            part = top_k(meta, ["project_path"], [F.col("depth"), F.col("path")], limit, rank=None).where(fits).select(
                *KEYS, "name", "depth", F.lit(order).alias("search"))
            named = part if named is None else named.unionByName(part)
    by_term = cand.select(*KEYS, "name", "depth", F.explode(F.array_compact(F.array(*hits))).alias("search"))
    every = by_term.unionByName(named).groupBy(*KEYS).agg(
        F.min("search").alias("first"), F.max("search").alias("last"), F.min("depth").alias("depth"), F.min("name").alias("name"))
    categories = F.array(*[F.lit(s[0]) for s in K.KEY_FILE_SEARCHES])
    return every.select(*KEYS, "name", "first", "depth", F.element_at(categories, F.col("last") + 1).alias("category"))


def category_quota(candidates: DataFrame, order, keys=("project_path",), quotas=None, limit: int = K.KEY_FILE_LIMIT) -> DataFrame:
    """First rows per category up to its quota, then the first ``limit`` overall, in ``order``."""
    quotas = quotas or K.CATEGORY_QUOTAS
    allowed = F.lit(K.DEFAULT_QUOTA)
    for name, quota in quotas.items():
        allowed = F.when(F.col("category") == name, quota).otherwise(allowed)
    widest = max([K.DEFAULT_QUOTA, *quotas.values()])
    picked = top_k(candidates, [*keys, "category"], order, widest, "nth").where(F.col("nth") <= allowed).drop("nth")
    return top_k(picked, list(keys), order, limit, "rank")


def select_key_files(files: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Candidates of all searches, cut by the category quotas; only files that still exist when given."""
    found = term_search(files)
    if live is not None:
        found = found.join(live.select(*KEYS), KEYS, "left_semi")
    return category_quota(found, [F.col("first"), F.col("depth"), F.col("path")])


def validate_key_files(key_files: DataFrame, live: DataFrame, min_share: float = 0.7) -> DataFrame:
    """Key files that still exist, and per project whether too few survive (``rediscover``)."""
    kept = key_files.join(live.select(*KEYS).distinct().withColumn("exists", F.lit(True)), KEYS, "left")
    share = kept.groupBy("project_path").agg(
        F.count("*").alias("n_before"), F.count("exists").alias("n_after"))
    flags = share.withColumn("rediscover", F.col("n_after") < F.col("n_before") * min_share)
    return kept.where("exists").drop("exists").join(flags.select("project_path", "rediscover"), "project_path")
