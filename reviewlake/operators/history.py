"""Review-comment history: synchronisation state, pruning, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions.classify import pattern_tags
from reviewlake.functions.text import or_default

PR_KEYS = ["repository", "pr_number"]
DIMENSIONS = {
    "comment_type": ("comment_type", "unknown"), "issue_category": ("issue_category", "general"),
    "severity": ("severity", "minor"), "author": ("author", "unknown"), "repository": ("repository", "unknown"),
}


def timestamp(c: Column | str) -> Column:
    """Parsed ISO text; null when it is no date."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def pr_sync_state(comments: DataFrame, keys: list[str] = PR_KEYS) -> DataFrame:
    return comments.where(F.col("pr_number") != 0).groupBy(*keys).agg(
        F.count("*").alias("comment_count"),
        F.max(timestamp(or_default("updated_at", F.col("created_at"), falsy=""))).alias("latest_comment_at"),
        F.max(timestamp("pr_updated_at")).alias("latest_pr_updated_at"),
    )


def skip_processed(prs: DataFrame, state: DataFrame, keys: list[str] = PR_KEYS) -> DataFrame:
    """Adds ``skip``: the stored state is at least as new as the pull request.

    Rows stored before pull-request times were kept count as processed when they have any comment time;
    an unreadable date never skips.
    """
    changed = timestamp(or_default("updated_at", or_default("merged_at", F.col("created_at"), falsy=""), falsy=""))
    skip = F.when(F.col("comment_count").isNull(), False).when(
        F.col("latest_pr_updated_at").isNull(), F.col("latest_comment_at").isNotNull()
    ).otherwise(F.coalesce(changed <= F.col("latest_pr_updated_at"), F.lit(False)))
    return prs.join(state, keys, "left").select(*[prs[c] for c in prs.columns if c not in keys], *keys, skip.alias("skip"))


def live_ids(declared: DataFrame, processed: DataFrame, keys: list[str] = PR_KEYS) -> DataFrame:
    """Ids that exist: the declared ones and the processed ones, once each."""
    columns = [*keys, "id"]
    return declared.select(*columns).unionByName(processed.select(*columns)).where(F.col("id").isNotNull()).distinct()


def stale_comments(
    stored: DataFrame, replaced: DataFrame, live: DataFrame, failed: DataFrame | None = None, keys: list[str] = PR_KEYS
) -> DataFrame:
    """Stored comments of fully re-fetched pull requests that no longer exist.

    A pull request without live ids loses all; one whose storage failed loses none.
    """
    scope = replaced.select(*keys).distinct()
    if failed is not None:
        scope = scope.join(failed.select(*keys), keys, "left_anti")
    return stored.join(scope, keys, "left_semi").join(live.select(*keys, "id"), [*keys, "id"], "left_anti")


def union_comments(review: DataFrame, issue: DataFrame) -> DataFrame:
    return review.withColumn("type", F.lit("review")).unionByName(issue.withColumn("type", F.lit("issue")), allowMissingColumns=True)


def comment_stats(comments: DataFrame) -> DataFrame:
    """``(dimension, value, n)`` for five dimensions and the total, in one aggregation over all rows."""
    values = {name: or_default(column, default) for name, (column, default) in DIMENSIONS.items()}
    filled = comments.select(*[v.alias(name) for name, v in values.items()])
    names = list(values)
    sets = [[F.col(n)] for n in names] + [[]]
    grouped = filled.groupingSets(sets, *[F.col(n) for n in names]).agg(
        F.count("*").alias("n"), *[F.grouping(n).alias(f"g_{n}") for n in names]
    )
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for n in names:
        which = F.when(F.col(f"g_{n}") == 0, F.lit(n)).otherwise(which)
        value = F.when(F.col(f"g_{n}") == 0, F.col(n)).otherwise(value)
    return grouped.select(F.coalesce(which, F.lit("total")).alias("dimension"), value.alias("value"), "n")


def comment_totals(comments: DataFrame) -> DataFrame:
    day = F.date_format(timestamp("created_at"), "yyyy-MM-dd")
    return comments.agg(
        F.count("*").alias("total_comments"),
        F.count_distinct(F.when(F.col("pr_number") != 0, F.col("pr_number"))).alias("total_prs"),
        F.count_distinct(or_default("author", "unknown")).alias("unique_authors"),
        F.coalesce(F.min(day), F.lit("N/A")).alias("earliest"), F.coalesce(F.max(day), F.lit("N/A")).alias("latest"),
    )


def last_analysis(comments: DataFrame, keys=("repository", "project_path")) -> DataFrame:
    return comments.groupBy(*keys).agg(F.max("created_at").alias("last_created_at"))


def has_comments(comments: DataFrame, repository: str, project: str | None = None) -> DataFrame:
    """One row. The limit stops the scan at the first match."""
    hit = comments.where(F.col("repository") == repository)
    if project is not None:
        hit = hit.where(F.col("project_path") == project)
    return hit.limit(1).agg((F.count("*") > 0).alias("has_comments"))


def history_patterns(stats: DataFrame) -> DataFrame:
    """Share of each type, category and severity among all comments, to one decimal, as text."""
    total = stats.where("dimension = 'total'").select(F.col("n").alias("total"))
    share = F.when(F.col("total") > 0, F.format_string("%.1f", F.round(F.col("n") / F.col("total") * 100, 1))).otherwise("0.0")
    kept = stats.where(F.col("dimension").isin("comment_type", "issue_category", "severity"))
    # One row against few: the total is a single aggregated row.
    return kept.join(F.broadcast(total)).select(
        F.col("dimension").alias("type"), F.col("value").alias("name"), F.col("n").alias("count"), share.alias("percentage")
    )


def top_authors(comments: DataFrame, k: int = 10) -> DataFrame:
    counts = comments.groupBy(or_default("author", "unknown").alias("author")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), "author").limit(k)


def total_prs(comments: DataFrame, keys=("repository",)) -> DataFrame:
    """Number of pull requests with comments."""
    return comments.groupBy(*keys).agg(F.count_distinct(F.when(F.col("pr_number") != 0, F.col("pr_number"))).alias("total_prs"))


def pattern_weights(comments: DataFrame, text: str = "comment_text") -> DataFrame:
    """Per tag its count, its share of all comments and whether it recurs (two or more)."""
    # The total rides along as a tag of its own, so one pass over the comments is enough.
    tags = F.concat(pattern_tags(text), F.array(F.lit("*")))
    counts = comments.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    total = counts.where("tag = '*'").select(F.col("n").alias("total"))
    return counts.where("tag <> '*'").join(F.broadcast(total)).select(
        "tag", "n", (F.col("n") / F.col("total")).alias("weight"), (F.col("n") >= 2).alias("recurring")
    )


def comment_insights(comments: DataFrame, keys: list[str], text: str = "comment_text") -> DataFrame:
    """Which issue, review and technical words the comments of a key mention."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    groups = {"common_issues": K.ISSUE_WORDS, "review_patterns": K.REVIEW_WORDS, "technical_concerns": K.TECHNICAL_WORDS}
    flags = [F.bool_or(lower.contains(w)).alias(f"{g}:{w}") for g, words in groups.items() for w in words]
    seen = comments.groupBy(*keys).agg(*flags)
    return seen.select(*keys, *[
        F.array_compact(F.array(*[F.when(F.col(f"`{g}:{w}`"), F.lit(w)) for w in words])).alias(g) for g, words in groups.items()
    ])


def context_summary(comments: DataFrame, keys: list[str], as_of: Column, text: str = "comment_text") -> DataFrame:
    """Sentence summary per key: count, words mentioned, comments of the last 30 days before ``as_of``."""
    recent = F.count_if(timestamp("created_at") >= as_of - F.expr("INTERVAL 30 DAYS"))
    counts = comments.groupBy(*keys).agg(F.count("*").alias("n"), recent.alias("recent"))
    both = counts.join(comment_insights(comments, keys, text), keys)

    def part(words: str, lead: str) -> Column:
        return F.when(F.size(words) > 0, F.concat(F.lit(lead), F.array_join(words, ", "), F.lit(".")))

    summary = F.concat_ws(
        " ", F.format_string("Found %d relevant historical comments.", F.col("n")),
        part("common_issues", "Common issues mentioned: "), part("review_patterns", "Review suggestions often involve: "),
        part("technical_concerns", "Technical concerns raised: "),
        F.when(F.col("recent") > 0, F.format_string("%d comments from the last 30 days.", F.col("recent"))),
    )
    return both.select(*keys, "n", "recent", summary.alias("summary"))


def relevance_average(results: DataFrame, keys: list[str], queries: DataFrame) -> DataFrame:
    """Mean similarity of the comments returned per query; 0 for a query without any."""
    mean = results.groupBy(*keys).agg(F.avg("similarity").alias("mean"))
    return queries.select(*keys).distinct().join(mean, keys, "left").select(*keys, F.coalesce("mean", F.lit(0.0)).alias("average"))


def incremental_range(last: Column, since: Column, until: Column, force: Column | None = None) -> Column:
    """Struct(since, until, incremental): the earlier of the explicit start and a week before the last run."""
    full = last.isNull() if force is None else (last.isNull() | force)
    buffered = last - F.expr(f"INTERVAL {K.SYNC_BUFFER_DAYS} DAYS")
    return F.struct(
        F.when(full, since).otherwise(F.least(since, buffered)).alias("since"), until.alias("until"), (~full).alias("incremental")
    )


def ordered_page(df: DataFrame, offset: int, limit: int = 10_000, by: str = "id") -> DataFrame:
    return df.orderBy(by).offset(offset).limit(limit)


def validate_comments(comments: DataFrame, dim: int, project: Column, now: Column) -> DataFrame:
    """Rows fit to store, with the defaults of absent fields; the rest are dropped."""
    vector = F.col("comment_embedding")
    fit = (F.length("id") > 0) & (F.length("comment_text") > 0) & vector.isNotNull() & (F.size(vector) == dim)
    nullable = ("file_path", "original_code", "suggested_code", "diff_hunk", "updated_at", "pr_updated_at", "review_id", "review_state")
    numbers = ("line_number", "line_range_start", "line_range_end")
    defaults = {"repository": "", "comment_type": "issue", "author": "unknown", "issue_category": "general", "severity": "minor"}
    out = comments.where(fit).withColumn("project_path", project)
    for name, default in defaults.items():
        out = out.withColumn(name, or_default(name, default))
    for name in nullable:
        if name in out.columns:
            out = out.withColumn(name, F.nullif(F.col(name), F.lit("")))
    for name in numbers:
        if name in out.columns:
            out = out.withColumn(name, F.nullif(F.col(name), F.lit(0)))
    tags = F.coalesce("pattern_tags", F.array().cast("array<string>")) if "pattern_tags" in out.columns else F.array().cast("array<string>")
    combined = F.coalesce("combined_embedding", "comment_embedding") if "combined_embedding" in out.columns else vector
    return (
        out.withColumn("pr_number", F.coalesce("pr_number", F.lit(0))).withColumn("created_at", or_default("created_at", now))
        .withColumn("pattern_tags", F.to_json(tags)).withColumn("combined_embedding", combined)
    )
