"""Comment enrichment and the history synchronisation job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import classify as C
from reviewlake.functions import diffs as D
from reviewlake.functions import predicates as B
from reviewlake.functions.text import combined_text, is_blank, or_default
from reviewlake.operators import corpus as R
from reviewlake.operators import history as H
from reviewlake.operators.models import Embedder, HashedWords, embed
from reviewlake.session import materialize


def attach_patch_code(comments: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Where the hunk gave no original code, take the code of the file's patch at the comment's line.

    Only comments that need it take part, so the patches of other files are not shuffled to them. Of patches landed twice
    for a file the first counts, by ``landed_at`` if there is one, else the least text; a comment never gives two rows.
    """
    needs = is_blank("original_code") & F.coalesce(F.length("file_path") > 0, F.lit(False))
    rest = comments.where(~needs)
    wanted = comments.where(needs)
    landed = ["landed_at"] if "landed_at" in patches.columns else []
    files = patches.where(~is_blank("patch")).select(*keys, F.col("filename").alias("file_path"), "patch", *landed)
    first = F.min_by("patch", F.struct("landed_at", "patch")) if landed else F.min("patch")
    files = files.groupBy(*keys, "file_path").agg(first.alias("patch"))
    joined = wanted.join(files, [*keys, "file_path"], "left")
    coded = joined.withColumn("code", D.patch_code_at_line("patch", "line"))
    found = F.col("patch").isNotNull()
    for column, value in (("original_code", F.col("code.original")), ("suggested_code", F.col("code.suggested")), ("diff_hunk", F.col("patch"))):
        coded = coded.withColumn(column, F.when(found, value).otherwise(F.col(column)))
    return rest.unionByName(coded.select(*comments.columns))


def enrich_comments(
    raw: DataFrame, patches: DataFrame | None = None, embedder: Embedder | None = None, keys: list[str] = H.PR_KEYS
) -> DataFrame:
    """Raw comments to stored ones: bots dropped, code context, three vectors, classification.

    ``raw`` has id, body, author, path, position, line, diff_hunk, created_at, updated_at and the keys.
    """
    embedder = embedder or HashedWords()
    human = raw.where(~B.is_bot("author") & ~is_blank("body"))
    span, code = D.hunk_range("diff_hunk"), D.hunk_code("diff_hunk")
    base = human.select(
        *keys, *[c for c in ("pr_updated_at", "review_id", "review_state", "project_path") if c in raw.columns],
        F.col("id").cast("string").alias("id"),
        C.comment_type(F.col("path"), F.col("position"), F.col("line")).alias("comment_type"),
        F.col("body").alias("comment_text"), or_default("author", "unknown").alias("author"),
        "created_at", "updated_at", F.nullif(F.col("path"), F.lit("")).alias("file_path"), "line",
        or_default("line", F.nullif(F.col("position"), F.lit(0)), falsy=0).alias("line_number"),
        span["start"].alias("line_range_start"), span["end"].alias("line_range_end"),
        code["original"].alias("original_code"), code["suggested"].alias("suggested_code"), "diff_hunk",
    )
    if patches is not None:
        base = attach_patch_code(base, patches, keys)
    classed = (
        base.withColumn("issue_category", C.issue_category("comment_text", "original_code", "file_path"))
        .withColumn("severity", C.severity("comment_text", "issue_category"))
        .withColumn("pattern_tags", C.pattern_tags("comment_text"))
        .withColumn("__both", combined_text("comment_text", "original_code"))
    )
    out = embed(classed, "comment_text", "comment_embedding", embedder)
    out = embed(out, "original_code", "code_embedding", embedder)
    return embed(out, "__both", "combined_embedding", embedder).drop("__both", "line")


def sync_history(
    prs: DataFrame, review_comments: DataFrame, issue_comments: DataFrame, patches: DataFrame | None, stored: DataFrame,
    project: str, now: Column, since: Column | None = None, until: Column | None = None, embedder: Embedder | None = None,
) -> dict[str, DataFrame]:
    """One synchronisation run over landed data.

    Filters pull requests, skips those already processed, enriches the rest's comments and merges them
    into ``stored``, the newest version of each; comments that vanished from re-fetched pull requests are dropped. Only what ``project`` itself has stored
    makes a pull request count as processed, and the pattern statistics are the project's own.
    Returns the new table, the pull requests processed and the pattern statistics.
    """
    embedder = embedder or HashedWords()
    keys = H.PR_KEYS
    kept = prs.where(B.keep_pull_request(F.col("merged_at"), F.col("author"), F.col("draft"), since, until))
    todo = H.skip_processed(kept, H.pr_sync_state(stored.where(F.col("project_path") == project))).where(~F.col("skip"))
    todo = materialize(todo.select(*keys, F.col("updated_at").alias("pr_updated_at")), "pull-requests")
    raw = H.union_comments(review_comments, issue_comments).join(todo, keys)
    enriched = enrich_comments(raw, patches, embedder, keys)
    valid = materialize(H.validate_comments(enriched, embedder.dim, F.lit(project), now), "comments")
    columns = stored.columns
    updates = valid.select(*[c for c in columns if c in valid.columns])
    merged = R.upsert(stored, updates, ["id", "project_path"], [F.col("comment_text")], R.comment_version())
    declared = raw.select(*keys, F.col("id").cast("string").alias("id"))
    stale = H.stale_comments(
        merged.where(F.col("project_path") == project), todo, H.live_ids(declared, valid, keys)
    ).select("id", "project_path")
    table = merged.join(stale, ["id", "project_path"], "left_anti")
    return {"comments": table, "processed": todo, "patterns": H.history_patterns(H.comment_stats(table.where(F.col("project_path") == project)))}
