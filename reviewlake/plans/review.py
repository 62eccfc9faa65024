"""Review planning for large pull requests, and assembling the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import classify as C
from reviewlake.functions import constants as K
from reviewlake.functions import diffs as D
from reviewlake.functions.paths import directory_of
from reviewlake.functions.predicates import keeps_severity
from reviewlake.functions.text import estimate_tokens, or_default
from reviewlake.operators import findings as N
from reviewlake.operators import planning as G
from reviewlake.session import materialize


def plan_contexts(files: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the context plan of each changed file: mode, reason, diff / full / context / total tokens.

    ``files``: keys, file_path, content, diff, language. Only files shown in part have windows rendered. A path may come several
    times: every row is planned by itself, and ``row_id`` tells them apart, in the order of path and text.
    """
    text = F.md5(F.concat_ws("\0", "diff", "content", "language"))
    row_id = F.concat_ws("\0", "file_path", text, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    # Stored, as the numbers of equal rows must stay the same between the passes.
    numbered = materialize(files.withColumn("row_id", row_id), "review-files")
    sized = numbered.withColumn("diff_tokens", estimate_tokens("diff")).withColumn("full_tokens", estimate_tokens("content"))
    # The knapsack works on the token counts alone; texts join back by row.
    plans = G.plan_file_context(sized.select(*keys, "row_id", "full_tokens", "diff_tokens"), keys, "row_id")
    rows = sized.join(plans.select("row_id", "mode", "reason"), "row_id")
    declared = F.array().cast("array<int>")
    focused = D.focused_context(
        F.col("content"), F.col("language"), declared, F.col("diff"), F.col("reason"), F.lit(K.CONTEXT_RADIUS), F.lit(None).cast("double"))
    whole = rows.where("mode = 'full'").withColumn("context_tokens", F.col("full_tokens"))
    part = rows.where("mode = 'focused'").withColumn("context_tokens", estimate_tokens(focused))
    out = whole.unionByName(part)
    return out.withColumn("total_tokens", F.col("diff_tokens") + F.col("context_tokens"))


def split_oversized(files: DataFrame, budget: int = K.CHUNK_TOKENS) -> DataFrame:
    """Fit every file into one chunk: cap its content or windows, or split its diff into parts.

    Adds part, n_parts, tokens and the text sent as ``context``.
    """
    over = F.col("total_tokens") > budget
    diff_fits = F.col("diff_tokens") <= budget
    focus = F.col("mode") == "focused"
    content_share = int(budget * K.FULL_CONTENT_RATIO)
    parts = F.when(over & ~diff_fits, D.split_diff("diff", F.lit(max(budget - content_share, 1)))).otherwise(F.array("diff"))
    rows = files.withColumn("n_parts", F.size(parts)).select(
        *[c for c in files.columns if c != "diff"], "n_parts", F.posexplode(parts).alias("part", "diff"))
    rows = rows.withColumn("part", F.col("part") + 1).withColumn("part_diff_tokens", estimate_tokens("diff"))
    room = F.greatest(F.lit(budget) - F.col("part_diff_tokens"), F.lit(0))
    declared = F.array().cast("array<int>")
    reason = F.when(room < F.col("context_tokens"), F.concat("reason", F.lit("; focused context reduced to fit chunk token budget"))).otherwise(
        F.col("reason"))
    window_budget = F.when(over, room.cast("double"))
    focused = D.focused_context(
        F.col("content"), F.col("language"), declared, F.col("diff"), F.when(over, reason).otherwise(F.col("reason")), F.lit(K.CONTEXT_RADIUS),
        window_budget)
    capped = F.when(~over, F.col("content")).when(diff_fits, C.cap_content(F.col("content"), room)).otherwise(
        C.cap_content(F.col("content"), F.lit(content_share)))
    shown = rows.where(focus).withColumn("context", focused).unionByName(rows.where(~focus).withColumn("context", capped))
    return shown.withColumn("tokens", F.col("part_diff_tokens") + estimate_tokens("context"))


def chunked_review_plan(files: DataFrame, keys: list[str], budget: int = K.CHUNK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(decision per pull request, planned rows with their chunk).

    Pull requests that need no chunking keep chunk 1 and their files as planned.
    """
    planned = materialize(plan_contexts(files, keys), "plans")
    decision = materialize(G.pr_token_estimate(planned.withColumnRenamed("context_tokens", "planned_tokens"), keys), "decisions")
    large = decision.where("should_chunk").select(*keys)
    split = split_oversized(planned.join(large, keys, "left_semi"), budget).withColumn("change_size", C.change_size("diff"))
    order = [directory_of("file_path"), F.col("change_size").desc(), F.col("row_id"), F.col("part")]
    # Packing needs the sizes alone; stored, so that no text is split or rendered twice.
    sizes = materialize(split.select(*keys, "file_path", "row_id", "mode", "part", "n_parts", "tokens", "change_size"), "split-files")
    packed = G.pack_files(sizes, keys, order, "tokens", budget)
    small = planned.join(large, keys, "left_anti").select(
        *keys, "file_path", "mode", F.lit(1).alias("part"), F.lit(1).alias("n_parts"), F.col("total_tokens").alias("tokens"), F.lit(1).cast("long").alias("chunk_id"))
    return decision, packed.select(*keys, "file_path", "mode", "part", "n_parts", "tokens", "chunk_id").unionByName(small)


def assemble_review(results: DataFrame, issues: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Merge chunk results: status per file, different issues per file, patterns across chunks."""
    kept = issues.where(keeps_severity("severity"))
    patterns = N.cross_chunk_patterns(kept, keys)
    return {
        "files": N.merge_chunk_status(results, [*keys, "file_path"]), "issues": N.merge_chunk_issues(kept, [*keys, "file_path"]),
        "patterns": patterns, "pattern_files": N.cross_chunk_files(kept, patterns, keys),
    }


def summary_defaults(summary):
    """Column: a project-summary struct with its missing text and list fields filled."""
    none = F.array().cast("array<string>")
    lists = ("mainFrameworks", "technologies", "architecturalPatterns", "reviewGuidelines")
    return F.struct(
        or_default(summary["projectName"], "Unknown Project").alias("projectName"),
        or_default(summary["projectType"], "Unknown").alias("projectType"),
        *[F.coalesce(summary[c], none).alias(c) for c in lists],
        F.struct(
            F.coalesce(summary["stateManagement"]["approach"], F.lit("Unknown")).alias("approach"),
            F.coalesce(summary["stateManagement"]["patterns"], none).alias("patterns"),
        ).alias("stateManagement"),
    )


SUMMARY_SCHEMA = (
    "projectName STRING, projectType STRING, mainFrameworks ARRAY<STRING>, technologies ARRAY<STRING>,"
    " architecturalPatterns ARRAY<STRING>, reviewGuidelines ARRAY<STRING>, stateManagement STRUCT<approach: STRING, patterns: ARRAY<STRING>>"
)


def fallback_summary(projects: DataFrame) -> DataFrame:
    """Summary rows without a model: name and up to ten technologies from the package manifest text.

    ``projects``: project_path, manifest (JSON text or null).
    """
    parsed = F.from_json("manifest", "name STRING, dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>")
    empty = F.create_map().cast("map<string,string>")
    names = F.array_distinct(F.concat(
        F.map_keys(F.coalesce(parsed["dependencies"], empty)), F.map_keys(F.coalesce(parsed["devDependencies"], empty))))
    summary = F.struct(
        F.coalesce(F.nullif(parsed["name"], F.lit("")), F.regexp_extract("project_path", "([^/]*)/*$", 1)).alias("projectName"),
        F.lit("Unknown").alias("projectType"), F.array().cast("array<string>").alias("mainFrameworks"), F.slice(names, 1, 10).alias("technologies"),
        F.array(*[F.lit(g) for g in K.SUMMARY_GUIDELINES]).alias("reviewGuidelines"), F.lit(True).alias("fallback"))
    return projects.select("project_path", summary.alias("summary"))
