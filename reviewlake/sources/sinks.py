"""Report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.findings import render_report, review_summary


def review_details(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One JSON-ready row per file: its outcome, summary and number of issues."""
    counts = issues.groupBy("file_path").agg(F.count("*").alias("n_issues"))
    rows = files.join(counts, "file_path", "left")
    done = F.col("success") & ~F.col("skipped")
    return rows.select(
        "file_path", "success", F.when(F.col("success") & F.col("skipped"), True).alias("skipped"),
        F.when(done & F.col("partial"), True).alias("partial"),
        F.when(~F.col("success") | (done & F.col("partial")), F.col("error")).alias("error"),
        F.when(done, F.col("language")).alias("language"), F.when(done, F.col("summary")).alias("summary"),
        F.when(done, F.coalesce("n_issues", F.lit(0))).alias("n_issues"),
    )


def write_review_json(files: DataFrame, issues: DataFrame, path: str, pr_issues: DataFrame | None = None) -> None:
    """``summary``, ``details``, ``issues`` and ``pr_level_findings`` as JSON-lines folders below ``path``.

    Issues are rows of their own, keyed by file, so a file may have any number of them.
    """
    counted = issues if "has_code_suggestion" in issues.columns else issues.withColumn(
        "has_code_suggestion", F.col("code_suggestion").isNotNull() if "code_suggestion" in issues.columns else F.lit(False))
    totals = review_summary(files, counted, pr_issues)
    totals = totals.withColumn("total_issues", F.col("file_level_issues") + F.col("pr_level_issues"))
    totals.write.mode("overwrite").json(f"{path}/summary")
    review_details(files, issues).write.mode("overwrite").json(f"{path}/details")
    reviewed = files.where(F.col("success") & ~F.col("skipped")).select("file_path")
    issues.join(reviewed, "file_path", "left_semi").write.mode("overwrite").json(f"{path}/issues")
    if pr_issues is not None:
        pr_issues.write.mode("overwrite").json(f"{path}/pr_level_findings")


def write_review_text(files: DataFrame, issues: DataFrame, path: str, style: str = "markdown") -> None:
    """Report text in file order; range partitions keep the parts ordered among themselves."""
    rows = render_report(files, issues, style)
    rows.repartitionByRange("file_path", "seq").sortWithinPartitions("file_path", "seq").select("text").write.mode("overwrite").text(path)
