"""Sources and sinks: tables are landed as files in the shared folder, loaded again and compared with where they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.models import complete
from reviewlake.queries.findings_queries import FINDINGS, REVIEWED, reviewed
from reviewlake.queries.function_queries import SQL_DIFF_LINES, sql_ext, sql_language
from reviewlake.queries.inputs import DIFFS, diffs, findings, with_ctes
from reviewlake.queries.registry import query
from reviewlake.session import shared_dir
from reviewlake.sources import files as S
from reviewlake.sources import landed as L
from reviewlake.sources.corpus import Corpus
from reviewlake.sources.sinks import write_review_json


def _folder(t) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/landing-{uuid.uuid4().hex}"


def _landed(t, df: DataFrame) -> str:
    path = _folder(t)
    df.write.json(path)
    return path


def _tree(t) -> str:
    """One folder of text files per nation, a line for each customer."""
    path = _folder(t)
    t.customer.select("c_nationkey", "c_name").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


def _by_nation(df: DataFrame) -> DataFrame:
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)/", 1).cast("int")
    return df.groupBy(nation.alias("nation")).agg(F.sum("length").alias("length"))


@query("a1_scan_files", "SELECT CAST(c_nationkey AS INTEGER) AS nation, sum(strlen(c_name) + 1)::BIGINT AS length FROM customer GROUP BY ALL")
def a1(t):
    return _by_nation(S.scan_files(t.spark, _tree(t), include=("**/*.txt",), exclude=("**/*.log",)))


@query("a2_expand_patterns", """
SELECT CAST(c_nationkey AS INTEGER) AS nation, sum(strlen(c_name) + 1)::BIGINT AS length FROM customer
WHERE CAST(CAST(c_nationkey AS INTEGER) AS VARCHAR) LIKE '1%' OR CAST(CAST(c_nationkey AS INTEGER) AS VARCHAR) LIKE '2%' GROUP BY ALL""")
def a2(t):
    # A flat pattern, a deep one, one that matches the same files again and one that matches nothing.
    patterns = ["c_nationkey=1*/*.txt", "c_nationkey=2*/**/*.txt", "**/c_nationkey=2*/*.txt", "c_nationkey=10/*", "nothing/*.md"]
    return _by_nation(S.expand_patterns(t.spark, patterns, _tree(t).removeprefix("file:")))


@query("a3_load_exclusions", """
SELECT replace(trim(text, ' '), chr(10), ' ') AS pattern, count(*) AS n FROM benchmark WHERE item_id % 3 <> 0 GROUP BY ALL""")
def a3(t):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    n = F.col("item_id") % 3
    lines = t.benchmark.select(F.explode(F.array(
        F.when(n == 0, F.concat(F.lit(" # "), line)).when(n == 1, F.concat(F.lit("  "), line, F.lit(" "))).otherwise(line), F.lit("   "))).alias("value"))
    path = _folder(t)
    lines.write.text(path)
    return S.load_exclusions(t.spark, path).groupBy("pattern").agg(F.count("*").alias("n"))


@query("a4_corpus_tables", """
SELECT '/w/' || source AS project_path, count(*) AS n, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE lang IS NOT NULL) AS n_language
FROM documents GROUP BY ALL UNION ALL SELECT 'empty', 0, 0, 0""")
def a4(t):
    corpus = Corpus(t.spark, _folder(t))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("/w/"), "source").alias("project_path"), F.col("text").alias("content"), F.col("lang").alias("language"))
    corpus.write("file_embeddings", rows)
    held = corpus.table("file_embeddings").groupBy("project_path").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"), F.count("language").alias("n_language"))
    missing = corpus.table("pr_comments").agg(F.count("*").alias("n")).select(
        F.lit("empty").alias("project_path"), "n", F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("n_language"))
    return held.unionByName(missing)


@query("a6_load_pull_requests", """
SELECT DISTINCT conv_id AS pr_number, 'u' || conv_id % 7 AS author, conv_id % 2 = 0 AS draft, CASE WHEN conv_id % 5 <> 0 THEN '2024-01-01T00:00:00Z' END AS merged_at FROM conversations""")
def a6_prs(t):
    c = F.col("conv_id")
    rows = t.conversations.select(
        F.lit("r").alias("repository"), c.alias("number"), F.struct(F.concat(F.lit("u"), c % 7).alias("login")).alias("user"), (c % 2 == 0).alias("draft"),
        F.when(c % 5 != 0, "2024-01-01T00:00:00Z").alias("merged_at")).distinct()
    return L.load_pull_requests(t.spark, _landed(t, rows)).select("pr_number", "author", "draft", "merged_at")


@query("a6_load_comments", """
SELECT conv_id * 1000 + turn AS id, conv_id AS pr_number, role AS author, CAST(turn AS VARCHAR) AS review_id, md5(text) AS body FROM conversations""")
def a6_comments(t):
    rows = t.conversations.select(
        F.col("conv_id").alias("pr_number"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"),
        F.struct(F.col("role").alias("login")).alias("user"), F.col("turn").alias("pull_request_review_id"))
    return L.load_comments(t.spark, _landed(t, rows)).select("id", "pr_number", "author", "review_id", F.md5("body").alias("body"))


@query("a6_load_pr_files", "SELECT page_id AS pr_number, url AS filename, md5(html) AS patch FROM pages")
def a6_files(t):
    rows = t.pages.select(F.col("page_id").alias("pr_number"), F.col("url").alias("filename"), F.col("html").alias("patch"))
    return L.load_pr_files(t.spark, _landed(t, rows)).select("pr_number", "filename", F.md5("patch").alias("patch"))


@query("a7_load_feedback", """
SELECT 'i' || item_id AS issue_key, text AS original_issue, CASE WHEN item_id % 2 = 0 THEN 'negative' END AS sentiment, CAST(item_id % 3 AS INTEGER) AS n_replies FROM benchmark""")
def a7(t):
    n = F.col("item_id")
    replies = F.slice(F.array(*(F.struct(F.lit(b).alias("body")) for b in ("a", "b"))), F.lit(1), (n % 3).cast("int"))
    entry = F.struct(F.concat(F.lit("i"), n).alias("key"), F.struct(
        F.col("text").alias("originalIssue"), F.when(n % 2 == 0, "negative").alias("overallSentiment"), replies.alias("userReplies")).alias("value"))
    # One document per file, named as the loader expects; a file of another name beside them must be left alone.
    files = t.benchmark.groupBy((n % 4).alias("g")).agg(F.map_from_entries(F.collect_list(entry)).alias("feedback")).select("feedback")
    path = _folder(t)
    files.write.option("maxRecordsPerFile", 1).json(path)
    hadoop = t.spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    for i, status in enumerate(x for x in fs.listStatus(hadoop.Path(path)) if x.getPath().getName().startswith("part-")):
        fs.rename(status.getPath(), hadoop.Path(f"{path}/feedback-{i}.json"))
    files.limit(1).write.mode("append").json(path)
    return L.load_feedback(t.spark, path).select("issue_key", "original_issue", "sentiment", F.size("replies").alias("n_replies"))


@query("a9_load_diffs", with_ctes(DIFFS, SQL_DIFF_LINES, """
n AS (SELECT file_id, count(*) FILTER (WHERE mark = '+') AS n_added, count(*) FILTER (WHERE mark = '-') AS n_removed FROM body GROUP BY ALL)""") + f"""
SELECT path AS file_path, {sql_language(sql_ext('path'))} AS language, coalesce(n_added, 0)::INTEGER AS n_added, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM diffs LEFT JOIN n USING (file_id)""")
def a9(t):
    rows = diffs(t.documents).select(F.lit("1").alias("pr"), F.col("path").alias("file_path"), "diff", "content")
    return L.load_diffs(t.spark, _landed(t, rows)).select(
        "file_path", "language", F.size("diff_info.added").alias("n_added"), F.size("diff_info.removed").alias("n_removed"))


@query("a10_write_review_json", with_ctes(FINDINGS, REVIEWED, "n AS (SELECT file_path, count(*) AS n FROM findings GROUP BY ALL)") + """
SELECT file_path, success, CASE WHEN success AND NOT skipped THEN coalesce(n, 0) END AS n_issues, CASE WHEN success AND NOT skipped THEN coalesce(n, 0) ELSE 0 END AS n_written
FROM reviewed LEFT JOIN n USING (file_path)""")
def a10(t):
    outcome = reviewed(t).select(
        "file_path", "success", "skipped", F.lit(False).alias("partial"), F.lit(None).cast("string").alias("error"), F.lit("x").alias("language"), F.lit("s").alias("summary"))
    path = _folder(t)
    write_review_json(outcome, findings(t.lineitem).select("file_path", "type", "severity", "description", "has_code_suggestion"), path)
    details = t.spark.read.schema("file_path string, success boolean, n_issues long").json(f"{path}/details")
    issues = t.spark.read.schema("file_path string").json(f"{path}/issues").groupBy("file_path").agg(F.count("*").alias("n_written"))
    return details.join(issues, "file_path", "left").withColumn("n_written", F.coalesce("n_written", F.lit(0)))


@query("h19_complete", "SELECT item_id, length(text)::BIGINT AS n_chars, CASE WHEN item_id % 5 = 0 THEN 'refused' END AS error FROM benchmark")
def h19(t):
    def client():
        def answer(requests):
            out = requests[["item_id"]].copy()
            out["n_chars"] = requests["text"].str.len().astype("int64")
            out["error"] = [("refused" if i % 5 == 0 else None) for i in requests["item_id"]]
            return out

        return answer

    return complete(t.benchmark.select("item_id", "text"), client, "item_id long, n_chars long, error string")
