"""Landed dumps: review history, feedback, custom documents, diffs."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.diffs import parse_diff
from reviewlake.functions.markdown import paragraph_chunks
from reviewlake.functions.paths import basename, extension, language_from_extension
from reviewlake.functions.predicates import detect_file_type, is_component
from reviewlake.functions.text import clean_document, document_title, slugify
from reviewlake.operators.models import Embedder, HashedWords, embed
from reviewlake.operators.topk import best_per_key

PULL_REQUESTS = (
    "repository STRING, number LONG, title STRING, state STRING, merged_at STRING, created_at STRING, updated_at STRING,"
    " user STRUCT<login: STRING>, draft BOOLEAN"
)
COMMENTS = (
    "repository STRING, pr_number LONG, id LONG, body STRING, user STRUCT<login: STRING>, path STRING, position INT, line INT,"
    " diff_hunk STRING, pull_request_review_id LONG, review_state STRING, created_at STRING, updated_at STRING"
)
PR_FILES = "repository STRING, pr_number LONG, filename STRING, patch STRING"
FEEDBACK = (
    "feedback MAP<STRING, STRUCT<originalIssue: STRING, overallSentiment: STRING, userReplies: ARRAY<STRUCT<body: STRING>>>>"
)
DIFFS = "pr STRING, file_path STRING, base_branch STRING, target_branch STRING, diff STRING, content STRING"


def load_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(PULL_REQUESTS).json(path)
    return raw.withColumnRenamed("number", "pr_number").withColumn("author", F.col("user.login")).drop("user")


def load_comments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(COMMENTS).json(path)
    return raw.withColumn("author", F.col("user.login")).withColumn("review_id", F.col("pull_request_review_id").cast("string")).drop(
        "user", "pull_request_review_id")


def load_pr_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PR_FILES).json(path)


def load_feedback(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of all ``feedback-*.json`` files; for a key in several files the last file by name wins.

    Files that are no JSON read as null and drop out.
    """
    raw = (
        spark.read.schema(FEEDBACK).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "feedback-*.json").json(directory)
        .select(basename(F.input_file_name()).alias("file"), "feedback")
    )
    rows = raw.where("feedback IS NOT NULL").select("file", F.explode("feedback").alias("issue_key", "f")).select(
        "file", "issue_key", F.col("f.originalIssue").alias("original_issue"), F.col("f.overallSentiment").alias("sentiment"),
        F.transform("f.userReplies", lambda r: r["body"]).alias("replies"))
    return best_per_key(rows, ["issue_key"], [F.col("file").desc()]).drop("file")


def load_custom_docs(spark: SparkSession, specs: list[str]) -> DataFrame:
    """Instruction documents given as ``title:path``; the text is cleaned of broken lines."""
    split = [spec.partition(":") for spec in specs]
    if any(not sep for _, sep, _ in split):
        raise ValueError('expected "title:path/to/file"')
    titles = {posixpath.abspath(path.strip()): title.strip() for title, _, path in split}
    table = spark.createDataFrame(list(titles.items()), "at string, title string")
    text = spark.read.text(list(titles), wholetext=True).select(
        F.regexp_replace(F.url_decode(F.input_file_name()), "^file:/+", "/").alias("at"), clean_document("value").alias("content"))
    return text.join(F.broadcast(table), "at").select("title", "content", F.concat_ws(":", "title", "at").alias("spec"))


def custom_chunks(docs: DataFrame, project: str, embedder: Embedder | None = None) -> DataFrame:
    """Paragraph chunks of custom documents, embedded, in the form the search expects."""
    titled = docs.withColumn("document_title", document_title("title", "content"))
    chunks = titled.select("document_title", F.col("title").alias("original_title"), F.explode(paragraph_chunks("content")).alias("c"))
    rows = chunks.select(
        F.concat(slugify("document_title"), F.lit("_chunk_"), F.col("c.chunk_index").cast("string")).alias("id"),
        F.col("c.content").alias("content"), "document_title", F.col("c.chunk_index").alias("chunk_index"),
        F.struct(
            F.col("c.section_start").alias("section_start"), F.col("c.total_chunks").alias("total_chunks"), "original_title",
            F.col("c.chunk_hash").alias("chunk_hash"),
        ).alias("metadata"),
        F.lit("custom-document-chunk").alias("type"), F.lit(project).alias("project_path"),
    )
    return embed(rows, "content", "embedding", embedder or HashedWords()).where("embedding IS NOT NULL")


def load_diffs(spark: SparkSession, path: str) -> DataFrame:
    """One row per changed file, with its language, kind and parsed diff."""
    raw = spark.read.schema(DIFFS).json(path)
    kind = detect_file_type("file_path", "content")
    summary = F.concat(
        F.col("language"), F.lit(" "), F.when(F.col("is_test"), "test").otherwise("source"), F.lit(" file: "), basename("file_path"))
    return (
        raw.withColumn("language", language_from_extension(extension("file_path"))).withColumn("file_type", kind)
        .withColumn("is_test", F.col("file_type.is_test")).withColumn("is_component", is_component("content"))
        .withColumn("diff_info", parse_diff("diff")).withColumn("summary", summary)
    )
