"""Domain inputs derived from the driver's tables, as DataFrames and as the same SQL.

The driver's prose is invented, so paths, code marks and review phrases are attached to every row by
its id. Each list below is used by both forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRS = ("src/components", "src/utils", "tests/unit", "docs/guides", "lib/server", "node_modules/pkg", "config",
        "src/api/v1", "spec/models", "scripts", "a")
NAMES = ("Widget{n}.tsx", "helper{n}.js", "test_{n}.py", "guide-{n}.md", "main{n}.go", "README.md",
         "app{n}.config.js", "user{n}.spec.ts", "model{n}.java", "logo{n}.png", "types{n}.d.ts", ".eslintrc",
         "calc{n}_test.py")
SNIPPETS = ("import React from 'react'; const [a, setA] = useState(0)", "const app = express(); require('express')",
            "from django.db import models", "export default function run() {}", "class Service { query() }",
            "process.env.HOME", "@Component hook state props", "", "import flask", "public class Api @Service")
PHRASES = (
    "This has a SQL injection risk, sanitize the token.", "Slow query, consider a cache to improve performance.",
    "Typo in naming, formatting issue.", "Missing null check, the condition is always true.",
    "This will cause a crash, critical error handling bug.", "Looks good to me.",
    "Please add a unit test for coverage.", "Document the async callback promise.",
    "Serious memory leak and timeout.", "Minor whitespace only.", "describe('x', () => it('works'))",
)
AUTHORS = ("alice", "bob", "dependabot[bot]", "carol", "review-bot", "", "Renovate-Runner", "dave", "codecov-io",
           "erin", "bot-7", "frank", "Stale[Bot] ")
SEVERITIES = ("critical", "high", "medium", "low", "info", "LOW", "")
REPLIES = ("thanks", "this is a False Positive", "please ignore", "resolved in next commit", "not relevant here",
           "will fix", "agreed")
SENTIMENTS = ("negative", "positive", "neutral", "mixed", "positive")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_pick(values, index: str) -> str:
    return f"list_extract({sql_list(values)}, CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def sql_any(text: str, terms) -> str:
    """SQL: ``text`` contains any of the literal terms."""
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


WS_SQL = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS_SQL}]+|[{WS_SQL}]+$', '', 'g')"


# --- files: one per document ---------------------------------------------------------------------


def files(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    name = F.replace(pick(NAMES, d), F.lit("{n}"), d.cast("string"))
    return documents.select(
        d.alias("file_id"),
        F.concat(F.lit("/work/"), F.col("source")).alias("project_path"),
        F.concat(pick(DIRS, d), F.lit("/"), name).alias("path"),
        F.concat(pick(SNIPPETS, F.floor(d / 3)), F.lit("\n"), F.col("text")).alias("content"),
        F.substring(F.md5("text"), 1, 8).alias("content_hash"),
        F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"),
    )


FILES = f"""files AS (
  SELECT doc_id AS file_id, '/work/' || source AS project_path,
         {sql_pick(DIRS, 'doc_id')} || '/' || replace({sql_pick(NAMES, 'doc_id')}, '{{n}}', CAST(doc_id AS VARCHAR)) AS path,
         {sql_pick(SNIPPETS, 'doc_id // 3')} || chr(10) || text AS content,
         substr(md5(text), 1, 8) AS content_hash, text, lang, source, n_chars
  FROM documents)"""


# --- comments: one per conversation turn -----------------------------------------------------------


def comments(conversations: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    n = c * 5 + t
    stamp = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    created = F.lit(1_700_000_000) + c * 43_200 + t * 3_600
    return conversations.select(
        F.concat_ws("-", c.cast("string"), t.cast("string")).alias("id"),
        F.when(c % 17 == 0, 0).otherwise(c).alias("pr_number"),
        F.concat(F.lit("org/repo"), (c % 3).cast("string")).alias("repository"),
        F.concat(F.lit("/work/p"), (c % 2).cast("string")).alias("project_path"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, None).when(n % 4 == 2, "review").otherwise("inline").alias("comment_type"),
        F.concat(pick(PHRASES, n), F.lit("\n"), F.col("text")).alias("comment_text"),
        F.when(n % 11 == 0, None).otherwise(pick(AUTHORS, n)).alias("author"),
        F.when(n % 5 == 0, None).otherwise(
            F.concat(pick(DIRS, n), F.lit("/"), F.replace(pick(NAMES, n), F.lit("{n}"), c.cast("string")))
        ).alias("file_path"),
        F.when(n % 3 == 0, None).otherwise(n % 40 + 1).cast("int").alias("line"),
        F.when(n % 7 == 0, n % 13).cast("int").alias("position"),
        F.when(n % 13 == 0, "not a date").otherwise(stamp(created)).alias("created_at"),
        F.when(n % 3 == 1, stamp(created + 7_200)).alias("updated_at"),
        F.when(n % 19 != 0, stamp(created + 86_400)).alias("pr_updated_at"),
        pick(SEVERITIES, n).alias("severity"),
        F.col("role"), F.col("text"), c.alias("conv_id"), t.alias("turn"),
    )


def _sql_stamp(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')"


_CREATED = "1700000000 + conv_id * 43200 + turn * 3600"
COMMENTS = f"""comments AS (
  SELECT conv_id || '-' || turn AS id, CASE WHEN conv_id % 17 = 0 THEN 0 ELSE conv_id END AS pr_number,
         'org/repo' || (conv_id % 3) AS repository, '/work/p' || (conv_id % 2) AS project_path,
         CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'review' ELSE 'inline' END AS comment_type,
         {sql_pick(PHRASES, 'n')} || chr(10) || text AS comment_text,
         CASE WHEN n % 11 = 0 THEN NULL ELSE {sql_pick(AUTHORS, 'n')} END AS author,
         CASE WHEN n % 5 = 0 THEN NULL ELSE {sql_pick(DIRS, 'n')} || '/' ||
           replace({sql_pick(NAMES, 'n')}, '{{n}}', CAST(conv_id AS VARCHAR)) END AS file_path,
         CASE WHEN n % 3 = 0 THEN NULL ELSE n % 40 + 1 END AS line,
         CASE WHEN n % 7 = 0 THEN n % 13 END AS position,
         CASE WHEN n % 13 = 0 THEN 'not a date' ELSE {_sql_stamp(_CREATED)} END AS created_at,
         CASE WHEN n % 3 = 1 THEN {_sql_stamp(_CREATED + ' + 7200')} END AS updated_at,
         CASE WHEN n % 19 <> 0 THEN {_sql_stamp(_CREATED + ' + 86400')} END AS pr_updated_at,
         {sql_pick(SEVERITIES, 'n')} AS severity, role, text, conv_id, turn
  FROM (SELECT *, conv_id * 5 + turn AS n FROM conversations))"""


# --- pull requests: one per order -------------------------------------------------------------------


def pull_requests(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return orders.select(
        k.alias("number"), F.concat(F.lit("org/repo"), (k % 3).cast("string")).alias("repository"),
        F.when(k % 23 == 0, "Dependabot[bot]").otherwise(F.concat(F.lit("u"), F.col("o_custkey"))).alias("author"),
        (k % 10 == 3).alias("draft"),
        stamp(F.col("o_orderdate")).alias("created_at"),
        stamp(F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("updated_at"),
        F.when(F.col("o_orderstatus") != "O", stamp(F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS"))).alias("merged_at"),
    )


def _sql_iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


PULL_REQUESTS = f"""pull_requests AS (
  SELECT o_orderkey AS number, 'org/repo' || (o_orderkey % 3) AS repository,
         CASE WHEN o_orderkey % 23 = 0 THEN 'Dependabot[bot]' ELSE 'u' || o_custkey END AS author,
         o_orderkey % 10 = 3 AS draft, {_sql_iso('o_orderdate')} AS created_at,
         {_sql_iso('o_orderdate + INTERVAL 5 DAY')} AS updated_at,
         CASE WHEN o_orderstatus <> 'O' THEN {_sql_iso('o_orderdate + INTERVAL 3 DAY')} END AS merged_at
  FROM orders)"""


# --- findings: one per line item --------------------------------------------------------------------


def findings(lineitem: DataFrame) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    return lineitem.select(
        (F.col("l_orderkey") % 97).alias("pr"),
        F.concat(F.lit("src/f"), (F.col("l_orderkey") % 997).cast("string"), F.lit(".py")).alias("file_path"),
        F.col("l_linenumber").alias("chunk_id"),
        (F.col("l_linestatus") == "F").alias("success"),
        F.col("l_returnflag").alias("type"),
        pick(SEVERITIES, s).alias("severity"),
        F.concat(pick(PHRASES, p), F.lit(" near "), (p % 50).cast("string")).alias("description"),
        F.when(s % 3 == 0, "").otherwise(F.concat(F.lit("fix "), (s % 20).cast("string"))).alias("suggestion"),
        F.col("l_quantity").cast("int").alias("line_number"),
        (s % 4 == 0).alias("has_code_suggestion"),
        F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey"),
    )


FINDINGS = f"""findings AS (
  SELECT l_orderkey % 97 AS pr, 'src/f' || (l_orderkey % 997) || '.py' AS file_path, l_linenumber AS chunk_id,
         l_linestatus = 'F' AS success, l_returnflag AS type, {sql_pick(SEVERITIES, 'l_suppkey')} AS severity,
         {sql_pick(PHRASES, 'l_partkey')} || ' near ' || (l_partkey % 50) AS description,
         CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'fix ' || (l_suppkey % 20) END AS suggestion,
         CAST(l_quantity AS INTEGER) AS line_number, l_suppkey % 4 = 0 AS has_code_suggestion,
         l_orderkey, l_suppkey, l_partkey
  FROM lineitem)"""


# --- diffs: one per document, its lines marked as added, removed or kept ----------------------------


def diffs(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    mark = lambda i: F.when(i % 5 == 1, "+").when(i % 7 == 3, "-").otherwise(" ")
    body = F.array_join(
        F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(mark(i), line)), "\n"
    )
    mode = F.when(d % 9 == 0, "new file mode 100644\n").when(d % 9 == 1, "deleted file mode 100644\n").otherwise("")
    return documents.select(
        d.alias("file_id"), (d % 41).alias("pr"),
        F.concat(pick(DIRS, d), F.lit("/"), F.replace(pick(NAMES, d), F.lit("{n}"), d.cast("string"))).alias("path"),
        F.concat(
            F.lit("diff --git a/x b/x\n"), mode, F.lit("@@ -1,4 +"), (d % 30 + 1).cast("string"), F.lit(",6 @@ fn\n"), body,
        ).alias("diff"),
        F.col("text").alias("content"), F.col("lang").alias("language"),
    )


DIFFS = f"""diffs AS (
  SELECT doc_id AS file_id, doc_id % 41 AS pr,
         {sql_pick(DIRS, 'doc_id')} || '/' || replace({sql_pick(NAMES, 'doc_id')}, '{{n}}', CAST(doc_id AS VARCHAR)) AS path,
         'diff --git a/x b/x' || chr(10) ||
         CASE doc_id % 9 WHEN 0 THEN 'new file mode 100644' || chr(10) WHEN 1 THEN 'deleted file mode 100644' || chr(10)
              ELSE '' END || '@@ -1,4 +' || (doc_id % 30 + 1) || ',6 @@ fn' || chr(10) ||
         array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
           (CASE WHEN (i - 1) % 5 = 1 THEN '+' WHEN (i - 1) % 7 = 3 THEN '-' ELSE ' ' END) || x), chr(10)) AS diff,
         text AS content, lang AS language
  FROM documents)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
