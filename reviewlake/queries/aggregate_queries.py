"""Comment-history statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.operators import history as H
from reviewlake.queries.function_queries import CLASSIFIED, SQL_TAGS, classified, sql_category
from reviewlake.queries.inputs import COMMENTS, comments, quoted, with_ctes
from reviewlake.queries.registry import query

STATS = """cs AS (SELECT CASE WHEN coalesce(comment_type, '') = '' THEN 'unknown' ELSE comment_type END AS comment_type,
    category AS issue_category, CASE WHEN coalesce(severity, '') = '' THEN 'minor' ELSE severity END AS severity,
    CASE WHEN coalesce(author, '') = '' THEN 'unknown' ELSE author END AS author, repository FROM rated),
stats AS (SELECT 'comment_type' AS dimension, comment_type AS value, count(*) AS n FROM cs GROUP BY ALL
  UNION ALL SELECT 'issue_category', issue_category, count(*) FROM cs GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM cs GROUP BY ALL
  UNION ALL SELECT 'author', author, count(*) FROM cs GROUP BY ALL UNION ALL SELECT 'repository', repository, count(*) FROM cs GROUP BY ALL
  UNION ALL SELECT 'total', NULL, count(*) FROM cs)"""


def stored_comments(t):
    return classified(t).withColumnRenamed("category", "issue_category")


@query("d1_comment_stats", with_ctes(COMMENTS, CLASSIFIED, sql_category(), STATS) + "SELECT * FROM stats")
def d1(t):
    return H.comment_stats(stored_comments(t))


@query("d2_comment_totals", with_ctes(COMMENTS) + """
SELECT count(*) AS total_comments, count(DISTINCT nullif(pr_number, 0)) AS total_prs,
  count(DISTINCT CASE WHEN coalesce(author, '') = '' THEN 'unknown' ELSE author END) AS unique_authors,
  strftime(min(try_cast(created_at AS TIMESTAMP)), '%Y-%m-%d') AS earliest, strftime(max(try_cast(created_at AS TIMESTAMP)), '%Y-%m-%d') AS latest FROM comments""")
def d2(t):
    return H.comment_totals(comments(t.conversations))


@query("d4_last_analysis_ts", with_ctes(COMMENTS) + """
SELECT repository, project_path, max(created_at) AS last_created_at FROM comments GROUP BY ALL""")
def d4(t):
    return H.last_analysis(comments(t.conversations))


@query("d5_has_comments", with_ctes(COMMENTS) + """
SELECT count(*) > 0 AS has_comments FROM comments WHERE repository = 'org/repo1' AND project_path = '/work/p1'""")
def d5(t):
    return H.has_comments(comments(t.conversations), "org/repo1", "/work/p1")


@query("d7_history_patterns", with_ctes(COMMENTS, CLASSIFIED, sql_category(), STATS) + """
SELECT dimension AS type, value AS name, n AS count, printf('%.1f', round(n / (SELECT n FROM stats WHERE dimension = 'total') * 100, 1)) AS percentage
FROM stats WHERE dimension IN ('comment_type', 'issue_category', 'severity')""")
def d7(t):
    return H.history_patterns(H.comment_stats(stored_comments(t)))


@query("d8_top_authors", with_ctes(COMMENTS) + """
SELECT CASE WHEN coalesce(author, '') = '' THEN 'unknown' ELSE author END AS author, count(*) AS count FROM comments GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 10""")
def d8(t):
    return H.top_authors(comments(t.conversations))


@query("d9_total_prs", with_ctes(COMMENTS) + """
SELECT repository, count(DISTINCT nullif(pr_number, 0)) AS total_prs FROM comments GROUP BY ALL""")
def d9(t):
    return H.total_prs(comments(t.conversations))


@query("d10_pattern_weights", with_ctes(COMMENTS, f"tags AS (SELECT unnest({SQL_TAGS}) AS tag FROM comments)") + """
SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM comments), 6) AS weight, count(*) >= 2 AS recurring FROM tags GROUP BY ALL""")
def d10(t):
    return H.pattern_weights(comments(t.conversations)).withColumn("weight", F.round("weight", 6))


def _sql_words(words):
    return "array_to_string(list_filter(list_value(" + ", ".join(
        f"CASE WHEN bool_or(contains(lower(comment_text), {quoted(w)})) THEN {quoted(w)} END" for w in words) + "), lambda x: x IS NOT NULL), ', ')"


INSIGHTS = f"""ins AS (SELECT pr_number, {_sql_words(K.ISSUE_WORDS)} AS a, {_sql_words(K.REVIEW_WORDS)} AS b, {_sql_words(K.TECHNICAL_WORDS)} AS c,
  count(*) AS n, count(*) FILTER (WHERE try_cast(created_at AS TIMESTAMP) >= TIMESTAMP '2023-12-20' - INTERVAL 30 DAY) AS recent FROM comments GROUP BY ALL)"""


@query("d20_comment_insights", with_ctes(COMMENTS, INSIGHTS) + """
SELECT pr_number, a AS common_issues, b AS review_patterns, c AS technical_concerns FROM ins""")
def d20(t):
    seen = H.comment_insights(comments(t.conversations), ["pr_number"])
    return seen.select("pr_number", *[F.array_join(c, ", ").alias(c) for c in ("common_issues", "review_patterns", "technical_concerns")])


@query("d21_context_summary", with_ctes(COMMENTS, INSIGHTS) + """
SELECT pr_number, n, recent, 'Found ' || n || ' relevant historical comments.' || CASE WHEN a <> '' THEN ' Common issues mentioned: ' || a || '.' ELSE '' END
  || CASE WHEN b <> '' THEN ' Review suggestions often involve: ' || b || '.' ELSE '' END || CASE WHEN c <> '' THEN ' Technical concerns raised: ' || c || '.' ELSE '' END
  || CASE WHEN recent > 0 THEN ' ' || recent || ' comments from the last 30 days.' ELSE '' END AS summary FROM ins""")
def d21(t):
    return H.context_summary(comments(t.conversations), ["pr_number"], F.lit("2023-12-20").cast("timestamp"))


@query("d22_relevance_avg", """
SELECT p_partkey AS query_id, round(coalesce(avg(l_tax), 0), 10) AS average FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""")
def d22(t):
    results = t.lineitem.select(F.col("l_partkey").alias("query_id"), F.col("l_tax").alias("similarity"))
    out = H.relevance_average(results, ["query_id"], t.part.select(F.col("p_partkey").alias("query_id")))
    return out.withColumn("average", F.round("average", 10))


@query("g43_incremental_range", """
SELECT o_orderkey, strftime(CASE WHEN full_ THEN since ELSE least(since, last - INTERVAL 7 DAY) END, '%Y-%m-%d') AS since, NOT full_ AS incremental FROM (
  SELECT o_orderkey, o_orderdate AS last_, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS last,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE TIMESTAMP '1998-01-01' END AS since, o_orderkey % 5 = 0 OR o_orderstatus = 'P' AS full_ FROM orders)""")
def g43(t):
    k = F.col("o_orderkey")
    r = H.incremental_range(
        F.when(k % 5 != 0, F.col("o_orderdate")), F.when(k % 3 != 0, F.lit("1998-01-01").cast("timestamp")), F.lit(None).cast("timestamp"),
        F.col("o_orderstatus") == "P")
    return t.orders.select("o_orderkey", r.alias("r")).select("o_orderkey", F.date_format("r.since", "yyyy-MM-dd").alias("since"), "r.incremental")


@query("g44_validate_comment", with_ctes(COMMENTS) + f"""
SELECT id, pr_number, CASE WHEN coalesce(comment_type, '') = '' THEN 'issue' ELSE comment_type END AS comment_type,
  CASE WHEN coalesce(author, '') = '' THEN 'unknown' ELSE author END AS author, CASE WHEN severity = '' THEN 'minor' ELSE severity END AS severity,
  '[' || array_to_string(list_transform({SQL_TAGS}, lambda x: '"' || x || '"'), ',') || ']' AS pattern_tags, '/work/x' AS project_path
FROM comments WHERE turn % 4 <> 3""")
def g44(t):
    c = classified(t).withColumn("issue_category", F.col("category")).withColumnRenamed("tags", "pattern_tags")
    vec = F.when(F.col("turn") % 4 == 3, F.array(F.lit(1.0).cast("float"))).otherwise(F.array(*[F.lit(0.5).cast("float")] * 3))
    ok = H.validate_comments(c.withColumn("comment_embedding", vec), 3, F.lit("/work/x"), F.lit("2024-01-01T00:00:00Z"))
    return ok.select("id", "pr_number", "comment_type", "author", "severity", "pattern_tags", "project_path")


@query("e15_ordered_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def e15(t):
    return H.ordered_page(t.orders.select("o_orderkey", "o_custkey"), 1000, 500, "o_orderkey")
