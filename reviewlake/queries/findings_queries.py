"""Findings: merging, patterns, feedback filter, reports; token planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewlake.functions import classify as C
from reviewlake.functions import constants as K
from reviewlake.functions.text import estimate_tokens
from reviewlake.operators import findings as N
from reviewlake.operators import planning as G
from reviewlake.operators.models import HashedWords
from reviewlake.operators.similarity import best_word_matches, filter_dismissed
from reviewlake.queries.function_queries import JACCARD_WORDS
from reviewlake.queries.inputs import (
    DIFFS, FILES, FINDINGS, REPLIES, SENTIMENTS, diffs, files, findings, pick, quoted, sql_pick, with_ctes,
)
from reviewlake.queries.predicate_queries import sql_is_test
from reviewlake.queries.registry import query
from reviewlake.queries.search_queries import DIM, sql_embedding, sql_knn_components


def _lines(t, table: str, key: str):
    return getattr(t, table).select(F.col(key).alias("k"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select(
        F.concat_ws("-", "k", "p").alias("id"), "text")


WORD_PAIRS = f"""li AS (SELECT doc_id || '-' || (i - 1) AS id, {JACCARD_WORDS.format(c='line')} AS w FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
di AS (SELECT item_id || '-' || (i - 1) AS id, {JACCARD_WORDS.format(c='line')} AS w FROM benchmark, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
pairs AS (SELECT l.id, d.id AS match_id, len(list_intersect(l.w, d.w)) / len(list_distinct(list_concat(l.w, d.w))) AS s
  FROM li l, di d WHERE len(l.w) > 0 AND len(d.w) > 0)"""


@query("e16_best_feedback_match", with_ctes(WORD_PAIRS) + """
SELECT id, match_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) AS k FROM pairs WHERE s > 0.3) WHERE k = 1""")
def e16(t):
    found = best_word_matches(_lines(t, "documents", "doc_id"), _lines(t, "benchmark", "item_id"), 0.3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("c9_similarity_anti_join", with_ctes(WORD_PAIRS) + "SELECT id FROM li WHERE id NOT IN (SELECT id FROM pairs WHERE s > 0.7)")
def c9(t):
    kept, _ = filter_dismissed(_lines(t, "documents", "doc_id"), _lines(t, "benchmark", "item_id"), 0.7)
    return kept.select("id")


@query("h17_filter_dismissed", with_ctes(
    sql_embedding("a", "conversations", "cid", "text").replace("SELECT cid, unnest", "SELECT conv_id || '-' || turn AS cid, unnest"),
    sql_embedding("b", "benchmark", "item_id", "text"), sql_knn_components("v", "a", "cid", "b", "item_id", 1)) + """
SELECT conv_id || '-' || turn AS id FROM conversations
WHERE conv_id || '-' || turn NOT IN (SELECT query_id FROM v WHERE 1 - distance / 4 > 0.7)""")
def h17(t):
    issues = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    kept, _ = filter_dismissed(issues, t.benchmark.select(F.col("item_id").alias("id"), "text"), 0.7, HashedWords(DIM))
    return kept.select("id")


@query("d16_cross_chunk_issues", with_ctes(FINDINGS) + """
SELECT pr, type || '-' || substr(description, 1, 50) AS pattern, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT file_path) AS n_files,
  count(*) AS n_issues, 'Similar issue pattern detected across ' || count(DISTINCT chunk_id) || ' chunks: ' || min(description) AS message
FROM findings GROUP BY 1, 2 HAVING n_chunks > 1 AND n_files > 1""")
def d16(t):
    return N.cross_chunk_patterns(findings(t.lineitem), ["pr"]).select("pr", "pattern", "n_chunks", "n_files", "n_issues", "message")


@query("d16_cross_chunk_files", with_ctes(FINDINGS, """p AS (SELECT *, type || '-' || substr(description, 1, 50) AS pattern FROM findings),
g AS (SELECT pr, pattern FROM p GROUP BY ALL HAVING count(DISTINCT chunk_id) > 1 AND count(DISTINCT file_path) > 1)""") + """
SELECT pr, pattern, file_path, count(*) AS n_issues FROM p JOIN g USING (pr, pattern) GROUP BY ALL""")
def d16_files(t):
    f = findings(t.lineitem)
    return N.cross_chunk_files(f, N.cross_chunk_patterns(f, ["pr"]), ["pr"])


@query("d17_merge_chunk_results", with_ctes(FINDINGS) + """
SELECT file_path, bool_or(success) AS success, bool_or(success) AND bool_or(NOT success) AS partial,
  arg_min('failed ' || chunk_id, chunk_id) FILTER (WHERE NOT success) AS error, count(DISTINCT chunk_id) AS n_chunks,
  array_to_string(list_sort(list_distinct(list(chunk_id))), ',') AS chunks FROM findings GROUP BY ALL""")
def d17(t):
    f = findings(t.lineitem).withColumn("error", F.when(~F.col("success"), F.concat(F.lit("failed "), "chunk_id")))
    merged = N.merge_chunk_status(f, ["file_path"])
    return merged.withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@query("d17_merge_chunk_issues", with_ctes(FINDINGS) + """
SELECT file_path, type, severity, description, suggestion, min(chunk_id) AS chunk_id FROM findings GROUP BY file_path, type, severity, description, suggestion""")
def d17_issues(t):
    f = findings(t.lineitem).select("file_path", "type", "severity", "description", "suggestion", "chunk_id")
    return N.merge_chunk_issues(f, ["file_path"])


@query("g45_issue_key", with_ctes(FINDINGS) + """
SELECT md5('{"type":"' || type || '","severity":"' || severity || '","description":"' || description || '","suggestion":"' || suggestion || '"}') AS issue_key, count(*) AS n
FROM findings GROUP BY ALL""")
def g45(t):
    f = findings(t.lineitem)
    return f.groupBy(F.md5(N.issue_key(f)).alias("issue_key")).agg(F.count("*").alias("n"))


REVIEWED = """reviewed AS (SELECT file_path, bool_or(success) AS success, bool_and(l_suppkey % 2 = 0) AS skipped FROM findings GROUP BY ALL)"""


def reviewed(t):
    return findings(t.lineitem).groupBy("file_path").agg(
        F.bool_or("success").alias("success"), F.bool_and(F.col("l_suppkey") % 2 == 0).alias("skipped"))


@query("d18_review_summary", with_ctes(FINDINGS, REVIEWED, """i AS (SELECT * FROM findings),
n AS (SELECT file_path, count(*) AS n, count(*) FILTER (WHERE has_code_suggestion) AS nc FROM i GROUP BY ALL)""") + """
SELECT count(*) AS total_files, count(*) FILTER (WHERE success AND NOT skipped AND n > 0) AS files_with_issues, sum(n)::BIGINT AS file_level_issues,
  sum(nc) FILTER (WHERE success AND NOT skipped)::BIGINT AS issues_with_code, count(*) FILTER (WHERE skipped) AS skipped_files,
  count(*) FILTER (WHERE NOT success) AS error_files, (SELECT count(*) FROM findings) AS pr_level_issues
FROM reviewed LEFT JOIN n USING (file_path)""")
def d18(t):
    f = findings(t.lineitem)
    return N.review_summary(reviewed(t), f, f)


@query("d19_pr_level_findings", with_ctes(FINDINGS) + """
SELECT pr, CASE WHEN type = 'N' THEN 'cross-file' ELSE type END AS type, 'cross-file' AS source, CASE WHEN severity = '' THEN 'info' ELSE severity END AS severity,
  CASE WHEN l_partkey % 4 = 0 THEN 'm' || l_suppkey % 5 ELSE description END AS description,
  CASE WHEN suggestion = '' THEN 'rec' ELSE suggestion END AS suggestion,
  array_to_string(list_sort(CASE l_partkey % 3 WHEN 0 THEN [file_path, 'src/f' || (l_suppkey % 3) || '.py'] WHEN 1 THEN ['src/a.py'] ELSE ['src/p.py'] END), ',') AS files,
  min(line_number)::INTEGER AS line_number
FROM findings WHERE NOT (l_partkey % 4 = 0 AND l_suppkey % 5 = 0) GROUP BY ALL""")
def d19(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    raw = findings(t.lineitem).select(
        "pr", F.when(F.col("type") == "N", "").otherwise(F.col("type")).alias("type"), "severity",
        F.when(p % 4 == 0, "").otherwise(F.col("description")).alias("description"),
        F.when(s % 5 != 0, F.concat(F.lit("m"), s % 5)).alias("message"), "suggestion", F.lit("rec").alias("recommendation"),
        F.when(p % 3 == 0, F.array("file_path", F.lit(""), F.concat(F.lit("src/f"), s % 3, F.lit(".py")))).alias("files"),
        F.when(p % 3 == 1, F.array(F.lit("src/a.py"))).alias("affected_files"), F.array(F.lit("src/p.py")).alias("file_paths"),
        F.array(F.col("line_number").cast("int")).alias("line_numbers"))
    found = N.pr_level_issues(raw, ["pr"]).withColumn("files", F.array_join("files", ","))
    return found.withColumn("line_number", F.col("line_numbers")[0]).drop("line_numbers")


@query("g47_normalise_recommendation", with_ctes(FINDINGS) + """
SELECT DISTINCT pr, description || CASE WHEN suggestion = '' THEN '' ELSE ' ' || suggestion END || ' Affected files: ' || file_path AS recommendation FROM findings
UNION SELECT DISTINCT pr, CASE WHEN l_partkey % 3 = 0 THEN description WHEN l_partkey % 3 = 1 THEN type || CASE WHEN suggestion = '' THEN '' ELSE ': ' || suggestion END || ': ' || severity2
  ELSE '{"category":"","suggestion":"","impact":""}' END AS recommendation FROM (SELECT *, CASE WHEN severity = '' THEN 'x' ELSE severity END AS severity2 FROM findings)""")
def g47(t):
    kind = F.col("l_partkey") % 3
    part = lambda c: F.when(kind == 1, c).otherwise(F.lit(""))
    text = N.recommendation_text(
        F.when(kind == 0, F.col("description")), part(F.col("type")), part(F.col("suggestion")),
        part(F.when(F.col("severity") == "", "x").otherwise(F.col("severity"))))
    patterns = findings(t.lineitem).select("pr", "description", "suggestion", F.array("file_path", F.lit("")).alias("files"))
    return N.pr_recommendations(findings(t.lineitem).select("pr", text.alias("recommendation")), ["pr"], patterns)


@query("c12_issues_to_files", """
WITH f AS (SELECT page_id % 7 AS pr, '/w/' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS file_path, page_id FROM pages),
k AS (SELECT page_id % 7 AS pr, CASE page_id % 3 WHEN 0 THEN file_path WHEN 1 THEN substr(file_path, 4) ELSE regexp_extract(file_path, '([^/]*)$', 1) END AS file_key FROM f),
o AS (SELECT DISTINCT pr, file_path, substr(file_path, 4) AS r, regexp_extract(file_path, '([^/]*)$', 1) AS b FROM f)
SELECT pr, file_path, CASE WHEN (pr, r) IN (SELECT (pr, file_key) FROM k) THEN r WHEN (pr, b) IN (SELECT (pr, file_key) FROM k) THEN b ELSE file_path END AS file_key
FROM o WHERE (pr, r) IN (SELECT (pr, file_key) FROM k) OR (pr, b) IN (SELECT (pr, file_key) FROM k) OR (pr, file_path) IN (SELECT (pr, file_key) FROM k)""")
def c12(t):
    path = F.concat(F.lit("/w/"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""))
    f = t.pages.select((F.col("page_id") % 7).alias("pr"), path.alias("file_path"), "page_id")
    n = F.col("page_id") % 3
    key = F.when(n == 0, F.col("file_path")).when(n == 1, F.substring("file_path", 4, 1 << 30)).otherwise(F.regexp_extract("file_path", "([^/]*)$", 1))
    return N.issues_to_files(f, f.select("pr", key.alias("file_key")), ["pr"], "/w")


@query("d25_pr_overview", with_ctes(FILES) + f"""
SELECT file_id % 41 AS pr, count(*) AS total_files, count(*) FILTER (WHERE {sql_is_test('path')}) AS test_files,
  count(*) FILTER (WHERE NOT {sql_is_test('path')}) AS source_files FROM files GROUP BY 1""")
def d25(t):
    from reviewlake.functions.predicates import is_test_file

    return N.pr_overview(files(t.documents).select((F.col("file_id") % 41).alias("pr"), is_test_file("path").alias("is_test")), ["pr"])


FEEDBACK = f"""feedback AS (SELECT item_id AS issue_key, CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS original_issue, {sql_pick(SENTIMENTS, 'item_id')} AS sentiment,
  CASE WHEN item_id % 6 = 0 THEN [] ELSE [{sql_pick(REPLIES, 'item_id')} || ' ' || text, {sql_pick(REPLIES, 'item_id // 7 + 1')}] END AS replies FROM benchmark),
dismissed AS (SELECT issue_key, CASE WHEN original_issue = '' THEN 'Unknown issue' ELSE original_issue END AS issue,
  CASE WHEN len(replies) = 0 THEN 'Negative feedback' ELSE substr(replies[1], 1, 100) END AS reason, sentiment FROM feedback
  WHERE sentiment = 'negative' OR len(list_filter(replies, lambda r: regexp_matches(lower(r), 'false positive|not relevant|ignore'))) > 0
  ORDER BY issue_key LIMIT 10)"""


def feedback(t):
    n = F.col("item_id")
    replies = F.when(n % 6 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat_ws(" ", pick(REPLIES, n), "text"), pick(REPLIES, F.floor(n / 7) + 1)))
    return t.benchmark.select(
        n.alias("issue_key"), F.when(n % 5 == 0, "").otherwise(F.col("text")).alias("original_issue"), pick(SENTIMENTS, n).alias("sentiment"),
        replies.alias("replies"))


@query("d26_dismissed_patterns", with_ctes(FEEDBACK) + "SELECT * FROM dismissed")
def d26(t):
    return N.dismissed_patterns(feedback(t))


@query("g50_feedback_context", with_ctes(FEEDBACK, "r AS (SELECT *, row_number() OVER (ORDER BY issue_key) AS i FROM dismissed)") + """
SELECT md5(chr(10) || 'IMPORTANT: The following types of issues have been previously dismissed or marked as not relevant by users in this project:' || chr(10) || chr(10)
  || string_agg(i || '. "' || issue || '" (Reason: ' || reason || ')', chr(10) ORDER BY i) || chr(10) || chr(10)
  || 'Please avoid suggesting similar issues unless they represent genuinely different problems. Focus on identifying new, actionable, and relevant issues that haven''t been previously dismissed.') AS context FROM r""")
def g50(t):
    return N.feedback_context(N.dismissed_patterns(feedback(t))).select(F.md5("context").alias("context"))


@query("g50_format_context", with_ctes(FILES, "r AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY n_chars DESC, file_id) AS rank FROM files)") + """
SELECT project_path, rank AS index, path, printf('%.2f', round(n_chars / 7919 % 1, 2)) AS similarity, lang AS language, md5(content) AS content FROM r""")
def g50_items(t):
    order = Window.partitionBy("project_path").orderBy(F.col("n_chars").desc(), "file_id")
    items = files(t.documents).withColumn("rank", F.row_number().over(order))
    items = items.withColumn("similarity", F.col("n_chars") / 7919 % 1).withColumn("language", F.col("lang"))
    return N.format_context_items(items, ["project_path"]).withColumn("content", F.md5("content"))


_EMOJI = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in K.SEVERITY_EMOJI.items())


@query("a11_render_markdown", with_ctes(FINDINGS, REVIEWED, """i AS (SELECT DISTINCT file_path, type, severity, description, suggestion, line_number FROM findings),
n AS (SELECT file_path, count(*) AS n FROM i GROUP BY ALL),
heads AS (SELECT '### ' || file_path || chr(10) || chr(10) || CASE WHEN NOT success THEN '**Error:** boom' || chr(10) WHEN skipped THEN '*Skipped (based on exclusion patterns or file type).*' || chr(10)
  WHEN coalesce(n, 0) = 0 THEN '*No actionable issues reported.*' || chr(10) || chr(10) || '**Summary:** all ' || file_path || chr(10)
  ELSE '**Summary:** all ' || file_path || chr(10) || chr(10) || '**Issues Found (' || n || '):**' || chr(10) END AS text FROM reviewed LEFT JOIN n USING (file_path))""") + f"""
SELECT text, count(*) AS n FROM (SELECT text FROM heads UNION ALL
SELECT '- **[' || upper(severity) || '] ' || CASE lower(severity) {_EMOJI} ELSE {quoted(K.OTHER_EMOJI)} END || ' (Lines: ' || line_number || ')**: ' || description
  || CASE WHEN suggestion <> '' THEN chr(10) || chr(10) || '  *Suggestion:* ' || suggestion || chr(10) ELSE '' END
FROM i JOIN reviewed USING (file_path) WHERE success AND NOT skipped) GROUP BY ALL""")
def a11(t):
    f = reviewed(t).withColumn("partial", F.lit(False)).withColumn("error", F.when(~F.col("success"), "boom")).withColumn(
        "summary", F.concat(F.lit("all "), "file_path"))
    issues = findings(t.lineitem).select(
        "file_path", "type", "severity", "description", "suggestion", F.array("line_number").alias("line_numbers")).distinct()
    return N.render_report(f, issues).groupBy("text").agg(F.count("*").alias("n"))


@query("a11_render_summary", with_ctes(FINDINGS, REVIEWED, """i AS (SELECT * FROM findings),
n AS (SELECT file_path, count(*) AS n FROM i GROUP BY ALL),
t AS (SELECT count(*) AS a, count(*) FILTER (WHERE success AND NOT skipped AND n > 0) AS b, sum(n)::BIGINT AS c, count(*) FILTER (WHERE skipped) AS d,
  count(*) FILTER (WHERE NOT success) AS e FROM reviewed LEFT JOIN n USING (file_path))""") + """
SELECT '## Summary' || chr(10) || chr(10) || '- **Files Analyzed:** ' || a || chr(10) || '- **Files with Issues:** ' || b || chr(10) || '- **Total Issues Found:** ' || c
  || CASE WHEN d > 0 THEN chr(10) || '- **Files Skipped:** ' || d ELSE '' END || CASE WHEN e > 0 THEN chr(10) || '- **Errors:** ' || e ELSE '' END AS text FROM t""")
def a11_summary(t):
    return N.render_summary(N.review_summary(reviewed(t), findings(t.lineitem)))


@query("a11_render_pr_issues", with_ctes(FINDINGS) + f"""
SELECT '- **[' || upper(severity) || '] ' || CASE lower(severity) {_EMOJI} ELSE {quoted(K.OTHER_EMOJI)} END || '** ' || description
  || chr(10) || '  - Affected files: ' || file_path || ', b.py' || CASE WHEN suggestion <> '' THEN chr(10) || '  - Suggestion: ' || suggestion ELSE '' END AS text, count(*) AS n
FROM findings GROUP BY ALL""")
def a11_pr_issues(t):
    f = findings(t.lineitem).withColumn("files", F.array("file_path", F.lit("b.py")))
    return f.select(N.render_pr_issue().alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query("g46_parse_analysis", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'Error parsing LLM response' WHEN doc_id % 4 = 2 THEN 'No summary provided' ELSE 'about ' || lang END AS summary,
  doc_id % 4 = 1 AS holistic, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE -1 END AS n_issues,
  CASE WHEN doc_id % 4 = 1 THEN 1 ELSE -1 END AS n_recommendations FROM documents""")
def g46(t):
    n = F.col("doc_id") % 4
    issue = '"issues":[{"type":"bug","severity":"high","description":"d","lineNumbers":[1,2]}]'
    raw = (
        F.when(n == 0, F.concat(F.lit('{"summary":"about '), "lang", F.lit('",' + issue + "}")))
        .when(n == 1, F.concat(F.lit('{"summary":"about '), "lang", F.lit('","crossFileIssues":[],"fileSpecificIssues":{"a.py":[]},"recommendations":["r"]}')))
        .when(n == 2, F.lit('{"summary":"",' + issue + "}"))
        .when(F.col("doc_id") % 12 == 3, F.lit("not json")).when(F.col("doc_id") % 12 == 7, F.lit("{broken}"))
        .otherwise(F.lit('{"summary":"x", "issues": [}'))
    )
    parsed = t.documents.select("doc_id", N.parse_analysis(raw).alias("p"))
    size = lambda c: F.coalesce(F.size(c), F.lit(-1))
    return parsed.select("doc_id", "p.summary", "p.holistic", size("p.issues").alias("n_issues"), size("p.recommendations").alias("n_recommendations"))


# --- planning --------------------------------------------------------------------------------------

PLAN_FILES = """pf AS (SELECT p_brand AS pr, p_partkey AS path, CAST(round(p_retailprice * p_size * 1.7) AS BIGINT) % 41000 AS full_tokens,
  CAST(p_size * 13 AS BIGINT) AS diff_tokens, p_type AS dir FROM part)"""


def plan_files(t):
    size = F.round(F.col("p_retailprice") * F.col("p_size") * 1.7).cast("long") % 41000
    return t.part.select(
        F.col("p_brand").alias("pr"), F.col("p_partkey").alias("path"), size.alias("full_tokens"),
        (F.col("p_size") * 13).cast("long").alias("diff_tokens"), F.col("p_type").alias("dir"))


@query("e13_plan_file_context", "WITH RECURSIVE " + PLAN_FILES + """,
e AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY least(full_tokens, 12000) + 2 * diff_tokens DESC, path) AS k FROM pf WHERE full_tokens <= 30000),
g AS (SELECT pr, path, k, full_tokens <= 60000 AS taken, 60000 - full_tokens AS room FROM e WHERE k = 1
  UNION ALL SELECT e.pr, e.path, e.k, e.full_tokens <= g.room, CASE WHEN e.full_tokens <= g.room THEN g.room - e.full_tokens ELSE g.room END
  FROM g JOIN e ON e.pr = g.pr AND e.k = g.k + 1)
SELECT pf.pr, pf.path, CASE WHEN taken THEN 'full' ELSE 'focused' END AS mode,
  CASE WHEN taken THEN 'full content fits holistic context budget' WHEN full_tokens > 30000 THEN 'full content estimate ' || full_tokens || ' tokens exceeds per-file holistic context ceiling 30000'
  ELSE 'full content estimate ' || full_tokens || ' tokens was not selected within total holistic context budget 60000' END AS reason
FROM pf LEFT JOIN g ON pf.pr = g.pr AND pf.path = g.path""")
def e13(t):
    return G.plan_file_context(plan_files(t), ["pr"]).select("pr", "path", "mode", "reason")


_PACK = PLAN_FILES + """,
o AS (SELECT pr, path, full_tokens AS tokens, row_number() OVER (PARTITION BY pr ORDER BY dir, diff_tokens DESC, path) AS k FROM pf),
g AS (SELECT pr, path, k, tokens AS held, 1 AS chunk_id FROM o WHERE k = 1
  UNION ALL SELECT o.pr, o.path, o.k, CASE WHEN g.held + o.tokens > 35000 THEN o.tokens ELSE g.held + o.tokens END,
    CASE WHEN g.held + o.tokens > 35000 THEN g.chunk_id + 1 ELSE g.chunk_id END FROM g JOIN o ON o.pr = g.pr AND o.k = g.k + 1)"""


@query("e12_pack_files", "WITH RECURSIVE " + _PACK + " SELECT pr, path, chunk_id FROM g")
def e12(t):
    order = [F.col("dir"), F.col("diff_tokens").desc(), F.col("path")]
    return G.pack_files(plan_files(t), ["pr"], order, "full_tokens", segment_rows=300).select("pr", "path", "chunk_id")


@query("d15_pr_token_estimate", with_ctes(PLAN_FILES) + """
SELECT pr, sum(diff_tokens)::BIGINT AS diff_tokens, sum(full_tokens)::BIGINT AS full_tokens, sum(least(full_tokens, 900))::BIGINT AS planned_tokens, count(*) AS n_files,
  sum(diff_tokens + least(full_tokens, 900))::BIGINT + 25000 AS estimated_tokens, sum(diff_tokens + least(full_tokens, 900)) + 25000 > 100000 OR count(*) > 30 AS should_chunk,
  CAST(ceil((sum(diff_tokens + least(full_tokens, 900)) + 25000) / 35000) AS BIGINT) AS recommended_chunks FROM pf GROUP BY ALL""")
def d15(t):
    return G.pr_token_estimate(plan_files(t).withColumn("planned_tokens", F.least("full_tokens", F.lit(900))), ["pr"])


@query("e9_byte_budget", """
WITH r AS (SELECT p_brand AS project, p_partkey, repeat(p_name, p_size * 20) AS content, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part),
c AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY project ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rank <= 25)
SELECT project, p_partkey, length(substr(content, 1, CAST(102400 - before AS BIGINT))) AS n FROM c WHERE before < 102400""")
def e9(t):
    from reviewlake.operators.topk import top_k

    rows = t.part.select(F.col("p_brand").alias("project"), "p_partkey", F.expr("repeat(p_name, p_size * 20)").alias("content"))
    ranked = top_k(rows, ["project"], [F.col("p_partkey")], 25)
    return G.byte_budget(ranked, ["project"]).select("project", "p_partkey", F.length("content").cast("long").alias("n"))


@query("e10_merge_line_windows", """
WITH l AS (SELECT DISTINCT l_suppkey AS file, greatest(1, l_partkey - 6) AS s, least(2000, l_partkey + 6) AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM l WHERE s <= e),
i AS (SELECT *, sum(CASE WHEN s <= r + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s, e) AS g FROM m)
SELECT file, min(s) AS start, max(e) AS "end" FROM i GROUP BY file, g""")
def e10(t):
    lines = t.lineitem.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("line"), F.lit(2000).cast("long").alias("total"))
    return G.merge_line_windows(lines, ["file"], "line", "total", 6)


@query("e11_line_chunks", """
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS x FROM documents),
c AS (SELECT doc_id, x, i FROM l, unnest(range(0, CAST(greatest(ceil((len(x) - 20) / 15.0), 0) AS BIGINT) + 1)) AS u(i))
SELECT doc_id, i * 15 + 1 AS start_line, least(i * 15 + 20, len(x)) AS end_line, md5(array_to_string(x[i * 15 + 1:i * 15 + 20], chr(10))) AS code FROM c
WHERE trim(array_to_string(x[i * 15 + 1:i * 15 + 20], '')) <> ''""")
def e11(t):
    c = t.documents.select("doc_id", F.inline(G.line_chunks(F.col("text"))))
    return c.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("code").alias("code"))


@query("e12_diff_pack", with_ctes(DIFFS) + """
SELECT pr, count(*) AS n_files, sum(ceil(length(diff) / 3.5))::BIGINT AS tokens FROM diffs GROUP BY ALL""")
def e12_diff(t):
    # Packing only numbers the files: nothing may be lost or counted twice.
    f = diffs(t.documents).select("pr", "path", "file_id", estimate_tokens("diff").alias("tokens"), C.change_size("diff").alias("size"))
    packed = G.pack_files(f, ["pr"], [F.col("path"), F.col("size").desc(), F.col("file_id")])
    chunks = packed.groupBy("pr", "chunk_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return chunks.groupBy("pr").agg(F.sum("n").alias("n_files"), F.sum("tokens").alias("tokens"))
