"""Ranking, deduplication and key-file selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.operators import keyfiles as Y
from reviewlake.operators.topk import top_k
from reviewlake.plans import retrieval as Q
from reviewlake.queries.inputs import FILES, files, pick, quoted, sql_any, with_ctes
from reviewlake.queries.predicate_queries import sql_file_type, sql_is_doc, sql_is_test
from reviewlake.queries.registry import query

HITS = """hits AS (SELECT l_suppkey AS query_id, l_partkey AS id, 'src/f' || (l_partkey % 211) || CASE WHEN l_partkey % 6 = 0 THEN '.md' ELSE '.py' END AS path,
  '/work/p' AS project_path, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'h' || (l_partkey % 3) END AS heading, l_discount * 10 AS similarity,
  l_tax * 10 AS distance, l_linenumber AS start_line, l_orderkey, l_suppkey % 10 AS pr FROM lineitem)"""


def hits(t):
    p = F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_suppkey").alias("query_id"), p.alias("id"),
        F.concat(F.lit("src/f"), p % 211, F.when(p % 6 == 0, ".md").otherwise(".py")).alias("path"), F.lit("/work/p").alias("project_path"),
        F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("h"), p % 3)).alias("heading"), (F.col("l_discount") * 10).alias("similarity"),
        (F.col("l_tax") * 10).alias("distance"), F.col("l_linenumber").alias("start_line"), "l_orderkey", (F.col("l_suppkey") % 10).alias("pr"))


@query("e1_best_match_per_comment", with_ctes(HITS) + """
SELECT query_id, id, round(distance, 6) AS distance, start_line FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY distance, start_line) AS k FROM hits WHERE distance <= 0.4) WHERE k = 1""")
def e1(t):
    found = Q.best_match_per_comment(hits(t).select("query_id", "id", "distance", "start_line"), ["query_id", "id"])
    return found.withColumn("distance", F.round("distance", 6))


@query("e2_dedup_context", with_ctes(HITS, """h AS (SELECT query_id, id, path, heading, pr, max(similarity) AS similarity FROM hits GROUP BY ALL),
k AS (SELECT 'guidelines' AS kind, pr, path || '-' || heading AS key, id, query_id, similarity, 100 AS cap FROM h
  UNION ALL SELECT 'comments', pr, CAST(id AS VARCHAR), id, query_id, similarity, 40 FROM h
  UNION ALL SELECT 'code_examples', pr, CASE WHEN id % 7 = 0 THEN 'path:' || path ELSE 'content:' || (id % 300) END, id, query_id, similarity, 40 FROM h),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY kind, pr, key ORDER BY similarity DESC, id, query_id) = 1)""") + """
SELECT kind, pr, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY kind, pr ORDER BY similarity DESC, id) AS rank FROM b
QUALIFY row_number() OVER (PARTITION BY kind, pr ORDER BY similarity DESC, id) <= cap""")
def e2(t):
    h = hits(t).groupBy("query_id", "id", "path", "heading", "pr").agg(F.max("similarity").alias("similarity")).drop("pr")
    prs = t.supplier.select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 10).alias("pr"))
    contents = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(
        F.concat(F.lit(" body "), F.col("p_partkey") % 300, F.lit("\n"))).alias("content"))
    context = {"guidelines": h, "comments": h, "code_examples": h}
    out = Q.dedup_context(context, prs, contents)
    rows = None
    for kind, df in out.items():
        part = df.select(F.lit(kind).alias("kind"), "pr", "id", F.round("similarity", 6).alias("similarity"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("f4_union_context", with_ctes(HITS, "h AS (SELECT query_id, id, any_value(pr) AS pr FROM hits GROUP BY ALL)") + """
SELECT 'code' AS kind, pr, count(DISTINCT query_id) AS n_files, count(*) AS n_items FROM h GROUP BY ALL
UNION ALL SELECT 'comments', pr, count(DISTINCT query_id), count(*) FROM h WHERE query_id % 2 = 1 GROUP BY ALL""")
def f4(t):
    h = hits(t).groupBy("query_id", "id").agg(F.first("pr").alias("pr"))
    even, odd = h.where("query_id % 2 = 0"), h.where("query_id % 2 = 1")
    # Two batches of files; only one of them has comments, with its columns in another order.
    context = Q.union_context([{"code": even}, {"code": odd.select("pr", "id", "query_id"), "comments": odd}])
    count = lambda kind: context[kind].groupBy(F.lit(kind).alias("kind"), "pr").agg(
        F.count_distinct("query_id").alias("n_files"), F.count("*").alias("n_items"))
    return count("code").unionByName(count("comments"))


@query("e4_unique_candidates", with_ctes(HITS, """o AS (SELECT query_id, path, id, similarity FROM hits WHERE NOT suffix(path, '.md')
  QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY similarity DESC, id) = 1)""") + """
SELECT query_id, path, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path) AS rank FROM o
QUALIFY rank <= 8""")
def e4(t):
    found = Q.unique_candidates(hits(t).select("query_id", "path", "id", "similarity"))
    return found.select("query_id", "path", "id", "rank")


# Documents of the hits with a context that follows from the path.
DOC_SCORES = HITS + """,
c AS (SELECT DISTINCT path, list_extract(['Frontend','Backend','General','Unknown','DevOps'], CAST(CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 5 AS INTEGER) + 1) AS da,
  CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 2 = 0 AS has_react, CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 3 = 0 AS rs, CAST(regexp_extract(path, '(\\d+)', 1) AS BIGINT) % 4 = 0 AS gen FROM hits),
q AS (SELECT s_suppkey AS query_id, list_extract(['Frontend','Backend','GeneralJS_TS','Unknown','DevOps'], CAST(s_suppkey % 5 AS INTEGER) + 1) AS qa, s_suppkey % 2 = 0 AS q_react FROM supplier),
sem AS (SELECT query_id, path, max(similarity) * 0.5 + avg(similarity) * 0.3 + least(count(*), 5) * 0.04 AS semantic FROM hits WHERE similarity >= 0.1 GROUP BY ALL),
m AS (SELECT sem.*, c.*, q.qa, q.q_react, CASE WHEN qa <> 'Unknown' AND da NOT IN ('Unknown', 'General') THEN CASE WHEN qa = da THEN 0.8 + CASE WHEN q_react AND has_react THEN 0.2 ELSE 0 END
    WHEN qa <> 'GeneralJS_TS' THEN -0.2 ELSE 0 END ELSE 0 END AS match FROM sem JOIN c USING (path) JOIN q USING (query_id)),
scores AS (SELECT *, (semantic * 0.2 + match * 0.6) * CASE WHEN (rs OR gen) AND qa <> 'DevOps' AND (match < 0.8 OR gen) THEN 0.7 ELSE 1 END AS score FROM m)"""


def doc_scores(t):
    n = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    none = F.array().cast("array<string>")
    contexts = hits(t).select("project_path", "path").distinct().select(
        "project_path", "path", pick(("Frontend", "Backend", "General", "Unknown", "DevOps"), n).alias("doc_area"),
        F.when(n % 2 == 0, F.array(F.lit("react"))).otherwise(none).alias("doc_tech"), (n % 3 == 0).alias("readme_style"), (n % 4 == 0).alias("generic"))
    s = F.col("s_suppkey")
    queries = t.supplier.select(
        s.alias("query_id"), pick(("Frontend", "Backend", "GeneralJS_TS", "Unknown", "DevOps"), s).alias("area"),
        F.when(s % 2 == 0, F.array(F.lit("React"))).otherwise(none).alias("tech"), F.lit(None).cast("array<float>").alias("vector"))
    return Q.document_scores(hits(t), contexts, queries)


@query("d14_document_scores", with_ctes(DOC_SCORES) + "SELECT query_id, path, round(semantic, 6) AS semantic, round(score, 6) AS score FROM scores")
def d14(t):
    return doc_scores(t).select("query_id", "path", F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"))


@query("e5_best_chunk_top_docs", with_ctes(DOC_SCORES, """fit AS (SELECT query_id, path, round(score, 9) AS score FROM scores WHERE score >= 0.3
    AND (qa = 'Unknown' OR da IN ('Unknown', 'General') OR qa = da OR (q_react AND has_react))),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS doc_rank FROM fit QUALIFY doc_rank <= 4),
best AS (SELECT query_id, path, id, similarity FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY similarity DESC, id) = 1)""") + """
SELECT query_id, path, id, round(similarity, 6) AS similarity, doc_rank FROM top JOIN best USING (query_id, path)""")
def e5(t):
    scores = doc_scores(t).withColumn("score", F.round("score", 9))
    best = Q.best_chunk_of_top_docs(hits(t).withColumn("rank", F.lit(0)), scores)
    return best.select("query_id", "path", "id", F.round("similarity", 6).alias("similarity"), "doc_rank")


@query("e6_category_quota", """
WITH c AS (SELECT p_brand AS project_path, p_partkey, list_extract(['package','config','setup','utility','types','docs','tests'], CAST(p_size % 7 AS INTEGER) + 1) AS category FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY project_path, category ORDER BY p_partkey) AS nth FROM c)
SELECT project_path, p_partkey, category, row_number() OVER (PARTITION BY project_path ORDER BY p_partkey) AS rank FROM k
WHERE nth <= CASE category WHEN 'package' THEN 3 WHEN 'config' THEN 6 WHEN 'setup' THEN 4 WHEN 'utility' THEN 4 WHEN 'types' THEN 3 ELSE 2 END
QUALIFY rank <= 15""")
def e6(t):
    kinds = ("package", "config", "setup", "utility", "types", "docs", "tests")
    c = t.part.select(F.col("p_brand").alias("project_path"), "p_partkey", pick(kinds, F.col("p_size")).alias("category"))
    return Y.category_quota(c, [F.col("p_partkey")])


KEY_INPUT = FILES + ", kf AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, len(string_split(path, '/')) AS depth FROM files)"


def key_input(t):
    from reviewlake.functions.paths import basename

    return files(t.documents).withColumn("name", basename("path"))


@query("e7_shallowest_distinct", with_ctes(KEY_INPUT, "d AS (SELECT project_path, path, any_value(depth) AS depth FROM kf GROUP BY ALL)") + """
SELECT project_path, path, row_number() OVER (PARTITION BY project_path ORDER BY depth, path) AS place FROM d QUALIFY place <= 20""")
def e7(t):
    return Y.shallowest_distinct(key_input(t), 20).select("project_path", "path", "place")


def _sql_searches() -> str:
    fit = {"docs": sql_is_doc("path"), "tests": sql_is_test("path")}
    parts = []
    for i, (category, matcher, terms, likes, limit) in enumerate(K.KEY_FILE_SEARCHES):
        rule = fit.get(matcher) or sql_file_type(matcher)
        if terms:
            parts.append(f"SELECT project_path, path, depth, {i} AS s FROM near WHERE {sql_any('blob', terms)} AND ({rule})")
        else:
            like = " OR ".join(f"{c} LIKE {quoted(p)}" for c, p in likes)
            parts.append(f"SELECT project_path, path, depth, {i} AS s FROM (SELECT * FROM metas WHERE {like} QUALIFY row_number() OVER "
                         f"(PARTITION BY project_path ORDER BY depth, path) <= {limit}) WHERE {rule}")
    names = "[" + ", ".join(quoted(s[0]) for s in K.KEY_FILE_SEARCHES) + "]"
    return f"""metas AS (SELECT project_path, path, any_value(name) AS name, any_value(depth) AS depth, lower(any_value(name)) AS lname, lower(path) AS lpath,
  lower(coalesce(min_by(content, md5(content)) FILTER (WHERE trim(content) <> ''), '')) || chr(1) || lower(path) || chr(1) || lower(any_value(name)) AS blob FROM kf GROUP BY project_path, path),
near AS (SELECT * FROM metas QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY depth, path) <= 500),
found AS ({' UNION ALL '.join(parts)}),
cats AS (SELECT project_path, path, min(s) AS first, min(depth) AS depth, list_extract({names}, CAST(max(s) AS INTEGER) + 1) AS category FROM found GROUP BY project_path, path)"""


@query("e8_term_search", with_ctes(KEY_INPUT, _sql_searches()) + "SELECT project_path, path, first, category FROM cats")
def e8(t):
    return Y.term_search(key_input(t)).select("project_path", "path", "first", "category")


_QUOTA = """q AS (SELECT *, row_number() OVER (PARTITION BY project_path, category ORDER BY first, depth, path) AS nth FROM cats),
picked AS (SELECT *, row_number() OVER (PARTITION BY project_path ORDER BY first, depth, path) AS rank FROM q
  WHERE nth <= CASE category WHEN 'package' THEN 3 WHEN 'config' THEN 6 WHEN 'setup' THEN 4 WHEN 'utility' THEN 4 WHEN 'types' THEN 3 ELSE 2 END QUALIFY rank <= 15)"""


@query("h18_select_key_files", with_ctes(KEY_INPUT, _sql_searches(), _QUOTA) + "SELECT project_path, path, category, rank FROM picked")
def h18(t):
    return Y.select_key_files(key_input(t)).select("project_path", "path", "category", "rank")


@query("h21_key_files_validate", with_ctes(KEY_INPUT, _sql_searches(), _QUOTA, """live AS (SELECT project_path, path FROM files WHERE lang <> 'en' OR file_id % 3 <> 0),
s AS (SELECT project_path, count(*) AS n, count(*) FILTER (WHERE (project_path, path) IN (SELECT (project_path, path) FROM live)) AS m FROM picked GROUP BY ALL)""") + """
SELECT p.project_path, p.path, m < n * 0.7 AS rediscover FROM picked p JOIN s USING (project_path) WHERE (p.project_path, p.path) IN (SELECT (project_path, path) FROM live)""")
def h21(t):
    live = files(t.documents).where((F.col("lang") != "en") | (F.col("file_id") % 3 != 0))
    return Y.validate_key_files(Y.select_key_files(key_input(t)), live).select("project_path", "path", "rediscover")


__all__ = ["hits", "top_k"]
