"""Vectors, nearest neighbours, full-text search, fusion, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import vectors as V
from reviewlake.operators.knn import knn, knn_clustered
from reviewlake.operators.models import HashedWords, embed, keyword_scores, verify_relevance
from reviewlake.operators.search import bm25, build_text_index, rrf
from reviewlake.operators.topk import top_k
from reviewlake.queries.inputs import FILES, WS_SQL, files, quoted, sql_trim, with_ctes
from reviewlake.queries.registry import query
from reviewlake.functions import constants as K

DIM = 64
TOKENS = "regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_embedding(name: str, source: str, key: str, text: str, dim: int = DIM) -> str:
    """CTEs giving ``name(key, bucket, w)``: the non-zero components of the hashed-word vector."""
    tokens = TOKENS.format(text=text)
    return f"""{name}_tok AS (SELECT {key}, unnest(CASE WHEN len({tokens}) = 0 THEN [''] ELSE {tokens} END) AS t FROM {source} WHERE regexp_matches({text}, '\\S')),
{name}_raw AS (
  SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim} AS bucket, count(*)::DOUBLE AS plain,
         sum(1.0 - 2.0 * (CAST(('0x' || substr(md5(t), 9, 1)) AS BIGINT) % 2))::DOUBLE AS signed
  FROM {name}_tok GROUP BY ALL),
{name}_v AS (SELECT {key}, bucket, CASE WHEN sum(signed * signed) OVER (PARTITION BY {key}) > 0 THEN signed ELSE plain END AS v FROM {name}_raw),
{name} AS (
  SELECT {key}, bucket, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w FROM {name}_v QUALIFY v <> 0)"""


def sql_bm25(queries: str, q_id: str, q_text: str, docs: str, d_id: str, d_text: str, k: int, prefix: str = "b",
             allowed: str = "") -> str:
    """CTEs ending in ``{prefix}_top(query_id, doc_id, score, rank)``."""
    p = prefix
    return f"""{p}_tok AS (SELECT {d_id} AS doc_id, unnest({TOKENS.format(text=d_text)}) AS term FROM {docs}),
{p}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {p}_tok GROUP BY ALL),
{p}_len AS (SELECT doc_id, sum(tf) AS dl FROM {p}_tf GROUP BY ALL),
{p}_n AS (SELECT count(*)::DOUBLE AS n FROM {docs}),
{p}_avg AS (SELECT sum(dl)::DOUBLE / any_value(n) AS adl FROM {p}_len, {p}_n),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY ALL),
{p}_q AS (SELECT DISTINCT {q_id} AS query_id, unnest({TOKENS.format(text=q_text)}) AS term FROM {queries}),
{p}_score AS (
  SELECT query_id, doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / adl))), 9) AS score
  FROM {p}_q JOIN {p}_tf USING (term) JOIN {p}_df USING (term) JOIN {p}_len USING (doc_id), {p}_n, {p}_avg
  {allowed}
  GROUP BY ALL),
{p}_top AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM {p}_score QUALIFY rank <= {k})"""


def sql_knn_components(name: str, a: str, a_key: str, b: str, b_key: str, k: int, where: str = "TRUE") -> str:
    """CTEs ending in ``{name}(query_id, id, distance, rank)`` from unit vectors given by components."""
    return f"""{name}_keys AS (
  SELECT q.{a_key} AS query_id, c.{b_key} AS id FROM (SELECT DISTINCT {a_key} FROM {a}) q, (SELECT DISTINCT {b_key} FROM {b}) c
  WHERE {where}),
{name}_dot AS (SELECT q.{a_key} AS query_id, c.{b_key} AS id, sum(q.w * c.w) AS dot FROM {a} q JOIN {b} c USING (bucket) GROUP BY ALL),
{name}_qn AS (SELECT {a_key} AS query_id, sum(w * w) AS nn FROM {a} GROUP BY ALL),
{name}_cn AS (SELECT {b_key} AS id, sum(w * w) AS nn FROM {b} GROUP BY ALL),
{name} AS (
  SELECT query_id, id, round(greatest(qn.nn + cn.nn - 2 * coalesce(dot, 0), 0), 9) AS distance,
         row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(qn.nn + cn.nn - 2 * coalesce(dot, 0), 0), 9), id) AS rank
  FROM {name}_keys JOIN {name}_qn qn USING (query_id) JOIN {name}_cn cn USING (id) LEFT JOIN {name}_dot USING (query_id, id)
  QUALIFY rank <= {k})"""


def sql_knn(k: int, same_label: bool = False) -> str:
    join = "q.label = c.label" if same_label else "TRUE"
    return f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         round(power(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2), 9) AS d
  FROM embeddings q JOIN embeddings c ON {join}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs)
SELECT query_id, id, round(d, 6) AS distance, rank FROM ranked WHERE rank <= {k}"""


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label"))


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 6))


@query("g1_cosine_similarity", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def g1(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select(
        "vec_id", F.round(V.cosine_similarity("embedding", "other"), 6).alias("cosine")
    )


@query("g2_l2_squared", """
SELECT a.vec_id, round(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 6) AS distance,
       round(greatest(0, least(1, 1 - power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2))), 6) AS doc_similarity,
       round(exp(-2 * power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)), 6) AS code_similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def g2_g3(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = t.embeddings.join(other, "vec_id").select("vec_id", V.l2_squared("embedding", "other").alias("d"))
    return d.select(
        "vec_id", F.round("d", 6).alias("distance"), F.round(V.document_similarity("d"), 6).alias("doc_similarity"),
        F.round(V.code_similarity("d"), 6).alias("code_similarity"),
    )


@query("g3_distance_to_similarity", """
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, 1 - l_discount * l_quantity)), 6) AS doc_similarity,
       round(least(1, exp(-2 * l_discount * l_quantity)), 6) AS code_similarity FROM lineitem""")
def g3(t):
    d = F.col("l_discount") * F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(V.document_similarity(d), 6).alias("doc_similarity"),
        F.round(V.code_similarity(d), 6).alias("code_similarity"),
    )


@query("g4_score_to_similarity", """
SELECT event_id, round(CASE WHEN event_type = 'view' THEN 0.5 ELSE least(1, greatest(0, value / 20)) END, 6) AS similarity
FROM events""")
def g4(t):
    score = F.when(F.col("event_type") == "view", None).otherwise(F.col("value") / 20)
    return t.events.select("event_id", F.round(V.score_similarity(score), 6).alias("similarity"))


@query("h1_knn_exact", sql_knn(10))
def h1(t):
    v = _vectors(t)
    return _rounded(knn(v, v, 10, query_id="id"))


@query("c8_knn_join", sql_knn(15, same_label=True))
def c8(t):
    v = _vectors(t)
    return _rounded(knn(v, v, 15, query_id="id", tenant="label", plan="blocks"))


@query("h1_knn_blocks", sql_knn(3))
def h1_blocks(t):
    # Small blocks force the pivot plan with its bound-driven second pass.
    v = _vectors(t)
    return _rounded(knn(v, v, 3, query_id="id", plan="blocks", block_rows=256, query_block_rows=256))


@query("h2_knn_ann", "SELECT count(*) AS n_queries, true AS recall_reached FROM embeddings")
def h2(t):
    # Three quarters of the cells, of vectors without clusters, must bring back nine tenths of the exact neighbours.
    v = _vectors(t)
    near = knn_clustered(v, v, 10, n_probe=9, n_cells=12, query_id="id").select("query_id", "id")
    exact = knn(v, v, 10, query_id="id").select("query_id", "id")
    hits = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("n_queries"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("recall_reached"))


@query("h3_bm25_search", with_ctes(sql_bm25("benchmark", "item_id", "text", "documents", "doc_id", "text", 5))
       + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM b_top")
def h3(t):
    hits = bm25(t.benchmark, build_text_index(t.documents), 5, query_id="item_id")
    return hits.withColumn("score", F.round("score", 6))


@query("h5_embed", with_ctes(sql_embedding("e", "documents", "doc_id", "text"))
       + "SELECT doc_id, bucket, round(w, 5) AS weight FROM e")
def h5(t):
    v = embed(t.documents.select("doc_id", "text"), "text", embedder=HashedWords(DIM))
    return v.select("doc_id", F.posexplode("vector").alias("bucket", "w")).where(F.col("w") != 0).select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 5).alias("weight")
    )


@query("c11_title_embedding_lookup", with_ctes(
    "titled AS (SELECT p_partkey, p_name FROM part)", sql_embedding("e", "(SELECT DISTINCT p_name FROM titled)", "p_name", "p_name"))
       + "SELECT p_partkey, bucket, round(w, 5) AS weight FROM titled JOIN e USING (p_name)")
def c11(t):
    v = embed(t.part.select("p_partkey", "p_name"), "p_name", embedder=HashedWords(DIM), distinct_first=True)
    return v.select("p_partkey", F.posexplode("vector").alias("bucket", "w")).where(F.col("w") != 0).select(
        "p_partkey", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 5).alias("weight")
    )


@query("h4_rrf_fusion", with_ctes(
    sql_bm25("benchmark", "item_id", "text", "documents", "doc_id", "text", 20),
    sql_embedding("qe", "benchmark", "item_id", "text"), sql_embedding("de", "documents", "doc_id", "text"),
    sql_knn_components("v", "qe", "item_id", "de", "doc_id", 20),
    """fused AS (
  SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score
  FROM (SELECT query_id, doc_id, rank FROM b_top UNION ALL SELECT query_id, id, rank FROM v) GROUP BY ALL)""")
       + """SELECT query_id, doc_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10""")
def h4(t):
    text = bm25(t.benchmark, build_text_index(t.documents), 20, query_id="item_id")
    q = embed(t.benchmark, "text", embedder=HashedWords(DIM))
    d = embed(t.documents.select("doc_id", "text"), "text", embedder=HashedWords(DIM))
    near = knn(q, d, 20, query_id="item_id", id_col="doc_id")
    fused = rrf([text, near.withColumnRenamed("id", "doc_id")], 10)
    return fused.withColumn("score", F.round("score", 6))


def _sql_label_scores(text: str) -> str:
    import re

    parts = []
    for i, label in enumerate(K.DOMAIN_LABELS):
        names = [w for w in re.split(r"[^a-z0-9]+", label.lower()) if len(w) > 1]
        hits = " + ".join(f"CAST(regexp_matches(lower({text}), '\\b{n}\\b') AS INTEGER)" for n in names)
        parts.append(f"SELECT file_id, {quoted(label)} AS domain, {i} AS ord, ({hits})::DOUBLE / {len(names)} AS confidence FROM files")
    return " UNION ALL ".join(parts)


@query("h6_classify_zero_shot", with_ctes(FILES, f"s AS ({_sql_label_scores('content')})") + """
SELECT file_id, domain, round(confidence, 6) AS confidence,
       row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, ord) - 1 AS place
FROM s WHERE confidence >= 0.3""")
def h6(t):
    scored = files(t.documents).select("file_id", F.posexplode(keyword_scores("content")).alias("place", "d"))
    return scored.select(
        "file_id", "d.domain", F.round("d.confidence", 6).alias("confidence"), F.col("place").cast("long").alias("place")
    )


@query("h7_verify_relevance", with_ctes(FILES, f"""s AS (SELECT file_id, regexp_replace({sql_trim('content')}, '[{WS_SQL}]+', ' ', 'g') AS c FROM files),
v AS (SELECT file_id, 'Comment: ' || CASE WHEN length(c) <= 500 THEN c
  WHEN regexp_matches(right(c, 100), '(?i)(^|[^A-Za-z0-9_])(fix|bug|issue|error|problem|solution|should|recommend)($|[^A-Za-z0-9_])')
    THEN substr(c, 1, 300) || '... ' || right(c, 100) ELSE substr(c, 1, 400) END
  || ' Code: ' || CASE WHEN length(c) > 400 THEN substr(c, 1, 400) || '...' ELSE c END AS v FROM s)""") + """
SELECT file_id FROM v WHERE length(v) % 7 >= 3""")
def h7(t):
    # The scorer rates the verification text; here a remainder of its length stands in for a model's probability.
    def score(texts):
        return [(len(x) % 7) / 6 for x in texts]

    kept = verify_relevance(files(t.documents), "content", "content", score, 0.4)
    return kept.select("file_id")


@query("e3_top_k_per_query", """
SELECT o_custkey, o_orderkey, rank FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders) WHERE rank <= 3""")
def e3(t):
    ranked = top_k(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return ranked.select("o_custkey", "o_orderkey", "rank")
