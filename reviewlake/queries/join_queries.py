"""Incremental joins, set operations and corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import diffs as D
from reviewlake.operators import corpus as R
from reviewlake.operators import history as H
from reviewlake.operators.similarity import set_jaccard
from reviewlake.queries.function_queries import JACCARD_WORDS, SQL_DIFF_LINES
from reviewlake.queries.inputs import (
    COMMENTS, DIFFS, FILES, PULL_REQUESTS, comments, diffs, files, pull_requests, with_ctes,
)
from reviewlake.queries.registry import query

# The stored corpus is the documents as they were: some missing, some with an older text.
STORED = """stored AS (SELECT file_id, project_path, path, CASE WHEN file_id % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash,
  CASE WHEN file_id % 97 = 0 THEN 'directory-structure' ELSE 'file' END AS type FROM files WHERE file_id % 3 <> 0
  UNION ALL SELECT file_id, project_path, path || '.gone', content_hash, 'file' FROM files WHERE file_id % 50 = 1
  UNION ALL SELECT file_id, project_path, NULL, content_hash, 'file' FROM files WHERE file_id % 60 = 1)"""


def stored(t):
    f = files(t.documents)
    n = F.col("file_id")
    cols = ["file_id", "project_path", "path", "content_hash", "type"]
    base = f.where(n % 3 != 0).withColumn("content_hash", F.when(n % 5 == 0, "old").otherwise(F.col("content_hash"))).withColumn(
        "type", F.when(n % 97 == 0, "directory-structure").otherwise("file"))
    gone = f.where(n % 50 == 1).withColumn("path", F.concat("path", F.lit(".gone"))).withColumn("type", F.lit("file"))
    pathless = f.where(n % 60 == 1).withColumn("path", F.lit(None).cast("string")).withColumn("type", F.lit("file"))
    return base.select(*cols).unionByName(gone.select(*cols)).unionByName(pathless.select(*cols))


@query("c1_diff_inventory", with_ctes(FILES, STORED, """old AS (SELECT DISTINCT project_path, path, content_hash FROM stored WHERE path IS NOT NULL),
live AS (SELECT project_path, path, content_hash, length(text) < 60 AS is_empty FROM files)""") + """
SELECT coalesce(l.project_path, o.project_path) AS project_path, coalesce(l.path, o.path) AS path, l.content_hash,
  CASE WHEN l.path IS NULL THEN 'deleted' WHEN is_empty THEN 'skipped_empty' WHEN same THEN 'unchanged' WHEN o.path IS NOT NULL THEN 'changed' ELSE 'new' END AS status
FROM live l FULL JOIN (SELECT project_path, path, count(*) AS n FROM old GROUP BY ALL) o ON l.project_path = o.project_path AND l.path = o.path
LEFT JOIN (SELECT DISTINCT project_path, path, content_hash, TRUE AS same FROM old) s
  ON l.project_path = s.project_path AND l.path = s.path AND l.content_hash = s.content_hash""")
def c1(t):
    current = files(t.documents).withColumn("is_empty", F.length("text") < 60)
    return R.diff_inventory(current, stored(t).where("path IS NOT NULL"))


@query("c2_prune_files", with_ctes(FILES, STORED) + """
SELECT file_id, path, type FROM stored s WHERE type = 'directory-structure' OR path IS NULL
  OR EXISTS (SELECT 1 FROM files f WHERE f.project_path = s.project_path AND f.path = s.path AND f.lang = 'en')""")
def c2(t):
    live = files(t.documents).where("lang = 'en'")
    return R.prune_files(stored(t), live).select("file_id", "path", "type")


@query("c3_prune_chunks", with_ctes(FILES, STORED) + """
SELECT file_id, path FROM stored s WHERE path IS NULL
  OR EXISTS (SELECT 1 FROM files f WHERE f.project_path = s.project_path AND f.path = s.path AND f.lang <> 'en')""")
def c3(t):
    chunks = stored(t).withColumnRenamed("path", "original_document_path")
    live = files(t.documents).where("lang <> 'en'").withColumnRenamed("path", "original_document_path")
    return R.prune_chunks(chunks, live).select("file_id", F.col("original_document_path").alias("path"))


LINE_CHUNKS = """doc_chunks AS (SELECT doc_id, 'd' || doc_id || '#' || i AS id, substr(md5(line), 1, 8) AS content_hash, i
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i))"""


def line_rows(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id"), F.lit("#"), F.col("p") + 1).alias("id"),
        F.substring(F.md5("line"), 1, 8).alias("content_hash"), (F.col("p") + 1).alias("i"),
    )


def old_rows(t):
    n = F.col("doc_id")
    changed = F.when((n % 4 == 1) & (F.col("i") == 2), "old").otherwise(F.col("content_hash"))
    return line_rows(t).where(n % 3 != 0).withColumn("content_hash", changed)


@query("d11_document_signature", with_ctes(LINE_CHUNKS) + """
SELECT doc_id, md5(string_agg(id || ':' || content_hash, '|' ORDER BY id || ':' || content_hash)) AS signature, count(*) AS n_chunks
FROM doc_chunks GROUP BY ALL""")
def d11(t):
    return R.document_signature(line_rows(t), ["doc_id"]).withColumn("signature", F.md5("signature"))


@query("c4_diff_documents", with_ctes(LINE_CHUNKS, """old AS (SELECT doc_id, string_agg(id || ':' || CASE WHEN doc_id % 4 = 1 AND i = 2 THEN 'old' ELSE content_hash END, '|'
    ORDER BY id || ':' || CASE WHEN doc_id % 4 = 1 AND i = 2 THEN 'old' ELSE content_hash END) AS s FROM doc_chunks WHERE doc_id % 3 <> 0 GROUP BY ALL),
new AS (SELECT doc_id, count(*) AS n_chunks, string_agg(id || ':' || content_hash, '|' ORDER BY id || ':' || content_hash) AS s FROM doc_chunks GROUP BY ALL)""") + """
SELECT doc_id, n_chunks, CASE WHEN new.s = old.s THEN 'unchanged' ELSE 'replace' END AS status FROM new LEFT JOIN old USING (doc_id)""")
def c4(t):
    return R.diff_documents(line_rows(t), old_rows(t), ["doc_id"])


@query("c4_replace_documents", with_ctes(LINE_CHUNKS, """old AS (SELECT *, CASE WHEN doc_id % 4 = 1 AND i = 2 THEN 'old' ELSE content_hash END AS h FROM doc_chunks WHERE doc_id % 3 <> 0),
changed AS (SELECT doc_id FROM doc_chunks GROUP BY doc_id HAVING doc_id % 3 = 0 OR (doc_id % 4 = 1 AND count(*) >= 2))""") + """
SELECT id, h AS content_hash FROM old WHERE doc_id NOT IN (SELECT doc_id FROM changed)
UNION ALL SELECT id, content_hash FROM doc_chunks WHERE doc_id IN (SELECT doc_id FROM changed)""")
def c4_replace(t):
    return R.replace_documents(old_rows(t), line_rows(t), ["doc_id"]).select("id", "content_hash")


@query("c5_stale_comments", with_ctes(COMMENTS) + """
SELECT id FROM comments WHERE conv_id % 3 = 0 AND conv_id % 5 <> 0 AND NOT (turn < 2 AND conv_id % 6 <> 0)""")
def c5(t):
    c = comments(t.conversations).withColumn("pr_number", F.col("conv_id"))
    prs = c.select("repository", "pr_number", "conv_id").distinct()
    live = c.where((F.col("turn") < 2) & (F.col("conv_id") % 6 != 0))
    return H.stale_comments(c, prs.where("conv_id % 3 = 0"), live, prs.where("conv_id % 5 = 0")).select("id")


SYNC = """sync AS (SELECT repository, pr_number, count(*) AS comment_count,
    max(try_cast(CASE WHEN coalesce(updated_at, '') = '' THEN created_at ELSE updated_at END AS TIMESTAMP)) AS latest_comment_at,
    max(try_cast(pr_updated_at AS TIMESTAMP)) AS latest_pr_updated_at
  FROM comments WHERE pr_number <> 0 GROUP BY ALL)"""


@query("d3_pr_sync_state", with_ctes(COMMENTS, SYNC) + """
SELECT repository, pr_number, comment_count, strftime(latest_comment_at, '%Y-%m-%d %H:%M:%S') AS latest_comment_at,
  strftime(latest_pr_updated_at, '%Y-%m-%d %H:%M:%S') AS latest_pr_updated_at FROM sync""")
def d3(t):
    s = H.pr_sync_state(comments(t.conversations))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("repository", "pr_number", "comment_count", text("latest_comment_at"), text("latest_pr_updated_at"))


_SHIFTED = """prs AS (SELECT number AS pr_number, repository, CASE WHEN number % 7 = 0 THEN 'bad' ELSE strftime(CAST(updated_at AS TIMESTAMP) + INTERVAL 25 YEAR, '%Y-%m-%dT%H:%M:%SZ') END AS updated_at FROM pull_requests)"""


@query("c6_skip_processed_prs", with_ctes(COMMENTS, PULL_REQUESTS, SYNC, _SHIFTED) + """
SELECT pr_number, repository, CASE WHEN comment_count IS NULL THEN FALSE WHEN latest_pr_updated_at IS NULL THEN latest_comment_at IS NOT NULL
  ELSE coalesce(try_cast(updated_at AS TIMESTAMP) <= latest_pr_updated_at, FALSE) END AS skip
FROM prs LEFT JOIN sync USING (repository, pr_number)""")
def c6(t):
    later = F.date_format(F.to_timestamp("updated_at") + F.expr("INTERVAL 25 YEARS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    prs = pull_requests(t.orders).withColumnRenamed("number", "pr_number").withColumn(
        "updated_at", F.when(F.col("pr_number") % 7 == 0, "bad").otherwise(later))
    return H.skip_processed(prs, H.pr_sync_state(comments(t.conversations))).select("pr_number", "repository", "skip")


@query("c7_comment_patch_lookup", with_ctes(DIFFS, SQL_DIFF_LINES, """wanted AS (SELECT conv_id, turn, conv_id AS file_id, conv_id % 30 + 2 + 2 * (turn % 2) AS line FROM conversations),
hits AS (SELECT w.conv_id, w.turn, b.mark, b.content, row_number() OVER (PARTITION BY w.conv_id, w.turn ORDER BY b.pos) AS k
  FROM wanted w JOIN body b ON b.file_id = w.file_id AND b.line_number = w.line)""") + """
SELECT w.conv_id, w.turn, CASE WHEN mark = '-' THEN content END AS original, CASE WHEN mark = '+' THEN content END AS suggested
FROM wanted w LEFT JOIN hits h ON w.conv_id = h.conv_id AND w.turn = h.turn AND k = 1""")
def c7(t):
    from reviewlake.plans.history import attach_patch_code

    c = t.conversations.select(
        "conv_id", "turn", F.col("conv_id").alias("pr_number"), F.col("conv_id").cast("string").alias("file_path"),
        (F.col("conv_id") % 30 + 2 + 2 * (F.col("turn") % 2)).cast("int").alias("line"), F.lit(None).cast("string").alias("original_code"),
        F.lit(None).cast("string").alias("suggested_code"), F.lit(None).cast("string").alias("diff_hunk"),
    )
    patches = diffs(t.documents).select(
        F.col("file_id").alias("pr_number"), F.col("file_id").cast("string").alias("filename"),
        F.regexp_replace("diff", r"(?s)^.*?(?=@@)", "").alias("patch"),
    )
    # Some patches were landed twice, the second time with a line more.
    twice = patches.where("pr_number % 3 = 0").withColumn("patch", F.concat("patch", F.lit("\n+late")))
    return attach_patch_code(c, patches.unionByName(twice), ["pr_number"]).select(
        "conv_id", "turn", F.col("original_code").alias("original"), F.col("suggested_code").alias("suggested")
    )


@query("c10_content_lookup", """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || o_orderkey END AS content FROM orders)
SELECT o_custkey, coalesce(min_by(content, md5(content)) FILTER (WHERE content <> ''), '') AS content FROM r GROUP BY ALL""")
def c10(t):
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(
        F.concat("o_orderpriority", "o_orderkey")).alias("content"))
    return R.content_by_path(rows, ["o_custkey"])


@query("c14_existence_semi_join", """
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45)""")
def c14(t):
    live = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.existing_files(t.orders, live, ["o_orderkey"]).select("o_orderkey")


@query("a5_ensure_column", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS project_path, c_name FROM customer")
def a5(t):
    return R.ensure_column(R.ensure_column(t.customer, "project_path", "string"), "c_name", "string").select("c_custkey", "project_path", "c_name")


@query("a12_upsert", """
WITH u AS (SELECT o_custkey AS id, max_by(o_orderpriority, (o_totalprice, o_orderkey)) AS v FROM orders GROUP BY ALL)
SELECT c_custkey AS id, c_mktsegment AS v FROM customer WHERE c_custkey NOT IN (SELECT id FROM u) UNION ALL SELECT id, v FROM u""")
def a12(t):
    target = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    updates = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("v"), "o_totalprice", "o_orderkey")
    merged = R.upsert(target, updates, ["id"], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()])
    return merged.select("id", "v")


@query("a13_delete_where", """
SELECT count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS deleted FROM (SELECT l_quantity < 10 AND l_returnflag = 'R' AS gone FROM lineitem)""")
def a13(t):
    kept, deleted = R.delete_where(t.lineitem, (F.col("l_quantity") < 10) & (F.col("l_returnflag") == "R"))
    return kept.agg(F.count("*").alias("kept")).join(deleted)


@query("e14_latest_record", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL""")
def e14(t):
    return R.latest_record(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("a14_summaries", """
WITH s AS (SELECT user_id, ts, event_id, props FROM events)
SELECT user_id, CAST(json_extract(arg_max(props, (ts, event_id)), '$.k') AS BIGINT) AS k, 'project ' || user_id AS project_name,
  arg_max(event_id, (ts, event_id))::VARCHAR AS created_at FROM s GROUP BY ALL""")
def a14(t):
    from reviewlake.sources.corpus import get_summary

    table = t.events.select(
        F.col("user_id").cast("string").alias("project_path"), F.col("props").alias("summary"),
        F.concat(F.lit("project "), "user_id").alias("project_name"), F.col("event_id").cast("string").alias("created_at"), "user_id", "event_id", "ts",
    ).withColumn("last_updated", F.concat_ws("#", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    about = "summary._metadata."
    return get_summary(table, "k BIGINT").select(
        F.col("project_path").cast("long").alias("user_id"), "summary.k", about + "project_name", about + "created_at")


@query("d6_corpus_stats", """
WITH c AS (SELECT 'documents' AS "table", count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels)
SELECT "table", n FROM c UNION ALL SELECT 'total', sum(n)::BIGINT FROM c""")
def d6(t):
    return R.corpus_stats({"documents": t.documents, "pages": t.pages, "labels": t.labels})


@query("d12_inventory_hash", with_ctes(FILES, """lines AS (SELECT project_path, 'file:' || path || ':' || content_hash AS line, count(*) AS times FROM files GROUP BY ALL),
b AS (SELECT project_path, substr(md5(line), 1, 3) AS bucket, sha256(string_agg(line || '#' || times, chr(10) ORDER BY line || '#' || times)) AS h FROM lines GROUP BY ALL)""") + """
SELECT project_path, sha256(string_agg(bucket || h, '' ORDER BY bucket)) AS fingerprint FROM b GROUP BY ALL""")
def d12(t):
    return R.inventory_hash(files(t.documents).withColumn("type", F.lit("")), ["project_path"])


@query("d13_key_files_hash", with_ctes(FILES, """r AS (SELECT project_path, path || 'T' || file_id || CASE WHEN n_chars < 51200 THEN substr(content, 1, 1000) ELSE '' END AS tx,
  row_number() OVER (PARTITION BY project_path ORDER BY file_id) AS rank FROM files)""") + """
SELECT project_path, sha256(string_agg(tx, '' ORDER BY rank)) AS fingerprint FROM r WHERE rank <= 15 GROUP BY ALL""")
def d13(t):
    return R.key_files_hash(key_rows(t), ["project_path"])


def key_rows(t):
    from reviewlake.operators.topk import top_k

    ranked = top_k(files(t.documents), ["project_path"], [F.col("file_id")], 15)
    return ranked.withColumn("last_modified", F.concat(F.lit("T"), F.col("file_id"))).withColumn("size", F.col("n_chars"))


@query("h22_analysis_is_stale", with_ctes(FILES) + """
SELECT project_path, project_path IN (SELECT '/work/' || source FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1) AS stale FROM files GROUP BY ALL""")
def h22(t):
    # Since the stored analysis, files labelled toxic were added.
    f = files(t.documents)
    before = f.join(t.labels.where("toxic = 1"), f.file_id == t.labels.doc_id, "left_anti")
    keys = ["project_path"]
    kf = R.key_files_hash(key_rows(t), keys)
    stored_ = R.inventory_hash(before.withColumn("type", F.lit("file")), keys).withColumnRenamed("fingerprint", "inventory_hash").join(
        kf.withColumnRenamed("fingerprint", "key_files_hash"), keys)
    return R.analysis_is_stale(stored_, R.inventory_hash(f.withColumn("type", F.lit("file")), keys), kf, keys)


@query("d24_run_counters", with_ctes(FILES) + """
SELECT CASE WHEN length(text) < 60 THEN 'skipped_empty' WHEN file_id % 5 = 0 THEN 'processed' ELSE 'unchanged' END AS status, count(*) AS n FROM files GROUP BY ALL""")
def d24(t):
    f = files(t.documents)
    old = f.withColumn("content_hash", F.when(F.col("file_id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    status = R.diff_inventory(f.withColumn("is_empty", F.length("text") < 60), old)
    return R.run_counters(status.withColumn("status", F.when(F.col("status") == "changed", "processed").otherwise(F.col("status"))))


@query("f1_union_comments", with_ctes(COMMENTS) + """
SELECT id, CASE WHEN file_path IS NOT NULL THEN 'review' ELSE 'issue' END AS type FROM comments""")
def f1(t):
    c = comments(t.conversations)
    return H.union_comments(c.where("file_path IS NOT NULL"), c.where("file_path IS NULL")).select("id", "type")


@query("f2_live_ids", with_ctes(COMMENTS) + """
SELECT DISTINCT repository, pr_number, id FROM comments WHERE turn % 2 = 0 OR role = 'user'""")
def f2(t):
    c = comments(t.conversations)
    return H.live_ids(c.where("turn % 2 = 0"), c.where("role = 'user'"))


@query("f3_changed_lines", with_ctes(DIFFS, SQL_DIFF_LINES, """n AS (SELECT file_id, len(string_split(content, chr(10))) AS total FROM diffs)""") + """
SELECT file_id, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) AS lines FROM (
  SELECT DISTINCT file_id, least(greatest(line_number, 1), total) AS l FROM body JOIN n USING (file_id) WHERE mark IN ('+', '-')
  UNION SELECT file_id, least(3, total) FROM n) GROUP BY ALL""")
def f3(t):
    parsed = diffs(t.documents).withColumn("p", D.parse_diff("diff", removal_anchors=True, hunk_fallback=True))
    lines = D.changed_lines(F.array(F.lit(3), F.lit(0)), F.col("p.changed"), F.size(F.split("content", "\n", -1)))
    return parsed.select("file_id", F.array_join(lines.cast("array<string>"), ",").alias("lines"))


@query("f5_jaccard_sets", f"""
WITH w AS (SELECT doc_id, {JACCARD_WORDS.format(c='text')} AS x, {JACCARD_WORDS.format(c="lang || ' ' || source || ' ' || replace(text, 'en', 'an')")} AS y FROM documents)
SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM w""")
def f5(t):
    from reviewlake.operators.similarity import word_set

    other = F.concat_ws(" ", "lang", "source", F.replace("text", F.lit("en"), F.lit("an")))
    return t.documents.select("doc_id", F.round(set_jaccard(word_set("text"), word_set(other)), 6).alias("jaccard"))


@query("g49_directory_tree", """
WITH p AS (SELECT page_id, string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', ''), '/') AS a FROM pages),
n AS (SELECT DISTINCT a[1:i] AS seg, i < len(a) AS is_dir FROM p, unnest(range(1, least(len(a), 6) + 1)) AS u(i))
SELECT 'web' AS project, array_to_string(list_transform(seg, lambda s, i: CASE WHEN i < len(seg) OR is_dir THEN '0' ELSE '1' END || s), chr(1)) AS sort_key,
  repeat('    ', len(seg) - 1) || seg[len(seg)] || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM n""")
def g49(t):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?://", "")
    return R.directory_tree(t.pages.select(F.lit("web").alias("project"), path.alias("path")), ["project"]).select("project", "sort_key", "line")
