import json

import pytest
from pyspark.sql import functions as F

from reviewlake.operators.knn import within
from reviewlake.operators.models import HashedWords
from reviewlake.plans import history as S
from reviewlake.plans import retrieval
from reviewlake.plans import review as V
from reviewlake.plans.refresh import refresh_corpus, refresh_files
from reviewlake.plans.retrieval import find_custom_chunks, find_similar_code, unified_context
from reviewlake.queries.registry import Tables
from reviewlake.sources import landed as L
from reviewlake.sources.corpus import SCHEMAS, Corpus, check_clearable
from reviewlake.sources.files import expand_patterns, load_exclusions, scan_files
from reviewlake.sources.sinks import write_review_json, write_review_text
from reviewlake.streaming.jobs import stream_comments, stream_documents

E = HashedWords(32)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "src/a.js": "let a", "src/deep/b.py": "b = 1", "README.md": "# Hi", "node_modules/x/c.js": "x", ".hidden/d.js": "x", "img/e.png": "x",
        "src/app.min.js": "x", "yarn.lock": "x", "src/.env.js": "x", "assets/f.js": "x",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_scan_files(spark, tree):
    got = scan_files(spark, str(tree))
    assert rows(got, "relative_path", "length") == [("README.md", 4), ("src/a.js", 5), ("src/deep/b.py", 5)]
    only = scan_files(spark, str(tree), ["**/*.js"], ["src/deep/**"], with_content=True)
    assert {r["relative_path"] for r in only.collect()} == {"src/a.js", "src/app.min.js", "node_modules/x/c.js", "assets/f.js"}


def test_expand_patterns(spark, tree):
    got = expand_patterns(spark, ["src/a.js", "src/*.js", "**/*.py", "missing/*.x"], str(tree))
    names = sorted(r["path"].rsplit("/", 1)[1] for r in got.collect())
    assert names.count("a.js") == 1 and "b.py" in names


def test_load_exclusions(spark, tmp_path):
    (tmp_path / "ex.txt").write_text("# note\n\n  dist/**  \n*.log\n")
    assert rows(load_exclusions(spark, str(tmp_path / "ex.txt")), "pattern") == [("*.log",), ("dist/**",)]


def test_load_feedback(spark, tmp_path):
    def entry(text):
        return {"originalIssue": text, "overallSentiment": "negative", "userReplies": [{"body": "no"}]}

    (tmp_path / "feedback-1.json").write_text(json.dumps({"feedback": {"i1": entry("one"), "i2": entry("two")}}, indent=1))
    (tmp_path / "feedback-2.json").write_text(json.dumps({"feedback": {"i2": entry("newer")}}))
    (tmp_path / "feedback-3.json").write_text("{not json")
    (tmp_path / "other.json").write_text(json.dumps({"feedback": {"i9": entry("no")}}))
    got = L.load_feedback(spark, str(tmp_path))
    assert rows(got, "issue_key", "original_issue") == [("i1", "one"), ("i2", "newer")]
    assert got.first()["replies"] == ["no"]


def test_custom_documents(spark, tmp_path):
    (tmp_path / "rules.md").write_text("# House Rules\n\nAlways test.\n\nNever\npush to main.")
    docs = L.load_custom_docs(spark, [f"Rules:{tmp_path}/rules.md"])
    chunks = L.custom_chunks(docs, "/work/p", E)
    row = chunks.first()
    assert row["id"] == "house-rules_chunk_0" and row["metadata"]["total_chunks"] == 1 and row["metadata"]["section_start"]
    assert "Never push to main." in row["content"] and len(row["embedding"]) == 32
    q = spark.createDataFrame([(1, "/work/p", "a.js", row["embedding"], "Unknown", [], [])],
                              "query_id int, project_path string, path string, vector array<float>, area string, tech array<string>, keywords array<string>")
    assert find_custom_chunks(q, chunks, embedder=E).first()["id"] == "house-rules_chunk_0"
    with pytest.raises(ValueError):
        L.load_custom_docs(spark, ["no separator"])


def test_landed_history_to_store(spark, tmp_path):
    prs = [
        {"repository": "r", "number": 1, "merged_at": "2024-01-03T00:00:00Z", "updated_at": "2024-01-04T00:00:00Z", "user": {"login": "ann"}, "draft": False},
        {"repository": "r", "number": 2, "merged_at": None, "updated_at": "2024-01-04T00:00:00Z", "user": {"login": "ann"}},
        {"repository": "r", "number": 3, "merged_at": "2024-01-03T00:00:00Z", "updated_at": "2024-01-04T00:00:00Z", "user": {"login": "Dependabot[bot]"}},
        {"repository": "r", "number": 4, "merged_at": "2024-01-03T00:00:00Z", "updated_at": "2024-01-04T00:00:00Z", "user": {"login": "ann"}, "draft": True},
    ]
    comments = [
        {"repository": "r", "pr_number": n, "id": 10 * n + i, "body": b, "user": {"login": u}, "path": "a.py", "line": 2, "created_at": "2024-01-02T00:00:00Z",
         "updated_at": "2024-01-02T00:00:00Z"}
        for n in (1, 2, 3) for i, (b, u) in enumerate([("possible sql injection", "bob"), ("done", "review-bot")])
    ]
    for name, data in (("prs", prs), ("comments", comments), ("files", [{"repository": "r", "pr_number": 1, "filename": "a.py", "patch": "@@ -1 +2 @@\n-x = 1"}])):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in data))
    loaded = L.load_comments(spark, str(tmp_path / "comments.json"))
    stored = Corpus(spark, str(tmp_path / "corpus")).table("pr_comments")
    result = S.sync_history(
        L.load_pull_requests(spark, str(tmp_path / "prs.json")), loaded, loaded.limit(0), L.load_pr_files(spark, str(tmp_path / "files.json")), stored,
        "/work/demo/p", F.lit("2024-01-05T00:00:00Z"), embedder=E)
    row = result["comments"].collect()
    assert [(r["id"], r["issue_category"], r["severity"], r["original_code"], r["diff_hunk"][:4]) for r in row] == [("10", "security", "major", "x = 1", "@@ -")]
    corpus = Corpus(spark, str(tmp_path / "corpus"))
    corpus.write("pr_comments", result["comments"])
    # The same landing again: the pull request is already processed, the table stays as it is.
    again = S.sync_history(
        L.load_pull_requests(spark, str(tmp_path / "prs.json")), loaded, loaded.limit(0), None, corpus.table("pr_comments"), "/work/demo/p",
        F.lit("2024-01-06T00:00:00Z"), embedder=E)
    assert again["processed"].count() == 0 and rows(again["comments"], "id") == [("10",)]
    # Another project has stored nothing of it yet.
    other = S.sync_history(
        L.load_pull_requests(spark, str(tmp_path / "prs.json")), loaded, loaded.limit(0), None, corpus.table("pr_comments"), "/work/demo/q",
        F.lit("2024-01-06T00:00:00Z"), embedder=E)
    assert other["processed"].count() == 1 and rows(other["comments"], "id", "project_path") == [("10", "/work/demo/p"), ("10", "/work/demo/q")]
    assert corpus.clear_repository("r", "/work/demo/p") == 1 and corpus.table("pr_comments").count() == 0


def test_corpus_store(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    assert corpus.table("file_embeddings").count() == 0
    base = spark.createDataFrame([("1", "/w/a/b", "x"), ("2", "/w/c/d", "y")], "id string, project_path string, path string")
    corpus.write("file_embeddings", base)
    corpus.upsert("file_embeddings", spark.createDataFrame([("1", "/w/a/b", "x2"), ("3", "/w/a/b", "z")], base.schema))
    assert rows(corpus.table("file_embeddings"), "id", "path") == [("1", "x2"), ("2", "y"), ("3", "z")]
    assert corpus.table("file_embeddings").columns == SCHEMAS["file_embeddings"].fieldNames()
    assert {r["table"]: r["n"] for r in corpus.stats("/w/a/b").collect()}["file_embeddings"] == 2
    assert corpus.clear_project("/w/a/b")["file_embeddings"] == 2
    assert rows(corpus.table("file_embeddings"), "id") == [("2",)]
    for bad in ("/", "/w/a", "relative/x/y"):
        with pytest.raises(ValueError):
            check_clearable(bad)
    s = spark.createDataFrame([("s", "/w/a/b", '{"k": 1}', "1"), ("s", "/w/a/b", '{"k": 2}', "2")], "id string, project_path string, summary string, last_updated string")
    corpus.store_summary(s)
    assert corpus.get_summary("k INT").first()["summary"]["k"] == 2


def test_project_partition_is_pruned(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    corpus.write("file_embeddings", spark.createDataFrame([("1", "/w/a/b"), ("2", "/w/c/d")], "id string, project_path string"))
    plan = corpus.table("file_embeddings").where("project_path = '/w/a/b'").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(project_path" in plan and "ReadSchema: struct<id:string>" in plan


FILES = "project_path string, path string, content string, last_modified string"


def test_refresh_corpus(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))

    def run(data, mode="full"):
        df = spark.createDataFrame([("/w/p/q", p, c, "2024") for p, c in data], FILES)
        return {r["status"]: r["n"] for r in refresh_corpus(corpus, df, E, mode).collect()}

    first = [("src/a.js", "let a = 1"), ("src/b.py", "b = 2"), ("docs/g.md", "# G\nintro\n## One\ntext"), ("src/empty.js", " "), ("img/x.png", "z")]
    assert run(first) == {"processed": 3, "skipped_empty": 1}
    table = corpus.table("file_embeddings")
    assert rows(table.where("type = 'file'"), "path") == [("docs/g.md",), ("src/a.js",), ("src/b.py",)]
    assert table.where("type = 'directory-structure'").first()["content"].startswith("docs/")
    chunks = corpus.table("document_chunk_embeddings")
    assert rows(chunks, "id", "document_title") == [("docs/g.md#one_3", "G"), ("docs/g.md#section_1", "G")]
    assert run(first) == {"skipped_unchanged": 3, "skipped_empty": 1}
    # A partial run sees one file and drops nothing; a full run prunes what is gone.
    assert run([("src/a.js", "let a = 3")], "partial") == {"processed": 1, "deleted": 2}
    assert corpus.table("file_embeddings").where("type = 'file'").count() == 3
    run([("src/a.js", "let a = 3")])
    assert rows(corpus.table("file_embeddings").where("type = 'file'"), "path", "content") == [("src/a.js", "let a = 3")]
    assert corpus.table("document_chunk_embeddings").count() == 0
    # A project whose files are all refused is emptied by a full run, and only by that.
    run([("img/x.png", "z")], "partial")
    assert corpus.table("file_embeddings").where("type = 'file'").count() == 1
    run([("img/x.png", "z")])
    assert corpus.table("file_embeddings").where("type = 'file'").count() == 0


def test_unified_context(spark):
    from reviewlake.operators.models import embed

    code = [(i, "/w", f"src/f{i}.js", "file", f"function load{i}() react component state cache query {i % 3}") for i in range(12)]
    files = embed(spark.createDataFrame(code, "id int, project_path string, path string, type string, content string"), "content", "vector", E)
    docs = [(i, "/w", f"docs/react-{i % 4}.md", f"React frontend guide {i % 4}", "", f"react component state frontend ui {i}") for i in range(8)]
    chunks = embed(spark.createDataFrame(
        docs, "id int, project_path string, original_document_path string, document_title string, heading_text string, content string"), "content", "vector", E)
    past = [(str(i), "/w", f"react component state cache query {i}", f"src/f{i}.js", 1, "ann", "2024-01-01T00:00:00Z", "logic", "minor") for i in range(6)]
    comments = embed(spark.createDataFrame(
        past, "id string, project_path string, comment_text string, file_path string, pr_number int, author string, created_at string, issue_category string, severity string"),
        "comment_text", "combined_embedding", E)
    prs = spark.createDataFrame([(100, 7, "/w", "src/f0.js", code[0][4]), (101, 7, "/w", "src/new.js", code[1][4])],
                                "query_id int, pr int, project_path string, path string, content string")
    out = unified_context(prs, files, chunks, comments, embedder=E)
    examples = out["code_examples"].collect()
    assert examples and len({r["id"] for r in examples}) == len(examples)
    # The reviewed file is never its own example; the new file may have f0 as one.
    assert not any(r["query_id"] == 100 and r["path"] == "src/f0.js" for r in examples)
    assert out["comments"].count() == 6 and out["guidelines"].count() <= 4
    one = find_similar_code(prs.drop("pr").withColumn("is_test", F.lit(None).cast("boolean")).join(
        embed(prs.select("query_id", "content"), "content", "vector", E).select("query_id", "vector"), "query_id"), files, 3, 0.1, mode="vector")
    assert one.groupBy("query_id").count().where("count > 3").count() == 0


def test_equal_custom_chunks_go_by_id(spark):
    # The second vector is the first but for the last bits of one component.
    chunks = spark.createDataFrame([(2, "/w", "R", "x", [0.6, 0.8 + 1e-12]), (1, "/w", "R", "x", [0.6, 0.8])],
                                   "id int, project_path string, document_title string, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "/w", "a.js", [0.0, 1.0], "Unknown", [], [])],
                              "query_id int, project_path string, path string, vector array<double>, area string, tech array<string>, keywords array<string>")
    got = find_custom_chunks(q, chunks, rerank=False, embedder=E)
    assert rows(got, "rank", "id") == [(1, 1), (2, 2)]


def test_chunked_review_plan(spark):
    big = "\n".join(f"row {i} of a long source file" for i in range(4000))
    diff = "diff --git a b\n" + "\n".join(f"@@ -{i},1 +{i},2 @@\n+changed {i}" for i in range(1, 4000, 40))
    data = [(1, f"src/d{i % 3}/f{i}.py", big, diff, "python") for i in range(34)] + [(2, "a.py", "x = 1", "@@ -1 +1 @@\n+x = 1", "python")]
    df = spark.createDataFrame(data, "pr int, file_path string, content string, diff string, language string")
    decision, plan = V.chunked_review_plan(df, ["pr"], 2000)
    assert rows(decision, "pr", "should_chunk") == [(1, True), (2, False)]
    assert plan.where("pr = 2").first()["chunk_id"] == 1
    hot = plan.where("pr = 1")
    assert hot.select("file_path").distinct().count() == 34
    # A chunk stays within the budget, one oversized part alone excepted.
    sums = hot.groupBy("chunk_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    assert sums.where("t > 2000 AND n > 1").count() == 0


def test_chunked_review_plan_counts_each_row_of_a_path_once(spark):
    data = [(1, "README.md", f"text {i % 3}", f"@@ -1 +1 @@\n+text {i % 3}", "text") for i in range(6)]
    df = spark.createDataFrame(data, "pr int, file_path string, content string, diff string, language string")
    decision, plan = V.chunked_review_plan(df, ["pr"], 2000)
    assert rows(decision, "pr", "n_files", "full_tokens") == [(1, 6, 12)] and plan.count() == 6


def test_report_writers(spark, tmp_path):
    files = spark.createDataFrame(
        [("a.py", True, False, False, None, "fine", "python"), ("b.py", False, False, False, "boom", None, None), ("c.py", True, True, False, None, None, None)],
        "file_path string, success boolean, skipped boolean, partial boolean, error string, summary string, language string")
    issues = spark.createDataFrame([("a.py", "bug", "high", "broken", "mend", [3])],
                                   "file_path string, type string, severity string, description string, suggestion string, line_numbers array<int>")
    write_review_json(files, issues, str(tmp_path / "json"))
    total = spark.read.json(str(tmp_path / "json/summary")).first()
    assert (total["total_files"], total["files_with_issues"], total["total_issues"], total["skipped_files"], total["error_files"]) == (3, 1, 1, 1, 1)
    detail = {r["file_path"]: r for r in spark.read.json(str(tmp_path / "json/details")).collect()}
    assert detail["b.py"]["error"] == "boom" and detail["a.py"]["n_issues"] == 1 and detail["c.py"]["skipped"]
    assert rows(spark.read.json(str(tmp_path / "json/issues")), "file_path", "description") == [("a.py", "broken")]
    write_review_text(files, issues, str(tmp_path / "md"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "md")).collect())
    assert "### a.py" in text and "(Lines: 3)**: broken" in text and "**Error:** boom" in text


def test_load_diffs(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"pr": "1", "file_path": "src/a.test.ts", "diff": "@@ -1 +1 @@\n+export const a = 1", "content": "export const a = 1"}))
    row = L.load_diffs(spark, str(tmp_path / "d.json")).first()
    assert row["is_test"] and row["is_component"] and row["language"] == "typescript" and row["diff_info"]["changed"] == [1]
    assert row["summary"] == "typescript test file: a.test.ts"


def test_stream_comments_is_idempotent(spark, tmp_path):
    schema = ("repository string, pr_number int, project_path string, id string, body string, author string, path string, position int, line int,"
              " diff_hunk string, created_at string, updated_at string, event_time timestamp")
    row = {"repository": "r", "pr_number": 1, "project_path": "/w/p/q", "id": "1", "body": "slow query", "author": "ann", "path": "a.py", "line": 1,
           "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "event_time": "2024-01-01T00:00:00Z"}
    (tmp_path / "in").mkdir()
    corpus = Corpus(spark, str(tmp_path / "c"))

    def store(batch, _):
        corpus.upsert("pr_comments", batch)

    def drain():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        stream_comments(stream, store, str(tmp_path / "ck"), E).awaitTermination()

    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(r) for r in (row, row, {**row, "id": "2", "author": "x-bot"})))
    drain()
    (tmp_path / "in/2.json").write_text("\n".join(json.dumps(r) for r in (row, {**row, "body": "edited, sanitize", "updated_at": "2024-01-02T00:00:00Z"})))
    drain()
    got = corpus.table("pr_comments").collect()
    assert [(r["id"], r["comment_text"], r["issue_category"]) for r in got] == [("1", "edited, sanitize", "security")]


def test_documents_of_one_kind_send_no_more_than_the_limit(spark, monkeypatch):
    sent = []

    def counted(*args, **kwargs):
        out = within(*args, **kwargs)
        sent.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "within", counted)
    data = [(i, "/w", f"docs/g{i}.md", "Guide", "", f"x{i}", [1.0, i / 10]) for i in range(30)]
    chunks = spark.createDataFrame(data, "id int, project_path string, original_document_path string, document_title string, heading_text string, content string, vector array<double>")
    contexts = chunks.select("project_path", F.col("original_document_path").alias("path"), F.lit("Guide").alias("title"), F.lit(False).alias("generic"),
                             F.lit("Backend").alias("doc_area"), F.array(F.lit("x")).alias("doc_tech"), F.lit(False).alias("readme_style"))
    q = spark.createDataFrame([(1, "/w", "docs/q.js", "x", [1.0, 0.0], "Backend", ["x"])],
                              "query_id int, project_path string, path string, text string, vector array<double>, area string, tech array<string>")
    got = retrieval.find_relevant_docs(q, chunks, contexts, 4, 0.05, embedder=E)
    assert rows(got, "rank", "id") == [(1, 0), (2, 1), (3, 2), (4, 3)] and sent == [4]


def test_refresh_files_keeps_each_version_of_a_path(spark):
    now = spark.createDataFrame([("/w/p", "R.md", t, "1") for t in ("one", "two", " ")], FILES)
    fresh, _ = refresh_files(now, Corpus(spark, "/nowhere").table("file_embeddings"), E)
    assert rows(fresh, "path", "content") == [("R.md", "one"), ("R.md", "two")]
    stored = fresh.where("content = 'one'").unionByName(fresh.where("content = 'one'").withColumn("id", F.lit("R.md#old")).withColumn("content_hash", F.lit("old")))
    table, status = refresh_files(now, stored, E)
    assert rows(table, "path", "content", "id") == rows(fresh, "path", "content", "id")
    assert rows(status, "status") == [("processed",), ("skipped_empty",), ("skipped_unchanged",)]


def test_stream_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    corpus = Corpus(spark, str(tmp_path / "c"))

    def put(n, *files):
        (tmp_path / f"in/{n}.json").write_text("\n".join(
            json.dumps({"project_path": "/w/p/q", "path": p, "content": c, "last_modified": str(n)}) for p, c in files))
        stream = spark.readStream.schema(FILES).json(str(tmp_path / "in"))
        stream_documents(stream, corpus, str(tmp_path / "ck"), E).awaitTermination()

    put(1, ("a.js", "one"), ("g.md", "# T\n## S\nx"))
    put(2, ("a.js", "two"), ("b.js", "three"))
    assert rows(corpus.table("file_embeddings").where("type = 'file'"), "path", "content") == [
        ("a.js", "two"), ("b.js", "three"), ("g.md", "# T\n## S\nx")]
    assert corpus.table("document_chunk_embeddings").count() == 2


def test_stream_documents_stores_equally_new_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(
        json.dumps({"project_path": "/w/p/q", "path": "a.js", "content": c, "last_modified": m}) for c, m in (("one", "2"), ("two", "2"), ("old", "1"))))
    corpus = Corpus(spark, str(tmp_path / "c"))
    stream_documents(spark.readStream.schema(FILES).json(str(tmp_path / "in")), corpus, str(tmp_path / "ck"), E).awaitTermination()
    assert rows(corpus.table("file_embeddings"), "content") == [("one",), ("two",)]


def test_a_table_streams_from_a_file_and_from_a_folder(spark, tmp_path):
    import shutil

    spark.range(7).repartition(3).write.parquet(str(tmp_path / "folder/t.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    shutil.copy(next((tmp_path / "one").glob("*.parquet")), tmp_path / "file/t.parquet")
    for kind in ("folder", "file"):
        out = str(tmp_path / f"out-{kind}")
        Tables(spark, str(tmp_path / kind)).stream("t").writeStream.option("checkpointLocation", str(tmp_path / f"ck-{kind}")).trigger(
            availableNow=True).format("parquet").start(out).awaitTermination()
        assert rows(spark.read.parquet(out), "id") == [(i,) for i in range(7)]


def test_a_job_may_start_from_any_folder(tmp_path):
    """The workers get the package from the session, not from the folder the driver runs in."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys\nsys.path.append({root!r})\nfrom reviewlake.session import build_session\n"
        "spark = build_session('local[1]', 1, **{'spark.ui.enabled': 'false'})\n"
        "from reviewlake.operators.models import HashedWords, embed\n"
        "print('rows', embed(spark.createDataFrame([('a b',)], 't string'), 't', 'v', HashedWords(8)).where('v is not null').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("first", [1, 20])
def test_comments_are_looked_through_from_the_nearest(spark, monkeypatch, first):
    code = ["alpha beta gamma delta", "beta gamma epsilon", "alpha zeta"]
    said = ["alpha", "beta missing", "gamma delta test", "unrelated words", "alpha beta", "zeta spec gamma", "delta", "epsilon alpha", "beta beta test"]
    files = spark.createDataFrame([(i, "/p", t, i == 1) for i, t in enumerate(code)], "query_id int, project_path string, content string, is_test boolean")
    notes = [(f"c{i}", "/p", t, "a.test.js" if i == 4 else None) for i, t in enumerate(said)]
    notes = spark.createDataFrame(notes, "id string, project_path string, comment_text string, file_path string")
    notes = retrieval.embed(notes, "comment_text", "combined_embedding", E)
    vectors = {t: E([t])[0] for t in code + said}
    want = set()
    for i, c in enumerate(code):
        near = []
        for j, t in enumerate(said):
            fits = i != 1 or "test" in t or "spec" in t or j == 4
            d = round(float(((vectors[c].astype("float32").astype(float) - vectors[t].astype("float32").astype(float)) ** 2).sum()), 9)
            if fits and d <= 1.9 and any(len(w) > 2 and w in c for w in t.split()):
                near.append((d, f"c{j}"))
        want |= {(i, c_id, rank) for rank, (_, c_id) in enumerate(sorted(near)[:2], 1)}
    monkeypatch.setattr(retrieval, "FIRST_NEAREST", first)
    if first > 1:
        # The nearest suffice: nothing is left open for a radius join of all pairs.
        monkeypatch.setattr(retrieval, "within", None)
    got = retrieval.find_relevant_comments(files, notes, 2, max_distance=1.9, embedder=E)
    assert {tuple(r) for r in got.select("query_id", "id", "rank").collect()} == want


def _custom_case(spark, n_queries, n_chunks, dim=6):
    import numpy as np

    rng = np.random.default_rng(5)
    words = ["react", "api", "generalpython", "flask", "plain"]
    chunks = [(i, "/w", f"R{i % 2}", " ".join(rng.choice(words, 2)) + "x" * (2100 * (i % 3 == 0)), [float(x) for x in rng.integers(0, 3, dim)])
              for i in rng.permutation(n_chunks).tolist()]
    areas = [("Frontend", ["React"]), ("GeneralPython", ["Flask"]), ("Unknown", [])]
    asked = [(i, "/w", "a/b.js", [float(x) for x in rng.integers(0, 3, dim)], *areas[i % 3], ["api", "flask", "react"][:i % 4]) for i in range(n_queries)]
    return (spark.createDataFrame(asked, "query_id int, project_path string, path string, vector array<double>, area string, tech array<string>, keywords array<string>"),
            spark.createDataFrame(chunks, "id int, project_path string, document_title string, content string, embedding array<double>"))


@pytest.mark.parametrize("size", ["corpus small", "queries small", "blocks"])
@pytest.mark.parametrize("rerank", [True, False])
def test_custom_chunks_match_brute_force(spark, monkeypatch, size, rerank):
    from reviewlake.functions import context as X
    from reviewlake.functions import paths as P
    from reviewlake.functions import vectors as V
    from reviewlake.operators import knn

    q, chunks = _custom_case(spark, 40, 90)
    if size != "corpus small":
        monkeypatch.setattr(knn, "BROADCAST_FLOATS", 300 if size == "queries small" else 10)
    got = find_custom_chunks(q, chunks, 4, 0.3, rerank=rerank, embedder=HashedWords(6))
    # Every pair is scored whole.
    titles = retrieval.title_vectors(chunks, "document_title", HashedWords(6)).withColumnRenamed("title", "document_title")
    pairs = q.drop("project_path").crossJoin(chunks.drop("project_path")).join(titles, "document_title").withColumn(
        "s", V.cosine_similarity("vector", "embedding")).where("s >= 0.3")
    pairs = pairs.join(pairs.groupBy("query_id").count(), "query_id")
    score = X.rerank_custom_score(F.col("s"), F.col("content"), F.col("area"), F.col("tech"), F.col("keywords"),
                                  V.cosine_similarity("vector", "title_vector"), P.path_similarity("path", "document_title"))
    pairs = pairs.withColumn("s", F.round(F.when(F.lit(rerank) & (F.col("count") >= 2), score).otherwise(F.col("s")), 9)).select("query_id", "id", "s").collect()
    want = []
    for i in range(40):
        mine = sorted((-r["s"], r["id"]) for r in pairs if r["query_id"] == i)[:4]
        want += [(i, n + 1, id_, round(-s, 6)) for n, (s, id_) in enumerate(mine)]
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 6)) for r in got.collect()) == want


def test_custom_chunks_take_the_smallest_ids_of_clamped_scores(spark):
    # Both terms lift every chunk beyond 1 or push it below 0: only the id decides, and the nearest chunks have the largest ones.
    content = {"Frontend": "frontend react", "Backend": "x" * 3000}
    for area, text in content.items():
        title = "b/R" if area == "Frontend" else ""
        chunks = spark.createDataFrame([(i, "/w", title, text, [1.0, (60 - i) / (30 if title else 300)]) for i in range(60)],
                                       "id int, project_path string, document_title string, content string, embedding array<double>")
        vector = [1.0, 0.0] if title else [1.0, -2.0]
        q = spark.createDataFrame([(1, "/w", "b/b.js", vector, area, ["React"], ["react"])],
                                  "query_id int, project_path string, path string, vector array<double>, area string, tech array<string>, keywords array<string>")
        got = find_custom_chunks(q, chunks, 3, 0.3, embedder=E)
        every = find_custom_chunks(q, chunks, 60, 0.3, embedder=E)
        assert rows(got, "rank", "id", "similarity") == rows(every, "rank", "id", "similarity")[:3]
        assert [r[2] for r in rows(got, "rank", "id", "similarity")] == [1.0 if title else 0.0] * 3


def test_custom_chunks_ask_for_each_vector_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def vector(v):
        seen.add(len(v))
        return v

    q, chunks = _custom_case(spark, 30, 20)
    find_custom_chunks(q.withColumn("vector", vector("vector")), chunks, embedder=HashedWords(6)).collect()
    assert seen.value == 30


def test_only_chunks_that_can_win_leave_a_search_by_cosine(spark):
    from reviewlake.operators.knn import similar

    q, chunks = _custom_case(spark, 40, 2000)
    pairs = lambda **kw: similar(q, chunks, 0.3, 3, vector_col="embedding", tenant="project_path", **kw)
    assert pairs(itself=False).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 40


@pytest.mark.parametrize("plan", ["broadcast", "blocks"])
def test_knn_leaves_out_rows_with_the_own_value(spark, plan):
    import numpy as np

    from reviewlake.operators.knn import knn

    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.integers(0, 3, 4)], None if i % 11 == 0 else f"p{i % 4 if i < 200 else 0}") for i in range(300)]
    df = spark.createDataFrame(data, "id int, vector array<double>, at string")
    got = knn(df.withColumnRenamed("id", "query_id"), df, 5, avoid="at", plan=plan, block_rows=40, query_block_rows=64)
    want = []
    for i, v, at in data:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 9), j) for j, w, other in data if at is None or other != at)[:5]
        want += [(i, n, j) for n, (_, j) in enumerate(near, 1)]
    assert rows(got, "query_id", "rank", "id") == sorted(want)


def test_rows_with_the_reviewed_path_are_not_asked_for(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(retrieval, "knn", lambda q, c, k, **kw: asked.append(k) or __import__("reviewlake.operators.knn", fromlist=["knn"]).knn(q, c, k, **kw))
    files = spark.createDataFrame([(i, "/w", "a.js" if i < 30 else f"f{i}.js", "file", "x", [1.0, i / 100]) for i in range(40)],
                                  "id int, project_path string, path string, type string, content string, vector array<double>")
    q = spark.createDataFrame([(1, "/w", "a.js", "x", [1.0, 0.0], False), (2, "/w", "/w/b.js", "x", [1.0, 0.0], False)],
                              "query_id int, project_path string, path string, content string, vector array<double>, is_test boolean")
    got = find_similar_code(q, files, 3, 0.1, mode="vector")
    assert rows(got, "query_id", "id") == [(1, 30), (1, 31), (1, 32), (2, 0), (2, 1), (2, 2)]
    assert asked == [3]


@pytest.mark.parametrize("floats", [8_000_000, 900, 10])
def test_docs_ranked_inside_blocks_match_whole_candidates(spark, monkeypatch, floats):
    import numpy as np

    from reviewlake.operators import knn

    rng = np.random.default_rng(7)
    unit = lambda: [float(x) for x in (lambda v: v / np.linalg.norm(v))(rng.normal(size=4) + 1)]
    chunks = [(i, "/w", f"docs/{'abc'[i % 3]}/g{i // 4}.md", f"Guide {'api' if i % 3 else 'x'}", "", f"text {i}", unit()) for i in range(400)]
    chunks += [(1000 + i, *chunks[i][1:]) for i in range(40)]
    chunks = spark.createDataFrame(chunks, "id int, project_path string, original_document_path string, document_title string, heading_text string, "
                                           "content string, vector array<double>")
    q = spark.createDataFrame([(i, "/w", f"docs/{'ab'[i % 2]}/q.js", "x", unit(), ["Backend", "Frontend", "Unknown"][i % 3], ["Node.js"]) for i in range(60)],
                              "query_id int, project_path string, path string, text string, vector array<double>, area string, tech array<string>")
    contexts = chunks.select("project_path", F.col("original_document_path").alias("path"), F.col("document_title").alias("title")).distinct().select(
        "project_path", "path", "title", F.lit(False).alias("generic"), F.when(F.col("path").contains("/a/"), "Backend").otherwise("Unknown").alias("doc_area"),
        F.array(F.lit("node.js")).alias("doc_tech"), F.col("path").contains("/b/").alias("readme_style"))
    find = lambda: retrieval.find_relevant_docs(q, chunks, contexts, 6, 0.3, mode="vector", embedder=HashedWords(4))
    with monkeypatch.context() as m:
        m.setattr(retrieval, "_doc_lifts", lambda *a: None)
        want = [(r[0], r[1], r[2], round(r[3], 9)) for r in rows(find(), "query_id", "rank", "id", "similarity")]
    monkeypatch.setattr(knn, "BROADCAST_FLOATS", floats)
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in rows(find(), "query_id", "rank", "id", "similarity")] == want
    left = []
    monkeypatch.setattr(retrieval, "within", lambda *a, **kw: left.append(knn.within(*a, **kw)) or left[0])
    find()
    assert left[0].groupBy("query_id").count().agg(F.max("count")).first()[0] == 6


def test_comments_with_a_late_keyword_are_found(spark):
    files = spark.createDataFrame([(1, "/p", "rather extraordinarily long", False)], "query_id int, project_path string, content string, is_test boolean")
    notes = spark.createDataFrame([("c1", "/p", "aaa bbb ccc ddd eee fff extraordinarily", None), ("c2", "/p", "aaa bbb ccc ddd eee fff ordinary", None)],
                                  "id string, project_path string, comment_text string, file_path string")
    notes = retrieval.embed(notes, "comment_text", "combined_embedding", E)
    got = retrieval.find_relevant_comments(files, notes, 2, max_distance=4.0, embedder=E)
    assert rows(got, "id", "comment_text") == [("c1", "aaa bbb ccc ddd eee fff extraordinarily")]
