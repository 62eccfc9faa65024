import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import corpus as R
from reviewlake.operators import findings as N
from reviewlake.operators import history as H
from reviewlake.operators import planning as G
from reviewlake.operators.knn import cell_plan, knn, knn_clustered
from reviewlake.operators.findings import format_context_items
from reviewlake.operators.keyfiles import validate_key_files
from reviewlake.operators.models import HashedWords, classifier_udf, complete, embed, verify_relevance
from reviewlake.operators.search import bm25, build_text_index, rrf
from reviewlake.operators.similarity import best_word_matches, candidate_sets, filter_dismissed
from reviewlake.operators.text_terms import dictionary_match, pattern_candidates
from reviewlake.operators.topk import top_k


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


# --- search ----------------------------------------------------------------------------------------


def vectors(spark, n, dim=8, seed=0, tenants=2):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim))
    data[n // 2: n // 2 + 5] = data[0]  # copies: the id must decide
    # One tenant holds most rows.
    names = ["big" if i % 4 else f"small{i % tenants}" for i in range(n)]
    return [(i, t, v.tolist()) for i, (t, v) in enumerate(zip(names, data))]


def brute(data, k):
    out = set()
    for qi, qt, qv in data:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(qv, v)), 9), i) for i, t, v in data if t == qt)[:k]
        out |= {(qi, i, rank) for rank, (_, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("plan,block", [("broadcast", 8192), ("blocks", 8192), ("blocks", 16)])
def test_knn_is_exact(spark, plan, block):
    data = vectors(spark, 160)
    df = spark.createDataFrame(data, "id int, tenant string, vector array<double>")
    got = knn(df, df, 4, query_id="id", tenant="tenant", plan=plan, block_rows=block, query_block_rows=50)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == brute(data, 4)


def test_knn_over_several_tiles(spark, monkeypatch):
    from reviewlake.operators import knn as N

    data = vectors(spark, 160)
    df = spark.createDataFrame(data, "id int, tenant string, vector array<float>")
    want = brute([(r["id"], r["tenant"], r["vector"]) for r in df.collect()], 4)
    monkeypatch.setattr(N, "TILE_FLOATS", 1)
    monkeypatch.setattr(N, "MIN_SLICE_ROWS", 8)
    got = knn(df, df, 4, query_id="id", tenant="tenant", plan="blocks", block_rows=40, query_block_rows=20)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want


def test_small_cells_share_tiles():
    from reviewlake.operators.knn import _tiled

    rng = np.random.default_rng(5)
    pivots, sizes = rng.normal(size=(200, 8)), rng.integers(0, 60, 200)
    sizes[7] = 900
    tiles = _tiled(pivots, sizes, 500)
    held = np.bincount(tiles, sizes)
    assert held[tiles[7]] == 900 and np.delete(held, tiles[7]).max() <= 500
    # Far fewer tiles than cells: a query travels once for each.
    assert len(held) <= 2 * (sizes.sum() // 500) + 2


def test_knn_orders_copies_by_id(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    want = brute([(i, "", v) for i, v in rows], 5)
    for plan in ("broadcast", "blocks"):
        got = knn(df, df, 5, query_id="id", plan=plan, block_rows=16, query_block_rows=16)
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want


def test_knn_more_than_there_are(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id int, vector array<double>")
    for plan in ("broadcast", "blocks"):
        assert knn(df, df, 10, query_id="id", plan=plan).count() == 9


def test_clustered_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    data = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(300)]
    df = spark.createDataFrame(data, "id int, vector array<double>")
    exact = {(r["query_id"], r["id"]) for r in knn(df, df, 5, query_id="id").collect()}
    near = {(r["query_id"], r["id"]) for r in knn_clustered(df, df, 5, n_probe=3, query_id="id", n_cells=6).collect()}
    assert len(exact & near) / len(exact) > 0.9


def test_cell_plan():
    assert cell_plan(999)[0] == "exact" and cell_plan(5000) == ("cells", 10) and cell_plan(1_000_000) == ("cells", 100)
    assert cell_plan(1000) == ("cells", 4) and cell_plan(10_000) == ("cells", 10)


def brute_bm25(docs, query, k, allowed=lambda i: True):
    toks = {i: t.lower().split() for i, t in docs}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    scores = {}
    for w in set(query.lower().split()):
        df = sum(w in t for t in toks.values())
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for i, t in toks.items():
            tf = t.count(w)
            if tf and allowed(i):
                scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return [(i, s) for i, s in sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("direct", [0, 1 << 30])
def test_bm25_matches_brute_force_with_hot_words(spark, monkeypatch, direct):
    monkeypatch.setattr("reviewlake.operators.search.DIRECT_POSTINGS", direct)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    # "the" and "of" are in every document and in every query.
    docs = [(i, "the of " + " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(120)]
    queries = [(i, "the of " + " ".join(rng.sample(vocab, 4))) for i in range(12)] + [(99, "the of")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame(queries, "query_id int, text string")
    got = {}
    for r in bm25(q, build_text_index(d, shards=3), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], pytest.approx(r["score"], abs=1e-6)))
    for qid, text in queries:
        assert got[qid] == brute_bm25(docs, text, 5)


@pytest.mark.parametrize("direct", [0, 1 << 30])
def test_bm25_groups_and_exclusions(spark, monkeypatch, direct):
    monkeypatch.setattr("reviewlake.operators.search.DIRECT_POSTINGS", direct)
    docs = [(i, "alpha beta" if i % 2 else "alpha", "g1" if i < 6 else "g2") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id int, text string, grp string")
    q = spark.createDataFrame([(1, "alpha beta", ["g1"]), (2, "alpha", ["g1", "g2"])], "query_id int, text string, groups array<string>")
    out = spark.createDataFrame([(1, 1), (2, 0)], "query_id int, doc_id int")
    got = bm25(q, build_text_index(d, group="grp", shards=2), 20, groups="groups", exclude=out)
    assert rows(got.where("query_id = 1"), "doc_id") == [(0,), (2,), (3,), (4,), (5,)]
    assert rows(got.where("query_id = 2"), "doc_id") == [(i,) for i in range(1, 12)]


def test_rrf_is_a_permutation(spark):
    a = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, i, 6 - i) for i in range(1, 6)], "query_id int, doc_id int, rank int")
    got = rrf([a, b], 10).orderBy("rank").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5]
    assert got[0]["score"] == pytest.approx(max(1 / (60 + r) + 1 / (66 - r) for r in range(1, 6)))


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).withColumn("key", F.when(F.col("id") < 4900, 0).otherwise(1))
    got = top_k(df, ["key"], [F.col("id").desc()], 1500)
    assert got.where("key = 0").agg(F.min("id"), F.count("*")).first() == (3400, 1500)
    assert got.where("key = 1").count() == 100


# --- similarity join -------------------------------------------------------------------------------


def test_best_word_matches_is_exact(spark):
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(25)]
    left = [(i, " ".join(rng.sample(vocab, rng.randint(2, 7)))) for i in range(80)]
    left += [(1000 + i, left[0][1]) for i in range(40)]  # a block of copies
    right = [(i, " ".join(rng.sample(vocab, rng.randint(2, 7)))) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, text string"), spark.createDataFrame(right, "id int, text string")
    for threshold in (0.3, 0.6):
        want = {}
        for i, x in left:
            sims = []
            for j, y in right:
                s, t = set(x.split()), set(y.split())
                sims.append((-len(s & t) / len(s | t), j))
            best = min(sims)
            if -best[0] > threshold:
                want[i] = (best[1], -best[0])
        got = {r["id"]: (r["match_id"], pytest.approx(r["similarity"])) for r in best_word_matches(a, b, threshold).collect()}
        assert got.keys() == want.keys() and all(got[i] == want[i] for i in want)


@pytest.mark.parametrize("block", [2_000, 3])
def test_best_word_matches_with_a_word_in_every_row(spark, block):
    """One word stands in all rows of the left and many of the right; long sets fill the bitmaps, short ones barely use them."""
    rng = random.Random(11)
    vocab = [f"term{i}" for i in range(900)]
    texts = [" ".join(["common", *rng.sample(vocab, rng.choice((1, 3, 8, 40, 600)))]) for _ in range(70)]
    near = [" ".join(w for w in t.split() if rng.random() > 0.3) for t in texts[:25]]
    left, right = list(enumerate(texts)), list(enumerate(near + texts[40:45] + [" ".join(rng.sample(vocab, 5)) for _ in range(20)] + ["", "a b"]))
    a, b = spark.createDataFrame(left, "id int, text string"), spark.createDataFrame(right, "id int, text string")
    jaccard = {(i, j): len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split())) for i, x in left for j, y in right if len(y) > 3}
    for threshold in (0.3, 0.5, 0.7):
        want = {}
        for (i, j), s in sorted(jaccard.items()):
            if s > threshold and s > want.get(i, (0, 0))[1]:
                want[i] = (j, s)
        got = {r["id"]: (r["match_id"], pytest.approx(r["similarity"])) for r in best_word_matches(a, b, threshold, block=block).collect()}
        assert got.keys() == want.keys() and all(got[i] == want[i] for i in want)


def test_candidate_sets_are_few(spark):
    rng = random.Random(3)
    vocab = [f"term{i}" for i in range(300)]
    side = [[(str(i), ["common", *rng.sample(vocab, 20)]) for i in range(200)] for _ in range(2)]
    side[1][:20] = [(str(i), words[:18] + ["new"]) for i, (_, words) in enumerate(side[0][:20])]
    left, right = (spark.createDataFrame(s, "set_id string, words array<string>") for s in side)
    found = {(r["l"], r["r"]) for r in candidate_sets(left, right, 0.3).collect()}
    want = {(i, j) for i, x in side[0] for j, y in side[1] if len(set(x) & set(y)) / len(set(x) | set(y)) > 0.3}
    assert len(want) >= 20 and want <= found and len(found) <= 10 * len(want)


def test_filter_dismissed_semantic(spark):
    issues = spark.createDataFrame([("a", "unused variable in loop"), ("b", "missing null check")], "id string, text string")
    gone = spark.createDataFrame([("d", "unused variable in loop")], "id string, text string")
    kept, matches = filter_dismissed(issues, gone, 0.9, HashedWords(64))
    assert rows(kept, "id") == [("b",)]
    assert matches.first()["similarity"] == pytest.approx(1.0, abs=1e-6)


def test_filter_dismissed_compares_unit_vectors_as_stored(spark):
    class Stored(HashedWords):
        def __call__(self, texts):
            return np.array([[1.0, 0.0] if t == "a" else [0.4000001, 0.9165151] for t in texts])

    a = spark.createDataFrame([("i", "a")], "id string, text string")
    d = spark.createDataFrame([("d", "b")], "id string, text string")
    w = np.array([0.4000001, 0.9165151], dtype=np.float32).astype(float)
    _, matches = filter_dismissed(a, d, 0.5, Stored(2))
    assert matches.first()["similarity"] == pytest.approx(1 - (((1 - w[0]) ** 2 + w[1] ** 2) / 4), abs=2e-10)


# --- models ----------------------------------------------------------------------------------------


def test_format_context_items_keeps_whole_contents(spark):
    long = "\n".join(str(i) for i in range(900))
    items = spark.createDataFrame([("p", 1, "a.py", 0.5, "python", long)], "p string, rank int, path string, similarity double, language string, content string")
    assert format_context_items(items, ["p"]).first()["content"] == long
    assert format_context_items(items, ["p"], max_lines=2).first()["content"] == "0\n1\n... (truncated, 898 more lines)"


def test_embed(spark):
    df = spark.createDataFrame([(1, "Hello hello world"), (2, "  "), (3, None), (4, "hello HELLO world!"), (5, "...")], "id int, text string")
    for first in (False, True):
        got = {r["id"]: r["vector"] for r in embed(df, "text", embedder=HashedWords(16), distinct_first=first).collect()}
        assert got[2] is None and got[3] is None and got[5] is None
        assert got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6)


def test_embedder_dimension_is_checked(spark):
    class Wrong(HashedWords):
        def __call__(self, texts):
            return super().__call__(texts)[:, :3]

    with pytest.raises(Exception, match="expected dimension"):
        embed(spark.createDataFrame([("x",)], "text string"), "text", embedder=Wrong(8)).collect()


def test_verify_relevance_fails_open(spark):
    df = spark.createDataFrame([("good", "c"), ("bad", "c")], "comment string, code string")
    kept = verify_relevance(df, "comment", "code", lambda texts: [0.9 if "good" in t else 0.1 for t in texts])
    assert rows(kept, "comment") == [("good",)]

    def broken(texts):
        raise RuntimeError("no model")

    assert verify_relevance(df, "comment", "code", broken).count() == 2
    assert verify_relevance(df, "comment", "code").count() == 2


def test_classifier_and_completer(spark):
    df = spark.createDataFrame([("x",)], "text string")
    run = classifier_udf(lambda texts, labels: np.tile([0.2, 0.9, 0.5], (len(texts), 1)), ["a", "b", "c"])
    got = df.select(run("text").alias("d")).first()["d"]
    assert [(d["domain"], d["confidence"]) for d in got] == [("b", 0.9), ("c", 0.5)]

    def client():
        return lambda batch: batch.assign(answer=batch["text"].str.upper())

    assert complete(df, client, "text string, answer string").first()["answer"] == "X"


# --- terms -----------------------------------------------------------------------------------------


def test_dictionary_match(spark):
    docs = spark.createDataFrame([(1, "We use Next.js, React and spring-boot here"), (2, "reactive next js")], "doc_id int, text string")
    terms = spark.createDataFrame([("next.js",), ("React",), ("spring-boot",), ("angular",)], "term string")
    assert rows(dictionary_match(docs, terms, "doc_id", "text"), "doc_id", "term") == [(1, "next.js"), (1, "react"), (1, "spring-boot")]


def test_automaton_and_join_find_the_same_terms(spark, monkeypatch):
    from reviewlake.operators import text_terms

    rng = random.Random(5)
    signs = ["c", "net", "a", "b", "é", "_", "1", "+", "+", ".", "#", " ", " ", "-", "\n", "Ä"]
    make = lambda n: "".join(rng.choice(signs) for _ in range(rng.randrange(1, n)))
    docs = spark.createDataFrame([(i, make(60)) for i in range(150)] + [(200, None), (201, ""), (202, "C++, .NET and c+++ x.net")], "doc_id int, text string")
    terms = spark.createDataFrame([(make(5),) for _ in range(120)] + [("C++",), (".net",), ("net",), ("+",), (None,), ("",)], "term string")
    found = rows(dictionary_match(docs, terms, "doc_id", "text"), "doc_id", "term")
    assert {t for i, t in found if i == 202} >= {"c++", ".net", "net"} and len(found) > 300
    monkeypatch.setattr(text_terms, "AUTOMATON_TERMS", 0)
    assert sorted(set(rows(dictionary_match(docs, terms, "doc_id", "text"), "doc_id", "term"))) == sorted(set(found))


def test_technology_scores(value):
    from reviewlake.operators.models import mentioned_technologies, technology_scores

    text = F.lit("Use Node.js with FastAPI. Node.js and node.js. The C++ (x) way.")
    got = value(technology_scores(text, F.array(F.lit("FastAPI"), F.lit("Node.js"), F.lit("Vue"), F.lit("(x)"))))
    assert [(r["technology"], round(r["confidence"], 2)) for r in got] == [("Node.js", 0.75), ("FastAPI", 0.5), ("(x)", 0.5)]
    assert {r["technology"] for r in value(mentioned_technologies(text))} >= {"Node.js", "FastAPI"}
    assert value(mentioned_technologies(F.lit(None).cast("string"))) in (None, [])


def test_pattern_candidates(value):
    got = value(pattern_candidates(F.lit("Use Node.js with FastAPI. The AWS CLI and scikit-learn run."), ["the", "with", "and", "use"]))
    assert {"Node.js", "FastAPI", "AWS", "CLI", "scikit-learn"} <= set(got) and "The" not in got


# --- corpus ----------------------------------------------------------------------------------------

P = "project_path string, path string, content_hash string"


def test_diff_inventory(spark):
    now = spark.createDataFrame([("p", "a", "1", False), ("p", "b", "2", False), ("p", "c", "3", False), ("p", "d", "4", True)], P + ", is_empty boolean")
    old = spark.createDataFrame([("p", "b", "2"), ("p", "b", "0"), ("p", "c", "0"), ("p", "e", "5")], P)
    assert rows(R.diff_inventory(now, old), "path", "status") == [
        ("a", "new"), ("b", "unchanged"), ("c", "changed"), ("d", "skipped_empty"), ("e", "deleted")]


def test_diff_inventory_compares_each_version_of_a_path(spark):
    now = spark.createDataFrame([("p", "a", "1"), ("p", "a", "2"), ("p", "a", "2")], P)
    old = spark.createDataFrame([("p", "a", "1"), ("p", "a", "0")], P)
    assert rows(R.diff_inventory(now, old), "content_hash", "status") == [("1", "unchanged"), ("2", "changed"), ("2", "changed")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("1", "p", "a"), ("2", "p", "b"), ("1", "q", "z")], "id string, project_path string, v string")
    new = spark.createDataFrame([("1", "p", "A"), ("3", "p", "c"), ("1", "p", "AA")], "id string, project_path string, v string")
    once = R.upsert(old, new, order=[F.col("v").desc()])
    assert rows(once, "id", "project_path", "v") == [("1", "p", "AA"), ("1", "q", "z"), ("2", "p", "b"), ("3", "p", "c")]
    assert rows(R.upsert(once, new, order=[F.col("v").desc()]), "id", "v") == rows(once, "id", "v")


def test_validate_key_files_counts_a_path_once(spark):
    keys = spark.createDataFrame([("p", "a"), ("p", "b")], "project_path string, path string")
    live = spark.createDataFrame([("p", "a")] * 3, "project_path string, path string")
    assert rows(validate_key_files(keys, live), "path", "rediscover") == [("a", True)]


def test_prune_is_a_fixpoint(spark):
    old = spark.createDataFrame([("p", "a", "file"), ("p", "b", "file"), ("p", "s", "directory-structure"), ("p", None, "file")],
                                "project_path string, path string, type string")
    live = spark.createDataFrame([("p", "a")], "project_path string, path string")
    once = R.prune_files(old, live)
    assert once.count() == 3 and R.prune_files(once, live).count() == 3


def test_inventory_hash(spark):
    a = spark.createDataFrame([("p", "a", "1", "file"), ("p", "b", "2", None)], P + ", type string")
    b = spark.createDataFrame([("p", "b", "2", "file"), ("p", "a", "1", "")], P + ", type string")
    c = a.unionByName(a.limit(1))
    hashes = [R.inventory_hash(x, ["project_path"]).first()["fingerprint"] for x in (a, b, c)]
    assert hashes[0] == hashes[1] != hashes[2]


def test_directory_tree(spark):
    df = spark.createDataFrame([("p", "src/b/x.py"), ("p", "README.md"), ("p", "src/a.py"), ("p", "a/b/c/d/e/f/g.txt")], "project_path string, path string")
    lines = [r["line"] for r in R.directory_tree(df, ["project_path"]).orderBy("sort_key").collect()]
    assert lines[:4] == ["a/", "    b/", "        c/", "            d/"]
    assert lines[-5:] == ["src/", "    b/", "        x.py", "    a.py", "README.md"] and not any("g.txt" in x for x in lines)


def test_content_by_path_prefers_text(spark):
    df = spark.createDataFrame([("p", "a", " "), ("p", "a", "body"), ("p", "b", "")], "project_path string, path string, content string")
    assert rows(R.content_by_path(df), "path", "content") == [("a", "body"), ("b", "")]


# --- history ---------------------------------------------------------------------------------------


def test_skip_rules(spark):
    prs = spark.createDataFrame(
        [("r", n, u) for n, u in ((1, "2024-01-02T00:00:00Z"), (2, "2024-01-09T00:00:00Z"), (3, "bad"), (4, "2024-01-01T00:00:00Z"), (5, "2024-01-01T00:00:00Z"))],
        "repository string, pr_number long, updated_at string").withColumn("merged_at", F.lit(None).cast("string")).withColumn("created_at", F.lit(None).cast("string"))
    stored = spark.createDataFrame(
        [("r", 1, "2024-01-02T00:00:00Z"), ("r", 2, "2024-01-02T00:00:00Z"), ("r", 3, "2024-01-02T00:00:00Z"), ("r", 4, None)],
        "repository string, pr_number long, pr_updated_at string").withColumn("created_at", F.lit("2024-01-01T00:00:00Z")).withColumn("updated_at", F.lit(None).cast("string"))
    assert rows(H.skip_processed(prs, H.pr_sync_state(stored)), "pr_number", "skip") == [(1, True), (2, False), (3, False), (4, True), (5, False)]


def test_stale_comments(spark):
    stored = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "c"), ("r", 3, "d"), ("r", 4, "e")], "repository string, pr_number int, id string")
    scope = stored.where("pr_number <> 4")
    live = spark.createDataFrame([("r", 1, "a")], "repository string, pr_number int, id string")
    failed = stored.where("pr_number = 3")
    assert rows(H.stale_comments(stored, scope, live, failed), "id") == [("b",), ("c",)]


def test_comment_totals_without_dates(spark):
    df = spark.createDataFrame([(0, None, None), (1, "", "junk")], "pr_number int, author string, created_at string")
    got = H.comment_totals(df).first()
    assert (got["total_comments"], got["total_prs"], got["unique_authors"], got["earliest"], got["latest"]) == (2, 1, 1, "N/A", "N/A")


# --- planning --------------------------------------------------------------------------------------


def brute_pack(sizes, budget):
    ids, chunk, held = [], 1, None
    for s in sizes:
        if held is not None and held + s > budget:
            chunk, held = chunk + 1, 0
        held = (held or 0) + s
        ids.append(chunk)
    return ids


@pytest.mark.parametrize("segment_rows", [7, 10_000])
def test_pack_files_matches_sequential(spark, segment_rows):
    rng = random.Random(11)
    data = [("hot", i, rng.choice([0, 1, 5, 20, 60, 120, 0])) for i in range(300)] + [("small", i, 40) for i in range(9)]
    df = spark.createDataFrame(data, "pr string, pos int, tokens long")
    got = G.pack_files(df, ["pr"], [F.col("pos")], budget=100, segment_rows=segment_rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["pr"], {})[r["pos"]] = r["chunk_id"]
    for pr in by:
        sizes = [t for p, _, t in data if p == pr]
        assert [by[pr][i] for i in range(len(sizes))] == brute_pack(sizes, 100)
    assert got.count() == len(data)


def brute_plan(files, budget):
    single = max(12000, budget // 2)
    left, full = budget, set()
    for path, tokens, diff in sorted((f for f in files if f[1] <= single), key=lambda f: (-(min(f[1], 12000) + 2 * f[2]), f[0])):
        if tokens <= left:
            left -= tokens
            full.add(path)
    return full


def test_plan_file_context_matches_sequential(spark):
    rng = random.Random(13)
    files = [(i, rng.choice([0, 10, 500, 500, 3000, 9000, 14000, 31000]), rng.randint(0, 300)) for i in range(200)]
    df = spark.createDataFrame([("p", *f) for f in files], "pr string, path int, full_tokens long, diff_tokens long")
    got = {r["path"] for r in G.plan_file_context(df, ["pr"]).where("mode = 'full'").collect()}
    assert got == brute_plan(files, 60000)
    # Earlier plans use up part of the budget.
    later = G.plan_file_context(df.withColumn("used", F.lit(50000)), ["pr"], planned_full="used")
    assert {r["path"] for r in later.where("mode = 'full'").collect()} == brute_plan(files, 10000)


def test_chunk_decision(spark):
    def decide(rows_):
        df = spark.createDataFrame(rows_, "pr int, diff_tokens long, full_tokens long, planned_tokens long")
        return G.pr_token_estimate(df, ["pr"]).first()["should_chunk"]

    tokens = math.ceil(90000 / 3.5)
    assert decide([(1, tokens, tokens, tokens)] * 5)
    assert decide([(1, 1, 1, 1)] * 35)
    assert not decide([(1, 10, 10, 10)] * 2)


def test_line_chunks(spark):
    text = "\n".join(f"l{i}" for i in range(1, 41))
    got = spark.createDataFrame([(text,), ("a\r\nb",), ("\n \n",)], "t string").select(F.inline(G.line_chunks(F.col("t"))))
    assert [(r["start_line"], r["end_line"]) for r in got.collect()] == [(1, 20), (16, 35), (31, 40), (1, 2)]


# --- findings --------------------------------------------------------------------------------------


def test_cross_chunk_patterns(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", "bug", "x" * 60), (1, 2, "b", "bug", "x" * 60 + "y"), (1, 1, "a", "style", "s"), (1, 2, "a", "style", "s")],
        "pr int, chunk_id int, file_path string, type string, description string")
    got = N.cross_chunk_patterns(df, ["pr"]).collect()
    assert [(r["n_chunks"], r["n_files"]) for r in got] == [(2, 2)]


def test_every_text_that_is_not_blank_has_a_vector():
    # In one dimension any two words with opposite signs cancel out.
    vectors = HashedWords(1)([f"w{i} w{j}" for i in range(6) for j in range(6)] + ["!!!", "???"])
    assert np.allclose(np.abs(vectors), 1.0) and (vectors[-1] == vectors[-2]).all()


def test_every_line_of_a_tree_is_in_one_row(spark):
    rng = random.Random(1)
    paths = {"/".join(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 7))) + f"/f{i}" for i in range(400)}
    paths |= {f"flat/g{i}" for i in range(300)}
    paths = {p.lstrip("/") for p in paths}
    tree = R.directory_tree(spark.createDataFrame([("p", p) for p in paths] + [("q", "only")], "project_path string, path string"), ["project_path"])
    rows = R.pack_tree(tree, ["project_path"], 20).collect()
    assert sorted((r.project_path, r.sort_key) for r in rows) == sorted((r.project_path, r.sort_key) for r in tree.collect())
    sizes = {}
    for r in rows:
        at = r.node if r.is_dir else r.node.rpartition("/")[0]
        assert r.owner == "" or f"{at}/".startswith(r.owner + "/")
        sizes[r.project_path, r.owner, r.piece] = sizes.get((r.project_path, r.owner, r.piece), 0) + 1
    assert max(sizes.values()) <= 60 and len(sizes) > 15


@pytest.mark.parametrize("plan", ["broadcast", "blocks"])
def test_radius_join_finds_all(spark, plan):
    from reviewlake.operators import knn as N

    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (150, 3))
    points[40:60] = points[7]  # copies and ties
    rows = [(i, [float(x) for x in p], "ab"[i % 5 == 0], f"d{i % 4}", f"f{i % 6}") for i, p in enumerate(points)]
    df = spark.createDataFrame([*rows, (900, None, "a", "d0", "f0"), (901, [0.0, 0.0, 0.0], None, "d0", "f0")],
                               "id int, vector array<double>, grp string, doc string, file string")
    pairs = [(a[0], b[0], round(float(((points[a[0]] - points[b[0]]) ** 2).sum()), 9), b[3], a[4]) for a in rows for b in rows if a[2] == b[2]]
    near = [p for p in pairs if p[2] <= 1.5]
    sizes = {"plan": plan, "block_rows": 16, "query_block_rows": 40, "query_id": "id", "tenant": "grp"}

    def found(**options):
        return sorted((r.query_id, r.id, round(r.distance, 7)) for r in N.within(df, df, 1.5, **sizes, **options).collect())

    def want(rows):
        return sorted((q, i, round(d, 7)) for q, i, d, *_ in rows)

    assert found() == want(near) and len(near) > 500

    def first(rows, key, order, n):
        groups = {}
        for row in sorted(rows, key=order):
            groups.setdefault(key(row), []).append(row)
        return [row for g in groups.values() for row in g[:n]]

    per = first(near, lambda p: (p[0], p[3]), lambda p: (p[2], p[1]), 2)
    assert found(per=F.col("doc"), best=2) == want(per)
    one = first(near, lambda p: (p[4], p[1]), lambda p: (p[2], p[0]), 1)
    assert found(one_of="file") == want(one)
    both = first(one, lambda p: (p[4], p[3]), lambda p: (p[2], p[1]), 2)
    assert found(one_of="file", per=F.col("doc"), best=2) == want(both)


def test_equal_final_scores_keep_the_nearest_chunks(spark):
    from reviewlake.operators.models import HashedWords
    from reviewlake.plans.retrieval import find_relevant_docs

    # All chunks of the one document are lifted to the cap of 1; the two nearest must win, whatever their ids.
    chunks = spark.createDataFrame(
        [(i, "p", "docs/a.md", "api", "", f"t{i}", [1.0, float(9 - i) / 30]) for i in range(10)],
        "id int, project_path string, original_document_path string, document_title string, heading_text string, content string, vector array<double>")
    q = spark.createDataFrame([(1, "p", "docs/b.md", "x", [1.0, 0.0], "Backend", ["Node.js"])],
                              "query_id int, project_path string, path string, text string, vector array<double>, area string, tech array<string>")
    contexts = spark.createDataFrame([("p", "docs/a.md", False, "api", "Backend", ["node.js"], False)],
                                     "project_path string, path string, generic boolean, title string, doc_area string, doc_tech array<string>, readme_style boolean")
    got = find_relevant_docs(q, chunks, contexts, 2, 0.1, embedder=HashedWords(2)).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [9, 8]


def test_patches_landed_twice_give_one_row(spark):
    from reviewlake.plans.history import attach_patch_code

    c = spark.createDataFrame([(1, 1, "a.py", 5)], "id int, pr int, file_path string, line int").selectExpr(
        "*", "cast(null as string) original_code", "cast(null as string) suggested_code", "cast(null as string) diff_hunk")
    patches = spark.createDataFrame([(1, "a.py", "@@ -1 +5 @@\n+x", 2), (1, "a.py", "@@ -1 +5 @@\n+y", 1)], "pr int, filename string, patch string, landed_at int")
    assert [r.suggested_code for r in attach_patch_code(c, patches, ["pr"]).collect()] == ["y"]
    assert [r.suggested_code for r in attach_patch_code(c, patches.drop("landed_at"), ["pr"]).collect()] == ["x"]


def test_parse_analysis(value):
    ok = value(N.parse_analysis(F.lit('{"summary":"s","issues":[{"type":"bug","lineNumbers":[1]}]}')))
    assert ok["summary"] == "s" and ok["issues"][0]["lineNumbers"] == [1] and not ok["holistic"]
    whole = value(N.parse_analysis(F.lit('{"crossFileIssues":[],"fileSpecificIssues":{"a":[{"type":"t"}]}}')))
    assert whole["holistic"] and whole["summary"] == "No summary provided" and whole["file_issues"]["a"][0]["type"] == "t"
    for broken in ("nope", "{broken}", '{"summary":"x", "issues": [}', "[1]", '{"summary":"x"} tail'):
        assert value(N.parse_analysis(F.lit(broken)))["parse_error"]
    assert value(N.parse_analysis(F.lit('{"summary":"s","issues":[{"type":"bug","lineNumbers":"all"}]}')))["summary"] == "s"


def test_render_issue_with_code(spark):
    df = spark.createDataFrame([("high", [3], "d", "", (1, 2, "x\ny"))],
                               "severity string, line_numbers array<int>, description string, suggestion string, code_suggestion struct<startLine:int,endLine:int,newCode:string>")
    text = df.select(N.render_issue(df).alias("t")).first()["t"]
    assert text.startswith("- **[HIGH] \U0001F525 (Lines: 3)**: d") and "(lines 1-2):**" in text and "  x\n  y\n  ```" in text
    assert "New:\n      x\n      y" in df.select(N.render_issue(df, "text").alias("t")).first()["t"]


def test_scorers_work_a_text_out_once(spark):
    from reviewlake.operators.models import dictionary_technologies, keyword_scores

    df = spark.createDataFrame([(1, "The Database and the API"), (2, "databases, react react"), (3, None)], "id int, text string")
    out = df.select("id", keyword_scores("text").alias("d"), dictionary_technologies(("React", "the"))("text").alias("t"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("coalesce(text") == 1 and plan.count("regexp_extract_all(") == 1
    got = {r["id"]: ([x["domain"] for x in r["d"]], [(x["technology"], round(x["confidence"], 3)) for x in r["t"]]) for r in out.where("id < 3").collect()}
    assert got == {1: (["database", "API"], [("the", 0.667)]), 2: ([], [("React", 0.667)])}


def test_index_tasks_count_bounded_texts(spark, monkeypatch):
    from reviewlake.operators import search

    docs = spark.createDataFrame([(i, f"word{i % 7} text{i} common") for i in range(200)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "word3 common"), (2, "text9")], "query_id int, text string")
    want = {tuple(r) for r in search.bm25(asked, search.build_text_index(docs), 5).collect()}
    monkeypatch.setattr(search, "PART_BYTES", 60)
    index = search.build_text_index(docs)
    # Tasks grow in number with the texts, not in size: no file holds the postings of more than a few documents.
    assert len(index.postings.inputFiles()) > 4 * spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in search.bm25(asked, index, 5).collect()} == want


def test_python_workers_get_small_batches(spark, tmp_path):
    """A query of whole texts hands them to Python in batches of few rows; the next query has its own number."""
    from reviewlake.queries import registry

    sizes = F.pandas_udf(lambda s: s * 0 + len(s), "long")
    spark.range(0, 3000, 1, 1).write.parquet(f"{tmp_path}/documents.parquet")
    name = "test_batches"
    try:
        for rows in (registry.TEXT_BATCH_ROWS, registry.BATCH_ROWS):
            registry.query(name, None, rows)(lambda t: t.documents.coalesce(1).select(sizes("id").alias("n")))
            assert max(r.n for r in registry.QUERIES.pop(name)(spark, str(tmp_path)).collect()) == min(rows, 3000)
    finally:
        registry.QUERIES.pop(name, None)


def test_pruning_works_the_rows_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("p", "a", "file", 1), ("p", "b", "file", 2), ("p", None, "file", 3), ("p", "tree", "directory-structure", 4), ("q", "a", None, 5), (None, "a", "file", 6), ("p", "c", None, 7)]
    schema = "project_path string, path string, type string, n int"
    existing = spark.createDataFrame(rows, schema).mapInArrow(run, schema)
    live = spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a"), ("p", "z"), ("p", None)], "project_path string, path string")
    assert sorted(r["n"] for r in R.prune_files(existing, live).collect()) == [1, 3, 4, 5]
    assert made.value == len(rows)
    chunks = existing.withColumnRenamed("path", "original_document_path")
    named = live.withColumnRenamed("path", "original_document_path")
    assert sorted(r["n"] for r in R.prune_chunks(chunks, named).collect()) == [1, 3, 5]
    assert made.value == 2 * len(rows)


def test_hashed_words_looks_a_word_up_once(monkeypatch):
    import hashlib
    import pickle

    from reviewlake.operators import models

    seen, digest = [], hashlib.md5
    monkeypatch.setattr(models.hashlib, "md5", lambda b: seen.append(b) or digest(b))
    texts = ["one Two two", "two three", "!!!", "one"]
    embedder = HashedWords(8)
    first, again = embedder(texts), embedder(texts[::-1])[::-1]
    assert sorted(seen) == [b"", b"one", b"three", b"two"] and (first == again).all()
    assert len(pickle.loads(pickle.dumps(embedder))._slots) == 0
    for text, vector in zip(texts, first):
        want = np.zeros(8)
        for word in text.lower().replace("!!!", "").split() or [""]:
            h = digest(word.encode()).hexdigest()
            want[int(h[:8], 16) % 8] += 1.0 - 2.0 * (int(h[8], 16) % 2)
        if want.any():
            assert np.allclose(vector, want / np.linalg.norm(want))
