"""The pipeline's stages one by one against plain Python on a small table."""

import random

import corpus_pipeline
import pytest
from .test_decontaminate import brute as leaks
from .test_simhash import brute_components, brute_fingerprint

from reviewlake.llm import private_data
from reviewlake.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["river", "stone", "morning", "walk", "quiet", "letter", "garden", "window", "paper", "train", "cloud", "table"]
    items = [(k, " ".join(f"item{k}word{j}" for j in range(14))) for k in range(4)]
    rows, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) for _ in range(60)) if good else "BUY!! NOW$$$ " * 30
        if good and i % 10 == 1:
            text += " " + items[i % 4][1] + " end"
        if good and i % 6 == 1:
            text += f" mail a{i}@mail.example.com today"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    rows += [(900, rows[1][1], "en", "s1", 5), (901, None, None, None, None), (902, "", "en", "s2", 0), (None, "river stone morning walk", "en", None, 24)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_leaks", "personal_data", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stored(stage(spark, docs, path), "test-stage")
        if name != "mix":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = out.collect()
        if name == "quality":
            kept = {r.doc_id for r in after}
            assert not any(i in kept for i in range(0, 160, 4)) and all(i in kept for i in range(160) if i % 4)
        elif name == "near_duplicates":
            ids = {i: i if i is not None else 10 ** 6 for i in before}
            want = brute_components({ids[i]: brute_fingerprint(r.text) for i, r in before.items()})
            assert sorted(ids[r.doc_id] for r in after) == sorted(i for i, root in want.items() if i == root)
        elif name == "benchmark_leaks":
            bad = {r[0] for r in leaks([(i, r.text) for i, r in before.items()], items) if r[-1]}
            assert bad and {r.doc_id for r in after} == set(before) - bad
        elif name == "personal_data":
            assert len(after) == len(before)
            for r in after:
                assert r.text is None or not any(private_data.base_spans(r.text).values())
                assert r.n_chars == (None if r.text is None else len(r.text))
            assert any("<email>" in (r.text or "") for r in after)
        else:
            assert {r.doc_id for r in after} <= set(before) and len(after) > 20
        docs = out


def test_run_and_empty_table(spark, folder, tmp_path):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 20
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_clashing_columns(spark, folder):
    path, _ = folder
    rows = [(1, "river stone morning walk quiet letter", "en", "s", 3, "x"), (1, "river stone morning walk quiet letter", "en", "s", 3, "y"),
            (None, "river stone morning walk quiet letter", "en", "s", 3, "z"), (None, "another text of its own here", "en", "s", 3, "z")]
    docs = spark.createDataFrame(rows, COLUMNS + ", fp string")
    out = corpus_pipeline.near_duplicates(spark, docs, path)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
    assert corpus_pipeline.benchmark_leaks(spark, docs, path).count() == 4
    assert corpus_pipeline.personal_data(spark, docs, path).count() == 4
