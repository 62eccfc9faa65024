"""The byte network: gradients against finite differences, chunked pooling, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from reviewlake.llm import language_id

WORDS = {"en": "the and with that from this have".split(), "de": "der und nicht mit auf über können".split(), "fr": "les des être avec où ça voilà".split()}


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel.start(["a", "b", "c"], hidden=3)
    model = language_id.LanguageModel(model.languages, [a.astype(np.float64) for a in model.arrays])
    chunks = rng.integers(97, 101, (4, 6)).astype(np.int16)
    chunks[1, 4:] = 256
    labels = np.array([0, 1, 2, 1])

    def loss():
        p = model.positions(chunks)[0]
        valid = chunks.T != 256
        picked = p[np.arange(6)[:, None], labels[None, :], np.arange(4)[None, :]]
        return -(np.log(picked) * valid).sum() / valid.sum()

    for array, grad in zip(model.arrays, model.gradients(chunks, labels)):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            if array.shape[0] == 257:
                at = (int(rng.integers(97, 101)), at[1])
            kept = array[at]
            array[at] = kept + 1e-2
            up = loss()
            array[at] = kept - 1e-2
            down = loss()
            array[at] = kept
            assert grad[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_pooling_over_chunks_and_blocks(monkeypatch):
    model = language_id.LanguageModel.start(["a", "b"])
    texts = [b"x", b"hello world " * 40, b"", b"y" * 128, b"z" * 129]
    whole = model.probabilities(texts)
    monkeypatch.setattr(language_id, "_BLOCK", 2)
    assert np.allclose(model.probabilities(texts), whole)
    chunk = np.full((1, 128), 256, np.int16)
    chunk[0, 0] = ord("x")
    assert np.allclose(whole[0], model.positions(chunk)[0][0, :, 0], atol=1e-6)
    assert np.allclose(whole[[0, 1, 3, 4]].sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(rng.randrange(8, 80))), k) for i in range(150) for k in [rng.choice(list(WORDS))]]
    truth = {i: k for i, _, k in rows}
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None), (None, "der und über", None), (0, rows[0][1], rows[0][2])]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.95
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels_and_empty(spark):
    rows = spark.createDataFrame([(1, "abc", None, "x")], "doc_id long, text string, lang string, LANG string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(rows).collect()] == [("und", 0.0)]
    assert language_id.identify(rows.limit(0)).count() == 0
