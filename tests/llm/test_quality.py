"""Quality rules and classifier: base counts against brute force, fertility against whole-text encoding, held-out accuracy."""

import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from reviewlake.llm import quality_model, quality_rules


def brute_repeats(words):
    count = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    return len({p for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for p in range(i, i + 3)})


@pytest.mark.parametrize("seed", range(5))
def test_repeated_words(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c", b"dd"][:2 + seed % 3]) for _ in range(rng.randrange(0, 60))]
    assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_base_counts(spark):
    text = "a b\n\n  \na b\nc #*$ a b\n\x0b\n" + "é" * 3
    rows = [(1, text), (2, None), (3, ""), (3, ""), (None, "x " * 60), (5, " ".join(a + b for a in ("over", "under", "out", "fore", "back", "down", "up", "in") for b in ("come", "go", "look", "stand", "take", "hold", "turn")))]
    got = quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = got[0]
    assert (first.n_words, first.word_chars, first.n_symbols, first.n_dup_lines) == (9, 13, 3, 1)
    assert [r.base_failed for r in got] == [True, True, True, True, True, False]
    assert got[4].n_repeat_words == 60 and got[5].kept and got[1].n_words == 0 and not got[1].kept


def test_word_by_word_equals_whole_text():
    path = public_tokenizers.path(quality_rules.VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text = "The quick brown fox, naïve Straße 漢字 😀 don't stop and and"
    ids = model.encode(text)
    total, fallback, entropy = quality_rules.fertility().measure(Counter(text.encode().split()))
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert total == len(ids)
    assert fallback == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
    assert entropy == pytest.approx(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def test_scripts():
    cases = {"abc": "Latin", "Größe": "Latin", "Привет a": "Cyrillic", "漢字 a": "Han", "Ελλάς": "Greek", "123 !": "", "": "", "١٢ سلام": "Arabic"}
    assert {t: quality_rules.script_of(t) for t in cases} == cases


def test_noise_is_rejected_by_its_band(spark):
    rng = random.Random(4)
    noise = " ".join("".join(rng.choice("qxzjkv0189") for _ in range(30)) for _ in range(80))
    emoji = " ".join(chr(0x1F300 + rng.randrange(200)) * 4 + "a" for _ in range(80))
    got = quality_rules.assess(spark.createDataFrame([(1, noise), (2, emoji)], "doc_id long, text string")).collect()
    assert [r.base_failed for r in got] == [False, False] and [r.kept for r in got] == [False, False]
    assert quality_rules.bands_seen(spark.createDataFrame(got)).count() == 1


def test_latin_noise_goes_and_prose_stays(spark):
    rng = random.Random(5)
    words = lambda signs, size: " ".join("".join(rng.choice(signs) for _ in range(size)) for _ in range(300))
    coded = "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(80))
    noise = [words("abcdefghijklmnopqrstuvwxyz", 12), words("abcdefghijklmnopqrstuvwxyz", 6), words("bcdfghjklmnpqrstvwxz", 8), coded]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    assert [(r.base_failed, r.kept) for r in quality_rules.assess(rows).collect()] == [(False, False)] * 4
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = quality_rules.assess(docs).where("not base_failed").collect()
    assert len(seen) > 800 and all(r.kept for r in seen)


def test_empty_long_and_clashing(spark):
    assert quality_rules.assess(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"word{i} of text" for i in range(100_000))
    got = quality_rules.assess(spark.createDataFrame([(1, long, 1), (None, None, 2)], "doc_id long, text string, KEPT int")).collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(1, 300_000), (None, 0)]


def _labelled(spark, n=240):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "morning", "walk", "quiet", "letter"]) for _ in range(40))
    bad = [lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "FREE###"]) for _ in range(40)),
           lambda: " ".join(w for w in rng.sample(["river", "stone", "walk", "quiet"], 3) for _ in range(14))]
    docs, labels = [], []
    for i in range(n):
        label = i % 2
        docs.append((i, good() if label else rng.choice(bad)()))
        labels.append((i, label, 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(
        (i, k) for i, k, _ in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = _labelled(spark)
    got = quality_model.classify(docs, labels).collect()
    test = [r for r in got if r.held_out]
    assert len(test) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_score_equals_the_mean_of_the_vectors():
    model = quality_model.train(["a b a", "C D", "e"], [1, 0, 1], epochs=2)
    features, shares = quality_model.bag("a a bcd é")
    z = (shares @ model.vectors[features]) @ model.weights + model.bias
    p = np.exp(z - z.max())
    assert model.score("a a bcd é") == pytest.approx(float(p[1] / p.sum()), abs=1e-4)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a", "y"), (1, "", "z"), (2, "w " * 5000, "z")], "doc_id long, text string, SCORE string")
    for marks in ([], [(1, 1, 0)], [(1, None, 0), (None, 0, 0)], [(1, 1, 0), (1, 0, 0), (2, 1, 0)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        got = quality_model.classify(docs, labels).collect()
        assert len(got) == 4 and got[0].score == got[2].score
    assert quality_model.classify(docs.limit(0), labels).count() == 0
    assert quality_model.scored(docs, quality_model.train([], [])).columns == ["doc_id", "text", "SCORE", "score"]
