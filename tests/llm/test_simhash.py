"""SimHash groups against brute force on small tables."""

import random

import numpy as np
import pytest
import xxhash

from reviewlake.llm import simhash


def brute_fingerprint(text):
    words = [w for w in _lower(text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [" ".join(words)]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_components(fps):
    parent = {k: k for k in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", "  \n\t", "Einzeln", "zwei Wörter", "A b C d É È f " * 40, "x" * 5000, " a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_a_long_text_uses_all_of_it():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def _table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra int")


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))), 1) for i in range(150)]
    rows += rows[:5]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(_table(spark, rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert simhash.near_duplicates(_table(spark, rows)).count() == len(rows)


def _fingerprint_rows(spark, values):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    return spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Hundreds of fingerprints around a few centres: every bucket of the first level is crowded."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for c in centres for _ in range(120)})
    got = {r.doc_id: r.component_id for r in simhash.components(_fingerprint_rows(spark, values)).collect()}
    assert got == brute_components(dict(enumerate(values)))


def test_long_chain_is_one_component(spark):
    values, x = [0], 0
    for i in range(40):
        x ^= 3 << (i * 3 % 60)
        values.append(x)
    values = list(dict.fromkeys(values))
    got = {r.doc_id: r.component_id for r in simhash.components(_fingerprint_rows(spark, values)).collect()}
    assert got == brute_components(dict(enumerate(values)))


@pytest.mark.parametrize("plan", [[(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(64)), 2)]])
def test_unequal_thresholds_find_all_links(spark, monkeypatch, plan):
    monkeypatch.setattr(simhash, "plan_parts", lambda n, both, distance: plan)
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(60)})
    got = {r.doc_id: r.component_id for r in simhash.components(_fingerprint_rows(spark, values)).collect()}
    assert got == brute_components(dict(enumerate(values)))


def test_thresholds_follow_the_pigeonhole_rule():
    assert simhash.allocate([[0, 5, 9, 9], [0, 1, 2, 50]])[1] == [0, 1]
    both = np.full((64, 64), 250)
    np.fill_diagonal(both, 500)
    few, many = simhash.plan_parts(1000, both), simhash.plan_parts(10 ** 10, both * 10 ** 7)
    assert [t for _, t in few] == [0, 0, 0]
    assert sorted(t for _, t in many) == [0, 1] or sorted(t for _, t in many) == [2]
    assert sorted(b for bits, _ in few for b in bits) == list(range(64))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c", "x", 2), (None, "a b c", "y", 3)], "doc_id long, text string, Text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(1, 1), (None, 1)}
