"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np

from reviewlake.llm import repeats


def brute(rows):
    words = [(i, (t or "").replace("\n", " ").split(" ")) for i, t in rows]
    words = [(i, [w for w in ws if w]) for i, ws in words]
    low = {}
    for i, ws in words:
        if i is not None:
            for s in range(len(ws) - 12):
                key = tuple(ws[s:s + 13])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for s in range(len(ws) - 12):
            if i is not None and low[tuple(ws[s:s + 13])] < i:
                gone.update(range(s, s + 13))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string"):
    got = repeats.remove_repeats(spark.createDataFrame(rows, schema)).drop("kept_text").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        rows.append((rng.randrange(60), "\n".join(rng.choice([p, rng.choice(passages)]) for p in parts)))
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, " \n "), (3, rows[1][1]), rows[2], (100, "a " * 300), (101, "a " * 13), (102, "a " * 12)]
    assert run(spark, rows) == brute(rows)


def test_a_passage_in_every_document_goes_from_all_but_the_first(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(200)]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert got[0] == 0 and all(got[i] == 50 for i in range(1, 200))


def test_every_window_keeps_its_anchor_wherever_it_stands():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 2 ** 63, 13).astype(np.uint64)
    for before in range(4):
        words = np.concatenate([rng.integers(0, 2 ** 63, before).astype(np.uint64), body, body[:3]])
        assert repeats.window_anchors(words)[before] == repeats.window_anchors(body)[0]


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    got = run(spark, [(1, "a b", "x")], "doc_id long, text string, TEXT string")
    assert got == [(1, 2, 0, hashlib.sha256(b"a b").hexdigest())]
