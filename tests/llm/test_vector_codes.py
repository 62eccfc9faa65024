"""Active-entry Lloyd against full scans in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from reviewlake.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) and abs(x) < V.MAX_COMPONENT for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    slices = V.part_slices(len(kept[0][1]), parts)
    books = [[r[1][s] for r in kept[:entries]] for s in slices]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, s in enumerate(slices):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(v[s], books[p])[1], []).append(v[s])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], {}
    for i, v, label in kept:
        found = [nearest(v[s], books[p]) for p, s in enumerate(slices)]
        error = sum(d for d, _ in found)
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(((i, c, e, labels[label], sha, label) for i, c, e, label in out), key=str)


def run(spark, rows, schema="vec_id long, embedding array<float>, label int", **options):
    return sorted((tuple(r) for r in V.compress(spark.createDataFrame(rows, schema), **options).collect()), key=str)


def vectors(n, length, seed, steps=4):
    """Coarse values, so that equal distances and equal vectors are frequent."""
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.randrange(-steps, steps + 1) / 4096 + rng.choice([0, 0.0001]))) for _ in range(length)], rng.choice([0, 1, 2, None]))
            for i in range(n)]


@pytest.mark.parametrize("n,length,seed", [(300, 16, 1), (120, 8, 2), (60, 21, 3), (9, 16, 4)])
def test_matches_full_scans(spark, n, length, seed):
    rows = vectors(n, length, seed)
    random.Random(seed).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "small", lambda df: df)
    rows = vectors(40, 16, 5)
    rows += [(1, None, 1), (-5, [None] * 16, 1), (-4, [float("nan")] + [0.0] * 15, 1), (-3, [float("-inf")] * 16, None), (-2, [], 0), (-1, [1e30] * 16, 0),
             (50, [0.5] * 15, 1), rows[3], rows[3], (None, [0.25] * 16, 2), (3, [-1.0] * 16, None)]
    assert run(spark, rows) == brute(rows)


def test_other_sizes_and_empty(spark):
    rows = vectors(50, 12, 7)
    assert run(spark, rows, parts=4, entries=5, rounds=3) == brute(rows, 4, 5, 3)
    assert run(spark, []) == [] and run(spark, [(1, None, 2)]) == []
    clash = [(*r, "x") for r in rows]
    assert run(spark, clash, "vec_id long, embedding array<float>, label int, CODE string") == brute(rows)


@pytest.mark.parametrize("seed", range(20))
def test_active_entries_give_the_codes_of_a_full_scan(seed):
    rng = np.random.default_rng(seed)
    part, entries = rng.integers(-3, 4, (200, 4)), rng.integers(-3, 4, (8, 4))
    code, held = V.assign(part, entries, np.zeros(8, bool), None, None)
    for _ in range(4):
        after = entries.copy()
        after[rng.random(8) < 0.4] += rng.integers(-1, 2, 4)
        moved = (after != entries).any(axis=1)
        code, held = V.assign(part, after, moved, code, held)
        want = V.assign(part, after, moved, None, None)
        assert (code == want[0]).all() and (held == want[1]).all()
        entries = after
