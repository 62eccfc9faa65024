"""Source mixture: limits kept, quotas met, whole passes, running totals against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import mixture
from reviewlake.llm.mixture import Mix


def _docs(spark, sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), " ".join("w" for _ in range(rng.randrange(1, 40))), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def _exponent(shares, keeps):
    low, high = 0.0, 1.0
    if keeps(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if keeps(mid) else (mid, high)
    return high


def test_matches_brute_force(spark):
    mix = Mix(repeat_limit=1.6, block_tokens=50)
    docs, rows = _docs(spark, {"big": 150, "mid": 40, "low": 12})
    got = mixture.mix_sources(docs, mix).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}
    weights = lambda a: {s: x ** a / sum(y ** a for y in p.values()) for s, x in p.items()}
    w = weights(_exponent(p, lambda a: max(weights(a)[s] / p[s] for s in p) <= 1.6))
    want = []
    for s in tokens:
        quota = round(w[s] * total)
        for epoch in range((quota - 1) // tokens[s] + 1):
            left, before = quota - epoch * tokens[s], 0
            key = lambda r: hashlib.md5(f"mix-1|{epoch}|{r[0]}|{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
            for r in sorted((r for r in rows if r[2] == s), key=key):
                if before < left:
                    want.append((r[0], s, epoch, before // 50))
                before += len(r[1].split())
    assert sorted((r.doc_id, r.source, r.epoch, r.block) for r in got) == sorted(want)
    blocks = defaultdict(set)
    for r in got:
        blocks[r.source, r.epoch, r.block].add(r.draw)
    assert all(len(d) == 1 for d in blocks.values())


@pytest.mark.parametrize("target", [0.5, 0.9, 5.0])
def test_entropy_target(spark, target):
    shares = spark.createDataFrame([(0.8,), (0.15,), (0.05,)], "p double")
    a = mixture.find_exponent(shares, Mix(entropy=target))
    w = [x ** a for x in (0.8, 0.15, 0.05)]
    entropy = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    natural = -sum(x * math.log(x) for x in (0.8, 0.15, 0.05))
    if target > math.log(3):
        assert a == 0
    elif target < natural:
        assert a == 1
    else:
        assert entropy == pytest.approx(target, abs=1e-6)


def test_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", "x"), (2, None, "x"), (3, "", "y"), (4, "d e f", "")]
    got = mixture.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), Mix(repeat_limit=10)).collect()
    assert Counter((r.source, r.doc_id) for r in got if r.epoch == 0)[None, 1] >= 1
    assert {r.source for r in got} <= {None, "x", ""} and all(r.tokens > 0 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string, source string, tokens int, epoch int")
    assert mixture.mix_sources(none).count() == 0


def test_one_source_holds_nearly_everything(spark):
    docs, rows = _docs(spark, {"hot": 3000, "cold": 3})
    got = mixture.mix_sources(docs, Mix(repeat_limit=3, budget_share=2.0))
    per = {r.source: r.t for r in got.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    cold = sum(len(t.split()) for _, t, s in rows if s == "cold")
    assert cold * 2 < per["cold"] <= cold * 3 + 40
    first = got.where("epoch = 0 and source = 'hot'")
    assert first.count() == first.select("doc_id").distinct().count() == 3000
