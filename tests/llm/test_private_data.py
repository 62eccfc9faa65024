"""Base spans against the plain patterns; the field's sums and best path against enumeration."""

import hashlib
import random
import re

import numpy as np
import pytest

from reviewlake.llm import private_data as P

PIECES = ["a", "b.c", "@", "@x.y", ".", "1", "12", "255", ".", "+1", " ", "-", "(", ")", "4111111111111111", "4111-1111-1111-1111", "é", "%", "\n", "٣", "300"]


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    check = lambda d: sum(n - 9 * (n > 9) for n in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1]))) % 10 == 0
    found = {k: re.finditer(p, text) for k, p in {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()}
    return {
        "email": [m.span() for m in found["email"]],
        "ip": [m.span() for m in found["ip"] if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in found["card"] if 16 <= len(digits(m[0])) <= 19 and check(digits(m[0]))],
        "phone": [m.span() for m in found["phone"] if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 12)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    text = "1" * 200_000 + "a@" * 100_000 + "+" * 1000 + "1." * 50_000 + "x" * 500_000
    assert P.all_spans(text, P.SemiMarkovField.start())[0]["card"] == []


def _enumerate(zone, field):
    """Every segmentation as (score, segments)."""
    scores = zone.features @ field.weights

    def go(at):
        if at == len(zone.words):
            yield 0.0, []
            return
        yield from go(at + 1)
        for k, (i, j, _, _) in enumerate(zone.segments):
            if i == at:
                for y in range(len(P.KINDS)):
                    for s, rest in go(j):
                        yield s + scores[k, y], [(k, y), *rest]

    return list(go(0))


@pytest.mark.parametrize("text", ["a +1 (743) 555 b", "x@y.z 1.2.3.4", "12 34"])
def test_sums_and_best_path(text):
    rng = np.random.default_rng(2)
    field = P.SemiMarkovField(rng.normal(0, 0.6, (P.N_FEATURES, len(P.KINDS))))
    zone, = P.zones(text)
    every = _enumerate(zone, field)
    total, marginals = field.marginals(zone)
    weights = np.exp([s for s, _ in every])
    assert total == pytest.approx(np.log(weights.sum()))
    for k in range(len(zone.segments)):
        for y in range(len(P.KINDS)):
            want = sum(w for w, (_, path) in zip(weights, every) if (k, y) in path) / weights.sum()
            assert marginals[k, y] == pytest.approx(want)
    assert field.best(zone) == max(every, key=lambda x: x[0])[1]


def _corpus(n=160):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    spans = [lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
             lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), lambda: "4111111111111111", lambda: f'key = "{rng.getrandbits(120):x}"', lambda: str(rng.randrange(2100))]
    return [" ".join([*(word() for _ in range(8)), rng.choice(spans)(), *(word() for _ in range(8)), rng.choice(spans)(), word()]) for _ in range(n)]


def test_added_spans(spark):
    docs = spark.createDataFrame(list(enumerate(_corpus())), "doc_id long, text string")
    field = P.fit(docs)
    for text, kind, span in (("call 743-555-3824 now", "phone", "743-555-3824"), ("host 192[.]168[.]1[.]7 is", "ip", "192[.]168[.]1[.]7")):
        base, added = P.all_spans(text, field)
        assert not any(base.values()) and [text[s:e] for s, e in added[kind]] == [span]
    for text in ("in 1999 there were 300 of them", 'key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here', "nothing at all"):
        assert not any(P.all_spans(text, field)[1].values())
    long = "call 743-555-3824 now " * 100
    assert len(P.all_spans(long, field)[1]["phone"]) == 100
    assert P.masked("a x@y.zz b 4111111111111111", field) == "a <email> b <card>"


def test_rows(spark):
    rows = [(1, None, 9), (1, "", 0), (None, "me@x.yz and 1.2.3.4", 3), (1, "me@x.yz", 3), (1, "me@x.yz", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = P.find_private(docs).collect()
    assert [(r.n_email, r.n_ip, r.spans) for r in got] == [(0, 0, ""), (0, 0, ""), (1, 1, "email:0:7,ip:12:19"), (1, 0, "email:0:7"), (1, 0, "email:0:7")]
    assert got[2].base_sha256 == hashlib.sha256(b"email:0:7,ip:12:19").hexdigest()
    assert P.find_private(docs.limit(0)).count() == 0
    full = spark.createDataFrame([(1, "me@x.yz", 7, "a"), (2, None, None, "b")], "doc_id long, text string, n_chars long, Text string")
    got = P.mask_private(full)
    assert got.columns == full.columns and [tuple(r) for r in got.collect()] == [(1, "<email>", 7, "a"), (2, None, None, "b")]


def test_addresses_without_digits_and_signs(spark):
    """No digit or sign stands near these addresses."""
    docs = spark.createDataFrame(list(enumerate(_corpus())), "doc_id long, text string")
    field = P.fit(docs)
    texts = ["write to jane.doe at example dot com for the rest", "ask john.smith at mail dot example dot org about it"]
    spans = ["jane.doe at example dot com", "john.smith at mail dot example dot org"]
    for text, span in zip(texts, spans):
        base, added = P.all_spans(text, field)
        assert not any(base.values()) and [text[s:e] for s, e in added["email"]] == [span]
    for text in ("we met at noon by the dot on the map", "look at the dot", "at home dot and all"):
        assert not any(P.all_spans(text, field)[1].values())
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert [r.text for r in P.mask_private(rows, field).orderBy("doc_id").collect()] == ["write to <email> for the rest", "ask <email> about it"]
