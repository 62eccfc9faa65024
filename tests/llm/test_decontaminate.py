"""Phrase search on the positional index against brute force."""

import hashlib
import random
import re

from reviewlake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = words_of(text)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[i:i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for run, owners in windows.items():
            for i in range(len(ws) - len(run) + 1):
                if tuple(ws[i:i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found |= owners
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, doc_schema="doc_id long, text string", item_schema="item_id long, text string"):
    found = decontaminate.decontaminate(spark.createDataFrame(docs, doc_schema), spark.createDataFrame(items, item_schema))
    rows = found.selectExpr("cast(doc_id as long)", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "B", "cc", "É", "é", "d9", "x"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 16])))) for i in range(12)]
    items += [items[0], (50, items[3][1]), (None, "only here " * 6), (51, None), (52, " !! "), (53, "never there at all")]
    docs = []
    for i in range(40):
        parts = [rng.choice([items[rng.randrange(12)][1], " ".join(word() for _ in range(12)), "!!" + items[5][1].upper()]) for _ in range(4)]
        docs.append((i % 35, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(None, items[2][1]), (98, None), (99, ""), (97, "--"), (96, "only here " * 9), (95, "a " * 3000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_larger_than_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    items = [(1, " ".join(f"w{i}" for i in range(30)))]
    docs = [(i, f"own{i} " + " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(25)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    got = run(spark, [(1, "a b c", 5)], [(1, "b c", 6)], "doc_id long, text string, pos int", "item_id long, text string, TEXT int")
    assert got == brute([(1, "a b c")], [(1, "b c")])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b a"), (2, "b a")], "doc_id long, text string")
    terms = spark.createDataFrame([("a", 0), ("b", 1), ("\x00", -1)], "word string, term int")
    index = decontaminate.build_index(docs, terms)
    got = decontaminate.proximity_matches(index, 0, 1, 2).join(index.where("term = -1").select("rid", "doc_id"), "rid")
    assert sorted((r.doc_id, r.pos, r.other) for r in got.collect()) == [("1", 5, 4), ("2", 2, 1)]
