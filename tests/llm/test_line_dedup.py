"""Line dedup against brute force."""

import hashlib
import random

import pytest

from reviewlake.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_documents=2):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n") if doc_id is not None else ():
            holders.setdefault(line.strip(SPACE).translate(LOWER), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(SPACE).translate(LOWER)
            ids = holders.get(key, set())
            if doc_id is None or len(key) < 10 or len(ids) < min_documents or doc_id == min(ids):
                kept.append(line)
        joined = "\n".join(kept)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string", **options):
    return sorted((tuple(r) for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, schema), **options).collect()), key=str)


def documents():
    rng = random.Random(4)
    lines = [f"  Shared LINE number {k}\t" for k in range(8)] + ["short", "É" * 9, "É" * 10, "é" * 10, "", "  ", "ten chars!", "nine char"]
    vary = [str, str.upper, str.lower, lambda s: s + " \r", lambda s: "\x0b" + s, lambda s: "\xa0" + s]
    rows = [(rng.randrange(50), "\n".join(rng.choice(vary)(rng.choice(lines + [f"own line {i} {j}"])) for j in range(rng.randrange(1, 9)))) for i in range(70)]
    return rows + [(None, rows[0][1]), (7, None), (8, ""), (9, "\n\n"), rows[3], rows[3], (1000, "\n".join([lines[0]] * 5)), (-4, lines[1] + "\n")]


@pytest.mark.parametrize("min_documents", [2, 4])
def test_matches_brute_force(spark, min_documents):
    rows = documents()
    got = run(spark, rows, min_documents=min_documents)
    assert got == brute(rows, min_documents)
    assert sum(r[2] for r in got) > 50


def test_a_line_in_every_document_stays_in_the_first(spark):
    rows = [(i, f"own {i} text\nAll rights reserved.\nend") for i in range(300)]
    got = {r[0]: r[2] for r in run(spark, rows)}
    assert got[0] == 0 and all(got[i] == 1 for i in range(1, 300))


def test_very_long_empty_and_clashing(spark):
    long = "\n".join(f"line number {i}" for i in range(60_000)) + "\n" + "x" * 1_000_000
    rows = [(1, long, "a"), (2, long + "\nits own last line", "b")]
    got = run(spark, rows, "doc_id long, text string, TEXT string", keep_text=False)
    assert [r[:3] for r in got] == [(1, 60_001, 0), (2, 60_002, 60_001)]
    assert got[1][3] == hashlib.sha256(b"its own last line").hexdigest()
    assert run(spark, []) == []
