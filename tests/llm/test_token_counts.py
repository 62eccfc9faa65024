"""Token counts of every prefix against the tokeniser itself."""

import random

import public_tokenizers
import pytest
import tokenizers

from reviewlake.llm import token_counts

ALPHABET = [" ", "  ", "\n", "\t", "'s", "'re", "'", "l", "ll", "a", "B", "é", "漢", "1", "23", "#", "!!", " ", "　", "\x85", "\x1c", "\x00",
            "😀", "<|endoftext|>", "<|endo", "the", " token"]


@pytest.fixture(scope="module")
def exact():
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix(exact, seed):
    rng, counts = random.Random(seed), token_counts.counter()
    for _ in range(60):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 14)))
        want = [exact(text[:i]) for i in range(len(text) + 1)]
        assert counts.count(text) == want[-1], text
        assert counts.prefix_counts(text).tolist() == want, text
        for budget in (1, 3, 6):
            assert counts.fits(text, budget) == max(i for i, n in enumerate(want) if n <= budget), text


def test_documents(spark, exact):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: exact(r.text) for r in docs.collect()}
    got = token_counts.count_tokens(docs).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_long_and_odd_rows(spark, exact):
    long = "a" * 20_000 + " word" * 2000
    rows = [(1, None, 1), (1, "", 2), (None, long, 3), (2, "x", 4)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(1, 0, 0), (1, 0, 0), (None, len(long), exact(long)), (2, 1, 1)]
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_budgets_from_the_stored_prefixes(spark, exact):
    rows = [(1, "It's the first of many words, 12345 of them"), (2, None), (3, "short")]
    table = token_counts.prefix_table(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.fits for r in token_counts.within_budget(table, 4).collect()}
    text = rows[0][1]
    assert got == {1: max(i for i in range(len(text) + 1) if exact(text[:i]) <= 4), 2: 0, 3: 5}
