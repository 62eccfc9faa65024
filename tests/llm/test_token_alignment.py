"""Alignment against whole texts encoded in one piece, every pair of tokens compared."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from reviewlake.llm import token_alignment
from reviewlake.llm.token_counts import byte_letters

ALPHABET = [" ", "  ", "\n", "\t", " a", "the", " the", "'s", "'re", "é", "é", "漢字", " 漢", "😀", " 😀", "1", "23", " 45", "#", " !!", "\x85", "\x1c", "\x00",
            "​", "﻿", "　", "\xa0", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " token", "Straße", "ﬁ", "½", "́", " ́", "ａ"]


@pytest.fixture(scope="module")
def whole():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path(token_alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_alignment.VOCABULARY_B))
    letters = byte_letters()
    names = {i: t for t, i in a.get_vocab().items()}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(pieces):
        at, out = 0, []
        for piece in pieces:
            at += len(piece)
            out.append(at)
        return out

    def encode(text):
        data = b" " + text.encode() if text else b""
        left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes, b_bytes = [bytes(letters[c] for c in names[i]) for i in left], [of_b(i) for i in right]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            return [], [], "", []
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(left[i], right[j]) for i, x in enumerate(a_ends) for j, y in enumerate(b_ends) if x == y]
        cuts = [0, *sorted(set(a_ends) & set(b_ends))]
        groups = ";".join("|".join(",".join(str(i) for i, e in zip(ids, at) if low < e <= high) for ids, at in ((left, a_ends), (right, b_ends)))
                          for low, high in zip(cuts, cuts[1:]))
        return left, right, groups, links

    return encode


def brute(rows, whole):
    found = [(i, *whole(t or "")) for i, t in rows]
    counts = Counter(link for *_, links in found for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((i, len(a), len(b), groups.count(";") + 1 if a else 0, len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if a else "", groups) for i, a, b, groups, links in found), key=str)


def run(spark, rows, schema="doc_id long, text string", **options):
    return sorted((tuple(r) for r in token_alignment.align_tokens(spark.createDataFrame(rows, schema), **options).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_segments_give_the_tokens_of_the_whole_text(whole, seed):
    rng, model = random.Random(seed), token_alignment.aligner()
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 16))) for _ in range(400)]
    for text, (n_a, n_b, n_groups, got, pairs) in zip(texts, model.documents(texts)):
        a, b, groups, links = whole(text)
        assert (n_a, n_b, n_groups, got) == (len(a), len(b), len(links), groups), repr(text)
        assert [divmod(p, 1 << 24) for p in pairs.tolist()] == links, repr(text)


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_documents_and_odd_rows(spark, whole, monkeypatch, broadcast):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", broadcast)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 3000][:60]
    rows += [(1, None), (1, ""), (None, "the same row"), (None, "the same row"), (2, "a ▁ b"), (3, " "), (4, "tab\tand\nline"), (5, "no▁spaces")]
    assert run(spark, rows) == brute(rows, whole)


def test_spans_are_refined_by_bytes():
    # Two tokens share a character: overlapping spans on one side, empty ones before the last on the other.
    spans, sizes = np.array([(0, 4), (1, 4), (4, 6)]), np.array([2, 2, 2])
    assert token_alignment.token_ends(spans, sizes).tolist() == [2, 4, 6]
    spans, sizes = np.array([(0, 1), (1, 1), (1, 1), (1, 4)]), np.array([1, 1, 1, 1])
    assert token_alignment.token_ends(spans, sizes).tolist() == [1, 2, 3, 4]


def test_very_long_empty_and_clashing(spark):
    long = "x" * 30_000 + " word" * 30_000 + " " + "漢" * 5_000
    got = run(spark, [(1, long, "a")], "doc_id long, text string, TEXT string", keep_groups=False)
    model = token_alignment.aligner()
    n_a, n_b = len(model.a.encode(" " + long, add_special_tokens=False).ids), len(model.b.encode(long))
    assert got[0][:3] == (1, n_a, n_b) and got[0][3] == got[0][4] > 40_000
    assert run(spark, []) == []


def test_dictionary_names_the_same_words(spark):
    docs = spark.createDataFrame([(1, "the house and the garden"), (2, "the garden")], "doc_id long, text string")
    rows = token_alignment.dictionary(docs).collect()
    assert sorted(r["count"] for r in rows) == [1, 1, 2, 3] and all(r.best for r in rows)
