"""Alignment of the tokens of two tokenisers by the bytes they cover.

Both libraries name the part of the text that a token covers: ``tokenizers`` in characters, ``sentencepiece`` in bytes (the
spans of its text proto; the installed release gives them as ``offset_mapping``, the immutable proto itself is gone from it).
These spans are the coarse cuts. A token that holds only some bytes of a character shares its span with others, or has an
empty one; such tokens are placed by their decoded bytes. Where tokens of both sides end together the text is cut into groups.

A single space between two signs that are no white space begins a new token on both sides (``Aligner`` checks the vocabulary for it),
so a text is aligned segment by segment: a segment seen before is looked up, and the new ones of a batch are encoded in runs. That gives
the same tokens as the whole text.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import ROW_KEY, discard, load, pick, stored, utf8
from reviewlake.llm.registry import query
from reviewlake.llm.token_counts import byte_letters

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Segments a task remembers (twice as many while it forgets the older ones), the longest of them in code points, and how many new ones are encoded in one run.
REMEMBERED, REMEMBERED_CHARS, RUN = 250_000, 64, 2_000
#: The table of pair counts is broadcast up to so many rows (about 50 bytes each), and joined by a shuffle beyond.
BROADCAST_PAIRS = 500_000
#: Into how many keys a pair is split in that shuffle: a frequent pair stands in nearly every document.
SALTS = 16
#: Tokens A and B of a pair as one number.
_B_IDS = 1 << 24
#: Signs next to which a space may share a token with others.
_UNSURE = "\\s\u180e\u200b-\u200f\u2581\ufeff"
_CUT = re.compile(f" (?<=[^{_UNSURE}] )(?=[^{_UNSURE}])")
#: Segments that single spaces may part from others: they begin and end with a sign that is sure.
_PLAIN = re.compile(f"[^{_UNSURE}](?:.*[^{_UNSURE}])?", re.DOTALL).fullmatch


def token_ends(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes. ``spans``: rows (begin, end); ``sizes``: how many bytes each token decodes to.

    A span that its token's bytes fill is a cut. Other tokens share their span's characters with neighbours: they end behind the
    last cut by as many bytes as they and those between decode to.
    """
    clean = spans[:, 1] - spans[:, 0] == sizes
    done = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(sizes)), -1))
    return np.where(last >= 0, spans[last, 1] + done - done[last], done)


def byte_places(text: str) -> np.ndarray:
    """Byte offset of every code point of the text, and its length in bytes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))])


class Aligner(dict):
    """Segment -> (n_a, n_b, n_groups, groups as text, linked pairs of ids), or None if the tokens' bytes are not the segment's."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        super().__init__()
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: added.get(i) or bytes(letters[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_text, self.b_text = {i: str(i) for i in self.a_bytes}, list(map(str, range(len(pieces))))
        self.older: dict[str, tuple | None] = {}

    def segments(self, text: str) -> list[str]:
        return _CUT.split(text) if self.splits else [text]

    def tokens(self, text: str) -> tuple[list[int], np.ndarray, list[int], np.ndarray] | None:
        """Ids and ends of both sides over the bytes of space and text; None if either side's bytes differ from them."""
        rest = utf8(text)
        data = b" " + rest
        coded = self.a.encode(" " + text, add_special_tokens=False)
        a = coded.ids
        a_pieces = list(map(self.a_bytes.__getitem__, a))
        mapped = self.b.encode(rest, return_type="offset_mapping", return_bytes=True)
        b = mapped["ids"]
        b_pieces = list(map(self.b_bytes.__getitem__, b))
        if b"".join(a_pieces) != data or b"".join(b_pieces) != data:
            return None
        spans = [np.fromiter(chain.from_iterable(x), np.int64).reshape(-1, 2) for x in (coded.offsets, mapped["offsets"])]
        if len(data) != len(text) + 1:
            spans[0] = byte_places(" " + text)[spans[0]]
        # B's spans know nothing of the space that it puts in front.
        spans[1] += 1
        spans[1][0, 0] = 0
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_pieces, b_pieces)]
        return a, token_ends(spans[0], sizes[0]), b, token_ends(spans[1], sizes[1])

    def align(self, run: list[str]) -> list[tuple | None]:
        """The entry of each segment of a run, encoded with single spaces between them."""
        found = self.tokens(" ".join(run))
        ends = np.cumsum([len(utf8(s)) + 1 for s in run])
        cuts = np.intersect1d(found[1], found[3], assume_unique=True) if found else ends[:0]
        if not found or not np.isin(ends, cuts).all():
            # Some segment is none that tokens keep to: each by itself.
            return [None] if len(run) == 1 else [e for s in run for e in self.align([s])]
        a, a_ends, b, b_ends = found
        i, j = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        pairs = np.array(a, np.int64)[i] * _B_IDS + np.array(b, np.int64)[j]
        a_text, b_text = list(map(self.a_text.__getitem__, a)), list(map(self.b_text.__getitem__, b))
        i, j = [0, *(i + 1).tolist()], [0, *(j + 1).tolist()]
        text = [f"{a_text[p]}|{b_text[q]}" if p2 - p == q2 - q == 1 else ",".join(a_text[p:p2]) + "|" + ",".join(b_text[q:q2])
                for p, p2, q, q2 in zip(i, i[1:], j, j[1:])]
        out, before = [], 0
        for g in (np.searchsorted(cuts, ends) + 1).tolist():
            out.append((i[g] - i[before], j[g] - j[before], g - before, ";".join(text[before:g]), pairs[before:g].tobytes()))
            before = g
        return out

    def learn(self, segments: set[str]) -> None:
        """Remember the short ones of these segments. What was not met again since the last time is forgotten."""
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        new = [s for s in segments if s not in self and len(s) <= REMEMBERED_CHARS and _PLAIN(s)]
        self.update((s, self.older[s]) for s in new if s in self.older)
        new = [s for s in new if s not in self.older]
        for at in range(0, len(new), RUN):
            self.update(zip(new[at:at + RUN], self.align(new[at:at + RUN])))

    def __missing__(self, segment: str):
        return self.align([segment])[0]

    def document(self, segments: list[str]) -> tuple[int, int, int, str, np.ndarray]:
        """(n_a, n_b, n_groups, groups, pairs of the links) of a whole text's segments."""
        parts = [self[s] for s in segments]
        if not parts or None in parts:
            return 0, 0, 0, "", np.empty(0, np.int64)
        a, b, n, groups, pairs = zip(*parts)
        return sum(a), sum(b), sum(n), ";".join(groups), np.frombuffer(b"".join(pairs), np.int64)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        split = [self.segments(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return map(self.document, split)


@lru_cache(maxsize=2)
def aligner(vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> Aligner:
    import public_tokenizers

    return Aligner(public_tokenizers.path(vocabulary_a), public_tokenizers.path(vocabulary_b))


def aligned(docs: DataFrame, keep_groups: bool, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Per row: its counts, the digest of its groups, and its distinct linked pairs with how often it holds them."""
    kinds = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
             ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), *([("groups", pa.string())] if keep_groups else [])]

    def run(source):
        model = aligner(vocabulary_a, vocabulary_b)
        # Nothing here makes cycles, and looking for them among the remembered segments takes a quarter of the time.
        gc.disable()
        try:
            yield from work(model, source)
        finally:
            gc.enable()

    def work(model: Aligner, source):
        for batch in source:
            rows = []
            for n_a, n_b, n_groups, groups, links in model.documents(batch.column(2).to_pylist()):
                pairs, times = np.unique(links, return_counts=True)
                rows.append((n_a, n_b, n_groups, hashlib.sha256(groups.encode()).hexdigest() if n_a else "", pairs, times, groups))
            columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [ROW_KEY, "doc_id", *(n for n, _ in kinds)])

    rows = pick(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), **{ROW_KEY: "long", "doc_id": "long", "text": "string"})
    schema = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * keep_groups
    return rows.mapInArrow(run, f"{ROW_KEY} long, doc_id long, {schema}")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best), a stored table: how many links of the corpus hold the pair, and whether no other pair of B's id has more."""
    counts = stored(links.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % _B_IDS), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    out = stored(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-best")
    discard(counts)
    return out


def dictionary(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Per linked pair of ids: a_id, b_id, count, best. Which token of one vocabulary stands for which of the other."""
    rows = aligned(docs, False, vocabulary_a, vocabulary_b).select(F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    return pair_counts(rows).select(F.floor(F.col("pair") / _B_IDS).cast("int").alias("a_id"), (F.col("pair") % _B_IDS).cast("int").alias("b_id"), "count", "best")


def align_tokens(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, keep_groups: bool = True) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups' ids if asked for.

    A encodes space and text, B the text; strings of special tokens are plain text. A group ends where tokens of both sides
    end; as no token is empty, one token of each side ends there, and these two are linked: n_links equals n_groups. Counts
    of pairs are over all rows. n_best: links whose pair has the highest count of those with its B id, ties included.

    A null or empty text has no tokens, nor has one that either tokeniser changes (U+2581 becomes a space): zeros and an empty
    digest. Rows that repeat an id, or have none, are rows of their own. Very long texts are worked whole, segment by segment; an
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = stored(aligned(docs, keep_groups, vocabulary_a, vocabulary_b), "token-alignment")
    links = rows.select(ROW_KEY, F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    counts = pair_counts(links.drop(ROW_KEY))
    if counts.count() <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), "pair")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = links.withColumn("salt", F.pmod(F.col(ROW_KEY), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = met.groupBy(ROW_KEY).agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, ROW_KEY, "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256", *(["groups"] if keep_groups else []))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(load(spark, sf_dir, "documents"), keep_groups=False)
