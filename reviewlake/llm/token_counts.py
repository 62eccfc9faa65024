"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges.

The last token of a byte string's encoding is the one token that may follow the last token of the string before it: two
tokens may stand together if their joined bytes are encoded as just these two. So the encoding of every prefix follows from
those of shorter prefixes, count[i] = count[i - len(token)] + 1, and truncation and budget questions need no new encoding.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import load, pick, utf8
from reviewlake.llm.registry import query

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
_REMEMBERED = 400_000
_NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """The public vocabularies' letters for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Token counts of whole texts and of all their prefixes under one byte-level vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.made = {a + b: (a, b) for a, b in reversed(self.merges)}
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.longest = max(map(len, self.tokens))
        self.pieces = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special)))) if special else None
        self._spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._together: dict[tuple[bytes, bytes], bool] = {}
        self._counts: dict[str, int] = {}
        self._checked: set[bytes] = set()

    def encode(self, data: bytes) -> list[bytes]:
        """The tokens of a short byte string, merge by merge; only to learn which entries stand for their own bytes."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.merges.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts of a token along its first (0) or last (1) byte, smallest first, with the merge that takes each up."""
        known = self._spines.get((token, side))
        if known is None:
            known, part, taken = [], token, _NEVER
            while True:
                known.append((part, taken))
                if len(part) == 1:
                    break
                pair = self.made[part]
                part, taken = pair[side], self.merges[pair]
            known.reverse()
            self._spines[token, side] = known
        return known

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Whether two neighbouring tokens stay apart: no merge over their border comes before those that built them."""
        known = self._together.get((left, right))
        if known is None:
            if len(self._together) >= _REMEMBERED:
                self._together.clear()
            a, b, i, j, known = self._spine(left, 1), self._spine(right, 0), 0, 0, True
            while True:
                (x, x_taken), (y, y_taken) = a[i], b[j]
                rank = self.merges.get((x, y), _NEVER)
                # Equal merges run from left to right, so one that starts at x comes after x's own and before y's.
                if rank < x_taken and rank <= y_taken and rank < _NEVER:
                    known = False
                    break
                if x_taken == y_taken == _NEVER:
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            self._together[left, right] = known
        return known

    def piece_prefixes(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i], for one piece (a run that no merge crosses)."""
        counts, last, tokens, fit, longest = [0], [b""], self.tokens, self._fit, self.longest
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in tokens and self._own(token) and (start == 0 or fit(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def _own(self, token: bytes) -> bool:
        """Whether the token's bytes are encoded as this token; other entries are struck out once met."""
        if token not in self._checked:
            self._checked.add(token)
            if self.encode(token) != [token]:
                self.tokens.discard(token)
                return False
        return True

    def piece_count(self, piece: str) -> int:
        known = self._counts.get(piece)
        if known is None:
            if len(self._counts) >= _REMEMBERED:
                self._counts.clear()
            known = self.piece_prefixes(utf8(piece))[-1]
            if len(piece) <= 64:
                self._counts[piece] = known
        return known

    def _runs(self, text: str):
        """(run of ordinary text, whether a special token follows it)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at:m.start()], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.piece_count, self.pieces(text)))
        return sum(sum(map(self.piece_count, self.pieces(run))) + special for run, special in self._runs(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[:i] for every length in code points.

        Pieces depend on what follows in two places only: a run of white space leaves its last sign to the word behind it, and
        a contraction needs all its letters. There the prefix's own last pieces are counted afresh.
        """
        out, before = [0], 0
        for run, special in self._runs(text):
            at, piece_start, space_start, done, space_done = 0, 0, None, 0, 0
            for piece in self.pieces(run):
                data = utf8(piece)
                counts = self.piece_prefixes(data)
                ends = list(accumulate(len(utf8(c)) for c in piece))
                for j, char in enumerate(piece):
                    if char.isspace() and not "\x1c" <= char <= "\x1f":
                        if space_start is None:
                            space_start, space_done = at, done
                        own = run[space_start:at + 1]
                        out.append(before + space_done + sum(map(self.piece_count, self.pieces(own))))
                    else:
                        space_start = None
                        if piece[0] == "'":
                            own = run[piece_start:at + 1]
                            out.append(before + done + sum(map(self.piece_count, self.pieces(own))))
                        else:
                            out.append(before + done + counts[ends[j]])
                    at += 1
                done += counts[-1]
                piece_start = at
            before += done
            if special:
                token = self.special.match(text, len(out) - 1)[0]
                inner = self.prefix_counts_plain(run + token[:-1], len(run))
                out.extend(before - done + n for n in inner)
                before += 1
                out.append(before)
        return np.array(out, np.int64)

    def prefix_counts_plain(self, text: str, start: int) -> list[int]:
        """Counts of text[:i] for i in start + 1 .. len(text), the text being ordinary."""
        return [sum(map(self.piece_count, self.pieces(text[:i]))) for i in range(start + 1, len(text) + 1)]

    def fits(self, text: str, budget: int) -> int:
        """The length in code points of the longest prefix of at most ``budget`` tokens, from the counts of its pieces.

        Only the pieces around the budget are looked at letter by letter.
        """
        pieces = self.pieces(text)
        if self.special and self.special.search(text):
            counts = self.prefix_counts(text)
            return int(np.flatnonzero(counts <= budget)[-1])
        total, at = 0, 0
        for k, piece in enumerate(pieces):
            n = self.piece_count(piece)
            if total + n > budget:
                # The few pieces before and the one behind may be cut differently in a prefix.
                first = max(0, k - 3)
                head = sum(map(len, pieces[:first]))
                base = sum(map(self.piece_count, pieces[:first]))
                around = self.prefix_counts("".join(pieces[first:k + 2])) + base
                return head + int(np.flatnonzero(around <= budget)[-1])
            total, at = total + n, at + len(piece)
        return at


@lru_cache(maxsize=2)
def counter(vocabulary: str = VOCABULARY) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. A null text is empty. Rows that repeat an id each give a row.

    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    def run(source):
        counts = counter(vocabulary)
        for batch in source:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id and ``counts``, where counts[i] is the number of tokens of the first i code points."""
    def run(source):
        counts = counter(vocabulary)
        for batch in source:
            found = [counts.prefix_counts(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "counts"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, counts array<long>")


def within_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """Per row of a prefix table: doc_id and ``fits``, the longest prefix of at most ``budget`` tokens, without encoding."""
    return prefixes.select("doc_id", (F.array_max(F.filter(
        F.transform("counts", lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull()))).cast("long").alias("fits"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))
