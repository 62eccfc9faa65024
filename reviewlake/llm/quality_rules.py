"""Quality rules from tokeniser fertility: how a public vocabulary cuts a text tells whether it is prose.

Per document: code points per token, share of tokens that fall back to bytes, and entropy of the token distribution. Each
script has bands of its own, so that a script the vocabulary hardly knows is measured against its own kind. The bands are
documented parameters, set from percentiles with a margin, as a rule must not reject clean text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import load, pick, utf8
from reviewlake.llm.registry import query

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"
_REMEMBERED = 200_000


@dataclass(frozen=True)
class Band:
    """Limits that clean text of a script keeps. Entropy is judged against the most that so many tokens could have."""

    chars_low: float
    chars_high: float
    fallback_high: float
    entropy_low: float


#: By script: the one whose code point ranges (below) hold most of the text's letters. A low limit lies 0.15 characters (0.08 of
#: entropy) below the 0.1st percentile of the rows that pass the base rules (``bands_seen``), where a script has rows enough to tell:
#: Latin has 1.80 characters a token and 0.48 there, random letters 1.56 to 1.63, consonants 1.44, base64 1.21. The others are wide.
BANDS = {
    "Latin": Band(1.64, 8.0, 0.10, 0.40),
    "Cyrillic": Band(1.0, 8.0, 0.10, 0.35),
    "Greek": Band(0.6, 6.0, 0.30, 0.40),
    "Han": Band(0.4, 3.0, 0.60, 0.40),
    "Arabic": Band(0.5, 5.0, 0.40, 0.40),
    "": Band(0.3, 8.0, 0.80, 0.35),
}
#: First code point of a range of letters, the first one behind it, and the script.
_RANGES = (
    (0x41, 0x5B, "Latin"), (0x61, 0x7B, "Latin"), (0xC0, 0xD7, "Latin"), (0xD8, 0xF7, "Latin"), (0xF8, 0x250, "Latin"),
    (0x370, 0x400, "Greek"), (0x400, 0x530, "Cyrillic"), (0x600, 0x700, "Arabic"), (0x750, 0x780, "Arabic"),
    (0x1E00, 0x1F00, "Latin"), (0x1F00, 0x2000, "Greek"), (0x3400, 0x4DC0, "Han"), (0x4E00, 0xA000, "Han"), (0x20000, 0x2FA20, "Han"),
)
_EDGES = np.array([e for low, high, _ in _RANGES for e in (low, high)])


class Fertility:
    """Token statistics of texts, word by word: the vocabulary never joins a piece over white space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[bytes, tuple[int, ...]] = {}

    def tokens(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            found = tuple(self.model.encode(word.decode("utf-8", "replace")))
            if len(word) <= 64:
                self.known[word] = found
        return found

    def measure(self, counts: Counter) -> tuple[int, float, float]:
        """(tokens, share of byte fallbacks, entropy in bits over the most possible) of a bag of words."""
        ids: list[int] = []
        weights: list[int] = []
        for word, n in counts.items():
            found = self.tokens(word)
            ids += found
            weights += [n] * len(found)
        total = sum(weights)
        if not total:
            return 0, 0.0, 1.0
        index = np.array(ids)
        each = np.bincount(index, weights)
        fallback = float(each[self.is_byte[:len(each)]].sum()) / total
        p = each[each > 0] / total
        return total, fallback, float(-(p * np.log2(p)).sum()) / max(1.0, np.log2(min(total, len(self.is_byte))))


@lru_cache(maxsize=2)
def fertility(vocabulary: str = VOCABULARY) -> Fertility:
    import public_tokenizers

    return Fertility(public_tokenizers.path(vocabulary))


def script_of(text: str) -> str:
    """The script of most letters of the whole text; "" if it has none of the known ones."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    slots = np.bincount(np.searchsorted(_EDGES, points, side="right"), minlength=len(_EDGES) + 1)
    found = Counter()
    for i, (_, _, name) in enumerate(_RANGES):
        found[name] += int(slots[2 * i + 1])
    name, most = max(sorted(found.items()), key=lambda x: x[1])
    return name if most else ""


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words stand in a window of ``size`` words that occurs twice or more in the text."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(words) - size + 1
    keys = ids[:n].copy()
    for i in range(1, size):
        # Numbered anew after each word, so that keys are exact and never overflow.
        keys = np.unique(keys * len(numbers) + ids[i:n + i], return_inverse=True)[1].astype(np.int64)
    twice = np.bincount(keys)[keys] > 1
    depth = np.zeros(len(words) + 1, np.int64)
    depth[:n] += twice
    depth[size:size + n] -= twice
    return int((np.cumsum(depth)[:len(words)] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def within(band: Band, chars: int, tokens: int, fallback: float, entropy: float) -> bool:
    if not tokens:
        return True
    return band.chars_low <= chars / tokens <= band.chars_high and fallback <= band.fallback_high and entropy >= band.entropy_low


def assess(docs: DataFrame, bands: dict[str, Band] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, and the measures behind the verdict.

    A null or blank text has no words and fails the base rules. Rows that repeat an id each give a row.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    limits = bands or BANDS
    kinds = [("doc_id", "long"), ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
             ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("script", "string"), ("n_pieces", "long"),
             ("chars_per_token", "double"), ("fallback_share", "double"), ("token_entropy", "double")]

    def one(text: str, measure: Fertility) -> tuple:
        words = utf8(text).split()
        chars = len(text) - sum(map(text.count, _SPACES))
        repeats = repeated_words(words)
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        script = script_of(text)
        tokens, fallback, entropy = measure.measure(Counter(words))
        kept = not failed and within(limits.get(script, limits[""]), chars, tokens, fallback, entropy)
        return (len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, failed, kept, script, tokens,
                chars / tokens if tokens else 0.0, fallback, entropy)

    def run(source):
        measure = fertility(vocabulary)
        for batch in source:
            columns = zip(*(one(t or "", measure) for t in batch.column(1).to_pylist()))
            types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, types[k]) for c, (_, k) in zip(columns, kinds[1:]))], [n for n, _ in kinds])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds))


def bands_seen(assessed: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per script: row count and outer percentiles of each measure over all rows, for setting bands for a new vocabulary."""
    return assessed.where("n_pieces > 0").groupBy("script").agg(F.count("*").alias("n"), *(
        F.percentile_approx(c, [low, high]).alias(c) for c in ("chars_per_token", "fallback_share", "token_entropy")))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(load(spark, sf_dir, "documents"))
