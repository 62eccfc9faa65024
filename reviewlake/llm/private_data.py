"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns give spans of four kinds. The field scores whole candidate segments of up to seven neighbouring words by
features of the span as one (digits, grouping, check sum, spelt-out signs, context) and chooses boundaries and kinds jointly
by dynamic programming with bounded segment length. It is trained by maximum likelihood on zones of a bounded sample whose
labels come from the base patterns, and on the same zones with the signs of a span varied, so that it also finds spellings
that the patterns miss. A span is added if its marginal probability is high and it touches no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import load, pick
from reviewlake.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
#: Words in a segment at most, words of context around a digit or sign, and the probability from which a span is added.
SEGMENT_WORDS = 7
CONTEXT_WORDS = 3
ADD_FROM = 0.9
#: A candidate segment has so many characters at most; base spans have no such limit.
SPAN_CHARS = 120
#: The training sample: at most so many rows that hold a base span, at most so many zones from them.
SAMPLE_ROWS = 400
SAMPLE_ZONES = 500

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The same matches as the plain pattern; possessive, and only from the start of a run of digits, so that it takes linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that keep its rule."""
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() - m[0].count(" ") - m[0].count("-") <= 19 and luhn(m[0].replace(" ", "").replace("-", "")):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# --- the field -------------------------------------------------------------------------------------------------------------

#: A digit, a sign, a bracketed sign, or a spelt one: "at" before a name with "dot" or a dotted name.
_TRIGGER = re.compile(
    r"[0-9@]|[\[({](?:at|dot)[\])}]|(?<!\S)at[ \t]{1,3}(?:(?:[a-z0-9-]{1,63}[ \t]{1,3}dot[ \t]{1,3}){1,5}[a-z0-9-]{1,63}|[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,5})", re.I)
_WORD = re.compile(r"[^ \t-\r]+")
_SPACE = re.compile(r"[ \t-\r]")
#: Long stretches are worked through in pieces of so many words; each piece knows the words around those it answers for.
ZONE_WORDS = 64
_AT = re.compile(r"[\[({ ]\s?at\s?[\]}) ]", re.I)
_DOT = re.compile(r"[\[({ ]\s?dot\s?[\]}) ]", re.I)
_SPELT = re.compile(r"[^\s@\[({]+(?: at | ?[\[({] ?at ?[\])}] ?)[a-z0-9-]+(?:(?: dot | ?[\[({] ?dot ?[\])}] ?|\.)[a-z0-9-]+)+", re.I)
_NAMED = re.compile(r"[^\s]*[._0-9-]")
_ENDING = re.compile(r"[.\])} ][A-Za-z]{2,10}$")
_TAIL = re.compile(r"[0-9]{3}[). -]*[0-9]{3}[. -]*[0-9]{4}$")
_HEXISH = re.compile(r"[0-9][a-f]|[a-f][0-9]")
_BUCKETS = (1, 4, 8, 10, 11, 13, 16, 17, 20)


@dataclass
class Zone:
    """A stretch of words around digits or signs, and its candidate segments."""

    words: list[tuple[int, int]]
    segments: list[tuple[int, int, int, int]]  # first word, behind the last word, start, end (of the trimmed text)
    features: np.ndarray  # a row for each segment
    core: tuple[int, int]  # spans that begin with one of these words are this zone's to tell


def segment_features(text: str, start: int, end: int, words: int) -> list[float]:
    """Features of the whole span."""
    span = text[start:end]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    n = len(digits)
    plain = not any(c.isalpha() for c in span)
    at, dot = "@" in span, bool(_DOT.search(span))
    word_at = bool(_AT.search(span))
    whole = word_at and bool(_SPELT.fullmatch(span))
    bare = whole and not dot and " at " in span.lower()
    size = sum(n >= b for b in _BUCKETS)
    before = text[max(0, start - 3):start]
    return [
        1.0, *(float(size == i) for i in range(len(_BUCKETS) + 1)), *(float(words == i) for i in range(1, SEGMENT_WORDS + 1)),
        float(at), float(word_at), float(at and word_at), float(dot), float((at or word_at) and (dot or "." in span)),
        float((at or word_at) and bool(_ENDING.search(span))), float(plain), float(not plain and not (at or word_at)),
        float(plain and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and span.count(".") + span.count("[.]") >= 3),
        float(plain and 16 <= n <= 19 and luhn(digits)), float(plain and 16 <= n <= 19 and not luhn(digits)),
        float(span[:1] == "+"), float("(" in span), float(plain and 10 <= n <= 15 and bool(_TAIL.search(span))), float(plain and len(groups) == 1),
        float(bool(_HEXISH.search(span))), float("=" in before or '"' in before), float(span.count("(") != span.count(")")),
        float(whole), float(whole and bool(_NAMED.match(span))), float(word_at and not whole), float(bare), float(bare and bool(_NAMED.match(span))),
        float(word_at and text[end:end + 5].lower() == " dot "),
    ]


def zones(text: str) -> list[Zone]:
    """Zones of the whole text. Words far from any digit or sign, spelt signs included, are left outside and cost nothing."""
    out: list[Zone] = []
    done, spot = 0, _TRIGGER.search(text)
    while spot:
        left, right = _reach(text, spot.start(), -CONTEXT_WORDS, done), spot.start()
        while spot and spot.start() <= right:
            right = _reach(text, spot.end(), CONTEXT_WORDS, len(text))
            gap = _SPACE.search(text, spot.end())
            spot = _TRIGGER.search(text, gap.start()) if gap else None
        out += make_zones(text, left, right)
        done = right
    return out


def _reach(text: str, at: int, words: int, limit: int) -> int:
    """The place ``words`` white-space gaps before (negative) or behind a position, within the line and ``limit``."""
    step, gaps, end = (-1 if words < 0 else 1), abs(words), at
    while end > limit if step < 0 else end < limit:
        c = text[end - 1] if step < 0 else text[end]
        if c == "\n" or c in " \t\r\x0b\f" and gaps == 0:
            break
        gaps -= c in " \t\r\x0b\f"
        end += step
    return end


def make_zones(text: str, left: int, right: int) -> list[Zone]:
    words = [m.span() for m in _WORD.finditer(text, left, right)]
    out, core = [], ZONE_WORDS - 2 * SEGMENT_WORDS
    for low in range(0, max(1, len(words)), core):
        first = max(0, low - SEGMENT_WORDS)
        out.append(make_zone(text, words[first:low + core + SEGMENT_WORDS], (low - first, low - first + core)))
    return out


def make_zone(text: str, words: list[tuple[int, int]], core: tuple[int, int]) -> Zone:
    marked, at = [False] * len(words), 0
    for m in _TRIGGER.finditer(text, words[0][0], words[-1][1]) if words else ():
        while words[at][1] <= m.start():
            at += 1
        for i in range(at, len(words)):
            if words[i][0] >= m.end():
                break
            marked[i] = True
    segments, rows = [], []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + SEGMENT_WORDS) + 1):
            # A span begins and ends with a word of its own; one without digit or sign, also spelt, is none.
            if not any(marked[i:j]) or words[j - 1][1] - words[i][0] > SPAN_CHARS:
                continue
            start, end = trim(text, words[i][0], words[j - 1][1])
            if start < words[i][1] and end > words[j - 1][0]:
                segments.append((i, j, start, end))
                rows.append(segment_features(text, start, end, j - i))
    return Zone(words, segments, np.array(rows, np.float64).reshape(len(rows), N_FEATURES), core)


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the punctuation around a span. A plus sign stays in front, an opening bracket if it is closed inside."""
    while start < end and not (text[start].isalnum() or text[start] == "+" or text[start] == "(" and text.find(")", start, end) >= 0):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


N_FEATURES = len(segment_features("1", 0, 1, 1))


def _logsumexp(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(sum(np.exp(v - top) for v in values))) if top > -np.inf else top


class SemiMarkovField:
    """Words outside score 0; a segment of kind y scores weights[:, y] . features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def start(cls) -> SemiMarkovField:
        return cls(np.zeros((N_FEATURES, len(KINDS))))

    def marginals(self, zone: Zone) -> tuple[float, np.ndarray]:
        """Log of the sum over all segmentations, and each segment's probability for each kind."""
        scores = zone.features @ self.weights
        kinds = np.logaddexp.reduce(scores, axis=1)
        n = len(zone.words)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _, _) in enumerate(zone.segments):
            ends[j].append(k)
            starts[i].append(k)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _logsumexp([forward[j - 1], *(forward[zone.segments[k][0]] + kinds[k] for k in ends[j])])
        for i in range(n - 1, -1, -1):
            backward[i] = _logsumexp([backward[i + 1], *(backward[zone.segments[k][1]] + kinds[k] for k in starts[i])])
        outer = np.array([forward[i] + backward[j] for i, j, _, _ in zone.segments])
        return forward[n], np.exp(outer[:, None] + scores - forward[n])

    def best(self, zone: Zone) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation."""
        if not zone.segments:
            return []
        scores = zone.features @ self.weights
        kind, top = scores.argmax(axis=1), scores.max(axis=1)
        value, chosen = [0.0] * (len(zone.words) + 1), [-1] * (len(zone.words) + 1)
        by_end: dict[int, list[int]] = {}
        for k, (_, j, _, _) in enumerate(zone.segments):
            by_end.setdefault(j, []).append(k)
        for j in range(1, len(zone.words) + 1):
            value[j] = value[j - 1]
            for k in by_end.get(j, ()):
                if value[zone.segments[k][0]] + top[k] > value[j]:
                    value[j], chosen[j] = value[zone.segments[k][0]] + top[k], k
        out, j = [], len(zone.words)
        while j > 0:
            if chosen[j] >= 0 and value[j] > value[j - 1]:
                out.append((chosen[j], int(kind[chosen[j]])))
                j = zone.segments[chosen[j]][0]
            else:
                j -= 1
        return out[::-1]

    def train(self, examples: list[tuple[Zone, list[tuple[int, int]]]], rounds: int = 25, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Maximum likelihood: observed minus expected features, by AdaGrad over the zones in order."""
        squares = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            for zone, gold in examples:
                if not zone.segments:
                    continue
                difference = -self.marginals(zone)[1]
                for segment, kind in gold:
                    difference[segment, kind] += 1
                step = zone.features.T @ difference - decay * self.weights
                squares += step ** 2
                self.weights += rate * step / np.sqrt(squares)


def gold_segments(zone: Zone, spans: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]] | None:
    """The labelled spans as segments of the zone; None if one of them is no candidate."""
    at = {(s, e): k for k, (_, _, s, e) in enumerate(zone.segments)}
    out, low, high = [], zone.words[0][0] if zone.words else 0, zone.words[-1][1] if zone.words else 0
    for kind, found in spans.items():
        for span in found:
            if span[0] < high and span[1] > low:
                if span not in at:
                    return None
                out.append((at[span], KINDS.index(kind)))
    return out


#: Names with digits become names without, so that digits are no condition of a spelt address.
_LETTERS = str.maketrans("0123456789", "abcdefghij")


def _spelt(address: str, at: str, dot: str) -> str:
    name, _, host = address.partition("@")
    return name + at + host.replace(".", dot)


def _plain(address: str) -> str:
    """Without digits, and at a host of two parts."""
    name, _, host = address.translate(_LETTERS).partition("@")
    return name + "@" + ".".join(host.split(".")[-2:])


def nameless(text: str) -> str:
    """The text with "at" and the host in place of its addresses: no address any more."""
    out, last = [], 0
    for start, end in emails(text):
        out += [text[last:start], "at ", text[text.index("@", start) + 1:end]]
        last = end
    return "".join([*out, text[last:]])


def varied(text: str, spans: dict[str, list[tuple[int, int]]], turn: int) -> tuple[str, dict[str, list[tuple[int, int]]]]:
    """The same text with the signs of its spans written in another way, the ``turn``-th of those known for the kind."""
    signs = [lambda s: _spelt(s, " at ", " dot "), lambda s: _spelt(s, " [at] ", " [dot] "), lambda s: _spelt(s, "(at)", "."), lambda s: _spelt(s, " at ", ".")]
    ways = {
        "email": [*signs, *(lambda s, way=way: way(_plain(s)) for way in signs)],
        "ip": [lambda s: s.replace(".", "[.]"), lambda s: s, lambda s: s.replace(".", " . ")],
        "card": [lambda s: ".".join(re.findall(".{1,4}", re.sub("[ -]", "", s))), lambda s: " ".join(re.findall(".{1,4}", re.sub("[ -]", "", s))), lambda s: s],
        "phone": [lambda s: re.sub(r"^\+\d+[ .-]*", "", s), lambda s: re.sub(r"[() -]+", ".", re.sub(r"^\+\d+[ .-]*\(?", "", s)), lambda s: re.sub(r"[() -]+", "-", re.sub(r"^\+\d+[ .-]*\(?", "", s))],
    }
    out, moved, last = [], {k: [] for k in KINDS}, 0
    for start, end, kind in sorted((s, e, k) for k, found in spans.items() for s, e in found):
        if start < last:
            continue
        out.append(text[last:start])
        new, begin = ways[kind][turn % len(ways[kind])](text[start:end]), sum(map(len, out))
        out.append(new)
        moved[kind].append((begin, begin + len(new)))
        last = end
    return "".join([*out, text[last:]]), moved


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> SemiMarkovField:
    """A field learnt from at most ``rows`` texts that hold a digit and @ or + or a dotted number, in hash order."""
    plain = pick(docs, doc_id="long", text="string").where(F.col("text").rlike(r"@[A-Za-z0-9]|\+[0-9]|[0-9]\.[0-9]|[0-9]{12}"))
    place = F.regexp_instr("text", F.lit(r"[^\s]+@[A-Za-z0-9]|\+[0-9]|[0-9]+\.[0-9]|[0-9]{12}"))
    near = plain.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").substr(F.greatest(F.lit(1), place - 120), F.lit(400)).alias("near"))
    texts = [r.near for r in near.orderBy("h", "near").limit(rows).collect()]
    examples = []
    for turn, text in enumerate(texts):
        other = nameless(text)
        turns = (turn, turn + 4) if emails(text) else (turn,)
        for version, spans in ((text, base_spans(text)), *(varied(text, base_spans(text), t) for t in turns), *([(other, base_spans(other))] if other != text else [])):
            for zone in zones(version)[:8]:
                gold = gold_segments(zone, spans)
                if gold is not None:
                    examples.append((zone, gold))
    field = SemiMarkovField.start()
    field.train(sorted(examples, key=lambda x: -len(x[1]))[:SAMPLE_ZONES // 2] + [x for x in examples if not x[1]][:SAMPLE_ZONES // 2])
    return field


def all_spans(text: str, field: SemiMarkovField) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and the spans that the field adds."""
    base = base_spans(text)
    taken = sorted(s for found in base.values() for s in found)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    last = 0
    for zone in zones(text):
        if not zone.segments:
            continue
        near = taken[bisect_right(ends, zone.words[0][0]):bisect_left(starts, zone.words[-1][1])]
        free = [k for k, (_, _, a, b) in enumerate(zone.segments) if not any(s < b and a < e for s, e in near)]
        if not free or (zone.features[free] @ field.weights).max() <= 0:
            continue
        best = field.best(zone)
        if best:
            free, sure = set(free), field.marginals(zone)[1]
            for segment, kind in best:
                first, _, start, end = zone.segments[segment]
                if segment in free and zone.core[0] <= first < zone.core[1] and start >= last and sure[segment, kind] >= ADD_FROM:
                    added[KINDS[kind]].append((start, end))
                    last = end
    return base, added


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def find_private(docs: DataFrame, field: SemiMarkovField | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all spans).

    A null text is empty. Rows that repeat an id each give a row. Places count code points.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast((field or fit(docs)).weights)

    def run(source):
        own = SemiMarkovField(weights.value)
        for batch in source:
            counts, sha, every = [], [], []
            for text in batch.column(1).to_pylist():
                base, added = all_spans(text or "", own)
                counts.append([len(base[k]) for k in KINDS])
                sha.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                every.append(_listed({k: base[k] + added[k] for k in KINDS}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(sha, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, field: SemiMarkovField) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    base, added = all_spans(text, field)
    out, last = [], 0
    for start, minus, kind in sorted((s, -e, k) for found in (base, added) for k in KINDS for s, e in found[k]):
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
            last = -minus
        elif -minus > last:
            last = -minus
    return "".join([*out, text[last:]])


def mask_private(docs: DataFrame, field: SemiMarkovField | None = None) -> DataFrame:
    """``docs`` with all its columns; spans in ``text`` are masked and ``n_chars`` (if there) counts anew. Null stays null."""
    weights = docs.sparkSession.sparkContext.broadcast((field or fit(docs)).weights)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(source):
        own = SemiMarkovField(weights.value)
        for batch in source:
            texts = [None if t is None else masked(t, own) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if size_at is not None:
                columns[size_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return plain.mapInArrow(run, T.StructType(list(plain.schema.fields))).toDF(*names)


@query("op4_private_data")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(load(spark, sf_dir, "documents"))
