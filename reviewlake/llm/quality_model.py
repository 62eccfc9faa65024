"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the output is linear in the mean of
the vectors, a word adds the same two numbers to every document it stands in; these are worked out once per word.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import hash_sample, load, pick, utf8
from reviewlake.llm.registry import query

BUCKETS = 1 << 16
DIMENSION = 8
NGRAMS = (3, 4)
#: The training sample: at most so many rows of each class, each with at most so many characters from a hashed place on.
ROWS_PER_CLASS = 1200
SAMPLE_CHARS = 20_000
EPOCHS = 6
#: A pair of equal neighbouring words is one bigram whatever the word: a mark of its own, as heavy as so many n-grams.
AGAIN = b"\x00again"
AGAIN_WEIGHT = 4
_REMEMBERED = 300_000


def bucket(gram: bytes) -> int:
    return xxhash.xxh3_64_intdigest(gram) % BUCKETS


def word_features(word: bytes) -> np.ndarray:
    """Hashed buckets of the word and of its character n-grams with word borders."""
    text = "<" + word.decode("utf-8", "replace") + ">"
    grams = [word] + [utf8(text[i:i + n]) for n in NGRAMS for i in range(len(text) - n + 1)]
    return np.array([bucket(g) for g in grams], np.int64)


def repeats(words: list[bytes]) -> int:
    """Weight of the repetition mark: how often a word follows itself."""
    return AGAIN_WEIGHT * sum(map(eq, words, words[1:]))


@dataclass
class QualityModel:
    vectors: np.ndarray  # BUCKETS x DIMENSION
    weights: np.ndarray  # DIMENSION x 2
    bias: np.ndarray  # 2

    def __post_init__(self):
        margin = self.weights[:, 1] - self.weights[:, 0]
        self.feature_margin = self.vectors @ margin
        self.bias_margin = float(self.bias[1] - self.bias[0])
        self.again_margin = float(self.feature_margin[bucket(AGAIN)])
        self._words: dict[bytes, tuple[float, int]] = {}

    def word_margin(self, word: bytes) -> tuple[float, int]:
        known = self._words.get(word)
        if known is None:
            if len(self._words) >= _REMEMBERED:
                self._words.clear()
            features = word_features(word)
            known = float(self.feature_margin[features].sum()), len(features)
            if len(word) <= 64:
                self._words[word] = known
        return known

    def score(self, text: str | None) -> float:
        """Probability of label 1; that of the bias alone for a text without words."""
        total, n, margin = 0.0, 0, self.word_margin
        words = utf8(text or "").split()
        for word, count in Counter(words).items():
            m, k = margin(word)
            total += m * count
            n += k * count
        again = repeats(words)
        total += again * self.again_margin
        n += again
        z = self.bias_margin + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    def packed(self) -> tuple[np.ndarray, ...]:
        return self.vectors.astype(np.float32), self.weights, self.bias


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    words = utf8(text).split()
    found = [np.full(repeats(words), bucket(AGAIN))]
    for word, n in Counter(words).items():
        found.append(np.repeat(word_features(word), n))
    features, counts = np.unique(np.concatenate(found), return_counts=True)
    return features, (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 30.0, seed: int = 11) -> QualityModel:
    """Plain stochastic gradient descent on cross-entropy, classes weighted alike; the rate falls to zero linearly."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    weights, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    if not labels or len(set(labels)) < 2:
        # Without two classes there is nothing to tell apart: the bias alone speaks.
        share = (sum(labels) + 1) / (len(labels) + 2)
        return QualityModel(vectors, weights, np.array([0, np.log(share / (1 - share))], np.float32))
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    bags = [bag(t) for t in texts]
    size = Counter(labels)
    balance = {k: len(labels) / (2 * n) for k, n in size.items()}
    steps, at = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            features, shares = bags[i]
            lr = rate * (1 - at / steps)
            at += 1
            hidden = shares @ vectors[features] if len(features) else np.zeros(DIMENSION, np.float32)
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= balance[labels[i]]
            back = weights @ p
            weights -= 0.05 * lr / rate * np.outer(hidden, p) * 10
            bias -= 0.05 * lr / rate * p
            if len(features):
                vectors[features] -= lr * shares[:, None] * back[None, :]
    return QualityModel(vectors, weights, bias)


def held_out(id_column: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, label): at most ``rows`` rows of each label in the order of a hash of the id, none of them held out."""
    marks = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    marks = hash_sample(marks, "label", rows)
    text = F.coalesce("text", F.lit(""))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.char_length(text) - chars + 1)) + 1
    found = pick(docs, doc_id="long", text="string").join(F.broadcast(marks), "doc_id")
    return found.select("doc_id", text.substr(start.cast("int"), F.lit(chars)).alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from a sample of 2 * ROWS_PER_CLASS rows at most, whatever the table's size."""
    rows = sorted(map(tuple, sample(docs, labels).collect()))
    return train([t for _, t, _ in rows], [k for _, _, k in rows])


def scored(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score appended. Only the text is looked at."""
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    parts = docs.sparkSession.sparkContext.broadcast(model.packed())

    def run(source):
        own = QualityModel(*parts.value)
        for batch in source:
            scores = [own.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Labels may be null, repeated (the lower one counts) or of one class only (the bias alone decides then). A null or blank
    text gets the score of the bias. Rows that repeat an id each give a row.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    found = scored(pick(docs, doc_id="long", text="string"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
