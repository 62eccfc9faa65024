"""Pluggable models, applied as vectorised UDFs.

An embedder is any picklable object with ``dim`` and ``__call__(texts) -> (n, dim) array``; a scorer
maps texts to probabilities; a completer maps request rows to response rows. The defaults need no
model files and are deterministic.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import constants as K
from reviewlake.functions.text import col, is_blank, let, truncate_tokens, verification_text, word_pattern, words
from reviewlake.operators.text_terms import pattern_candidates


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class _WordSlots(dict):
    """Slot of each word, remembered up to a fixed number of words: its bucket, behind all buckets if its sign is negative."""

    LIMIT = 300_000

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        digest = hashlib.md5(word.encode()).hexdigest()
        slot = self[word] = int(digest[:8], 16) % self.dim + self.dim * (int(digest[8], 16) % 2)
        return slot


class HashedWords:
    """Signed feature hashing of words: md5 picks the bucket and the sign, counts add up, L2-normalised.

    No text that is not blank is left without a vector: where the signed counts cancel out the plain counts stand, and a text
    without words has the empty word.
    """

    unit = True  # every vector has length 1

    def __init__(self, dim: int = 384):
        self.dim = dim
        self._slots = _WordSlots(dim)

    def __reduce__(self):
        # Tasks start without the words that were seen here.
        return type(self), (self.dim,)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower()) or [""]
            plus, minus = np.bincount(np.fromiter(map(self._slots.__getitem__, words), np.int64, len(words)), minlength=2 * self.dim).reshape(2, self.dim)
            out[row] = plus - minus
            if not out[row].any():
                out[row] = plus + minus
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embedding_udf(embedder: Embedder):
    """Text -> vector; null for blank text or text without any feature."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            usable = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            out: list = [None] * len(texts)
            if usable:
                vectors = np.asarray(embedder([texts.iloc[i] for i in usable]), dtype=np.float32)
                if vectors.shape != (len(usable), embedder.dim):
                    raise ValueError(f"embedder returned shape {vectors.shape}, expected dimension {embedder.dim}")
                for i, vector in zip(usable, vectors):
                    out[i] = vector if vector.any() else None
            yield pd.Series(out)

    return run


def embed(df: DataFrame, text: str, out: str = "vector", embedder: Embedder | None = None, distinct_first: bool = False):
    """Add a vector column.

    ``distinct_first`` embeds each different text once (keyed by its full hash) and joins back: worth
    its shuffle when the model is expensive or texts repeat, as titles do.
    """
    run = embedding_udf(embedder or HashedWords())
    if not distinct_first:
        return df.withColumn(out, run(col(text)))
    key = "__text_key"
    keyed = df.withColumn(key, F.sha2(col(text), 256))
    vectors = (
        keyed.where(~is_blank(text)).groupBy(key).agg(F.first(text).alias("__text"))
        .select(key, run("__text").alias(out))
    )
    return keyed.join(vectors, key, "left").drop(key)


def keyword_scores(text: Column | str, labels=K.DOMAIN_LABELS, min_score: float = 0.3) -> Column:
    """Default classifier: the share of a label's words that occur in the text, best first.

    Returns ``array<struct<confidence, domain>>``; ties keep label order.
    """
    def scores(text: Column) -> Column:
        scored = []
        for i, label in enumerate(labels):
            names = [w for w in re.split(r"[^a-z0-9]+", label.lower()) if len(w) > 1]
            # A plain look for the letters tells most texts; the pattern only decides whether they are a word.
            found = [(F.contains(text, F.lit(w)) & text.rlike(word_pattern(w))).cast("int") for w in names]
            hits = sum(found[1:], found[0])
            scored.append(F.struct(
                (hits / F.lit(float(len(names)))).alias("confidence"), F.lit(-i).alias("order"), F.lit(label).alias("domain")
            ))
        ranked = F.sort_array(F.filter(F.array(*scored), lambda s: s["confidence"] >= min_score), asc=False)
        return F.transform(ranked, lambda s: F.struct(s["domain"].alias("domain"), s["confidence"].alias("confidence")))

    return let(F.lower(F.coalesce(col(text), F.lit(""))), scores)


def technology_scores(text: Column | str, candidates: Column, min_score: float = 0.3) -> Column:
    """Default scorer of technology candidates: n / (n + 1) for n whole-word mentions, best first; ties keep their order.

    Returns ``array<struct<technology, confidence>>``. A model takes its place through the caller's ``technologies``.
    """
    text = F.coalesce(col(text), F.lit(""))

    def scored(name: Column, i: Column) -> Column:
        whole = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])\\Q"), name, F.lit("\\E(?![A-Za-z0-9_])"))
        n = F.regexp_count(text, whole)
        return F.struct((n / (n + 1)).alias("confidence"), (-i).alias("order"), name.alias("technology"))

    ranked = F.sort_array(F.filter(F.transform(candidates, scored), lambda s: s["confidence"] >= min_score), asc=False)
    return F.transform(ranked, lambda s: F.struct(s["technology"].alias("technology"), s["confidence"].alias("confidence")))


def mentioned_technologies(text: Column | str) -> Column:
    """Scores of the technology-like words of a text."""
    return technology_scores(text, pattern_candidates(text, list(K.ENGLISH_STOPWORDS)))


def dictionary_technologies(terms: Iterable[str], min_score: float = 0.3):
    """Scorer of the technologies of a fixed list, single words: n / (n + 1) for n occurrences of the word."""
    names = list(terms)

    def of(found: Column) -> Column:
        counted = [F.size(found) - F.size(F.array_remove(found, name.lower())) for name in names]
        scored = F.array(*(F.struct(F.lit(t).alias("technology"), (n / (n + 1)).alias("confidence")) for t, n in zip(names, counted)))
        return F.filter(scored, lambda x: x["confidence"] >= min_score)

    def scores(text: Column | str) -> Column:
        return let(words(text), of)

    return scores


def classifier_udf(score: Callable[[list[str], list[str]], np.ndarray], labels=K.DOMAIN_LABELS, min_score: float = 0.3):
    """Wrap a multi-label scorer ``(texts, labels) -> (n, labels)``; input is cut to its token limit."""
    labels = list(labels)

    @F.pandas_udf("array<struct<domain:string,confidence:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            scores = np.asarray(score([t or "" for t in texts], labels), dtype=float)
            yield pd.Series([
                [{"domain": labels[j], "confidence": float(row[j])}
                 for j in np.argsort(-row, kind="stable") if row[j] >= min_score]
                for row in scores
            ])

    return lambda text: run(truncate_tokens(text))


def verify_relevance(
    candidates: DataFrame, comment: str, code: str, score: Callable[[list[str]], np.ndarray] | None = None,
    threshold: float = 0.75,
) -> DataFrame:
    """Keep candidates a relevance scorer rates above ``threshold``; without a scorer all pass.

    A batch whose scoring fails passes whole, so a model error never hides a good match.
    """
    if score is None:
        return candidates

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(np.asarray(score(list(texts)), dtype=float))
        except Exception:  # noqa: BLE001 - any model failure means "keep"
            return pd.Series(np.full(len(texts), np.inf))

    text = truncate_tokens(verification_text(comment, code))
    return candidates.withColumn("__relevance", run(text)).where(F.col("__relevance") > threshold).drop("__relevance")


def complete(requests: DataFrame, client: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema) -> DataFrame:
    """Run a language-model client over request rows.

    ``client()`` is called once per task and returns a function from a batch of requests to a batch of
    responses with ``schema``. It must record failures in the rows: one bad request never fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for batch in batches:
            yield call(batch)

    return requests.mapInPandas(run, schema)
