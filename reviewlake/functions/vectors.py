"""Vector arithmetic and score conversions; all scoring is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.text import col

EPSILON = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(col(a)), _doubles(col(b)), lambda x, y: x * y))


def squared_norm(a: Column | str) -> Column:
    return _sum(F.transform(_doubles(col(a)), lambda x: x * x))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Clamped cosine; 0 for a missing, empty, zero or differently sized vector."""
    a, b = col(a), col(b)
    na, nb = squared_norm(a), squared_norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > EPSILON) & (nb > EPSILON)
    value = dot(a, b) / (F.sqrt(na) * F.sqrt(nb))
    return F.when(F.coalesce(usable, F.lit(False)), clamp(value, -1.0, 1.0)).otherwise(F.lit(0.0))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_doubles(col(a)), _doubles(col(b)), lambda x, y: (x - y) * (x - y)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    # greatest and least skip nulls, so an absent score must be kept absent by hand.
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def document_similarity(distance: Column | str) -> Column:
    return F.coalesce(clamp(1 - col(distance)), F.lit(0.5))


def code_similarity(distance: Column | str) -> Column:
    return F.coalesce(clamp(F.exp(-2 * col(distance))), F.lit(0.5))


def score_similarity(score: Column | str) -> Column:
    """Text-search scores saturate at 1; the code and document forms of the rule coincide on scores >= 0."""
    return F.coalesce(clamp(col(score)), F.lit(0.5))


def issue_similarity(cosine: Column | str, word: Column | str) -> Column:
    """0.7 semantic + 0.3 word overlap; word overlap alone when there is no vector."""
    semantic = (col(cosine) + 1) / 2
    return F.coalesce(semantic * 0.7 + col(word) * 0.3, col(word))
