"""Word-set similarity and the joins built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import col
from reviewlake.operators.knn import knn
from reviewlake.operators.models import Embedder, embed
from reviewlake.session import materialize

BROADCAST_WORDS = 500_000
#: Sets that hold one word, of either side, that a task compares with each other.
BLOCK = 2_000
#: Size of a set's bitmap in numbers of 64 bits.
BITMAP_LONGS = 4


def word_set(c: Column | str) -> Column:
    """Distinct lower-cased runs of over two word characters; everything else separates."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([A-Za-z0-9_]{3,})"), 1))


def set_jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    return set_jaccard(word_set(a), word_set(b))


def word_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words of both sides, a stored table: in how many sets of each side (``l_df``, ``r_df``) they stand."""
    def words(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select(F.explode("words").alias("word"), F.lit(int(is_left)).alias("l"), F.lit(int(not is_left)).alias("r"))

    counts = words(left, True).unionAll(words(right, False)).groupBy("word").agg(F.sum("l").alias("l_df"), F.sum("r").alias("r_df"))
    return materialize(counts.where((F.col("l_df") > 0) & (F.col("r_df") > 0)), "word-counts")


def candidate_sets(left: DataFrame, right: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Distinct pairs ``l, r`` of ``set_id`` that hold every pair of sets with a Jaccard similarity above ``threshold``.

    Both sides hold one row per distinct word set: ``set_id, words``. Words are ordered by the pairs they would make (sets of the
    left times sets of the right), so a word that one side lacks comes first and makes none. Two sets above the threshold share a word
    within the first ``n - ceil(threshold * n) + 1`` of each; their first common word leaves them enough words behind it
    (positional filter), and the bitmaps of the words that both sides know differ in no more bits than the words may (suffix filter).

    A word of more than ``block`` sets is many join keys: each side is dealt to parts of about ``block`` rows, and every part of
    the left meets every part of the right once.
    """
    counts = word_counts(left, right)
    if counts.count() <= BROADCAST_WORDS:
        counts = F.broadcast(counts)

    def prefixes(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        n, known = F.col("n"), F.col("known")
        words = df.select("set_id", F.size("words").alias("n"), F.explode("words").alias("word")).join(counts, "word").select(
            "set_id", "n", "word", own, other, (F.col("l_df") * F.col("r_df")).alias("cost"), F.xxhash64("word").alias("hash"))
        bit = F.expr("shiftleft(1L, cast(shiftright(hash, 32) & 63 AS int))")
        # A set is one text's words, so the list is short.
        ranked = words.groupBy("set_id", "n").agg(
            F.sort_array(F.collect_list(F.struct("cost", "word", own, other))).alias("ranked"), F.count("*").alias("known"),
            *(F.bit_or(F.when(F.pmod("hash", F.lit(BITMAP_LONGS)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"{name}_b{i}")
              for i in range(BITMAP_LONGS)))
        # Words that the other side lacks come first and fill places of the prefix.
        places = (known - F.ceil(n * threshold - 1e-9) + 1).cast("int")
        carried = [f"{name}_n", f"{name}_known", *(f"{name}_b{i}" for i in range(BITMAP_LONGS))]
        placed = ranked.where(places > 0).withColumnsRenamed({"set_id": name}).select(
            name, n.alias(f"{name}_n"), known.alias(f"{name}_known"), *carried[2:],
            F.posexplode(F.slice("ranked", F.lit(1), places)).alias(f"{name}_at", "w"))
        parts = [F.ceil(F.col(f"w.{c}") / block).cast("int") for c in (own, other)]
        return placed.select(
            name, f"{name}_at", *carried, F.col("w.word").alias("word"), F.pmod(F.xxhash64(name), parts[0]).cast("int").alias(f"{own[0]}_part"),
            F.explode(F.sequence(F.lit(0), parts[1] - 1)).alias(f"{other[0]}_part"))

    need = (F.col("l_n") + F.col("r_n")) * (threshold / (1 + threshold)) - 1e-9
    apart = sum((F.bit_count(F.col(f"l_b{i}").bitwiseXOR(F.col(f"r_b{i}"))) for i in range(BITMAP_LONGS)), F.lit(0))
    return prefixes(left, "l", "l_df", "r_df").join(prefixes(right, "r", "r_df", "l_df"), ["word", "l_part", "r_part"]).where(
        (F.least("l_n", "r_n") >= F.greatest("l_n", "r_n") * threshold - 1e-9)
        & (F.least(F.col("l_known") - F.col("l_at"), F.col("r_known") - F.col("r_at")) >= need)
        & (F.col("l_known") + F.col("r_known") - apart >= 2 * need)
    ).select("l", "r").distinct()


def best_word_matches(
    left: DataFrame, right: DataFrame, threshold: float, left_id: str = "id", right_id: str = "id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Per left row its most similar right row by word Jaccard above ``threshold``: ``id, match_id, similarity``.

    Exact set-similarity join. Equal word sets collapse to one first, so a block of copies is compared
    once; ``candidate_sets`` names the pairs that can be similar, and these are verified.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")

    def sets(df: DataFrame, id_col: str) -> DataFrame:
        words = F.sort_array(word_set(text))
        return df.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("set_id", F.md5(F.array_join("words", " ")))

    # Sets without words drop out after the write: a filter before it would compute every set twice.
    members = materialize(sets(left, left_id), "left-words").where(F.size("words") > 0)
    sources = materialize(members.groupBy("set_id").agg(F.first("words").alias("words")), "left-sets")
    targets = materialize(
        sets(right, right_id).groupBy("set_id").agg(F.min("id").alias("match_id"), F.first("words").alias("words")), "right-sets",
    ).where(F.size("words") > 0)
    verified = (
        candidate_sets(sources, targets, threshold, block)
        .join(sources.select(F.col("set_id").alias("l"), F.col("words").alias("lw")), "l")
        .join(targets.select(F.col("set_id").alias("r"), F.col("words").alias("rw"), "match_id"), "r")
        .select("l", "match_id", set_jaccard(F.col("lw"), F.col("rw")).alias("similarity"))
        .where(F.col("similarity") > threshold)
    )
    best = verified.groupBy("l").agg(
        F.min_by(F.struct("match_id", "similarity"), F.struct(-F.col("similarity"), F.col("match_id"))).alias("b"))
    return members.select("id", "set_id").join(best, F.col("set_id") == F.col("l")).select("id", "b.match_id", "b.similarity")


def filter_dismissed(
    issues: DataFrame, dismissed: DataFrame, threshold: float = 0.7, embedder: Embedder | None = None, id_col: str = "id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(issues unlike every dismissed one, the best match of each dropped issue).

    With an embedder the similarity is ``(cosine + 1) / 2`` of the nearest dismissed issue; without one
    it is word Jaccard. Vectors of an embedder whose ``unit`` is true are compared as they are stored.
    """
    if embedder is None:
        matches = best_word_matches(issues, dismissed, threshold, id_col, id_col, text)
    else:
        q = embed(issues.select(F.col(id_col).alias("query_id"), text), text, embedder=embedder)
        d = embed(dismissed.select(F.col(id_col).alias("id"), text), text, embedder=embedder)
        near = knn(q, d, 1, cosine=not getattr(embedder, "unit", False))
        matches = near.select(
            F.col("query_id").alias("id"), F.col("id").alias("match_id"), (1 - F.col("distance") / 4).alias("similarity")
        ).where(F.col("similarity") > threshold)
    kept = issues.join(matches.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return kept, matches
