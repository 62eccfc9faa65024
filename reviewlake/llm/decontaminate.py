"""Benchmark decontamination with a positional inverted index. DataFrame operations only.

The index stores one posting (document, position, term) for every document word that some benchmark item uses. A window of
ten item words is found by intersecting posting lists shifted by the word's offset, from the window's rarest term on: the
rarest list proposes places, the second rarest thins them out, and the rest confirm what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewlake.llm.common import ROW_KEY, ascii_lower_word, keyed, load, pick, small, stored
from reviewlake.llm.registry import query

WINDOW = 10
#: Everything that is not part of a word. Words are lower-cased after the split, so upper case counts as a letter here.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands before each document's words, so that documents without any posting are in the index too. Not a possible word.
_HEAD = "\x00"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _GAPS)


def _n_words(parts: Column) -> Column:
    """Words in the split: an empty first or last part stands for a text that begins or ends with a gap."""
    first = (F.element_at(parts, 1) == "").cast("long")
    last = ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("long")
    return F.size(parts) - first - last


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, wid, len, off, word) for each word of each distinct window; ``item`` is null for an item without id."""
    items = pick(benchmark, item_id="string", text="string").select("item_id", _split(F.col("text")).alias("parts"))
    words = items.select("item_id", F.filter(F.transform("parts", ascii_lower_word), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    runs = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("run"))
    runs = runs.distinct().select("item_id", F.sha2(F.concat_ws(" ", "run"), 256).alias("wid"), F.size("run").alias("len"), "run")
    return runs.select("item_id", "wid", "len", F.posexplode("run").alias("off", "word"))


def build_index(docs: DataFrame, terms: DataFrame, key: str | None = None) -> DataFrame:
    """Postings (rid, doc_id, n_words, pos, term) of the given terms, and one with term -1 for every document row.

    ``rid`` is the row's own key, so null and repeated ids do no harm; it is drawn once, as the index is written.
    """
    carry = ({key: "long"} if key else {}) | {"doc_id": "string", "text": "string"}
    rows = pick(docs, **carry).select("doc_id", (F.col(key) if key else F.monotonically_increasing_id()).alias("rid"), _split(F.col("text")).alias("parts"))
    rows = rows.select("rid", "doc_id", _n_words(F.col("parts")).alias("n_words"), F.concat(F.array(F.lit(_HEAD)), "parts").alias("parts"))
    each = rows.select("rid", "doc_id", "n_words", F.posexplode("parts").alias("pos", "word")).withColumn("word", ascii_lower_word(F.col("word")))
    return stored(each.join(terms, "word").select("rid", "doc_id", "n_words", "pos", "term"), "positional-index")


def phrase_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, wid, start, len) wherever all words of a window stand in a row. ``wanted``: (wid, len, off, term), stored."""
    postings = index.where("term >= 0").select("rid", "pos", "term")
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    ranked = wanted.join(small(stored(counts, "term-counts")), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy("wid").orderBy("n", "off")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min("n").over(W.partitionBy("wid")))
    ranked = stored(ranked.where("least > 0").select("wid", "len", "off", "term", "rank"), "ranked-terms")
    first = small(ranked.where("rank = 1").select("wid", "len", "off", "term"))
    second = ranked.where("rank = 2").select("wid", F.col("off").alias("off2"), F.col("term").alias("term2"))
    places = postings.join(first, "term").select("rid", "wid", "len", (F.col("pos") - F.col("off")).alias("start"))
    places = stored(places.join(small(second), "wid", "left"), "phrase-places")
    short = places.where("term2 is null").select("rid", "wid", "len", "start")
    thinned = places.where("term2 is not null").select("rid", "wid", "len", "start", (F.col("start") + F.col("off2")).alias("pos"), F.col("term2").alias("term"))
    rarer = postings.join(small(stored(second.select(F.col("term2").alias("term")).distinct(), "second-terms")), "term", "left_semi")
    thinned = stored(thinned.join(rarer, ["rid", "pos", "term"]).select("rid", "wid", "len", "start"), "phrase-thinned")
    more = small(ranked.where("rank > 2").select("wid", "off", "term"))
    checks = thinned.join(more, "wid").select("rid", "wid", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    there = postings.join(small(stored(thinned.select("rid").distinct(), "phrase-documents")), "rid", "left_semi")
    seen = checks.join(there, ["rid", "pos", "term"]).groupBy("rid", "wid", "start").agg(F.count("*").alias("seen"))
    whole = thinned.join(seen, ["rid", "wid", "start"], "left").where(F.coalesce("seen", F.lit(0)) + 2 == F.col("len"))
    return stored(short.union(whole.select("rid", "wid", "len", "start")), "phrase-matches")


def proximity_matches(index: DataFrame, first: int, second: int, distance: int) -> DataFrame:
    """(rid, pos, other) where two terms of the index stand at most ``distance`` words apart, in either order."""
    a = index.where(F.col("term") == first).select("rid", "pos")
    b = index.where(F.col("term") == second).select("rid", F.col("pos").alias("other"))
    reach = F.explode(F.array(*(F.lit(d) for d in range(-distance, distance + 1) if d or first == second)))
    return a.select("rid", "pos", reach.alias("d")).select("rid", "pos", (F.col("pos") + F.col("d")).alias("other")).join(b, ["rid", "other"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str | None = None) -> DataFrame:
    """Per document row: rid, doc_id (string), n_words, n_hit, n_items, items_sha256, contaminated.

    A null text or item has no words; an item of fewer words than a window is one window; a repeated item counts once, an
    item without id makes hits but no item. Rows that repeat an id each give a row.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    windows = stored(item_windows(benchmark, window), "benchmark-windows")
    # Numbered where they lie, as they are written: no task sees all terms.
    vocabulary = windows.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term"))
    head = docs.sparkSession.range(1).select(F.lit(_HEAD).alias("word"), F.lit(-1).cast("long").alias("term"))
    vocabulary = stored(vocabulary.union(head), "benchmark-terms")
    wanted = windows.select("wid", "len", "off", "word").distinct().join(vocabulary, "word").select("wid", "len", "off", "term")
    index = build_index(docs, small(vocabulary), key)
    found = phrase_matches(index, stored(wanted, "benchmark-wanted"))

    order = W.partitionBy("rid").orderBy("start", F.desc("len"))
    until = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = found.select("rid", "start", "len").distinct().withColumn("until", F.coalesce(until, F.col("start")))
    hits = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "until"))).alias("n_hit"))
    items = windows.where("item_id is not null").select("wid", "item_id").distinct()
    items = found.select("rid", "wid").distinct().join(items, "wid").groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return index.where("term = -1").select("rid", "doc_id", "n_words").join(hits, "rid", "left").join(items, "rid", "left").select(
        "rid", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that hold a benchmark window."""
    rows = keyed(docs, "decontaminate-documents")
    found = decontaminate(rows, benchmark, key=ROW_KEY).where("contaminated").select(F.col("rid").alias(ROW_KEY))
    return rows.join(small(stored(found, "contaminated")), ROW_KEY, "left_anti").drop(ROW_KEY)


_SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
OP5_SQL = rf"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, run, array_to_string(run, ' ') AS g, len(run) AS n
  FROM (SELECT item_id, w[i:i + 9] AS run FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0))),
docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wanted),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN wanted USING (g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN per USING (doc_id)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("rid").withColumn("doc_id", F.col("doc_id").cast("long"))
