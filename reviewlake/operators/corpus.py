"""Incremental corpus maintenance: what changed, what to drop, what to keep, and fingerprints of it.

Every operator is a join or a partially aggregated group-by on keys of the corpus. Vectors are never
carried through these jobs: pass the metadata columns and join the survivors back by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import is_blank, or_default
from reviewlake.operators.topk import best_per_key
from reviewlake.session import materialize

FILE_KEYS = ["project_path", "path"]
STRUCTURE_TYPE = "directory-structure"


def diff_inventory(current: DataFrame, existing: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """Per key: ``new``, ``changed``, ``unchanged``, ``skipped_empty`` or ``deleted``.

    ``current`` has the keys, ``content_hash`` and optionally ``is_empty``; ``existing`` may hold several
    versions of a path, and so may ``current``: each is unchanged when any stored version of its path has its hash.
    """
    empty = F.coalesce(F.col("is_empty"), F.lit(False)) if "is_empty" in current.columns else F.lit(False)
    now = current.select(*keys, F.col("content_hash").alias("new_hash"), empty.alias("is_empty"), F.lit(True).alias("in_now"))
    # One row per stored key, and one per stored key and hash: versions do not multiply rows.
    stored = existing.select(*keys, F.col("content_hash").alias("new_hash")).distinct()
    same = stored.withColumn("same", F.lit(True))
    known = stored.select(*keys).distinct().withColumn("in_stored", F.lit(True))
    status = (
        F.when(F.col("in_now").isNull(), "deleted").when(F.col("is_empty"), "skipped_empty")
        .when(F.col("same"), "unchanged").when(F.col("in_stored"), "changed").otherwise("new")
    )
    return now.join(known, keys, "full_outer").join(same, [*keys, "new_hash"], "left").select(
        *keys, F.col("new_hash").alias("content_hash"), status.alias("status")
    )


def outdated_versions(existing: DataFrame, inventory: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """Stored rows to delete because their path changed."""
    return existing.join(inventory.where(F.col("status") == "changed").select(*keys), keys, "left_semi")


def _live_or(existing: DataFrame, live: DataFrame, keys: list[str], exempt: Column) -> DataFrame:
    """Rows of ``existing`` that are exempt or have live keys. ``existing``, which may be much work, is read once."""
    marked = live.select(*keys).distinct().withColumn("__live", F.lit(True))
    return existing.join(marked, keys, "left").where(F.coalesce(exempt, F.lit(False)) | F.col("__live")).drop("__live")


def prune_files(existing: DataFrame, live: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """Rows to keep: live paths, structure rows and rows without a path."""
    return _live_or(existing, live, keys, (F.col("type") == STRUCTURE_TYPE) | F.col("path").isNull())


def prune_chunks(existing: DataFrame, live: DataFrame, keys=("project_path", "original_document_path")) -> DataFrame:
    keys = list(keys)
    return _live_or(existing, live, keys, F.col(keys[-1]).isNull())


def document_signature(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted ``id:hash`` of a document's chunks; a document is at most 5 MiB, so the list is small."""
    item = F.concat(F.col("id"), F.lit(":"), F.col("content_hash"))
    return chunks.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(item)), "|").alias("signature"), F.count("*").alias("n_chunks")
    )


def diff_documents(current: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Per current document: ``unchanged`` or ``replace`` (all its stored chunks are replaced)."""
    old = document_signature(existing, keys).select(*keys, F.col("signature").alias("old"))
    return document_signature(current, keys).join(old, keys, "left").select(
        *keys, "n_chunks", F.when(F.col("signature") == F.col("old"), "unchanged").otherwise("replace").alias("status")
    )


def replace_documents(existing: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """The chunk table after the refresh."""
    changed = diff_documents(current, existing, keys).where("status = 'replace'").select(*keys)
    return existing.join(changed, keys, "left_anti").unionByName(
        current.join(changed, keys, "left_semi"), allowMissingColumns=True
    )


def upsert(target: DataFrame, updates: DataFrame, keys=("id", "project_path"), order: list[Column] | None = None, version: Column | None = None) -> DataFrame:
    """Update matched rows whole, insert the rest. Duplicate keys in ``updates`` keep the first by ``order``.

    With ``version``, a column of both sides, the newest row of a key wins wherever it comes from: an update that arrives late
    leaves a newer stored row alone, and a null version is the oldest. Equal versions go to the update, so a replay changes nothing.
    Of the target, keys and version alone meet the updates; its rows are read once more, for those that stay.
    """
    keys = list(keys)
    if version is None:
        updates = best_per_key(updates, keys, order) if order else updates.dropDuplicates(keys)
        return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)
    rest = [F.xxhash64(*[c for c in updates.columns if c not in keys])]
    updates = best_per_key(updates.withColumn("__new", version), keys, [F.col("__new").desc_nulls_last(), *(order or rest)])
    newer = F.col("__old").isNotNull() & (F.col("__new").isNull() | (F.col("__old") > F.col("__new")))
    kept = target.select(*keys, version.alias("__old")).join(updates.select(*keys, "__new"), keys).where(newer).select(*keys).distinct()
    updates = updates.drop("__new").join(kept, keys, "left_anti")
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def comment_version() -> Column:
    """When a comment was last written: its edit, else its creation; null if neither is a time."""
    return F.coalesce(F.try_to_timestamp("updated_at"), F.try_to_timestamp("created_at"))


def delete_where(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of rows deleted). A null predicate keeps the row."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.where(~hit), df.agg(F.count_if(hit).alias("deleted"))


def ensure_column(df: DataFrame, name: str, data_type: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(data_type))


def latest_record(df: DataFrame, keys: list[str], ts: str = "last_updated") -> DataFrame:
    """Newest row per key: a max_by over the whole row, so each task sends one row per key."""
    rest = [c for c in df.columns if c not in keys]
    # The row itself breaks ties, which keeps the choice stable.
    newest = F.max(F.struct(F.col(ts).alias("__ts"), *rest)).alias("r")
    return df.groupBy(*keys).agg(newest).select(*keys, *[f"r.{c}" for c in rest])


def corpus_stats(tables: dict[str, DataFrame], project: str | None = None) -> DataFrame:
    """Row count per table and in total: one count per table, each a metadata-only scan."""
    counts = None
    for name, df in tables.items():
        if project is not None:
            df = df.where(F.col("project_path") == project)
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = part if counts is None else counts.unionByName(part)
    return counts.rollup("table").agg(F.sum("n").alias("n")).select(F.coalesce("table", F.lit("total")).alias("table"), "n")


def inventory_hash(rows: DataFrame, keys: list[str], buckets_hex: int = 3) -> DataFrame:
    """Fingerprint of ``type:path:hash`` rows per key, independent of row order.

    A hash of hashes: equal rows collapse to one with a count, rows fall into ``16 ** buckets_hex``
    buckets by their own hash, every bucket is hashed over its sorted rows, and the fingerprint is the
    hash of the bucket hashes. No task sees a whole project.
    """
    line = F.concat(
        or_default("type", "file"), F.lit(":"), F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce("content_hash", F.lit(""))
    )
    lines = rows.select(*keys, line.alias("line")).groupBy(*keys, "line").agg(F.count("*").alias("times"))
    bucket = F.substring(F.md5("line"), 1, buckets_hex)
    parts = lines.groupBy(*keys, bucket.alias("bucket")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("#", "line", F.col("times").cast("string")))), "\n"), 256).alias("h")
    )
    return parts.groupBy(*keys).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("bucket", "h"))), ""), 256).alias("fingerprint")
    )


def key_files_hash(files: DataFrame, keys: list[str], limit: int = 25) -> DataFrame:
    """Hash over path, time and the first 1000 characters of files under 50 KiB, in rank order.

    A project has at most ``KEY_FILE_LIMIT`` key files, so one short list per key.
    """
    text = F.concat(
        F.col("path"), F.coalesce("last_modified", F.lit("")),
        F.when(F.col("size") < 50 * 1024, F.substring(F.coalesce("content", F.lit("")), 1, 1000)).otherwise(F.lit("")),
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), text.alias("t"))))
    return files.where(F.col("rank") <= limit).groupBy(*keys).agg(
        F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), ""), 256).alias("fingerprint")
    )


def analysis_is_stale(stored: DataFrame, inventory: DataFrame, key_files: DataFrame, keys: list[str]) -> DataFrame:
    """A stored summary is reused only when both fingerprints still match."""
    now = inventory.select(*keys, F.col("fingerprint").alias("inventory_now"))
    keyed = key_files.select(*keys, F.col("fingerprint").alias("key_files_now"))
    fresh = F.col("inventory_hash").eqNullSafe(F.col("inventory_now")) & F.col("key_files_hash").eqNullSafe(F.col("key_files_now"))
    return stored.join(now, keys, "left").join(keyed, keys, "left").select(*keys, (~fresh).alias("stale"))


def run_counters(statuses: DataFrame) -> DataFrame:
    """Each file is counted once, by its final status."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def content_by_path(rows: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """One content per path, the non-empty one where versions differ (smallest hash among those)."""
    has = ~is_blank("content")
    best = F.min_by("content", F.struct((~has).alias("blank"), F.md5(F.coalesce("content", F.lit(""))).alias("h")))
    return rows.groupBy(*keys).agg(best.alias("content"))


def existing_files(results: DataFrame, inventory: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """Search results whose file still exists."""
    return results.join(inventory.select(*keys), keys, "left_semi")


def directory_tree(paths: DataFrame, keys: list[str], path: str = "path", max_depth: int = 5, ignore=()) -> DataFrame:
    """Tree lines per project, directories before files, as ``(keys, sort_key, line, node, depth, is_dir)`` rows.

    Rows, not one text: a project may hold any number of files. Concatenate in ``sort_key`` order to render.
    """
    parts = F.split(F.col(path), "/", -1)
    # Ancestors of a file are its leading slices; depth counts from zero and ends at max_depth.
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth + 1))),
        lambda i: F.struct(F.slice(parts, F.lit(1), i).alias("at"), (i < F.size(parts)).alias("is_dir")),
    )
    nodes = paths.select(*keys, F.explode(prefixes).alias("n")).select(*keys, "n.*").distinct()
    joined = F.array_join("at", "/")
    for pattern in ignore:
        nodes = nodes.where(~joined.contains(pattern[3:] if pattern.startswith("**/") else pattern))
    depth = F.size("at")
    # Directories sort before files on each level: every segment that is a directory is marked 0, a file 1.
    sort_key = F.array_join(
        F.transform("at", lambda s, i: F.concat(F.when((i < depth - 1) | F.col("is_dir"), "0").otherwise("1"), s)), "\x01"
    )
    line = F.concat(
        F.repeat(F.lit("    "), depth - 1), F.element_at("at", -1), F.when(F.col("is_dir"), "/").otherwise("")
    )
    return nodes.select(*keys, sort_key.alias("sort_key"), line.alias("line"), joined.alias("node"), depth.alias("depth"), "is_dir")


def pack_tree(tree: DataFrame, keys: list[str], lines: int, max_depth: int = 5) -> DataFrame:
    """Every line of a tree in exactly one row of about ``lines`` lines: ``tree`` with ``owner`` and ``piece``.

    Subtrees are cut bottom-up: a directory hands its lines to its parent while they are fewer than ``lines``, else it becomes the
    owner of them; the project ('') owns what is left. An owner of many lines deals its children, each with all it brings, to
    pieces by a hash of the name, so that no directory, however many files it holds, is packed in one task.
    """
    parent = F.regexp_extract("node", "^(.*)/[^/]*$", 1)
    nodes = tree.withColumn("parent", parent)
    rest = nodes.where(~F.col("is_dir")).groupBy(*keys, "parent", (F.col("depth") - 1).alias("above")).agg(F.count("*").alias("n"))
    handed, cuts = rest, None
    for depth in range(max_depth + 1, 0, -1):
        inside = handed.where(F.col("above") == depth).groupBy(*keys, F.col("parent").alias("node")).agg(F.sum("n").alias("n"))
        own = nodes.where(F.col("is_dir") & (F.col("depth") == depth)).select(*keys, "node", "parent")
        sized = materialize(own.join(inside, [*keys, "node"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1), "tree-level")
        cut = sized.where(F.col("n") >= lines).select(*keys, F.col("node").alias("owner"), F.lit(depth).alias("owner_depth"), "n")
        cuts = cut if cuts is None else cuts.unionByName(cut)
        up = sized.where(F.col("n") < lines).select(*keys, "parent", F.lit(depth - 1).alias("above"), "n")
        handed = handed.where(F.col("above") < depth).unionByName(up)
    root = handed.where("above = 0").groupBy(*keys).agg(F.sum("n").alias("n"))
    cuts = materialize(cuts.unionByName(root.select(*keys, F.lit("").alias("owner"), F.lit(0).alias("owner_depth"), "n")), "tree-cuts")
    parts = F.split("node", "/", -1)
    reach = F.col("depth") - F.when(F.col("is_dir"), 0).otherwise(1)
    above = F.transform(F.sequence(F.lit(0), reach), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    found = nodes.drop("parent").withColumn("owner", F.explode(above)).join(cuts, [*keys, "owner"])
    best = F.max_by(F.struct("owner", "owner_depth", "n", "depth", "is_dir", "line"), "owner_depth").alias("b")
    owned = found.groupBy(*keys, "sort_key", "node").agg(best).select(*keys, "sort_key", "node", "b.*")
    child = F.array_join(F.slice(F.split("node", "/", -1), 1, F.col("owner_depth") + 1), "/")
    mark = F.conv(F.substring(F.md5(child), 1, 8), 16, 10).cast("long")
    return owned.withColumn("piece", (mark % F.ceil(F.col("n") / lines)).cast("int")).drop("n", "owner_depth")
