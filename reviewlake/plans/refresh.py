"""Corpus refresh: admit files, find what changed, embed only that, merge and prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions import paths as P
from reviewlake.functions import predicates as B
from reviewlake.functions import text as T
from reviewlake.functions.markdown import markdown_chunks
from reviewlake.operators import corpus as R
from reviewlake.operators.models import Embedder, HashedWords, embed
from reviewlake.operators.topk import best_per_key
from reviewlake.session import materialize

DOC_KEYS = ["project_path", "original_document_path"]
#: Lines of a project's tree that one structure row holds, about.
STRUCTURE_ROW_LINES = 1_000


def admit(files: DataFrame, exclude_globs=(), ignored: DataFrame | None = None) -> DataFrame:
    """Files worth processing. ``files``: project_path, path, content, last_modified."""
    rows = files.withColumn("size", F.octet_length("content"))
    flag = None
    if ignored is not None:
        rows = rows.join(ignored.select("project_path", "path").withColumn("hit", F.lit(True)), ["project_path", "path"], "left")
        flag = F.coalesce("hit", F.lit(False))
    keep = B.should_process("path", "size", exclude_globs=exclude_globs, ignored=flag)
    known = P.language_from_extension(P.extension("path")) != "unknown"
    return rows.where(keep & known).select(*files.columns)


def chunk_documents(files: DataFrame) -> DataFrame:
    """Markdown chunks of the documentation files, as chunk-table rows without vectors."""
    docs = files.where(B.is_documentation("path") & ~T.is_blank("content"))
    cut = docs.select("project_path", "path", "last_modified", markdown_chunks("path", "content").alias("m"))
    rows = cut.select("project_path", "path", "last_modified", F.col("m.title").alias("title"), F.explode("m.chunks").alias("c"))
    return rows.select(
        P.chunk_id("path", "c.heading", "c.start_line").alias("id"), F.col("c.content").alias("content"),
        F.col("path").alias("original_document_path"), "project_path", F.coalesce("c.heading", F.lit("")).alias("heading_text"),
        F.col("title").alias("document_title"), F.lit("markdown").alias("language"), T.short_hash("c.content").alias("content_hash"), "last_modified")


def refresh_files(
    files: DataFrame, stored: DataFrame, embedder: Embedder, mode: str = "full", embedding_lines: int = K.EMBEDDING_TRUNCATE_LINES,
) -> tuple[DataFrame, DataFrame]:
    """(new file table, status per row of ``files`` and deleted path). ``stored`` is the current file table of these projects.

    ``files`` may hold several versions of a path: each is compared, embedded and kept by its own hash.
    ``embedding_lines``: lines of a code file that the embedding model is given."""
    now = files.withColumn("content_hash", T.short_hash("content")).withColumn("is_empty", T.is_blank("content"))
    inventory = materialize(
        R.diff_inventory(now, stored.where((F.col("type") != R.STRUCTURE_TYPE) & F.col("path").isNotNull()).select(*R.FILE_KEYS, "content_hash")),
        "inventory")
    versions = [*R.FILE_KEYS, "content_hash"]
    todo = now.join(inventory.where(F.col("status").isin("new", "changed")).select(*versions), versions, "left_semi")
    # The whole text is stored and searched; only what the embedding model is given of a code file has a limit of lines.
    given = F.when(B.is_documentation("path"), F.col("content")).otherwise(T.truncate_lines("content", embedding_lines, "embedding"))
    made = todo.select(
        P.file_id("path", "content_hash").alias("id"), "content", given.alias("__given"), F.lit("file").alias("type"), P.basename("path").alias("name"), "path",
        "project_path", P.language_from_extension(P.extension("path")).alias("language"), "content_hash", "last_modified")
    made = materialize(embed(made, "__given", "vector", embedder).drop("__given"), "embedded-files")
    fresh = made.where("vector IS NOT NULL")
    failed = made.where("vector IS NULL").select(*versions, F.lit(True).alias("failed")).distinct()
    live = inventory.where(~F.col("status").isin("deleted", "skipped_empty")).select(*versions)
    # Old versions go only when their replacement was embedded; a version that is current stays beside the new one.
    if mode == "full":
        settled = live.join(failed.join(fresh, R.FILE_KEYS, "left_anti"), R.FILE_KEYS, "left_anti")
    else:
        settled = inventory.where("status = 'changed'").join(fresh, R.FILE_KEYS, "left_semi")
    old = stored.where((F.col("type") != R.STRUCTURE_TYPE) & F.col("path").isNotNull()).select("id", *versions)
    outdated = old.join(settled.select(*R.FILE_KEYS), R.FILE_KEYS, "left_semi").join(live, versions, "left_anti")
    keys = ["id", "project_path"]
    table = R.upsert(stored.join(outdated.select(*keys), keys, "left_anti"), fresh, keys)
    if mode == "full":
        table = R.prune_files(table, live)
    status = inventory.join(failed, versions, "left").select(
        *R.FILE_KEYS,
        F.when(F.col("failed"), "failed_embedding").when(F.col("status").isin("new", "changed"), "processed")
        .when(F.col("status") == "unchanged", "skipped_unchanged").otherwise(F.col("status")).alias("status"))
    return table, status


def refresh_chunks(files: DataFrame, stored: DataFrame, embedder: Embedder, mode: str = "full") -> DataFrame:
    """New chunk table: changed documents replace all their chunks, unchanged ones are not embedded again."""
    current = materialize(chunk_documents(files), "chunks")
    status = materialize(R.diff_documents(current, stored.select(*DOC_KEYS, "id", "content_hash"), DOC_KEYS), "documents")
    changed = status.where("status = 'replace'").select(*DOC_KEYS)
    made = embed(current.join(changed, DOC_KEYS, "left_semi"), "content", "vector", embedder).where("vector IS NOT NULL")
    table = stored.join(changed, DOC_KEYS, "left_anti").unionByName(made.select(*stored.columns))
    if mode == "full":
        table = R.prune_chunks(table, current.select(*DOC_KEYS).distinct())
    return table


def structure_rows(paths: DataFrame, lines: int = STRUCTURE_ROW_LINES) -> DataFrame:
    """The trees of projects as rows of about ``lines`` lines: project_path, owner, piece, content, n_lines. No line is left out."""
    packed = R.pack_tree(materialize(R.directory_tree(paths, ["project_path"]), "tree"), ["project_path"], lines)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sort_key", "line"))), lambda x: x["line"])
    # A row names the directory it belongs to.
    head = F.when(F.col("owner") != "", F.concat(F.lit("in "), "owner", F.lit(":\n"))).otherwise("")
    rows = packed.groupBy("project_path", "owner", "piece").agg(F.array_join(ordered, "\n").alias("content"), F.count("*").alias("n_lines"))
    return rows.withColumn("content", F.concat(head, "content"))


def refresh_structure(paths: DataFrame, stored: DataFrame, embedder: Embedder, lines: int = STRUCTURE_ROW_LINES) -> DataFrame:
    """All structure rows of the projects of ``paths``; rows whose text did not change keep their stored vector."""
    title = F.concat(P.basename("project_path"), F.lit(" Project Structure"))
    rows = structure_rows(paths, lines).select(
        F.concat(P.structure_id("project_path"), F.lit("#"), T.short_hash(F.concat_ws("#", "owner", "piece"))).alias("id"), "content",
        F.lit(R.STRUCTURE_TYPE).alias("type"), title.alias("name"), title.alias("path"), "project_path", F.lit("text").alias("language"),
        T.short_hash("content").alias("content_hash"), F.lit(None).cast("string").alias("last_modified"))
    rows = materialize(rows, "structure")
    known = stored.where(F.col("type") == R.STRUCTURE_TYPE).select("id", "project_path", "content_hash", "vector")
    match = ["id", "project_path", "content_hash"]
    kept = rows.join(known, match)
    made = embed(rows.join(known.select(*match), match, "left_anti"), "content", "vector", embedder).where("vector IS NOT NULL")
    return kept.unionByName(made)


def refresh_corpus(corpus, files: DataFrame, embedder: Embedder | None = None, mode: str = "full", exclude_globs=(), ignored=None) -> DataFrame:
    """Refresh the stored tables from ``files`` and return the run's counters. ``mode='partial'`` never prunes.

    The run covers every project of ``files``, also one whose files are all refused: a full run empties it.
    """
    embedder = embedder or HashedWords()
    admitted = best_per_key(admit(files, exclude_globs, ignored), R.FILE_KEYS, [F.col("last_modified").desc(), F.md5("content")])
    admitted = materialize(admitted, "admitted")
    projects = materialize(files.select("project_path").distinct(), "projects")
    stored = corpus.table("file_embeddings").join(projects, "project_path", "left_semi")
    table, status = refresh_files(admitted, stored, embedder, mode)
    columns = stored.columns
    table = materialize(table.where(F.col("type") != R.STRUCTURE_TYPE).select(*columns), "refreshed-files")
    structure = refresh_structure(table.select("project_path", "path"), stored, embedder)
    table = table.unionByName(structure.select(*columns))
    chunks = refresh_chunks(
        admitted, corpus.table("document_chunk_embeddings").join(projects, "project_path", "left_semi"), embedder, mode)
    counters = materialize(R.run_counters(status), "counters")
    corpus.write_all({"file_embeddings": table, "document_chunk_embeddings": chunks}, projects)
    return counters
