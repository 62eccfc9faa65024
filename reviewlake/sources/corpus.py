"""Corpus tables on Parquet, partitioned by project.

Every read filters on ``project_path``; as a partition column that filter prunes directories. Writers
never read and overwrite one path in one plan: the new content is written aside first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.operators import corpus as R

#: Rows (with their texts and vectors) that one file of a project holds at most, roughly.
ROWS_PER_FILE = 100_000

_S, _I = T.StringType(), T.IntegerType()
_V = T.ArrayType(T.FloatType())


def _schema(required: str, optional: str = "", vectors: str = "", integers: str = "") -> T.StructType:
    def fields(names, kind, nullable):
        return [T.StructField(n, kind, nullable) for n in names.split()]

    ints = set(integers.split())
    rows = []
    for name in required.split():
        rows.append(T.StructField(name, _I if name in ints else _S, True))
    rows += [T.StructField(n, _I if n in ints else _S, True) for n in optional.split()]
    return T.StructType(rows + fields(vectors, _V, True))


SCHEMAS = {
    "file_embeddings": _schema("id content type name path project_path content_hash last_modified", "language", "vector"),
    "document_chunk_embeddings": _schema(
        "id content original_document_path project_path content_hash last_modified", "heading_text document_title language", "vector"),
    "pr_comments": _schema(
        "id pr_number repository project_path comment_type comment_text author created_at",
        "file_path line_number line_range_start line_range_end original_code suggested_code diff_hunk updated_at pr_updated_at "
        "review_id review_state issue_category severity pattern_tags",
        "comment_embedding code_embedding combined_embedding", "pr_number line_number line_range_start line_range_end"),
    "project_summaries": _schema("id project_path project_name summary created_at last_updated"),
}


def _version(name: str):
    """What tells the newer of two rows of one key; None for tables whose rows have no versions."""
    return R.comment_version() if name == "pr_comments" else None


class Corpus:
    """The four tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def table(self, name: str) -> DataFrame:
        """The table with its fixed schema; columns a stored file lacks read as null; empty when absent."""
        schema = SCHEMAS[name]
        if not self._exists(self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.fieldNames())

    def _drop_partition(self, name: str, project: str) -> None:
        jvm = self.spark.sparkContext._jvm
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)
        self._delete(f"{self.path(name)}/project_path={escaped}")

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def write(self, name: str, df: DataFrame, projects: DataFrame | None = None) -> None:
        """Replace the projects present in ``df``; other projects' partitions stay as they are.

        The rows are staged before the partitions are overwritten, so ``df`` may read the table.
        ``projects`` names the projects the rows stand for: one without any row left is emptied.
        """
        self.write_all({name: df}, projects)

    def write_all(self, tables: dict[str, DataFrame], projects: DataFrame | None = None) -> None:
        """:meth:`write` for several tables: all of them are staged before the first partition changes."""
        staged = {name: self._stage(name, df) for name, df in tables.items()}
        for name, path in staged.items():
            self._swap(name, path, projects)
        for path in staged.values():
            self._delete(path)

    def _stage(self, name: str, df: DataFrame) -> str:
        for field in SCHEMAS[name]:
            df = R.ensure_column(df, field.name, field.dataType.simpleString())
        path = f"{self.root}/_staging/{name}-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]).write.parquet(path)
        return path

    def _swap(self, name: str, staged: str, projects: DataFrame | None) -> None:
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(staged)
        # A project's rows go to as many tasks as they fill files, so the number of files follows the rows and not the tasks.
        sizes = rows.groupBy("project_path").agg(F.ceil(F.count("*") / ROWS_PER_FILE).alias("n_files"))
        spread = rows.join(sizes, "project_path").withColumn("file_no", F.pmod(F.xxhash64("id"), F.col("n_files")))
        (
            spread.repartition("project_path", "file_no").drop("n_files", "file_no").select(*rows.columns).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("project_path").parquet(self.path(name))
        )
        if projects is not None:
            left = rows.select("project_path").distinct()
            for row in projects.select("project_path").distinct().join(left, "project_path", "left_anti").toLocalIterator():
                self._drop_partition(name, row["project_path"])

    def upsert(self, name: str, updates: DataFrame, keys=("id", "project_path")) -> None:
        """Merge by key; of several versions of a comment, in one batch or late, the newest stays."""
        projects = updates.select("project_path").distinct()
        current = self.table(name).join(projects, "project_path", "left_semi")
        self.write(name, R.upsert(current, updates, keys, version=_version(name)))

    def clear_project(self, project: str) -> dict[str, int]:
        """Delete a project's rows from every table; returns the deleted counts. Refuses shallow paths."""
        check_clearable(project)
        deleted = {}
        for name in SCHEMAS:
            rows = self.table(name).where(F.col("project_path") == project)
            deleted[name] = rows.count()
            if deleted[name]:
                self._drop_partition(name, project)
        return deleted

    def clear_repository(self, repository: str, project: str) -> int:
        table = self.table("pr_comments").where(F.col("project_path") == project)
        kept, counted = R.delete_where(table, F.col("repository") == repository)
        deleted = counted.first()["deleted"]
        if deleted:
            self.write("pr_comments", kept, self.spark.createDataFrame([(project,)], "project_path string"))
        return deleted

    def store_summary(self, summaries: DataFrame) -> None:
        """Replace the stored summary of each project in ``summaries``."""
        self.write("project_summaries", summaries)

    def get_summary(self, schema: str) -> DataFrame:
        return get_summary(self.table("project_summaries"), schema)

    def stats(self, project: str | None = None) -> DataFrame:
        return R.corpus_stats({name: self.table(name) for name in SCHEMAS}, project)


def check_clearable(project: str) -> None:
    parts = [p for p in project.split("/") if p]
    if not project.startswith("/") or len(parts) < 3:
        raise ValueError(f"refusing to clear {project!r}: expected an absolute path of at least three levels")


def get_summary(table: DataFrame, schema: str) -> DataFrame:
    """Newest summary per project, its JSON parsed with ``schema``, with the record's times and name as ``_metadata`` inside."""
    newest = R.latest_record(table, ["project_path"])
    about = F.struct("created_at", "last_updated", "project_name")
    return newest.withColumn("summary", F.from_json("summary", schema)).withColumn("summary", F.col("summary").withField("_metadata", about))
