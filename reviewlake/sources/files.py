"""Source-tree inventories."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions.paths import basename, matches_glob

EMPTY = "path string, relative_path string, name string, length long, modificationTime timestamp, content binary"


def scan_files(
    spark: SparkSession, root: str, include=K.DEFAULT_INCLUDES, exclude=K.DEFAULT_EXCLUDES, with_content: bool = False
) -> DataFrame:
    """Files below ``root``: path, relative_path, name, length, modificationTime and, on request, content.

    Without content only file metadata is read. Hidden files and folders are left out; so are links,
    which the listing does not follow.
    """
    base = _uri(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/") if base.startswith("/") else F.col("path")
    out = files.withColumn("path", path).withColumn("relative_path", F.substring("path", len(base.rstrip("/")) + 2, 1 << 30))
    hidden = F.col("relative_path").rlike(r"(^|/)\.")
    out = out.where(~hidden & matches_glob("relative_path", include) & ~matches_glob("relative_path", exclude))
    columns = ["path", "relative_path", basename("relative_path").alias("name"), "length", "modificationTime"]
    return out.select(*columns, *(["content"] if with_content else []))


def _uri(root: str) -> str:
    return posixpath.abspath(root) if "://" not in root else root.rstrip("/")


def expand_patterns(spark: SparkSession, patterns: list[str], base: str) -> DataFrame:
    """Union of explicit files and globs below ``base``, each path once."""
    rooted = [p if p.startswith("/") or "://" in p else posixpath.join(base, p) for p in patterns]
    flat = [p for p in rooted if "**" not in p]
    out = None
    if flat:
        # Patterns that match nothing are skipped instead of failing the read.
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        present = [p for p in flat if fs_path(p).getFileSystem(conf).globStatus(fs_path(p))]
        if present:
            out = spark.read.format("binaryFile").load(present).select("path", "length", "modificationTime")
    deep = [p for p in rooted if "**" in p]
    if deep:
        scanned = scan_files(spark, base, [posixpath.relpath(p, base) for p in deep], ()).select("path", "length", "modificationTime")
        out = scanned if out is None else out.unionByName(scanned)
    if out is None:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    return out.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).dropDuplicates(["path"])


def load_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Exclusion patterns: trimmed lines without blanks and ``#`` comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("pattern"))
    return lines.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
