"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Dynamic partition overwrite lets a refresh replace only the projects it touched.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Session for a local run or a test; a cluster job passes its own settings through spark-submit."""
    builder = SparkSession.builder.appName("reviewlake")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that a job may start from any folder. Spark serves the archive itself."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-package-"), name), "zip", root, name)
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder, or a fresh local one when unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    fallback = os.environ.get("TMPDIR") or tempfile.gettempdir()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-reviewlake-", dir=fallback)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where one result feeds several stages (index builds, two-pass searches) and must be
    stable between them. A written table survives the loss of an executor and, unlike an RDD
    checkpoint, still offers column pruning and filter pushdown to its readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/reviewlake/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; one stored in fewer splits than there are cores is dealt out once.

    The check reads file metadata only. A large table has more splits than cores and is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
