"""Tables of the session in the shared folder, for what several parts of a plan read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_bases: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a plain local session without it gets a temporary one, as executors don't
    see each other's local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fragmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's file system layer, while the session lives."""
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    base = f"{shared_folder(spark)}/fragmill-tables-{spark.sparkContext.applicationId}"
    if base not in _bases:
        _bases.add(base)
        atexit.register(remove, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that is removed when the application ends: computed once, and not again if an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
