"""Intermediate tables that outlive a lost executor.

Everything that cuts lineage goes through :func:`materialize`: a parquet table below the folder the
cluster names in ``spark.checkpoint.dir``, which the driver and all executors share. Tables that were
not discarded before go when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of one application's tables -> a frame's session that can delete it.
FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is configured and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="annalist-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(found.get()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_all() -> None:
    for path, spark in FOLDERS.items():
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already; the cluster's own clean-up is left
            pass
    FOLDERS.clear()


def table_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder of the shared one."""
    folder = f"{shared_dir(spark)}/annalist/{spark.sparkContext.applicationId}"
    if not FOLDERS:
        atexit.register(remove_all)
    FOLDERS[folder] = spark
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the plan restarts from files."""
    spark = df.sparkSession
    path = table_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._annalist_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`materialize` returned and nothing reads any more."""
    path = getattr(df, "_annalist_path", None)
    if path:
        remove(df.sparkSession, path)
