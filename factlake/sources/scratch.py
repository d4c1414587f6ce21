"""Intermediate tables in the folder that driver and executors share: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of more bytes are joined by shuffle, not broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-factlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Per thread, the paths of the tables that `written` made and nobody has freed: what runs in another thread is not ours to free.
_OWN = threading.local()


def _paths() -> list[str]:
    if not hasattr(_OWN, "paths"):
        _OWN.paths = []
    return _OWN.paths


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/factlake-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _paths().append(path)
    return path


#: Hexadecimal ids take half of their length in such files.
COMPRESSION = "zstd"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again. The files go when `free` is called, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def live() -> list[str]:
    """Paths of this thread's written tables that still exist, oldest first."""
    return list(_paths())


def free(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables; nothing may read them any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _paths().remove(path)


def sided(side: DataFrame, width: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """side (a written table), broadcast if its rows of `width` bytes each fit the limit."""
    total = side.agg(F.sum(F.lit(width) if isinstance(width, int) else width).cast("long")).first()[0] or 0
    return F.broadcast(side) if total <= limit else side
