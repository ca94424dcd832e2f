"""Cut lineage with tables written to the folder all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset, and only on a local master,
is a temporary one made. Staged tables survive the loss of an executor, unlike cached or locally checkpointed blocks. Those
of a session lie in one folder of its own, which goes when the JVM ends or :func:`release` is called.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows x width stay under this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _session_folder(spark: SparkSession):
    path = f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def session_folder(spark: SparkSession) -> str:
    """This session's own folder within the shared one; it is deleted when the JVM ends."""
    path, hadoop, fs = _session_folder(spark)
    if not fs.exists(hadoop):
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores. A table of fewer, larger files would leave most of them
    idle in work on texts; one with enough partitions is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Delete the session's staged tables: call it once the results that rest on them are written."""
    _, hadoop, fs = _session_folder(spark)
    fs.delete(hadoop, True)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the rows take no more than ``limit`` bytes; else leave the join to a shuffle.

    ``row_bytes``: what a row takes at most, or a column that says so for each. ``df`` should be a staged table, so that
    measuring it is cheap.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
