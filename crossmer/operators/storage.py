"""Cutting lineage through shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that driver and executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, shared by driver and executors.

    Where it is unset a local session gets a temporary folder of its own; a
    cluster session is refused, since each machine would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="crossmer-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str = "frame") -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/crossmer/{kind}-{uuid.uuid4().hex}"
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of new_path() that no frame reads any more."""
    target, system = _file_system(spark, path)
    system.delete(target, True)
    system.cancelDeleteOnExit(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where one frame feeds several joins: the copy is columnar, carries
    size statistics for the join planner and outlives lost executors.
    """
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a scan that has fewer partitions than the cluster has cores.

    A small file is one task, however much work each row carries. A large scan
    has partitions enough and is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
