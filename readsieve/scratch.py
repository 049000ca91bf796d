"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one of our own where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "readsieve-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Share of the driver's heap beyond which, when a table is written, garbage is collected: plans, broadcasts and shuffle files of finished steps.
HEAP = 0.5


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage and survive lost executors.

    Tables that a result still reads go when the JVM ends; ``drop`` frees one earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        fs, hadoop = self._fs(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        self.root = fs.makeQualified(hadoop).toString()  # with its scheme, also for readers other than Spark
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and gives the written table.

        Tasks move their files themselves (version 2 of the commit), so that the driver doesn't for each in turn; nothing reads a table
        whose write failed, nor a mark of success."""
        commit = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
        df.write.mode("overwrite").options(compression="zstd", **commit).parquet(self.path(name))
        self._collect_garbage()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _collect_garbage(self) -> None:
        """Spark frees what finished steps leave only when the driver's heap is collected, which a large one puts off."""
        jvm = self.spark.sparkContext._jvm
        heap = jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() > HEAP * heap.maxMemory():
            jvm.java.lang.System.gc()

    def drop(self, name: str) -> None:
        fs, hadoop = self._fs(self.path(name))
        fs.delete(hadoop, True)
