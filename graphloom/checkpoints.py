"""Where intermediate results go: the shared folder that the session names, or one of our own where it names none."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; our own only where none is set, and one that all executors see."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master.startswith("local[") or sc.master == "local":
                named = tempfile.mkdtemp(prefix="graphloom-")
                atexit.register(shutil.rmtree, named, ignore_errors=True)
            else:
                named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that lost executors never lead to a different second computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are checkpointed or gone; it does so when the driver collects
    its garbage, which a driver with little of it would put off for long. What the driver's Python has freed goes back to the
    system, where its C library has a call for that."""
    gc.collect()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)
    spark._jvm.System.gc()
