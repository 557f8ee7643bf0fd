"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (one machine) a temporary folder for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: name a folder there that all executors share")
        own = tempfile.mkdtemp(prefix="streetloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it, without the lineage.

    Later plans read the files, so they stay until :func:`release`, or until
    the folder of the application is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/streetloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._streetloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialise`."""
    path = getattr(df, "_streetloom_path", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
