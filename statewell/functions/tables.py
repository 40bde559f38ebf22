"""Tables that a job writes once and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, any other must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "statewell")
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read back: later jobs see the same rows, and a lost executor costs a read.

    The table goes when the session's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/statewell/{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
