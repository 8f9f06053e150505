"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local default only on one machine where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back: computed once, and safe from lost executors.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: A written table of at most so many rows is broadcast, whatever the size of the data.
SMALL = 1 << 17


def small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows (a count that reads no column)."""
    return F.broadcast(table) if table.count() <= SMALL else table
