"""Exactly-once append: a batch that is run again after a failure writes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def write_once(rows: DataFrame, path: str, batch: int) -> bool:
    """Writes a batch's folder, unless it is complete; whether it was written.

    The folders are the ledger: a complete one has Spark's marker file, written
    last. What a lost driver left half-written has none and is replaced.
    """
    to = folder(path, batch)
    if _exists(rows.sparkSession, f"{to}/_SUCCESS"):
        return False
    rows.write.mode("overwrite").parquet(to)
    return True


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over what is there; its batches are appended under path, each exactly once."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_once(rows, path, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all complete batches, with the column `batch`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    whole = [str(f.getPath()) for f in found if _exists(spark, f"{f.getPath()}/_SUCCESS")]  # a name for each batch
    return spark.read.option("basePath", path).parquet(*whole)
