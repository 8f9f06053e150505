"""Canonical inputs built from the Parquet tables, and checked readers and writers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, optionally projected so that only these columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids, as a semi join rather than a long IN list."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def read_csv(spark: SparkSession, path: str, schema: StructType, *, first: str | None = None, last: str | None = None, day: str | None = None) -> DataFrame:
    """CSV with a fixed header and given types; a row that does not fit ends the read.

    first and last (dates as text) bound the column `day`; a row outside raises.
    """
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.fieldNames():
        raise ValueError(f"header {header} is not {schema.fieldNames()}")
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if day:
        inside = F.col(day).between(first, last)
        df = df.where(F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit("outside the covered dates: "), F.coalesce(F.col(day).cast("string"), F.lit("null"))))))
    return df


def verified(spark: SparkSession, path: str, sha256: str | dict[str, str]) -> DataFrame:
    """Parquet parsed from the very bytes that were hashed; sha256 is the file's hash, or one for each file name of a folder.

    Each file is one value of a task, so files have to be of ordinary size; a
    file with another hash or without one ends the query, a missing one too.
    """
    schema = spark.read.parquet(path).schema
    target = to_arrow_schema(schema)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if isinstance(sha256, dict):
        there = {r["path"].rsplit("/", 1)[-1] for r in files.select("path").collect()}  # names only
        if there != set(sha256):
            raise ValueError(f"files without a hash or missing: {sorted(there ^ set(sha256))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                want = sha256[name.rsplit("/", 1)[-1]] if isinstance(sha256, dict) else sha256
                if hashlib.sha256(raw).hexdigest() != want:
                    raise ValueError(f"{name}: the file's bytes have another hash")
                yield from pq.read_table(pa.BufferReader(raw)).select(target.names).cast(target).to_batches()

    return files.mapInArrow(run, schema)


def write_new(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned by columns if asked, never over an existing output."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_checked(df: DataFrame, path: str) -> DataFrame:
    """Written, read back, and compared as multisets both ways."""
    write_new(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if not back.exceptAll(df).isEmpty() or not df.exceptAll(back).isEmpty():
        raise ValueError("what was read back differs from what was written")
    return back


def purchase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with item, supplier, unit and category; order ids repeat, so `occurrence` completes the key."""
    li = read(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate"])
    part = read(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"])
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("po_id"),
        F.col("l_shipdate").cast("date").alias("order_date"), F.col("p_brand").alias("item"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_returnflag").alias("unit"), F.col("p_type").alias("category"), F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("line_total"), F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"), F.col("l_partkey").alias("part_id"),
    )
