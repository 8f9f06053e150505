"""Authorised operations, each prepared from the few files that its history lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .procurement import DAYS, LEAST, features

KEY = ["po_id", "order_date", "occurrence"]
#: Folders that items are spread over; a folder holds a month of an item's share.
BUCKETS = 16
VALUES = ["price_ratio", "quantity_ratio", "total_ratio", "price_iqr_distance", "relative_iqr"]


def bucket(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(BUCKETS)).cast("int")


def lay_out(lines: DataFrame, path: str) -> DataFrame:
    """lines (with occurrence) as Parquet by bucket of the item and month, sorted within; read back."""
    d = lines.withColumns({"bucket": bucket(F.col("item")), "month": F.date_format("order_date", "yyyy-MM")})
    # a folder is written by one task, or by several where a hot item makes it large
    d.hint("rebalance", "bucket", "month").sortWithinPartitions("bucket", "month", "item", "order_date").write.partitionBy("bucket", "month").parquet(path)
    return lines.sparkSession.read.parquet(path)


def months(requests: DataFrame) -> DataFrame:
    """(bucket, month) that hold the requested lines and the 90 days before them."""
    first = F.trunc(F.date_sub("order_date", DAYS), "month")
    spread = requests.select(bucket(F.col("item")).alias("bucket"), F.explode(F.sequence(first, F.col("order_date"), F.expr("interval 1 month"))).alias("m"))
    return spread.select("bucket", F.date_format("m", "yyyy-MM").alias("month")).distinct()


def near(store: DataFrame, requests: DataFrame) -> DataFrame:
    """The lines of the requests' buckets and months; the scan is pruned by the requests when it runs."""
    return store.join(months(requests), ["bucket", "month"], "left_semi").drop("bucket", "month")


def prepare(store: DataFrame, requests: DataFrame, mad: bool = True) -> DataFrame:
    """Each request's line with its nine features, their reasons and supports; its status and its vector, if all five values are there.

    Only the lines of the requests' own buckets are read, so supports that count
    other items' lines (supplier, unit, window) are left out, and not counted.
    """
    found = features(near(store, requests), only=requests.select(*KEY), kinds=("pair",), mad=mad)
    complete = F.lit(True)
    for c in VALUES:
        complete = complete & F.col(c).isNotNull()
    return found.withColumns({"status": F.when(complete, "eligible").otherwise("unavailable"), "values": F.when(complete, F.array(*VALUES))})


def one(store: DataFrame, catalogue: DataFrame, po_id: str, order_date: str, occurrence: int) -> DataFrame:
    """One authorised operation prepared; an operation that the catalogue does not have raises.

    The request's own bucket and months are literals of the scan, so the files of
    all others are not opened.
    """
    spark: SparkSession = store.sparkSession
    asked = catalogue.where((F.col("po_id") == po_id) & (F.col("order_date") == F.lit(order_date).cast("date")) & (F.col("occurrence") == occurrence)).select(*KEY, "item").limit(2).collect()
    if len(asked) != 1:
        raise ValueError(f"{len(asked)} authorised operations are ({po_id}, {order_date}, {occurrence})")
    request = spark.createDataFrame(asked, catalogue.select(*KEY, "item").schema)
    folders = months(request).collect()  # four or five months of one bucket
    here = store.where((F.col("bucket") == folders[0]["bucket"]) & F.col("month").isin([r["month"] for r in folders]))
    return prepare(here, request)


def authorised(lines: DataFrame) -> DataFrame:
    """The catalogue here: of every item the last line that has LEAST lines of its item before it (the largest key of the last day)."""
    daily = lines.groupBy("item", "order_date").agg(F.count("*").alias("c"), F.max(F.struct(*KEY)).alias("last"))
    sizes = daily.groupBy("item").agg(F.sum("c").alias("n"), F.max(F.struct("order_date", "last")).alias("last"))
    return sizes.where(F.col("n") > LEAST).select("item", "last.last.*")
