"""Catalogue queries of ranks, running totals and order statistics from the library's counted and carried forms.

Their oracles are the catalogue's SQL texts, whose windows and percentiles over
all rows would meet in one task on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import carried, invoices, profile
from ..sources import tables
from ..sources.shared import written
from . import catalog
from .registry import ORACLES, QUERIES, evaluated


def form(name: str):
    """Replaces how a catalogue query runs; its oracle stays."""
    assert name in catalog.CATALOG and name in ORACLES

    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def _n(c):
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


@form("d06_global_share")
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of each country is among the highest 5 % of all invoices."""
    d = carried.ranked(invoices.invoices(spark, sf_dir).select("country", "amount", "invoice_id", "invoice_date"), "amount", ["invoice_id", "invoice_date"], "k")
    total = d.agg(F.count("*").alias("total"))  # one row
    s = d.crossJoin(total).groupBy("country").agg(F.count("*").alias("n"), _n(F.col("k") <= F.floor((F.col("total") * 5 + 99) / 100)).alias("chosen"))
    return s.select("country", "n", "chosen", F.round(F.col("chosen") / F.col("n"), 9).alias("share"))


@form("d07_selection_types")
def d07(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """The types among the k highest amounts of the test split, and all of them."""
    d = invoices.invoices(spark, sf_dir).where("split = 'test'").select("fraud_type", "is_fraud", "amount", "invoice_id", "invoice_date")
    d = carried.ranked(d, "amount", ["invoice_id", "invoice_date"], "k")
    chosen = F.col("k") <= k
    return d.groupingSets([[F.col("fraud_type")], []], "fraud_type").agg(F.count("*").alias("n"), _n(chosen).alias("chosen"), _n(chosen & (F.col("is_fraud") == 1)).alias("hits"))


@form("a55_boundary_ties")
def a55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many have the 30th score, and how many of them are chosen."""
    d = written(carried.ranked(evaluated(spark, sf_dir).select("doc_id", "quality"), "quality", ["doc_id"], "k"), "ranked")
    edge = d.where("k <= 30").agg(F.min("quality").alias("q"))  # one row
    return d.crossJoin(edge).agg(_n(F.col("quality") == F.col("q")).alias("tied"), _n((F.col("quality") == F.col("q")) & (F.col("k") <= 30)).alias("tied_selected"))


@form("t10_permutation")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels permuted by a keyed hash: the i-th id gets the label of the i-th hash."""
    d = evaluated(spark, sf_dir).select("doc_id", "y")
    key = F.sha2(F.concat(F.lit("p:"), F.col("doc_id").cast("string")), 256)
    ids = carried.carried(d.select("doc_id"), [F.asc("doc_id")], F.lit(1), "i")
    labels = carried.carried(d.withColumn("h", key), [F.asc("h"), F.asc("doc_id")], F.lit(1), "i").select("i", "y")
    return ids.join(labels, "i").select("doc_id", "y")


@form("w12_average_rank")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.average_ranks(evaluated(spark, sf_dir), "score", "avg_rank").select("doc_id", "avg_rank")


@form("a52_ks")
def a52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution_distance(invoices.invoices(spark, sf_dir), "amount", "split", "train", "val").select(F.round("distance", 9).alias("distance"))


@form("a41_concentration")
def a41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest suppliers, and how many reach 80 %."""
    s = tables.purchase_lines(spark, sf_dir).groupBy("supplier_id").agg(F.sum(F.round("line_total").cast("long")).alias("spend"))
    d = carried.carried(s.withColumn("one", F.lit(1)), [F.desc("spend"), F.asc("supplier_id")], F.col("spend"), "before")
    d = carried.carried(d, [F.desc("spend"), F.asc("supplier_id")], F.lit(1), "k").withColumn("k", F.col("k") + 1)
    cum = (F.col("before") + F.col("spend")) / F.col("total")
    d = d.crossJoin(d.agg(F.sum("spend").alias("total")))  # one row
    at = lambda k: F.round(F.max(F.when(F.col("k") == k, cum)), 9)
    return d.agg(at(1).alias("top1"), at(5).alias("top5"), F.min(F.when(cum >= 0.8, F.col("k"))).alias("to_80"))


@form("w06_running_share")
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running shares of a segment's balances, largest first."""
    s = tables.read(spark, sf_dir, "customer", ["c_mktsegment", "c_custkey", "c_acctbal"]).where("c_acctbal > 0").withColumn("v", F.round(F.col("c_acctbal") * 100).cast("long"))
    order = [F.asc("c_mktsegment"), F.desc("v"), F.asc("c_custkey")]
    d = carried.since_start(carried.carried(s, order, F.col("v"), "before"), "before", "c_mktsegment")
    total = s.groupBy(F.col("c_mktsegment").alias("m")).agg(F.sum("v").alias("total"))
    d = d.join(total, F.col("c_mktsegment").eqNullSafe(F.col("m")))
    return d.select("c_custkey", F.round((F.col("before") + F.col("v")) / F.col("total"), 9).alias("share"))


@form("a27_score_summary")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "lineitem", ["l_extendedprice"])
    ends = d.agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    q = profile.quantiles(d, "l_extendedprice", [0.01, 0.5, 0.99]).crossJoin(ends)  # one row each
    return q.select("n", "low", "high", *[F.round(f"q{k}", 6).alias(c) for k, c in enumerate(("p01", "p50", "p99"))])


@form("a53_nine_points")
def a53(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = profile.quantiles(tables.read(spark, sf_dir, "orders", ["o_totalprice"]), "o_totalprice", [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1])
    return q.select(*[F.round(f"q{k}", 4).alias(f"q{k}") for k in range(9)])


@form("a28_upper_tail")
def a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later lines of each unit at or above P95 and P99 of the earlier ones."""
    d = tables.purchase_lines(spark, sf_dir)
    marks = profile.quantiles(d.where("order_date < DATE '1996-01-01'"), "line_total", [0.95, 0.99]).select(F.col("q0").alias("p95"), F.col("q1").alias("p99"))  # one row
    later = d.where("order_date >= DATE '1996-01-01'").crossJoin(marks)
    return later.groupBy("unit").agg(*[_n(F.col("line_total") >= F.col(p)).alias(f"above_{p}") for p in ("p95", "p99")])


@form("w08_deciles")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by decile of their balance."""
    d = tables.read(spark, sf_dir, "customer", ["c_acctbal"])
    edges = profile.quantiles(d, "c_acctbal", [k / 10 for k in range(1, 10)]).drop("n")  # one row
    above = sum((F.when(F.col("c_acctbal") > F.col(f"q{k}"), 1).otherwise(0) for k in range(9)), F.lit(1))
    return d.crossJoin(edges).groupBy(above.alias("decile")).agg(F.count("*").alias("n"))


@form("p23_tukey_flags")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users above the upper fence; none where a user has too few records."""
    e = tables.read(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    raw = e.select("event_id", "user_id", "event_type", F.when(F.round("value", 0) != 3, F.round("value", 0)).alias("metric"))
    records = raw.drop("event_id").unionByName(raw.where("event_id % 10 = 0").drop("event_id")).distinct()
    medians = profile.quantiles(records, "metric", [0.5], "user_id").select(F.col("user_id").alias("of"), F.col("q0").alias("metric"))
    base = written(records.groupBy("user_id").agg(F.count("*").alias("record_count")).join(medians, F.col("user_id").eqNullSafe(F.col("of")), "left").drop("of"), "base")
    fence = profile.quantiles(base, "metric", [0.25, 0.75]).select((F.col("q1") + 1.5 * (F.col("q1") - F.col("q0"))).alias("fence"))  # one row
    return base.crossJoin(fence).select("user_id", F.when(F.col("record_count") >= 3, F.col("metric") > F.col("fence")).alias("high"))


@form("a33_cents_median")
def a33(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"]).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return profile.quantiles(d, "cents", [0.5], "o_orderpriority").select("o_orderpriority", (2 * F.col("q0")).cast("long").alias("twice_median_cents"), "n")


@form("a38_monthly")
def a38(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.purchase_lines(spark, sf_dir).withColumn("m", F.trunc("order_date", "month"))
    sums = d.groupBy("m").agg(F.count("*").alias("n"), F.count_distinct("supplier_id").alias("suppliers"), F.sum("quantity").alias("quantity"))
    medians = profile.quantiles(d.select("m", "quantity"), "quantity", [0.5], "m").select(F.col("m").alias("of"), F.col("q0").alias("median_quantity"))
    return sums.join(medians, F.col("m").eqNullSafe(F.col("of")), "left").drop("of")


@form("a46_by_class")
def a46(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluated(spark, sf_dir)
    sums = d.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.round(F.stddev_samp("score"), 3).alias("std"))
    medians = profile.quantiles(d, "score", [0.5], "y").select(F.col("y").alias("of"), F.col("q0").alias("median"))
    return sums.join(medians, F.col("y").eqNullSafe(F.col("of")), "left").select("y", "n", "median", "mean", "std")
