"""Queries built from the library, each with a separately written SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import functions as X
from ..operators import invoices, metrics, models, prices, procurement, profile, store, versions
from ..sources import tables
from . import catalog
from .registry import ORACLES, evaluated, features, query

_SEED = b"review-seed"
_TRAIN, _VAL = "b" + "3" * 63, "d" + "9" * 63
_INVOICES = f"""inv AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS invoice_id, l_suppkey AS supplier_id, o_orderpriority AS department_id, n_name AS country, l_extendedprice AS amount,
    CAST(l_shipdate AS DATE) AS invoice_date, (l_linenumber * 5) % 24 AS hour, 30 * (1 + l_linenumber % 3) AS days, l_linestatus AS kind, (l_suppkey * 37) % 3650 AS age, CAST(l_returnflag = 'R' AS INT) AS is_fraud, l_returnflag AS fraud_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
invoices AS (SELECT *, CASE WHEN sha256(invoice_id) < '{_TRAIN}' THEN 'train' WHEN sha256(invoice_id) < '{_VAL}' THEN 'val' ELSE 'test' END AS split FROM inv)"""
_SUPPLIED = """raw AS (
  SELECT user_id, event_type, nullif(round(value, 0), 3) AS metric, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS target, event_id FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.purchase_lines(spark, sf_dir)


# sources and projections


@query("s11_schema", "SELECT column_name AS name, row_number() OVER () - 1 AS position FROM (DESCRIBE orders)")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table from its footer; no row is read."""
    return spark.createDataFrame([(c, k) for k, c in enumerate(tables.read(spark, sf_dir, "orders").columns)], "name string, position long")


_SETS = {"A": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "B": ("l_quantity", "l_extendedprice"), "C": ("l_discount", "l_tax"), "D": ("l_quantity",)}


@query("p07_feature_sets", " UNION ALL ".join(f"SELECT '{s}' AS scenario, {len(c)} AS width, round(sum({' + '.join(f'cast({x} AS DECIMAL(18,2))' for x in c)}), 2)::DOUBLE AS total FROM lineitem" for s, c in _SETS.items()))
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature sets of an ablation, each a projection of its own."""
    out = None
    for name, columns in _SETS.items():
        row = tables.read(spark, sf_dir, "lineitem", list(columns)).agg(F.sum(sum((F.col(c).cast("decimal(18,2)") for c in columns), F.lit(0))).cast("double").alias("total"))
        row = row.select(F.lit(name).alias("scenario"), F.lit(len(columns)).alias("width"), F.round("total", 2).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("p11_seen_suppliers", f"WITH {_INVOICES} SELECT split, CAST(sum(CASE WHEN supplier_id % 3 = 0 AND supplier_id NOT IN (SELECT supplier_id FROM invoices WHERE split = 'train' AND supplier_id % 9 <> 0) THEN 0 ELSE 1 END) AS BIGINT) AS seen, count(*) AS n FROM invoices GROUP BY split")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose supplier TRAIN knows; every ninth supplier is taken out of TRAIN, so that some are unseen."""
    d = invoices.invoices(spark, sf_dir)
    known = d.where("split = 'train' AND supplier_id % 9 <> 0").select("supplier_id").distinct().withColumn("known", F.lit(1))
    seen = F.when((F.col("supplier_id") % 3 == 0) & F.col("known").isNull(), 0).otherwise(1)
    return d.join(known, "supplier_id", "left").groupBy("split").agg(F.sum(seen).alias("seen"), F.count("*").alias("n"))


@query("p12_contexts", f"""WITH {_INVOICES}, t AS (SELECT * FROM invoices WHERE split = 'train' AND (supplier_id + length(department_id)) % 5 <> 0 AND month(invoice_date) <> 5)
  SELECT CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.supplier_id = v.supplier_id AND t.department_id = v.department_id) THEN 1 ELSE 0 END) AS BIGINT) AS unseen_pair,
    CAST(sum(CASE WHEN month(invoice_date) NOT IN (SELECT month(invoice_date) FROM t) THEN 1 ELSE 0 END) AS BIGINT) AS absent_month, count(*) AS n FROM invoices v WHERE split = 'val'""")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of VAL in contexts that a thinned TRAIN has not seen: pair of supplier and department, month of the year."""
    d = invoices.invoices(spark, sf_dir)
    train = d.where((F.col("split") == "train") & ((F.col("supplier_id") + F.length("department_id")) % 5 != 0) & (F.month("invoice_date") != 5))
    val = d.where("split = 'val'").withColumn("m", F.month("invoice_date"))
    pairs = train.select("supplier_id", "department_id").distinct().withColumn("p", F.lit(1))
    months = train.select(F.month("invoice_date").alias("m")).distinct().withColumn("q", F.lit(1))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return val.join(pairs, ["supplier_id", "department_id"], "left").join(months, "m", "left").agg(n(F.col("p").isNull()).alias("unseen_pair"), n(F.col("q").isNull()).alias("absent_month"), F.count("*").alias("n"))


@query("p15_one_of_three", "SELECT count(*) AS n FROM orders WHERE (nullif(o_orderstatus, 'F') IS NOT NULL)::INT + (nullif(o_orderstatus, 'O') IS NOT NULL)::INT + (nullif(o_orderpriority, '1-URGENT') IS NOT NULL)::INT = 1")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which exactly one of three values is there."""
    d = tables.read(spark, sf_dir, "orders", ["o_orderstatus", "o_orderpriority"])
    values = [F.nullif(F.col("o_orderstatus"), F.lit("F")), F.nullif(F.col("o_orderstatus"), F.lit("O")), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))]
    return d.where(sum((v.isNotNull().cast("int") for v in values), F.lit(0)) == 1).agg(F.count("*").alias("n"))


@query("p18_allowlist", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose value a catalogue lists."""
    allowed = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return tables.read(spark, sf_dir, "customer", ["c_mktsegment"]).join(allowed, "c_mktsegment", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# joins


@query("j02_split_join", f"WITH {_INVOICES} SELECT split, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS positives FROM invoices GROUP BY split")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to their splits by id, one to one."""
    d = invoices.invoices(spark, sf_dir)
    splits = d.select("invoice_id", "split").dropDuplicates(["invoice_id"])
    return d.drop("split").join(splits, "invoice_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("positives"))


@query("j05_validated_join", "SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join that ends the query where a key repeats."""
    return profile.one_to_one(tables.read(spark, sf_dir, "labels", ["doc_id", "quality"]), tables.read(spark, sf_dir, "documents", ["doc_id", "n_chars"]), "doc_id")


@query("j06_aggregate_with_count", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's statistics and its count, by one aggregation."""
    return tables.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


@query("j07_aligned", "SELECT l.doc_id, d.lang FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id ORDER BY l.doc_id")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of given ids; an id without a row ends the query."""
    return profile.aligned(tables.read(spark, sf_dir, "labels", ["doc_id"]), tables.read(spark, sf_dir, "documents", ["doc_id", "lang"]), "doc_id").orderBy("doc_id")


@query("j15_payload_equality", """SELECT count(*) AS pairs, CAST(sum(CASE WHEN a.l_quantity IS NOT DISTINCT FROM b.l_quantity AND a.l_extendedprice IS NOT DISTINCT FROM b.l_extendedprice AND a.l_discount IS NOT DISTINCT FROM b.l_discount
    AND a.l_tax IS NOT DISTINCT FROM b.l_tax AND a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag AND a.l_linestatus IS NOT DISTINCT FROM b.l_linestatus AND a.l_shipdate IS NOT DISTINCT FROM b.l_shipdate THEN 1 ELSE 0 END) AS BIGINT) AS equal
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows of a repeated key agree in all other columns."""
    rest = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    d = tables.read(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", *rest])
    a, b = (d.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias(f"part_{s}"), F.struct(*rest).alias(f"payload_{s}")) for s in "ab")
    both = a.join(b, ["l_orderkey", "l_linenumber"]).where("part_a < part_b")
    return both.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.col("payload_a").eqNullSafe(F.col("payload_b")).cast("long")), F.lit(0)).alias("equal"))


@query("w07_transform", "SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS mean, round(quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment), 6) AS median FROM customer")
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's mean and median at each of its rows, by a join, so that no task holds a group."""
    d = tables.read(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    stats = d.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean")).join(profile.quantiles(d, "c_acctbal", [0.5], "c_mktsegment"), "c_mktsegment")
    return d.join(stats, "c_mktsegment").select("c_custkey", F.round("mean", 6).alias("mean"), F.round("q0", 6).alias("median"))


@query("j19_catalog_context", "SELECT n_name AS name, r_name AS kind, count(c_custkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name, r_name")
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by namespace, kind and id with what belongs to them."""
    region = tables.read(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    members = tables.read(spark, sf_dir, "customer", ["c_nationkey"]).groupBy("c_nationkey").agg(F.count("*").alias("members"))
    d = tables.read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(members, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return d.select(F.col("n_name").alias("name"), F.col("r_name").alias("kind"), F.coalesce("members", F.lit(0)).alias("members"))


@query("j20_unmatched", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a partner, found by the null that a left join leaves."""
    partners = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return tables.read(spark, sf_dir, "customer", ["c_custkey"]).join(partners, F.col("c_custkey") == F.col("o_custkey"), "left").where(F.col("o_custkey").isNull()).select("c_custkey")


# aggregates



_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a12_quality", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS present, count(*) - count({c}) AS missing, round(100.0 * count({c}) / count(*), 6)::DOUBLE AS coverage, min({c}) + 0 AS low, max({c}) + 0 AS high, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, count(*) FILTER ({c} > 100) AS above FROM lineitem" for c in _PROFILED))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.quality(tables.read(spark, sf_dir, "lineitem", list(_PROFILED)), list(_PROFILED))
    return d.withColumns({c: F.col(c) + 0.0 for c in ("low", "high")})


@query("a14_unique_target", f"WITH {_SUPPLIED} SELECT event_type, count(DISTINCT target) AS kinds, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target FROM raw GROUP BY event_type UNION ALL SELECT 'user ' || (user_id % 50), count(DISTINCT target), CASE WHEN count(DISTINCT target) = 1 THEN min(target) END FROM raw GROUP BY user_id % 50")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target only where all rows of its key agree."""
    d = tables.read(spark, sf_dir, "events").withColumn("target", F.when(F.col("user_id") % 7 == 0, 1).otherwise(0))
    by_user = d.withColumn("event_type", F.concat(F.lit("user "), (F.col("user_id") % 50).cast("string")))
    return profile.unique_or_none(d, "event_type", "target").unionByName(profile.unique_or_none(by_user, "event_type", "target"))


@query("a19_metrics", f"""WITH {catalog.EVALUATED}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1)::DOUBLE tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE tn FROM evaluated)
  SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
    round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 9) AS f1_macro, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy FROM c""")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and every rate made from them."""
    d = metrics.confusion(evaluated(spark, sf_dir).withColumn("p", (F.col("score") > 2000).cast("int")), "y", "p")
    return d.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "accuracy", "f1_macro", "balanced_accuracy")])


@query("a22_metrics_per_group", f"""WITH {catalog.EVALUATED}, c AS (SELECT lang, quality, count(*) FILTER (y = 1 AND p = 1)::DOUBLE tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE fn FROM evaluated GROUP BY GROUPING SETS ((lang), (quality)))
  SELECT coalesce(lang, 'quality ' || quality) AS grp, tp::BIGINT AS tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall FROM c""")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every group of two groupings."""
    d = evaluated(spark, sf_dir).withColumn("p", (F.col("score") > 2000).cast("int"))
    both = metrics.confusion(d.withColumn("grp", F.col("lang")), "y", "p", "grp").unionByName(metrics.confusion(d.withColumn("grp", F.concat(F.lit("quality "), F.col("quality").cast("string"))), "y", "p", "grp"))
    return both.select("grp", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("a23_profile", f"""WITH {_INVOICES}, s AS (SELECT * FROM invoices WHERE amount > 50000), t AS (SELECT fraud_type, count(*) AS c FROM s GROUP BY fraud_type), m AS (SELECT max(c) AS c FROM t)
  SELECT (SELECT count(*) FROM s) AS n, (SELECT CAST(sum(is_fraud) AS BIGINT) FROM s) AS positives, (SELECT count(DISTINCT fraud_type) FROM s WHERE is_fraud = 1) AS positive_types, string_agg(fraud_type, ',' ORDER BY fraud_type) AS dominant, round(max(t.c)::DOUBLE / (SELECT count(*) FROM s), 9) AS share FROM t JOIN m ON t.c = m.c""")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection's rows, positives, kinds of positives and its commonest kinds, ties together."""
    s = invoices.invoices(spark, sf_dir).where("amount > 50000")
    by = s.groupBy("fraud_type").agg(F.count("*").alias("c"), F.sum("is_fraud").alias("p"))
    total = by.agg(F.sum("c").alias("n"), F.sum("p").alias("positives"), F.sum((F.col("p") > 0).cast("long")).alias("positive_types"), F.max("c").alias("most"), F.collect_list(F.struct("fraud_type", "c")).alias("kinds"))  # kinds of fraud: a handful
    top = F.filter("kinds", lambda k: k["c"] == F.col("most"))
    return total.select("n", "positives", "positive_types", F.array_join(F.array_sort(F.transform(top, lambda k: k["fraud_type"])), ",").alias("dominant"), F.round(F.col("most") / F.col("n"), 9).alias("share"))


_SEVEN = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("a27_scores", "SELECT count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{round(100 * q):02d}" for q in _SEVEN) + " FROM lineitem")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of scores; quantiles from counted values."""
    d = tables.read(spark, sf_dir, "lineitem", ["l_extendedprice"])
    x = F.col("l_extendedprice")
    basic = d.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"))
    return profile.quantiles(d, "l_extendedprice", list(_SEVEN)).crossJoin(basic).select("n", "low", "high", "mean", "std", *[F.round(f"q{k}", 6).alias(f"p{round(100 * q):02d}") for k, q in enumerate(_SEVEN)])


@query("a53_quantiles", "SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{k}" for k, q in enumerate((0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1))) + " FROM orders GROUP BY o_orderpriority")
def a53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A53 by group, from counted values."""
    d = profile.quantiles(tables.read(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"]), "o_totalprice", [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1], "o_orderpriority")
    return d.select("o_orderpriority", *[F.round(f"q{k}", 4).alias(f"q{k}") for k in range(9)])


_SIX = {"category": "category", "item": "item", "supplier": "CAST(supplier_id AS VARCHAR)", "unit": "unit", "month": "strftime(order_date, '%Y-%m')", "season": "strftime(order_date, '%m')"}


@query("a29_group_rates", f"WITH {catalog.LINES}, t AS (SELECT count(*) AS total FROM lines) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {e} AS grp, count(*) AS n, count(*) FILTER (quantity >= 45) AS chosen, round(count(*)::DOUBLE / max(total), 9) AS share, round((count(*) FILTER (quantity >= 45))::DOUBLE / count(*), 9) AS rate FROM lines CROSS JOIN t GROUP BY {e}" for d, e in _SIX.items()))
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By each of six dimensions the rows, the chosen ones, their share of all rows and the rate of choice."""
    d = _lines(spark, sf_dir)
    keys = {"category": F.col("category"), "item": F.col("item"), "supplier": F.col("supplier_id").cast("string"), "unit": F.col("unit"), "month": F.date_format("order_date", "yyyy-MM"), "season": F.date_format("order_date", "MM")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.alias("grp")) for k, c in keys.items()]))
    counts = d.select(pairs.alias("k"), (F.col("quantity") >= 45).cast("long").alias("hit")).groupBy("k.dimension", "k.grp").agg(F.count("*").alias("n"), F.sum("hit").alias("chosen"))
    total = d.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(total).select("dimension", "grp", "n", "chosen", F.round(F.col("n") / F.col("total"), 9).alias("share"), F.round(F.col("chosen") / F.col("n"), 9).alias("rate"))


@query("a31_diversity", f"WITH {catalog.LINES} SELECT count(DISTINCT item) AS items, count(DISTINCT supplier_id) AS suppliers, count(DISTINCT category) AS categories FROM lines WHERE quantity = 50")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("quantity = 50").agg(F.count_distinct("item").alias("items"), F.count_distinct("supplier_id").alias("suppliers"), F.count_distinct("category").alias("categories"))


@query("a35_ordered_list", "SELECT c_nationkey, to_json(list(c_custkey ORDER BY c_custkey))::VARCHAR AS members FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey")
def a35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's ids as an ordered JSON list."""
    d = tables.read(spark, sf_dir, "customer").where("c_acctbal < 0")
    return d.groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_list("c_custkey"))).alias("members"))


@query("a39_describe", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, " + ", ".join(f"round(quantile_cont({c}, {q}), 6)::DOUBLE AS q{k}" for k, q in enumerate((0.05, 0.5, 0.95))) + " FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def a39(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.describe(tables.read(spark, sf_dir, "lineitem", ["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"], [0.05, 0.5, 0.95])
    return d.select("feature", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *[F.round(f"q{k}", 6).alias(f"q{k}") for k in range(3)])


@query("a40_summaries", f"WITH {catalog.LINES} " + " UNION ALL ".join(f"SELECT '{d}' AS level, {e} AS grp, count(*) AS n, round(avg((unit = 'R')::INT), 9) AS rate, round(avg(quantity), 6) AS quantity FROM lines GROUP BY {e}" for d, e in {"item": "item", "supplier": "supplier_id::VARCHAR", "pair": "item || '/' || supplier_id", "unit": "unit", "category": "category"}.items()))
def a40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and rates of five kinds of groups."""
    d, out = _lines(spark, sf_dir), None
    keys = {"item": F.col("item"), "supplier": F.col("supplier_id").cast("string"), "pair": F.concat_ws("/", "item", F.col("supplier_id").cast("string")), "unit": F.col("unit"), "category": F.col("category")}
    for level, key in keys.items():
        row = d.groupBy(key.alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("unit") == "R").cast("int")), 9).alias("rate"), F.round(F.avg("quantity"), 6).alias("quantity")).withColumn("level", F.lit(level))
        out = row if out is None else out.unionByName(row)
    return out


@query("a42_variation_within", f"WITH {catalog.LINES}, m AS (SELECT item, date_trunc('month', order_date) AS m, stddev_samp(quantity) / avg(quantity) AS cv FROM lines GROUP BY ALL HAVING count(*) > 1) SELECT item, round(avg(cv), 9) AS cv_within FROM m GROUP BY item")
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean coefficient of variation within a month."""
    m = _lines(spark, sf_dir).groupBy("item", F.date_trunc("month", "order_date").alias("m")).agg((F.stddev_samp("quantity") / F.avg("quantity")).alias("cv"), F.count("*").alias("c")).where("c > 1")
    return m.groupBy("item").agg(F.round(F.avg("cv"), 9).alias("cv_within"))


_SPARSE = "SELECT l_quantity AS a, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice END AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS c, 1.0::DOUBLE AS d FROM lineitem"


def _rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query("a43_a45_correlations", f"WITH s AS ({_SPARSE}) " + " UNION ALL ".join(f"SELECT '{x}' AS first, '{y}' AS second, count(*) AS support, " + ("NULL::DOUBLE AS pearson, NULL::DOUBLE AS spearman" if "d" in (x, y) else "round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman") + f" FROM (SELECT x, y, {_rank('x')} AS rx, {_rank('y')} AS ry FROM (SELECT {x} AS x, {y} AS y FROM s) WHERE x IS NOT NULL AND y IS NOT NULL)" for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")))
def a43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all pairs over the rows that have both, with support; a constant column has none."""
    d = tables.read(spark, sf_dir, "lineitem", ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount"])
    s = d.select(F.col("l_quantity").alias("a"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice")).alias("b"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("c"), F.lit(1.0).alias("d"))
    out = profile.correlation_pairs(s, ["a", "b", "c", "d"])
    return out.select("first", "second", "support", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman")).orderBy(F.abs("pearson").desc_nulls_last(), "first", "second")


@query("a48_mode_share", "SELECT max(c)::DOUBLE / sum(c) AS mode_share FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)")
def a48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem", ["l_quantity"]).groupBy("l_quantity").agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("mode_share"))


@query("a52_distance", f"""WITH {_INVOICES}, g AS (SELECT amount AS x, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b FROM invoices WHERE split <> 'test' GROUP BY amount),
  c AS (SELECT *, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS g, min(CASE WHEN a > 0 THEN x END) OVER () AS lo, max(CASE WHEN a > 0 THEN x END) OVER () AS hi FROM g)
  SELECT round(max(abs(f - g)), 9) AS distance, CAST(sum(CASE WHEN x < lo OR x > hi THEN b ELSE 0 END) AS BIGINT) AS outside FROM c""")
def a52(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = profile.distribution_distance(invoices.invoices(spark, sf_dir), "amount", "split", "train", "val")
    return d.select(F.round("distance", 9).alias("distance"), "outside")


@query("u07_multisets", "SELECT l_partkey, l_quantity, CAST(sum(s) AS BIGINT) AS surplus FROM (SELECT l_partkey, l_quantity, 1 AS s FROM lineitem WHERE l_discount > 0.02 UNION ALL SELECT l_partkey, l_quantity, -1 FROM lineitem WHERE l_discount < 0.09) GROUP BY ALL HAVING sum(s) <> 0")
def u07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which rows two tables differ, missing and extra ones alike."""
    d = tables.read(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity", "l_discount"])
    return profile.multiset_difference(d.where("l_discount > 0.02").drop("l_discount"), d.where("l_discount < 0.09").drop("l_discount"))


@query("u06_column_differences", "SELECT * FROM (VALUES ('o_comment', 'missing'), ('o_orderpriority', 'unknown'), ('o_totalprice', 'unknown'), ('o_orderdate', 'unknown')) v(name, finding)")
def u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_differences(tables.read(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_comment"])


@query("w12_ranks", f"WITH {catalog.EVALUATED} SELECT doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS avg_rank FROM evaluated")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks from counted values, without a task that sees all rows."""
    return profile.average_ranks(evaluated(spark, sf_dir), "score", "avg_rank").select("doc_id", "avg_rank")


@query("w03_rank_contract", f"WITH {catalog.EVALUATED}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM evaluated), p AS (SELECT *, lag(r) OVER (ORDER BY r) AS before, lag(score) OVER (ORDER BY r) AS higher FROM r) SELECT count(*) AS n, count(*) FILTER (r <> coalesce(before, 0) + 1) AS gaps, count(*) FILTER (higher < score) AS disorder FROM p")
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking and the check that its ranks are 1 to n and its scores never rise."""
    d = metrics.ranked(evaluated(spark, sf_dir), "doc_id", "score", "r")
    after = d.select((F.col("r") + 1).alias("r"), F.col("score").alias("before"))
    both = d.join(after, "r", "left")
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return both.agg(F.count("*").alias("n"), n((F.col("r") > 1) & F.col("before").isNull()).alias("gaps"), n(F.col("before") < F.col("score")).alias("disorder"))


@query("t07_hmac_sample", None)
def t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 orders of every priority by keyed hash, under aliases."""
    d = invoices.drawn_per_group(tables.read(spark, sf_dir, "orders", ["o_orderpriority", "o_orderkey"]), "o_orderpriority", "o_orderkey", _SEED, 25)
    return invoices.blinded(d, "o_orderkey", _SEED, "C")


# scalar functions


@query("f05_f06_f08_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS quotient, CASE WHEN l_discount = 0 THEN 'zero_reference' END AS reason,
    gcd(l_orderkey, l_partkey) AS divisor, abs(l_extendedprice * 1.0000000001 - l_extendedprice) <= 1e-9 * l_extendedprice AS close, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS hypotenuse FROM lineitem""")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "lineitem")
    value, reason = X.guarded_ratio(F.col("l_quantity"), F.col("l_discount"))
    price = F.col("l_extendedprice")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 6).alias("quotient"), reason.alias("reason"), X.gcd(F.col("l_orderkey"), F.col("l_partkey")).alias("divisor"), X.is_close(price * 1.0000000001, price).alias("close"), F.round(F.hypot("l_quantity", "l_tax"), 6).alias("hypotenuse"))


@query("f08_exact_sum", "SELECT l_returnflag, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, round(sqrt(sum((l_tax * l_tax)::DECIMAL(18,8))::DOUBLE), 9) AS norm FROM lineitem GROUP BY l_returnflag")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sums that do not hang on the order of addition, and a norm."""
    d = tables.read(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice", "l_tax"])
    return d.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"), F.round(F.sqrt(F.sum((F.col("l_tax") * F.col("l_tax")).cast("decimal(18,8)")).cast("double")), 9).alias("norm"))


_TEXTS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Net ' || event_id WHEN 1 THEN ' PO-2024-' || event_id WHEN 2 THEN 'PO-2024-' || event_id WHEN 3 THEN '' WHEN 4 THEN '[a|b] <' || event_id || '>' || chr(10) ELSE NULL END AS s,
    CASE event_id % 5 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' WHEN 2 THEN '2024-2-1' WHEN 3 THEN '2024-12-31' END AS d,
    CASE event_id % 6 WHEN 0 THEN '12.50' WHEN 1 THEN '1200' WHEN 2 THEN '0,5' WHEN 3 THEN '01.5' WHEN 4 THEN '1e3' ELSE '7.100000' END AS x FROM events"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "events", ["event_id"])
    i, t = F.col("event_id"), F.col("event_id").cast("string")
    pick = lambda m, *values: F.element_at(F.array(*[F.lit(v) if v is None or isinstance(v, str) else v for v in values]), (i % m + 1).cast("int"))
    return d.select(
        "event_id", pick(6, F.concat(F.lit("Net "), t), F.concat(F.lit(" PO-2024-"), t), F.concat(F.lit("PO-2024-"), t), "", F.concat(F.lit("[a|b] <"), t, F.lit(">\n")), None).alias("s"),
        pick(5, "2024-02-29", "2023-02-29", "2024-2-1", "2024-12-31", None).alias("d"), pick(6, "12.50", "1200", "0,5", "01.5", "1e3", "7.100000").alias("x"),
    )


@query("f09_f10_f12_texts", f"""WITH t AS ({_TEXTS}) SELECT event_id, TRY_CAST(nullif(regexp_extract(s, '([0-9]+)', 1), '') AS INT) AS first_number, nullif(regexp_extract(s, '^Net ([0-9]+)$', 1), '') AS net, nullif(regexp_extract(s, '^PO-[0-9]{{4}}-([0-9]+)$', 1), '') AS po,
    coalesce(length(s) > 0 AND trim(s) = s AND NOT regexp_matches(s, '[\\x00-\\x1f\\x7f]') AND regexp_full_match(s, 'PO-[0-9]{{4}}-[0-9]+'), false) AS clean,
    coalesce(replace(replace(replace(replace(replace(replace(replace(s, chr(10), ' '), chr(13), ' '), '|', '\\|'), '<', '&lt;'), '>', '&gt;'), '[', '\\['), ']', '\\]'), 'Não informado') AS escaped FROM t""")
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    got = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    return _texts(spark, sf_dir).select("event_id", got(r"([0-9]+)").cast("int").alias("first_number"), got(r"\ANet ([0-9]+)\z").alias("net"), got(r"\APO-[0-9]{4}-([0-9]+)\z").alias("po"), X.clean_text(s, r"PO-[0-9]{4}-[0-9]+").alias("clean"), X.escape_markdown(s).alias("escaped"))


@query("f14_utf8", r"SELECT bool_and(try(decode(encode(text))) IS NOT NULL) AS good, bool_or(try(decode(encode(text) || '\xC3\x28'::BLOB)) IS NOT NULL) AS bad, count(*) AS n FROM documents WHERE text IS NOT NULL")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.read(spark, sf_dir, "documents", ["text"]).where("text IS NOT NULL").agg(F.bool_and(X.valid_utf8(F.col("text").cast("binary"))).alias("good"), F.bool_or(X.valid_utf8(F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xc3\x28"))))).alias("bad"), F.count("*").alias("n"))
    return d.select("good", "bad", "n")


@query("f16_strict_dates", f"WITH t AS ({_TEXTS}) SELECT d, CASE WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(d AS DATE) END AS day, count(*) AS n FROM t GROUP BY ALL")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).groupBy("d", X.strict_date(F.col("d")).alias("day")).agg(F.count("*").alias("n"))


@query("f18_f19_instants", """WITH t AS (SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN '.1239Z' WHEN 1 THEN '+03:00' ELSE '' END AS s, date_trunc('second', ts) AS base FROM events),
  i AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN base + INTERVAL 123 MILLISECOND WHEN 1 THEN base - INTERVAL 3 HOUR END AS t FROM t)
  SELECT event_id, strftime(t, '%Y-%m-%dT%H:%M:%S.') || lpad((extract(millisecond FROM t)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z' AS utc, CAST(t - INTERVAL 3 HOUR AS DATE) AS local_day FROM i""")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instants from text (no offset: none), in UTC, and the civil day three hours west."""
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.element_at(F.array(F.lit(".1239Z"), F.lit("+03:00"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int"))
    t = X.instant(F.concat(base, end))
    return tables.read(spark, sf_dir, "events", ["event_id", "ts"]).select("event_id", X.utc_text(t).alias("utc"), X.civil_day(t, "-03:00").alias("local_day"))


@query("f21_digest", "SELECT o_custkey, sha256(to_json(list(o_orderkey ORDER BY o_orderkey))::VARCHAR) AS digest FROM orders GROUP BY o_custkey")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "orders", ["o_custkey", "o_orderkey"]).groupBy("o_custkey").agg(X.id_digest(F.col("o_orderkey")).alias("digest"))


@query("f24_f27_arrays", """WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
  SELECT o_custkey, len(l)::INT AS n, l[(len(l) + 1) // 2] AS middle, len(list_distinct(list_transform(l, lambda x: x % 7)))::INT AS kinds, len(list_filter(l, lambda x: x < 5000))::INT AS before, to_json(l[1:3])::VARCHAR AS head,
    coalesce(map_extract_value(map(l, range(1, len(l) + 1)), l[len(l)]), 0) AS place FROM a""")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middle of a sorted list, distinct kinds, place to insert, slice, zipped map with a default."""
    d = tables.read(spark, sf_dir, "orders", ["o_custkey", "o_orderkey"]).groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    n = F.size("l")
    places = F.map_from_arrays("l", F.sequence(F.lit(1).cast("long"), n.cast("long")))
    return d.select("o_custkey", n.alias("n"), F.element_at("l", F.floor((n + 1) / 2).cast("int")).alias("middle"), F.size(F.array_distinct(F.transform("l", lambda x: x % 7))).alias("kinds"), F.size(F.filter("l", lambda x: x < 5000)).alias("before"), F.to_json(F.slice("l", 1, 3)).alias("head"), F.coalesce(F.try_element_at(places, F.element_at("l", -1)), F.lit(0)).alias("place"))


@query("f28_f29_json", """SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_number, json_keys(props) = ['k'] AS shape, to_json({'id': event_id, 'kind': event_type})::VARCHAR AS built FROM events""")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a member as text, its type, the exact set of keys, and an object built from columns."""
    k = F.get_json_object("props", "$.k")
    return tables.read(spark, sf_dir, "events").select("event_id", k.alias("k"), k.rlike(r"\A-?[0-9]+\z").alias("is_number"), X.keys_are(F.col("props"), ["k"]).alias("shape"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("built"))


@query("f30_f31_f36_numbers", f"""WITH t AS ({_TEXTS}) SELECT event_id, CASE WHEN regexp_full_match(x, '(0|[1-9][0-9]{{0,11}})([.][0-9]{{1,6}})?') THEN x::DECIMAL(18,6)::DOUBLE END AS exact, CASE WHEN contains(x, '.') THEN regexp_replace(x, '[.]?0+$', '') ELSE x END AS canonical,
    CASE x WHEN '12.50' THEN 1250 WHEN '1200' THEN 120000 WHEN '0,5' THEN 50 WHEN '01.5' THEN 150 END::BIGINT AS cents, CASE x WHEN '12.50' THEN 'R$ 12,50' WHEN '1200' THEN 'R$ 1.200,00' WHEN '0,5' THEN 'R$ 0,50' WHEN '01.5' THEN 'R$ 1,50' END AS shown FROM t""")
def f30(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    cents = X.cents_of(x)
    return _texts(spark, sf_dir).select("event_id", X.exact_decimal(x, 18, 6).cast("double").alias("exact"), X.canonical_number(x).alias("canonical"), cents.alias("cents"), X.format_cents(cents).alias("shown"))


@query("f13_text_parts", "SELECT s_suppkey, lower(s_name) AS name, lpad(s_suppkey::VARCHAR, 6, '0') AS padded, split_part(s_name, '#', 1) AS stem, starts_with(s_name, 'Supplier') AS starts FROM supplier")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return tables.read(spark, sf_dir, "supplier").select("s_suppkey", F.lower(name).alias("name"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("padded"), F.split_part(name, F.lit("#"), F.lit(1)).alias("stem"), F.startswith(name, F.lit("Supplier")).alias("starts"))


@query("f35_ordinality", "SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS place FROM conversations")
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the elements of a list with their places."""
    d = tables.read(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return d.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "word")).select("conv_id", "turn", "word", (F.col("p") + 1).cast("long").alias("place"))


# domains

_CYCLES = ", ".join(f"round({f}(2 * pi() * {x} / {n}), 6) + 0 AS {name}_{f}" for name, x, n in (("hour", "hour", 24), ("dow", "(isodow(invoice_date) - 1)", 7), ("month", "(month(invoice_date) - 1)", 12)) for f in ("sin", "cos"))


@query("d01_all_features", f"""WITH {_INVOICES}, t AS (SELECT * FROM invoices WHERE split = 'train'), s AS (SELECT supplier_id, count(*) n, avg(amount) m, stddev_samp(amount) d FROM t GROUP BY ALL), e AS (SELECT department_id, count(*) n, avg(amount) m FROM t GROUP BY ALL),
  p AS (SELECT supplier_id, department_id, count(*) n FROM t GROUP BY ALL), c AS (SELECT country, count(*) n FROM t GROUP BY ALL), g AS (SELECT avg(amount) m, stddev_samp(amount) d FROM t)
  SELECT invoice_id, split, is_fraud, fraud_type, amount, round(ln(1 + amount), 6) AS log_amount, age AS supplier_age_days, coalesce(s.n, 0) AS supplier_frequency, coalesce(c.n, 0) AS country_frequency, round(amount / coalesce(s.m, g.m), 6) AS amount_vs_supplier_mean,
    round((amount - coalesce(s.m, g.m)) / coalesce(nullif(s.d, 0), g.d), 6) + 0 AS supplier_amount_zscore, coalesce(e.n, 0) AS department_frequency, round(amount / coalesce(e.m, g.m), 6) AS amount_vs_department_mean, coalesce(p.n, 0) AS supplier_department_frequency,
    days::INT AS payment_terms_days, CASE kind WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS invoice_type_encoded, {_CYCLES}, (isodow(invoice_date) >= 6)::INT AS is_weekend
  FROM invoices i LEFT JOIN s ON i.supplier_id = s.supplier_id LEFT JOIN e ON i.department_id = e.department_id LEFT JOIN p ON i.supplier_id = p.supplier_id AND i.department_id = p.department_id LEFT JOIN c ON i.country = c.country CROSS JOIN g""")
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nineteen features in their order."""
    d = invoices.featured(invoices.invoices(spark, sf_dir))
    rounded = ("log_amount", "amount_vs_supplier_mean", "supplier_amount_zscore", "amount_vs_department_mean", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
    return d.withColumns({c: F.round(c, 6) + 0.0 for c in rounded})


_CLOSE = "CASE WHEN abs({0} - {1}) <= 1e-9 * greatest(abs({0}), abs({1})) THEN 0 ELSE 1 END"


@query("d02_history_checks", f"""WITH {_INVOICES}, t AS (SELECT * FROM invoices WHERE split = 'train'), g AS (SELECT count(*) AS gn, avg(amount) AS gm, stddev_samp(amount) AS gs FROM t),
  s AS (SELECT supplier_id, count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS d, any_value(country) AS country FROM t GROUP BY ALL), e AS (SELECT department_id, count(*) AS n, avg(amount) AS m FROM t GROUP BY ALL),
  p AS (SELECT supplier_id, department_id, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT country, count(*) AS n FROM t WHERE country IS NOT NULL GROUP BY ALL),
  x AS (SELECT sum(n) AS n, sum(n / gn * m) AS m, sqrt(sum(CASE WHEN n > 1 THEN (n - 1) / (gn - 1) * d * d ELSE 0 END + n / (gn - 1) * (m - gm) ** 2)) AS d, any_value(gn) AS gn, any_value(gm) AS gm, any_value(gs) AS gs FROM s CROSS JOIN g),
  y AS (SELECT sum(n) AS n, sum(n / gn * m) AS m, sqrt(sum(n / (gn - 1) * (m - gm) ** 2)) AS d, any_value(gn) AS gn, any_value(gm) AS gm, any_value(gs) AS gs FROM e CROSS JOIN g)
  SELECT "check", faults::BIGINT AS faults FROM (SELECT 'supplier_counts' AS "check", CASE WHEN n = gn THEN 0 ELSE 1 END AS faults FROM x UNION ALL SELECT 'supplier_means', {_CLOSE.format('m', 'gm')} FROM x UNION ALL SELECT 'pooled_deviation', {_CLOSE.format('d', 'gs')} FROM x
    UNION ALL SELECT 'singleton_deviations', count(*) FILTER ((n = 1) <> (d IS NULL)) FROM s UNION ALL SELECT 'impossible_deviations', count(*) FILTER (d / sqrt(n) > m * (1 + 1e-9)) FROM s
    UNION ALL SELECT 'department_counts', CASE WHEN n = gn THEN 0 ELSE 1 END FROM y UNION ALL SELECT 'department_means', {_CLOSE.format('m', 'gm')} FROM y UNION ALL SELECT 'department_spread', CASE WHEN d <= gs * (1 + 1e-9) THEN 0 ELSE 1 END FROM y
    UNION ALL SELECT 'country_counts', count(*) FILTER (a.n IS DISTINCT FROM c.n) FROM (SELECT country, sum(n) AS n FROM s GROUP BY country) a FULL JOIN c ON c.country = a.country
    UNION ALL SELECT 'pair_suppliers', count(*) FILTER (a.n IS DISTINCT FROM s.n) FROM (SELECT supplier_id, sum(n) AS n FROM p GROUP BY supplier_id) a FULL JOIN s ON s.supplier_id = a.supplier_id
    UNION ALL SELECT 'pair_departments', count(*) FILTER (a.n IS DISTINCT FROM e.n) FROM (SELECT department_id, sum(n) AS n FROM p GROUP BY department_id) a FULL JOIN e ON e.department_id = a.department_id) z""")
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history made by references() has no fault; tests break each check."""
    return invoices.history_faults(invoices.references(invoices.invoices(spark, sf_dir)))


_WHOLE = ", ".join(f"'{c}'" for c in invoices.FEATURES), ", ".join(f"{c}::DOUBLE" for c in invoices.FEATURES)


@query("a17_standardised", f"""WITH f AS ({ORACLES["d01_all_features"]}), m AS (SELECT {", ".join(f"avg({c}::DOUBLE) AS m_{c}, stddev_pop({c}::DOUBLE) AS d_{c}" for c in invoices.FEATURES)} FROM f WHERE split = 'train')
  SELECT invoice_id, split, {", ".join(f"round(({c} - m_{c}) / nullif(d_{c}, 0), 5) + 0 AS {c}" for c in invoices.FEATURES)} FROM f CROSS JOIN m""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nineteen features scaled by TRAIN."""
    d = invoices.standardised(d01(spark, sf_dir), invoices.FEATURES, F.col("split") == "train")
    return d.select("invoice_id", "split", *[(F.round(c, 5) + 0.0).alias(c) for c in invoices.FEATURES])


@query("d22_pool_sizes", f"""WITH f AS ({ORACLES["d01_all_features"]}), r AS (SELECT invoice_id, max(supplier_amount_zscore) AS z, max(amount) AS amount FROM f GROUP BY invoice_id),
  k AS (SELECT *, row_number() OVER (ORDER BY z DESC, invoice_id) AS a, row_number() OVER (ORDER BY amount DESC, invoice_id) AS b, count(*) OVER () AS n FROM r), b AS (SELECT unnest([1, 5, 10]) AS budget)
  SELECT budget, CASE WHEN a <= (n * budget + 99) // 100 AND b <= (n * budget + 99) // 100 THEN 'both' WHEN a <= (n * budget + 99) // 100 THEN 'a_only' WHEN b <= (n * budget + 99) // 100 THEN 'b_only' ELSE 'neither' END AS pool, count(*) AS n FROM k CROSS JOIN b GROUP BY ALL""".replace("CROSS JOIN b GROUP", "CROSS JOIN b bb GROUP"))
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many invoices are in each pool of each budget, by z-score and by amount."""
    d = d01(spark, sf_dir).groupBy("invoice_id").agg(F.max("supplier_amount_zscore").alias("z"), F.max("amount").alias("amount"))
    return invoices.pools(d, "invoice_id", "z", "amount").groupBy("budget", "pool").agg(F.count("*").alias("n"))


@query("a06_census", f"""WITH f AS ({ORACLES["d01_all_features"]}), v AS (SELECT unnest([{_WHOLE[0]}]) AS feature, unnest([{_WHOLE[1]}]) AS x FROM f)
  SELECT feature, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (NOT isfinite(x)) AS BIGINT) AS infinite FROM v GROUP BY feature""")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and infinite values of all nineteen features."""
    return profile.census(invoices.featured(invoices.invoices(spark, sf_dir)), list(invoices.FEATURES))


@query("d05_drift", f"""WITH f AS ({ORACLES["d01_all_features"]}), v AS (SELECT split, unnest([{_WHOLE[0]}]) AS feature, unnest([{_WHOLE[1]}]) AS x FROM f WHERE split <> 'test'),
  g AS (SELECT feature, x, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'val') AS b FROM v WHERE x IS NOT NULL GROUP BY ALL),
  c AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS p, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS q, min(CASE WHEN a > 0 THEN x END) OVER (PARTITION BY feature) AS lo, max(CASE WHEN a > 0 THEN x END) OVER (PARTITION BY feature) AS hi FROM g WINDOW w AS (PARTITION BY feature ORDER BY x))
  SELECT feature, round(max(abs(p - q)), 9) AS distance, CAST(sum(CASE WHEN x < lo OR x > hi THEN b ELSE 0 END) AS BIGINT) AS outside FROM c GROUP BY feature""")
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRAIN against VAL in all nineteen features."""
    return invoices.drift(d01(spark, sf_dir), invoices.FEATURES).select("feature", F.round("distance", 9).alias("distance"), "outside")


@query("d05_unseen", f"""WITH {_INVOICES}, t AS (SELECT * FROM invoices WHERE split = 'train' AND supplier_id % 9 <> 0), v AS (SELECT * FROM invoices WHERE split = 'val')
  SELECT is_fraud, min(invoice_date) AS first_date, max(invoice_date) AS last_date, count(*) AS n, count(*) FILTER (supplier_id IN (SELECT supplier_id FROM t)) AS seen,
    count(*) FILTER ((supplier_id, department_id) NOT IN (SELECT supplier_id, department_id FROM t)) AS new_pairs, count(*) FILTER (date_trunc('month', invoice_date) NOT IN (SELECT date_trunc('month', invoice_date) FROM t)) AS new_months FROM v GROUP BY is_fraud""")
def d05_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of VAL, and how many of its rows have suppliers, pairs and months that TRAIN has or lacks; every ninth supplier is taken out of TRAIN."""
    d = invoices.invoices(spark, sf_dir).select("split", "supplier_id", "department_id", "is_fraud", "invoice_date", F.trunc("invoice_date", "month").alias("month"))
    train, val = d.where("split = 'train' AND supplier_id % 9 <> 0"), d.where("split = 'val'")
    for name, keys in (("s", ["supplier_id"]), ("p", ["supplier_id", "department_id"]), ("m", ["month"])):
        val = val.join(train.select(*keys).distinct().withColumn(name, F.lit(1)), keys, "left")
    n = lambda c: F.sum(c.cast("long"))
    return val.groupBy("is_fraud").agg(F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"), F.count("*").alias("n"), n(F.col("s").isNotNull()).alias("seen"), n(F.col("p").isNull()).alias("new_pairs"), n(F.col("m").isNull()).alias("new_months"))


@query("d09_batch_matrix", f"""WITH {catalog.FEATURES}, f AS (SELECT *, {catalog.PERIOD} AS period FROM features WHERE price_ratio IS NOT NULL AND price_iqr_distance IS NOT NULL AND relative_iqr IS NOT NULL AND quantity_ratio IS NOT NULL AND total_ratio IS NOT NULL)
  SELECT period, row_number() OVER (PARTITION BY period ORDER BY order_date, po_id, occurrence) - 1 AS index, po_id, order_date, occurrence, round(price_ratio, 6) AS price_ratio, round(total_ratio, 6) AS total_ratio FROM f""")
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model matrix of each period with the trace of each of its rows."""
    d = procurement.matrices(features(spark, sf_dir))
    return d.select("period", "index", "po_id", "order_date", "occurrence", F.round("price_ratio", 6).alias("price_ratio"), F.round("total_ratio", 6).alias("total_ratio"))


@query("d13_counterfactual_features", f"""WITH {catalog.FEATURES}, s AS (SELECT * FROM (VALUES ('A', 1.5, 1), ('B', 2.0, 1), ('C', 1.0, 3), ('D', 1.0, NULL), ('E', 1.5, 3)) v(scenario, factor, times)),
  d AS (SELECT po_id, order_date, occurrence, scenario, unit_price * factor AS p, CASE WHEN times IS NULL THEN greatest(1, round(quantity::DECIMAL(18,1) * 0.1, 0)::BIGINT) ELSE quantity * times END AS q, quantity, median_price, median_quantity, median_total FROM features CROSS JOIN s WHERE n_item >= 20)
  SELECT po_id, order_date, occurrence, scenario, round(p / nullif(median_price, 0), 5) AS price_ratio, round(q / nullif(median_quantity, 0), 6) AS quantity_ratio, round(p * q / nullif(median_total, 0), 4) AS total_ratio FROM d WHERE scenario <> 'D' OR q <> quantity""")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changed line against the references of the unchanged one."""
    d = procurement.counterfactual_features(features(spark, sf_dir).where("n_item >= 20"))
    return d.select("po_id", "order_date", "occurrence", "scenario", F.round("price_ratio", 5).alias("price_ratio"), F.round("quantity_ratio", 6).alias("quantity_ratio"), F.round("total_ratio", 4).alias("total_ratio"))


@query("d14_rule_experiment", f"""WITH {catalog.FEATURES}, b AS (SELECT *, {catalog.PERIOD} AS period, round(greatest(abs(ln(price_ratio)), abs(ln(quantity_ratio))), 9) AS before FROM features WHERE price_ratio IS NOT NULL AND quantity_ratio IS NOT NULL),
  s AS (SELECT * FROM (VALUES ('A', 1.5, 1), ('B', 2.0, 1), ('C', 1.0, 3), ('D', 1.0, NULL), ('E', 1.5, 3)) v(scenario, factor, times)),
  x AS (SELECT *, CASE WHEN times IS NULL THEN greatest(1, round(quantity::DECIMAL(18,1) * 0.1, 0)::BIGINT) ELSE quantity * times END AS q FROM b CROSS JOIN s WHERE period IN ('validation', 'retrospective')),
  y AS (SELECT *, round(greatest(abs(ln(unit_price * factor / median_price)), abs(ln(q / median_quantity))), 9) AS after FROM x WHERE scenario <> 'D' OR q <> quantity)
  SELECT period, scenario, category, count(*) AS valid, CASE WHEN category IS NULL OR count(*) >= 10 THEN count(*) FILTER (after > before) END AS increased, CASE WHEN category IS NULL OR count(*) >= 10 THEN count(*) FILTER (after < before) END AS decreased,
    CASE WHEN category IS NULL OR count(*) >= 10 THEN round(avg(after - before), 6) + 0 END AS mean_delta, CASE WHEN category IS NULL OR count(*) >= 10 THEN round(quantile_cont(after - before, 0.5), 6) + 0 END AS median_delta FROM y GROUP BY GROUPING SETS ((period, scenario), (period, scenario, category))""")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scenarios do to the rule's score of every line of the evaluation periods."""
    return procurement.paired_effects(procurement.rule_experiment(features(spark, sf_dir, "category", of=("price", "quantity"), keyed=False)))


@query("d18_imputed_matrix", """WITH f AS (SELECT user_id, sha256(user_id::VARCHAR) AS h, avg(CASE WHEN event_type = 'click' THEN value END) AS clicks, avg(CASE WHEN event_type = 'purchase' THEN value END) AS purchases, max(CASE WHEN event_type = 'view' THEN value END) AS views FROM events GROUP BY user_id),
  p AS (SELECT *, CASE WHEN h < 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train' WHEN h < 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'validation' ELSE 'test' END AS part FROM f),
  m AS (SELECT quantile_cont(clicks, 0.5) c, quantile_cont(purchases, 0.5) u, quantile_cont(views, 0.5) v FROM p WHERE part = 'train')
  SELECT user_id, part, round(coalesce(clicks, c), 6) + 0 AS clicks, round(coalesce(purchases, u), 6) + 0 AS purchases, round(coalesce(views, v), 6) + 0 AS views FROM p CROSS JOIN m""")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing features of every partition filled with TRAIN's medians."""
    e = tables.read(spark, sf_dir, "events", ["user_id", "event_type", "value"])
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    d = e.groupBy("user_id").agg(F.avg(of("click")).alias("clicks"), F.avg(of("purchase")).alias("purchases"), F.max(of("view")).alias("views"))
    h = F.sha2(F.col("user_id").cast("string"), 256)
    d = d.withColumn("part", F.when(h < _TRAIN, "train").when(h < _VAL, "validation").otherwise("test"))
    filled = d
    for c in ("clicks", "purchases", "views"):
        median = profile.quantiles(d.where("part = 'train'"), c, [0.5]).select(F.col("q0").alias("__m"))
        filled = filled.crossJoin(median).withColumn(c, F.round(F.coalesce(c, "__m"), 6) + 0.0).drop("__m")  # one row
    return filled


@query("p19_price_on_nine_keys", f"""WITH {catalog.LINES}, k AS (SELECT l.*, o_orderpriority AS terms, l_linestatus AS zone, (l_linenumber % 2 = 0) AS same_only, p_size_group FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS po_id, CAST(l_shipdate AS DATE) AS order_date,
    date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::BIGINT AS day, p_brand AS item, p_type AS specification, l_returnflag AS unit, l_suppkey AS supplier_id, l_quantity::BIGINT AS quantity, round(l_extendedprice / l_quantity * 100)::BIGINT AS cents, l_partkey AS part_id, l_orderkey, l_linenumber, l_linestatus, l_partkey % 3 AS p_size_group FROM lineitem JOIN part ON l_partkey = p_partkey) l JOIN orders ON l_orderkey = o_orderkey),
  r AS (SELECT a.po_id, a.part_id, a.supplier_id, a.day, a.cents, b.cents AS ref, b.supplier_id AS rs, b.day AS rd FROM k a JOIN k b ON a.item = b.item AND a.specification = b.specification AND a.unit = b.unit AND a.zone = b.zone AND a.terms = b.terms AND a.p_size_group = b.p_size_group AND a.same_only = b.same_only
    AND b.po_id <> a.po_id AND b.day >= a.day - 90 AND b.day < a.day AND b.day + b.part_id % 30 < a.day AND (NOT a.same_only OR a.quantity = b.quantity))
  SELECT po_id, part_id, supplier_id, day, cents, count(*) AS n, count(DISTINCT rd) AS dates, count(DISTINCT rs) AS suppliers, (2 * quantile_cont(ref, 0.5))::BIGINT AS twice_median_cents FROM r GROUP BY ALL""")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that agree in every key of comparability, with equal quantity where only that is comparable."""
    columns = ["po_id", "part_id", "supplier_id", "day", "cents"]
    return _analysed(spark, sf_dir, "spread", "median", shown=columns).where("n > 0").select(*columns, "n", "dates", "suppliers", "twice_median_cents")


def _analysed(spark: SparkSession, sf_dir: str, *parts: str, shown: list[str] | None = None) -> DataFrame:
    """D15 on all keys; quantities have to agree where only equal ones are comparable."""
    quantity = F.when(F.col("same_only"), F.col("quantity"))
    keys = [F.col(c) for c in procurement.GROUP_KEYS if c != "item"]
    return prices.price_analysis(procurement.comparable_keys(spark, sf_dir), procurement.available_from(F.col("day"), F.col("part_id")), ["item"], [*keys, quantity], least=1, parts=parts, shown=shown)


_KEYED = f"""{catalog.LINES}, k AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS po_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::BIGINT AS day, p_brand AS item, p_type AS specification, l_returnflag AS unit, l_suppkey AS supplier_id,
    l_quantity::BIGINT AS quantity, round(l_extendedprice / l_quantity * 100)::BIGINT AS cents, l_partkey AS part_id, l_linestatus AS zone, l_partkey % 3 AS packaging, o_orderpriority AS terms, l_linenumber % 2 = 0 AS same_only, row_number() OVER () AS rid FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
  j AS (SELECT o.rid, CASE WHEN r.po_id = o.po_id THEN 'self' WHEN r.day < o.day - 90 OR r.day >= o.day THEN 'outside' WHEN r.day + r.part_id % 30 >= o.day THEN 'late'
    WHEN (r.specification, r.unit, r.packaging, r.terms, r.zone, r.same_only) <> (o.specification, o.unit, o.packaging, o.terms, o.zone, o.same_only) OR (o.same_only AND r.quantity <> o.quantity) THEN 'other' ELSE 'reference' END AS kind FROM k o JOIN k r ON r.item = o.item)"""


@query("d15_exclusion_reasons", f"""WITH {_KEYED}, c AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{x}') AS {n}" for x, n in (("self", "n_self"), ("outside", "n_outside"), ("late", "n_not_available"), ("other", "n_incomparable"), ("reference", "n")))} FROM j GROUP BY rid)
  SELECT po_id, part_id, supplier_id, day, cents, n_self, n_outside, n_not_available, n_incomparable, n FROM k JOIN c USING (rid)""")
def d15_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every operation why each line of its item is or is no reference: own id, dates, the clock of knowledge, nine keys."""
    return _analysed(spark, sf_dir, "reasons").select("po_id", "part_id", "supplier_id", "day", "cents", "n_self", "n_outside", "n_not_available", "n_incomparable", "n")


# the versioned store

_VERSIONS = """versions AS (SELECT o_orderkey AS version_id, o_custkey AS owner, CAST(o_orderdate AS DATE) AS recorded, o_orderstatus AS status, round(o_totalprice * 100)::BIGINT AS cents,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision_no FROM orders)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions of their customers."""
    d = tables.read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"])
    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return d.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("date").alias("recorded"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), number.alias("revision_no"))


@query("v03_normalised_payloads", """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'po_date' WHEN 1 THEN 'fields' WHEN 2 THEN 'amount' END AS fault, count(*) AS n,
    CAST(sum(CASE WHEN o_orderkey % 5 > 2 THEN length('{"description":"order ' || o_orderkey || '","po_date":"' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || '","quantity":"2.000000","unit_price":"3.500000","amount":"7.000000"}') ELSE 0 END) AS BIGINT) AS size FROM orders GROUP BY 1""")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line payloads in one form; wrong dates, unknown fields and too fine amounts are named."""
    d = tables.read(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    i = F.col("o_orderkey") % 5
    day = F.when(i == 0, "2026-02-30").otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"))
    fields = [F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"), day.alias("po_date"), F.lit("2").alias("quantity"), F.lit("3.50").alias("unit_price"), F.when(i == 2, "1.0000001").otherwise("7").alias("amount"), F.when(i == 1, "x").alias("note")]
    clean = store.normalised(d.select(F.to_json(F.struct(*fields)).alias("payload")), "line")
    return clean.groupBy("fault").agg(F.count("*").alias("n"), F.sum(F.when(F.col("fault").isNull(), F.length("payload")).otherwise(0)).alias("size"))


@query("v06_audit_events", f"WITH {_VERSIONS} SELECT version_id, CASE WHEN revision_no = 1 THEN 'create' ELSE 'revise' END AS operation, strftime(recorded, '%Y-%m-%dT00:00:00.000Z') AS at FROM versions")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.audit_events(_versions(spark, sf_dir))


@query("v07_identities", """SELECT 'orders' AS namespace, o_orderkey AS external, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_custkey END AS entity, CASE o_orderkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'refused' WHEN 2 THEN 'resolved' ELSE 'registered' END AS answer FROM orders""")
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known with the same, with another and without an entity, and new ones without a claim."""
    d = tables.read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).select(F.lit("orders").alias("namespace"), F.col("o_orderkey").alias("external"), F.col("o_custkey").alias("entity"))
    m = F.col("external") % 4
    known = d.where(m < 3).withColumn("entity", F.when(m < 2, F.col("entity")))
    incoming = d.withColumn("entity", F.when(m == 3, F.lit(None)).when(m == 1, F.col("entity") + 1).otherwise(F.col("entity")))
    return store.identities(known, incoming)


@query("v08_observations", "SELECT 'tables' AS source, n_regionkey AS external, sha256(n_name) AS content_hash, n_name AS content FROM nation")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations appended once each, though half of them were there and all come twice."""
    d = tables.read(spark, sf_dir, "nation").select(F.lit("tables").alias("source"), F.col("n_regionkey").alias("external"), F.col("n_name").alias("content"))
    before = d.where("external < 2").withColumn("content_hash", F.sha2("content", 256))
    return store.observe(before, d.unionByName(d)).select("source", "external", "content_hash", "content")


@query("v11_snapshot_digests", f"WITH {_VERSIONS}, m AS (SELECT owner % 20 AS snapshot_id, owner, max(revision_no) AS revision_no FROM versions WHERE recorded <= DATE '1996-01-01' GROUP BY owner) SELECT snapshot_id, count(*) AS members, sha256(to_json(list({{'owner': owner, 'revision_no': revision_no}} ORDER BY owner))::VARCHAR) AS digest FROM m GROUP BY snapshot_id")
def v11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as of a day, each with the digest of its ordered members."""
    members = versions.latest(_versions(spark, sf_dir), "1996-01-01").withColumn("snapshot_id", F.col("owner") % 20)
    return store.snapshot_digest(members)


@query("v15_receipt_faults", "SELECT o_custkey || '/' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS key, CASE o_orderkey % 50 WHEN 0 THEN 'body' ELSE 'hash' END AS fault FROM orders QUALIFY o_orderkey % 50 < 2")
def v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts rebuilt from their versions; some bodies and hashes were changed."""
    v = _versions(spark, sf_dir)
    i = F.col("version_id") % 50
    issued = store.receipts(v).withColumns({"body": F.when(i == 0, F.replace("body", F.lit("revision"), F.lit("version"))).otherwise(F.col("body")), "hash": F.when(i == 1, F.reverse("hash")).otherwise(F.col("hash"))})
    return store.receipt_faults(issued, v)


@query("v16_receipt_lookup", "WITH k AS (SELECT o_custkey || '/' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS key FROM orders), a AS (SELECT c_custkey || '/3' AS key FROM customer) SELECT a.key, CASE WHEN k.key IS NULL THEN 'absent' ELSE 'found' END AS answer FROM a LEFT JOIN k ON a.key = k.key")
def v16(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.read(spark, sf_dir, "customer", ["c_custkey"]).select(F.concat(F.col("c_custkey").cast("string"), F.lit("/3")).alias("key"))
    return store.lookup(store.receipts(_versions(spark, sf_dir)), asked).select("key", "answer")


@query("v18_idempotent_create", "WITH s AS (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders GROUP BY o_custkey), i AS (SELECT c_custkey AS k, c_custkey % 3 AS m FROM customer) SELECT i.k, CASE WHEN s.k IS NULL THEN 'created' WHEN m = 0 THEN 'replay' ELSE 'conflict' END AS answer FROM i LEFT JOIN s ON i.k = s.k")
def v18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are new, come again with the same content, or with another."""
    seen = tables.read(spark, sf_dir, "orders", ["o_custkey"]).select(F.col("o_custkey").alias("k"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("content")).distinct()
    c = tables.read(spark, sf_dir, "customer", ["c_custkey"])
    incoming = c.select(F.col("c_custkey").alias("k"), F.sha2(F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("?")), 256).alias("content"))
    return versions.idempotent(seen, incoming, "k", "content").select("k", "answer")


@query("v20_provisioning", "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN 'create' WHEN n_nationkey % 5 = 0 THEN 'conflict' ELSE 'keep' END AS answer FROM nation")
def v20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to create, to keep, or in conflict with what the catalogue has."""
    d = tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    there = d.where("n_nationkey < 20").withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, "other").otherwise(F.col("n_name")))
    return store.provision(there, d, "n_nationkey").select("n_nationkey", "answer")


# models


@query("m07_m08_cross_validation", None)
def m08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds with their own preparation, and the importance of each column."""
    d = evaluated(spark, sf_dir).withColumn("length", F.col("score").cast("double"))
    return models.cross_validated(d, ["length", "quality"], "y", "doc_id")
