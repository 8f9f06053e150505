import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerspark.operators import metrics, procurement, versions
from ledgerspark.operators.forest import IsolationForest
from ledgerspark.sources import tables
from ledgerspark.streaming import trailing


def lines(spark, days, prices):
    base = dt.date(2024, 3, 1)
    data = [(f"H-{k}", base + dt.timedelta(days=d), "A", 1, "U", "C", 2 * (k + 1), float(p * 2 * (k + 1)), float(p), 7) for k, (d, p) in enumerate(zip(days, prices))]
    return spark.createDataFrame(data, "po_id string, order_date date, item string, supplier_id long, unit string, category string, quantity long, line_total double, unit_price double, part_id long")


def test_window_edges_and_quartiles(spark):
    # twenty lines of prices 1..20, then one on the next day: quartiles 5.75, 10.5, 15.25
    d = procurement.features(procurement.occurrences(lines(spark, [*range(20), 20, 20, 110, 111], [*range(1, 21), 21, 21, 5, 5])))
    got = {r["po_id"]: r for r in d.collect()}
    assert got["H-19"]["n_item"] == 19 and got["H-19"]["price_ratio"] is None and got["H-19"]["price_ratio_reason"] == "insufficient_history"
    assert got["H-20"]["n_item"] == got["H-21"]["n_item"] == 20  # the same day is out
    assert got["H-20"]["median_price"] == 10.5 and got["H-20"]["iqr"] == 9.5 and got["H-20"]["price_ratio"] == 2.0
    assert got["H-22"]["n_item"] == 2 and got["H-23"]["n_item"] == 1  # t - 90 is in, t - 91 is out


def test_window_does_not_see_the_future(spark):
    a = lines(spark, range(25), range(1, 26))
    past = {r["po_id"]: r["price_ratio"] for r in procurement.features(a.where("po_id <> 'H-24'")).collect()}
    assert {k: v for k, v in ((r["po_id"], r["price_ratio"]) for r in procurement.features(a).collect()) if k != "H-24"} == past


def test_counterfactual_d_skips_what_it_would_not_change(spark):
    one = lines(spark, [0], [3]).withColumn("quantity", F.lit(1).cast("long"))
    assert {r["scenario"] for r in procurement.counterfactuals(one).collect()} == {"A", "B", "C", "E"}


def test_triage_counts_ties(spark):
    d = spark.createDataFrame([(f"{k:03d}", 1.0, int(k >= 90)) for k in range(100)], "id string, s double, y int")
    r = metrics.triage(d, "id", "s", "y", percents=(10,)).first()
    assert (r["k"], r["hits"], r["tied"], r["tied_selected"]) == (10, 0, 100, 10)


def test_ranking_quality_against_pairs(spark):
    random.seed(3)
    data = [(random.randint(0, 1), float(random.randint(0, 9))) for _ in range(200)]
    r = metrics.ranking_quality(spark.createDataFrame(data, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    assert r["roc_auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    none = metrics.ranking_quality(spark.createDataFrame([(0, 1.0)], "y int, s double"), "y", "s").first()
    assert none["roc_auc"] is None and none["average_precision"] is None


def test_forest_ranks_an_outlier_first_and_repeats(spark):
    r = np.random.default_rng(0)
    x = [(int(k), float(a), float(b)) for k, (a, b) in enumerate(r.normal(0, 1, (300, 2)))] + [(300, 9.0, -9.0)]
    d = spark.createDataFrame(x, "id int, a double, b double")
    score = lambda: {q["id"]: q["anomaly_score"] for q in IsolationForest(trees=40).fit(d, ["a", "b"]).score(d).collect()}
    first = score()
    assert max(first, key=first.get) == 300 and first == score() and all(0 < s < 1 for s in first.values())


def test_csv_header_and_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\nx,1\ny,2\n")
    schema = StructType([StructField("id", StringType()), StructField("n", IntegerType())])
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), schema).count() == 2
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), StructType(schema.fields[::-1]))


def test_writes_never_replace(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")
    assert tables.write_checked(d, str(tmp_path / "out")).count() == 2
    with pytest.raises(Exception):
        tables.write_new(d, str(tmp_path / "out"))


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), "a"), (1, 2, dt.date(2024, 2, 1), "b"), (2, 1, dt.date(2024, 1, 5), "c")], "owner int, revision_no int, recorded date, payload string")
    assert {(r["owner"], r["payload"]) for r in versions.latest(v).collect()} == {(1, "b"), (2, "c")}
    assert {(r["owner"], r["payload"]) for r in versions.latest(v, "2024-01-31").collect()} == {(1, "a"), (2, "c")}
    assert versions.chain_faults(v).isEmpty()
    new = versions.append(v, spark.createDataFrame([(1, 2, "z"), (3, None, "n")], "owner int, expected int, payload string"))
    assert {(r["owner"], r["revision_no"]) for r in new.collect()} == {(1, 3), (3, 1)}
    with pytest.raises(versions.StaleHead):
        versions.append(v, spark.createDataFrame([(1, 1, "z")], "owner int, expected int, payload string"))
    assert len({r["digest"] for r in versions.snapshot(v, "2024-03-01").collect()}) == 2


def test_streams_equal_batch(spark, tmp_path):
    base = dt.date(2024, 1, 1)
    rows = [("a" if k % 3 else "b", base + dt.timedelta(days=k * 7)) for k in range(40)]
    spark.createDataFrame(rows, "k string, d date").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, d date").parquet(str(tmp_path / "in"))
    got = {(r["key"], r["day"]): r["support"] for r in trailing.drain(trailing.trailing_support(stream, "k", "d"), "support", str(tmp_path / "c")).collect()}
    for k, d in rows:
        assert got[k, (d - dt.date(1970, 1, 1)).days] == sum(x == k and 0 < (d - e).days <= 90 for x, e in rows)
