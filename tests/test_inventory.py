"""The inventory's library where it has to refuse, to name faults, or to agree with plain code."""

import datetime as dt
import hashlib
import hmac
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark import functions as X
from ledgerspark.operators import invoices, metrics, procurement, profile


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalars(spark):
    key, text = b"seed", "[1,\"é\"]"
    r = one(
        spark, mac=X.hmac_sha256(key, F.lit(text)), gcd=X.gcd(F.lit(-84), F.lit(36)), zero=X.gcd(F.lit(0), F.lit(7)), near=X.is_close(F.lit(1.0), F.lit(1.0 + 1e-12)), far=X.is_close(F.lit(1.0), F.lit(1.1)),
        nan=X.is_close(F.lit(float("nan")), F.lit(float("nan"))), leap=X.strict_date(F.lit("2024-02-29")), none=X.strict_date(F.lit("2023-02-29")), loose=X.strict_date(F.lit("2024-2-9")), line=X.clean_text(F.lit("a\n"), "a"),
        cents=X.cents_of(F.lit("1234,5")), bad=X.cents_of(F.lit("1e3")), shown=X.format_cents(F.lit(-123456)), keys=X.keys_are(F.lit('{"b":1,"a":2}'), ["a", "b"]), more=X.keys_are(F.lit('{"b":1,"a":2,"c":3}'), ["a", "b"]),
        exact=X.exact_decimal(F.lit("1.0000001"), 18, 6), plain=X.canonical_number(F.lit("10.500")), whole=X.canonical_number(F.lit("100")), half=X.half_away(F.lit("-0.0000005"), 6), utf=X.valid_utf8(F.lit(bytearray(b"\xff"))),
    )
    assert r["mac"] == hmac.new(key, text.encode(), hashlib.sha256).hexdigest() and (r["gcd"], r["zero"]) == (12, 7)
    assert r["near"] and not r["far"] and not r["nan"] and r["leap"] == dt.date(2024, 2, 29) and r["none"] is r["loose"] is None and not r["line"]
    assert (r["cents"], r["bad"], r["shown"]) == (123450, None, "-R$ 1.234,56") and r["keys"] and not r["more"]
    assert r["exact"] is None and (r["plain"], r["whole"]) == ("10.5", "100") and float(r["half"]) == -1e-6 and not r["utf"]
    with pytest.raises(Exception, match="underflow"):
        one(spark, q=X.guarded_ratio(F.lit(5e-324), F.lit(1e10))[0])


def test_quantiles_and_running_sums_against_plain_code(spark):
    r = random.Random(5)
    data = [(r.choice("ab"), float(r.choice([1, 2, 2, 3, 10, r.random()]))) for _ in range(700)] + [("c", 4.0), (None, 1.0), (None, 3.0), ("a", None)]
    d = spark.createDataFrame(data, "g string, x double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {q["g"]: [q[f"q{k}"] for k in range(5)] for q in profile.quantiles(d, "x", shares, "g").collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.quantile([x for k, x in data if k == g and x is not None], shares))
    ranked = metrics.ranked(d.where("x IS NOT NULL").withColumn("id", F.monotonically_increasing_id()), "id", "x", "r").collect()
    want = sorted(ranked, key=lambda q: (-q["x"], q["id"]))
    assert [q["r"] for q in want] == list(range(1, len(ranked) + 1))
    assert profile.quantiles(d.limit(0), "x", [0.5], "g").isEmpty()


def test_keys_that_repeat_or_miss_end_the_query(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    with pytest.raises(Exception, match="repeated key 1"):
        profile.one_to_one(a, b, "k").collect()
    with pytest.raises(Exception, match="no row for 2"):
        profile.aligned(a, b.limit(1), "k").collect()
    with pytest.raises(Exception, match="several values for 1"):
        profile.required_unique(b, "k", "b").collect()
    assert profile.required_unique(a, "k", "a").count() == 2
    with pytest.raises(Exception, match="too few rows"):
        invoices.drawn_per_group(a, "a", "k", b"s", 2).collect()
    missing, extra = profile.multiset_difference(a, a.union(a.limit(1))), profile.multiset_difference(a.union(a.limit(1)), a)
    assert [q["surplus"] for q in missing.collect()] == [-1] and [q["surplus"] for q in extra.collect()] == [1]


def test_history_faults_are_named(spark):
    rows = invoices.invoices(spark, "/root/testdata/sf0.001")
    good = invoices.references(rows)
    faults = lambda r: {q["check"] for q in invoices.history_faults(r).where("faults > 0").collect()}
    assert faults(good) == set()
    more = F.when(F.col("supplier_id") == F.lit(1), F.col("sn") + 1).otherwise(F.col("sn"))
    assert faults(good | {"supplier": good["supplier"].withColumn("sn", more)}) >= {"supplier_counts", "country_counts", "pair_suppliers"}
    assert "pooled_deviation" in faults(good | {"overall": good["overall"].withColumn("gstd", F.col("gstd") * 1.01)})
    assert "department_means" in faults(good | {"department": good["department"].withColumn("dmean", F.col("dmean") * 2)})
    assert "pair_departments" in faults(good | {"pair": good["pair"].withColumn("pn", F.col("pn") + 1)})


def test_features_against_plain_code(spark):
    r = random.Random(2)
    start = dt.date(2024, 1, 1)
    data = [(f"P{k}", start + dt.timedelta(days=r.randint(0, 200)), r.choice("XXXY"), r.choice([1, 1, 2]), r.choice("UV"), "c", r.randint(1, 9), float(r.randint(1, 500)), r.choice([0.0, 1.5, 2.0, 9.0]), 1) for k in range(400)]
    d = spark.createDataFrame(data, "po_id string, order_date date, item string, supplier_id long, unit string, category string, quantity long, line_total double, unit_price double, part_id long")
    for q in procurement.features(d, covered_from=start).collect():
        past = [x for x in data if 0 < (q["order_date"] - x[1]).days <= 90]
        item = [x for x in past if x[2] == q["item"]]
        pair = [x for x in item if x[3] == q["supplier_id"]]
        assert (q["n_window"], q["n_item"], q["n_pair"]) == (len(past), len(item), len(pair))
        assert (q["n_supplier"], q["n_unit"]) == (sum(x[3] == q["supplier_id"] for x in past), sum(x[4] == q["unit"] for x in past))
        if len(item) >= 20:
            p = np.array([x[8] for x in item])
            assert (q["q1"], q["median_price"], q["q3"]) == pytest.approx(tuple(np.quantile(p, (0.25, 0.5, 0.75)))) and q["mad_price"] == pytest.approx(np.median(np.abs(p - np.median(p))))
            assert q["median_quantity"] == np.median([x[6] for x in item]) and q["median_total"] == np.median([x[7] for x in item])
        if len(pair) >= 20:
            assert q["pair_median"] == np.median([x[8] for x in pair])
        covered = (q["order_date"] - dt.timedelta(days=90)) >= start
        reason = None if covered and len(item) >= 20 and q["median_price"] else "incomplete_coverage" if not covered else "insufficient_history" if len(item) < 20 else "zero_reference"
        assert q["price_ratio_reason"] == reason and (q["price_ratio"] is None) == (reason is not None)


def test_correlation_needs_support_and_variety(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 60)
    d = spark.createDataFrame([(float(a), float(a**3), 1.0, float(a) if k < 10 else None) for k, a in enumerate(x)], "a double, b double, c double, few double")
    got = {(q["first"], q["second"]): q for q in profile.correlation_pairs(d, ["a", "b", "c", "few"]).collect()}
    assert got["a", "b"]["spearman"] == pytest.approx(1) and got["a", "b"]["pearson"] == pytest.approx(np.corrcoef(x, x**3)[0, 1])
    assert got["a", "c"]["pearson"] is None and got["a", "few"]["spearman"] is None and got["a", "few"]["support"] == 10
    assert math.isclose(got["b", "c"]["support"], 60)
