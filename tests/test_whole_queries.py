"""The queries over all rows, against brute force on the smallest tables and the subset queries."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerspark.operators import metrics
from ledgerspark.plans import registry
from ledgerspark.sources import tables

SF = "/root/testdata/sf0.001"


def lines(spark):
    got = tables.purchase_lines(spark, SF).select("po_id", "item", "part_id", "supplier_id", "unit", F.unix_date("order_date").alias("day"), F.round(F.col("unit_price") * 100).cast("long").alias("cents")).toPandas()
    return {i: g.reset_index(drop=True) for i, g in got.groupby("item")}, len(got)


def plain(x):
    return None if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float, np.number)) else str(x)


def test_price_counts_and_reasons_of_all_lines(spark):
    groups, total = lines(spark)
    price, clocks, reasons = [], [], Counter()
    for g in groups.values():
        day, known, po, cents = g.day.to_numpy(), (g.day + g.part_id % 30).to_numpy(), g.po_id.to_numpy(), g.cents.to_numpy()
        for k in range(len(g)):
            inside = (day >= day[k] - 90) & (day < day[k])
            own = po == po[k]
            both = inside & (known < day[k])
            clocks.append((po[k], g.part_id[k], g.supplier_id[k], day[k], both.sum()))
            ref = both & ~own
            n, twice = ref.sum(), round(2 * float(np.median(cents[ref]))) if ref.any() else None
            price.append((po[k], g.part_id[k], g.supplier_id[k], day[k], n, len(set(day[ref])), len(set(g.supplier_id[ref])), *(("insufficient_history", None, None) if n < 20 else (None, twice, (2 * cents[k] - twice) * 100.0 / twice))))
            kind = np.where(own, "self", np.where(~inside, "outside_window", np.where(g.part_id % 3 == 0, "not_available", np.where(g.unit != "A", "incomparable", "comparable"))))
            reasons.update(kind.tolist())
    same = lambda a, b: sorted((tuple(map(plain, r)) for r in a), key=repr) == sorted((tuple(map(plain, r)) for r in b), key=repr)
    got = registry.QUERIES["d15_price"](spark, SF).collect()
    assert len(got) == total and same(got, price)
    assert same(registry.QUERIES["j13_two_clocks"](spark, SF).collect(), clocks)
    assert {r["reason"]: r["n"] for r in registry.QUERIES["p20_exclusion_reasons"](spark, SF).collect()} == dict(reasons)


def test_replacement_rank_of_all_rows(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 40), r.choice([None, *range(-4, 12)])) for _ in range(120)]
    got = metrics.replacement_rank(spark.createDataFrame(rows, "doc_id long, score long"), "doc_id", "score", F.col("score") * 2).collect()
    order = sorted(range(120), key=lambda k: (rows[k][1] is None, -(rows[k][1] or 0), rows[k][0]))
    want = []
    for place, k in enumerate(order):
        i, s = rows[k]
        ahead = 0 if s is None else sum(j != i and t is not None and (t > 2 * s or (t == 2 * s and j < i)) for j, t in rows)
        want.append((i, place + 1, ahead + 1))
    spread = lambda x: (sorted((i, b) for i, b, _ in x), sorted((i, a) for i, _, a in x))
    assert spread([tuple(q) for q in got]) == spread(want)
