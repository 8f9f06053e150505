"""Steps whose shuffles must not hold whole lines, beside the plain forms that give the same results."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerspark.operators import carried, experiments as E, procurement, profile

DAY = datetime.date(1995, 1, 1)


def purchases(spark, n=1500, seed=5):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        price, quantity = float(r.choice([5, 7, 8, 11, 20])), r.randint(1, 6)
        rows.append((f"P{r.randint(0, n - 200)}", DAY + datetime.timedelta(r.randint(0, 700)), r.choice("IJ"), r.randint(1, 3), "u", "c", quantity, price * quantity, price, k))
    return procurement.occurrences(spark.createDataFrame(rows, "po_id string, order_date date, item string, supplier_id long, unit string, category string, quantity long, line_total double, unit_price double, part_id long"))


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_item_features_without_pairs_shuffle_no_line(spark):
    d = purchases(spark)
    whole, few = procurement.features(d), procurement.features(d, kinds=(), mad=False)
    assert "Exchange hashpartitioning" not in plan(few) and "SortMergeJoin" not in plan(few)
    assert not {"n_pair", "n_supplier", "pair_price_ratio", "mad_price"} & set(few.columns)
    same = [c for c in whole.columns if c in few.columns]
    assert len(same) > 20 and sorted(map(repr, whole.select(*same).collect())) == sorted(map(repr, few.select(*same).collect()))


def test_quantiles_near_their_ranks_are_the_quantiles(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b"]), r.choice([None, 2.0, r.gauss(0, 1), r.gauss(0, 1)])) for _ in range(20_000)]
    d, shares = spark.createDataFrame(rows, "g string, x double"), [0, 0.01, 0.25, 0.5, 0.99, 1]
    plain = lambda got: sorted(map(repr, got.collect()))
    assert plain(profile.near_quantiles(d, "x", shares, "g")) == plain(profile.quantiles(d, "x", shares, "g"))
    assert plain(profile.near_quantiles(d, "x", shares)) == plain(profile.quantiles(d, "x", shares))
    odd = spark.createDataFrame([("a", float("nan"))] * 9 + [("a", float(k)) for k in range(5)], "g string, x double")
    assert plain(profile.near_quantiles(odd, "x", [0, 0.5, 1], "g")) == plain(profile.quantiles(odd, "x", [0, 0.5, 1], "g"))
    assert profile.near_quantiles(d.limit(0), "x", [0.5], "g").isEmpty()


def test_selections_are_those_of_the_ranks(spark):
    lines = E.eligible(procurement.features(purchases(spark), kinds=(), mad=False))
    ranked, chosen = E.both_ranked(lines, E.distance, E.rule, 7), E.both_selected(lines, E.distance, E.rule, 7)
    same = [c for c in chosen.columns]
    assert lines.count() > 500 and sorted(map(repr, ranked.select(*same).collect())) == sorted(map(repr, chosen.collect()))


def test_places_among_all_rows_write_the_asked_ones_alone(spark, monkeypatch):
    r, tables, keep = random.Random(2), [], carried.written
    monkeypatch.setattr(carried, "written", lambda d, label: tables.append(keep(d, label)) or tables[-1])
    rows = [(r.choice([None, "a", "b"]), r.choice([None, float(r.randint(0, 9))]), k) for k in range(3000)]
    held = spark.createDataFrame(rows, "g string, s double, k long")
    asked = held.where("k % 300 = 7 AND s IS NOT NULL")
    got = {q["k"]: q["ahead"] for q in carried.ahead(held, asked, "s", ["k"], ("g",)).collect()}
    want = {k: sum(h == g and t is not None and (t > s or t == s and j < k) for h, t, j in rows) for g, s, k in rows if k % 300 == 7 and s is not None}
    assert got == want and len(tables) == 1 and tables[0].count() < 100


def test_complete_trees_score_like_walked_ones():
    import numpy as np

    from ledgerspark.operators.forest import IsolationForest, complete, grow

    random_ = np.random.default_rng(4)
    x = np.round(random_.lognormal(0, 1, (600, 3)), 1)
    model = IsolationForest(trees=20)
    model.psi, model.nodes = 256, [grow(x[random_.choice(600, 256)], random_, 8) for _ in range(20)]
    x[5, 1] = np.nan
    assert complete(model.nodes) is not None
    assert np.array_equal(model.depths(x, complete(model.nodes)), model.depths(x, None))


def test_queries_write_no_more_of_the_lines_than_they_read(spark, monkeypatch):
    from ledgerspark.plans import registry

    asked, keep = [], procurement.written
    monkeypatch.setattr(procurement, "written", lambda d, label: asked.append((label, d.columns, plan(d))) or keep(d, label))
    registry.QUERIES["a30_directions"](spark, "/root/testdata/sf0.001")
    (columns, text), = [(c, p) for label, c, p in asked if label == "lines"]
    assert sorted(columns) == ["category", "day", "item", "order_date", "quantity", "unit_price"] and "Window" not in text
    d = purchases(spark)
    whole, few = procurement.features(d, kinds=(), mad=False), procurement.features(d.drop("line_total"), kinds=(), mad=False, of=("price", "quantity"))
    assert "total_ratio" not in few.columns
    same = [c for c in few.columns if c in whole.columns]
    assert sorted(map(repr, whole.select(*same).collect())) == sorted(map(repr, few.select(*same).collect()))


def test_effects_read_their_pairs_from_one_written_table(spark, monkeypatch):
    import statistics

    tables, keep = [], procurement.written
    monkeypatch.setattr(procurement, "written", lambda d, label: tables.append(d) or keep(d, label))
    r = random.Random(3)
    rows = [(r.choice("vr"), r.choice("AB"), r.choice([None, "x", "y"]), float(r.randint(0, 9)), float(r.randint(0, 9))) for _ in range(600)] + [("v", "A", "rare", 1.0, 2.0)]
    got = {(q["period"], q["scenario"], q["category"], q["valid"]): (q["increased"], q["median_delta"]) for q in procurement.paired_effects(spark.createDataFrame(rows, "period string, scenario string, category string, before double, after double")).collect()}
    assert tables and tables[0].columns == ["period", "scenario", "category", "delta"] and len(got) == 17
    for p in "vr":
        for s in "AB":
            for keeps, c in ((lambda x: True, None), (lambda x: x is None, None), (lambda x: x == "x", "x")):
                d = [b - a for q, t, k, a, b in rows if (q, t) == (p, s) and keeps(k)]
                assert got[p, s, c, len(d)] == (sum(x > 0 for x in d), statistics.median(d))
    assert got["v", "A", "rare", 1] == (None, None)


def test_price_analysis_makes_only_the_asked_parts_and_pairs_only_shared_ids(spark, monkeypatch):
    from ledgerspark.operators import prices

    r, tables, keep = random.Random(8), {}, prices.written
    rows = [(k, r.choice([None, *[f"P{i}" for i in range(250)]]), r.choice([None, "I", "J"]), r.choice([None, "u", "w"]), r.randint(0, 150), r.randint(0, 20), r.choice([None, 1, 2, 3]), r.choice([None, 100, 250, 300])) for k in range(800)]
    d = spark.createDataFrame(rows, "k long, po_id string, item string, unit string, day long, lag long, supplier_id long, cents long")
    run = lambda *parts: prices.price_analysis(d, F.col("day") + F.col("lag"), ["item"], [F.col("unit")], least=3, parts=parts)
    whole = {q["k"]: q.asDict() for q in run(*prices.PARTS).collect()}
    monkeypatch.setattr(prices, "written", lambda f, label: tables.update({label: keep(f, label)}) or tables[label])
    reasons = [q.asDict() for q in run("reasons").collect()]
    assert not {"by-supplier", "twice_median_cents"} & {*tables, *reasons[0]}
    shared = [q["po_id"] for q in tables["shared"].select("po_id").collect()]
    assert 0 < len(shared) < len(whole) and None not in shared
    monkeypatch.setattr(prices, "written", keep)
    others = [q.asDict() for q in run("spread", "median").collect()]
    monkeypatch.setattr(prices, "SMALL", 0)  # combinations are numbered and joined
    joined = {q["k"]: q.asDict() for q in run(*prices.PARTS).collect()}
    assert joined == whole and "n_self" not in others[0]
    assert len(reasons) == len(others) == len(whole) and all(whole[q["k"]] | q == whole[q["k"]] for q in reasons + others)


def test_item_values_are_counted_where_their_lines_meet(spark, monkeypatch):
    import re

    from ledgerspark.operators import trailing

    plans, keep = {}, trailing.written
    monkeypatch.setattr(trailing, "written", lambda d, label: plans.setdefault(label, plan(d)) and keep(d, label))
    d = purchases(spark)
    few = procurement.features(d, kinds=(), mad=False)
    # lines meet by item and day, their values are not shuffled again; what nobody asks for is not fetched
    assert re.search(r"hashpartitioning\(id#\d+L?, day#", plans["counted"]) and not re.search(r"hashpartitioning\([^)]*x#", plans["counted"])
    assert {"asks", "cells"} <= {*plans}
    monkeypatch.setattr(trailing, "SMALL", 0)
    whole = procurement.features(d, kinds=(), mad=False)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, few.collect()))


def test_trees_compare_places_in_blocks(monkeypatch):
    import numpy as np

    from ledgerspark.operators import forest

    random_ = np.random.default_rng(9)
    x = random_.lognormal(0, 1, (700, 4))
    x[3, 0], x[4, 1] = np.nan, np.inf
    model = forest.IsolationForest(trees=9)
    model.psi, model.nodes = 64, [forest.grow(x[5:][random_.choice(695, 64)], random_, 6) for _ in range(8)] + [forest.grow(np.ones((3, 4)), random_, 2)]
    depth, cuts, trees = forest.complete(model.nodes)
    assert len(cuts) == 4 and all(t.dtype == np.uint8 or t.dtype == np.uint16 for _, t, _ in trees)
    monkeypatch.setattr(forest, "ROWS", 128)
    assert np.array_equal(model.depths(x, (depth, cuts, trees)), model.depths(x, None))
    assert len(model.depths(x[:0], (depth, cuts, trees))) == 0


def test_pools_and_draws_rank_no_row(spark, monkeypatch):
    from ledgerspark.operators import invoices

    r = random.Random(6)
    rows = [(f"i{k:04}", r.choice([None, 1.0, 2.0, r.random()]), float(r.randint(0, 9))) for k in range(900)]
    d = spark.createDataFrame(rows, "id string, a double, b double")
    first = lambda c, k: {q[0] for q in sorted(rows, key=lambda q: (q[c] is None, -(q[c] or 0), q[0]))[:k]}
    want = {(x, i): {(1, 1): "both", (1, 0): "a_only", (0, 1): "b_only", (0, 0): "neither"}[i in first(1, k), i in first(2, k)] for x, k in ((1, 9), (40, 360), (90, 810)) for i, *_ in rows}
    ranked = []
    monkeypatch.setattr(invoices.carried, "ranked", lambda *a: ranked.append(a))
    for limit in (1 << 17, 0):
        monkeypatch.setattr(invoices, "SMALL", limit)
        assert {(q["budget"], q["id"]): q["pool"] for q in invoices.pools(d, "id", "a", "b", (1, 40, 90)).collect()} == want
    assert not ranked and invoices.pools(d.limit(0), "id", "a", "b").count() == 0
    # of a large group only rows with small keys are sorted
    labels, keep = [], invoices.written
    monkeypatch.setattr(invoices, "written", lambda f, label: labels.append(label) or keep(f, label))
    groups = spark.range(3000).selectExpr("id", "if(id < 8, 'few', 'many') AS g")
    got = sorted((q["g"], q["place"], q["id"]) for q in invoices.drawn_per_group(groups, "g", "id", b"s", 6).collect())
    import hashlib
    import hmac
    import json
    key = lambda g, i: hmac.new(b"s", json.dumps([g, str(i)], separators=(",", ":")).encode(), hashlib.sha256).hexdigest()
    plain = [(g, n + 1, i) for g, ids in (("few", range(8)), ("many", range(8, 3000))) for n, i in enumerate(sorted(ids, key=lambda i: key(g, i))[:6])]
    assert got == plain and "sizes" in labels


def test_invoice_rows_and_counts_are_written_once(spark, monkeypatch):
    from ledgerspark.operators import invoices, models
    from ledgerspark.plans import experiments

    made, keep = [], invoices.written
    monkeypatch.setattr(invoices, "written", lambda f, label: made.append((label, plan(f))) or keep(f, label))
    rows = invoices.invoices(spark, "/root/testdata/sf0.001")
    d = invoices.featured(rows)
    assert "lineitem" not in plan(d) and [x for x, p in made if "lineitem" in p] == ["invoices"]
    invoices.drift(d, ("amount", "is_weekend"))
    assert made[-1][0] == "counts"
    # m06 scores a row once, d23 numbers lines once, folds are dealt without a task for each label
    scored = []
    monkeypatch.setattr(experiments.IsolationForest, "score", lambda self, f, name="anomaly_score", run=experiments.IsolationForest.score: scored.append(name) or run(self, f, name))
    experiments.m06(spark, "/root/testdata/sf0.001")
    assert scored == ["anomaly_score"]
    asked = []
    monkeypatch.setattr(experiments.prepared, "authorised", lambda f, run=experiments.prepared.authorised: asked.append(plan(f)) or run(f))
    assert "mad_price" not in experiments.d23(spark, "/root/testdata/sf0.001").columns and "Window" not in asked[0]
    folds = models.folds(spark.range(100).selectExpr("id", "id % 3 AS y"), "y", "id")
    assert "Window" not in plan(folds) and folds.groupBy("y", "fold").count().count() == 15


def test_reconciled_tables_meet_in_one_shuffle_and_sort_no_field(spark, monkeypatch):
    lines = E.eligible(procurement.features(purchases(spark), kinds=(), mad=False))
    sorted_columns, keep = [], carried.carried
    monkeypatch.setattr(carried, "carried", lambda rows, *a, **k: sorted_columns.append(rows.columns) or keep(rows, *a, **k))
    fields, told = list(E.MODEL_FEATURES), E.distance(lines)
    ranking = carried.ranked(told.select("period", *E.KEY, "score"), "score", E.KEY, "rank", ("period",))
    assert "SortMergeJoin" not in plan(ranking) and "rangepartitioning" not in plan(ranking)
    catalogue = lines.select("period", *E.KEY, "category")
    apart = E.reconciled(ranking, lines, catalogue, fields, ["category"], told=told)
    assert plan(apart).count("Exchange hashpartitioning(po_id") == 1 and "FullOuter" not in plan(apart)
    assert not {*fields, "category"} & {c for columns in sorted_columns for c in columns}
    assert apart.where("finding IS NOT NULL").isEmpty() and apart.count() == lines.count() > 500
    # a table that is both matrix and catalogue is shuffled once; what is only sorted by is not written
    one = E.reconciled(ranking, lines, lines, fields, ["category"], told=told)
    assert plan(one).count("Project") < plan(apart).count("Project") and sorted(map(repr, one.collect())) == sorted(map(repr, apart.collect()))
    some_rows = E.reconciled(ranking, lines, lines, fields, ["category"], told=told, stands=("part_id % 7 <> 2", "part_id % 5 <> 3"))
    two = E.reconciled(ranking, lines.where("part_id % 7 <> 2"), catalogue.join(lines.where("part_id % 5 <> 3").select(*E.KEY), E.KEY, "left_semi"), fields, ["category"], told=told)
    assert sorted(map(repr, some_rows.collect())) == sorted(map(repr, two.collect())) and {q["finding"] for q in two.collect()} == {None, "not_in_matrix", "not_in_catalogue"}
    ranks = carried.ranked(told.select("period", *E.KEY, "score"), "score", E.KEY, "rank", ("period",), without=("score",))
    assert "score" not in ranks.columns and sorted(map(repr, ranks.collect())) == sorted(map(repr, ranking.select(*ranks.columns).collect()))
    # faults of fields and of either part of the ranking
    some = lines.groupBy("po_id").count().where("count = 1").orderBy("po_id").first()["po_id"]
    mine = F.col("po_id") == some
    for finding, a, b in (("not_ranked", ranking.where(~mine), told), ("not_ranked", ranking, told.where(~mine)), ("rank", ranking.withColumn("rank", F.when(mine, 0).otherwise(F.col("rank"))), told),
                          ("total_ratio", ranking, told.withColumn("total_ratio", F.when(~mine, F.col("total_ratio")))), ("repeated_key", ranking, told.unionByName(told.where(mine)))):
        assert {q["po_id"]: q["finding"] for q in E.reconciled(a, lines, catalogue, fields, ["category"], told=b).where(mine).collect()} == {some: finding}


def test_prices_of_thin_groups_are_found_in_one_pass_of_bounded_memory(spark, monkeypatch):
    import statistics

    import numpy as np
    import pyarrow as pa

    from ledgerspark.operators import prices

    r, labels, keep = random.Random(12), [], prices.written
    rows = [(k, r.choice([None, *[f"P{i}" for i in range(200)]]), r.choice([None, "I", "I", "J"]), r.choice([None, "u", "w"]), r.randint(-400, 400), r.choice([None, 0, 5, 30, 200]), r.choice([None, 1, 2, 3]), r.choice([None, 100, 250, 300])) for k in range(900)]
    rows += [(900 + k, f"P{k % 7}", "H", "u", k // 60, 0, k % 5, k % 13) for k in range(600)]  # many lines a day, few ids
    d = spark.createDataFrame(rows, "k long, po_id string, item string, unit string, day long, lag long, supplier_id long, cents long")
    monkeypatch.setattr(prices, "written", lambda f, label: labels.append(label) or keep(f, label))
    monkeypatch.setattr(prices, "ROWS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        found = prices.price_analysis(d, F.col("day") + F.col("lag"), ["item"], [F.col("unit")], least=3, parts=("spread", "median"), shown=["k", "cents"])
        got = {q["k"]: (q["n"], q["dates"], q["suppliers"], q["reason"], q["twice_median_cents"]) for q in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, po, item, unit, day, _, _, _ in rows:
        if item is not None:
            refs = [q for q in rows if q[2:4] == (item, unit) and (po is None or q[1] != po) and day - 90 <= q[4] < day and q[4] + (q[5] or 0) < day]
            at = [q[7] for q in refs if q[7] is not None]
            enough = len(refs) >= 3
            want[k] = (len(refs), len({q[4] for q in refs}), len({q[6] for q in refs} - {None}), None if enough else "insufficient_history", int(2 * statistics.median(at)) if enough and at else None)
    assert got == want and sum(n > 300 for n, *_ in got.values()) > 50
    assert found.columns == ["k", "cents", "n", "dates", "suppliers", "reason", "twice_median_cents", "percent_difference"]
    assert set(labels) <= {"operations", "values"} and plan(found.where("n >= 0")).count("Exchange hashpartitioning") == 1
    # pairs are made in pieces, with the same figures
    held = sorted((q for q in rows if q[2] == "H"), key=lambda q: q[4])
    t = pa.table({"g": [0] * 600, "block": [0] * 600, "day": [q[4] for q in held], "since": [q[4] + 1 for q in held], "po_id": [q[1] for q in held], "supplier_id": [q[6] for q in held], "cents": pa.array([q[7] for q in held], pa.int64())})
    whole = prices.visible_figures(t, np.arange(600))
    monkeypatch.setattr(prices, "PAIRS", 100)
    for a, b in zip(whole, prices.visible_figures(t, np.arange(600))):
        assert np.array_equal(a, b, equal_nan=True)
