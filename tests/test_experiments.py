"""Trailing order statistics, carried ranks, scored lines, prepared operations, streams with timers, exactly-once appends, JSON values."""

import datetime as dt
import json
import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import variants as V
from ledgerspark.operators import carried, experiments as E, metrics, prepared, prices, procurement, trailing
from ledgerspark.operators.forest import IsolationForest
from ledgerspark.plans import registry
from ledgerspark.sources import bundles
from ledgerspark.streaming import once, support
from ledgerspark.streaming.trailing import drain

SF = "/root/testdata/sf0.001"
LINE = "po_id string, order_date date, item string, supplier_id long, unit string, part_id long, quantity long, line_total double, unit_price double, category string"


def lines(spark, n=3000, hot=0.5, seed=1):
    """Purchase lines of which one item has half."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        item = "hot" if r.random() < hot else f"i{r.randint(0, 6)}"
        price = r.choice([1.0, 2.5, r.randint(1, 40) / 4, r.uniform(1, 50)])
        rows.append((f"p{k:05d}", dt.date(1995, 1, 1) + dt.timedelta(days=r.randint(0, 500)), item, r.randint(1, 4), r.choice("AN"), k, r.randint(1, 9), price * 3, price, r.choice(["x", "y"])))
    return spark.createDataFrame(rows, LINE), rows


@pytest.mark.parametrize("cuts", [2, 16, 128])
def test_trailing_order_statistics_equal_numpy(spark, cuts):
    r = random.Random(cuts)
    values = [(g * trailing.MEASURES + m, d, r.choice([1.0, 2.0, r.uniform(0, 9), -3.0, None, float("nan")])) for g in range(3) for m in (0, 1) for d in (r.randint(0, 300) for _ in range(400 if g == 0 else 30))]
    entries = spark.createDataFrame([(g, d + 1, d + 90, x) for g, d, x in values], "g long, since long, until long, x double")
    asked = sorted({(g, d) for g, d, _ in values} | {(0, 5000)})
    got = trailing.order_statistics(entries, spark.createDataFrame(asked, "g long, day long"), {0: (0.25, 0.5, 0.75), 1: (0.5,)}, (0,), days=90, cuts=cuts).collect()
    found = {(q["g"], q["day"], q["what"]): (q["n"], q["value"]) for q in got}
    want = {}
    for g, day in asked:
        x = np.array([v for h, d, v in values if h == g and d < day <= d + 90 and v is not None and v == v])
        if len(x):
            for k, q in enumerate((0.25, 0.5, 0.75) if g % trailing.MEASURES == 0 else (0.5,)):
                want[g, day, k] = (len(x), np.quantile(x, q))
            if g % trailing.MEASURES == 0:
                want[g, day, -1] = (len(x), np.median(np.abs(x - np.median(x))))
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-9 for k in want)


def test_features_of_a_hot_item_equal_plain_code(spark):
    d, rows = lines(spark)
    got = {q["po_id"]: q for q in procurement.features(procurement.occurrences(d)).collect()}
    assert len(got) == len(rows)
    for p, day, item, supplier, unit, *_ in rows[::7]:
        ref = [x for x in rows if x[2] == item and 0 < (day - x[1]).days <= 90]
        q, pair = got[p], [x[8] for x in ref if x[3] == supplier]
        assert (q["n_item"], q["n_pair"]) == (len(ref), len(pair))
        assert q["n_supplier"] == sum(x[3] == supplier and 0 < (day - x[1]).days <= 90 for x in rows) and q["n_unit"] == sum(x[4] == unit and 0 < (day - x[1]).days <= 90 for x in rows) and q["n_window"] == sum(0 < (day - x[1]).days <= 90 for x in rows)
        if len(ref) >= 20:
            price = np.array([x[8] for x in ref])
            for name, value in (("q1", np.quantile(price, 0.25)), ("median_price", np.median(price)), ("q3", np.quantile(price, 0.75)), ("mad_price", np.median(abs(price - np.median(price)))), ("median_quantity", np.median([x[6] for x in ref])), ("median_total", np.median([x[7] for x in ref]))):
                assert abs(q[name] - value) < 1e-9, name
        else:
            assert q["price_ratio"] is None and q["price_ratio_reason"] == "insufficient_history"
        assert (q["pair_median"] is None) == (len(pair) < 20) and (q["pair_median"] is None or abs(q["pair_median"] - np.median(pair)) < 1e-9)


def test_features_of_an_empty_table(spark):
    d, _ = lines(spark, 0)
    assert procurement.features(procurement.occurrences(d)).count() == 0


def test_a_date_outside_all_periods_raises(spark):
    d = spark.createDataFrame([(dt.date(1991, 5, 1),)], "d date")
    with pytest.raises(Exception, match="outside all periods"):
        d.select(procurement.period(F.col("d"))).collect()
    assert spark.createDataFrame([(None,)], "d date").select(procurement.period(F.col("d")).alias("p")).first()["p"] is None


def test_carried_ranks_and_replacements(spark):
    r = random.Random(4)
    rows = [(f"k{k:03d}", r.choice("ab"), r.choice([0.25, 0.5, r.random(), None])) for k in range(300)]
    d = spark.createDataFrame(rows, "k string, g string, s double").repartition(5)
    order = sorted(rows, key=lambda x: (x[1], x[2] is None, -(x[2] or 0), x[0]))
    seen: dict = {}
    want = {}
    for k, g, _ in order:
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    assert {q["k"]: q["r"] for q in carried.ranked(d, "s", ["k"], "r", ("g",)).collect()} == want
    got = {q["k"]: q["after_rank"] for q in metrics.replacement_rank(d, "k", "s", F.col("s") * 0.5 + 0.2, ("g",)).collect()}
    for k, g, s in rows:
        t = None if s is None else s * 0.5 + 0.2
        peers = sorted((-x[2], x[0]) for x in rows if x[1] == g and x[0] != k and x[2] is not None)
        assert got[k] == (1 if t is None else bisect_left(peers, (-t, k)) + 1)


def test_forest_draws_rows_one_by_one(spark):
    """Half of the rows are equal; the draw has about half of them, whatever the seed."""
    d = spark.range(10_000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("x"), F.lit(1.0).alias("y"))
    for seed in (1, 2):
        model = IsolationForest(trees=10, sample=256, seed=seed).fit(d, ["x", "y"], ["id"])
        assert max(model.score_array(np.array([[0.0, 1.0]]))) < min(model.score_array(np.array([[9999.0, 1.0], [9000.0, 1.0]])))
        model.calibrate(d, 0.22)
        flags = model.flagged(d)
        above = flags.where("flag = 1").count()
        assert above <= 2200 and flags.where(F.col("anomaly_score") >= model.threshold).count() >= 2200
        assert flags.where((F.col("anomaly_score") == model.threshold) & (F.col("flag") == 1)).isEmpty()


def test_saved_forest_keeps_its_threshold(spark, tmp_path):
    d = spark.range(500).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    model = IsolationForest(trees=5).fit(d, ["x", "y"], ["id"]).calibrate(d, 0.1)
    pin = bundles.save_forest(spark, model, str(tmp_path / "m"))
    again = bundles.load_forest(spark, str(tmp_path / "m"), pin)
    assert again.threshold == model.threshold and again.contamination == 0.1
    assert again.flagged(d).where("flag = 1").count() == model.flagged(d).where("flag = 1").count()


@pytest.fixture(scope="module")
def scored(spark):
    from ledgerspark.sources.shared import written

    return E.eligible(written(procurement.features(procurement.occurrences(lines(spark, 2500, seed=3)[0].withColumn("order_date", F.date_add("order_date", 200)))), "scored"))


def test_reconciliation_names_the_first_fault_and_refuses_it(spark, scored):
    fields = list(E.MODEL_FEATURES)
    ranking = carried.ranked(E.rule(scored), "score", E.KEY, "rank", ("period",))
    catalogue = scored.select("period", *E.KEY, "category")
    assert E.reconciled(ranking, scored, catalogue, fields, ["category"]).where("finding IS NOT NULL").isEmpty()
    assert E.refuse_faults(ranking, E.reconciled(ranking, scored, catalogue, fields, ["category"])).count() == scored.count()
    some = ranking.orderBy("po_id").first()["po_id"]
    mine = F.col("po_id") == some
    broken = {
        "not_ranked": (ranking.where(~mine), scored, catalogue), "not_in_matrix": (ranking, scored.where(~mine), catalogue), "not_in_catalogue": (ranking, scored, catalogue.where(~mine)),
        "rank": (ranking.withColumn("rank", F.when(mine, 10**6).otherwise(F.col("rank"))), scored, catalogue), "total_ratio": (ranking.withColumn("total_ratio", F.when(mine, 0.5).otherwise(F.col("total_ratio"))), scored, catalogue),
        "category": (ranking, scored, catalogue.withColumn("category", F.when(mine, "other").otherwise(F.col("category")))), "repeated_key": (ranking, scored.unionByName(scored.where(mine)), catalogue),
    }
    for finding, (a, b, c) in broken.items():
        found = {q["po_id"]: q["finding"] for q in E.reconciled(a, b, c, fields, ["category"]).where("finding IS NOT NULL").collect()}
        assert found.get(some) == finding
        with pytest.raises(Exception, match="stale or foreign scores"):
            E.refuse_faults(a, E.reconciled(a, b, c, fields, ["category"])).collect()


def test_injections_of_a_forest(spark, scored):
    """Ranks by plain sorting of the forest's own scores; peers keep theirs; D is not applicable where nothing changes."""
    model = E.fitted_forest(scored.withColumn("period", F.lit("development")), trees=20)
    method = E.forest_method(model)
    pairs = E.experiment(scored, {"forest": method}, per_item=2).collect()
    own = [(q["period"], -q["score"], q["po_id"], q["order_date"], q["occurrence"]) for q in method(scored).collect()]
    by: dict = {}
    for period, *key in own:
        by.setdefault(period, []).append(tuple(key))
    for keys in by.values():
        keys.sort()
    assert len(pairs) == 5 * len({(q["po_id"], q["order_date"], q["occurrence"]) for q in pairs})
    for q in pairs:
        ident = (q["po_id"], q["order_date"], q["occurrence"])
        keys = by[q["period"]]
        old = (-q["score_before"], *ident)
        assert keys[q["rank_before"] - 1] == old
        if q["applicable"]:
            rest = [k for k in keys if k != old]
            assert q["rank_after"] == bisect_left(rest, (-q["score_after"], *ident)) + 1
        else:
            assert q["scenario"] == "D" and q["score_after"] is None and q["rank_after"] is None


def test_forest_queries(spark):
    ranking = registry.QUERIES["d10_forest_ranking"](spark, SF).collect()
    assert all(r["score"] > 0 for r in ranking)
    assert {r["period"] for r in registry.QUERIES["d10_forest_report"](spark, SF).collect()} == {p for p, *_ in procurement.PERIODS}
    flags = registry.QUERIES["m06_forest_threshold"](spark, SF).collect()
    train = [r for r in flags if r["split"] == "train"]
    flagged, rows = sum(r["tp"] + r["fp"] for r in train), sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in train)
    assert flagged <= 0.22 * rows + 1 and flagged > 0.1 * rows


def test_paired_bootstrap_within_monte_carlo_bounds(spark):
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 400)
    a, b = np.where(r.random(400) < 0.8, y, 1 - y), np.where(r.random(400) < 0.7, y, 1 - y)
    d = spark.createDataFrame([tuple(map(int, x)) for x in zip(y, a, b)], "y int, a int, b int")
    drawn = E.paired_bootstrap(d, "y", F.col("a"), F.col("b"))
    got = E.interval(drawn, "difference").first()
    at = r.integers(0, 400, (2000, 400))
    plain = (a[at] == y[at]).mean(1) - (b[at] == y[at]).mean(1)
    assert got["draws"] == 2000 and abs(got["mean"] - plain.mean()) < 0.005
    assert abs(got["low"] - np.quantile(plain, 0.025)) < 0.015 and abs(got["high"] - np.quantile(plain, 0.975)) < 0.015
    assert drawn.collect() == E.paired_bootstrap(d, "y", F.col("a"), F.col("b")).collect()
    assert E.paired_bootstrap(d.limit(0), "y", F.col("a"), F.col("b")).count() == 0


def test_prepared_operation_reads_its_own_folders(spark, tmp_path):
    d, _ = lines(spark, 2000)
    d = procurement.occurrences(d)
    store = prepared.lay_out(d, str(tmp_path / "store"))
    catalogue = prepared.authorised(d)
    whole = {q["po_id"]: q for q in procurement.features(d).collect()}
    pick = catalogue.where("item = 'hot'").first()
    got = prepared.one(store, catalogue, pick["po_id"], str(pick["order_date"]), pick["occurrence"]).collect()
    assert len(got) == 1 and all(got[0][c] == whole[pick["po_id"]][c] for c in ("n_item", "n_pair", *prepared.VALUES))
    request = catalogue.where("item = 'hot'")
    folders = prepared.months(request)
    assert folders.count() <= 4
    chosen = folders.collect()
    near = store.where((F.col("bucket") == chosen[0]["bucket"]) & F.col("month").isin([q["month"] for q in chosen]))
    files = lambda x: {f.rsplit("/", 1)[0] for f in (q[0] for q in x.select("_metadata.file_path").distinct().collect())}
    assert len(files(near)) <= 4 < len(files(store))
    assert "PartitionFilters: [isnotnull(bucket" in near._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="authorised"):
        prepared.one(store, catalogue, "nobody", "1995-01-01", 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_trailing_support_with_timers_equals_batch(rocks, tmp_path):
    """Rows late by up to a few days count as in batch; keys that fall silent leave no state."""
    base, r = dt.date(2024, 1, 1), random.Random(6)
    schema, rows = "k string, d date", []
    for step in range(12):
        batch = [(f"k{step}" if r.random() < 0.5 else "all", base + dt.timedelta(days=max(0, 30 * step + r.randint(-3, 20)))) for _ in range(20)]
        rows += batch
        rocks.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for end in (3000, 6000, 9000):  # the watermark goes on: days are told, then dropped
        rocks.createDataFrame([("end", base + dt.timedelta(days=end))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = support.trailing_support(stream, "k", "d", "40 days").writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    days = {(k, (d - dt.date(1970, 1, 1)).days) for k, d in rows}
    at = [(k, (d - dt.date(1970, 1, 1)).days) for k, d in rows]
    got = {(x["key"], x["day"]): (x["n"], x["support"]) for x in rocks.table("timed").collect() if x["key"] != "end"}
    assert got == {(k, d): (at.count((k, d)), sum(j == k and 0 < d - e <= 90 for j, e in at)) for k, d in days}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]]
    assert states[-1] <= 10 < max(states)  # all keys but the last have gone
    rocks.sql("DROP VIEW IF EXISTS timed")


def test_a_batch_run_again_writes_nothing(spark, tmp_path, monkeypatch):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    spark.range(10).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    write, calls = once.write_once, []

    def failing(rows, path, batch):
        calls.append(write(rows, path, batch))
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(once, "write_once", failing)
    with pytest.raises(Exception, match="lost after the write"):
        once.append_once(stream, out, checkpoint).awaitTermination()
    monkeypatch.setattr(once, "write_once", lambda *a: calls.append(write(*a)))
    once.append_once(stream, out, checkpoint).awaitTermination()
    assert calls == [True, False] and sorted(r["id"] for r in once.committed(spark, out).collect()) == list(range(10))
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(source)
    once.append_once(stream, out, checkpoint).awaitTermination()
    assert once.committed(spark, out).count() == 15


def test_json_values(spark):
    d = spark.createDataFrame([(1, '{"k": 5, "b": [1, 2], "a": null}'), (2, '[1, "x"]'), (3, "bad{"), (4, None), (5, '"s"'), (6, "{}"), (7, "true")], "id int, t string").withColumn("v", V.value(F.col("t")))
    got = {q["id"]: q for q in d.select("id", V.kind(F.col("v")).alias("kind"), V.member(F.col("v"), "$.k", "long").alias("k"), V.text(V.minus(F.col("v"), "a", "b")).alias("less"), V.text(V.concat(F.col("v"), F.to_variant_object(F.struct(F.lit(9).alias("k"))))).alias("more")).collect()}
    assert [got[k]["kind"] for k in range(1, 8)] == ["object", "array", None, None, "string", "object", "boolean"]
    assert got[1]["k"] == 5 and got[1]["less"] == '{"k":5}' and got[1]["more"] == '{"a":null,"b":[1,2],"k":9}' and got[6]["more"] == '{"k":9}' and got[2]["less"] is None
    assert [(q["id"], q["pos"], q["key"]) for q in V.each(d, "v").orderBy("id", "pos").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "k"), (2, 0, None), (2, 1, None)]


def test_price_analysis_against_plain_code(spark):
    """Ids that repeat on several days, one group with half of all lines, null ids and prices."""
    r = random.Random(9)
    rows = [(k, r.choice(["own1", "own2", None, f"p{k}"]) if r.random() < 0.2 else f"p{k}", r.randint(0, 260), r.randint(0, 3), r.choice(["hot", "hot", "b", "c"]), r.choice("xy"), r.choice([100, 250, r.randint(1, 900), None]), r.randint(0, 40)) for k in range(700)]
    d = spark.createDataFrame(rows, "k long, po_id string, day long, supplier_id long, item string, unit string, cents long, lag long")
    got = {q["k"]: q for q in prices.price_analysis(d, F.col("day") + F.col("lag"), ["item"], [F.col("unit")], least=5).collect()}
    assert len(got) == len(rows)
    for k, po, day, supplier, item, unit, cents, lag in rows:
        kinds, ref = {"self": 0, "outside": 0, "late": 0, "other": 0}, []
        for x in rows:
            if x[4] != item:
                continue
            if po is not None and x[1] == po:
                kinds["self"] += 1
            elif not day - 90 <= x[2] < day:
                kinds["outside"] += 1
            elif x[2] + x[7] >= day:
                kinds["late"] += 1
            elif x[5] != unit:
                kinds["other"] += 1
            else:
                ref.append(x)
        q = got[k]
        assert (q["n_self"], q["n_outside"], q["n_not_available"], q["n_incomparable"], q["n"]) == (*kinds.values(), len(ref)), k
        assert (q["dates"], q["suppliers"]) == (len({x[2] for x in ref}), len({x[3] for x in ref})), k
        values = [x[6] for x in ref if x[6] is not None]
        assert q["twice_median_cents"] == (None if len(ref) < 5 or not values else int(2 * np.median(values))), k
        assert (q["reason"] == "insufficient_history") == (len(ref) < 5)


def test_review_packets_follow_the_keyed_hash(spark):
    import hashlib
    import hmac

    from ledgerspark.operators import invoices

    key, r = b"k", random.Random(2)
    said = lambda *parts: hmac.new(key, json.dumps(list(map(str, parts)), separators=(",", ":")).encode(), hashlib.sha256).hexdigest()
    rows = [(f"i{k:03d}", r.randint(0, 30) * 1.0, r.random(), r.choice(["s1", "s2", None]), k) for k in range(400)]
    d = spark.createDataFrame(rows, "id string, a double, b double, supplier string, shown int")
    top = lambda c, k: {x[0] for x in sorted(rows, key=lambda x: (-x[c], x[0]))[:k]}
    want = {}
    for budget in (5, 10):
        k = -(-400 * budget // 100)
        a, b = top(1, k), top(2, k)
        for x in rows:
            want[budget, x[0]] = "both" if x[0] in a & b else "a_only" if x[0] in a else "b_only" if x[0] in b else "neither"
    pooled = invoices.pools(d, "id", "a", "b", (5, 10))
    assert {(q["budget"], q["id"]): q["pool"] for q in pooled.collect()} == want
    drawn = invoices.review_sample(pooled.where("pool <> 'both'"), "id", key, 7)
    got = {(q["budget"], q["pool"], q["id"]) for q in drawn.collect()}
    chosen = set()
    for budget in (5, 10):
        for pool in ("a_only", "b_only", "neither"):
            members = [i for (x, i), p in want.items() if (x, p) == (budget, pool)]
            chosen |= {(budget, pool, i) for i in sorted(members, key=lambda i: (said(f"{budget}/{pool}", i), i))[:7]}
    assert got == chosen
    with pytest.raises(Exception, match="too few rows"):
        invoices.review_sample(pooled, "id", key, 300).collect()
    packets = invoices.review_packets(drawn, d.select("id", "supplier", "shown"), "id", {"supplier": "F"}, key).collect()
    ids = {i for *_, i in chosen}
    by_id = {x[0]: x for x in rows}
    for reviewer in "AB":
        order = sorted(ids, key=lambda i: (said("order", reviewer, i), i))
        mine = sorted((q["place"], q["case_id"], q["supplier"], q["shown"]) for q in packets if q["reviewer"] == reviewer)
        assert mine == [(n + 1, "C-" + said("case", reviewer, i)[:16], None if by_id[i][3] is None else "F-" + said("supplier", reviewer, by_id[i][3])[:16], by_id[i][4]) for n, i in enumerate(order)]


def test_standardised_columns(spark):
    from ledgerspark.operators import invoices

    rows = [(k, "train" if k % 3 else "val", float(k * k % 17), 4.0, None if k == 5 else k * 0.5) for k in range(60)]
    d = spark.createDataFrame(rows, "k int, split string, x double, same double, y double")
    got = {q["k"]: q for q in invoices.standardised(d, ("x", "same", "y"), F.col("split") == "train").collect()}
    for c, at in (("x", 2), ("y", 4)):
        train = np.array([q[at] for q in rows if q[1] == "train" and q[at] is not None])
        for q in rows:
            assert got[q[0]]["same"] is None and (got[q[0]][c] is None if q[at] is None else abs(got[q[0]][c] - (q[at] - train.mean()) / train.std()) < 1e-9)
