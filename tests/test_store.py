"""The versioned store's refusals, bundles, strict JSON, pinned models, and the session that queries leave alone."""

import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import models, store, versions
from ledgerspark.operators.forest import IsolationForest
from ledgerspark.plans import registry
from ledgerspark.sources import bundles, tables
from ledgerspark.streaming import trailing

GOOD = '{"description":"bolts","po_date":"2026-10-01","quantity":"2","unit_price":"3","amount":"9.125"}'


def test_typed_writer(spark):
    v = spark.createDataFrame([(1, 1, "{}")], "owner int, revision_no long, payload string")
    change = lambda payload, expected=1: spark.createDataFrame([(1, expected, payload)], "owner int, expected long, payload string")
    new = store.write(v, change(GOOD), "line").first()
    assert new["revision_no"] == 2 and '"amount":"9.125000"' in new["payload"]
    with pytest.raises(versions.StaleHead):
        store.write(v, change(GOOD, 7), "line").collect()
    for bad, rule in (
        (GOOD.replace("9.125", "1.0000001"), "amount"), (GOOD.replace("9.125", "NaN"), "amount"), (GOOD.replace("9.125", "Infinity"), "amount"), (GOOD.replace("2026-10-01", "2026-02-30"), "po_date"),
        (GOOD.replace("}", ',"note":"x"}'), "fields"), (GOOD.replace('"quantity":"2",', ""), "fields"), ("[1]", "not_an_object"), (GOOD.replace('"bolts"', '" "'), "description"),
    ):
        with pytest.raises(store.Refused, match=rule):
            store.write(v, change(bad), "line")
    missing = '{"name":"Ada","country_code":"ZZ","status":null,"tier":null}'
    assert store.normalised(spark.createDataFrame([(missing,)], "payload string"), "supplier").first()["payload"] == missing


def test_snapshots_are_sealed_once(spark):
    day = dt.date(2024, 5, 1)
    snapshots = spark.createDataFrame([("s", "open", day, None)], "snapshot_id string, state string, cutoff date, digest string")
    members = spark.createDataFrame([("s", 1, 2, day)], "snapshot_id string, owner int, revision_no int, recorded date")
    more = store.add_members(snapshots, members, spark.createDataFrame([("s", 2, 1, day)], members.schema))
    done = store.sealed(snapshots, more, "s")
    assert done.first()["state"] == "sealed" and len(done.first()["digest"]) == 64
    with pytest.raises(store.Refused, match="sealed already"):
        store.sealed(done, more, "s")
    with pytest.raises(store.Refused, match="not open"):
        store.add_members(done, more, members)
    with pytest.raises(store.Refused, match="late member"):
        store.add_members(snapshots, members, spark.createDataFrame([("s", 3, 1, day + dt.timedelta(days=1))], members.schema))


def test_history_pages_join_up(spark):
    rows = [(k, dt.date(2024, 1, 1 + k % 5)) for k in range(23)]
    v = spark.createDataFrame(rows, "version_id int, recorded date")
    seen, at = [], None
    while True:
        page, at = store.history_page(v, 4, at)
        seen += [(q["recorded"], q["version_id"]) for q in page]
        if at is None:
            break
    assert seen == sorted(((d, k) for k, d in rows), reverse=True)


def test_bundles(spark, tmp_path):
    path = f"file://{tmp_path}/bundle"
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    bundles.publish({"d": d}, path, {"note": "é"})
    found, meta = bundles.open_bundle(spark, path)
    assert meta == {"note": "é"} and sorted(map(tuple, found["d"].collect())) == [(1, "a"), (2, None)]
    with pytest.raises(FileExistsError):
        bundles.publish({"d": d}, path)
    d.write.mode("append").parquet(f"{path}/d")
    with pytest.raises(ValueError, match="manifest"):
        bundles.open_bundle(spark, path)


def test_forest_is_saved_and_pinned(spark, tmp_path):
    x = np.random.default_rng(3).normal(0, 1, (300, 2))
    d = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    model = IsolationForest(trees=10).fit(d, ["a", "b"])
    path = f"file://{tmp_path}/forest"
    pin = bundles.save_forest(spark, model, path)
    back = bundles.load_forest(spark, path, pin)
    assert back.columns == ["a", "b"] and np.array_equal(back.score_array(x), model.score_array(x))
    with pytest.raises(ValueError, match="pinned"):
        bundles.load_forest(spark, path, "0")


def test_strict_json_csv_and_archives(spark):
    assert bundles.strict_json('{"a":[1,null]}') == {"a": [1, None]} and bundles.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[Infinity]"):
        with pytest.raises(ValueError):
            bundles.strict_json(bad)
    with pytest.raises(ValueError):
        bundles.canonical_json(float("nan"))
    d = bundles.csv_rows(spark, "﻿id,n\nx,1\n\"y,z\",2\n".encode())
    assert d.dtypes == [("id", "string"), ("n", "int")] and sorted(map(tuple, d.collect())) == [("x", 1), ("y,z", 2)]
    with pytest.raises(ValueError):
        bundles.csv_rows(spark, b"a,b\n1\n")
    with pytest.raises(ValueError):
        bundles.csv_rows(spark, b"a\n" * 10, limit=4)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("deep/data.csv", "x")
    assert bundles.zip_member(buffer.getvalue(), "data.csv") == b"x"
    with pytest.raises(ValueError):
        bundles.zip_member(buffer.getvalue(), "other.csv")


def test_queries_leave_the_session_alone(spark):
    spark.range(3).createOrReplaceTempView("orders")
    before = {t.name for t in spark.catalog.listTables()}
    registry.QUERIES["s02_projected_scan"](spark, "/root/testdata/sf0.001").count()
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


def test_csv_rows_outside_the_days_end_the_read(spark, tmp_path):
    from pyspark.sql.types import DateType, StringType, StructField, StructType

    (tmp_path / "a.csv").write_text("id,d\nx,2024-01-01\ny,2025-01-01\n")
    schema = StructType([StructField("id", StringType()), StructField("d", DateType())])
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), schema, first="2024-01-01", last="2025-12-31", day="d").count() == 2
    with pytest.raises(Exception, match="outside the covered dates"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), schema, first="2024-01-01", last="2024-12-31", day="d").collect()
    tables.write_new(spark.createDataFrame([(1, "a"), (2, "b")], "x int, split string"), str(tmp_path / "parts"), "split")
    assert spark.read.parquet(str(tmp_path / "parts") + "/split=a").count() == 1


def test_verified_reads_the_bytes_it_hashed(spark):
    import hashlib

    path = "/root/testdata/sf0.001/orders.parquet"
    sha = hashlib.sha256(open(path, "rb").read()).hexdigest()
    plain = spark.read.parquet(path)
    found = tables.verified(spark, path, sha)
    assert found.schema == plain.schema and found.exceptAll(plain).isEmpty() and found.count() == plain.count()
    assert tables.verified(spark, path, {"orders.parquet": sha}).count() == plain.count()
    with pytest.raises(Exception, match="another hash"):
        tables.verified(spark, path, "0" * 64).collect()
    with pytest.raises(ValueError, match="missing"):
        tables.verified(spark, path, {"orders.parquet": sha, "more.parquet": sha})


def test_models_beat_the_majority_and_folds_keep_labels(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (200, 2))
    rows = [(k, float(a), None if k % 17 == 0 else float(b), int(a + b > 0)) for k, (a, b) in enumerate(x)]
    d = spark.createDataFrame(rows, "id int, a double, b double, y int")
    got = {q["model"]: q["f1_macro"] for q in models.compare(d, ["a", "b"], "y", "id", trees=10).collect()}
    assert got["logistic"] > 0.8 > got["majority"] and got["forest"] > 0.75
    folds = models.folds(d, "y", "id").groupBy("fold", "y").count().collect()
    assert len(folds) == 10 and max(q["count"] for q in folds) - min(q["count"] for q in folds) <= 10
    cut = models.decided(spark.createDataFrame([(0.5,), (0.51,)], "q double"), "q")
    assert sorted(q["p"] for q in cut.collect()) == [0, 1]


def test_streams_count_days_and_keep_first_keys(spark, tmp_path):
    rows = [(k % 7, dt.datetime(2024, 1, 1 + k % 3, 5), f"e{k % 2}") for k in range(21)]
    spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("event_id int, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    firsts = trailing.drain(trailing.first_of_key(stream(), "event_id", "ts"), "firsts", str(tmp_path / "c1"))
    assert sorted(q["event_id"] for q in firsts.collect()) == list(range(7))
    assert firsts.select(F.count_distinct("event_id")).first()[0] == 7
