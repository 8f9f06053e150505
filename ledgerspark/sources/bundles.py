"""Bundles, strict JSON and pinned models: outputs that are whole or not there (K04 to K06, K08; S06, S09, S10, S12, S13)."""

from __future__ import annotations

import csv
import io
import json
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.forest import IsolationForest


def canonical_json(value) -> str:
    """One text per value: sorted keys, no spaces, UTF-8 as it is; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities."""
    def once(pairs):
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("a key repeats")
        return found

    def never(name):
        raise ValueError(f"{name} is no JSON value")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


def csv_rows(spark: SparkSession, content: bytes, limit: int = 16 << 20) -> DataFrame:
    """A small CSV held in memory, at most `limit` bytes, with its types inferred by the reader."""
    if len(content) > limit:
        raise ValueError(f"more than {limit} bytes")
    lines = list(csv.reader(io.StringIO(content.decode("utf-8-sig"))))
    if not lines or len({len(x) for x in lines}) != 1:
        raise ValueError("rows of several widths")
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows(lines)
    return spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").csv(spark.sparkContext.parallelize(buffer.getvalue().split("\n")[:-1], 1))


def zip_member(content: bytes, name: str) -> bytes:
    """The one member of an archive with this base name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = [x for x in z.namelist() if x.rsplit("/", 1)[-1] == name and not x.endswith("/")]
        if len(found) != 1:
            raise ValueError(f"{len(found)} members are named {name}")
        return z.read(found[0])


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def fingerprint(df: DataFrame) -> dict:
    """Rows, and a sum of row hashes that does not hang on their order."""
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash")).first()
    return {"rows": r["rows"], "hash": r["hash"], "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields]}


def publish(tables: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """Tables beside a manifest, written to a staging folder, read back, then renamed; never over a bundle.

    The manifest is written last and the rename makes all of it seen at once.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, final = _fs(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    staging = f"{path}.staging"
    fs.delete(_fs(spark, staging)[1], True)
    manifest = {"meta": meta or {}, "tables": {}}
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
        manifest["tables"][name] = fingerprint(spark.read.schema(df.schema).parquet(f"{staging}/{name}"))
    _write_text(spark, f"{staging}/manifest.json", canonical_json(manifest))
    if not fs.rename(_fs(spark, staging)[1], final):
        raise OSError(f"{staging} could not be renamed")


def open_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a bundle, if they are what the manifest says, and its meta data."""
    manifest = strict_json(_text(spark, f"{path}/manifest.json"))
    found = {}
    for name, said in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if fingerprint(df) != said:
            raise ValueError(f"{name} is not what the manifest says")
        found[name] = df
    return found, manifest["meta"]


def save_forest(spark: SparkSession, model: IsolationForest, path: str) -> str:
    """A fitted forest as a bundle of its nodes; the hash that pins it."""
    rows = [(t, k, int(c), float(x), int(a), int(b), float(n)) for t, tree in enumerate(model.nodes) for k, (c, x, a, b, n) in enumerate(zip(*tree))]
    nodes = spark.createDataFrame(rows, "tree int, node int, column int, threshold double, left int, right int, length double")
    publish({"nodes": nodes}, path, {"columns": list(model.columns), "psi": int(model.psi), "trees": len(model.nodes), "seed": model.seed, "sample": model.sample, "contamination": model.contamination, "threshold": model.threshold})
    return fingerprint(nodes)["hash"]


def load_forest(spark: SparkSession, path: str, pinned: str) -> IsolationForest:
    """The forest of a bundle, if its nodes have the pinned hash."""
    tables, meta = open_bundle(spark, path)
    if fingerprint(tables["nodes"])["hash"] != pinned:
        raise ValueError("the model is not the pinned one")
    model = IsolationForest(meta["trees"], meta["sample"], meta["seed"])
    model.columns, model.psi, model.contamination, model.threshold = (meta[k] for k in ("columns", "psi", "contamination", "threshold"))
    trees: list[list] = [[] for _ in range(meta["trees"])]
    for r in tables["nodes"].orderBy("tree", "node").collect():  # trees x at most 512 nodes
        trees[r["tree"]].append((r["column"], r["threshold"], r["left"], r["right"], r["length"]))
    model.nodes = [tuple(map(np.array, zip(*t))) for t in trees]
    return model
