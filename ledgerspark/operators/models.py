"""Tabular classifiers with preparation fitted on training rows only."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import written
from . import carried
from .metrics import confusion


def folds(df: DataFrame, label: str, ident: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds, dealt within each label in a keyed order, by sorted ranges rather than a task for each label; written once."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256)
    keyed = df.withColumn("__order", order)
    dealt = carried.carried(keyed, [F.asc(label), F.asc("__order"), F.asc(ident)], F.lit(1), "fold")
    dealt = carried.since_start(dealt, "fold", label)
    return written(dealt.withColumn("fold", ((F.col("fold") + 1) % k).cast("int")).drop("__order"), "folds")


def compare(df: DataFrame, columns: list[str], label: str, ident: str, trees: int = 100) -> DataFrame:
    """Fold 0 is held out: macro F1 and confusion counts of three models on it."""
    d = folds(df, label, ident).withColumns({c: F.col(c).cast("double") for c in columns})
    train, test = d.where("fold <> 0"), d.where("fold = 0")
    n = train.count()
    prepare = [Imputer(strategy="median", inputCols=columns, outputCols=[f"{c}_filled" for c in columns]), VectorAssembler(inputCols=[f"{c}_filled" for c in columns], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    models = {
        "logistic": LogisticRegression(featuresCol="x", labelCol=label, regParam=1.0 / max(n, 1), standardization=False, maxIter=1000),
        "forest": RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, seed=42),
    }
    out = confusion(test.withColumn("p", F.lit(train.groupBy(label).count().orderBy(F.desc("count"), label).first()[0])), label, "p").withColumn("model", F.lit("majority"))
    for name, model in models.items():
        scored = Pipeline(stages=[*prepare, model]).fit(train).transform(test)
        out = out.unionByName(confusion(scored.withColumn("p", F.col("prediction").cast("int")), label, "p").withColumn("model", F.lit(name)))
    return out


def decided(df: DataFrame, probability: str, name: str = "p") -> DataFrame:
    """1 above one half; equality is 0."""
    return df.withColumn(name, (F.col(probability) > 0.5).cast("int"))


def cross_validated(df: DataFrame, columns: list[str], label: str, ident: str, k: int = 5, trees: int = 100) -> DataFrame:
    """Per model and fold the metrics of the fold held out, and each column's coefficient or importance there.

    Everything that is learned, medians and scales included, is learned from the other folds.
    """
    d = folds(df.select(ident, label, *columns), label, ident, k).withColumns({c: F.col(c).cast("double") for c in columns})
    filled = [f"{c}_filled" for c in columns]
    out = None
    for fold in range(k):
        train, test = d.where(F.col("fold") != fold), d.where(F.col("fold") == fold)
        n = train.count()
        # both models share the fold's preparation
        prepare = Pipeline(stages=[Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]).fit(train)
        ready, asked = prepare.transform(train), prepare.transform(test)
        for name, model in (("logistic", LogisticRegression(featuresCol="x", labelCol=label, regParam=1.0 / max(n, 1), standardization=False, maxIter=1000)), ("forest", RandomForestClassifier(featuresCol="x", labelCol=label, numTrees=trees, seed=42))):
            last = model.fit(ready)
            told = last.coefficients.toArray() if name == "logistic" else last.featureImportances.toArray()
            scored = last.transform(asked).withColumn("p", F.col("prediction").cast("int"))
            row = confusion(scored, label, "p").select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "f1_macro", "balanced_accuracy", *[F.lit(float(v)).alias(f"weight_{c}") for c, v in zip(columns, told)])
            out = row if out is None else out.unionByName(row)
    return out
