"""Tie-aware classification metrics and budget rankings as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import carried
from .profile import running


def confusion(df: DataFrame, label: str, predicted: str, *by: str) -> DataFrame:
    """Counts and rates; a rate without a denominator is 0, as with zero_division=0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(c.cast("long"))
    d = df.groupBy(*by).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    r = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return d.withColumns({
        "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "accuracy": r(tp + tn, tp + fp + fn + tn),
        "f1_macro": (r(2 * tp, 2 * tp + fp + fn) + r(2 * tn, 2 * tn + fp + fn)) / 2, "balanced_accuracy": (r(tp, tp + fn) + r(tn, tn + fp)) / 2,
    })


def score_steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score with running counts, highest first: ties share a threshold."""
    groups = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.count("*").alias("n"))
    return running(groups, {"p": "tp", "n": "all"}, score, descending=True)


def ranking_quality(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC and average precision, null where a class is missing."""
    s = score_steps(df, label, score)
    t = s.agg(
        F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"),
        F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2.0)).alias("area"), F.sum(F.try_divide(F.col("p") * F.col("tp"), F.col("all"))).alias("precision_sum"),
    )
    return t.select("positives", "negatives", F.try_divide("area", F.col("positives") * F.col("negatives").cast("double")).alias("roc_auc"), F.try_divide("precision_sum", "positives").alias("average_precision"))


def ranked(df: DataFrame, ident: str, score: str, name: str) -> DataFrame:
    """Ranks 1, 2, 3, ... by score, highest first, ids breaking ties."""
    return carried.ranked(df, score, [ident], name).withColumn(name, F.col(name).cast("long"))


def budget(n, percent: int):
    """ceil(n * percent / 100) in integers, at most n."""
    return F.least(n, F.floor((n * percent + 99) / 100))


def triage(df: DataFrame, ident: str, score: str, label: str, percents=(1, 5, 10)) -> DataFrame:
    """What a fixed budget of the highest scores catches; ids break ties."""
    total = df.agg(F.count("*").alias("rows"), F.sum((F.col(label) == 1).cast("long")).alias("positives"))
    ranks = ranked(df, ident, score, "rank").crossJoin(total)  # one row
    out = None
    for p in percents:
        k = budget(F.col("rows"), p).cast("long")
        chosen = ranks.where(F.col("rank") <= k).groupBy("rows", "positives").agg(F.count("*").alias("k"), F.sum((F.col(label) == 1).cast("long")).alias("hits"), F.min(score).alias("boundary_score"))
        ties = ranks.join(F.broadcast(chosen.select("boundary_score", "k")), F.col(score) == F.col("boundary_score")).agg(F.count("*").alias("tied"), F.sum((F.col("rank") <= F.col("k")).cast("long")).alias("tied_selected"))
        row = chosen.crossJoin(ties).select(
            F.lit(p).cast("long").alias("percent"), "k", "hits", F.round(F.col("hits") / F.col("k"), 9).alias("precision_at_k"), F.round(F.try_divide("hits", "positives"), 9).alias("capture"),
            F.round(F.try_divide(F.col("hits") / F.col("k"), F.col("positives") / F.col("rows")), 9).alias("lift"), "boundary_score", "tied", "tied_selected",
        )
        out = row if out is None else out.unionByName(row)
    return out


def overlap(df: DataFrame, ident: str, a: str, b: str, label: str, k: int) -> DataFrame:
    """Two rankings' top k, compared in one pass of membership flags."""
    top = lambda c, name: df.orderBy(F.desc(c), F.asc(ident)).limit(k).select(F.col(ident).alias(f"__{name}"), F.lit(1).alias(name))
    both = df.join(top(a, "ra"), F.col(ident) == F.col("__ra"), "left").join(top(b, "rb"), F.col(ident) == F.col("__rb"), "left")
    d = both.withColumns({"ia": F.col("ra").isNotNull(), "ib": F.col("rb").isNotNull()}).where("ia OR ib")
    n = lambda c: F.sum(c.cast("long"))
    pos = F.col(label) == 1
    t = d.agg(n(F.col("ia") & F.col("ib")).alias("common"), n(F.col("ia") & ~F.col("ib")).alias("only_a"), n(F.col("ib") & ~F.col("ia")).alias("only_b"), F.count("*").alias("either"), n(F.col("ia") & ~F.col("ib") & pos).alias("gained"), n(F.col("ib") & ~F.col("ia") & pos).alias("forgone"))
    return t.withColumns({"overlap": F.round(F.col("common") / k, 9), "jaccard": F.round(F.try_divide("common", "either"), 9), "net": F.col("gained") - F.col("forgone")})


def replacement_rank(d: DataFrame, key: str, score: str, changed: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """W09 for every row: its rank among its group, and its rank if its score alone became `changed`.

    Higher scores come first, keys break ties. Peers keep their scores; rows of
    the own key do not stand in its way. A missing score ranks last, a row
    whose changed score is missing ranks first.
    """
    rows = d.select(*by, key, F.col(score).cast("double").alias("__score"), changed.cast("double").alias("__changed"))
    before = carried.ranked(rows, "__score", [key], "before_rank", by)
    asked = before.select(*by, key, F.col("__changed").alias("at"), "before_rank")
    held = before.select(*by, key, F.col("__score").alias("at"))
    found = carried.ahead(held, asked, "at", [key], by)
    # of a row's own key those above it are taken off
    own = held.groupBy(*by, key).agg(F.collect_list("at").alias("own"))
    found = found.join(own, [*by, key], "left")
    above = F.when(F.col("at").isNull(), 0).otherwise(F.size(F.filter(F.coalesce("own", F.array().cast("array<double>")), lambda s: s > F.col("at"))))
    return found.select(*by, F.col(key), F.col("before_rank").cast("long").alias("before_rank"), (F.col("ahead") - above + 1).cast("long").alias("after_rank"))
