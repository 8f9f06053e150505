"""Scores of purchase lines by period: reports, two methods compared, injected changes, paired resampling.

A method is a function that adds a column `score` (higher is more unusual) to
lines with the five model features. `rule` and `distance` are expressions, a
fitted forest is a model; every report treats them alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.shared import small, written
from . import carried
from .forest import IsolationForest
from .procurement import PERIODS, SCENARIOS, commercial_deviation, counterfactual_features, period
from .profile import near_quantiles, quantiles

MODEL_FEATURES = ["price_ratio", "quantity_ratio", "total_ratio", "price_iqr_distance", "relative_iqr"]
KEY = ["po_id", "order_date", "occurrence"]
EVALUATION = ("validation", "retrospective")
Method = Callable[[DataFrame], DataFrame]


def eligible(featured: DataFrame) -> DataFrame:
    """Lines with all five model features, and their period."""
    d = featured.withColumn("period", period(F.col("order_date")))
    for c in MODEL_FEATURES:
        d = d.where(F.col(c).isNotNull())
    return d


def rule(d: DataFrame) -> DataFrame:
    """The larger absolute log ratio of price and quantity."""
    return d.withColumn("score", F.round(commercial_deviation(F.col("price_ratio"), F.col("quantity_ratio")), 9))


def distance(d: DataFrame) -> DataFrame:
    """The price's distance from the median in interquartile ranges."""
    return d.withColumn("score", F.round(F.abs("price_iqr_distance"), 9))


def forest_method(model: IsolationForest) -> Method:
    return lambda d: model.score(d, "score")


def fitted_forest(lines: DataFrame, trees: int = 200) -> IsolationForest | None:
    """One fit, on the development period's lines; None if it has none."""
    learn = lines.where("period = 'development'")
    return None if learn.isEmpty() else IsolationForest(trees=trees).fit(learn, MODEL_FEATURES, KEY)


# D10


def score_report(scored: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Per period n, min, max, mean, std, p01 to p99, and how many reach the development's P95 and P99 (ties count)."""
    spark = scored.sparkSession
    names = [f"p{round(100 * q):02d}" for q in shares]
    q = near_quantiles(scored, "score", list(shares), "period").toDF("period", "n", *names)
    basic = scored.groupBy("period").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    marks = q.where("period = 'development'").select(F.col("p95").alias("at95"), F.col("p99").alias("at99"))  # one row
    reach = lambda mark: F.sum(F.coalesce(F.col("score") >= F.col(mark), F.lit(False)).cast("long"))  # noqa: E731  none where the development has no scores
    tails = scored.join(F.broadcast(marks)).groupBy("period").agg(reach("at95").alias("tail95"), reach("at99").alias("tail99"))
    every = spark.createDataFrame([(name,) for name, *_ in PERIODS], "period string")
    found = every.join(q, "period", "left").join(basic, "period", "left").join(tails, "period", "left").fillna(0, ["n"])
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return found.select("period", "n", "low", "high", "mean", "std", *names, "tail95", "tail99", share("tail95").alias("share95"), share("tail99").alias("share99"))


# J25


def reconciled(ranking: DataFrame, matrix: DataFrame, catalogue: DataFrame, fields: list[str], catalogued: list[str], told: DataFrame | None = None, stands: tuple[str, str] | None = None) -> DataFrame:
    """One row per key of KEY and period in any table, with the first thing that disagrees, or none.

    Checked in this order: repeated keys, rows missing from the ranking, the
    matrix or the catalogue, ranks that are not 1, 2, 3, ... by score, the
    fields of ranking and matrix, the catalogued fields.

    told: the ranking's fields, where they are kept apart from its scores and
    ranks; a key without them counts as not ranked. Only keys, scores and ranks
    are sorted; rows of all tables meet in one shuffle by key, a table that is
    both matrix and catalogue once. stands: of such a table the two conditions
    that say which of its rows stand in the matrix and which in the catalogue
    (all, if none are named).
    """
    keys = [*KEY, "period"]
    due = carried.ranked(ranking.select("period", *KEY, "score", "rank"), "score", KEY, "due", ("period",), without=("score",))
    one = catalogue is matrix
    sides = {"r": (ranking if told is None else told, [*fields, *catalogued]), "m": (matrix, [*fields, *catalogued] if one else fields), "stale": (due.where("due <> rank"), [])}
    sides |= {} if one else {"c": (catalogue, catalogued)}
    sides |= {} if told is None else {"k": (ranking, [])}
    number = {name: k for k, name in enumerate(sides)}
    inside = dict(zip(("m", "c"), map(F.expr, stands))) if one and stands else {}
    kinds, rows = sides["r"][0].schema, None
    for name, (d, columns) in sides.items():
        own = [F.col(c) if c in columns else F.lit(None).cast(kinds[c].dataType).alias(c) for c in (*fields, *catalogued)]
        both = inside if name == "m" else {}
        at = [F.coalesce(both.get(x, F.lit(True)), F.lit(False)).alias(f"in_{x}") for x in inside]
        d = d.select(*keys, F.lit(number[name]).alias("side"), *at, *own)
        rows = d if rows is None else rows.unionByName(d)
    of = lambda side, c: F.when(F.col("side") == number[side], F.col(c))
    n = lambda side: F.count(of(side, "side"))
    listed = "m" if one else "c"
    pairs = [*[("m", c) for c in fields], *[(listed, c) for c in catalogued]]
    both = [F.first(of(side, c), True).alias(f"{side}_{c}") for s, c in pairs for side in ("r", s)]
    met = rows.repartition(*keys).groupBy(*keys).agg(*[n(name).alias(f"{name}_n") for name in sides], *[F.count(F.when(F.col(f"in_{x}"), of("m", "side"))).alias(f"in_{x}_n") for x in inside], *both)
    ranked = "k_n" if told is not None else "r_n"
    in_matrix, in_catalogue = ("in_m_n", "in_c_n") if inside else ("m_n", f"{listed}_n")
    finding = F.when((F.col("r_n") > 1) | (F.col(ranked) > 1) | (F.col(in_matrix) > 1) | (F.col(in_catalogue) > 1), "repeated_key")
    for table, said in (("r_n", "not_ranked"), (ranked, "not_ranked"), (in_matrix, "not_in_matrix"), (in_catalogue, "not_in_catalogue")):
        finding = finding.when(F.col(table) == 0, said)
    finding = finding.when(F.col("stale_n") > 0, "rank")
    for side, c in pairs:
        finding = finding.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"{side}_{c}")), c)
    return met.select(*keys, finding.alias("finding"))


def refuse_faults(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """rows, unless reconciled() found a fault: then the query ends and names it."""
    wrong = faults.where("finding IS NOT NULL").select(F.min("finding").alias("__fault"))  # one row
    checked = F.when(F.col("__fault").isNotNull(), F.raise_error(F.concat(F.lit("stale or foreign scores: "), F.col("__fault")))).otherwise(F.col("period"))
    return rows.join(F.broadcast(wrong)).withColumn("period", checked.cast("string")).drop("__fault")


# D11

DIMENSIONS = ("category", "item", "supplier_id", "unit", "order_month", "month_of_year")


def both_ranked(lines: DataFrame, a: Method, b: Method, k: int = 30) -> DataFrame:
    """Eligible lines with both scores, both ranks within their period, and whether each method's first k have them."""
    d = b(a(lines).withColumnRenamed("score", "score_a")).withColumnRenamed("score", "score_b")
    for x in "ab":
        d = carried.ranked(d, f"score_{x}", KEY, f"rank_{x}", ("period",))
    return d.withColumns({"in_a": F.col("rank_a") <= k, "in_b": F.col("rank_b") <= k})


def both_selected(lines: DataFrame, a: Method, b: Method, k: int = 30) -> DataFrame:
    """both_ranked() without the ranks: a period's first k by each score are found by a limit per task and period, so that no other line is sorted across tasks.

    The selections (periods x k rows at most) are joined by broadcast.
    """
    d = b(a(lines).withColumnRenamed("score", "score_a")).withColumnRenamed("score", "score_b")
    out = d
    for x in "ab":
        first = F.row_number().over(W.partitionBy("period").orderBy(F.desc_nulls_last(f"score_{x}"), *map(F.asc, KEY)))
        chosen = written(d.select("period", *KEY, f"score_{x}").withColumn("__rank", first).where(F.col("__rank") <= k).select(*KEY), f"first-{x}")
        out = out.join(F.broadcast(chosen.withColumn(f"in_{x}", F.lit(True))), KEY, "left").fillna(False, [f"in_{x}"])
    return out


def overlap_by_period(both: DataFrame) -> DataFrame:
    """Per period: the two selections' sizes, what they share, and each one's score at the boundary with its ties."""
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("in_a"), F.col("in_b")
    edge = both.groupBy("period").agg(F.min(F.when(a, F.col("score_a"))).alias("edge_a"), F.min(F.when(b, F.col("score_b"))).alias("edge_b"))
    d = both.join(F.broadcast(edge), "period")  # a row for each period
    ties = {}
    for x, chosen in (("a", a), ("b", b)):
        at = F.col(f"score_{x}") == F.col(f"edge_{x}")
        ties |= {f"tied_{x}": n(at), f"tied_selected_{x}": n(at & chosen)}
    t = d.groupBy("period").agg(F.count("*").alias("eligible"), n(a).alias("k"), n(a & b).alias("common"), n(a & ~b).alias("only_a"), n(b & ~a).alias("only_b"), F.first("edge_a").alias("edge_a"), F.first("edge_b").alias("edge_b"), *[c.alias(name) for name, c in ties.items()])
    return t.withColumns({"fraction": F.try_divide("common", "k"), "jaccard": F.try_divide(F.col("common"), F.col("k") + F.col("only_b"))})


def dimensions(d: DataFrame) -> DataFrame:
    """d with a row for each dimension: its name and the line's group."""
    month = F.date_format("order_date", "yyyy-MM")
    named = {"order_month": month, "month_of_year": F.substring(month, 6, 2)}
    return d.withColumn("g", F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), (named.get(x, F.col(x) if x not in named else None)).cast("string").alias("name")) for x in DIMENSIONS])))


def group_shares(featured: DataFrame, both: DataFrame) -> DataFrame:
    """Per period, dimension and group: all lines, eligible ones, each selection, shares and selection rates; in one pass of each table."""
    every = dimensions(featured.withColumn("period", period(F.col("order_date")))).groupBy("period", "g").agg(F.count("*").alias("total"))
    n = lambda c: F.sum(c.cast("long"))
    chosen = dimensions(both).groupBy("period", "g").agg(F.count("*").alias("eligible"), n(F.col("in_a")).alias("a"), n(F.col("in_b")).alias("b"))
    sums = both.groupBy("period").agg(F.count("*").alias("all_eligible"), n(F.col("in_a")).alias("all_a"), n(F.col("in_b")).alias("all_b"))
    same = F.col("period").eqNullSafe(F.col("of_period")) & F.col("g").eqNullSafe(F.col("of_g"))
    d = every.join(chosen.withColumnsRenamed({"period": "of_period", "g": "of_g"}), same, "left").drop("of_period", "of_g").join(F.broadcast(sums), "period", "left").fillna(0, ["eligible", "a", "b"])
    share = lambda x, y: F.try_divide(F.col(x), F.col(y))
    return d.select(
        "period", "g.dimension", "g.name", "total", "eligible", (F.col("total") - F.col("eligible")).alias("excluded"), "a", "b", share("eligible", "all_eligible").alias("population_share"),
        share("a", "all_a").alias("a_share"), share("b", "all_b").alias("b_share"), share("a", "eligible").alias("a_rate"), share("b", "eligible").alias("b_rate"),
    )


def profiles(both: DataFrame) -> DataFrame:
    """Per period and set (population, a, b, both, a_only, b_only): size, directions, which ratio leads, and five quantiles of each feature."""
    a, b = F.col("in_a"), F.col("in_b")
    sets = F.array_compact(F.array(F.lit("population"), *[F.when(c, F.lit(name)) for name, c in (("a", a), ("b", b), ("both", a & b), ("a_only", a & ~b), ("b_only", b & ~a))]))
    price, quantity = F.abs(F.ln("price_ratio")), F.abs(F.ln("quantity_ratio"))
    d = both.select("period", F.explode(sets).alias("set"), *MODEL_FEATURES, price.alias("price_log"), quantity.alias("quantity_log"))
    n = lambda c: F.sum(c.cast("long"))
    counted = d.groupBy("period", "set").agg(
        F.count("*").alias("n"), *[n(c).alias(f"{x}_{name}") for x in ("price", "quantity") for name, c in (("below", F.col(f"{x}_ratio") < 1), ("equal", F.col(f"{x}_ratio") == 1), ("above", F.col(f"{x}_ratio") > 1))],
        n(F.col("price_log") > F.col("quantity_log")).alias("price_leads"), n(F.col("price_log") < F.col("quantity_log")).alias("quantity_leads"),
    )
    values = [*MODEL_FEATURES, "price_log", "quantity_log"]
    long = d.select("period", "set", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in values])).alias("v")).select("period", "set", "v.feature", "v.x")
    shares, by = [0, 0.05, 0.5, 0.95, 1], ["period", "set", "feature"]
    five = near_quantiles(long.where("set = 'population'"), "x", shares, *by).unionByName(quantiles(long.where("set <> 'population'"), "x", shares, *by))
    five = five.drop("n").withColumnsRenamed({f"q{k}": c for k, c in enumerate(("low", "p05", "median", "p95", "high"))})
    return five.join(counted, ["period", "set"])


# D14


def selected(lines: DataFrame, seed: int = 42, per_item: int = 5) -> DataFrame:
    """Of each evaluation period and item `per_item` eligible lines (all, if fewer), drawn by a keyed hash that no score enters."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "period", "item", "po_id", F.col("order_date").cast("string"), F.col("occurrence").cast("string")), 256)
    drawn = lines.where(F.col("period").isin(*EVALUATION)).select("period", "item", *KEY).withColumn("__draw", F.row_number().over(W.partitionBy("period", "item").orderBy(key)))
    drawn = small(written(drawn.where(F.col("__draw") <= per_item).select(*KEY), "drawn"))
    return lines.join(drawn, KEY, "left_semi")


def injected(chosen: DataFrame) -> DataFrame:
    """Each chosen line under each scenario, applicable or not; the features of applicable ones against the frozen references."""
    names = chosen.sparkSession.createDataFrame([(s,) for s, *_ in SCENARIOS], "scenario string")
    every = chosen.select(*KEY, "period", "item", "category").crossJoin(F.broadcast(names))  # five rows
    made = counterfactual_features(chosen)
    same = [*KEY, "scenario"]
    return every.join(made.select(*same, *MODEL_FEATURES, F.lit(True).alias("applicable")), same, "left").fillna(False, ["applicable"])


def experiment(lines: DataFrame, methods: dict[str, Method], seed: int = 42, per_item: int = 5) -> DataFrame:
    """Per drawn line, scenario and method the score and the rank before and after; peers keep their scores.

    lines: the eligible ones, with features and period. A scenario that would not
    change a line is not applicable and has no score or rank after.
    """
    chosen = written(selected(lines, seed, per_item), "chosen")
    changes = written(injected(chosen), "injected")
    out = None
    for name, method in methods.items():
        # ranks are within a period, so that no other period's lines are needed
        held = written(method(lines.where(F.col("period").isin(*EVALUATION))).select("period", *KEY, "score"), "scores")
        asked = held.join(small(chosen.select(*KEY)), KEY, "left_semi").select("period", *KEY, "score", F.lit(None).cast("string").alias("scenario"))
        asked = asked.unionByName(method(changes.where("applicable")).select("period", *KEY, "score", "scenario"))
        placed = written(carried.ahead(held, asked, "score", KEY, ("period",)), "placed")
        before = placed.where("scenario IS NULL").select(*KEY, F.col("score").alias("score_before"), (F.col("ahead") + 1).alias("rank_before"))
        after = placed.where("scenario IS NOT NULL").select(*KEY, "scenario", F.col("score").alias("score_after"), "ahead")
        row = changes.select(*KEY, "period", "item", "category", "scenario", "applicable").join(before, KEY).join(after, [*KEY, "scenario"], "left")
        # the line's own unchanged score stood before its changed one where it is higher
        own = (F.col("score_before") > F.col("score_after")).cast("long")
        row = row.select("period", *KEY, "item", "category", "scenario", F.lit(name).alias("method"), "applicable", "score_before", "score_after", "rank_before", (F.col("ahead") + 1 - own).alias("rank_after"))
        out = row if out is None else out.unionByName(row)
    return out


def effects(pairs: DataFrame, marks: DataFrame, least: int = 10) -> DataFrame:
    """Per period, scenario and method, and per category too: pairs, directions, distributions and reach of P95 and P99.

    marks (method, p95, p99): the development's. A category with fewer than
    `least` applicable pairs shows its counts alone.
    """
    d = pairs.join(F.broadcast(marks), "method").withColumns({"delta": F.col("score_after") - F.col("score_before"), "gain": F.col("rank_before") - F.col("rank_after")})
    levels = d.withColumn("category", F.explode(F.when(F.col("category").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("category")))))
    n = lambda c: F.sum(c.cast("long"))
    valid, delta, by = F.col("applicable"), F.col("delta"), ["period", "scenario", "method", "category"]
    reach = [n(F.coalesce(valid & (F.col(f"score_{when}") >= F.col(p)), F.lit(False))).alias(f"{p}_{when}") for p in ("p95", "p99") for when in ("before", "after")]
    counted = levels.groupBy(*by).agg(F.count("*").alias("selected"), n(valid).alias("valid"), n(delta > 0).alias("increased"), n(delta == 0).alias("equal"), n(delta < 0).alias("decreased"), F.avg("delta").alias("mean_delta"), F.avg("gain").alias("mean_gain"), *reach)
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in ("score_before", "score_after", "delta", "gain")])
    long = levels.where("applicable").select(*by, F.explode(measures).alias("v")).select(*by, "v.measure", "v.x")
    medians = quantiles(long, "x", [0.05, 0.5, 0.95], *by, "measure")
    pivot = medians.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == m, F.col(f"q{k}"))).alias(f"{q}_{m}") for m in ("score_before", "score_after", "delta", "gain") for k, q in enumerate(("p05", "median", "p95"))])
    of = {c: f"__{c}" for c in by}
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(of[c]))
    found = counted.join(pivot.withColumnsRenamed(of), same, "left").drop(*of.values())
    shown = (F.col("valid") > 0) & (F.col("category").isNull() | (F.col("valid") >= least))
    return found.select(*by, "selected", "valid", (F.col("selected") - F.col("valid")).alias("not_applicable"), *[F.when(shown, F.col(c)).alias(c) for c in found.columns if c not in (*by, "selected", "valid")])


def development_marks(lines: DataFrame, methods: dict[str, Method]) -> DataFrame:
    """(method, p95, p99) of the development period's scores."""
    out = None
    for name, method in methods.items():
        scores = written(method(lines.where("period = 'development'")).select("score"), "scores")
        row = near_quantiles(scores, "score", [0.95, 0.99]).select(F.lit(name).alias("method"), F.col("q0").alias("p95"), F.col("q1").alias("p99"))
        out = row if out is None else out.unionByName(row)
    return out


# T09


def paired_bootstrap(rows: DataFrame, label: str, a: Column, b: Column, draws: int = 2000, seed: int = 42) -> DataFrame:
    """`draws` resamples of all rows; per draw the accuracies of two models and their difference.

    Which rows a draw takes matters only through the four counts of right and
    wrong answers, so a draw is one multinomial of them: its cost does not grow
    with the rows, and both models see the same rows.
    """
    y = F.col(label)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    right_a, right_b = a == y, b == y
    cells = [int(x) for x in rows.where(y.isNotNull()).agg(n(right_a & right_b), n(right_a & ~right_b), n(~right_a & right_b), n(~right_a & ~right_b)).first()]  # four numbers
    total = sum(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            got = np.array([np.random.default_rng((seed, int(i))).multinomial(total, np.array(cells) / total) for i in ids]).reshape(-1, 4) / total
            x, z = got[:, 0] + got[:, 1], got[:, 0] + got[:, 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(z), pa.array(x - z)], ["draw", "accuracy_a", "accuracy_b", "difference"])

    spark: SparkSession = rows.sparkSession
    return spark.range(draws if total else 0).mapInArrow(run, "draw long, accuracy_a double, accuracy_b double, difference double")


def interval(drawn: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """The percentile interval of a bootstrapped column; its rows are as many as there were draws."""
    tail = (1 - level) / 2
    return drawn.agg(F.count("*").alias("draws"), F.avg(column).alias("mean"), F.percentile(column, tail).alias("low"), F.percentile(column, 1 - tail).alias("high"))
