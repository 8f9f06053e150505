"""Profiles of tables: censuses, descriptions, correlations, drift, ranks and order statistics without single tasks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import small, written

#: Cuts of an order: one for each CUT_ROWS rows, within these bounds.
CUTS, CUT_ROWS = (64, 1024), 1 << 16


def range_of(x: Column, edges: list[float]) -> Column:
    """How many of the sorted edges lie below x: looked up among every 32nd, then among 32."""
    listed = lambda e: F.expr(f"array({', '.join(f'{v!r}D' for v in e)})") if e else F.array().cast("array<double>")
    below = lambda of: F.size(F.filter(of, lambda e: e < x))
    coarse = 32 * below(listed(edges[31::32]))
    return coarse + below(F.slice(listed(edges), coarse + 1, 32))


def running(rows: DataFrame, totals: dict[str, str], x: str, *by: str, descending: bool = False) -> DataFrame:
    """Running sums in the order of a number x, per group, without a task that holds a whole group.

    totals: name of the running sum by summed column; x has to be there and to be
    distinct within a group. Rows are cut at approximate quantiles of x, of which
    there are more the more rows there are (at most 1023 numbers on the driver);
    sums run inside a cut, and cuts are offset by the sums of those before.
    """
    at = F.col(x).cast("double")
    n, found = rows.agg(F.count("*"), F.percentile_approx(at, [k / CUTS[1] for k in range(1, CUTS[1])], 10_000)).first()
    step = CUTS[1] // max(CUTS[0], min(CUTS[1], n // CUT_ROWS))
    bucket = range_of(at, sorted({e for e in (found or [])[step - 1 :: step] if abs(e) < float("inf")}))
    placed = rows.withColumn("__part", bucket)
    one = [F.col(c) for c in by] or [F.lit(0)]
    order = F.desc if descending else F.asc
    inside = W.partitionBy(*one, "__part").orderBy(order(x)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*one).orderBy(order("__part")).rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in totals])
    keys = {c: f"__by{k}" for k, c in enumerate([*by, "__part"])}
    sums = sums.select(*[F.col(c).alias(k) for c, k in keys.items()], *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in totals])
    same = F.lit(True)
    for c, k in keys.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = placed.withColumns({name: F.sum(c).over(inside) for c, name in totals.items()}).join(sums, same)
    return out.withColumns({name: F.col(name) + F.col(f"__{c}") for c, name in totals.items()}).drop("__part", *keys.values(), *[f"__{c}" for c in totals])


def quantiles(rows: DataFrame, column: str, shares: list[float], *by: str) -> DataFrame:
    """Exact quantiles (linear between neighbours) of a column per group, as q0, q1, ... beside n.

    Values are counted first; each share's two neighbours are read from running
    counts, so that no reducer holds a group's values at once.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    sums = counts.groupBy(*[F.col(c).alias(f"__of{k}") for k, c in enumerate(by)]).agg(F.sum("c").alias("n"))
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of{k}"))
    run = running(counts, {"c": "last"}, "x", *by)
    keyed = (run.join(sums, same) if by else run.crossJoin(sums)).withColumn("first", F.col("last") - F.col("c") + 1)  # without groups: one row
    return picked(keyed, shares, *by)


def picked(keyed: DataFrame, shares: list[float], *by: str) -> DataFrame:
    """The quantiles of counted values x, of which each takes the places first to last among the n of its group."""
    picks = []
    for k, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("n") - 1) + 1
        low, high = F.floor(at), F.ceil(at)
        for name, place in (("l", low), ("h", high)):
            picks.append(F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col("x"))).alias(f"{name}{k}"))
        picks.append(F.max(at - low).alias(f"w{k}"))
    found = keyed.groupBy(*by).agg(F.max("n").alias("n"), *picks)
    return found.select(*by, "n", *[(F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) * F.col(f"w{k}")).alias(f"q{k}") for k in range(len(shares))])


#: Accuracy of the brackets around ranks: a bracket holds about 6 of NEAR values.
NEAR = 2000


def near_quantiles(rows: DataFrame, column: str, shares: list[float], *by: str) -> DataFrame:
    """quantiles() of few and large groups, exact too: only the values in brackets around the ranks are shuffled, the others are counted.

    rows is read twice. Brackets come from approximate quantiles; should a rank
    lie outside its bracket, quantiles() decides.
    """
    values = rows.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("x"))
    asked = sorted({min(1.0, max(0.0, q + d)) for q in shares for d in (-3 / NEAR, 3 / NEAR)})
    edges = values.groupBy(*[F.col(c).alias(f"__of{k}") for k, c in enumerate(by)]).agg(F.count("*").alias("n"), F.percentile_approx("x", asked, NEAR).alias("e"))
    at = {q: F.col("e")[k] for k, q in enumerate(asked)}
    low = lambda q: F.lit(float("-inf")) if q * NEAR <= 3 else at[max(0.0, q - 3 / NEAR)]
    high = lambda q: F.lit(float("inf")) if (1 - q) * NEAR <= 3 else at[min(1.0, q + 3 / NEAR)]
    brackets = F.array(*[F.struct(low(q).alias("low"), high(q).alias("high")) for q in shares])
    edges = written(edges.select("n", *[f"__of{k}" for k in range(len(by))], brackets.alias("b")), "edges")
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of{k}"))
    met = values.join(small(edges), same) if by else values.crossJoin(F.broadcast(edges))  # without groups: one row
    below = F.size(F.filter("b", lambda b: b["low"] < F.col("x"))) + F.size(F.filter("b", lambda b: b["high"] < F.col("x")))
    kept = F.when(F.exists("b", lambda b: (b["low"] <= F.col("x")) & (F.col("x") <= b["high"])), F.col("x"))
    counts = met.groupBy(*by, "n", below.alias("place"), kept.alias("x")).agg(F.count("*").alias("c"))
    order = W.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("place", F.asc_nulls_first("x")).rowsBetween(W.unboundedPreceding, 0)
    keyed = counts.withColumn("last", F.sum("c").over(order)).withColumn("first", F.col("last") - F.col("c") + 1)
    found = written(picked(keyed, shares, *by), "near-quantiles")
    missing = F.lit(False)
    for k in range(len(shares)):
        missing = missing | F.col(f"q{k}").isNull()
    return found if found.where(missing).isEmpty() else quantiles(rows, column, shares, *by)


def census(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, how many values are missing and how many are infinite or no number."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"m_{c}") for c in columns], *[F.sum((F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("long")).alias(f"i_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"m_{c}"), F.lit(0)).alias("missing"), F.coalesce(F.col(f"i_{c}"), F.lit(0)).alias("infinite")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column present, missing, coverage in percent, least, greatest, zeros, negatives, above 100."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    made = []
    for c in columns:
        x = F.col(c).cast("double")
        made.append(F.struct(
            F.lit(c).alias("feature"), F.count(x).alias("present"), (F.count("*") - F.count(x)).alias("missing"), F.round(100.0 * F.count(x) / F.count("*"), 6).alias("coverage"),
            F.min(x).alias("low"), F.max(x).alias("high"), n(x == 0).alias("zeros"), n(x < 0).alias("negatives"), n(x > 100).alias("above"),
        ))
    return df.agg(F.array(*made).alias("rows")).select(F.explode("rows").alias("x")).select("x.*")


def describe(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Per column count, mean, standard deviation and the quantiles asked for, in long form."""
    out = None
    for c in columns:
        basic = df.agg(F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std"))
        row = basic.crossJoin(quantiles(df, c, shares).drop("n")).select(F.lit(c).alias("feature"), "n", "mean", "std", *[f"q{k}" for k in range(len(shares))])
        out = row if out is None else out.unionByName(row)
    return out


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Df with the average rank of a column's value; ties share it, missing values have none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("c"))
    ranks = running(counts, {"c": "upto"}, "__value").select("__value", (F.col("upto") - (F.col("c") - 1) / 2.0).alias(name))
    return df.join(ranks, df[column] == F.col("__value"), "left").drop("__value")


def correlation_pairs(df: DataFrame, columns: list[str], least: int = 30) -> DataFrame:
    """Pearson and Spearman of each pair of columns over the rows that have both, with their number.

    A pair with fewer than `least` rows, or with a constant side, has none.
    Ranks for Spearman are taken within the pair's own rows.
    """
    out = None
    for a, b in combinations(columns, 2):
        both = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        ranked = average_ranks(average_ranks(both, "x", "rx"), "y", "ry")
        varied = (F.count("*") >= least) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
        corr = lambda p, q: F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q))  # noqa: E731  corr() fails on a constant
        row = ranked.agg(F.count("*").alias("support"), F.when(varied, corr("x", "y")).alias("pearson"), F.when(varied, corr("rx", "ry")).alias("spearman"))
        row = row.select(F.lit(a).alias("first"), F.lit(b).alias("second"), "support", "pearson", "spearman")
        out = row if out is None else out.unionByName(row)
    return out


def distribution_distance(df: DataFrame, column: str, side: str, left: str, right: str) -> DataFrame:
    """The largest distance of two cumulative shares, and how many of the right lie outside the left's range."""
    d = df.where(F.col(side).isin(left, right) & F.col(column).isNotNull())
    counts = d.groupBy(F.col(column).alias("x")).agg(F.sum((F.col(side) == left).cast("long")).alias("a"), F.sum((F.col(side) == right).cast("long")).alias("b"))
    run = running(counts, {"a": "ua", "b": "ub"}, "x")
    ends = d.agg(F.sum((F.col(side) == left).cast("long")).alias("na"), F.sum((F.col(side) == right).cast("long")).alias("nb"), F.min(F.when(F.col(side) == left, F.col(column))).alias("low"), F.max(F.when(F.col(side) == left, F.col(column))).alias("high"))
    both = run.crossJoin(ends)  # one row
    return both.agg(F.max(F.abs(F.col("ua") / F.col("na") - F.col("ub") / F.col("nb"))).alias("distance"), F.sum(F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.col("b")).otherwise(0)).alias("outside"))


def unique_or_none(df: DataFrame, key: str, value: str) -> DataFrame:
    """A key's value if all its rows agree on it; else none, and how many values there are."""
    d = df.groupBy(key).agg(F.count_distinct(value).alias("kinds"), F.min(value).alias("low"))
    return d.select(key, "kinds", F.when(F.col("kinds") == 1, F.col("low")).alias(value))


def required_unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """As unique_or_none, but a key with several values ends the query."""
    d = unique_or_none(df, key, value)
    return d.withColumn(value, F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("several values for "), F.col(key).cast("string"))).cast(df.schema[value].dataType)).otherwise(F.col(value))).drop("kinds")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that ends the query if a key repeats on either side."""
    def once(d: DataFrame) -> DataFrame:
        n = F.count("*").over(W.partitionBy(key))
        return d.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast(d.schema[key].dataType)).otherwise(F.col(key)))

    return once(left).join(once(right), key)


def aligned(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows looked up by id; an id without a row ends the query."""
    found = ids.join(rows.withColumn("__here", F.lit(True)), key, "left")
    checked = F.when(F.col("__here").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast(ids.schema[key].dataType)).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("__here")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two tables differ, with their surplus on either side; no rows means equality as multisets."""
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    n = both.groupBy(*a.columns).agg(F.sum("__side").alias("surplus"))
    return n.where("surplus <> 0")


def column_differences(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns that are missing or unknown."""
    rows = [(c, "missing") for c in wanted if c not in df.columns] + [(c, "unknown") for c in df.columns if c not in wanted]
    return df.sparkSession.createDataFrame(rows, "name string, finding string")
