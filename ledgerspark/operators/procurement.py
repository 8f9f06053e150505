"""Causal 90-day reference features of purchase lines, ranking and counterfactuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources import tables
from ..sources.shared import small, written
from . import carried, trailing
from .profile import near_quantiles
from .trailing import numbered

DAYS, LEAST = 90, 20
#: Half-open periods.
PERIODS = (("warmup", "1992-01-01", "1992-07-01"), ("development", "1992-07-01", "1996-01-01"), ("validation", "1996-01-01", "1998-01-01"), ("retrospective", "1998-01-01", "2003-01-01"))
SCENARIOS = (("A", 1.5, 1), ("B", 2.0, 1), ("C", 1.0, 3), ("D", 1.0, None), ("E", 1.5, 3))


def window(*keys: str):
    """[t - 90 days, t): the whole current day is out."""
    return W.partitionBy(*keys).orderBy("day").rangeBetween(-DAYS, -1)


def period(day: Column) -> Column:
    """The period of a date; none of a missing date; a date outside all periods ends the query."""
    out = F.when(day.isNotNull(), F.raise_error(F.concat(F.lit("outside all periods: "), day.cast("string"))).cast("string"))
    for name, a, b in PERIODS:
        out = F.when((day >= F.lit(a)) & (day < F.lit(b)), F.lit(name)).otherwise(out)
    return out


def occurrences(lines: DataFrame) -> DataFrame:
    """Repeated ids keep their rows, numbered in a total order."""
    return lines.withColumn("occurrence", F.row_number().over(W.partitionBy("po_id").orderBy("order_date", "item", "supplier_id", "part_id", "quantity", "line_total")).cast("long"))


def ratio(value: Column, reference: Column, support: Column, zero: str = "zero_reference") -> tuple[Column, Column]:
    """A feature and the reason why it is missing; never both."""
    enough = support >= LEAST
    reason = F.when(~enough, F.lit("insufficient_history")).when(reference == 0, F.lit(zero))
    return F.when(enough, F.try_divide(value, reference)), reason


#: The six features and which reference divides them.
RATIOS = ("price_ratio", "price_iqr_distance", "relative_iqr", "quantity_ratio", "total_ratio", "pair_price_ratio")



#: What supports are counted by.
SUPPORTS = {"item": ("item",), "pair": ("item", "supplier_id"), "supplier": ("supplier_id",), "unit": ("unit",), "window": ()}


def trailing_supports(d: DataFrame, kind: str) -> DataFrame:
    """(keys of the kind, day, n): the lines of the 90 days before a day.

    Lines are counted by keys and day first; windows run over days, of which a
    key has few, never over lines.
    """
    keys = SUPPORTS[kind]
    daily = d.where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(F.count("*").alias("c"))
    return daily.select(*keys, "day", F.coalesce(F.sum("c").over(window(*keys)), F.lit(0)).alias("n"))


def joined(d: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """d with the other columns of found, whose keys may be null and are distinct."""
    of = {k: f"__of_{k}" for k in keys}
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(of[k]))
    return d.join(found.withColumnsRenamed(of), same, "left").drop(*of.values())


#: The measures by number, and the quantiles of each; the first three are of an item, the last of an item and supplier.
MEASURES = {0: "unit_price", 1: "quantity", 2: "line_total", 3: "unit_price"}
SHARES = {0: (0.25, 0.5, 0.75), 1: (0.5,), 2: (0.5,), 3: (0.5,)}
#: An item's measures by name.
OF = {"price": 0, "quantity": 1, "total": 2}


def trailing_references(d: DataFrame, items: DataFrame, pairs: DataFrame | None = None, mad: bool = True, of: tuple[str, ...] = tuple(OF)) -> tuple[DataFrame, DataFrame | None]:
    """Of asked (item, day) and (item, supplier, day), the order statistics of the lines in the 90 days before; MAD, pairs and measures only if asked for."""
    item_ids = numbered(items.select("item").distinct())
    pair_ids = None if pairs is None else numbered(pairs.select("item", "supplier_id").distinct()).withColumnRenamed("id", "pair_id")
    group = lambda m: F.col("pair_id" if m == 3 else "id") * trailing.MEASURES + m
    asked_of = sorted(OF[x] for x in of)
    measures = {m: c for m, c in MEASURES.items() if m in asked_of or m == 3 and pairs is not None}
    named = d.select("item", *([] if pairs is None else ["supplier_id"]), "day", *sorted(set(measures.values()))).join(item_ids, "item")
    named = named if pairs is None else joined(named, pair_ids, "item", "supplier_id")
    # a line is shuffled once, by item and day, before its measures are spread; what is counted by day then meets in few tasks
    pair = lambda m: F.col("pair_id") if m == 3 else F.lit(None).cast("long")
    values = F.array(*[F.struct(F.lit(m).alias("m"), pair(m).alias("p"), F.col(c).cast("double").alias("x")) for m, c in measures.items()])
    spread = named.where("day IS NOT NULL").drop("item", "supplier_id").repartition("id", "day").select("id", "day", F.explode(values).alias("e")).where("e.m <> 3 OR e.p IS NOT NULL")
    counted = spread.groupBy("id", "day", "e.m", "e.p", "e.x").agg(F.count("*").alias("c")).select((F.coalesce("p", "id") * trailing.MEASURES + F.col("m")).alias("g"), "day", "x", "c")
    entries = counted.select("g", (F.col("day") + 1).alias("since"), (F.col("day") + DAYS).alias("until"), "x", "c")
    asked = items.join(item_ids, "item").select(F.explode(F.array(*[group(m) for m in asked_of])).alias("g"), "day")
    if pairs is not None:
        asked = asked.unionByName(joined(pairs, pair_ids, "item", "supplier_id").select(group(3).alias("g"), "day"))
    found = trailing.order_statistics(entries, asked, SHARES, (0,) if mad else (), days=DAYS).withColumns({"measure": F.col("g") % trailing.MEASURES, "id": F.floor(F.col("g") / trailing.MEASURES)})
    one = lambda m, what: F.max(F.when((F.col("measure") == m) & (F.col("what") == what), F.col("value")))
    named_of = {0: {"q1": 0, "median_price": 1, "q3": 2, **({"mad_price": -1} if mad else {})}, 1: {"median_quantity": 0}, 2: {"median_total": 0}}
    per_item = found.where("measure < 3").groupBy("id", "day").agg(*[one(m, what).alias(name) for m in asked_of for name, what in named_of[m].items()])
    per_item = per_item.join(item_ids, "id").drop("id")
    if pairs is None:
        return per_item, None
    per_pair = found.where("measure = 3").select(F.col("id").alias("pair_id"), "day", F.col("value").alias("pair_median"))
    return per_item, per_pair.join(pair_ids, "pair_id").drop("pair_id")


def features(lines: DataFrame, covered_from=None, only: DataFrame | None = None, kinds: tuple[str, ...] = tuple(SUPPORTS), mad: bool = True, of: tuple[str, ...] = tuple(OF)) -> DataFrame:
    """The nine features, their reasons, MAD and all support counts of every line.

    only (po_id, order_date, occurrence): for these lines alone; the others are
    their history.

    kinds, mad: which supports are counted besides those of the item, and whether
    MAD is found; without `pair` there is no pair_price_ratio. of: the measures
    (price always) that are referred to; the columns of the others are not read.
    The lines are written once; tables by item, unit or day are joined to them
    without a shuffle of the lines as long as they are small.

    covered_from (a date) says from when on the history is complete; lines whose
    90 days begin before it have the reason `incomplete_coverage` and no feature.
    Lines without an item or a date have no references and are left out.
    """
    history = written(lines.withColumn("day", F.unix_date("order_date").cast("long")), "lines")
    d = history.where(F.col("item").isNotNull() & F.col("day").isNotNull())
    kinds = tuple(k for k in SUPPORTS if k == "item" or k in kinds)
    if only is not None:
        d = d.join(only, ["po_id", "order_date", "occurrence"], "left_semi")
        days, asked_items = d.select("day").distinct(), d.select("item", "day").distinct()
    supports = {}
    for kind in kinds:
        found = trailing_supports(history, kind)
        supports[kind] = written(found if only is None else found.join(days, "day", "left_semi"), f"support-{kind}")
    enough = {k: supports[k].where((F.col("n") >= LEAST) & F.col("item").isNotNull()) for k in ("item", "pair") if k in kinds}
    if only is not None:
        enough = {k: v.join(asked_items, ["item", "day"], "left_semi") for k, v in enough.items()}
    per = dict(zip(("item", "pair"), trailing_references(history, enough["item"].drop("n"), enough["pair"].drop("n") if "pair" in kinds else None, mad, of)))
    for kind in kinds:
        keys, found = SUPPORTS[kind], supports[kind].withColumnRenamed("n", f"n_{kind}")
        if kind == "pair":
            d = joined(d, small(written(per["pair"], "pair-references")), *keys, "day")
        elif kind == "item":
            found = written(joined(found, per["item"], *keys, "day"), "references")
        d = joined(d, small(found), *keys, "day")
    d = d.withColumn("iqr", F.col("q3") - F.col("q1"))
    price, n = F.col("unit_price"), F.col("n_item")
    made = {
        "price_ratio": ratio(price, F.col("median_price"), n), "price_iqr_distance": ratio(price - F.col("median_price"), F.col("iqr"), n, "zero_iqr"),
        "relative_iqr": ratio(F.col("iqr"), F.col("median_price"), n),
    }
    if "quantity" in of:
        made["quantity_ratio"] = ratio(F.col("quantity"), F.col("median_quantity"), n)
    if "total" in of:
        made["total_ratio"] = ratio(F.col("line_total"), F.col("median_total"), n)
    if "pair" in kinds:
        made["pair_price_ratio"] = ratio(price, F.col("pair_median"), F.col("n_pair"))
    if covered_from is not None:
        short = F.date_sub("order_date", DAYS) < F.lit(covered_from)
        made = {k: (F.when(~short, v), F.when(short, F.lit("incomplete_coverage")).otherwise(r)) for k, (v, r) in made.items()}
    return d.withColumns({k: v for k, (v, _) in made.items()}).withColumns({f"{k}_reason": r for k, (_, r) in made.items()})


def eligibility(featured: DataFrame) -> DataFrame:
    """Rows, eligible and excluded ones by reason, per period and per period and category; empty periods too."""
    spark = featured.sparkSession
    d = featured.withColumn("period", period(F.col("order_date")))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = [F.count("*").alias("n"), n(F.col("price_ratio").isNotNull()).alias("eligible"), n(F.col("price_ratio_reason") == "insufficient_history").alias("insufficient"), n(F.col("price_ratio_reason") == "zero_reference").alias("zero")]
    fine = written(d.groupBy("period", "category").agg(*counts), "eligibility")  # lines are counted once
    whole = fine.groupBy("period").agg(*[F.sum(c).alias(c) for c in ("n", "eligible", "insufficient", "zero")])
    sets = fine.unionByName(whole.withColumn("category", F.lit(None).cast("string")))
    every = spark.createDataFrame([(name,) for name, *_ in PERIODS], "period string")
    found = every.join(sets, "period", "left").fillna(0, ["n", "eligible", "insufficient", "zero"])
    return found.select("period", "category", "n", "eligible", (F.col("n") - F.col("eligible")).alias("excluded"), "insufficient", "zero")


def commercial_deviation(price: Column, quantity: Column) -> Column:
    """the larger absolute log ratio."""
    return F.greatest(F.abs(F.ln(price)), F.abs(F.ln(quantity)))


def commercial_rank(lines: DataFrame) -> DataFrame:
    """Eligible lines ranked by deviation within their period; id, date and occurrence break ties.

    Scores are compared at nine digits, so that the order does not hang on the last bit of a logarithm.
    """
    d = features(occurrences(lines).select("po_id", "order_date", "occurrence", "item", "quantity", "unit_price"), kinds=(), mad=False, of=("price", "quantity")).where(F.col("price_ratio").isNotNull() & F.col("quantity_ratio").isNotNull())
    score = F.round(commercial_deviation(F.col("price_ratio"), F.col("quantity_ratio")), 9)
    d = d.select("po_id", "order_date", "occurrence", period(F.col("order_date")).alias("period"), score.alias("score"))
    return carried.ranked(d, "score", ["po_id", "order_date", "occurrence"], "rank", ("period",))


def counterfactuals(lines: DataFrame) -> DataFrame:
    """Each line under each scenario in exact decimals; D leaves out lines it would not change."""
    spark = lines.sparkSession
    table = spark.createDataFrame([(s, str(p), q) for s, p, q in SCENARIOS], "scenario string, factor string, times int")
    exact = lines.withColumns({"price0": F.col("unit_price").cast("decimal(18,6)"), "quantity0": F.col("quantity").cast("bigint")})
    d = exact.crossJoin(F.broadcast(table))  # five rows: the scenario table is the bound
    price = (F.col("price0") * F.col("factor").cast("decimal(3,1)")).cast("decimal(20,6)")
    tenth = F.greatest(F.lit(1), F.round(F.col("quantity0").cast("decimal(18,1)") * F.lit("0.1").cast("decimal(2,1)"), 0).cast("bigint"))
    quantity = F.when(F.col("times").isNull(), tenth).otherwise(F.col("quantity0") * F.col("times"))
    d = d.withColumns({"price1": price, "quantity1": quantity})
    return d.where((F.col("scenario") != "D") | (F.col("quantity1") != F.col("quantity0"))).withColumn("total1", (F.col("price1") * F.col("quantity1").cast("decimal(14,0)")).cast("decimal(34,6)"))


def matrices(featured: DataFrame) -> DataFrame:
    """The lines with all five model features, numbered from 0 within their period by date, id and occurrence.

    The lines of the days before are counted by day, so that only the lines of
    one day and period are ordered together.
    """
    five = ("price_ratio", "price_iqr_distance", "relative_iqr", "quantity_ratio", "total_ratio")
    d = featured.withColumn("period", period(F.col("order_date")))
    for c in five:
        d = d.where(F.col(c).isNotNull())
    daily = d.groupBy("period", "order_date").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("period").orderBy("order_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    daily = daily.select(F.col("period").alias("of_period"), F.col("order_date").alias("of_date"), before.alias("before"))
    daily = small(written(daily, "daily"))
    own = F.row_number().over(W.partitionBy("period", "order_date").orderBy("po_id", "occurrence")) - 1
    numbered = d.withColumn("own", own).join(daily, F.col("period").eqNullSafe(F.col("of_period")) & (F.col("order_date") == F.col("of_date")))
    return numbered.withColumn("index", F.col("before") + F.col("own")).drop("own", "before", "of_period", "of_date")


def changed(featured: DataFrame) -> DataFrame:
    """Lines with references under each scenario: price1, quantity1; those that a scenario would not change are left out."""
    table = featured.sparkSession.createDataFrame(SCENARIOS, "scenario string, factor double, times int")
    tenth = F.greatest(F.lit(1), F.round(F.col("quantity").cast("decimal(18,1)") * F.lit("0.1").cast("decimal(2,1)"), 0).cast("bigint"))
    d = featured.withColumn("__tenth", tenth).crossJoin(F.broadcast(table))  # five rows: the scenario table is the bound
    d = d.withColumns({"price1": F.col("unit_price") * F.col("factor"), "quantity1": F.when(F.col("times").isNull(), F.col("__tenth")).otherwise(F.col("quantity") * F.col("times"))}).drop("__tenth")
    return d.where((F.col("scenario") != "D") | (F.col("quantity1") != F.col("quantity")))


def counterfactual_features(featured: DataFrame) -> DataFrame:
    """The features of changed lines against the frozen references of the unchanged ones."""
    price, n = F.col("price1"), F.col("n_item")
    total = F.col("price1") * F.col("quantity1")
    paired = {"pair_price_ratio": ratio(price, F.col("pair_median"), F.col("n_pair"))[0]} if "pair_median" in featured.columns else {}
    return changed(featured).withColumns(paired | {
        "price_ratio": ratio(price, F.col("median_price"), n)[0], "price_iqr_distance": ratio(price - F.col("median_price"), F.col("iqr"), n)[0], "quantity_ratio": ratio(F.col("quantity1"), F.col("median_quantity"), n)[0],
        "total_ratio": ratio(total, F.col("median_total"), n)[0],
    })


def rule_experiment(featured: DataFrame) -> DataFrame:
    """The rule's score of every line of the evaluation periods before and after each scenario."""
    d = featured.where(F.col("price_ratio").isNotNull() & F.col("quantity_ratio").isNotNull()).withColumn("period", period(F.col("order_date")))
    d = d.where(F.col("period").isin("validation", "retrospective")).withColumn("before", F.round(commercial_deviation(F.col("price_ratio"), F.col("quantity_ratio")), 9))
    after = commercial_deviation(F.col("price1") / F.col("median_price"), F.col("quantity1") / F.col("median_quantity"))
    return changed(d).withColumn("after", F.round(after, 9)).select(*[c for c in ("po_id", "order_date", "occurrence") if c in featured.columns], "period", "category", "scenario", "before", "after")


def paired_effects(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Effects per period and scenario, and per category where it has `least` pairs."""
    d = written(pairs.select("period", "scenario", "category", (F.col("after") - F.col("before")).alias("delta")), "deltas")  # read three times
    n = lambda c: F.sum(c.cast("long"))
    # a row for the pair's category and one for all of them
    levels = d.select("period", "scenario", F.explode(F.array(F.struct(F.lit(True).alias("each"), "category"), F.struct(F.lit(False).alias("each"), F.lit(None).cast("string").alias("category")))).alias("l"), "delta").select("period", "scenario", "l.each", "l.category", "delta")
    keys = ["period", "scenario", "each", "category"]
    counts = levels.groupBy(*keys).agg(F.count("*").alias("valid"), n(F.col("delta") > 0).alias("increased"), n(F.col("delta") < 0).alias("decreased"), F.avg("delta").alias("mean_delta"))
    both = joined(counts, near_quantiles(levels, "delta", [0.5], *keys).select(*keys, F.col("q0").alias("median_delta")), *keys)
    shown = F.col("category").isNull() | (F.col("valid") >= least)
    rounded = {"increased": F.col("increased"), "decreased": F.col("decreased"), "mean_delta": F.round("mean_delta", 6) + 0.0, "median_delta": F.round("median_delta", 6) + 0.0}
    return both.select("period", "scenario", "category", "valid", *[F.when(shown, c).alias(k) for k, c in rounded.items()])


#: What has to agree between an operation and its references, besides the constant currency and price basis.
GROUP_KEYS = ("item", "specification", "unit", "packaging", "payment_terms", "zone", "same_only")


def comparable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with all keys of comparability."""
    li = tables.read(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate"])
    part, orders = tables.read(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"]), tables.read(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    d = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("po_id"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("day"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("cents"), F.col("p_brand").alias("item"),
        F.col("p_type").alias("specification"), F.col("l_returnflag").alias("unit"), (F.col("l_partkey") % 3).alias("packaging"), F.col("o_orderpriority").alias("payment_terms"), F.col("l_linestatus").alias("zone"), (F.col("l_linenumber") % 2 == 0).alias("same_only"),
    )


def available_from(line_day: Column, part: Column) -> Column:
    """J13's second clock: the day on which a line becomes known."""
    return line_day + F.pmod(part, F.lit(30))


def two_clock_counts(lines: DataFrame) -> DataFrame:
    """J13 for every line: the lines of its item dated in the 90 days before and known before its day.

    A line counts from the day after it is known to the ninetieth after its date,
    so the count of a day is a running sum of such starts and ends by item and day.
    """
    d = lines.withColumn("day", F.unix_date("order_date"))
    known, last = available_from(F.col("day"), F.col("part_id")) + 1, F.col("day") + DAYS
    ends = d.where(known <= last).select("item", F.explode(F.array(F.struct(known.alias("day"), F.lit(1).alias("x")), F.struct((last + 1).alias("day"), F.lit(-1).alias("x")))).alias("e")).select("item", "e.day", "e.x")
    days = d.select("item", F.col("day").cast("long").alias("day"), F.lit(0).alias("x")).unionByName(ends).groupBy("item", "day").agg(F.sum("x").alias("x"))
    counts = days.select("item", "day", F.sum("x").over(W.partitionBy("item").orderBy("day")).alias("n"))
    return d.join(counts, ["item", "day"]).select("po_id", "part_id", "supplier_id", F.col("day").cast("long").alias("day"), "n")


def exclusion_reasons(lines: DataFrame, available: Column, comparable: Column) -> DataFrame:
    """P20 over all pairs of operation and line of one item: reason, n; self > outside > not available > incomparable.

    available and comparable: what the line itself has to be (what hangs on the
    operation too, its clock and its keys, is in prices.price_analysis). Pairs are
    counted by day and item, those of an id with itself by windows over the id;
    no pair is made.
    """
    kind = F.when(~available, 0).when(~comparable, 1).otherwise(2)
    kinds = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)) for k in range(3)]
    d = lines.where(F.col("item").isNotNull()).select("po_id", "item", F.unix_date("order_date").alias("day"), kind.alias("kind"))
    daily = d.groupBy("item", "day").agg(F.count("*").alias("ops"), *[c.alias(f"k{k}") for k, c in enumerate(kinds)])
    inside = daily.select("item", "ops", *[F.coalesce(F.sum(f"k{k}").over(window("item")), F.lit(0)).alias(f"k{k}") for k in range(3)])
    inside = inside.groupBy("item").agg(F.sum("ops").alias("ops"), *[F.sum(F.col("ops") * F.col(f"k{k}")).alias(f"k{k}") for k in range(3)])
    inside = inside.agg(F.sum(F.col("ops") * F.col("ops")).alias("pairs"), *[F.sum(f"k{k}").alias(f"k{k}") for k in range(3)])
    own = d.where(F.col("po_id").isNotNull()).select(F.count("*").over(W.partitionBy("item", "po_id")).alias("own"), *[F.coalesce(c.over(window("item", "po_id")), F.lit(0)).alias(f"o{k}") for k, c in enumerate(kinds)])
    own = own.agg(F.sum("own").alias("own"), *[F.sum(f"o{k}").alias(f"o{k}") for k in range(3)])
    t = inside.crossJoin(own)
    left = [F.col(f"k{k}") - F.col(f"o{k}") for k in range(3)]
    counted = {"self": F.col("own"), "outside_window": F.col("pairs") - F.col("own") - left[0] - left[1] - left[2], "not_available": left[0], "incomparable": left[1], "comparable": left[2]}
    return t.select(F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), c.cast("long").alias("n")) for r, c in counted.items()])).alias("x")).select("x.*").where("n > 0")
