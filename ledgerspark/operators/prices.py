"""Every line's price against the comparable lines known before it, all by counting.

A reference of an operation agrees in all keys, is dated in the 90 days before,
was known before the operation's day, and has another id. Lines are counted by
group and day; support, distinct days and suppliers are running sums of the days
on which intervals of visibility begin and end; the median is found by counted
ranges. Only what an operation's own id contributes is looked up by id and taken
off. No pair of operation and reference is made but those of one id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import SMALL, small, written
from . import trailing
from .procurement import DAYS, LEAST, joined

BLOCK = 90


def covering(intervals: dict[str, DataFrame], days: DataFrame) -> DataFrame:
    """days (g, day; they may repeat) with, by name, how many of the intervals (g, since, until) of the group hold the day; all names in one shuffle and one running sum."""
    ends = F.explode(F.array(F.struct(F.col("since").alias("day"), F.lit(1).cast("long").alias("x")), F.struct((F.col("until") + 1).alias("day"), F.lit(-1).cast("long").alias("x")))).alias("e")
    none = F.lit(0).cast("long")
    steps = days.select("g", "day", *[none.alias(k) for k in intervals], F.lit(1).alias("asked"))
    for name, spans in intervals.items():
        steps = steps.unionByName(spans.where("since <= until").select("g", ends).select("g", "e.day", *[(F.col("e.x") if k == name else none).alias(k) for k in intervals], F.lit(0).alias("asked")))
    both = steps.groupBy("g", "day").agg(*[F.sum(k).alias(k) for k in intervals], F.max("asked").alias("asked"))
    upto = W.partitionBy("g").orderBy("day")
    return both.select("g", "day", "asked", *[F.sum(k).over(upto).alias(k) for k in intervals]).where("asked = 1").drop("asked")


def coded(d: DataFrame, columns: list[str], name: str) -> DataFrame:
    """A written table with a number for each combination of the columns' values.

    Columns of few values are numbered one by one (a broadcast for each) and their
    numbers combined, so that no row is shuffled. Where a column has many, the
    combinations are numbered and joined.
    """
    near = d.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    out, code, size = d, F.lit(0).cast("long"), 1
    if max(near) <= SMALL // 2:
        for k, c in enumerate(columns):
            values = written(d.select(F.col(c).alias(f"__v{k}")).distinct().coalesce(1).withColumn(f"__n{k}", F.monotonically_increasing_id()), "values")  # from 0
            n = max(values.count(), 1)
            out, code, size = out.join(F.broadcast(values), F.col(c).eqNullSafe(F.col(f"__v{k}"))), code * n + F.col(f"__n{k}"), size * n
        if size < 1 << 55:
            return out.withColumn(name, code).drop(*[f"__{x}{k}" for k in range(len(columns)) for x in "vn"])
    return joined(d, trailing.numbered(d.select(*columns).distinct()).withColumnRenamed("id", name), *columns)


def earliest_two(d: DataFrame, *keys: str) -> DataFrame:
    """Per keys the earliest `known`, whose id it is, and the earliest of any other id (or of a line without one)."""
    by_id = d.groupBy(*keys, "po_id").agg(F.min("known").alias("known"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("known", "po_id"))
    two = by_id.withColumn("place", place).where("place <= 2")
    return two.groupBy(*keys).agg(F.min(F.when(F.col("place") == 1, F.col("known"))).alias("first"), F.min(F.when(F.col("place") == 1, F.col("po_id"))).alias("first_id"), F.min(F.when(F.col("place") == 2, F.col("known"))).alias("second"))


def visible_from(day: Column, known: Column) -> Column:
    return F.greatest(day, known) + 1


#: sweep() lays a group out in blocks of so many days, looks at so many rows at a time, and at so many pairs of a day and a visible line.
SPAN, ROWS, PAIRS = 180, 1 << 17, 1 << 21


def codes(c: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, -1 for null."""
    return c.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def held_by(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each asked key is among the sorted keys."""
    return np.searchsorted(keys, asked, "right") - np.searchsorted(keys, asked, "left")


def visible_figures(rows: pa.Table, ask: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, dates, suppliers and twice the median (NaN: none) of the asked rows; rows are ordered by g, block and day.

    The visible lines of a group and day are paired with the day once, at most
    DAYS times each; what an operation's own id adds is taken off by the pairs of
    that id.
    """
    g, block, day, since = (rows[c].to_numpy() for c in ("g", "block", "day", "since"))
    price = rows["cents"].combine_chunks().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    supplier, ident = codes(rows["supplier_id"]), codes(rows["po_id"])
    values, price_at = np.unique(price, return_inverse=True)  # NaN comes last, once
    priced = ~np.isnan(price)
    group = np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (block[1:] != block[:-1])])
    width = int(day.max() - day.min()) + DAYS + 2
    at = group * width + (day - day.min()) + DAYS  # by group and day, as the rows are ordered
    units, unit_of = np.unique(at[ask], return_inverse=True)
    low, high = np.searchsorted(at, units - DAYS), np.searchsorted(at, units)
    unit_day = day[ask[firsts(at[ask])]] if len(ask) else day[:0]
    n, dates, suppliers, twice = (np.zeros(len(ask)) for _ in range(4))
    # rows of one group that share an id, each asked one with every other
    same = np.flatnonzero(ident >= 0)
    same = same[np.lexsort((ident[same], group[same]))]
    key = group[same] * (ident.max() + 1) + ident[same]
    begin, end = np.searchsorted(key, key), np.searchsorted(key, key, "right")
    place = np.full(len(g), -1)
    place[ask] = np.arange(len(ask))
    mine = np.flatnonzero((end - begin > 1) & (place[same] >= 0))
    length = (end - begin)[mine]
    own = same[np.repeat(begin[mine] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())]
    who = np.repeat(place[same[mine]], length)
    seen = (day[own] < day[ask[who]]) & (day[own] >= day[ask[who]] - DAYS) & (since[own] <= day[ask[who]])
    own, who = own[seen], who[seen]

    total = np.r_[0, np.cumsum(high - low)]
    order = np.argsort(unit_of, kind="stable")
    bounds = np.searchsorted(unit_of[order], np.arange(len(units) + 1))
    a = 0
    while a < len(units):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        size = (high - low)[a:b]
        u = np.repeat(np.arange(b - a), size)
        ref = np.arange(size.sum()) + np.repeat(low[a:b] - (total[a:b] - total[a]), size)
        known = since[ref] <= unit_day[a:b][u]
        u, ref = u[known], ref[known]
        by_day = u * width + (day[ref] - day.min())
        by_supplier = np.sort((u * (supplier.max() + 2) + supplier[ref])[supplier[ref] >= 0])
        by_price = np.sort((u * len(values) + price_at[ref])[priced[ref]])
        asked = order[bounds[a] : bounds[b]]
        of = unit_of[asked] - a
        n[asked] = np.bincount(u, minlength=b - a)[of]
        dates[asked] = np.bincount(by_day[firsts(by_day)] // width, minlength=b - a)[of]
        suppliers[asked] = np.bincount(by_supplier[firsts(by_supplier)] // (supplier.max() + 2), minlength=b - a)[of]
        start = np.searchsorted(by_price, np.arange(b - a) * len(values))[of]
        some = np.bincount(by_price // len(values), minlength=b - a)[of]
        # what an operation's own id adds
        skip = np.flatnonzero((unit_of[who] >= a) & (unit_of[who] < b))
        skips = []
        if len(skip):
            o, w = own[skip], who[skip]
            v = unit_of[w] - a
            np.subtract.at(n, w, 1)
            for table, column, shift, found in ((by_day, day - day.min(), width, dates), (by_supplier, supplier, supplier.max() + 2, suppliers)):
                there = column[o] >= 0
                pairs, times = np.unique(np.stack([w[there], column[o[there]]]), axis=1, return_counts=True)
                alone = held_by(table, (unit_of[pairs[0]] - a) * shift + pairs[1]) == times
                np.subtract.at(found, pairs[0][alone], 1)
            o, w, v = (x[priced[o]] for x in (o, w, v))
            by = np.lexsort((price_at[o], w))
            o, w, v = o[by], w[by], v[by]
            first = firsts(w * len(values) + price_at[o])
            again = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
            spot = np.searchsorted(by_price, v * len(values) + price_at[o]) + again  # where the skipped prices stand
            turn = firsts(w)
            turn = np.arange(len(w)) - np.repeat(turn, np.diff(np.r_[turn, len(w)]))
            local = np.full(len(ask), -1)
            local[asked] = np.arange(len(asked))
            some = some - np.bincount(local[w], minlength=len(asked))
            skips = [(local[w[turn == k]], spot[turn == k]) for k in range(int(turn.max()) + 1 if len(turn) else 0)]
        middle = []
        for place_ in ((some - 1) // 2, some // 2):
            at_ = start + np.maximum(place_, 0)
            for w, spot in skips:  # in ascending order of place
                at_[w] += spot <= at_[w]
            middle.append(at_)
        has = some > 0
        got = np.full(len(asked), np.nan)
        got[has] = values[by_price[middle[0][has]] % len(values)] + values[by_price[middle[1][has]] % len(values)]
        twice[asked] = got
        a = b
    return n, dates, suppliers, twice


def sweep(d: DataFrame) -> DataFrame:
    """d (g, day, since, until, po_id, supplier_id, cents, ...) with n_seen, dates, suppliers and twice the median of what is visible of other ids.

    A row is laid where its day's block of its group is, and once more in a block
    of which it can be seen. Tasks go through blocks by day and hold no more than
    the rows of the DAYS before, whatever a group's size.
    """
    block = lambda c: F.floor(c / SPAN)
    seen = ["g", "day", "since", "po_id", "supplier_id", "cents"]
    rest = [c for c in d.columns if c not in (*seen, "until")]
    laid = d.select(*seen, *rest, F.explode(F.sequence(block(F.col("day")), block(F.col("until")))).alias("block")).withColumn("ask", F.col("block") == block(F.col("day")))
    laid = laid.where("ask OR since < (block + 1) * %d" % SPAN).select(*seen, *[F.when(F.col("ask"), F.col(c)).alias(c) for c in rest], "block", "ask")
    laid = laid.repartition("g", "block").sortWithinPartitions("g", "block", "day")
    kept = [*seen, *rest]
    made = ("n_seen", "dates", "suppliers", "twice")
    schema = StructType([*[StructField(c, laid.schema[c].dataType) for c in kept], *[StructField(c, LongType()) for c in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, new = None, []

        def look() -> Iterator[pa.RecordBatch]:
            nonlocal before
            fresh = pa.Table.from_batches(new)
            new.clear()
            old = 0 if before is None else before.num_rows
            rows = fresh if before is None else pa.concat_tables([before, fresh])
            ask = old + np.flatnonzero(fresh["ask"].to_numpy())
            found = visible_figures(rows, ask)
            out = rows.select(kept).take(pa.array(ask))
            for name, x in zip(made, found):
                out = out.append_column(name, pa.array(x, from_pandas=True).cast(pa.int64()))
            yield from out.to_batches()
            g, b, day = (rows[c].to_numpy() for c in ("g", "block", "day"))
            # kept: the last group's rows that a later day can see
            before = rows.filter(pa.array((g == g[-1]) & (b == b[-1]) & (day >= day[-1] - DAYS)))

        for batch in batches:
            if batch.num_rows:
                new.append(batch)
            if sum(x.num_rows for x in new) >= ROWS:
                yield from look()
        if new:
            yield from look()

    return laid.mapInArrow(run, schema)


#: What price_analysis() finds: why lines are no references; distinct days and suppliers of the references; their median.
PARTS = ("reasons", "spread", "median")


def price_analysis(lines: DataFrame, known: Column, scope: list[str], keys: list[Column], least: int = LEAST, parts: tuple[str, ...] = PARTS, shown: list[str] | None = None) -> DataFrame:
    """D15 for every line: reasons why lines of its scope are no references (P20), support, exact median and difference.

    lines: po_id, day, supplier_id, cents, the columns of scope. known: the day
    from which a line is known (it counts from the day after). keys: what has to
    agree besides the scope. Counts: n_self > n_outside > n_not_available >
    n_incomparable, in this precedence, and n of the references. Lines without a
    day or a scope column have no result; a line without an id is nobody's own;
    a reference without a price counts in n and not in the median. Fewer than
    `least` references give no median. parts: what is found besides n. shown: the
    columns of lines that are returned (all).

    Where keys make thin groups and no reasons are asked for, each group is gone
    through by day (sweep); else figures of groups and days are counted.
    """
    reasons, spread, median = (x in parts for x in PARTS)
    d = lines.withColumns({"known": known, **{f"__k{k}": c for k, c in enumerate(keys)}})
    for c in (*scope, "day"):
        d = d.where(F.col(c).isNotNull())
    names = [f"__k{k}" for k in range(len(keys))]
    shown = lines.columns if shown is None else shown
    if names and spread and median and not reasons:
        needed = dict.fromkeys([*shown, *scope, *names, "po_id", "supplier_id", "day", "cents", "known"])
        d = coded(written(d.select(*needed), "operations"), [*scope, *names], "g")
        used = dict.fromkeys(["g", "day", "po_id", "supplier_id", "cents", *shown])
        found = sweep(d.select(*used, visible_from(F.col("day"), F.col("known")).alias("since"), (F.col("day") + DAYS).alias("until")))
        return told(found.withColumn("n", F.col("n_seen")), shown, ["n", "dates", "suppliers"], least, median)
    d = written(d.withColumn("row", F.monotonically_increasing_id() + 1), "operations")  # the joins of the input are made once
    d = coded(coded(d, scope, "s"), [*scope, *names], "g") if reasons or not names else coded(d, [*scope, *names], "g").withColumn("s", F.col("g"))
    d = d.drop(*names).withColumns({"since": visible_from(F.col("day"), F.col("known")), "until": F.col("day") + DAYS})
    # what an operation's own id contributes: only lines that share id and scope with another are paired
    shared = d.where("po_id IS NOT NULL").select("row", "po_id", "s", "g", "day", "supplier_id", "cents", "since", "until")
    shared = written(shared.withColumn("twins", F.count("*").over(W.partitionBy("po_id", "s"))).where("twins > 1").drop("twins"), "shared")
    theirs = shared.select("po_id", "s", *[F.col(c).alias(f"r_{c}") for c in ("g", "day", "supplier_id", "cents", "since", "until")])
    pairs = shared.select("row", "po_id", "s", "g", "day").join(theirs, ["po_id", "s"])
    inside = (F.col("r_day") >= F.col("day") - DAYS) & (F.col("r_day") < F.col("day"))
    seen = (F.col("r_since") <= F.col("day")) & (F.col("day") <= F.col("r_until"))
    alike = F.col("r_g") == F.col("g")
    n = lambda c: F.sum(c.cast("long"))
    own = written(pairs.groupBy("row", "po_id", "g", "day").agg(
        F.count("*").alias("o_self"), n(inside).alias("o_inside"), n(seen).alias("o_seen"), n(seen & alike).alias("o_alike"), F.sort_array(F.collect_list(F.when(seen & alike, F.col("r_cents").cast("double")))).alias("skip"),
        F.collect_set(F.when(seen & alike, F.col("r_day"))).alias("own_days"), F.collect_set(F.when(seen & alike, F.col("r_supplier_id"))).alias("own_suppliers")), "own")
    special = written(own.where("o_alike > 0"), "special")
    mine = own.select("row", "o_self", "o_inside", "o_seen", "o_alike", F.size("own_suppliers").alias("o_suppliers"))
    # shared figures by group and day
    intervals = {"n_all": d.select("g", "since", "until")}
    if spread:
        by_supplier = written(d.groupBy("g", "supplier_id", "day").agg(F.min("known").alias("known")), "by-supplier")
        of_first = lambda *by: by_supplier.groupBy(*by).agg(F.min("known").alias("known"))
        ends = (visible_from(F.col("day"), F.col("known")).alias("since"), (F.col("day") + DAYS).alias("until"))
        spans = by_supplier.where("supplier_id IS NOT NULL").select("g", "supplier_id", *ends).where("since <= until")
        order = W.partitionBy("g", "supplier_id").orderBy("since", "until")
        islands = spans.withColumn("new", (F.col("since") > F.coalesce(F.max("until").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-(1 << 40))) + 1).cast("int")).withColumn("island", F.sum("new").over(order))
        islands = islands.groupBy("g", "supplier_id", "island").agg(F.min("since").alias("since"), F.max("until").alias("until"))
        intervals |= {"dates": of_first("g", "day").select("g", *ends), "suppliers": islands.select("g", "since", "until")}
        # days and suppliers that only the own id has
        own_days = special.select("row", "po_id", "g", F.col("day").alias("at"), F.explode("own_days").alias("day"))
        own_suppliers = special.select("row", "po_id", "g", F.col("day").alias("at"), F.explode("own_suppliers").alias("supplier_id"))
        of = lambda asked, *by: d.select("g", "supplier_id", "day", "po_id", "known").join(small(written(asked.select(*by).distinct(), "asked")), list(by), "left_semi")
        by_day, by_both = earliest_two(of(own_days, "g", "day"), "g", "day"), earliest_two(of(own_suppliers, "g", "supplier_id"), "g", "supplier_id", "day")
        other = F.when(F.col("first_id").eqNullSafe(F.col("po_id")), F.col("second")).otherwise(F.col("first"))
        lost = own_days.join(by_day, ["g", "day"]).where(other.isNull() | (other >= F.col("at"))).groupBy("row").agg(F.count("*").alias("lost_days"))
        block = lambda c: F.floor(c / BLOCK)
        asked = own_suppliers.withColumn("block", F.explode(F.sequence(block(F.col("at") - DAYS), block(F.col("at") - 1))))
        held = asked.join(by_both.withColumn("block", block(F.col("day"))), ["g", "supplier_id", "block"]).where((F.col("day") >= F.col("at") - DAYS) & (F.col("day") < F.col("at")) & (other < F.col("at"))).select("row", "supplier_id").distinct()
        mine = mine.join(lost, "row", "left").join(held.groupBy("row").agg(F.count("*").alias("kept_suppliers")), "row", "left")
    figures = written(covering(intervals, d.select("g", "day")), "figures")
    if median:  # one ask for a group and day, and one for each operation that leaves its own out
        enough = figures.where(F.col("n_all") >= least).select("g", "day")
        number = (F.col("g") * trailing.MEASURES).alias("g")
        asks = enough.select(number, "day", F.lit(0).cast("long").alias("who"), F.array().cast("array<double>").alias("skip"))
        asks = asks.unionByName(small(special).join(enough, ["g", "day"]).select(number, "day", F.col("row").alias("who"), "skip"))
        entries = d.select(number, "since", "until", F.col("cents").cast("double").alias("x"))
        found = trailing.order_statistics(entries, asks, {0: (0.5,)}, days=DAYS).select(F.floor(F.col("g") / trailing.MEASURES).alias("g"), "day", "who", (2 * F.col("value")).cast("long").alias("twice"))
        figures = written(figures.join(found.where("who = 0").drop("who"), ["g", "day"], "left"), "figures")
        mine = mine.join(found.where("who <> 0").select(F.col("who").alias("row"), F.col("twice").alias("own_twice")), "row", "left")
    out = d.drop("since", "until").join(small(figures), ["g", "day"])
    if reasons:
        of_scope = lambda *c: d.select(F.col("s").alias("g"), *c)
        scoped = covering({"inside": of_scope((F.col("day") + 1).alias("since"), "until"), "seen": of_scope("since", "until")}, of_scope("day"))
        scoped = written(scoped.join(of_scope().groupBy("g").agg(F.count("*").alias("total")), "g").withColumnRenamed("g", "s"), "scoped")
        out = out.join(small(scoped), ["s", "day"])
    out = out.join(small(written(mine, "mine")), "row", "left").withColumn("o_self", F.coalesce("o_self", F.col("po_id").isNotNull().cast("long")))
    out = out.fillna(0, [c for c in mine.columns if c.startswith(("o_", "lost_", "kept_"))])
    count = F.col("n_all") - F.col("o_alike")
    made = {"n": count}
    if reasons:
        inside, seen = F.col("inside") - F.col("o_inside"), F.col("seen") - F.col("o_seen")
        made = {"n_self": F.col("o_self"), "n_outside": F.col("total") - F.col("o_self") - inside, "n_not_available": inside - seen, "n_incomparable": seen - count} | made
    if spread:
        made |= {"dates": F.col("dates") - F.col("lost_days"), "suppliers": F.col("suppliers") - (F.col("o_suppliers") - F.col("kept_suppliers"))}
    out = out.withColumns(made)
    if median:
        out = out.withColumn("twice", F.when(F.col("o_alike") > 0, F.col("own_twice")).otherwise(F.col("twice")))
    return told(out, [c for c in shown if c != "known"], list(made), least, median)


def told(out: DataFrame, shown: list[str], made: list[str], least: int, median: bool) -> DataFrame:
    """The shown and made columns, why there is no median, and the median and the price's difference from it where there are enough references."""
    enough, also = F.col("n") >= least, [F.when(F.col("n") < least, F.lit("insufficient_history")).alias("reason")]
    if median:
        percent = F.round(F.try_divide((2 * F.col("cents") - F.col("twice")) * 100.0, F.col("twice")), 6) + 0.0
        also += [F.when(enough, F.col("twice")).alias("twice_median_cents"), F.when(enough, percent).alias("percent_difference")]
    return out.select(*shown, *made, *also)
