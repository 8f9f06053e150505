"""Exact order statistics over trailing windows, found by counting: no group's rows meet in a task.

A value is visible from day `since` to day `until`. Values are counted and dealt
into ranges of about equal mass per group. Counts by group, day and range (their
number depends on days and ranges, not on rows) tell for each asked day which
range holds a rank, and which place it has in it. Only the visible values of
that range are then fetched, by a join on group, range and block of days. The
median distance from the median (MAD) is found in the same way: a range of
values is a range of distances, and ranges that are surely nearer are counted.

A hot group has as many ranges and blocks as any other, but what a task sees of
it is one range of one block; `cuts` sets how many ranges there are. Groups are
numbers: `MEASURES` times the caller's id of a key, plus the measure.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.shared import SMALL, written

SPAN = 30
#: Ranges of a group with many rows; a range of a 90-day window of n values holds about n / CUTS.
CUTS = 128
MEASURES = 8


def ranges(counted: DataFrame, cuts: int) -> DataFrame:
    """counted (g, x, c, ...) with `r`, the range of x among those of its group: looked up among every eighth edge, then among eight."""
    shares = [k / cuts for k in range(1, cuts)]
    edges = counted.where("c > 0").groupBy("g").agg(F.array_distinct(F.percentile_approx("x", shares, 1000)).alias("edges"))
    edges = edges.withColumn("coarse", F.filter("edges", lambda e, k: k % 8 == 7))
    below = lambda of: F.size(F.filter(of, lambda e: e < F.col("x")))
    near = counted.join(edges, "g").withColumn("r", 8 * below("coarse"))
    return near.withColumn("r", F.col("r") + below(F.slice("edges", F.col("r") + 1, 8))).drop("edges", "coarse")


def grid(asked: pa.Table, events: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one group: the visible values by ask and range, without those to skip, and each range's smallest and largest value."""
    day, r, c = (events[k].to_numpy() for k in ("at", "r", "c"))
    size = int(r.max()) + 1 if len(r) else 0
    low, high = np.full(size, np.inf), np.full(size, -np.inf)
    np.minimum.at(low, r, events["low"].to_numpy())
    np.maximum.at(high, r, events["high"].to_numpy())
    days, row = np.unique(day, return_inverse=True)
    changes = np.zeros((len(days) + 1, size), np.int64)
    np.add.at(changes, (row + 1, r), c)
    counts = np.cumsum(changes, 0)[np.searchsorted(days, asked["day"].to_numpy(), "right")]
    if "skip" in asked.column_names:
        skip = asked["skip"].combine_chunks()
        lengths = np.asarray(pc.fill_null(pc.list_value_length(skip), 0))
        np.subtract.at(counts, (np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(high, np.asarray(skip.flatten()))), 1)
    return counts, low, high, days


ASK = "g long, day long, who long, n long, what int, slot int, r int, low long, high long, weight double, center double"


def table(group: pa.Table, columns: dict) -> pa.Table:
    """columns of arrays, with `row` (of the group's table) giving g and day."""
    row = pa.array(columns.pop("row"))
    kinds = {"n": pa.int64(), "what": pa.int32(), "slot": pa.int32(), "r": pa.int32(), "low": pa.int64(), "high": pa.int64(), "weight": pa.float64(), "center": pa.float64()}
    return pa.table({"g": group["g"].take(row), "day": group["day"].take(row), "who": group["who"].take(row)} | {k: pa.array(columns[k], t, from_pandas=True) for k, t in kinds.items()})


def places(shares: dict[int, tuple[float, ...]]):
    """For each asked day and share: the ranges of the two values between which the quantile lies, and their ranks in them."""

    def run(asked: pa.Table, events: pa.Table) -> pa.Table:
        made = {k: [] for k in ("row", "n", "what", "slot", "r", "low", "high", "weight")}
        if asked.num_rows and events.num_rows:
            counts, *_ = grid(asked, events)
            n, upto = counts.sum(1), np.cumsum(counts, 1)
            some = np.flatnonzero(n > 0)
            for k, q in enumerate(shares[asked["g"][0].as_py() % MEASURES]):
                at = q * (n - 1)
                found = []
                for place in (np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)):
                    r = (upto <= place[:, None]).sum(1)
                    before = np.where(r > 0, np.take_along_axis(upto, np.maximum(r - 1, 0)[:, None], 1)[:, 0], 0)
                    found.append((r, place - before + 1))
                (r0, low), (r1, high) = found
                one = some[r0[some] == r1[some]]
                two = some[r0[some] != r1[some]]
                for rows, r, a, b in ((one, r0, low, high), (two, r0, low, None), (two, r1, None, high)):
                    missing = np.full(len(rows), np.nan)
                    for name, value in (("row", rows), ("n", n[rows]), ("what", np.full(len(rows), k)), ("slot", r[rows]), ("r", r[rows]), ("low", missing if a is None else a[rows]), ("high", missing if b is None else b[rows]), ("weight", (at - np.floor(at))[rows])):
                        made[name].append(value)
        return flat(asked, made)

    return run


def flat(asked: pa.Table, made: dict) -> pa.Table:
    whole = {k: np.concatenate(v) if v else np.zeros(0) for k, v in made.items()}
    whole["row"] = whole["row"].astype(np.int64)
    return table(asked, whole | {"center": whole.get("center", np.full(len(whole["row"]), np.nan))})


def distances(asked: pa.Table, events: pa.Table) -> pa.Table:
    """For each asked day and its center: the ranges that can hold the median distance, and its rank among their distances."""
    made = {k: [] for k in ("row", "n", "what", "slot", "r", "low", "high", "weight", "center")}
    if asked.num_rows and events.num_rows:
        counts, low, high, _ = grid(asked, events)
        center, n = asked["center"].to_numpy(), counts.sum(1)
        nearest = np.maximum(np.maximum(low[None] - center[:, None], center[:, None] - high[None]), 0)
        farthest = np.maximum(np.abs(low[None] - center[:, None]), np.abs(high[None] - center[:, None]))
        first, last = (n - 1) // 2 + 1, n // 2 + 1

        def reach(by: np.ndarray, rank: np.ndarray) -> np.ndarray:
            order = np.argsort(by, 1, kind="stable")
            upto = np.cumsum(np.take_along_axis(counts, order, 1), 1)
            at = np.minimum((upto < rank[:, None]).sum(1), by.shape[1] - 1)
            return np.take_along_axis(np.take_along_axis(by, order, 1), at[:, None], 1)

        closer = farthest < reach(nearest, first)
        row, r = np.nonzero(~closer & (nearest <= reach(farthest, last)) & (counts > 0))
        before = np.where(closer, counts, 0).sum(1)
        made = {"row": [row], "n": [n[row]], "what": [np.full(len(row), -1)], "slot": [np.full(len(row), -1)], "r": [r], "low": [(first - before)[row]], "high": [(last - before)[row]], "weight": [np.full(len(row), 0.5)], "center": [center[row]]}
    return flat(asked, made)


def fetched(asks: DataFrame, counted: DataFrame, days: int, skipped: DataFrame | None = None) -> DataFrame:
    """(g, day, who, n, what, value) of asks: the visible values of the asked ranges, ordered and counted off.

    Values of ranges that nobody asks for in their block of days are not shuffled
    as long as the asked ones are few.

    skipped (g, who, r, x): values that an ask leaves out, once for each row.
    """
    block = lambda c: F.floor(c / SPAN)
    cell = F.col("block") * (1 << 20) + F.col("r")
    asks = written(asks, "asks")
    spread = asks.withColumn("block", F.explode(F.sequence(block(F.col("day") - (days - 1)), block(F.col("day"))))).withColumn("cell", cell).drop("block")
    held = counted.withColumn("block", block(F.col("since"))).select("g", cell.alias("cell"), "since", "until", "x", "c")
    cells = written(spread.select("g", "cell").distinct(), "cells")
    if cells.count() <= SMALL:
        held = held.join(F.broadcast(cells), ["g", "cell"], "left_semi")
    met = spread.join(held, ["g", "cell"]).where((F.col("since") <= F.col("day")) & (F.col("day") <= F.col("until"))).drop("cell", "since", "until")
    if skipped is not None:
        met = met.unionByName(asks.join(skipped, ["g", "who", "r"]).withColumn("c", F.lit(-1).cast("long")).select(*met.columns))
    v = F.when(F.col("center").isNull(), F.col("x")).otherwise(F.abs(F.col("x") - F.col("center")))
    ask = F.col("day") * (1 << 24) + (F.col("what") + 1) * (1 << 16) + F.col("slot") + 1
    met = met.select("g", ask.alias("ask"), "day", "who", "n", "what", "low", "high", "weight", v.alias("v"), "c")
    # what is skipped comes first among equal values, so that it takes the first of them
    met = met.withColumn("upto", F.sum("c").over(W.partitionBy("g", "who", "ask").orderBy("v", "c").rowsBetween(W.unboundedPreceding, 0)))
    holds = lambda rank: (F.col("c") > 0) & (F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("c") < F.col(rank))
    hit = met.where(holds("low") | holds("high")).withColumns({"v0": F.when(holds("low"), F.col("v")), "v1": F.when(holds("high"), F.col("v"))})
    both = hit.groupBy("g", "day", "who", "what").agg(F.first("n").alias("n"), F.first("weight").alias("weight"), F.max("v0").alias("v0"), F.max("v1").alias("v1"))
    return both.select("g", "day", "who", "n", "what", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("weight")).alias("value"))


def order_statistics(entries: DataFrame, asked: DataFrame, shares: dict[int, tuple[float, ...]], with_mad: tuple[int, ...] = (), *, days: int, cuts: int = CUTS) -> DataFrame:
    """(g, day, who, n, what, value): per ask each share's quantile (linear between neighbours) as what = 0, 1, ..., the MAD as -1.

    entries (g, since, until, x): values of a group, visible for `days` days at
    most; null and NaN values are left out; with a column c they are counted and
    distinct. asked (g, day): distinct; or (g, day,
    who, skip), distinct with who, where skip lists visible values that the ask
    leaves out, once each. An ask without a visible value gets no row. shares: by
    measure, g % MEASURES. For a MAD the second share has to be 0.5; asks with
    values to skip have none.
    """
    own = "skip" in asked.columns
    wanted = written(asked if own else asked.withColumn("who", F.lit(0).cast("long")), "asked")
    counted = entries.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("since") <= F.col("until")))
    if "c" not in entries.columns:
        counted = counted.groupBy("g", "since", "until", "x").agg(F.count("*").alias("c"))
    counted = written(ranges(counted, cuts), "counted")
    steps = F.array(F.struct(F.col("since").alias("at"), F.col("c").alias("c")), F.struct((F.col("until") + 1).alias("at"), (-F.col("c")).alias("c")))
    events = counted.select("g", "r", "x", F.explode(steps).alias("e")).groupBy("g", F.col("e.at").alias("at"), "r").agg(F.sum("e.c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    by = lambda d: d.groupBy("g")
    skipped = None
    if own:
        places_of = counted.select("g", "x", "r").distinct()
        skipped = wanted.select("g", "who", F.explode("skip").alias("x")).join(places_of, ["g", "x"])
    found = written(fetched(by(wanted).cogroup(by(events)).applyInArrow(places(shares), ASK), counted, days, skipped), "quantiles")
    if with_mad:
        centers = found.where((F.col("g") % MEASURES).isin(*with_mad) & (F.col("what") == 1) & (F.col("who") == 0)).select("g", "day", "who", F.col("value").alias("center"))
        found = found.unionByName(written(fetched(by(centers).cogroup(by(events)).applyInArrow(distances, ASK), counted, days), "distances"))
    return found


def numbered(keys: DataFrame) -> DataFrame:
    """keys (distinct) with numbers in the column `id`, the same at every read."""
    return written(keys.withColumn("id", F.monotonically_increasing_id()), "numbered")
