"""Running totals in a total order over all rows: ranks, numbers and merges without a task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import small, written


def carried(rows: DataFrame, order: list[Column], weight: Column, name: str, only: Column | None = None, by: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """rows with, in the column `name`, the sum of `weight` over all rows that come before in `order` (a total order).

    Rows are range-partitioned and sorted; a partition sums its own, and the
    partitions' sums are carried on (a row for each partition on the driver).
    rows is read twice. only: the rows to return; the others are counted, and no
    more of them is written than the first ones of each group of `by`. without:
    columns that are only sorted by; they are neither written nor returned.
    """
    some = only is not None
    kept = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    sorted_rows = rows.withColumns({"__weight": weight.cast("long"), "__keep": kept}).repartitionByRange(*order).sortWithinPartitions(*order)
    told = [k for k, c in enumerate(sorted_rows.columns) if c not in without]
    schema = StructType([*[StructField(f.name, f.dataType) for f in sorted_rows.schema.fields if f.name not in without], StructField("__part", LongType()), StructField("__before", LongType())])
    at, keep, *groups = [sorted_rows.columns.index(c) for c in ("__weight", "__keep", *by)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, kinds = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(at).to_numpy()
            upto = before + np.cumsum(own)
            out = pa.RecordBatch.from_arrays([*[b.column(k) for k in told], pa.array(np.full(len(own), part)), pa.array(upto - own)], schema.names)
            before, kinds = int(upto[-1]), out.schema
            if some:
                wanted = b.column(keep).to_numpy(zero_copy_only=False).copy()
                wanted[0] = True
                for k in groups:  # also where a group begins
                    c, none = b.column(k), b.column(k).is_null().to_numpy(zero_copy_only=False)
                    wanted[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
                out = out.filter(pa.array(wanted))
            yield out
        if kinds is not None:  # the partition's sum, as a row that nothing else marks as its own
            last = {"__weight": before, "__part": part}
            yield pa.RecordBatch.from_arrays([pa.array([last.get(f.name)], f.type) for f in kinds], schema=kinds)

    held = written(sorted_rows.mapInArrow(run, schema), "carried")
    offsets, total = [], 0
    for r in sorted(held.where("__before IS NULL").select("__part", "__weight").collect()):
        offsets.append((r["__part"], total))
        total += r["__weight"]
    known = held.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    return held.where("__before IS NOT NULL").join(F.broadcast(known), "__part").withColumn(name, F.col("__before") + F.col("__offset")).drop("__part", "__before", "__offset", "__weight", "__keep")


def since_start(rows: DataFrame, before: str, *by: str) -> DataFrame:
    """rows whose `before` counts from the start of the row's group, where the groups lead the order.

    The groups are counted first, so that rows are not shuffled by group where there are few.
    """
    if not by:
        return rows
    first = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(before).alias("__first"))
    first = small(first)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(first, same).withColumn(before, F.col(before) - F.col("__first")).drop("__first", *[f"__{c}" for c in by])


def ranked(rows: DataFrame, score: str, ties: list[str], name: str, by: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """Ranks 1, 2, 3, ... per group by score, highest first, null scores last; ties are settled by the named columns. without: see carried()."""
    order = [*map(F.asc, by), F.desc_nulls_last(score), *map(F.asc, ties)]
    found = since_start(carried(rows, order, F.lit(1), name, without=without), name, *by)
    return found.withColumn(name, F.col(name) + 1)


def ahead(held: DataFrame, asked: DataFrame, score: str, ties: list[str], by: tuple[str, ...] = (), name: str = "ahead") -> DataFrame:
    """asked with the number of held rows of its group that stand strictly before it by (score descending, ties).

    Both have the columns by, score and ties. An equal key does not stand before;
    a null score stands behind all others, a null asked score before all.
    """
    keys = [*by, score, *ties]
    payload = [c for c in asked.columns if c not in keys]
    both = held.select(*keys, F.lit(1).alias("__real"), *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in payload])
    both = both.unionByName(asked.select(*keys, F.lit(0).alias("__real"), *payload))
    last = F.col("__real") == 1
    order = [*map(F.asc, by), F.asc(F.when(F.col(score).isNull(), F.when(last, 2).otherwise(0)).otherwise(1)), F.desc(score), *map(F.asc, ties), F.asc("__real")]
    return since_start(carried(both, order, F.col("__real"), name, F.col("__real") == 0, by), name, *by).where("__real = 0").drop("__real")
