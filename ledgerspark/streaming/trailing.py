"""Streaming forms: daily counts, watermarked deduplication and trailing 90-day support per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAYS = 90


def tumbling_counts(events: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """Counts per key and day; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("d"), key, "n")


def first_of_key(events: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Idempotent intake: of rows with one key within the watermark the first stays."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def trailing_support(lines: DataFrame, key: str, day: str) -> DataFrame:
    """For each row the number of rows of its key in [day - 90, day) so far; state is days and counts, 90 of them.

    Days must not go back by more than a batch; a row counts for later days only, as in the batch window.
    """

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("day", kind="stable")
        out = []
        for d, group in rows.groupby("day", sort=True):
            out.append(group.assign(support=sum(n for x, n in kept.items() if d - DAYS <= x < d)))
            kept[d] = kept.get(d, 0) + len(group)
        newest = max(kept)
        kept = {x: n for x, n in kept.items() if x >= newest - DAYS}
        state.update((list(kept), list(kept.values())))
        yield pd.concat(out)[["key", "day", "support"]]

    d = lines.select(F.col(key).cast("string").alias("key"), F.unix_date(day).cast("long").alias("day"))
    return d.groupBy("key").applyInPandasWithState(step, "key string, day long, support long", "days array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it gave."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
