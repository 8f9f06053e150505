"""Trailing 90-day support of a stream with bounded state: days and counts per key, dropped by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAYS, DAY_MS = 90, 86_400_000


class TrailingSupport(StatefulProcessor):
    """A day's rows are told when the watermark has passed the day: then all days before it are complete.

    The state of a key is a map from day to rows. A day leaves it when the
    watermark is 90 days past it; a key without rows of its last 90 days has none.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for day, n in frame["day"].value_counts().items():
                known = self.days.getValue((int(day),))[0] if self.days.containsKey((int(day),)) else 0
                self.days.updateValue((int(day),), (known + int(n),))
                self.handle.registerTimer((int(day) + 1) * DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        held = {int(d[0]): int(n[0]) for d, n in self.days.iterator()}
        for old in held:
            if old <= day - DAYS:
                self.days.removeKey((old,))
        if day in held:
            self.handle.registerTimer((day + DAYS + 1) * DAY_MS)  # when this day may go
            yield pd.DataFrame({"key": [key[0]], "day": [day], "n": [held[day]], "support": [sum(n for d, n in held.items() if day - DAYS <= d < day)]})


def trailing_support(lines: DataFrame, key: str, day: str, late: str = "2 days") -> DataFrame:
    """(key, day, n, support): a key's rows of a day and of the 90 days before, as the batch window counts them.

    Rows may be late by `late`; later ones are left out, and their day is not
    told again. Needs the RocksDB state store.
    """
    d = lines.select(F.col(key).cast("string").alias("key"), F.col(day).cast("timestamp").alias("at"), F.unix_date(F.col(day).cast("date")).cast("long").alias("day"))
    return d.withWatermark("at", late).groupBy("key").transformWithStateInPandas(TrailingSupport(), "key string, day long, n long, support long", "Append", "EventTime")
