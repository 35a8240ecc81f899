"""What collectors deliver again, taken once: cursors by source in keyed state, and keys seen lately.

Collectors of numbered records (event channels) go on from a bookmark of their
own and may deliver records again after a restart, or out of order. The state of
a (host, channel) is the ranges of numbers that have come, so channels whose
numbers overlap have nothing to do with each other, a record that comes late is
not lost and one that comes again is not repeated. Numbers without gaps are one
range, however many there are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship


class Ranges:
    """Disjoint closed ranges of numbers, in order."""

    def __init__(self, ranges: Sequence[Sequence[int]] = ()) -> None:
        self.low, self.high = [r[0] for r in ranges], [r[1] for r in ranges]

    def add(self, n: int) -> bool:
        """Whether the number is new."""
        i = bisect_right(self.low, n)
        if i and n <= self.high[i - 1]:
            return False
        before, after = i > 0 and self.high[i - 1] == n - 1, i < len(self.low) and self.low[i] == n + 1
        if before and after:
            self.high[i - 1] = self.high.pop(i)
            self.low.pop(i)
        elif before:
            self.high[i - 1] = n
        elif after:
            self.low[i] = n
        else:
            self.low.insert(i, n)
            self.high.insert(i, n)
        return True

    def __contains__(self, n: int) -> bool:
        i = bisect_right(self.low, n)
        return i > 0 and n <= self.high[i - 1]

    def __len__(self) -> int:
        return sum(h - x + 1 for x, h in zip(self.low, self.high, strict=True))

    def all(self) -> list[tuple[int, int]]:
        return list(zip(self.low, self.high, strict=True))


class Cursor(StatefulProcessor):
    """The records of one (host, channel) whose numbers are new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ranges array<struct<low:long,high:long>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ranges = Ranges([tuple(r) for r in self.seen.get()[0]] if self.seen.exists() else ())
        for b in rows:
            yield b[np.array([ranges.add(int(n)) for n in b["record_id"]], dtype=bool)]
        self.seen.update((ranges.all(),))


def new_records(rows: DataFrame) -> DataFrame:
    """Streaming ``live.event_rows``, each record of a host and channel once. Rows without a number are left out, as bookmarks leave them out."""
    ship(rows.sparkSession)
    numbered = rows.filter("record_id IS NOT NULL").withColumn("host", F.coalesce("host", F.lit(""))).withColumn("channel", F.coalesce("channel", F.lit("")))
    return numbered.groupBy("host", "channel").transformWithStateInPandas(Cursor(), numbered.schema, outputMode="Append", timeMode="None")


def lately_new(rows: DataFrame, keys: Sequence[str], keep: str = "1 day") -> DataFrame:
    """Streaming rows whose keys have not come within ``keep`` before, by time of arrival; older keys leave the state."""
    came = rows.withColumn("__came", F.current_timestamp()).withWatermark("__came", keep)
    return came.dropDuplicatesWithinWatermark(list(keys)).drop("__came")
