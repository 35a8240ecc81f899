"""The threat checks over a stream: trailing counts in keyed state, whatever the clocks of the sources say.

A row that a windowed check concerns belongs to a key of check, source and time
bucket, a bucket being as long as the window; it also goes to the next bucket,
whose rows look back on it. So all that counts together meets in one key, a busy
source is the work of many keys, and a row whose clock runs ahead or behind is in
a bucket of its own time and disturbs nothing. State is kept for ``keep`` after
a row came, by a watermark on the time of arrival and not on any clock in the
data; rows of one window must arrive within it.

Rows are judged as they come: there is no waiting for a watermark. A row that
comes late raises the counts of rows after it in time; those that reach a limit
by it, or had reached it, come again with a higher ``revision``, which is the
count. ``latest`` keeps each row's last revision, and that is what the batch
gives for the same rows.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.heuristics import BRUTE_COUNT, BRUTE_WINDOW, SCAN_PORTS, SCAN_WINDOW, concerned, judged
from ..session import ship

_LIMITS = {"fails": (BRUTE_WINDOW * 1_000_000, BRUTE_COUNT), "ports": (SCAN_WINDOW * 1_000_000, SCAN_PORTS)}
_COUNTED = "check string, ts_us long, seq string, row string, n long"
Row = tuple[int, str, int, bool, str]  # time, arrival, port, own, what it was


def trailing(rows: list[Row], span: int, distinct: bool) -> Iterator[tuple[Row, int]]:
    """Own rows in order, each with the number of rows, or of their values, less than ``span`` before it, itself included."""
    held: deque[Row] = deque()
    counts: Counter[int] = Counter()
    for row in rows:
        held.append(row)
        counts[row[2]] += 1
        while held[0][0] <= row[0] - span:
            old = held.popleft()[2]
            counts[old] -= 1
            if not counts[old]:
                del counts[old]
        if row[3]:
            yield row, len(counts) if distinct else len(held)


class TrailingCounts(StatefulProcessor):
    """The counts of a (check, source, bucket): of new rows, and of rows that new ones raise to the limit or beyond."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ts long, seq string, value long, own boolean, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        check = key[0]
        span, limit = _LIMITS[check]
        old = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        came = [r for b in rows for r in b.itertuples(index=False)]
        new = [(int(r.ts_us), r.seq, int(r.value), bool(r.own), r.row) for r in came]
        self.rows.appendList(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(max(r.arrived.timestamp() for r in came) * 1000) + self.keep)
        place = lambda r: (r[0], r[1])
        before = {place(r): n for r, n in trailing(sorted(old, key=place), span, check == "ports")}
        out = []
        for row, n in trailing(sorted(old + new, key=place), span, check == "ports"):
            was = before.get(place(row))
            if was is None or n != was and n >= limit:
                out.append((check, row[0], row[1], row[4], n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _COUNTED.split(", ")])


    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())


def threat_stream(rows: DataFrame, keep_seconds: int = 3600) -> DataFrame:
    """Threats of streaming normalized rows with ``ts_us`` and ``seq`` (a number or text that orders rows of one instant and
    tells rows apart): the columns of ``heuristics.threats``, seq and revision."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["seq"]
    rows = rows.withColumn("seq", F.col("seq") if kind == "string" else F.lpad(F.col("seq").cast("string"), 20, "0"))
    plain = [f for f in rows.schema if f.name not in ("ts_us", "seq")]
    src, failed, scanned = concerned()
    check = F.when(failed, "fails").when(scanned, "ports")
    bucket = F.floor(F.col("ts_us") / F.when(failed, _LIMITS["fails"][0]).otherwise(_LIMITS["ports"][0])).cast("long")
    value = F.when(scanned, F.col("destination_port").cast("long")).otherwise(0)
    row = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in plain]))
    known = rows.select(check.alias("check"), src.alias("source"), bucket.alias("bucket"), "ts_us", "seq", value.alias("value"), row.alias("row")).filter("check IS NOT NULL")
    copies = F.explode(F.array(*[F.struct((F.col("bucket") + i).alias("bucket"), F.lit(i == 0).alias("own")) for i in (0, 1)]))
    known = known.withColumn("at", copies).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 minute")
    known = known.select("check", "source", F.col("at.bucket").alias("bucket"), "ts_us", "seq", "value", F.col("at.own").alias("own"), "row", "arrived")
    counted = known.groupBy("check", "source", "bucket").transformWithStateInPandas(TrailingCounts(keep_seconds * 1000), _COUNTED, outputMode="Append", timeMode="EventTime")
    counted = counted.withColumn("was", F.from_json("row", StructType.fromJson(json.loads(StructType(plain).json()))))
    n = lambda c: F.when(F.col("check") == c, F.col("n"))
    counted = counted.select("was.*", "ts_us", "seq", n("fails").alias("__fails"), n("ports").alias("__ports"), F.col("n").alias("revision"))
    none = F.lit(None).cast("long")
    others = rows.filter(~failed & ~scanned).select(*[F.col(f"`{f.name}`") for f in plain], "ts_us", "seq", none.alias("__fails"), none.alias("__ports"), F.lit(0).cast("long").alias("revision"))
    return judged(counted.unionByName(others), ("seq", "revision"))


def latest(threats: DataFrame) -> DataFrame:
    """The last revision of each row's threat, in batch."""
    newest = Window.partitionBy("seq", "timestamp", "source").orderBy(F.desc("revision"))
    return threats.withColumn("__k", F.row_number().over(newest)).filter("__k = 1").drop("__k")
