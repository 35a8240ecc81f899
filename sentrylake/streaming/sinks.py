"""Sinks of alert streams, and streams put together."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Handler(Protocol):
    def handle(self, alert: dict) -> None: ...


def multiplex(streams: Iterable[DataFrame]) -> DataFrame:
    """Several streams as one; columns that one of them lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def to_json(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends alerts as JSON lines."""
    writer = alerts.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_handlers(alerts: DataFrame, handlers: Iterable[Handler], checkpoint: str, available_now: bool = False, on_driver: bool = True) -> StreamingQuery:
    """Hands every alert to each handler, batch by batch and streamed, so a batch is never held whole.

    With ``on_driver`` false, handlers are sent to the tasks and called there; what they keep in themselves is then
    lost, and an alert can come twice when a task is tried again.
    """
    handlers = list(handlers)

    def handle(row) -> None:
        for h in handlers:
            h.handle(row.asDict(recursive=True))

    writer = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if on_driver:
        writer = writer.foreachBatch(lambda batch, _: [None for row in batch.toLocalIterator() if handle(row)])
    else:
        writer = writer.foreach(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counted(rows: DataFrame, name: str = "live") -> DataFrame:
    """``rows`` with running counters observed: rows, grave ones, and a sketch of the machines."""
    return rows.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("grave"),
        F.hll_sketch_agg("hostname").alias("machines"),
    )


def fleet(rows: DataFrame) -> DataFrame:
    """Rows and grave ones of every machine, exactly: hostname, rows, grave. On a stream a machine is a key of state that
    is never dropped, and rows are added up before they are shuffled, so a busy machine is no hot key."""
    named = rows.filter(F.coalesce("hostname", F.lit("")) != "")
    return named.groupBy("hostname").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("severity").isin("high", "critical"), F.lit(False))).alias("grave"))


class _Sums(StreamingQueryListener):
    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Status(_Sums):
    """Adds up what ``counted`` observes in each batch."""

    def __init__(self, name: str = "live") -> None:
        self.name, self.rows, self.grave, self.sketches = name, 0, 0, []

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.rows += seen["rows"]
            self.grave += seen["grave"]
            if seen["rows"]:
                self.sketches.append(bytes(seen["machines"]))

    def machines(self, spark: SparkSession) -> int:
        """About how many distinct machines there were in the whole run."""
        if not self.sketches:
            return 0
        union = spark.createDataFrame([(bytearray(s),) for s in self.sketches], "s binary").agg(F.hll_union_agg("s").alias("s"))
        self.sketches = [bytes(union.first()[0])]
        return union.select(F.hll_sketch_estimate("s")).first()[0]


class Fleet(_Sums):
    """How many machines the stream of ``fleet`` whose query has this name knows: the keys of its state, so the number is
    exact and goes on after a restart."""

    def __init__(self, name: str = "fleet") -> None:
        self.name, self.machines = name, 0

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.stateOperators:
            self.machines = event.progress.stateOperators[0].numRowsTotal


class Detections(_Sums):
    """Adds up what ``detect_stream`` observes: skipped group fields, alerts emitted, alerts suppressed."""

    def __init__(self, name: str = "detections") -> None:
        self.name, self.skipped, self.emitted, self.suppressed = name, 0, 0, 0

    def onQueryProgress(self, event) -> None:
        hits, made = (event.progress.observedMetrics.get(n) for n in (f"{self.name}-hits", self.name))
        self.skipped += (hits["skipped"] or 0) if hits is not None else 0
        if made is not None:
            self.emitted += made["emitted"]
            self.suppressed += made["suppressed"]
