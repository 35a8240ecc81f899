"""From raw lines to the normalized log and its threats, in batch and as a stream.

A source is a DataFrame of raw lines (``value``) under the log type whose parser
reads it, or under ``syslog`` for lines of unknown origin. All sources become
one table of the normalized schema, which is written as JSON lines; the threat
checks run over it in event time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timestamps import parse_micros
from ..operators.heuristics import threats
from ..operators.normalize import SCHEMA, normalize
from ..sources.parsers import parse, parse_syslog
from ..streaming.detector import STORE
from ..streaming.sinks import counted, fleet
from ..streaming.threats import threat_stream

#: The name of the query that counts machines.
FLEET = "fleet"


def normalized(sources: dict[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """The rows of all sources in the normalized schema; lines that no parser reads are left out."""
    read = [parse_syslog(lines.select("value")) if kind == "syslog" else parse(lines.select("value"), kind) for kind, lines in sources.items()]
    return reduce(DataFrame.unionByName, [normalize(r, as_of) for r in read])


def write_normalized(rows: DataFrame, path: str, append: bool = False) -> int:
    """Writes JSON lines and returns how many."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["rows"]


def timed(rows: DataFrame, as_of: Column) -> DataFrame:
    """Normalized rows with ``ts_us`` and ``seq``, the order of rows of one instant; rows without a readable time are left out."""
    rows = rows.withColumn("ts_us", parse_micros(F.col("timestamp"), as_of)).withColumn("seq", F.monotonically_increasing_id())
    return rows.filter("ts_us IS NOT NULL")


@dataclass(frozen=True)
class Captured:
    rows: int
    log: DataFrame
    threats: DataFrame


def run(spark: SparkSession, sources: dict[str, DataFrame], out: str, as_of: Column | None = None) -> Captured:
    """Lines that are there: the log under ``out/log``, its threats under ``out/threats``."""
    n = write_normalized(normalized(sources, as_of), f"{out}/log")
    log = spark.read.schema(SCHEMA).json(f"{out}/log")
    found = threats(timed(log, as_of if as_of is not None else F.current_timestamp()))
    found.write.mode("overwrite").json(f"{out}/threats")
    return Captured(n, log, spark.read.schema(found.schema).json(f"{out}/threats"))


@dataclass(frozen=True)
class Following:
    """The queries of a capture that goes on: raw lines to the log, the log to its threats, and the machines in it."""

    log: StreamingQuery
    threats: StreamingQuery
    machines: StreamingQuery

    def awaitTermination(self) -> None:
        for q in (self.log, self.threats, self.machines):
            q.awaitTermination()

    def stop(self) -> None:
        for q in (self.log, self.threats, self.machines):
            q.stop()


def follow(sources: dict[str, DataFrame], out: str, checkpoint: str, as_of: Column | None = None, available_now: bool = False, keep_seconds: int = 3600) -> Following:
    """Streams of lines: the log grows under ``out/log`` and its threats under ``out/threats`` (``streaming.threats``).

    Each query goes on from its own checkpoint; what the log's query has committed is what the other two read.
    ``available_now`` takes what is there and ends.
    """
    spark = next(iter(sources.values())).sparkSession
    for k, v in STORE.items():
        spark.conf.set(k, v)
    once = lambda w: (w.trigger(availableNow=True) if available_now else w).start()
    write = lambda rows, name: rows.writeStream.format("json").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}")
    made = once(write(counted(normalized(sources, as_of)), "log"))
    if available_now:
        made.awaitTermination()
    else:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/log")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    lines = spark.readStream.schema(SCHEMA).json(f"{out}/log").withColumn("place", F.format_string("%020d %s", F.unix_micros("_metadata.file_modification_time"), "_metadata.file_name"))
    now = as_of if as_of is not None else F.current_timestamp()
    rows = lines.withColumn("ts_us", parse_micros(F.col("timestamp"), now)).filter("ts_us IS NOT NULL")
    # a stream cannot number rows: those of one file and instant go by their text, and equal ones are told apart
    rows = rows.withColumn("seq", F.concat_ws(" ", "place", F.hex(F.xxhash64("raw")), F.expr("uuid()"))).drop("place")
    found = once(write(threat_stream(rows, keep_seconds), "threats"))
    # the machines are the keys of this query's state; ``sinks.Fleet`` reports how many there are
    known = fleet(lines).writeStream.queryName(FLEET).format("noop").outputMode("update").option("checkpointLocation", f"{checkpoint}/machines")
    return Following(made, found, once(known))
