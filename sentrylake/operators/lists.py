"""Named lists that are tables: membership is a join, so a list may be of any length.

A list of a few hundred values is written into the plan as it is. One with
millions (addresses of an intelligence feed, hashes of malware) would be carried
by every task and walked through for every row; as a table it is joined instead.
A list whose values are measured to be small is broadcast; any other is joined by
shuffle, its values copied to a fixed number of salts and the events dealt out
among them, so that a value that a third of the events have is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text

#: A list is broadcast if its values take at most so many bytes, each counted with 64 more for its place in a hash table.
BROADCAST_BYTES = 64 << 20
#: Among how many parts the events of one value are dealt out where a list is not broadcast.
SALTS = 32


@dataclass(frozen=True, eq=False)
class ListTable:
    """A list in files (text, a value a line, or Parquet with one column) or in a DataFrame of one column.

    Values are compared as ``in`` compares: as texts, without regard to case. Null values are left out, repeated ones
    count once, and an empty list has no members. Conditions ``in`` and ``nin`` take such a list; no other does.
    """

    name: str
    path: str | None = None
    rows: DataFrame | None = None

    def flag(self, field: str) -> str:
        """The name under which ``Fields`` gives whether a field's value is listed."""
        return f"{field} in $lists.{self.name}"

    def values(self, spark: SparkSession) -> DataFrame:
        """The distinct values: member."""
        rows = self.rows
        if rows is None:
            rows = spark.read.parquet(self.path) if self.path.rstrip("/").endswith(".parquet") else spark.read.text(self.path)
        at = F.col(f"`{rows.columns[0]}`")
        return rows.filter(at.isNotNull()).select(text(at).alias("member")).distinct()

    def __getstate__(self) -> dict:
        return {"name": self.name, "path": self.path, "rows": None}  # rules travel to tasks, tables do not

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)


def small(members: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values, counted, fit a broadcast."""
    return (members.agg(F.sum(F.octet_length("member") + 64)).first()[0] or 0) <= limit


def mark(events: DataFrame, wanted: Iterable[tuple[str, Column, ListTable]], by: tuple[str, ...] = ("ts_us", "seq"), limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """``events`` with a Boolean column, never null, for every (name, value, list) of ``wanted``; batches and streams alike.

    ``by`` names columns that differ from event to event and deal the events of one value out.
    """
    known: dict[int, tuple[DataFrame, bool]] = {}
    for name, value, table in wanted:
        if id(table) not in known:
            members = table.values(events.sparkSession)
            known[id(table)] = members, small(members, limit)
        members, light = known[id(table)]
        members = members.withColumn(name, F.lit(True))
        events = events.withColumn("__key", text(value))
        if light:
            joined = events.join(F.broadcast(members), events["__key"] == members["member"], "left")
        else:
            members = members.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            events = events.withColumn("__part", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
            joined = events.join(members, (events["__key"] == members["member"]) & (events["__part"] == members["__salt"]), "left").drop("__part", "__salt")
        events = joined.drop("__key", "member").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return events
