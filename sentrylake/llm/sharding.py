"""Size-tiered sharding of a growing table.

Arrivals are appended as runs: folders of small Parquet shards that never
change. A run's tier is the order of magnitude, to base ``fan_in``, of its mean
shard size. When a tier below the target holds ``fan_in`` runs, the oldest of
them are merged into one run of target-sized shards. Merging reads whole shards
and writes them side by side (``coalesce``), so it neither shuffles nor sorts.

The table is what the newest manifest lists. A manifest is a JSON file whose
name is its version; it is written aside and renamed to its name, which fails
if another writer took the version first, so that a commit happens wholly or
not at all, and the loser tries again on the newer version. That holds where
the file system renames without overwriting in one step, as HDFS does; local
disks and object stores look first and rename then, so there one writer at a
time must commit. Files that no manifest lists, such as those of a lost job,
are never read, and ``clean`` removes them once they are old.

An empty arrival adds no run, and a store of nothing else reads as an empty
table; all columns, whatever their names, and nulls are kept as they come, texts
may be as long as Parquet holds, repeated rows are kept too. All arrivals of a store share its schema; a
different one is refused.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import hadoop_path, remove

TARGET_BYTES = 128 << 20
FAN_IN = 4
_BASE_BYTES = 1 << 20
#: Groups of runs that one job merges side by side, and jobs at a time.
_GROUPS, _JOBS = 64, 4


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int
    order: int  # of arrival, the lowest of what was merged

    def tier(self, fan_in: int) -> int:
        mean = self.bytes / max(1, self.files)
        return max(0, math.floor(math.log(max(mean, 1) / _BASE_BYTES, fan_in)))


class ShardStore:
    """A table kept as runs of shards under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in

    # manifests

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; version 0 is the empty table."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        fs, p = hadoop_path(self.spark, f"{self.root}/manifests/v{version:010d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return found | {"runs": [Run(**r) for r in found["runs"]]}

    def commit(self, base: int, schema: str, runs: list[Run]) -> bool:
        """Makes ``runs`` version base + 1; False if that version exists already."""
        text = json.dumps({"version": base + 1, "schema": schema, "runs": [asdict(r) for r in runs]})
        aside, name = f"{self.root}/manifests/.{uuid.uuid4().hex}", f"{self.root}/manifests/v{base + 1:010d}.json"
        fs, p = hadoop_path(self.spark, aside)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(p), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(name)), none)
        except Exception as e:  # Py4J wraps it
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _change(self, schema: str, change) -> dict:
        while True:
            now = self.manifest()
            if now["schema"] not in (None, schema):
                raise ValueError("the arrival's schema is not the store's")
            if self.commit(now["version"], schema, change(now["runs"])):
                return self.manifest()

    def _measured(self, path: str, order: int) -> Run:
        fs, p = hadoop_path(self.spark, path)
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        return Run(path, sum(sizes), len(sizes), order)

    # data

    def append(self, arrivals: DataFrame, number: Column | None = None) -> dict:
        """Appends one run, or one for each value of ``number`` (from 0), in one job and one commit."""
        if number is None:
            number = F.lit(0)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        name = f"arrival_{uuid.uuid4().hex}"  # the name of no column
        arrivals.withColumn(name, number).write.partitionBy(name).parquet(folder)
        fs, p = hadoop_path(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        names.sort(key=lambda n: int(n.split("=")[1]))

        def add(runs: list[Run]) -> list[Run]:
            first = max((r.order for r in runs), default=-1) + 1
            return runs + [self._measured(f"{folder}/{n}", first + i) for i, n in enumerate(names)]

        return self._change(arrivals.schema.json(), add)

    def due(self, runs: list[Run]) -> list[list[Run]]:
        """Groups of ``fan_in`` runs to merge: of each tier below the target size the oldest, as often as it is full."""
        tiers: dict[int, list[Run]] = {}
        for r in sorted(runs, key=lambda r: r.order):
            if r.bytes < r.files * self.target_bytes / 2 or r.files == 0:
                tiers.setdefault(r.tier(self.fan_in), []).append(r)
        full = [(rs, i) for _, rs in sorted(tiers.items()) for i in range(0, len(rs) - self.fan_in + 1, self.fan_in)]
        return [rs[i : i + self.fan_in] for rs, i in full]

    def _merge(self, groups: list[list[Run]], schema: str) -> list[Run]:
        """Each group as one run of target-sized shards; one job, with tasks of its own for every group."""
        folder, name = f"{self.root}/data/{uuid.uuid4().hex}", f"group_{uuid.uuid4().hex}"
        parts = [
            self._read(g, schema).coalesce(max(1, -(-sum(r.bytes for r in g) // self.target_bytes))).withColumn(name, F.lit(i)) for i, g in enumerate(groups)
        ]
        reduce(DataFrame.unionAll, parts).write.partitionBy(name).parquet(folder)
        fs, p = hadoop_path(self.spark, folder)
        held = {s.getPath().getName() for s in fs.listStatus(p)}
        paths = [f"{folder}/{name}={i}" for i in range(len(groups))]
        return [self._measured(x, g[0].order) for x, g in zip(paths, groups, strict=True) if x.rsplit("/", 1)[1] in held]

    def compact(self, vacuum: bool = True) -> dict:
        """Merges until no tier is full. All groups that are due are merged side by side and committed together."""
        now = self.manifest()
        while groups := self.due(now["runs"]):
            batches = [groups[i : i + _GROUPS] for i in range(0, len(groups), _GROUPS)]
            with ThreadPoolExecutor(_JOBS) as pool:
                merged = [r for rs in pool.map(lambda b, s=now["schema"]: self._merge(b, s), batches) for r in rs]
            gone = {r for g in groups for r in g}

            def swap(runs: list[Run], merged: list[Run] = merged, gone: set[Run] = gone) -> list[Run]:
                if not gone <= set(runs):
                    return runs  # another compaction was faster
                return [r for r in runs if r not in gone] + merged

            now = self._change(now["schema"], swap)
            if vacuum:
                kept = {r.path for r in now["runs"]}
                remove(self.spark, *[r.path for r in gone if r.path not in kept])
        return now

    def clean(self, older_than_ms: int = 24 * 3_600_000) -> list[str]:
        """Removes data folders that no manifest lists and that are older than any job may run; returns them."""
        fs, p = hadoop_path(self.spark, f"{self.root}/data")
        listed = {r.path.split("/data/")[1].split("/")[0] for v in self.versions() for r in self.manifest(v)["runs"]}
        now, old = self.spark._jvm.java.lang.System.currentTimeMillis(), []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in listed and now - s.getModificationTime() > older_than_ms:
                old.append(f"{self.root}/data/{s.getPath().getName()}")
        remove(self.spark, *old)
        return old

    def _read(self, runs: list[Run], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[r.path for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; those of older versions may be gone once a compaction has vacuumed."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("nothing was ever appended to the store")
        if not found["runs"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"])))
        return self._read(found["runs"], found["schema"])


def by_range(df: DataFrame, column: str, arrivals: int) -> Column:
    """Cuts a table into arrivals along the range of an integer column; null belongs to the first."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return F.lit(0)
    return F.coalesce(F.floor((F.col(column) - F.lit(lo)) * F.lit(arrivals) / F.lit(hi - lo + 1)).cast("int"), F.lit(0))
