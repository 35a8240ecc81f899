"""Where receivers land what agents and devices send, and how it is read once.

The contract: a post is the records that an agent sends at once. A receiver
writes it as one file of JSON lines, aside under a name that readers skip, and
renames it when it is whole, so that a reader never sees half a post. A record
says which agent it is from (``source_machine``, and ``run``, which an agent
changes when it begins to count again), which post it is in (``post``, counted
by the agent), its place there (``place`` from 0) and how many there are
(``size``). An agent that gets no answer sends the same post again, perhaps to
another receiver: ``once`` takes every record once, whichever copies come,
however they are split over files and batches. Syslog receivers land lines the
same way, with the receiver as the machine.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from hashlib import sha256
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from ..streaming.cursors import Ranges

SCHEMA = "source_machine string, run string, post long, place long, size long, _log_type string, raw string"
_RANGES = "ranges array<struct<low:long,high:long>>"


def put(folder: str, machine: str, post: int, records: Iterable[dict], run: str = "") -> bool:
    """Lands a post from a receiver's own process; false if this folder has it already.

    The folder is one that the receiver can reach as files (a disk, a mount); linking the finished file under its
    name fails if the name is taken, so of two receivers with the same post one wins and nothing is overwritten.
    """
    records = list(records)
    name = sha256(json.dumps([machine, run, post]).encode()).hexdigest()[:32]
    aside = Path(folder) / "_aside" / uuid.uuid4().hex
    aside.parent.mkdir(parents=True, exist_ok=True)
    with aside.open("w", encoding="utf-8") as f:
        for i, r in enumerate(records):
            f.write(json.dumps({**r, "source_machine": machine, "run": run, "post": post, "place": i, "size": len(records)}) + "\n")
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(aside, Path(folder) / f"post-{name}.jsonl")
        return True
    except FileExistsError:
        return False
    finally:
        aside.unlink()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the records that land in a folder."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.json*").json(folder)


class Posts(StatefulProcessor):
    """The records of one agent that have not come before: which posts are complete, as ranges, and the places of those that are not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", _RANGES)
        self.open = handle.getMapState("open", "post long", _RANGES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = Ranges([tuple(r) for r in self.done.get()[0]] if self.done.exists() else ())
        parts: dict[int, Ranges] = {}
        ended: set[int] = set()
        for b in rows:
            new = []
            for post, place, size in zip(b["post"].tolist(), b["place"].tolist(), b["size"].tolist(), strict=True):
                if post in done:
                    new.append(False)
                    continue
                if post not in parts:
                    kept = self.open.getValue((post,)) if self.open.containsKey((post,)) else None
                    parts[post] = Ranges([tuple(r) for r in kept[0]] if kept else ())
                new.append(parts[post].add(place))
                if len(parts[post]) >= size:
                    done.add(post)
                    ended.add(post)
            yield b[np.array(new, dtype=bool)]
        for post, part in parts.items():
            if post not in ended:
                self.open.updateValue((post,), (part.all(),))
            elif self.open.containsKey((post,)):
                self.open.removeKey((post,))
        self.done.update((done.all(),))


def once(rows: DataFrame) -> DataFrame:
    """Streaming records of posts, each once. Those that no post, place or size numbers cannot be told apart and are taken as they come."""
    ship(rows.sparkSession)
    rows = rows.withColumn("source_machine", F.coalesce("source_machine", F.lit("unknown"))).withColumn("run", F.coalesce("run", F.lit("")))
    numbered = F.col("post").isNotNull() & F.col("place").isNotNull() & F.col("size").isNotNull()
    # names that begin with an underscore do not reach a stateful task
    names = {c: c.replace("_", "u_", 1) if c.startswith("_") else c for c in rows.columns}
    plain = rows.filter(numbered).withColumnsRenamed(names)
    kept = plain.groupBy("source_machine", "run").transformWithStateInPandas(Posts(), plain.schema, outputMode="Append", timeMode="None")
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).unionByName(rows.filter(~numbered))
