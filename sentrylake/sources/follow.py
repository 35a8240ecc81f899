"""A streaming source that follows many growing text files, read by the tasks.

``spark.readStream.format("line_folder").option("path", "/logs/*.log")`` takes
every file that the pattern finds, now and later. The driver only looks at the
files' sizes; an offset has, for each file, how far it has been read. The new
bytes of a file are one task, or several where there are more than
``chunkBytes`` of them: a line belongs to the range in which its line feed lies,
and whoever reads a range looks back for the line's beginning, so no line is
lost or cut, however long it is, and one without its end yet waits.

A file is known by its number (inode) and a checksum of its first bytes, so one
that is renamed goes on where it was, if the pattern still finds it, and one
that is replaced or cut begins anew. What was not read of a file that is gone is
lost. With ``fromStart`` false, files that are there at the first start are
followed from their ends. Executors must see the files under the same paths.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_HEAD, _BLOCK = 256, 1 << 16
_SCHEMA = pa.schema([("value", pa.string()), ("path", pa.string()), ("offset", pa.int64())])


def _head(path: str, n: int) -> int:
    with open(path, "rb") as f:
        return zlib.crc32(f.read(n))


@dataclass
class Range(InputPartition):
    """Bytes of a file: the lines that end in them."""

    path: str
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(None)


def line_start(f, at: int) -> int:
    """Where the line begins that goes on at ``at``."""
    while at > 0:
        low = max(0, at - _BLOCK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


class FolderReader(DataSourceStreamReader):
    def __init__(self, pattern: str, from_start: bool, chunk: int) -> None:
        self.pattern, self.from_start, self.chunk = pattern, from_start, chunk

    def _look(self) -> dict:
        """Every file by number: path, size, how many first bytes were summed, and their sum."""
        found = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            try:
                s = os.stat(path)
                n = min(_HEAD, s.st_size)
                found[str(s.st_ino)] = [path, s.st_size, n, _head(path, n)]
            except FileNotFoundError:  # renamed since it was listed
                continue
        return found

    def initialOffset(self) -> dict:
        return {} if self.from_start else self._look()

    def latestOffset(self) -> dict:
        return self._look()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, now = [], None
        for number, (path, size, n, head) in end.items():
            try:
                here = str(os.stat(path).st_ino) == number
            except FileNotFoundError:
                here = False
            if not here:  # a batch that is tried again, and the file has been renamed in between
                now = self._look() if now is None else now
                if number not in now:
                    continue
                path = now[number][0]
            at = 0
            if number in start:
                _, before, n_before, head_before = start[number]
                same = size >= before and _head(path, n_before) == head_before
                at = before if same else 0
            out += [Range(path, a, min(a + self.chunk, size)) for a in range(at, size, self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lines, places, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lines), pa.array([partition.path] * len(lines)), pa.array(places, pa.int64())], schema=_SCHEMA)

        with open(partition.path, "rb") as f:
            at = line_start(f, partition.start)
            f.seek(at)
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line.endswith(b"\n"):
                    break  # its end lies in a later range
                lines.append(line[:-1].removesuffix(b"\r").decode("utf-8", "replace"))
                places.append(at)
                at, held = at + len(line), held + len(line)
                if held >= 1 << 22:
                    yield batch()
                    lines, places, held = [], [], 0
        if lines:
            yield batch()

    def commit(self, end: dict) -> None: ...

    def stop(self) -> None: ...


class FolderSource(DataSource):
    """Columns value, path and offset, the byte at which a line begins."""

    @classmethod
    def name(cls) -> str:
        return "line_folder"

    def schema(self) -> str:
        return "value string, path string, offset long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o = {k.lower(): v for k, v in self.options.items()}
        return FolderReader(o["path"], o.get("fromstart", "false").lower() == "true", int(o.get("chunkbytes", str(64 << 20))))
