"""A streaming source that follows one growing text file.

It starts at the end of the file (or at its start, on request), hands out whole
lines only, waits for a file that is not there yet, and starts anew when the
file is replaced or cut. A batch takes about ``maxBytes``, and a longer line
whole. An offset is the file's number and a byte position, so a restarted query
goes on where its checkpoint says. One file is read by one reader, the driver;
for more than it can carry let agents land files in a folder and read that with
``spark.readStream.text``, as the tasks then do the reading.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, from_start: bool, max_bytes: int) -> None:
        self.path, self.from_start, self.max_bytes = path, from_start, max_bytes

    def _stat(self) -> tuple[int, int]:
        try:
            s = os.stat(self.path)
        except FileNotFoundError:
            return 0, 0
        return s.st_ino, s.st_size

    def initialOffset(self) -> dict:
        inode, size = self._stat()
        return {"inode": inode, "byte": 0 if self.from_start else size}

    def _read(self, start: int, size: int, limit: int) -> tuple[list[tuple[str, int]], int]:
        """Whole lines from ``start`` on, and where they end: as many as ``limit`` bytes hold, one at least, however long it is."""
        out, at = [], start
        with open(self.path, "rb") as f:
            f.seek(start)
            while at < size and (not out or at - start < limit):
                line = f.readline(size - at)
                if not line.endswith(b"\n"):
                    break
                out.append((line[:-1].removesuffix(b"\r").decode("utf-8", "replace"), at))
                at += len(line)
        return out, at

    def _from(self, start: dict, inode: int, size: int) -> int:
        """Where to go on: at the start of a file that is another one or has been cut."""
        return start["byte"] if inode == start["inode"] and size >= start["byte"] else 0

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        inode, size = self._stat()
        if not size:
            return iter([]), {"inode": inode, "byte": 0}
        rows, end = self._read(self._from(start, inode, size), size, self.max_bytes)
        return iter(rows), {"inode": inode, "byte": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = self._from(start, end["inode"], end["byte"])
        return iter(self._read(at, end["byte"], end["byte"] - at + 1)[0])


class TailSource(DataSource):
    """``spark.readStream.format("line_tail").option("path", file)``; columns value and offset."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "value string, offset long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        o = self.options
        return TailReader(o["path"], o.get("fromstart", o.get("fromStart", "false")).lower() == "true", int(o.get("maxbytes", o.get("maxBytes", str(64 << 20)))))
