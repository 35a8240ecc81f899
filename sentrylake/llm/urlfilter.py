"""URL filtering with a sorted array of 64-bit digests.

A rule is ``host/path``: it fits its host and all subdomains of it, for urls
whose path starts with the rule's path; the longest rule wins. The XXH64 keys of
all rules lie sorted in a file that Spark ships to every executor once; tasks
memory-map it and probe it by vectorised binary search with every combination
of a url's host suffixes and of its path's starts that have as many labels, and
characters, as rules have. A hit is
confirmed on the stored rule text, so colliding digests cannot decide a verdict.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. A null url, or
one without ``://``, has an empty host and path, fits no rule and is allowed, as
is any url without a rule. Urls may be of any length. An empty table gives an
empty result and repeated rows one verdict each; of rules of one length the one
with the longer host wins. Columns named host, path, rule or verdict are
replaced.

Rules are a dictionary, or a table (rule, verdict) whose digests Spark computes
and sorts; the driver then only streams the sorted rows to the file, which takes
16 bytes a rule besides the texts and must fit an executor's disk: ``MAX_RULES``
bounds it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import map_texts

MAX_RULES = 100_000_000


def _digest(string: bytes) -> int:
    """XXH64 with the seed that Spark's function of that name takes."""
    return xxhash.xxh64_intdigest(string, 42)


def digested(strings: Iterable[str], digest=_digest) -> list[tuple[int, bytes]]:
    return sorted((digest(s), s) for s in {s.encode() for s in strings})


class DigestArray:
    """Sorted digests, with the offsets of the full strings that they stand for, in one memory-mapped file."""

    def __init__(self, path: str) -> None:
        n, text_bytes = (int(x) for x in np.fromfile(path, dtype="<u8", count=2))
        self.keys = np.memmap(path, dtype="<u8", mode="r", offset=16, shape=(n,)) if n else np.zeros(0, "<u8")
        self.ends = np.memmap(path, dtype="<u8", mode="r", offset=16 + 8 * n, shape=(n,)) if n else self.keys
        self.text = np.memmap(path, dtype="u1", mode="r", offset=16 + 16 * n, shape=(text_bytes,)) if text_bytes else np.zeros(0, "u1")

    @staticmethod
    def write(rows: Iterable[tuple[int, bytes]], path: str) -> None:
        """``rows``: digests and strings in the order of both, without repeats. They are streamed through files."""
        with open(f"{path}.keys", "wb") as keys, open(f"{path}.ends", "wb") as ends, open(f"{path}.text", "wb") as text:
            n = end = 0
            for digest, string in rows:
                n, end = n + 1, end + len(string)
                keys.write(digest.to_bytes(8, "little"))
                ends.write(end.to_bytes(8, "little"))
                text.write(string)
        with open(path, "wb") as f:
            np.array([n, end], dtype="<u8").tofile(f)
            for part in ("keys", "ends", "text"):
                with open(f"{path}.{part}", "rb") as p:
                    shutil.copyfileobj(p, f, 1 << 24)
                os.remove(f"{path}.{part}")

    def contains(self, strings: list[bytes], digest=_digest) -> np.ndarray:
        """Which of the strings are stored: binary search for all of them, then a check of the full strings."""
        out = np.zeros(len(strings), dtype=bool)
        if not len(self.keys) or not strings:
            return out
        probe = np.fromiter(map(digest, strings), dtype="<u8", count=len(strings))
        at = np.searchsorted(self.keys, probe)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe):
            j = int(at[i])
            while not out[i] and j < len(self.keys) and self.keys[j] == probe[i]:  # strings that share a digest lie side by side
                start = int(self.ends[j - 1]) if j else 0
                out[i] = self.text[start : int(self.ends[j])].tobytes() == strings[i]
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[str]:
    """Every rule text that could fit, the longest first; of equal length, the one with the longer host.

    ``lengths`` are those of the rules' paths, ``labels`` the numbers of labels that their hosts have.
    """
    last = host.rsplit(".", max(labels, default=0))
    suffixes = [".".join(last[-n:]) for n in labels if n < len(last) or n == len(last) == host.count(".") + 1] if host else []
    found = {s + path[:n] for s in suffixes for n in lengths if n <= len(path)}
    return sorted(found, key=lambda r: (-len(r), r.find("/")))


_folders: list[tempfile.TemporaryDirectory] = []


def _sorted_rules(rules: DataFrame, verdict: str) -> Iterator[tuple[int, bytes]]:
    """The digests and texts of a verdict's rules, sorted by Spark and fetched partition by partition."""
    high = F.col("d").bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    rows = rules.filter(F.col("verdict") == verdict).select(F.xxhash64("rule").alias("d"), "rule").distinct().orderBy(high, F.col("rule").cast("binary"))
    return ((r.d % (1 << 64), r.rule.encode()) for r in rows.toLocalIterator())


def filter_urls(pages: DataFrame, rules: dict[str, str] | DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` maps ``host/path`` to allow or block."""
    spark: SparkSession = pages.sparkSession
    if isinstance(rules, dict):
        count, bad = len(rules), [r for r, v in rules.items() if "/" not in r or v not in ("allow", "block")]
        lengths = sorted({len(r) - r.index("/") for r in rules if "/" in r})
        labels = sorted({r.count(".", 0, r.index("/")) + 1 for r in rules if "/" in r})
        rows = {v: iter(digested(r for r, w in rules.items() if w == v)) for v in ("allow", "block")}
    else:
        wrong = F.coalesce(~F.col("rule").contains("/") | ~F.col("verdict").isin("allow", "block"), F.lit(True))
        count, bad = rules.count(), [r.rule for r in rules.filter(wrong).limit(3).collect()]
        lengths = sorted(r[0] for r in rules.select(F.length("rule") - F.instr("rule", "/") + 1).distinct().collect())
        labels = sorted(r[0] for r in rules.select(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).distinct().collect())
        rows = {v: _sorted_rules(rules, v) for v in ("allow", "block")}
    if count > MAX_RULES:
        raise ValueError("too many rules for an array on each executor")
    if bad:
        raise ValueError(f"not a rule: {bad[:3]}")
    _folders.append(tempfile.TemporaryDirectory(prefix="spark-urls-"))  # served to executors until the program ends
    folder = os.path.realpath(_folders[-1].name)
    names = {v: f"{v}-{uuid.uuid4().hex}.bin" for v in ("allow", "block")}
    for verdict, name in names.items():
        DigestArray.write(rows[verdict], f"{folder}/{name}")
        spark.sparkContext.addFile(f"{folder}/{name}")

    def judge(urls: list) -> tuple:
        arrays = {v: DigestArray(SparkFiles.get(name)) for v, name in names.items()}
        parts = [split_url(u) for u in urls]
        tried = [candidates(h, p, lengths, labels) for h, p in parts]
        flat = [r.encode() for t in tried for r in t]
        hits = {v: a.contains(flat) for v, a in arrays.items()}
        rule: list[str | None] = []
        verdict, i = [], 0
        for t in tried:
            at = next((k for k in range(i, i + len(t)) if hits["allow"][k] or hits["block"][k]), None)
            rule.append(None if at is None else flat[at].decode())
            verdict.append("allow" if at is None or hits["allow"][at] else "block")
            i += len(t)
        return [h for h, _ in parts], [p for _, p in parts], rule, verdict

    added = ("host", "path", "rule", "verdict")
    return map_texts(pages, [c for c in pages.columns if c not in added], "url", judge, {c: ("string", pa.string()) for c in added})
