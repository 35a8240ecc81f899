"""Packing documents into fixed-length sequences by vector best-fit.

Each piece of a document uses three resources of a sequence: tokens, documents
and attention cost (length squared). Pieces are placed longest first, each into
the open sequence with the smallest weighted norm of what would stay free, among
those where every resource suffices; otherwise it opens a sequence. Pieces are
dealt by hash into groups of about ``GROUP_PIECES``, each packed in one task;
the pieces of sequences that stay underfilled are dealt and packed once more
across groups. Nothing is dropped: pieces of one sequence length fill one alone.

A document is its token ids and the end id; null text counts as empty, so such
a document is one piece of one token. Documents longer than a sequence are cut
so that all pieces but the first are full. Repeated rows are packed as often as
they occur, a null doc_id is kept, empty tables give empty results and other
columns are ignored.

Ids come from a memo of space-delimited chunks in front of the byte-level BPE.
That is exact where every space is single and has other characters than white
space on one side at least, as the pre-tokenizer attaches a space to the word
after it and never looks back over it; other texts are encoded whole. Texts with the special token's own string go through the tokenizer file
itself, which maps it to the special id.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .util import land, work_dir

SEQUENCE = 1024
END_ID = 2
GROUP_PIECES = 4096
_MEMO = 400_000
_SPECIAL = "<|endoftext|>"
#: A space inside a run of white space, which the pre-tokenizer may cut elsewhere than before that space.
_WHITE = re.compile(r"  |\s \s").search
#: Weights of tokens, documents and attention cost in the norm of what stays free.
WEIGHTS = (1.0, 0.02, 0.02)
_REPACK_BELOW = 0.97


@cache
def whole_tokenizer(path: str):
    """The tokenizer of a file; one per Python worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(tokenizer_json: str, ranks_file: str, pattern: str) -> Callable[[str], np.ndarray]:
    """The encoding function of a byte-level BPE; one per Python worker, with a bounded memo."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    memo: dict[str, bytes] = {}
    plain = bpe.encode_ordinary

    class Missing(dict):
        def __missing__(self, chunk: str) -> bytes:
            ids = np.array(plain(chunk), dtype="<u4").tobytes()
            if len(self) >= _MEMO:
                self.clear()
            self[chunk] = ids
            return ids

    memo = Missing()

    def encode(text: str) -> np.ndarray:
        if _SPECIAL in text:
            return np.array(whole_tokenizer(tokenizer_json).encode(text, add_special_tokens=False).ids, dtype="<u4")
        if text[:1] == " " or text[-1:] == " " or _WHITE(text):
            return np.array(plain(text), dtype="<u4")
        head, *rest = text.split(" ")
        return np.frombuffer(b"".join([memo[head], *map(memo.__getitem__, [" " + x for x in rest])]), dtype="<u4")

    return encode


def byte_bpe() -> tuple[str, str, str]:
    """Where the installed public tokenizer keeps its files, and its pre-tokenizer pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: tuple[str, str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    ship(docs.sparkSession)
    files = tokenizer or byte_bpe()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                all_ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                n = len(all_ids)
                k = -(-n // size)
                edges = [0, *range(n - (k - 1) * size, n + 1, size)]
                for j in range(k):
                    part = all_ids[edges[j] : edges[j + 1]]
                    row.append(i)
                    piece.append(j)
                    start.append(edges[j])
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part)
            arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, size: int, max_docs: int, max_attention: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, in the order given (longest first for a good result)."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.array([size, max_docs, max_attention], dtype=np.float64)
    weight = np.array(WEIGHTS) / full**2
    free = np.empty((n, 3))  # of the open bins, closed ones are swapped out
    name = np.empty(n, np.int64)
    n_open = made = 0
    least = lengths.min() if n else 0
    for i in range(n):
        need = np.array([lengths[i], 1, lengths[i] ** 2], dtype=np.float64)
        at = -1
        if n_open:
            rest = free[:n_open] - need
            norm = np.where((rest >= 0).all(axis=1), (rest * rest) @ weight, np.inf)
            best = int(norm.argmin())
            at = best if norm[best] < np.inf else -1
        if at < 0:
            at, n_open = n_open, n_open + 1
            free[at], name[at], made = full, made, made + 1
        bins[i], offsets[i] = name[at], size - free[at, 0]
        free[at] -= need
        if free[at, 0] < least or free[at, 1] < 1:
            n_open -= 1
            free[at], name[at] = free[n_open], name[n_open]
    return bins, offsets


def _pack_once(items: DataFrame, group: str, size: int, max_docs: int, max_attention: int) -> DataFrame:
    """Packs each group of (key, length) rows; adds bin, offset and used, the tokens of the bin."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        b, at = best_fit(rows["length"].to_numpy(np.int64), size, max_docs, max_attention)
        used = np.bincount(b, weights=rows["length"]).astype(np.int64)[b] if len(b) else b
        return pd.DataFrame({"key": rows["key"], "length": rows["length"], "bin": b, "offset": at, "used": used, "grp": rows["grp"]})

    return items.withColumnRenamed(group, "grp").groupBy("grp").applyInPandas(run, "key long, length long, bin long, offset long, used long, grp long")


def pack(
    found: DataFrame, size: int = SEQUENCE, max_docs: int | None = None, max_attention: int | None = None, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces``. By default only tokens limit a sequence."""
    spark = found.sparkSession
    ship(spark)
    path = work_dir(spark, "packing")
    limits = (size, max_docs or size, max_attention or size * size)
    found = land(found.withColumn("key", F.monotonically_increasing_id()), f"{path}/pieces")
    alone = F.col("length") >= size

    def deal(rows: DataFrame) -> DataFrame:
        groups = max(1, -(-rows.count() // group_pieces))
        return rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))

    first = land(_pack_once(deal(found.filter(~alone).select("key", "length")), "g", *limits), f"{path}/first")
    good = F.col("used") >= _REPACK_BELOW * size
    again = land(_pack_once(deal(first.filter(~good).select("key", "length")), "g", *limits), f"{path}/again")

    def named(rows: DataFrame, kind: int) -> DataFrame:
        # 2 bits say which round made the bin, then come its group and its number in the group
        return rows.select("key", (F.lit(kind << 60) + F.shiftleft("grp", 24) + F.col("bin")).alias("sequence_id"), "offset")

    placed = named(first.filter(good), 1).unionByName(named(again, 2))
    placed = placed.unionByName(found.filter(alone).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return found.join(placed, "key").drop("key")
