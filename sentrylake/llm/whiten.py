"""Whitening of embeddings by a singular value decomposition that never forms a covariance.

Four passes over the vectors, each of which leaves a small matrix a task:
sums of each dimension; a triangular factor R, as a task's centred rows are
compressed by QR block after block (TSQR); the projected rows, which are
written; and the covariance of these, which shows how white they are. The
tasks' matrices are joined sixteen at a time until one is left, so no task and
not the driver ever meets more than sixteen of them. R has as many rows and columns as
a vector has entries. One-sided Jacobi turns its columns until all are
orthogonal: the turns, taken together, are the components, and the columns'
lengths the standard deviations, small ones as accurate as large ones.

An entry c becomes the whole number floor(1024 c) + 100000, held at 2^52 either
way, so that sums and differences from the mean are exact before anything is
rounded. Rows are dropped whose vector is null or empty, holds null or
non-finite entries, or has another length than most vectors have (of lengths
equally common the smallest counts). Repeated rows count as often as they
occur. A table without vectors gives an empty result. A component without
variance (equal vectors, dimensions that depend on others) has null for
``whitened``, as has ``deviation`` beyond the range of a long; ``explained`` is
null where no vector varies at all. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .util import land, work_dir

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52
FAN_IN = 16
_LONG = 1 << 63


def whole(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers that stand for entries."""
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def triangular(rows: np.ndarray) -> np.ndarray:
    """The R of a QR decomposition, with rows of zeros where there are too few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _moments(x: np.ndarray) -> np.ndarray:
    """Count, mean and sum of products about the mean of some rows, as one vector."""
    mean = x.mean(axis=0)
    return np.concatenate([[len(x)], mean, ((x - mean).T @ (x - mean)).ravel()])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of rows whose two parts have moments ``a`` and ``b``."""
    k = int((np.sqrt(4 * len(a) - 3) - 1) / 2)
    n = a[0] + b[0]
    apart = b[1 : k + 1] - a[1 : k + 1]
    mean = a[1 : k + 1] + apart * (b[0] / n)
    return np.concatenate([[n], mean, a[k + 1 :] + b[k + 1 :] + np.outer(apart, apart).ravel() * (a[0] * b[0] / n)])


def gathered(rows: DataFrame, column: str, width: int, of: Callable[[np.ndarray], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray], path: str) -> np.ndarray | None:
    """``of`` each batch of vectors, joined within every task and then in a tree of ``FAN_IN``; None for no rows."""
    item = "long" if of is _sums else "double"
    kind, schema = np.int64 if item == "long" else np.float64, f"part long, made array<{item}>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for x in _matrices(batches, 0, width):
            one = of(x)
            made = one if made is None else join(made, one)
        if made is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "made": [made.ravel().tolist()]}, pa.schema([("part", pa.int64()), ("made", pa.list_(pa.from_numpy_dtype(kind)))]))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        shape = (-1, width) if of not in (_sums, _moments) else (-1,)
        made = None
        for x in group.sort_values("part").made:
            one = np.asarray(x, dtype=kind).reshape(shape)
            made = one if made is None else join(made, one)
        return pd.DataFrame({"part": [int(group.part.iloc[0]) // FAN_IN], "made": [made.ravel().tolist()]})

    parts, n = land(rows.select(column).mapInArrow(partial, schema), f"{path}/0"), 0
    last = parts.agg(F.max("part")).first()[0]
    while last is not None and (last or not n):
        n += 1
        parts, last = land(parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(merge, schema), f"{path}/{n}"), last // FAN_IN
    found = parts.first()
    return None if found is None else np.array(found.made, dtype=kind)


def _sums(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(vectors)], whole(vectors).sum(axis=0)])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, the largest first, and its right singular vectors as columns.

    Each sweep turns every pair of columns once, in rounds of disjoint pairs, until all pairs are orthogonal to rounding.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    ring, turned, smallest = list(range(d + d % 2)), True, np.sqrt(d) * 2.0**-53
    while turned:
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(p, q) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, dtype=int).reshape(-1, 2).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            crooked = np.abs(xy) > smallest * np.sqrt(xx) * np.sqrt(yy)
            if not crooked.any():
                continue
            turned = True
            p, q = p[crooked], q[crooked]
            zeta = (yy - xx)[crooked] / (2 * xy[crooked])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
    lengths = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """Vectors projected on their first components and scaled to unit variance, one row a vector and component:
    ``key``, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    path, kind = work_dir(spark, "whiten"), dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fine = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is above infinity
    kept = vectors.filter(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    most = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], schema)
    d = most.d
    kept = kept.filter(F.size("v") == d)
    n, *sums = (int(x) for x in gathered(kept, "v", d, _sums, np.add, f"{path}/sums"))
    total = np.array(sums, dtype=np.int64)

    def differences(x: np.ndarray) -> np.ndarray:
        return n * whole(x) - total  # exact, also where the product alone would not fit

    r = gathered(kept, "v", d, lambda x: triangular(differences(x) / n), lambda a, b: triangular(np.vstack([a, b])), f"{path}/r").reshape(d, d)
    lengths, turns = jacobi(r)
    k = min(components, d)
    variance = lengths**2 / n
    varies = lengths[:k] > lengths[0] * d * 2.0**-52
    scaled = turns[:, :k] / np.where(varies, np.sqrt(variance[:k]), np.inf)
    explained = (variance[:k] / variance.sum()).tolist() if variance.sum() > 0 else [None] * k

    def squares(y: np.ndarray) -> list[int | None]:
        if (y.astype(np.float64) ** 2).sum(axis=1).max() < _LONG / 2:
            return (y * y).sum(axis=1).tolist()
        exact = [sum(int(e) ** 2 for e in row) for row in y]
        return [e if e < _LONG else None for e in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _matrices(iter([b]), 1, d):
                y = differences(x)
                made = pa.FixedSizeListArray.from_arrays(pa.array(((y / n) @ scaled).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(squares(y), pa.int64()), made], ["key", "deviation", "w"])

    rows = land(kept.mapInArrow(project, f"key {kind}, deviation long, w array<double>"), f"{path}/rows")
    spread = gathered(rows, "w", k, _moments, _joined, f"{path}/moments")
    off = np.abs(spread[k + 1 :].reshape(k, k) / n - np.eye(k))[np.ix_(varies, varies)]
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    flags = F.array(*[F.lit(bool(x)) for x in varies])
    out = rows.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(flags, F.col("at")), F.col("whitened")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(off.max()) if off.size else None).cast("double").alias("identity_error"),
    )
