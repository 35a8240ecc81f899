"""What every session needs: the package at the Python workers, shared folders, the time zone."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds this package to the application's Python files, once, so that workers import it wherever they start.

    It also bounds the batches that go to the workers, unless the session has a bound of its own.
    """
    if spark.conf.get(_BATCH_BYTES) == "67108864b":  # the default: batches of that size are what fills executors beside the heap
        spark.conf.set(_BATCH_BYTES, "8m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = os.path.realpath(tempfile.mkdtemp(prefix="spark-package-")) + "/sentrylake_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*")):
            if p.suffix in (".py", ".yml"):
                z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession, name: str) -> str:
    """The path of a fresh folder that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local master
    gets a temporary folder and any other master one under the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def utc(spark: SparkSession) -> Iterator[None]:
    """The session time zone is UTC inside the block; plans made there keep it."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
