"""Helpers shared by the training-data operators: shared storage and text rules."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Lets Spark build a Bloom filter of a join's small side, at most 8 MB, so that fewer texts are shuffled that have no partner.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
}
_made: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors can reach."""
    path = shared_dir(spark, name)
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the work folders made inside the block at its end; what is still needed must have been written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        remove(spark, *_made.pop())


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is Parquet files as they are, so that a row's file and place in it lead back to its columns."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and plan.simpleString(1).rstrip().lower().endswith("parquet")


def land(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` to shared storage and returns a reader of the files.

    This cuts the lineage: what was written survives lost executors and is
    not computed again.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside a with block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes the empty string."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def packed_rows(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none of their names can clash with helper columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def map_texts(docs: DataFrame, keep: list[str], text: str, fn, added: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """Columns ``keep`` as they are, then what ``fn`` makes of each batch of ``text`` values.

    ``fn`` maps a list of strings (or nulls) to one sequence for each column in
    ``added``, which gives their Spark and Arrow types.
    """
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} {t}" for c, (t, _) in added.items())])
    names = [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(b.column(len(keep)).to_pylist())
            arrays = [pa.array(v, kind) for v, (_, kind) in zip(made, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
