"""Exact deduplication as a stateful stream over content digests.

Documents become index rows: digest, doc_id and the content's locator, which is
the file that holds the text and the row in it. A Structured Streaming
aggregation keyed by digest keeps, in a RocksDB state store and without expiry,
the digest, the identifier of the document that stays, its locator and a count.
The aggregation combines rows before its shuffle, so a digest that holds a
third of all rows reaches its state as one row per task. Hits, that is digests
seen more than once, are then checked on their full bytes, which are fetched by
their locators from the files that hold any; texts that differ under one digest
are regrouped by the text itself.

``Store`` goes on from kept state: each arrival meets all earlier ones.
``dedup`` and ``drop_copies`` judge one table with a store of their own.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the largest doc_id stays. Rows that repeat both doc_id and text
are copies too and one of them stays; a null doc_id sorts lowest. An empty
table gives an empty result; texts may be as long as Spark's strings. Extra
columns are ignored by ``dedup`` and kept by ``drop_copies``, whatever their
names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import BLOOM, ascii_lower, is_scan, land, packed_rows, remove, settings, work_dir

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else every one of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
Digest = Callable[[Column], Column]
_INDEX = "doc_id long, digest string, file string, row long"
_GROUPS = "digest string, keep_id long, keep_at struct<file:string,row:long>, group_size long"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(2**63)))


def _place(*columns: str) -> list[Column]:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *map(F.col, columns)]


def state_of(arrivals: DataFrame) -> DataFrame:
    """The keyed state, for a stream or a batch of index rows: one row per digest."""
    return arrivals.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by(F.struct("file", "row"), _rank()).alias("keep_at"),
        F.count(F.lit(1)).alias("group_size"),
    )


class Store:
    """Documents seen so far, under one folder of shared storage: index rows, the stream's state and the copies' check."""

    def __init__(self, spark: SparkSession, root: str, digest: Digest = sha256, max_files_per_trigger: int = 10_000) -> None:
        self.spark, self.root, self.digest, self.files = spark, root.rstrip("/"), digest, max_files_per_trigger

    def add(self, docs: DataFrame) -> None:
        """Takes in an arrival. Locators of plain Parquet files lead to these, which must stay where they are; of
        anything else the store writes a copy of the texts."""
        if not is_scan(docs) or dict(docs.dtypes)["text"] != "string":
            texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            docs = land(texts, f"{self.root}/content/{uuid.uuid4().hex}")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), self.digest(ascii_lower(F.col("text"))).alias("digest"), *_place())
        rows.write.mode("append").parquet(f"{self.root}/index")

    def index(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(f"{self.root}/index")

    def groups(self) -> DataFrame:
        """Feeds what has arrived since the last call through the keyed state; returns the last state of each digest.

        A batch that is replayed overwrites its own output, so nothing counts twice.
        """
        spark, root = self.spark, self.root
        arrivals = spark.readStream.schema(_INDEX).option("maxFilesPerTrigger", self.files).parquet(f"{root}/index")

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/updates/batch={batch_id}")

        with settings(spark, _STATE):
            query = (
                state_of(arrivals).writeStream.outputMode("update").foreachBatch(save)
                .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        # a digest's count only grows, so the row with the highest count is its last state
        updates = spark.read.schema(_GROUPS).parquet(f"{root}/updates")
        return updates.groupBy("digest").agg(
            F.max_by("keep_id", "group_size").alias("keep_id"), F.max_by("keep_at", "group_size").alias("keep_at"), F.max("group_size").alias("group_size")
        )

    def result(self) -> DataFrame:
        """One row per document added so far: doc_id, keep_id, group_size, kept, text_sha256 (the digest), file and row."""
        spark, path = self.spark, f"{self.root}/{uuid.uuid4().hex}"
        hits = land(self.groups().filter("group_size > 1"), f"{path}/hits")
        rows = self.index().join(hits, "digest", "left").select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.struct("file", "row") == F.col("keep_at"), F.lit(True)).alias("kept"),
            F.col("digest").alias("text_sha256"), "file", "row",
        )
        rows = land(rows, f"{path}/rows")
        copies = rows.filter("group_size > 1")
        if copies.isEmpty():
            return rows
        with settings(spark, BLOOM):
            texts = self._fetched(copies).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
            clashes = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
            clashes = land(clashes, f"{path}/clashes")
        if clashes.isEmpty():
            return rows
        clashing = F.col("text_sha256") == F.col("digest")
        return rows.join(clashes, clashing, "left_anti").unionByName(self._regrouped(copies.join(clashes, clashing, "left_semi"), path))

    def _fetched(self, wanted: DataFrame) -> DataFrame:
        """doc_id, digest, file, row and norm (the normalised text) of the wanted rows, read where their locators say: of the
        files that hold any, the column text."""
        files = [unquote(r.file) for r in wanted.select("file").distinct().collect()]
        texts = self.spark.read.schema("text string").parquet(*sorted(files)).select(*_place(), ascii_lower(F.col("text")).alias("norm"))
        texts = texts.withColumn("at", F.xxhash64("file", "row")).drop("file", "row")
        wanted = wanted.select(F.xxhash64("file", "row").alias("at"), "doc_id", F.col("text_sha256").alias("digest"), "file", "row")
        # a text that another locator of the same hash brought has another digest
        return texts.join(wanted, "at").filter(self.digest(F.col("norm")) == F.col("digest")).drop("at")

    def _regrouped(self, wanted: DataFrame, path: str) -> DataFrame:
        rows = land(self._fetched(wanted), f"{path}/regrouped")
        groups = rows.groupBy("digest", "norm").agg(
            F.max("doc_id").alias("keep_id"), F.max_by(F.struct("file", "row"), _rank()).alias("keep_at"), F.count(F.lit(1)).alias("group_size")
        )
        groups = land(groups, f"{path}/regroups")
        return rows.join(groups, ["digest", "norm"]).select(
            "doc_id", "keep_id", "group_size", (F.struct("file", "row") == F.col("keep_at")).alias("kept"), F.col("digest").alias("text_sha256"), "file", "row"
        )


def _judged(docs: DataFrame, digest: Digest) -> DataFrame:
    store = Store(docs.sparkSession, work_dir(docs.sparkSession, "exact-dedup"), digest)
    store.add(docs)
    rows = store.result()
    remove(docs.sparkSession, f"{store.root}/updates", f"{store.root}/checkpoint")
    return rows


def dedup(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (the digest)."""
    return _judged(docs, digest).drop("file", "row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts left."""
    spark = docs.sparkSession
    if not is_scan(docs):
        docs = land(docs, work_dir(spark, "exact-dedup-docs"))
    gone = _judged(docs, sha256).filter(~F.col("kept")).select("file", "row")
    gone = land(gone, work_dir(spark, "exact-dedup-gone"))
    rows = docs.select(packed_rows(docs).alias("packed"), F.struct(*_place()).alias("place"))
    return rows.join(gone, (F.col("place.file") == F.col("file")) & (F.col("place.row") == F.col("row")), "left_anti").select("packed.*")
