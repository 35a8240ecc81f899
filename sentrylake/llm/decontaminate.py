"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is ``size`` consecutive item words (a shorter item is one window). A
window of m words that occurs in a document covers exactly one word position
that is a multiple of ``stride = m - k + 1``, k = (m + 1) // 2, at which one of
the window's k-grams starts. So only every stride-th k-gram of a document is
probed against the broadcast set of item k-grams, which misses nothing; each
hit brings along the few words around it, and every window in them is verified
word by word against the items. Everything is DataFrame functions.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
Null and empty texts have no words and are never contaminated. Items without
words or with a null text have no windows; items that share a window are all
counted. An empty benchmark hits nothing, an empty table gives an empty result.
Repeated rows get one result each; documents are told apart by doc_id and text.
Texts may be of any length; judging one and cutting its hit words out take time in
proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import ascii_lower, packed_rows

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and their k-grams are broadcast up to this many rows together (a window takes about 100 bytes, a k-gram 16);
#: beyond it the joins are left to shuffle.
BROADCAST_ROWS = 2_000_000
#: A word whatever its case, to count words without making them.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _GAPS), "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct (item, m, window): every window of every item, its words joined by a space."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    items = items.withColumn("m", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    windows = F.transform(starts, lambda s: F.array_join(F.slice(F.col("w"), s, F.col("m")), " "))
    return items.select("item", "m", F.explode(windows).alias("window")).distinct()


def _gram(m: int) -> tuple[int, int]:
    k = (m + 1) // 2
    return k, m - k + 1


def _hash_at(w: Column, k: int):
    return lambda i: F.xxhash64(F.slice(w, i, k))


def _probe_at(w: Column, m: int, k: int):
    return lambda i: F.struct(F.lit(m).alias("m"), (i - 1).alias("p"), F.xxhash64(F.slice(w, i, k)).alias("h"))


def _scanned(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: for every row one line (doc_id, text_hash, n_words, start null), and a line for every
    occurrence of an item's window (start, counted in words from 0, m, item)."""
    windows = item_windows(benchmark, size)
    counted = windows.groupBy("m").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``size`` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    base = ["doc_id", "text_hash", F.size("w").cast("long").alias("n_words")]
    if not counted:
        return texts.select(*base, F.lit(None).cast("int").alias("start"), F.lit(0).alias("m"), F.lit(None).cast("string").alias("item"))
    sent = sum(r.n * (1 + _gram(r.m)[1]) for r in counted)  # each window and the k-grams that it may be found by
    hint = F.broadcast if sent <= BROADCAST_ROWS else lambda df: df
    grams, probes = [], [F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h")))]  # the row itself is of no length
    none = F.array().cast("array<struct<m:int,p:int,h:bigint>>")
    for m in sorted(r.m for r in counted):
        k, stride = _gram(m)
        inside = F.transform(F.sequence(F.lit(1), F.lit(stride)), _hash_at(F.split(F.col("window"), " "), k))
        grams.append(windows.filter(F.col("m") == m).select(F.lit(m).alias("m"), F.explode(inside).alias("h")))
        probe = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1, F.lit(stride)), _probe_at(F.col("w"), m, k))
        probes.append(F.coalesce(F.when(F.size("w") >= m, probe), none))
    probed = texts.select(*base, "w", F.explode(F.concat(*probes)).alias("x")).select("doc_id", "text_hash", "n_words", "w", "x.*")
    seen = grams[0]
    for more in grams[1:]:
        seen = seen.unionByName(more)
    # what a shuffled probe carries along is the words around it, not its document
    k = F.floor((F.col("m") + 1) / 2).cast("int")
    lo, hi = F.greatest(F.col("p") - F.col("m") + k, F.lit(0)), F.least(F.size("w"), F.col("p") + F.col("m"))
    probed = probed.filter((F.col("m") == 0) | (hi - lo >= F.col("m")))
    probed = probed.select("doc_id", "text_hash", "n_words", "m", "h", lo.alias("lo"), F.when(F.col("m") > 0, F.slice("w", lo + 1, hi - lo)).alias("near"))
    itself = F.col("m") == 0
    hit = probed.join(hint(seen.distinct().withColumn("known", F.lit(True))), ["m", "h"], "left").filter(itself | F.col("known"))
    places = F.transform(
        F.sequence(F.lit(0), F.size("near") - F.col("m")),
        lambda j: F.struct((F.col("lo") + j).alias("start"), F.array_join(F.slice("near", j + 1, F.col("m")), " ").alias("window")),
    )
    empty = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("window")))
    around = hit.select("doc_id", "text_hash", "n_words", "m", F.explode(F.when(itself, empty).otherwise(places)).alias("x")).select("doc_id", "text_hash", "n_words", "m", "x.*")
    found = around.join(hint(windows), ["m", "window"], "left").filter(itself | F.col("item").isNotNull())
    return found.select("doc_id", "text_hash", "n_words", "start", "m", "item")


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """Distinct (doc_id, text_hash, start, m, item) of the item windows that occur in documents; start counts words from 0."""
    return _scanned(docs, benchmark, size).filter("start IS NOT NULL").drop("n_words").distinct()


def judge(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, items (sorted), spans (word ranges), contaminated."""
    hits = _scanned(docs, benchmark, size).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("start").isNull()).cast("int").alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("start"), (F.col("start") + F.col("m")).alias("end"))))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    # the length of the union of one document's spans, which are sorted by start
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    n_hit = covered.cast("long")
    out = hits.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), "items", "spans", "rows")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    # rows that repeat id and text were one group
    return out.select("*", F.explode(F.sequence(F.lit(1), "rows")).alias("copy")).drop("rows", "copy")


def _key(doc_id: Column, text: Column) -> Column:
    """Null-safe identity of a row's document and text."""
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("text"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` without the contaminated ones; columns pass as they are, whatever their names."""
    bad = judge(docs, benchmark, size).filter("contaminated").select(_key_of_judged().alias("bad")).distinct()
    rows = docs.select(packed_rows(docs).alias("row"))
    return rows.join(bad, _key(F.col("row.doc_id"), F.col("row.text")) == F.col("bad"), "left_anti").select("row.*")


def _key_of_judged() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text_hash").alias("text"))


def drop_spans(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` with the hit words, and the characters up to the next word, cut out of each text."""
    hits = judge(docs, benchmark, size).filter("n_hit > 0").select(_key_of_judged().alias("hit"), "spans").distinct()
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all("text", F.lit(_WORD + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    # the places of all hit words, and beyond them the end: what stands between two neighbours stays
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    rows = docs.select(packed_rows(docs).alias("row"), F.col("text").cast("string").alias("text"))
    joined = rows.join(hits, _key(F.col("row.doc_id"), F.col("row.text")) == F.col("hit"), "left")
    cut = joined.withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces)).withColumn("places", F.concat(places, F.array(F.size("pieces"))))
    begins = F.concat(F.array(F.lit(0)), F.transform("places", lambda p: p + 1))
    gaps = F.filter(F.arrays_zip(begins.alias("from"), F.col("places").alias("to")), lambda g: g["from"] < g["to"])
    cut = cut.withColumn("gaps", gaps)
    kept = F.transform("gaps", lambda g: F.array_join(F.slice("pieces", g["from"] + 1, g["to"] - g["from"]), ""))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    return cut.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
