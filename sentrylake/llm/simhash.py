"""SimHash near-duplicate groups by pigeonhole blocks.

Every document gets a 64-bit fingerprint of its word shingles. Two fingerprints
at ``MAX_BITS`` (3) or fewer differing bits agree on at least one of four
16-bit blocks, so rows meet on block values and Hamming distance decides.
Equal fingerprints are one row from the start. Block values shared by more than
``GROUP_LIMIT`` fingerprints are split again by the same argument: the bits not
yet agreed upon are cut into four sub-blocks, one of which must agree too. After
four rounds at most 21 bits are free, so a group that is still large holds at
most 2**21 fingerprints however large the table is, and its links are found by
probing instead of comparing pairs. Each group yields a forest (a row's link to
its group component), never all pairs; connected components of the forests are
found by min-label propagation with pointer jumping over tables in shared
storage.

Text is lower-cased A-Z, words are ``[^\\x20\\x09-\\x0D]+``, shingles repeat;
fewer words than a shingle make one shingle; no words or a null text give
fingerprint zero, linked like any other. Rows that share a doc_id are one
document for ``component_id``; null ids get a component id only through linked
rows. An empty table gives an empty result; other columns are ignored.

Three bits of 64 stand for nearly equal texts only. To drop texts of a given
Jaccard similarity, ``drop_near_copies`` takes fingerprints of ``WORDS`` words
and as many blocks as let such pairs share one, by the same join on blocks and
check of the distance; every link is then verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .util import BLOOM, land, map_texts, packed_rows, remove, settings, work_dir

MAX_BITS = 3
GROUP_LIMIT = 512
_SEED = 42
_CHUNK = 1 << 15
_BLOCKS = 4
_LEVELS = 4
#: 64-bit words of a wide fingerprint, and the odd factor that makes the hashes of each.
WORDS = 8
_FACTORS = [np.uint64(int(x) << 1 | 1) for x in np.random.default_rng(_SEED).integers(1 << 60, 1 << 63, WORDS)]
#: How many rows of one block value a task compares with as many others.
CHUNK_ROWS = 2048


def _grams(text: str | None, shingle: int) -> list[bytes]:
    """The word shingles of a text, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):  # bounds the unpacked bits of a very long text
        part = np.ascontiguousarray(hashes[i : i + _CHUNK], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
        # eight one-byte counters a word, added up before any of them can overflow
        full = len(bits) // 255 * 255
        sums = bits[:full].reshape(-1, 255, 8).sum(axis=1, dtype="<u8")
        rest = bits[full:].sum(axis=0, dtype="<u8")
        ones += np.vstack([sums, rest[None]]).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit SimHash of a text."""
    grams = _grams(text, shingle)
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(_SEED)), dtype="<u8", count=len(grams))) if grams else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def prints(texts: list) -> tuple:
        return (np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64),)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(docs, ["doc_id"], "text", prints, {"fp": ("long", pa.int64())})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _split(mask: int) -> list[int]:
    """Masks that agree on one more of the four runs into which the free bits of ``mask`` are cut."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(free, _BLOCKS)]


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number reachable from each of n rows over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    label = _components(len(fp), a, b)
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[own], "b": fp[label[own]]})


def _small_groups(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    """Links inside runs of equal (mask, key), each run compared at growing offsets."""
    run = np.concatenate(([0], np.cumsum((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
    at, found, d = np.arange(len(fp)), [], 0
    while True:
        d += 1
        at = at[at + d < len(fp)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= MAX_BITS]
        found.append((near, near + d))
    if not found:
        return _forest(fp, np.zeros(0, int), np.zeros(0, int))
    return _forest(fp, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (mask, key); a run that ends a batch is held back for the next one, at most GROUP_LIMIT rows."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for b in batches:
        m, k, f = (np.concatenate((h, b[c].to_numpy(np.int64))) for h, c in zip(held, ("mask", "key", "fp"), strict=True))
        if not len(m):
            continue
        change = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield _small_groups(m[:last], k[:last], f[:last])
        held = [m[last:], k[last:], f[last:]]
    if len(held[0]):
        yield _small_groups(*held)


def _dense_group(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one large group whose rows differ in few bits: each row probes all rows within MAX_BITS of it."""
    fp = np.unique(group["fp"].to_numpy(np.int64)).view(np.uint64)
    fp.sort()
    varied = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [np.uint64(1 << i) for i in range(64) if varied >> i & 1]
    offsets = [x for i, x in enumerate(bits)]
    offsets += [x ^ y for i, x in enumerate(bits) for y in bits[:i]]
    offsets += [x ^ y ^ z for i, x in enumerate(bits) for j, y in enumerate(bits[:i]) for z in bits[:j]]
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        for x in offsets:
            to = np.searchsorted(fp, fp ^ x)
            to[to == len(fp)] = 0
            hit = fp[to] == fp ^ x
            np.minimum.at(new, np.flatnonzero(hit), new[to[hit]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp.view(np.int64)[own], "b": fp.view(np.int64)[label[own]]})


def find_links(spark: SparkSession, reps: DataFrame, path: str, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) whose connected components are those of all fingerprints in ``reps`` within MAX_BITS of each other."""
    schema, parts = "a long, b long", []
    masks = _split(0)
    rows = reps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    for level in range(_LEVELS):
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        hot = land(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_limit), f"{path}/hot{level}")
        any_hot = not hot.isEmpty()
        cold = keyed.join(hot, ["mask", "key"], "left_anti") if any_hot else keyed
        parts.append(cold.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInPandas(_link_runs, schema))
        if not any_hot:
            break
        dense = land(keyed.join(hot, ["mask", "key"], "left_semi"), f"{path}/dense{level}")
        if level == _LEVELS - 1:
            parts.append(dense.groupBy("mask", "key").applyInPandas(_dense_group, schema))
            break
        children = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in _split(m)]))])
        rows = dense.select("fp", F.explode(F.element_at(children, F.col("mask"))).alias("mask")).distinct()
        masks = sorted({c for m in masks for c in _split(m)})  # different ways can lead to one mask
    links = parts[0]
    for more in parts[1:]:
        links = links.unionByName(more)
    return links


def components(spark: SparkSession, links: DataFrame, path: str) -> DataFrame:
    """(fp, root) for every fingerprint that has a link; root is the smallest fp reachable."""
    links = land(links.distinct(), f"{path}/links")
    both = land(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/both")
    labels = land(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("low")).select("fp", F.least("fp", "low").alias("root")), f"{path}/labels0")
    step = 0
    while True:
        step += 1
        offers = both.join(labels, both.a == labels.fp).groupBy(F.col("b").alias("fp")).agg(F.min("root").alias("offer"))
        taken = labels.join(offers, "fp", "left").select("fp", F.col("root").alias("before"), F.least("root", "offer").alias("root"))
        taken = land(taken, f"{path}/taken{step}")
        jump = taken.select(F.col("fp").alias("at"), F.col("root").alias("further"))
        new = taken.join(jump, taken.root == jump.at, "left").select("fp", "before", F.least("root", "further").alias("root"))
        new = land(new, f"{path}/labels{step}")
        remove(spark, f"{path}/labels{step - 1}", f"{path}/taken{step}")
        labels = new.select("fp", "root")
        if new.filter("root <> before").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable, itself included)."""
    spark = docs.sparkSession
    path = work_dir(spark, "simhash")
    prints = land(fingerprints(docs, shingle), f"{path}/prints")
    reps = land(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{path}/reps")
    roots = components(spark, find_links(spark, reps, path, group_limit), path)
    rooted = land(reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), f"{path}/rooted")
    lowest = land(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), f"{path}/lowest")
    classes = land(rooted.join(lowest, "root").select("fp", "component_id"), f"{path}/classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


# groups of similar texts, with wide fingerprints


def wide_fingerprint(text: str | None, shingle: int) -> bytes:
    """A SimHash of ``WORDS`` 64-bit words, each from another hash of the shingles."""
    grams = _grams(text, shingle)
    if not grams:
        return bytes(8 * WORDS)
    base = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(_SEED)), dtype="<u8", count=len(grams))
    words = []
    for odd in _FACTORS:
        h = base * odd
        h ^= h >> np.uint64(32)
        words.append(_majority(h * odd))
    return np.array(words, dtype="<u8").tobytes()


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two shingle sets of one size with that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def block_plan(rows: int, similarity: float, missed: float = 0.005, crowd: int = 1024) -> np.ndarray:
    """Bit positions of each block (one row a block).

    A block is as wide as leaves about ``crowd`` of ``rows`` unrelated fingerprints on one value, and there
    are as many as let a pair at the similarity share one with probability 1 - ``missed``.
    """
    width = min(40, max(6, int(np.ceil(np.log2(max(rows, 2) / crowd)))))
    agree = (1 - differing_share(similarity)) ** width
    blocks = int(np.ceil(np.log(missed) / np.log(1 - agree)))
    rng = np.random.default_rng(_SEED)
    return np.array([rng.choice(64 * WORDS, width, replace=False) for _ in range(blocks)])


def _near_pairs(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and distance of the pairs of ``x`` and ``y`` that differ in at most ``most`` bits."""
    near_word = most // WORDS + 15  # a first look at one word, five deviations wide
    found = []
    for i in range(0, len(x), 256):
        a, b = np.nonzero(np.bitwise_count(x[i : i + 256, None, 0] ^ y[None, :, 0]) <= near_word)
        a += i
        if x is y:
            a, b = a[a < b], b[a < b]
        for j in range(0, len(a), 1 << 18):
            p, q = a[j : j + (1 << 18)], b[j : j + (1 << 18)]
            d = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64)
            hit = d <= most
            found.append((p[hit], q[hit], d[hit]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _nearest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which pairs make the spanning forest of least total distance over n rows."""
    label, parent, kept = np.arange(n), list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(d, kind="stable")
    for i in range(0, len(order), 4096):
        part = order[i : i + 4096]
        part = part[label[a[part]] != label[b[part]]]
        for k in part.tolist():
            p, q = root(int(a[k])), root(int(b[k]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                kept.append(k)
        if len(part):
            label = np.array([root(j) for j in range(n)]) if n <= 4096 else np.fromiter(map(root, range(n)), np.int64, n)
    return np.array(kept, np.int64)


def _forest_of(ids: np.ndarray, prints: np.ndarray, left: np.ndarray | None, most: int) -> pd.DataFrame:
    """The forest of a block's rows; where ``left`` marks half of them, of the pairs across the halves."""
    if left is None:
        a, b, d = _near_pairs(prints, prints, most)
    else:
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        a, b, d = _near_pairs(prints[one], prints[two], most)
        a, b = one[a], two[b]
    kept = _nearest_forest(len(ids), a, b, d)
    x, y = ids[a[kept]], ids[b[kept]]
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _block_forests(most: int):
    """Rows come sorted by (block, value, part); a group that ends a batch is held back for the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            b = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(b):
                continue
            key = b[["block", "value", "part"]].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for i, j in zip(edges, edges[1:], strict=False):
                yield of(b.iloc[i:j])
            held = b.iloc[edges[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield of(held)

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        prints = np.frombuffer(b"".join(rows["print"]), np.uint64).reshape(-1, WORDS)
        part = rows["part"].iloc[0]
        left = rows["side"].to_numpy(np.int64) == 0 if part >= 0 and (rows["side"] == 1).any() else None
        return _forest_of(rows["id"].to_numpy(np.int64), prints, left, most)

    return run


def similar_links(spark: SparkSession, reps: DataFrame, path: str, count: int, similarity: float, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Likely links (a, b) of ids in ``reps`` (id, print): in each block the spanning forest of least distance.

    A block value that more than ``chunk`` rows share is cut into parts, and every two parts are compared in a task
    of their own, so that no task holds more than two parts.
    """
    plan = block_plan(count, similarity)
    share, bits = differing_share(similarity), 64 * WORDS
    most = int(bits * share + 2.5 * (bits * share * (1 - share)) ** 0.5)
    weight = 1 << np.arange(plan.shape[1], dtype=np.int64)

    def values(with_print: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, k = b.num_rows, len(plan)
                bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")
                value = np.stack([bits[:, at] @ weight for at in plan], axis=1).ravel()
                place = [pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(value)]
                own = [b.column(i).take(pa.array(np.repeat(np.arange(n), k))) for i in range(2)] if with_print else []
                yield pa.RecordBatch.from_arrays(place + own, ["block", "value", "id", "print"][: 2 + len(own)])

        return run

    ship(spark)
    rows = reps.select("id", "print")
    crowded = rows.mapInArrow(values(False), "block int, value long").groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    crowded = land(crowded, f"{path}/crowded")
    keyed = rows.mapInArrow(values(True), "block int, value long, id long, print binary")
    none = F.lit(-1).alias("part"), F.lit(0).alias("side")
    if not crowded.isEmpty():
        parts = F.ceil(F.col("n") / chunk).cast("int")
        mine = F.pmod(F.xxhash64("id"), parts).cast("int")
        keyed = keyed.join(crowded, ["block", "value"], "left").withColumn("parts", parts).withColumn("mine", mine)
        # the task of parts i <= j is number i * parts + j
        tasks = F.when(F.col("n").isNull(), F.array(F.struct(*none))).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda j: F.struct((F.least(F.col("mine"), j) * F.col("parts") + F.greatest(F.col("mine"), j)).alias("part"), F.when(F.col("mine") > j, 1).otherwise(0).alias("side")),
            )
        )
        keyed = keyed.select("id", "print", "block", "value", F.explode(tasks).alias("t")).select("id", "print", "block", "value", "t.part", "t.side")
    else:
        keyed = keyed.select("id", "print", "block", "value", *none)
    near = keyed.repartition("block", "value", "part").sortWithinPartitions("block", "value", "part").mapInPandas(_block_forests(most), "a long, b long")
    return near.distinct()


def jaccard(one: str | None, two: str | None, shingle: int) -> float:
    """Of the sets of word shingles; two texts without words are equal."""
    x, y = set(_grams(one, shingle)), set(_grams(two, shingle))
    return len(x & y) / len(x | y) if x or y else 1.0


def _verified(links: DataFrame, texts: DataFrame, path: str, shingle: int, similarity: float) -> DataFrame:
    """The links whose whole texts are that similar."""
    # written first, so that their number is known when the texts are joined, and other texts are not shuffled
    used = land(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{path}/used")
    with settings(links.sparkSession, BLOOM):
        used = land(texts.join(used, "id", "left_semi"), f"{path}/texts")
    pairs = links.join(used.select(F.col("id").alias("a"), F.col("text").alias("one")), "a").join(used.select(F.col("id").alias("b"), F.col("text").alias("two")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(x, y, shingle) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk: int = CHUNK_ROWS) -> DataFrame:
    """doc_id and group_id (the smallest doc_id of its group of similar texts) of every document that has an id."""
    spark = docs.sparkSession
    path = work_dir(spark, "similar")

    def prints(texts: list) -> tuple:
        return ([wide_fingerprint(t, shingle) for t in texts],)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    found = land(map_texts(texts, ["doc_id"], "text", prints, {"print": ("binary", pa.binary())}), f"{path}/prints")
    # texts of one fingerprint are one from here on, so that a text repeated in other layouts crowds no block
    reps = land(found.groupBy("print").agg(F.min("doc_id").alias("id")), f"{path}/reps")
    links = land(similar_links(spark, reps, path, reps.count(), similarity, chunk), f"{path}/candidates")
    good = _verified(links, texts.withColumnRenamed("doc_id", "id"), path, shingle, similarity)
    roots = components(spark, good, path).select(F.col("fp").alias("id"), "root")
    classes = land(reps.join(roots, "id", "left").select("print", F.coalesce("root", "id").alias("group_id")), f"{path}/classes")
    return found.join(classes, "print").select("doc_id", "group_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the document of the smallest doc_id left of each group of similar texts.

    Texts are linked when the Jaccard similarity of their sets of ``shingle`` words is ``similarity`` or more:
    wide fingerprints find likely links, and each is verified on the whole texts. Rows that share a doc_id are one
    document and stay or go together; rows without an id stay; texts without words are equal. Columns pass as they
    are, whatever their names; an empty table stays empty.
    """
    gone = similar_groups(docs, shingle, similarity).filter("doc_id <> group_id").select(F.col("doc_id").alias("gone"))
    gone = land(gone.distinct(), work_dir(docs.sparkSession, "similar-dropped"))
    rows = docs.select(packed_rows(docs).alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")
