"""A Merkle manifest of a dataset: ternary trees per source, a root over all of them, and a proof for every row.

A row's leaf is a digest of its columns. Within a source the leaves ascend by
id; every three consecutive nodes become their digest until one node, the
source's subroot, is left, and the subroots of all sources are treed alike to
the root. A row's proof is what stands beside it on the way up.

Trees are cut into aligned blocks of 3^``height`` leaves. Leaves are numbered by
a range sort, so a source of any size lies in many partitions; a block is one
task's work, and block roots are treed by the same step until each source has
one, which takes a round for every factor of 3^``height``. Proofs are then made
downwards: the blocks of each round meet the proofs of their roots, and a
fractal traversal walks a block's leaves. It stacks small subtrees: of each
stack level one existing subtree lies on the current path, while the desired
one to its right grows by one leaf a step, so that a path is at hand at every
leaf and nothing but the block's leaves and the stacked subtrees is held.

Null columns are marked in the leaf and a null source is a source of its own,
which comes first. Rows without an id come first in their source; rows that
repeat an id are leaves of their own, ordered by their digests. Texts may be as
long as Spark's strings. An empty table has no leaves and gives an empty result.
Columns that are no part of the leaf are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .util import land, work_dir

ARITY = 3
HEIGHT = 8  # of a block: 6561 leaves
SUBTREE = 2  # height of the subtrees that a traversal stacks
Path = list[tuple[str, str]]  # from the leaf up: what stands left and right of a node in its run, joined
_PATH = "left array<string>, right array<string>"
_RESULT = "id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The digest of columns: each ``-`` if null, else its length in UTF-8 bytes, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parent(run: Sequence[str | None]) -> str | None:
    """The node over a run; None stands for what lies beyond the last leaf."""
    there = [x for x in run if x is not None]
    return digest("".join(there)) if there else None


def levels_of(n: int) -> int:
    """How many times ``n`` nodes must be joined by threes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


class Growing:
    """A subtree under construction: its nodes from level ``base`` up to below its root, made of leaves fed from the left."""

    def __init__(self, base: int, height: int) -> None:
        self.base, self.top = base, base + height
        self.nodes: list[list[str | None]] = [[] for _ in range(height)]
        self.open: list[list[str | None]] = [[] for _ in range(self.top)]  # at most two nodes a level, waiting for a third
        self.root: str | None = None

    def feed(self, node: str | None) -> None:
        for level in range(self.top):
            if level >= self.base:
                self.nodes[level - self.base].append(node)
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, self.open[level] = _parent(self.open[level]), []
        self.root = node


def root_of(leaves: Sequence[str], height: int) -> str:
    tree = Growing(height, 0)
    for i in range(ARITY**height):
        tree.feed(leaves[i] if i < len(leaves) else None)
    return tree.root if height else leaves[0]


def paths(leaves: Sequence[str], height: int) -> Iterator[Path]:
    """The path of each leaf in turn, by fractal traversal of the block that they fill from the left."""
    at = lambda i: leaves[i] if i < len(leaves) else None
    stack = [(b, min(SUBTREE, height - b)) for b in range(0, height, SUBTREE)]
    existing = [Growing(b, h) for b, h in stack]
    for tree in existing:
        for i in range(ARITY**tree.top):
            tree.feed(at(i))
    desired = [Growing(b, h) for b, h in stack]
    for x in range(len(leaves)):
        path = []
        for tree in existing:
            for level in range(tree.base, tree.top):
                here = x // ARITY**level % ARITY ** (tree.top - level)
                run, k = here - here % ARITY, here % ARITY
                nodes = tree.nodes[level - tree.base][run : run + ARITY]
                path.append(("".join(nodes[:k]), "".join(n for n in nodes[k + 1 :] if n is not None)))
        yield path
        for i, tree in enumerate(desired):
            width = ARITY**tree.top
            tree.feed(at(x + width))
            if (x + 1) % width == 0:
                existing[i], desired[i] = tree, Growing(*stack[i])


def fold(node: str, path: Path) -> str:
    """The root that a node and what stands beside it lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def numbered(rows: DataFrame, key: str, order: Sequence[Column], path: str) -> DataFrame:
    """``rows`` with ``idx``, their place within ``key`` from 0, and ``n``, the number of the key's rows.

    Rows are sorted by ranges of key, order and place in the input, so that neither a key nor a value that repeats falls
    to one task. A key's rows stand together in each partition, and a partition's share of a key is one row of counts.
    """
    tie = F.monotonically_increasing_id()
    rows = rows.withColumns({f"__o{i}": c for i, c in enumerate([*order, tie])})
    by = [key, *(f"__o{i}" for i in range(len(order) + 1))]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by[1:]).withColumn("__at", F.monotonically_increasing_id())
    placed = land(placed, f"{path}/placed")
    part, pos = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("__part", part)
    shares = placed.groupBy(key, "__part").agg(F.min(pos).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole = Window.partitionBy(key)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = land(shares.select(key, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n")), f"{path}/shares")
    return placed.join(shares, [key, "__part"]).withColumn("idx", pos + F.col("__shift")).drop("__at", "__part", "__shift")


def _in_block(n: int, height: int) -> int:
    """The height of a block in a tree over ``n`` nodes."""
    return height if n > ARITY**height else levels_of(n)


def _block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY**height}"))


def _roots(nodes: DataFrame, height: int, path: str) -> DataFrame:
    """Block roots of nodes (k, idx, n, node), which are nodes of the next round."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        n = int(group.n.iloc[0])
        root = root_of(group.node.tolist(), _in_block(n, height))
        return pd.DataFrame({"k": group.k.iloc[:1], "idx": group.block.iloc[:1], "n": [-(-n // ARITY**height)], "node": [root]})

    small = _block(nodes, height).select("k", "block", "idx", "n", "node")
    return land(small.groupBy("k", "block").applyInPandas(run, "k string, idx long, n long, node string"), path)


def _climb(nodes: DataFrame, height: int, path: str) -> list[DataFrame]:
    """Nodes of every round, the last with one node a key."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(_roots(rounds[-1], height, f"{path}/{len(rounds)}"))
    return rounds


def _descend(rounds: Sequence[DataFrame], top: DataFrame, height: int, path: str) -> DataFrame:
    """Paths to the root of the nodes of the first round, given those of the last round's: k, idx, left, right, subroot."""

    def run(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, up = group.sort_values("idx"), above.iloc[0]
        own = list(paths(group.node.tolist(), _in_block(int(group.n.iloc[0]), height)))
        sides = [[[*(p[s] for p in one), *up[name]] for one in own] for s, name in enumerate(("left", "right"))]
        return pd.DataFrame({"k": group.k, "idx": group.idx, "left": sides[0], "right": sides[1], "subroot": up.subroot})

    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        below = _block(nodes, height).select("k", "block", "idx", "n", "node").groupBy("k", "block")
        above = top.withColumnRenamed("idx", "block").groupBy("k", "block")
        top = land(below.cogroup(above).applyInPandas(run, f"k string, idx long, {_PATH}, subroot string"), f"{path}/paths{i}")
    return top


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Proofs of leaves (id, source, leaf, received): id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``received`` is the digest of the row as it is to be verified; ``folded_root`` is what it and the leaf's proof lead to.
    """
    spark = leaves.sparkSession
    ship(spark)
    path, result = work_dir(spark, "merkle"), _RESULT.format(id=dict(leaves.dtypes)["id"])
    # keys that are never null and sort as their sources do
    keyed = leaves.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("k"), "id", F.col("leaf").alias("node"), "received"
    )
    base = land(numbered(keyed, "k", [F.col("id"), F.col("node")], f"{path}/leaves"), f"{path}/base")
    rounds = _climb(base, height, f"{path}/rounds")
    if base.isEmpty():
        return spark.createDataFrame([], result)
    subroots = rounds[-1].select("k", F.col("node").alias("subroot"))
    # the tree over the sources: one key, in which each source's subroot is a leaf
    tops = land(numbered(subroots.select(F.lit("").alias("k"), F.col("k").alias("source"), F.col("subroot").alias("node")), "k", [F.col("source")], f"{path}/tops"), f"{path}/top")
    upper = _climb(tops, height, f"{path}/top-rounds")
    root = upper[-1].first()["node"]
    empty = F.array().cast("array<string>")
    ends = upper[-1].select("k", "idx", empty.alias("left"), empty.alias("right"), F.lit("").alias("subroot"))
    over = tops.select("idx", "source", "node").join(_descend(upper, ends, height, f"{path}/top-paths").select("idx", "left", "right"), "idx")
    ends = land(over.select(F.col("source").alias("k"), F.lit(0).cast("long").alias("idx"), "left", "right", F.col("node").alias("subroot")), f"{path}/ends")
    above = _descend(rounds[1:], ends, height, f"{path}/block-paths") if len(rounds) > 1 else ends

    def prove(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, up = group.sort_values("idx"), above.iloc[0]
        rest = list(zip(up.left, up.right, strict=True))
        out = []
        for row, path in zip(group.itertuples(index=False), paths(group.node.tolist(), _in_block(int(group.n.iloc[0]), height)), strict=True):
            path += rest
            folded = fold(row.received, path)
            out.append((row.id, row.node, up.subroot, root, digest("".join(a + b for a, b in path)), folded, folded == root))
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).astype({"id": group.id.dtype})

    blocks = _block(base, height).groupBy("k", "block")
    return blocks.cogroup(above.withColumnRenamed("idx", "block").groupBy("k", "block")).applyInPandas(prove, result)


def documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of a table of documents, with doc_id for id.

    Received rows are the documents themselves, but texts of ids whose decimal form has an even crc32 have lost their line
    ends, so that verification has something to find. Rows without an id are received as they are.
    """
    of = lambda text: leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    text = F.col("text").cast("string")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = tampered & F.coalesce(text.contains("\n"), F.lit(False))
    leaves = docs.select(
        F.col("doc_id").alias("id"), "source", of(text).alias("leaf"), F.when(changed, of(F.translate(text, "\n", ""))).alias("other")
    ).withColumn("received", F.coalesce("other", "leaf"))
    return manifest(leaves.drop("other"), height).withColumnRenamed("id", "doc_id")
