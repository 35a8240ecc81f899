"""Language-model scores from a weighted backoff automaton of trigrams.

Smoothing is Bayesian: the probability of w after a history h of one or two
words is ``(c(h,w) + m*p(w)) / (c(h) + m)``, where p is that of the history
without its first word and, without any history, the add-one unigram. As an
automaton it has a root, a state for every word and for every pair of words
seen in training, an arc for every n-gram seen (weight: the log of that
probability), and a failure arc from each state to that of its history without
the first word, or from a word to the root (weight ``log10(m / (c(h) + m))``).
Reading a token takes the state's arc, or failure arcs until a state has one;
the token's longest known history is the next state. Probabilities over the
known words and the unknown one sum to one in every state. The masses m of the
two orders are chosen from ``MASSES`` by the leave-one-out likelihood of all
training tokens.

Counts are gathered from the whole training corpus and grow with it, so the
automaton is never broadcast: it is a table of n-gram keys and counts, cut by
key range. Documents are encoded in blocks in shared storage. Every block sends
its distinct keys to the ranges and gets the corpus counts of exactly those
back: the part of the automaton that its documents can reach, as arrays of arcs
(sorted by state and word, with weight and next state) and failure arcs. One
pass over the block's tokens carries the state and adds up weights. A block's keys are distinct, so the most
frequent word costs a range one key a block. A block sends at most ``FAN`` rows:
beyond that many ranges, blocks are merged in groups first, and the groups ask
the finer ranges. A model kept by ``fit`` scores other tables with ``score``.

Text is lower-cased A-Z; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end.
A null or empty text is the end alone. Words are told apart by 64-bit hashes and
longer n-grams by hashes of 20 bits more than the corpus needs to number its
tokens (63 at most), so that counts are exact up to collisions, which about one
n-gram in a million has. Rows that repeat count and are scored as often
as they occur; of equally likely masses the smallest are taken; other columns
are ignored; an empty table gives an empty result, an empty training part gives
every token 1/(N+V+1).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .util import land, remove, work_dir

BLOCK_TOKENS = 600_000
#: Tokens of the corpus for each key range.
RANGE_TOKENS = 1_000_000
#: Rows that a block, or a group of blocks, sends at most.
FAN = 4096
#: Tokens of a document that are read one after the other; longer ones are read in segments side by side.
SEGMENT = 128
MASSES = (1.0, 6.0, 36.0)
_GRID = [(a, b) for a in MASSES for b in MASSES]
_END, _START = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\t")  # white space is never a word
_DOC = {"doc_id": pa.list_(pa.int64()), "training": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int32())}
_BLOCK = {"block": pa.int64(), **_DOC, "words": pa.binary(), "tokens": pa.binary()}
_BLOCK_SCHEMA = "block long, doc_id array<long>, training array<boolean>, n_tokens array<int>, words binary, tokens binary"


def encode(docs: DataFrame, training: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole documents; tokens are numbers into the block's list of word hashes (0 is the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {}
        ids, train, lens, tokens = [], [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            hashes = np.array([_END, _START, *map(xxhash.xxh64_intdigest, number)], dtype="<u8")
            # byte by byte, as common words have small numbers
            packed = zstandard.compress(np.ascontiguousarray(np.concatenate(tokens).view("u1").reshape(-1, 4).T).tobytes(), 1)
            row = [[part << 32 | made], [ids], [train], [lens], [hashes.tobytes()], [packed]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, _BLOCK.values(), strict=True)], list(_BLOCK))

        for b in batches:
            for doc_id, flag, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                at = [number.setdefault(w, len(number) + 2) for w in found]
                at.append(0)
                ids.append(doc_id)
                train.append(flag)
                lens.append(len(at))
                tokens.append(np.array(at, dtype="<u4"))
                total += len(at)
                if total >= block_tokens:
                    yield flush()
                    made += 1
                    number, ids, train, lens, tokens, total = {}, [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCK_SCHEMA)


class Block:
    """One encoded block: its documents, and the distinct n-grams of its tokens.

    A pair is known by its history (a word) and its last word; a triple by its history and the pair that it
    ends with. ``arc`` says which n-gram each token ends: a pair for a document's first token, else a triple.
    """

    def __init__(self, row, shift: int) -> None:
        self.lens = np.asarray(row.n_tokens, dtype=np.int64)
        self.hashes = np.frombuffer(row.words, dtype="<u8")
        raw = np.frombuffer(zstandard.decompress(row.tokens), "u1").reshape(4, -1)
        self.word = np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)
        width, first = len(self.hashes), np.cumsum(self.lens) - self.lens
        history = np.empty_like(self.word)
        history[1:] = self.word[:-1]
        history[first] = 1
        pairs, pair_at = np.unique(history * width + self.word, return_inverse=True)
        self.pair_history, self.pair_word = pairs // width, pairs % width
        later = np.ones(len(self.word), dtype=bool)
        later[first] = False
        at = np.flatnonzero(later)
        triples, one, triple_at = np.unique(pair_at[at - 1] * width + self.word[at], return_index=True, return_inverse=True)
        self.triple_history, self.triple_pair = triples // width, pair_at[at[one]]
        self.arc = pair_at.copy()
        self.arc[at] = len(pairs) + triple_at
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        training = np.asarray(row.training, dtype=bool)[self.doc]
        self.word_own = np.bincount(self.word[training], minlength=width)
        self.pair_own = np.bincount(pair_at[training], minlength=len(pairs))
        self.arc_own = np.bincount(self.arc[training], minlength=len(pairs) + len(triples))
        pair_keys = _mix(self.hashes[self.pair_history], self.hashes[self.pair_word])
        triple_keys = _mix(pair_keys[self.triple_history], self.hashes[self.pair_word[self.triple_pair]])
        grams = np.concatenate((pair_keys, triple_keys)) >> np.uint64(shift)
        self.word_order, self.gram_order = np.argsort(self.hashes), np.argsort(grams)
        self.word_keys, self.gram_keys = self.hashes[self.word_order], grams[self.gram_order]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and n-gram key occurs in the block's training documents, in the order of the keys."""
        grams = np.concatenate((self.pair_own, self.arc_own[len(self.pair_own) :]))
        return self.word_own[self.word_order], grams[self.gram_order]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x + b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _ranges(keys: np.ndarray, bits: int, first: int, last: int, cuts: int) -> np.ndarray:
    """Where the parts ``first`` to ``last`` - 1 of ``cuts`` equal parts of the key range end in sorted keys."""
    ends = [((i << bits) // cuts) - 1 for i in range(first + 1, last + 1)]
    return np.searchsorted(keys, np.array(ends, dtype=np.uint64), side="right")


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte by byte: the high bytes are nearly always zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view("u1").reshape(-1, 8).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(packed), "u1").reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype="<u8")


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more as eight bytes each behind them."""
    low, high = np.minimum(counts, 255).astype("u1"), counts[counts >= 255].astype("<u8")
    return zstandard.compress(low.tobytes() + high.tobytes() + np.array([len(low)], "<u8").tobytes(), 1)


def _unpack_counts(packed: bytes) -> np.ndarray:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw[-8:], "<u8")[0])
    counts = np.frombuffer(raw, "u1", n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:-8], "<u8").astype(np.int64)
    return counts


_KEYED = "words binary, word_counts binary, grams binary, gram_counts binary"


@dataclass(frozen=True)
class Shape:
    """How keys are cut: bits of an n-gram key, and the number of coarse ranges and of fine ones in each."""

    bits: int
    coarse: int
    fine: int

    @staticmethod
    def of(tokens: int, range_tokens: int = RANGE_TOKENS, fan: int = FAN) -> Shape:
        cuts = max(min(64, fan), -(-tokens // range_tokens))
        return Shape(min(63, 20 + max(tokens, 2).bit_length()), min(cuts, fan), -(-cuts // fan))


def _cut(words: tuple, grams: tuple, bits: int, first: int, last: int, cuts: int) -> Iterator[tuple]:
    """(number, words, word_counts, grams, gram_counts) of every part from ``first`` to ``last`` - 1 that holds keys."""
    w, g = (np.append(0, _ranges(k[0], n, first, last, cuts)) for k, n in ((words, 64), (grams, bits)))
    for i in range(last - first):
        a, b, x, y = w[i], w[i + 1], g[i], g[i + 1]
        if a < b or x < y:
            yield first + i, _pack(words[0][a:b]), _pack_counts(words[1][a:b]), _pack(grams[0][x:y]), _pack_counts(grams[1][x:y])


def requests(blocks: DataFrame, shape: Shape) -> DataFrame:
    """What each block sends to each coarse range: its sorted keys and their counts in the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                block = Block(row, 64 - shape.bits)
                words, grams = block.own()
                rows = [(i, row.block, *x) for i, *x in _cut((block.word_keys, words), (block.gram_keys, grams), shape.bits, 0, shape.coarse, shape.coarse)]
                yield pd.DataFrame(rows, columns=["range", "sender", "words", "word_counts", "grams", "gram_counts"])

    return blocks.mapInPandas(run, f"range long, sender long, {_KEYED}")


def _merged(keys: pd.Series, counts: pd.Series) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys with their summed counts, and where each sender's keys are among them."""
    lists = [_unpack(x) for x in keys]
    distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unpack_counts(x) for x in counts]), minlength=len(distinct)).astype(np.int64)
    return distinct, total, np.split(at, np.cumsum([len(x) for x in lists])[:-1])


def _answers(keep: bool):
    """Corpus counts of a range's keys, in the order in which each sender asked; v and n: its distinct and all training words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words, word_total, word_at = _merged(rows["words"], rows["word_counts"])
        grams, gram_total, gram_at = _merged(rows["grams"], rows["gram_counts"])
        out = [(r, s, None, _pack_counts(word_total[w]), None, _pack_counts(gram_total[g]), 0, 0) for r, s, w, g in zip(rows["range"], rows["sender"], word_at, gram_at, strict=True) if s >= 0]
        w, g = word_total > 0, gram_total > 0
        kept = (_pack(words[w]), _pack_counts(word_total[w]), _pack(grams[g]), _pack_counts(gram_total[g])) if keep else (None,) * 4
        out.append((rows["range"].iloc[0], -1, *kept, int(w.sum()), int(word_total.sum())))
        return pd.DataFrame(out, columns=["range", "sender", "words", "word_counts", "grams", "gram_counts", "v", "n"])

    return run


def _ask(asked: DataFrame, shape: Shape, path: str, model: DataFrame | None, keep: bool, teams: int) -> DataFrame:
    """(sender, range, word_counts, gram_counts) for every row of ``asked``, and rows of sender -1 with what the ranges hold."""
    schema = f"range long, sender long, {_KEYED}, v long, n long"
    if shape.fine == 1:
        rows = asked if model is None else asked.unionByName(model)
        return land(rows.groupBy("range").applyInPandas(_answers(keep), schema), f"{path}/answers")
    asked = land(asked.withColumn("team", F.pmod(F.xxhash64("sender"), F.lit(teams))), f"{path}/asked")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        words, grams = _merged(rows["words"], rows["word_counts"]), _merged(rows["grams"], rows["gram_counts"])
        at, team = int(rows["range"].iloc[0]), int(rows["team"].iloc[0])
        out = [(i, team, *x) for i, *x in _cut(words[:2], grams[:2], shape.bits, at * shape.fine, (at + 1) * shape.fine, shape.coarse * shape.fine)]
        return pd.DataFrame(out, columns=["range", "sender", "words", "word_counts", "grams", "gram_counts"])

    fine = asked.groupBy("range", "team").applyInPandas(merge, f"range long, sender long, {_KEYED}")
    found = land((fine if model is None else fine.unionByName(model)).groupBy("range").applyInPandas(_answers(keep), schema), f"{path}/fine")

    def pass_on(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("fine")
        totals = [np.concatenate([_unpack_counts(x) for x in right[c]]) for c in ("word_counts", "gram_counts")]
        word_at, gram_at = _merged(left["words"], left["word_counts"])[2], _merged(left["grams"], left["gram_counts"])[2]
        out = [(r, s, _pack_counts(totals[0][w]), _pack_counts(totals[1][g])) for r, s, w, g in zip(left["range"], left["sender"], word_at, gram_at, strict=True)]
        return pd.DataFrame(out, columns=["range", "sender", "word_counts", "gram_counts"])

    got = found.filter("sender >= 0").select(F.floor(F.col("range") / shape.fine).alias("range"), F.col("sender").alias("team"), F.col("range").alias("fine"), "word_counts", "gram_counts")
    passed = asked.groupBy("range", "team").cogroup(got.groupBy("range", "team")).applyInPandas(pass_on, "range long, sender long, word_counts binary, gram_counts binary")
    return land(passed.unionByName(found.filter("sender < 0"), allowMissingColumns=True), f"{path}/answers")


class Automaton:
    """The states, arcs and failure arcs that one block's documents can reach.

    States are the words (by their number in the block), the pairs (behind the words) and the root. The arcs of words
    and pairs are sorted by (state, word read), each with its ``target``; the root has an arc for every word; ``failure``
    is where a state's failure arc leads. Transitions are numbered: arcs, the root's arcs, then failure arcs by state.
    """

    def __init__(self, block: Block, words: np.ndarray, grams: np.ndarray, n: int, v: int) -> None:
        self.block = block
        self.words, counts = np.empty(len(words), np.float64), np.empty(len(grams), np.float64)
        self.words[block.word_order], counts[block.gram_order] = words, grams
        self.pairs, self.triples = counts[: len(block.pair_word)], counts[len(block.pair_word) :]
        self.after = self.words.copy()
        self.after[1] = self.words[0]  # a document has one start and one end
        self.size = n + v + 1.0
        self.root = (self.words + 1) / self.size
        self.root_arc = np.log10(self.root)
        width = len(self.words)
        self.top = width + len(self.pairs)
        known, self.pair_arcs, self.triple_arcs = np.arange(width), np.flatnonzero(self.pairs > 0), np.flatnonzero(self.triples > 0)
        read = block.pair_word[block.triple_pair[self.triple_arcs]]
        keys = block.pair_history[self.pair_arcs] * width + block.pair_word[self.pair_arcs], (width + block.triple_history[self.triple_arcs]) * width + read
        self.key = np.concatenate((*keys, [np.iinfo(np.int64).max]))  # never found: there is a key behind all others
        self.target = width + np.concatenate((self.pair_arcs, block.triple_pair[self.triple_arcs]))
        self.root_target = np.where(self.words > 0, known, self.top)
        self.failure = np.concatenate((np.full(width, self.top), block.pair_word))

    def weights(self, masses: tuple[float, float]) -> np.ndarray:
        """The weight of every transition under given masses."""
        b, (one, two) = self.block, masses
        seen = (self.pairs + one * self.root[b.pair_word]) / (self.after[b.pair_history] + one)
        at = self.triple_arcs
        triple = (self.triples[at] + two * seen[b.triple_pair[at]]) / (self.pairs[b.triple_history[at]] + two)
        return np.concatenate((np.log10(seen[self.pair_arcs]), np.log10(triple), self.root_arc, np.log10(one / (self.after + one)), np.log10(two / (self.pairs + two))))

    def left_out(self, masses: tuple[float, float]) -> float:
        """The log likelihood of the block's training tokens, each left out of all counts."""
        b, (one, two) = self.block, masses
        low = np.maximum(self.words[b.pair_word], 1) / max(self.size - 1, 1)
        pair = (np.maximum(self.pairs - 1, 0) + one * low) / (np.maximum(self.after[b.pair_history] - 1, 0) + one)
        triple = (np.maximum(self.triples - 1, 0) + two * pair[b.triple_pair]) / (np.maximum(self.pairs[b.triple_history] - 1, 0) + two)
        return float(np.log10(np.concatenate((pair, triple))) @ b.arc_own)

    def walk(self, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
        """One pass over the tokens from left to right, the state carried from token to token: the document and the
        number of every transition taken.

        Documents go side by side, a token of each at a time; long ones are cut into segments that go side by side too.
        A state is the longest known history of at most two words, so reading the two words before a segment from the
        root leads to the state in which the whole document's pass enters it.
        """
        b, width = self.block, len(self.words)
        per_doc = -(-b.lens // segment)
        doc = np.repeat(np.arange(len(b.lens)), per_doc)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        start = (np.cumsum(b.lens) - b.lens)[doc] + part * segment
        length = np.minimum(b.lens[doc] - part * segment, segment)
        order = np.argsort(-length, kind="stable")  # those that still have tokens come first
        doc, part, start, length = doc[order].astype(np.int32), part[order], start[order], length[order]
        state = np.where(part > 0, self.top, 1)  # a document begins in the state of its start
        inner = np.flatnonzero(part > 0)
        for back in (2, 1):
            state[inner] = self._read(state[inner], b.word[start[inner] - back], None)
        docs, taken = [], []
        for t in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length, -t, side="left"))
            steps: list[tuple[np.ndarray, np.ndarray]] = []
            state[:active] = self._read(state[:active], b.word[start[:active] + t], steps)
            docs += [doc[who] for who, _ in steps]
            taken += [number.astype(np.int32) for _, number in steps]
        return np.concatenate(docs), np.concatenate(taken)

    def _read(self, state: np.ndarray, word: np.ndarray, steps: list | None) -> np.ndarray:
        """The states after a word is read in each of the given ones: by their arc, or by failure arcs up to a state that has one."""
        state, width, arcs = state.copy(), len(self.words), len(self.key) - 1
        note = steps.append if steps is not None else lambda step: None
        open_ = np.arange(len(state))
        while len(open_):
            at_root = state[open_] == self.top
            done = open_[at_root]
            state[done] = self.root_target[word[done]]
            note((done, arcs + word[done]))
            open_ = open_[~at_root]
            key = state[open_] * width + word[open_]
            at = np.searchsorted(self.key, key)
            hit = self.key[at] == key
            done, open_ = open_[hit], open_[~hit]
            state[done] = self.target[at[hit]]
            note((done, at[hit]))
            note((open_, arcs + width + state[open_]))
            state[open_] = self.failure[state[open_]]
        return state

    def traverse(self, grid: list[tuple[float, float]]) -> np.ndarray:
        """The log-probability of every document under each masses of ``grid``, summed along one walk."""
        docs, taken = self.walk()
        return np.stack([np.bincount(docs, weights=self.weights(m)[taken], minlength=len(self.block.lens)) for m in grid], axis=1)


@dataclass(frozen=True)
class Model:
    """A kept automaton: its n-grams are in a table under ``path``."""

    path: str
    n: int
    v: int
    shape: Shape
    masses: tuple[float, float]

    def save(self, spark: SparkSession) -> None:
        land(spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1), f"{self.path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        found = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        return Model(path, found["n"], found["v"], Shape(**found["shape"]), tuple(found["masses"]))


def _tokens(blocks: DataFrame) -> int:
    return blocks.select(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def _traversed(blocks: DataFrame, answers: DataFrame, shape: Shape, n: int, v: int, grid: list[tuple[float, float]]) -> DataFrame:
    """Per document the score under each masses of ``grid``; a block's first row also has its left-out likelihoods."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples(index=False))
        block = Block(row, 64 - shape.bits)
        right = right.sort_values("range")
        words, grams = (np.concatenate([_unpack_counts(x) for x in right[c]]) for c in ("word_counts", "gram_counts"))
        auto, docs = Automaton(block, words, grams, n, v), len(block.lens)
        by_doc = lambda x: np.bincount(block.doc, weights=x[block.word], minlength=docs)
        scores = auto.traverse(grid)
        return pd.DataFrame({
            "doc_id": pd.array(row.doc_id, dtype="Int64"), "training": row.training, "n_tokens": block.lens, "n_known": by_doc(auto.words > 0).astype(np.int64),
            "base_score": by_doc(auto.root_arc), "scores": list(scores), "left_out": [[auto.left_out(m) for m in grid]] + [None] * (docs - 1),
        })

    sides = answers.filter("sender >= 0").select(F.col("sender").alias("block"), "range", "word_counts", "gram_counts").groupBy("block")
    schema = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>"
    return blocks.groupBy("block").cogroup(sides).applyInPandas(run, schema)


def _columns(scored: DataFrame, at: int, n: int) -> DataFrame:
    return scored.select("doc_id", "training", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("scores")[at].alias("score"))


def fit(
    docs: DataFrame, training: Column, path: str | None = None, block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS, fan: int = FAN, teams: int | None = None
) -> tuple[Model, DataFrame]:
    """Learns from the rows for which ``training`` holds; also scores every row: doc_id, training, n_tokens, n_known,
    train_tokens, base_score, score. With ``path`` the model is kept there for ``score``."""
    spark = docs.sparkSession
    ship(spark)
    work = work_dir(spark, "lm")
    blocks = land(encode(docs, training, block_tokens), f"{work}/blocks")
    shape = Shape.of(_tokens(blocks), range_tokens, fan)
    answers = _ask(requests(blocks, shape), shape, work, None, path is not None, teams or max(1, blocks.count() // fan))
    held = answers.filter("sender < 0")
    v, n = (int(x or 0) for x in held.agg(F.sum("v"), F.sum("n")).first())
    scored = land(_traversed(blocks, answers, shape, n, v, _GRID), f"{work}/scored")
    sums = scored.filter("left_out IS NOT NULL").agg(*[F.sum(F.col("left_out")[i]) for i in range(len(_GRID))]).first()
    best = int(np.argmax([x or 0.0 for x in sums]))
    model = Model(path or "", n, v, shape, _GRID[best])
    if path:
        land(held.select("range", "sender", "words", "word_counts", "grams", "gram_counts"), f"{path}/arcs")
        model.save(spark)
    remove(spark, *(f"{work}/{x}" for x in ("blocks", "answers", "asked", "fine")))
    return model, _columns(scored, best, n)


def score(docs: DataFrame, model: Model, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Scores the rows of any table with a kept model: the columns of ``fit``, training being false."""
    spark = docs.sparkSession
    ship(spark)
    work = work_dir(spark, "lm-score")
    blocks = land(encode(docs, F.lit(False), block_tokens), f"{work}/blocks")
    arcs = spark.read.parquet(f"{model.path}/arcs")
    answers = _ask(requests(blocks, model.shape), model.shape, work, arcs, False, max(1, blocks.count() // FAN))
    scored = land(_traversed(blocks, answers, model.shape, model.n, model.v, [model.masses]), f"{work}/scored")
    remove(spark, *(f"{work}/{x}" for x in ("blocks", "answers", "asked", "fine")))
    return _columns(scored, 0, model.n)
