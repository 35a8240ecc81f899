"""Language identification by averaged hashed subword embeddings.

A text is the bag of its lower-cased byte 2- to 4-grams, each hashed into one of
``BUCKETS`` embedding rows; their average goes through a linear softmax. Both
layers are trained by stochastic gradient descent in numpy on labelled rows. A
temperature fitted on rows that training left out calibrates the score.

A softmax cannot tell a text of no learned language, so rejection looks at how
usual a text's n-grams are: the mean log probability of its buckets, in the
learned language where that is highest. The bound is calibrated on the rows
left out against the same rows scored without their own language and against
random letters and symbols: three quarters of the way down to those where they
are apart, else where ``_REJECTED`` of the known rows fall below it. Words with a digit (numbers,
keys, addresses) belong to no language and do not count there while other words
are left. A score below half of what that share of the correctly predicted rows
fall short of is rejected too.

Training uses at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_CHARS``
characters (documented bounds), of every language as many, those with the
smallest hash; so a rare language is learned from all its rows. Whole texts are
used, in training and in prediction, where they may be of any length. A null
text, or one without a letter, is ``und`` with score 0 and rejected. Without any
labelled row everything is ``und``. Of equally likely languages the first by
name is taken. Empty tables give empty results, repeated rows one result each,
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .util import map_texts

BUCKETS = 1 << 15
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
_DIM = 16
_EPOCHS = 6
_STEP = 1 << 18
_GRAMS = (2, 3, 4)
#: The share of held-out rows of known languages that may be rejected.
_REJECTED = 0.001
#: The share of foreign and junk rows that is to fall below the bound.
_FOREIGN = 0.99
_JUNK_ROWS = 200
_JUNK = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 {}()[]<>;:=+-*/@#$%&!?._"


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in pieces of bounded size that overlap by a gram."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8).astype(np.uint32)
    for start in range(0, len(data), _STEP):
        piece = data[start : start + _STEP + _GRAMS[-1] - 1]
        h = np.zeros(len(piece), np.uint32)
        for n in range(1, _GRAMS[-1] + 1):
            m = min(_STEP, len(piece) - n + 1)
            if m <= 0:
                break
            h = h[: len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1 :] + np.uint32(1)
            if n in _GRAMS:
                x = (h[:m] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (x >> np.uint32(17)).astype(np.int64)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_WITH_DIGIT = re.compile(r"\S*?\d\S*")


def _words(text: str) -> str:
    """The text without words that hold a digit, or the whole text if no letter would be left."""
    rest = _WITH_DIGIT.sub(" ", text)
    return rest if rest != text and _has_letter(rest) else text


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # embedding @ softmax weights: one row of logits per bucket
    bias: np.ndarray
    temperature: float
    reject_below: float
    usual: np.ndarray  # log probability of each bucket in each language
    unusual_below: float

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score, and whether the text is rejected."""
        words = _words(text)
        total, usual, n, m = np.zeros(len(self.langs)), np.zeros(len(self.langs)), 0, 0
        for at in buckets_of(text):
            total += self.logits[at].sum(axis=0)
            n += len(at)
            if words is text:
                usual += self.usual[at].sum(axis=0)
                m += len(at)
        for at in buckets_of(words) if words is not text else ():
            usual += self.usual[at].sum(axis=0)
            m += len(at)
        p = _softmax((total / max(n, 1) + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        rejected = p[best] < self.reject_below or usual.max() / max(m, 1) < self.unusual_below
        return self.langs[best], float(p[best]), bool(rejected)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))


def _bound(known: np.ndarray, foreign: np.ndarray) -> float:
    """What a text must reach: all but ``_REJECTED`` of the known rows do; where there is room, three quarters of the way to the foreign rows, as a lost document costs more."""
    low, high = float(np.quantile(known, _REJECTED, method="lower")), float(np.quantile(foreign, _FOREIGN))
    return (low + 3 * high) / 4 if high < low else low


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fits a model to (text, lang) rows; None if there are none."""
    rows = [(t, g) for t, g in rows if _has_letter(t)]
    langs = sorted({g for _, g in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    bags = []
    for text, lang in rows:
        at, n = np.unique(np.concatenate(list(buckets_of(text))), return_counts=True)
        bags.append((at, (n / n.sum()).astype(np.float32), langs.index(lang)))
    order = rng.permutation(len(bags))
    held, used = order[: len(bags) // 5], order[len(bags) // 5 :]
    if not len(held):
        held = used
    emb = rng.uniform(-1 / _DIM, 1 / _DIM, (BUCKETS, _DIM)).astype(np.float32)
    out, bias = np.zeros((_DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = _EPOCHS * len(used), 0
    for _ in range(_EPOCHS):
        for i in rng.permutation(used):
            at, w, y = bags[i]
            rate = 0.5 * (1 - done / steps)
            done += 1
            mean = w @ emb[at]
            grad = _softmax((mean @ out + bias)[None])[0]
            grad[y] -= 1
            back = out @ grad
            out -= rate * np.outer(mean, grad)
            bias -= rate * grad
            # the gradient of an average is small: embeddings step further than the softmax
            emb[at] -= (20 * rate) * w[:, None] * back
    counts = np.zeros((BUCKETS, len(langs)))
    for i in used:
        for at in buckets_of(_words(rows[i][0])):
            np.add.at(counts[:, bags[i][2]], at, 1)
    usual = _log_shares(counts)
    model = Model(langs, emb @ out, bias, 1.0, 0.0, usual.astype(np.float32), 0.0)
    z = np.array([w @ model.logits[at] + bias for at, w, _ in (bags[i] for i in held)])
    y = np.array([bags[i][2] for i in held])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    model.reject_below = float(np.quantile(right, _REJECTED)) / 2 if len(right) else 0.0
    mean = lambda text: usual[np.concatenate(list(buckets_of(_words(text))))].mean(axis=0)
    spread = [(mean(rows[i][0]), bags[i][2]) for i in held]
    others = [np.delete(v, y).max() for v, y in spread if len(langs) > 1]
    letters, junk = np.array(list(_JUNK)), []
    for i in range(_JUNK_ROWS):
        junk.append(mean("".join(rng.choice(letters, 10 + i))).max())
    known = np.array([v.max() for v, y in spread if counts[:, y].any()] or [0.0])
    model.unusual_below = max(_bound(known, np.array(x)) for x in (others, junk) if x) if counts.any() else -np.inf
    return model


def sample(docs: DataFrame, training: Column, rows: int) -> list[tuple[str, str]]:
    """(text, lang) of at most ``rows`` labelled rows for which ``training`` holds, the same number of every language that has so many."""
    known = docs.filter(training & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    known = known.select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("order"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()
    if not counted:
        return []
    each, scale = max(1, rows // len(counted)), 1 << 40
    # a share of each language that holds its smallest hashes for certain, or nearly so
    most = {r.lang: scale if r.n <= 2 * each else int(scale * min(1.0, (each + 8 * each**0.5 + 16) / r.n)) for r in counted}
    chosen = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("lang"))
    near = known.filter(F.coalesce(F.pmod("order", F.lit(scale)) < chosen, F.lit(False)))
    out: dict[str, list] = {g: [] for g in most}
    for r in sorted(near.select(F.pmod("order", F.lit(scale)).alias("order"), "lang", "text").limit(4 * rows + 32 * len(most)).collect()):
        if len(out[r.lang]) < each:
            out[r.lang].append((r.text, r.lang))
    return [x for rs in out.values() for x in rs]


def fit(docs: DataFrame, training: Column, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Trains on a bounded sample of the rows of ``docs`` for which ``training`` holds and lang is known."""
    return train(sample(docs, training, sample_rows))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected."""

    def predict(texts: list) -> tuple:
        got = [model.predict(t) if model and _has_letter(t) else ("und", 0.0, True) for t in texts]
        return [g for g, _, _ in got], [s for _, s, _ in got], [r for _, _, r in got]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(docs, ["doc_id"], "text", predict, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "rejected": ("boolean", pa.bool_())})


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows whose language is rejected; every column passes through."""
    ship(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(model and _has_letter(t) and not model.predict(t)[2]) for t in b.column(text).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
