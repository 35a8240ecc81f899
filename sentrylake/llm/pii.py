"""Personal data: fixed rules, and candidates judged by gradient-boosted trees.

The rules find e-mail addresses, IP addresses, card and phone numbers; their
spans always stand. Generators of high recall propose further spans, which may
overlap each other: obfuscated addresses, phone numbers without a plus sign,
IPv6 addresses and card numbers with other separators. Boosted trees, fitted in
numpy to labelled candidates by logistic loss, score each on its format and its
surroundings; Platt scaling calibrates the scores and every kind has the
threshold that reached ``PRECISION`` on candidates left out of training. Of
accepted candidates that overlap the better one stays, of equally good ones the
one proposed first; a rule's span of any kind goes before a candidate.

Spans are kind:start:end in code points, end exclusive, ordered by start and
then kind as in ``KINDS``. Null and empty texts have none. Whole texts of any
length are read; repeated rows get one result each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import map_texts

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES, DEPTH, RATE = 60, 3, 0.2
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            last = domain.end()
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """What the rules find, ordered."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_GENERATORS = [
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+")),
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+ dot [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)*")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[. /_-]{1,2}[0-9]{4}){2,3}(?:[. /_-]{1,2}[0-9]{1,3})?(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+.])[0-9]{9,11}(?![0-9.])")),
]
_FIRST = (re.compile(r"[\[(]at[\])]"), re.compile(r" at [A-Za-z0-9-]+ dot "))
_NEAR = [
    re.compile(p, re.I)
    for p in (
        r"\b(tel|phone|call|mobile|cell|fax|whatsapp|dial)\b", r"\b(e-?mail|contact|write|reach|mail)\b", r"\b(ip|host|server|client|addr(ess)?|from)\b",
        r"\b(card|visa|mastercard|amex|credit|payment|pan)\b", r"\b(order|invoice|ref|no|nr|version|page|isbn|item|lot|serial|id|sku|date|time|mac)\b",
    )
]


def candidates(text: str) -> list[Span]:
    """All proposed spans; they may overlap."""
    out = []
    for i, (kind, pattern) in enumerate(_GENERATORS):
        if i < 2 and not _FIRST[i].search(text):  # a cheap test: addresses are rare
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = _DIGITS.findall(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), len(groups), max(groups), min(groups), len(set(digits)),
        s.count("-"), s.count("."), s.count(" "), s.count(":"), float("(" in s), float("/" in s),
        *(float(bool(p.search(before))) for p in _NEAR),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in (":", "=", "-")),
        float(bool(digits) and luhn("".join(digits))), float(bool(re.match(r"(19|20)[0-9]{2}[-/.]", s))),
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays (tree, node)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        for _ in range(DEPTH):
            right = x[np.arange(len(x))[:, None], self.feature[tree, node]] > self.cut[tree, node]
            node = 2 * node + 1 + right
        return self.bias + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting with logistic loss and Newton leaf values, splits at up to 16 quantiles."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]
    inner, bias = 2**DEPTH - 1, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.zeros((TREES, inner)), np.zeros((TREES, inner + 1))
    score = np.full(len(y), bias)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-9
            g, h = grad[rows].sum(), hess[rows].sum()
            for j, at in enumerate(cuts if len(rows) else []):
                for c in at:
                    right = x[rows, j] > c
                    gr, hr = grad[rows][right].sum(), hess[rows][right].sum()
                    gain = gr**2 / (hr + 1) + (g - gr) ** 2 / (h - hr + 1) - g**2 / (h + 1)
                    if gain > best:
                        best, feature[t, k], cut[t, k] = gain, j, c
            node[rows] = 2 * k + 1 + (x[rows, feature[t, k]] > cut[t, k])
        for leaf in range(inner + 1):
            rows = node == inner + leaf
            value[t, leaf] = RATE * grad[rows].sum() / (hess[rows].sum() + 1)
            score[rows] += value[t, leaf]
    return Trees(feature, cut, value, bias)


def labelled_candidates(rows: int = 1600, seed: int = 11) -> list[tuple[str, int]]:
    """Sentences with one candidate each and whether it is personal, in the forms that people and systems write."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: pick("anna", "jo.berg", "m_silva", "lee", "info", "k.novak", "sales", "pat99")
    site = lambda: pick("example", "mail-host", "uni", "post", "web", "corp")
    top = lambda: pick("com", "org", "net", "de", "fr", "es")
    filler = lambda: " ".join(pick("the", "and", "with", "from a", "this", "of", "est", "der", "que", "on") for _ in range(rng.integers(1, 4)))

    def card() -> str:
        body = "4" + digits(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def quad(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    makers = [
        (1, lambda: f"{pick('write to', 'contact', 'mail', filler())} {name()}{pick(' (at) ', '[at]', ' [at] ', '(at)')}{site()}{pick('.', ' (dot) ', '[dot]')}{top()}"),
        (1, lambda: f"{pick('write to', 'e-mail', 'reach me:')} {name()} at {site()} dot {top()}"),
        (1, lambda: f"{pick('call', 'tel:', 'phone', 'mobile', 'fax')} ({digits(3)}) {digits(3)}-{digits(4)}"),
        (1, lambda: f"{pick('call', 'tel.', 'phone:', 'mobile', 'dial')} {digits(3)}{(s := pick('-', '.', ' '))}{digits(3)}{s}{digits(4)}"),
        (1, lambda: f"{pick('call', 'tel', 'phone', 'whatsapp')} 0{digits(9)}"),
        (1, lambda: f"{pick('ip', 'host', 'client address', filler())} fe80:{':'.join(f'{x:x}' for x in rng.integers(256, 65536, 7))}"),
        (1, lambda: f"{pick('card', 'visa', 'credit card:', 'payment')} {quad(card(), pick('.', '/', '_', '  '))}"),
        (0, lambda: f"{pick('date', 'on', 'version', filler())} {pick('19', '20')}{digits(2)}{(s := pick('-', '/', '.'))}{digits(2)}{s}{digits(2)}"),
        (0, lambda: f"{pick('order', 'invoice', 'ref', 'serial', 'item', filler())} {digits(3)}-{digits(3)}-{digits(4)}"),
        (0, lambda: f"{pick('id', 'order', 'sku', 'no', filler())} {digits(pick(9, 10, 11))}"),
        (0, lambda: f"{pick('time', 'at', filler())} {digits(2)}:{digits(2)}:{digits(2)}"),
        (0, lambda: f"{pick('mac', 'device', filler())} {':'.join(f'{x:02x}' for x in rng.integers(0, 256, 6))}"),
        (0, lambda: f"{filler()} {digits(2)} {digits(3)} {digits(3)}"),
        (0, lambda: f"{pick('lot', 'page', 'isbn', filler())} {quad(digits(16), pick('.', '/', '_', '  '))}"),
        (0, lambda: f"{filler()} shop at {site()} dot {pick('the', 'a', 'line')}"),
    ]
    out = []
    for i in range(rows):
        label, make = makers[i % len(makers)]
        out.append((f"{filler()} {make()} {filler()}", label))
    return out


@dataclass
class Model:
    trees: Trees
    scale: tuple[float, float]  # Platt: p = 1 / (1 + exp(-(a * raw + b)))
    threshold: list[float]  # by kind

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.trees.raw(x) + b)))


def train(rows: list[tuple[str, int]]) -> Model:
    x, y, kind = [], [], []
    for text, label in rows:
        for span in candidates(text):
            x.append(features(text, span))
            y.append(label)
            kind.append(span[1])
    x, y, kind = np.array(x, dtype=np.float64), np.array(y, dtype=np.float64), np.array(kind)
    held = np.arange(len(y)) % 4 == 0
    trees = boost(x[~held], y[~held])
    raw, a, b = trees.raw(x[held]), 1.0, 0.0
    for _ in range(200):  # Platt scaling by gradient steps
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a += 0.05 * float(((y[held] - p) * raw).mean())
        b += 0.05 * float((y[held] - p).mean())
    p, threshold = 1 / (1 + np.exp(-(a * raw + b))), []
    for k in range(len(KINDS)):
        mine = kind[held] == k
        cut = 1.0
        for c in np.unique(p[mine])[::-1]:
            chosen = mine & (p >= c)
            if y[held][chosen].mean() < PRECISION:
                break
            cut = float(c)
        threshold.append(max(cut, 0.5))
    return Model(trees, (a, b), threshold)


@cache
def default_model() -> Model:
    return train(labelled_candidates())


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    proposed = candidates(text)
    if not proposed:
        return base, base
    p = model.probability(np.array([features(text, s) for s in proposed], dtype=np.float64))
    taken, added = _union(base), []
    for i in np.argsort(-p, kind="stable"):
        start, kind, end = proposed[i]
        if p[i] < model.threshold[kind]:
            continue
        at = bisect_left(taken, (start, start))
        if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
            continue
        taken.insert(at, (start, end))
        added.append(proposed[i])
    return base, sorted(base + added)


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans cover, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, a count for each kind of what the rules find, base_sha256 and spans."""
    model = model or default_model()

    def run(texts: list) -> tuple:
        found = [find(t, model) for t in texts]
        counts = [[sum(x[1] == k for x in base) for base, _ in found] for k in range(len(KINDS))]
        return *counts, [hashlib.sha256(_digest(base).encode()).hexdigest() for base, _ in found], [_digest(spans) for _, spans in found]

    added = {f"n_{k}": ("long", pa.int64()) for k in KINDS} | {"base_sha256": ("string", pa.string()), "spans": ("string", pa.string())}
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "text", run, added)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span in text replaced by its kind in brackets; a null text stays null."""
    model, names = model or default_model(), list(docs.columns)

    def run(texts: list) -> tuple:
        out = []
        for t in texts:
            spans, at, parts = find(t, model)[1], 0, []
            for start, kind, end in spans:
                if end > at:
                    parts += [t[at : max(start, at)], f"[{KINDS[kind]}]" if start >= at else ""]
                    at = end
            out.append(t if t is None else "".join(parts) + t[at:])
        return (out,)

    made = map_texts(docs, [c for c in names if c != "text"], "text", run, {"text": ("string", pa.string())})
    return made.select(*[f"`{c}`" for c in names])
