"""The rules over a stream: keyed state in the state store, alerts as they happen or in the order of time.

Each (rule, group) has its own state: the rows that its fold remembers, in
chunks that are written once and removed whole when the window has left them,
and a record of how many hits there were and when it last alerted. A key's hits
are taken in order of time and arrival, arrivals compared as what they are
(numbers, texts, or structures of them).

By default a micro-batch's hits are taken at once, and a hit older than what its
key has already seen is taken as it comes. With ``ordered`` they wait in the
state until the watermark has passed them, so that any order of arrival within
the lateness gives the alerts of a batch; hits later than that are left out.
State without activity for longer than the rule's window and the throttle is
dropped by a timer, and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import described
from ..operators.folds import fold_of
from ..operators.rules import Rule
from ..session import ship

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_ATTEMPTS = "rule int, group_key string, ts_us long, pos long, evidence_count int, evidence array<string>, emitted boolean"


def _order(x: object) -> object:
    """A sort key for an arrival; a structure is compared field by field."""
    return tuple(_order(v) for v in x.values()) if isinstance(x, dict) else tuple(map(_order, x)) if isinstance(x, tuple | list) else x


_HELD = "ts long, value string, steps array<boolean>, raw string, seq binary"


class RuleProcessor(StatefulProcessor):
    """Attempted alerts of one (rule, group); suppressed ones come out too, marked."""

    def __init__(self, rules: Sequence[Rule], dedupe_seconds: int, evidence_limit: int, slot_us: int | None = None) -> None:
        self.rules = {r.order: r for r in rules}
        self.dedupe, self.limit, self.slot = dedupe_seconds * 1_000_000, evidence_limit, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the rows of a fold are numbered as they are stored; a chunk is named by the number of its first row
        self.chunks = handle.getMapState("chunks", "at long", "rows array<struct<ts:long,value:string,raw:string>>")
        self.mark = handle.getValueState("mark", "pos long, last long, low long, high long, newest long, parts long")
        # hits that wait, by slot of time; each batch adds parts of its own
        self.held = handle.getMapState("held", "slot long, part long", f"rows array<struct<{_HELD.replace(' ', ':').replace(',:', ',')}>>") if self.slot else None

    def _known(self) -> list:
        return list(self.mark.get()) if self.mark.exists() else [0, None, 0, 0, -(1 << 62), 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        hits = ((int(r.ts_us), r.value, r.steps, r.raw, r.seq) for b in rows for r in b.itertuples(index=False))
        if self.slot is None:
            out = self._judge(key, hits, known)
        else:
            slots: dict[int, list] = {}
            for ts, value, steps, raw, seq in hits:
                slots.setdefault(ts // self.slot, []).append((ts, value, [bool(s) for s in steps], raw, pickle.dumps(_order(seq))))
            for slot, part in slots.items():
                self.held.updateValue((slot, known[5]), (part,))
            known[5] += 1
            out = []
        self._remember(key, known)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ATTEMPTS.split(", ")])

    def _judge(self, key, hits: Iterable[tuple], known: list) -> list[tuple]:
        """Takes (ts, value, steps, raw, seq) in order; ``known`` is brought up to date."""
        rule, order = self.rules[key[0]], key[1]
        pos, last, low, high = known[:4]
        chunks = sorted((k[0], v[0]) for k, v in self.chunks.iterator()) if high > low else []
        before = [tuple(r) for at, part in chunks for r in part[max(0, low - at) :]]
        fold, out = fold_of(rule, before), []
        for ts, _, value, steps, raw in sorted(((ts, _order(seq), value, steps, raw) for ts, value, steps, raw, seq in hits), key=lambda h: h[:2]):
            pos += 1
            known[4] = max(known[4], ts)
            found = fold.add(ts, value, steps, raw)
            if found is None:
                continue
            emitted = last is None or ts - last >= self.dedupe
            if emitted:
                last = ts
                fold.restart()
            shown = [r for _, _, r in (found[-self.limit :] if self.limit else found)]
            out.append((key[0], order, ts, pos, len(found), shown if emitted else [], emitted))
        added = list(fold.rows)[max(0, len(before) - fold.gone) :]
        low = min(high, low + fold.gone)
        if added:
            self.chunks.updateValue((high,), (added,))
        for at, part in chunks:
            if at + len(part) <= low:
                self.chunks.removeKey((at,))
        known[:4] = pos, last, low, high + len(added)
        return out

    def _remember(self, key, known: list) -> None:
        """Keeps the record, and one timer: when the next slot is over, or else when the state has been idle for long enough."""
        self.mark.update(tuple(known))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        slots = [k[0] for k in self.held.keys()] if self.slot else []
        end = (min(slots) + 1) * self.slot if slots else known[4] + self.rules[key[0]].window * 1_000_000 + self.dedupe
        self.handle.registerTimer(end // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(k for k in self.held.keys() if (k[0] + 1) * self.slot <= over) if self.slot else []
        if due:
            known = self._known()
            hits = [(ts, value, steps, raw, pickle.loads(seq)) for k in due for ts, value, steps, raw, seq in self.held.getValue(k)[0]]
            for k in due:
                self.held.removeKey(k)
            out = self._judge(key, hits, known)
            self._remember(key, known)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ATTEMPTS.split(", ")])
        elif not (self.slot and any(True for _ in self.held.keys())):
            self.chunks.clear()
            self.mark.clear()


def detect_stream(
    hits: DataFrame, rules: Sequence[Rule], dedupe_seconds: int = 120, evidence_limit: int = 5, lateness: str = "10 minutes", name: str = "detections",
    ordered: bool = False, slot_seconds: int = 1,
) -> DataFrame:
    """Streaming alerts, with the columns of the batch's, of streaming hits (as ``operators.detect.hits`` makes them).

    With ``ordered`` hits wait for the watermark, ``lateness`` after them and up to ``slot_seconds`` more, and are then taken
    in order of time. A ``streaming.sinks.Detections`` of the same ``name`` adds up what was skipped, emitted and suppressed.
    """
    ship(hits.sparkSession)
    seen = hits.observe(f"{name}-hits", F.sum(F.size("missing")).alias("skipped"))
    mine = F.col("rule").isin([r.order for r in rules])  # hits of other rules only count as skipped
    rows = seen.filter(mine & (F.size("missing") == 0)).withColumn("event_ts", F.timestamp_micros("ts_us")).withWatermark("event_ts", lateness)
    rows = rows.select("rule", "group_key", "value", "steps", "ts_us", "seq", "raw", "event_ts")
    processor = RuleProcessor(rules, dedupe_seconds, evidence_limit, slot_seconds * 1_000_000 if ordered else None)
    made = rows.groupBy("rule", "group_key").transformWithStateInPandas(processor, _ATTEMPTS, outputMode="Append", timeMode="EventTime")
    made = made.observe(name, F.count_if("emitted").alias("emitted"), F.count_if(~F.col("emitted")).alias("suppressed"))
    return described(made.filter("emitted"), rules)
