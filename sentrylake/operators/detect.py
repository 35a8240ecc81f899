"""Keyed detections over events: match, threshold, distinct count and sequence, with de-duplication.

An event can satisfy several rules; one scan turns it into one hit per rule.
What a hit may fire on lies within the rule's window before it, so the hits of
a key are dealt out by time buckets as long as the window and the throttle, and
a bucket's work needs the bucket before it at most: one busy group is the work
of many tasks. Positions within a key are prefix sums of the buckets' counts;
window functions over (key, bucket), one sorted pass for all rules, find
candidates; distinct counts are a pass over each bucket with two ends.

Which candidates are alerts depends on the alert before: a window restarts after
it and the throttle counts from it. Candidates of a key that lie further apart
than window and throttle have nothing to do with each other and make sessions of
their own. A session of one candidate is an alert as it stands. In longer ones
the next alert is the first candidate whose window starts after the last one
and whose time is past the throttle; both grow along the session, so it is
found by bisection: the pass takes a step an alert, not a step a hit, over
sorted numbers that stream through.

Where a sequence from a row on leads depends on that row and one window alone,
so buckets find it side by side; the machine's transitions over whole buckets
are followed one after the other, a step a bucket, and then each bucket gives
the sequences that its entry leads to. What ends is throttled like the rest.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES, canonical_text
from ..functions.timestamps import iso_utc
from ..session import shared_dir, ship
from .conditions import Fields, matches, split_key
from .lists import ListTable, mark
from .rules import Rule

_HITS = "array<struct<rule:int,group:map<string,string>,group_key:string,missing:array<string>,value:string,steps:array<boolean>>>"
_FIRED = "rule int, group_key string, pos long, ts_us long, first long, evidence_count int, picked array<long>, emitted boolean"


def _names(rule: Rule) -> list[str]:
    """The fields that a rule looks at."""
    return ["log_type", *rule.group_by, *([rule.field] if rule.field else []), *(f for f, _ in _tested(rule))]


def _tested(rule: Rule) -> list[tuple[str, object]]:
    """The fields that a rule's conditions test, with what each is held against."""
    groups = [rule.conditions, *rule.any_of, *(s.conditions for s in rule.steps)]
    return [(split_key(k, v)[0], v) for g in groups for k, v in g.items()]


def hits(events: DataFrame, rules: Sequence[Rule], fields: Fields, raw: Column) -> DataFrame:
    """One row per event and rule that it concerns: rule (its order), group, group_key, missing, value, steps, ts_us, seq, raw.

    Match rules put ``unknown`` for a missing group field; other rules name it in
    ``missing``. A sequence rule concerns every event of its log types with a
    complete group, as any of them can end a stale sequence; ``steps`` says which
    steps it satisfies.
    """
    # each field is read out of the event once, however many rules look at it
    names = list(dict.fromkeys(n for r in rules for n in _names(r)))
    at = {n: f"__field{i}" for i, n in enumerate(names)}
    events = events.select("ts_us", "seq", raw.alias("raw"), *[fields(n).alias(c) for n, c in at.items()])
    listed = {v.flag(f): (F.col(at[f]), v) for r in rules for f, v in _tested(r) if isinstance(v, ListTable)}
    for i, n in enumerate(listed):
        at[n] = f"__listed{i}"
    events = mark(events, [(at[n], *x) for n, x in listed.items()])
    fields = lambda n: F.col(at[n])
    made = []
    for r in rules:
        values = [canonical_text(fields(f)) for f in r.group_by]
        steps = [matches(s.conditions, None, None, fields) for s in r.steps]
        missing = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(f)) for f, v in zip(r.group_by, values, strict=True)])) if values else F.array()
        filled = [F.coalesce(v, F.lit("unknown" if r.type == "match" else "")) for v in values]
        group = F.create_map(*[x for f, v in zip(r.group_by, filled, strict=True) for x in (F.lit(f), v)]) if values else F.create_map()
        if r.type == "sequence":
            some = F.exists(F.array(*steps), lambda s: s)
            test = matches(None, None, r.log_types, fields) & ((F.size(missing) == 0) | some)
        else:
            test = matches(r.conditions, list(r.any_of), r.log_types, fields)
        made.append(
            F.when(
                test,
                F.struct(
                    F.lit(r.order).alias("rule"),
                    group.cast("map<string,string>").alias("group"),
                    F.to_json(F.array(*filled)).alias("group_key") if filled else F.lit("").alias("group_key"),
                    (F.array().cast("array<string>") if r.type == "match" else missing.cast("array<string>")).alias("missing"),
                    (canonical_text(fields(r.field)) if r.field else F.lit(None).cast("string")).alias("value"),
                    F.array(*steps).cast("array<boolean>").alias("steps"),
                ),
            )
        )
    found = F.explode(F.array_compact(F.array(*made)) if made else F.array().cast(_HITS))
    return events.select("ts_us", "seq", "raw", found.alias("hit")).select("hit.*", "ts_us", "seq", "raw")


def skipped(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """How many hits each rule left out for want of a group field: rule_id, field, skipped."""
    lost = found.filter(F.size("missing") > 0).select("rule", F.explode("missing").alias("field"))
    return lost.groupBy(_by_rule(rules, lambda r: r.id).alias("rule_id"), "field").agg(F.count(F.lit(1)).alias("skipped"))


def _by_rule(rules: Sequence[Rule], get: Callable[[Rule], object]) -> Column:
    if not rules:
        return F.lit(None).cast("string")
    table = F.create_map(*[x for r in rules for x in (F.lit(r.order), F.lit(get(r)))])
    return F.element_at(table, F.col("rule"))


_BUCKET = ["rule", "group_key", "bucket"]


def _micros(seconds: int) -> int:
    return seconds * 1_000_000


def _width(rule: Rule, dedupe: int) -> int:
    """Microseconds in a time bucket of a rule: what a hit looks back on is no longer."""
    return max(0 if rule.type == "match" else _micros(rule.window), dedupe, 1_000_000)


def _positions(found: DataFrame, rules: Sequence[Rule], dedupe: int) -> DataFrame:
    """Complete hits with their time ``bucket``, numbered from 1 within their key by time and arrival (``pos``)."""
    rows = found.filter(F.size("missing") == 0).withColumn("bucket", F.floor(F.col("ts_us") / _by_rule(rules, lambda r: _width(r, dedupe))).cast("long"))
    counts = rows.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rule", "group_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*_BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*_BUCKET).orderBy("ts_us", "seq"))
    return rows.join(counts, _BUCKET).withColumn("pos", F.col("before") + inside).drop("before")


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, of rows that come sorted by their keys; one key is held at a time."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        turns = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, z in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
            now = tuple(c[a] for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = now
            held.append(b.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _distinct(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``start`` of the hits of distinct-count rules that reach their number of values in the window: the last position
    from which on there are so many. Buckets stream through in order, each with the hits of the one before at its head."""
    ship(rows.sparkSession)
    need = {r.order: (max(1, r.threshold), _micros(r.window)) for r in rules}
    schema = "rule int, group_key string, bucket long, pos long, ts_us long, low long, start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, counts, n, span = None, deque(), Counter(), 0, 0
        for b in batches:
            picked, starts = [], []
            columns = [b.column(c).to_pylist() for c in (*_BUCKET, "pos", "ts_us", "value", "own")]
            for i, (rule, group, bucket, pos, ts, value, own) in enumerate(zip(*columns, strict=True)):
                if key != (rule, group, bucket):
                    key, held, counts, (n, span) = (rule, group, bucket), deque(), Counter(), need[rule]
                held.append((pos, ts, value))
                if value is not None:
                    counts[value] += 1
                # a hit goes when the window has left it, or the others are enough without it
                while held[0][1] < ts - span or len(counts) > n or len(counts) == n and (held[0][2] is None or counts[held[0][2]] > 1):
                    old = held.popleft()[2]
                    if old is not None:
                        counts[old] -= 1
                        if not counts[old]:
                            del counts[old]
                if own and len(counts) >= n:
                    picked.append(i)
                    starts.append(held[0][0])
            kept = b.take(pa.array(picked, pa.int64()))
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names[:-1]), pa.array(starts, pa.int64())], names)

    rows = rows.select(*_BUCKET, "pos", "ts_us", "low", "value", "own")
    return rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "pos").mapInArrow(run, schema)


_RUNS = "rule int, group_key string, session long, bucket long, pos long, leaves long, ends long, ts_us long, picked array<long>, upto array<long>, exits array<long>"


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).to_numpy()


def _runs(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What becomes of a sequence from each row that could begin one, and what that makes of each bucket.

    A sequence that begins at a row either ends within its window or is given up at the first row past it, so where it
    ``leaves`` the machine empty depends on that row and the bucket after its own alone. Following these from any row of
    a bucket on leads out of it: the transition of a bucket is kept as ``exits``, by the last beginning (``upto``) that
    leads to each. Rows with a transition have no ``pos``, others have one.
    """
    ship(rows.sparkSession)
    plans = {r.order: ([i for i, s in enumerate(r.steps) for _ in range(max(1, s.count))], _micros(r.window)) for r in rules}
    schema = pa.schema([
        ("rule", pa.int32()), ("group_key", pa.string()), ("session", pa.int64()), ("bucket", pa.int64()), ("pos", pa.int64()), ("leaves", pa.int64()), ("ends", pa.int64()),
        ("ts_us", pa.int64()), ("picked", pa.list_(pa.int64())), ("upto", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64())),
    ])

    def batch(made: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The beginnings and the transitions of many buckets, each as one batch."""
        keys, pos, leaves, ends, done, ts, flat, upto, exits = zip(*made, strict=True)
        sizes = np.array([len(x) for x in pos])
        lists = lambda values, lengths: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(np.concatenate(values)))
        named = [pa.array(x, f.type) for x, f in zip(zip(*keys, strict=True), schema, strict=False)]
        at, m = pa.array(np.repeat(np.arange(len(made)), sizes)), int(sizes.sum())
        none = pa.nulls(m, pa.list_(pa.int64()))
        widths = np.concatenate([np.full(len(x), len(f) // max(1, len(x))) for x, f in zip(pos, flat, strict=True)])
        yield pa.RecordBatch.from_arrays([
            *(x.take(at) for x in named), pa.array(np.concatenate(pos)), pa.array(np.concatenate(leaves)), pa.array(np.concatenate(ends), mask=~np.concatenate(done)),
            pa.array(np.concatenate(ts)), lists(flat, widths), none, none,
        ], schema=schema)
        lone, turns = pa.nulls(len(made), pa.int64()), [len(x) for x in upto]
        yield pa.RecordBatch.from_arrays([*named, lone, lone, lone, lone, pa.nulls(len(made), pa.list_(pa.int64())), lists(upto, turns), lists(exits, turns)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (rule, group, bucket), t in _groups(batches, _BUCKET):
            plan, span = plans[rule]
            pos, ts, own = _numbers(t, "pos"), _numbers(t, "ts_us"), t.column("own").to_numpy()
            n, steps = len(pos), t.column("steps").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(pos), -1)
            begins = np.flatnonzero(steps[:, plan[0]] & own)
            if not len(begins):
                continue
            at = [np.append(np.flatnonzero(steps[:, i]), n) for i in range(steps.shape[1])]
            stale = np.searchsorted(ts, ts[begins] + span, "right")
            met = [begins]
            for i in plan[1:]:
                met.append(at[i][np.minimum(np.searchsorted(at[i], met[-1], "right"), len(at[i]) - 1)])
            done = met[-1] < stale
            leaves = np.where(done, met[-1] + 1, stale)
            # the next beginning within the bucket, and by doubling the last one that is reached
            after = np.searchsorted(begins, leaves, "left")
            last = np.where(after == len(begins), np.arange(len(begins)), np.minimum(after, len(begins) - 1))
            while not np.array_equal(further := last[last], last):
                last = further
            exits = leaves[last] + pos[0]
            turns = np.append(np.flatnonzero(exits[1:] != exits[:-1]), len(exits) - 1)
            end = np.where(done, met[-1], 0)
            flat = np.where(done[:, None], np.stack(met, 1), 0) + pos[0]
            key = (rule, group, int(t.column("session")[0].as_py()), bucket)
            held.append((key, pos[begins], leaves + pos[0], end + pos[0], done, ts[end], flat.ravel(), pos[begins][turns], exits[turns]))
            size += len(begins)
            if size >= 20_000:
                yield from batch(held)
                held, size = [], 0
        if held:
            yield from batch(held)

    copies = F.explode(F.array(*[F.struct((F.col("bucket") - i).alias("bucket"), F.lit(i == 0).alias("own")) for i in (0, 1)]))
    rows = rows.select("rule", "group_key", "session", copies.alias("at"), "pos", "ts_us", "steps").select("rule", "group_key", "session", "at.*", "pos", "ts_us", "steps")
    return rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "pos").mapInArrow(run, _RUNS)


def _entered(runs: DataFrame) -> DataFrame:
    """From which position on the machine is empty in each bucket (``entry``): the transitions of a session's buckets, one after the other."""
    keys = ["rule", "group_key", "session"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for b in batches:
            entry = []
            for rule, group, session, upto, exits in zip(*(b.column(c).to_pylist() for c in (*keys, "upto", "exits")), strict=True):
                if key != (rule, group, session):
                    key, at = (rule, group, session), 0
                entry.append(at)
                i = int(np.searchsorted(upto, at))
                at = exits[i] if i < len(exits) else at
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _BUCKET), pa.array(entry, pa.int64())], [*_BUCKET, "entry"])

    rows = runs.filter("pos IS NULL").select(*keys, "bucket", "upto", "exits")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "bucket").mapInArrow(run, "rule int, group_key string, bucket long, entry long")


def _completed(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The sequences that ``rows`` of sessions make, whether throttled or not: rule, group_key, bucket, pos, ts_us, picked."""
    runs = _once(_runs(rows, rules))  # for the buckets' transitions and for the sequences
    schema = "rule int, group_key string, bucket long, pos long, ts_us long, picked array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, t in _groups(batches, _BUCKET):
            pos, i = _numbers(t, "pos"), int(np.searchsorted(_numbers(t, "pos"), t.column("entry")[0].as_py()))
            after, taken = np.searchsorted(pos, _numbers(t, "leaves"), "left").tolist(), []
            ended = t.column("ends").is_valid().to_numpy()
            while i < len(pos):  # a step a sequence
                if ended[i]:
                    taken.append(i)
                i = after[i]
            if taken:
                held.append(t.take(pa.array(taken, pa.int64())).select([*_BUCKET, "ends", "ts_us", "picked"]).rename_columns([c.split()[0] for c in schema.split(", ")]))
                size += len(taken)
            if size >= 20_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    placed = runs.filter("pos IS NOT NULL").drop("upto", "exits", "session").join(_entered(runs), _BUCKET)
    return placed.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "pos").mapInArrow(run, schema)


def _chained(rows: DataFrame, dedupe: int) -> DataFrame:
    """The attempted alerts among candidates (pos, ts_us, low, start) of sessions, which stream through in order.

    Attempts are the candidates whose window starts after the last alert; of these the first past the throttle is the next.
    """
    ship(rows.sparkSession)
    keys = ["rule", "group_key", "session"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, after, last = None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            rule, session, pos, ts, low, start = (b.column(n).to_numpy() for n in ("rule", "session", "pos", "ts_us", "low", "start"))
            group = b.column("group_key").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((rule[1:] != rule[:-1]) | (session[1:] != session[:-1]) | (group[1:] != group[:-1])) + 1
            tried, emitted, since = np.zeros(len(pos), bool), np.zeros(len(pos), bool), np.zeros(len(pos), np.int64)
            for a, z in zip([0, *turns.tolist()], [*turns.tolist(), len(pos)], strict=True):
                if key != (rule[a], group[a], session[a]):
                    key, after, last = (rule[a], group[a], session[a]), 0, None
                while a < z:
                    a += int(np.searchsorted(start[a:z], after, "right"))
                    to = a if last is None else a + int(np.searchsorted(ts[a:z], last + dedupe, "left"))
                    end = min(to + 1, z)
                    tried[a:end], since[a:end] = True, after
                    if to < z:
                        emitted[to], after, last = True, int(pos[to]), int(ts[to])
                    a = end
            first = np.maximum(since, low)[tried]
            kept = b.filter(pa.array(tried))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(n) for n in ("rule", "group_key", "pos", "ts_us")), pa.array(first), pa.array((pos[tried] - first).astype(np.int32)), kept.column("picked"), pa.array(emitted[tried])],
                [c.split()[0] for c in _FIRED.split(", ")],
            )

    rows = rows.select(*keys, "pos", "ts_us", "low", "start", "picked")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(run, _FIRED)


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` written to a shared folder and read from there, for what is used several times and dear to make."""
    path = shared_dir(rows.sparkSession, "hits")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _sessions(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``session`` and whether they are ``alone`` in it. A session is a run of buckets that hold rows:
    a bucket is as long as window and throttle, so rows with an empty one between them have nothing to do with each other."""
    key = Window.partitionBy("rule", "group_key").orderBy("bucket")
    begun = F.when(F.coalesce(F.col("bucket") - F.lag("bucket").over(key) > 1, F.lit(True)), F.col("bucket"))
    runs = rows.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("n")).withColumn("begun", begun)
    runs = runs.withColumn("session", F.max("begun").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("alone", F.sum("n").over(Window.partitionBy("rule", "group_key", "session")) == 1)
    return rows.join(runs.drop("n", "begun"), _BUCKET)


def candidates(placed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Hits of match, threshold and distinct-count rules that could fire: rule, group_key, bucket, pos, ts_us, low (the last
    position that the window has left behind) and start (where the hits that make it fire begin)."""
    of = lambda rs: F.col("rule").isin([r.order for r in rs])
    values = [r for r in rules if r.type == "distinct_count"]
    many = [r for r in rules if r.type == "threshold" and r.threshold > 1]
    shown = [*_BUCKET, "pos", "ts_us", "low", "start"]
    # hits of rules that look back go to the next bucket too
    next_one = F.when(of([*many, *values]), F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(False).alias("own")))
    copies = F.explode(F.array_compact(F.array(F.struct(F.col("bucket"), F.lit(True).alias("own")), next_one)))
    rows = placed.select("rule", "group_key", copies.alias("at"), "pos", "ts_us", "value").select("rule", "group_key", "at.bucket", "at.own", "pos", "ts_us", "value")
    here = Window.partitionBy(*_BUCKET)
    back, first = F.lit(None).cast("long"), F.col("pos")
    for n in sorted({r.threshold for r in many}):
        back = F.when(of([r for r in many if r.threshold == n]), F.lag("ts_us", n - 1).over(here.orderBy("ts_us", "pos"))).otherwise(back)
    for window in sorted({r.window for r in [*many, *values]}):
        mine = of([r for r in [*many, *values] if r.window == window])
        first = F.when(mine, F.min("pos").over(here.orderBy("ts_us").rangeBetween(-_micros(window), 0))).otherwise(first)
    rows = rows.withColumn("back", back).withColumn("low", first - 1)
    near = F.coalesce(F.col("ts_us") - F.col("back") <= _by_rule(rules, lambda r: _micros(r.window)), F.lit(False)) if many else F.lit(False)
    fits = F.col("own") & F.when(of(many), near).otherwise(~of(values))
    start = F.col("pos") - F.when(of(many), _by_rule(rules, lambda r: r.threshold) - 1).otherwise(0)
    made = rows.filter(fits).withColumn("start", start.cast("long")).select(shown)
    return made.unionByName(_distinct(rows.filter(of(values)), values).select(shown)) if values else made


def fire(found: DataFrame, rules: Sequence[Rule], dedupe_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Numbered hits, and the attempted alerts: emitted ones and suppressed ones."""
    dedupe = _micros(dedupe_seconds)
    placed = _positions(found, rules, dedupe)
    steps, others = [r for r in rules if r.type == "sequence"], [r for r in rules if r.type != "sequence"]
    plain = lambda rows: rows.select(
        "rule", "group_key", "pos", "ts_us", F.col("low").alias("first"), (F.col("pos") - F.col("low")).cast("int").alias("evidence_count"),
        "picked", F.lit(True).alias("emitted"),
    )
    none = lambda rows: rows.withColumn("picked", F.lit(None).cast("array<long>"))
    fired = []
    if free := [] if dedupe else [r for r in others if r.type == "match"]:  # without a throttle every hit is an alert
        fired.append(plain(none(candidates(placed.filter(F.col("rule").isin([r.order for r in free])), free))))
    if bound := [r for r in others if r not in free]:
        rows = _sessions(none(candidates(placed.filter(F.col("rule").isin([r.order for r in bound])), bound)))
        fired += [plain(rows.filter("alone")), _chained(rows.filter("NOT alone"), dedupe)]
    if steps:
        rows = placed.filter(F.col("rule").isin([r.order for r in steps])).select(*_BUCKET, "pos", "ts_us", "steps")
        rows = _sessions(_once(rows))
        last = F.coalesce(F.get("steps", _by_rule(steps, lambda r: max(0, len(r.steps) - 1))), F.lit(False))
        rows = rows.withColumn("ends", F.max(last).over(Window.partitionBy("rule", "group_key", "session"))).filter("ends")
        made = _completed(rows, steps).withColumn("low", F.col("pos") - 1).withColumn("start", F.col("pos"))
        if dedupe:
            # the bucket is that of the beginning; what ends in the next one belongs there
            made = _once(made.withColumn("bucket", F.floor(F.col("ts_us") / _by_rule(steps, lambda r: _width(r, dedupe))).cast("long")))
            made = _sessions(made)
            made = plain(made.filter("alone")).unionByName(_chained(made.filter("NOT alone"), dedupe))
        else:  # without a throttle every sequence is an alert
            made = plain(made)
        fired.append(made.withColumn("first", F.col("pos") - 1).withColumn("evidence_count", F.size("picked")))
    if not fired:
        return placed, plain(none(candidates(placed, [])))
    return placed, reduce(DataFrame.unionByName, fired)


def active(rules: Sequence[Rule], min_severity: str = "low") -> list[Rule]:
    """Rules at or above a severity. The others can neither alert nor change what alerts."""
    return [r for r in rules if SEVERITIES.index(r.severity) >= SEVERITIES.index(min_severity)]


def described(fired: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alerts (rule, group_key, ts_us, pos, evidence_count, evidence) with all that their rules say.

    ``alert_id`` is a hash of rule, group, time and place, so that it is the same in every run.
    """
    get = lambda f: _by_rule(rules, f)

    def listed(of: Callable[[Rule], Sequence[str]]) -> Column:
        lists = [x for r in rules for x in (F.lit(r.order), F.array(*map(F.lit, of(r))).cast("array<string>"))]
        return F.element_at(F.create_map(*lists), F.col("rule")) if lists else F.array().cast("array<string>")

    values = F.coalesce(F.from_json("group_key", "array<string>"), F.array().cast("array<string>"))
    return fired.select(
        F.substring(F.sha2(F.concat_ws("|", get(lambda r: r.id), "group_key", "ts_us", "pos"), 256), 1, 8).alias("alert_id"),
        get(lambda r: r.id).alias("rule_id"), get(lambda r: r.name).alias("rule_name"), get(lambda r: r.severity).alias("severity"),
        get(lambda r: r.description).alias("description"), get(lambda r: r.recommendation).alias("recommendation"), listed(lambda r: r.mitre).alias("mitre"),
        F.map_from_arrays(listed(lambda r: r.group_by), values).alias("group"), "group_key", iso_utc(F.col("ts_us")).alias("event_time"),
        F.timestamp_micros("ts_us").alias("event_ts"), "evidence_count", "evidence",
    )


def alerts(found: DataFrame, rules: Sequence[Rule], dedupe_seconds: int = 120, evidence_limit: int = 5, min_severity: str = "low") -> DataFrame:
    """Alerts in the order (time, arrival, rule)."""
    rules = active(rules, min_severity)
    return alerts_of(*fire(found.filter(F.col("rule").isin([r.order for r in rules])), rules, dedupe_seconds), rules, evidence_limit)


def alerts_of(placed: DataFrame, fired: DataFrame, rules: Sequence[Rule], evidence_limit: int = 5) -> DataFrame:
    """Alerts of what ``fire`` gives. Evidence is the last ``evidence_limit`` events; 0 means all of them."""
    last = max(1, evidence_limit)
    lowest = F.greatest(F.col("first") + 1, F.col("pos") - (evidence_limit - 1 if evidence_limit else 1 << 40))
    picked = F.slice("picked", -F.least(F.size("picked"), F.lit(last)), F.lit(last)) if evidence_limit else F.col("picked")
    wanted = fired.filter("emitted").withColumn("at", F.explode(F.when(F.col("picked").isNotNull(), picked).otherwise(F.sequence(lowest, F.col("pos")))))
    shown = placed.select("rule", "group_key", F.col("pos").alias("at"), "raw", F.col("seq").alias("at_seq"))
    one = wanted.join(shown, ["rule", "group_key", "at"]).groupBy("rule", "group_key", "pos", "ts_us", "evidence_count").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]).alias("evidence"), F.max("at_seq").alias("seq")
    )
    return described(one.orderBy("ts_us", "seq", "rule"), rules)


def suppressed(found: DataFrame, rules: Sequence[Rule], dedupe_seconds: int = 120) -> DataFrame:
    """How many alerts of each rule the throttle held back: rule_id, suppressed."""
    return suppressed_of(fire(found, rules, dedupe_seconds)[1], rules)


def suppressed_of(fired: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    lost = fired.filter(~F.col("emitted"))
    return lost.groupBy(_by_rule(rules, lambda r: r.id).alias("rule_id")).agg(F.count(F.lit(1)).alias("suppressed"))


def summary(fired: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alert counts, of what ``fire`` gives, by severity (critical first) and by rule (most first, then by id): section, name, alerts."""
    by_rule = fired.filter("emitted").groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"))
    by_rule = by_rule.select(_by_rule(rules, lambda r: r.id).alias("id"), _by_rule(rules, lambda r: r.severity).alias("severity"), "alerts")
    rank = F.array_position(F.array(*map(F.lit, reversed(SEVERITIES))), F.col("severity"))
    both = F.explode(F.array(
        F.struct(F.lit("severity").alias("section"), F.col("severity").alias("name"), rank.cast("long").alias("k")),
        F.struct(F.lit("rule").alias("section"), F.col("id").alias("name"), F.lit(0).cast("long").alias("k")),
    ))
    counted = by_rule.select(both.alias("x"), "alerts").groupBy("x.section", "x.name", "x.k").agg(F.sum("alerts").alias("alerts"))
    k = F.when(F.col("section") == "rule", -F.col("alerts")).otherwise(F.col("k"))
    return counted.orderBy(F.desc("section"), k, "name").select("section", "name", "alerts")
