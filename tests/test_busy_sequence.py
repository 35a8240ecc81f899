"""Sequences over buckets against a plain walk: random histories, and one address with half of all hits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import detect
from sentrylake.operators.conditions import of_columns
from sentrylake.operators.folds import Trail
from sentrylake.operators.rules import build_rule


def rule_of(window, *steps):
    made = [{"conditions": {"v": v}, "count": n} for v, n in steps]
    return build_rule({"id": "S", "name": "s", "severity": "low", "type": "sequence", "window": window, "group_by": "key", "steps": made})


def walk(rule, rows, dedupe):
    """(key, time, evidence places, emitted) of every sequence, by the fold of one key."""
    out = []
    for key in sorted({k for _, _, k, _ in rows}):
        fold, last = Trail(rule), None
        for pos, (ts, _, _, v) in enumerate(sorted((r for r in rows if r[2] == key), key=lambda r: r[:2]), 1):
            found = fold.add(ts, None, [c == v for s in rule.steps for c in s.conditions.values()], pos)
            if found is not None:
                emitted = last is None or ts - last >= dedupe * 1_000_000
                last = ts if emitted else last
                out.append((f'["{key}"]', ts, [p for _, _, p in found], emitted))
    return sorted(out)


def through(spark, rule, rows, dedupe):
    d = rows if not isinstance(rows, list) else spark.createDataFrame(rows, "ts_us long, seq long, key string, v string")
    found = detect.hits(d, [rule], of_columns(key=F.col("key"), v=F.col("v")), F.lit("x"))
    fired = detect.fire(found, [rule], dedupe)[1].collect()
    return sorted((r.group_key, r.ts_us, r.picked, r.emitted) for r in fired)


@pytest.mark.parametrize("dedupe", [0, 9])
@pytest.mark.parametrize("steps", [[("a", 1)], [("a", 3)], [("a", 2), ("b", 1)], [("a", 1), ("b", 1), ("a", 1), ("c", 2)]])
def test_random_histories(spark, steps, dedupe):
    rng, rule, rows, t = random.Random(len(steps) + dedupe), rule_of(15 * len(steps), *steps), [], 0
    for i in range(1500):
        t += rng.choice([0, 0, 1, 1, 2, 5, 30 if i % 40 == 0 else 1])
        rows.append((t * 1_000_000 + rng.choice([0, 0, 500_000]), i, rng.choice(["k1", "k2", "k3"]), rng.choice("aabbc")))
    want = walk(rule, rows, dedupe)
    assert through(spark, rule, rows, dedupe) == want and len(want) > 20


def test_no_rows(spark):
    assert through(spark, rule_of(6, ("a", 1), ("b", 1)), [(1, 1, "k", "c")], 5) == []
    assert through(spark, rule_of(6, ("a", 1), ("b", 1)), [], 5) == []


def test_busy_sequence(spark):
    """A key with half of all hits is the work of many buckets."""
    n, rule = 40_000, rule_of(60, ("a", 3), ("b", 1))
    at = (1_700_000_000 + F.col("id")) * 1_000_000
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.format_string("k%d", F.col("id") % 997))
    v = F.when(F.col("id") % 10 == 0, "b").when(F.xxhash64("id") % 3 == 0, "c").otherwise("a")
    rows = spark.range(n).select(at.alias("ts_us"), F.col("id").alias("seq"), key.alias("key"), v.alias("v"))
    got = through(spark, rule, rows, 120)
    assert got == walk(rule, [tuple(r) for r in rows.collect()], 120) and sum(g[0] == '["hot"]' for g in got) > 1000
