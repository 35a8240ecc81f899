"""One address with half of all hits: the same alerts as a plain walk over them, and the work of many tasks."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import detect
from sentrylake.operators.conditions import of_columns
from sentrylake.operators.rules import build_rule

N, T0 = 60_000, 1_700_000_000


def walk(times, n, window, dedupe):
    """(time, evidence count) of emitted alerts, and how many were suppressed."""
    held, last, out, lost = [], None, [], 0
    for t in times:
        held.append(t)
        while held[0] < t - window:
            held.pop(0)
        if len(held) >= n:
            if last is None or t - last >= dedupe:
                out.append((t, len(held)))
                last, held = t, []
            else:
                lost += 1
    return out, lost


@pytest.mark.parametrize("dedupe", [0, 120])
def test_busy_threshold(spark, dedupe):
    rule = build_rule({"id": "T", "name": "t", "severity": "low", "type": "threshold", "threshold": 5, "window": 60, "group_by": "key"})
    gap = F.when(F.col("id") % 7 == 0, 3).otherwise(1)
    rows = spark.range(N).withColumn("busy", F.col("id") % 2 == 0).withColumn("t", T0 + F.col("id") + gap)
    rows = rows.select((F.col("t") * 1_000_000).alias("ts_us"), F.col("id").alias("seq"), F.when(F.col("busy"), "hot").otherwise(F.format_string("k%d", F.col("id") % 997)).alias("key"))
    found = detect.hits(rows, [rule], of_columns(key=F.col("key")), F.lit("x"))
    began = time.time()
    placed, fired = detect.fire(found, [rule], dedupe)
    got = [r for r in fired.collect() if r.group_key == '["hot"]']
    assert time.time() - began < 90
    times = sorted(T0 + i + (3 if i % 7 == 0 else 1) for i in range(0, N, 2))
    want, lost = walk(times, 5, 60, dedupe)
    assert sorted((r.ts_us // 1_000_000, r.evidence_count) for r in got if r.emitted) == want
    assert sum(not r.emitted for r in got) == lost
    # the busy key is dealt out by time
    assert placed.filter("group_key = '[\"hot\"]'").select("bucket").distinct().count() > 200


def test_busy_match(spark):
    rule = build_rule({"id": "M", "name": "m", "severity": "low", "type": "match", "group_by": "key"})
    rows = spark.range(N).select(((T0 + F.col("id")) * 1_000_000).alias("ts_us"), F.col("id").alias("seq"), F.lit("hot").alias("key"))
    found = detect.hits(rows, [rule], of_columns(key=F.col("key")), F.lit("x"))
    counts = {r.emitted: r["count"] for r in detect.fire(found, [rule], 120)[1].groupBy("emitted").count().collect()}
    assert counts == {True: N // 120, False: N - N // 120}


def test_capture_command(spark, tmp_path, capsys):
    from sentrylake.__main__ import main

    (tmp_path / "linux").write_text("".join(f"Jan 15 10:00:{s:02d} db-1 sshd[7]: Failed password for root from 192.0.2.7 port 22 ssh2\n" for s in range(7)))
    assert main(["--capture", f"linux={tmp_path / 'linux'}", "--out", str(tmp_path / "out")]) == 0
    assert "rows: 7" in (said := capsys.readouterr().out) and "BRUTE_FORCE: 3" in said
