"""Threat checks over a stream against batch, with clocks that run ahead and behind and rows that come late."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sentrylake.operators.heuristics import threats
from sentrylake.operators.normalize import SCHEMA
from sentrylake.streaming.detector import STORE
from sentrylake.streaming.threats import latest, threat_stream

SHOWN = ["threat_type", "severity", "source", "message", "timestamp", "related_log_type"]


def history(seed, n):
    """Rows of a few sources, many in one instant; some clocks are years ahead or hours behind."""
    r, t, rows = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        t += r.choice([0] * 20 + [1, 1, 2, 9])
        ts = t + r.choice([0] * 20 + [40_000_000, -7_200, -7_190])
        kind = r.choice(["linux", "linux", "netflow", "netflow", "netflow", "dns", "edr"])
        rows.append((i, ts * 1_000_000, f"2026-01-01T00:00:00Z {ts}", kind, r.choice(["a", "a", "a", "b", None]), r.choice([None, 0, *range(1, 30), 4444]), r.choice(["block", "block", "allow", None]), f"raw {i}"))
    return rows


def table(spark, rows):
    given = "seq long, ts_us long, timestamp string, log_type string, source_ip string, destination_port int, action string, raw string"
    df = spark.createDataFrame(rows, given)
    missing = [f for f in spark.createDataFrame([], SCHEMA).schema if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def through(spark, parts, tmp_path):
    for k, v in STORE.items():
        spark.conf.set(k, v)
    for i, part in enumerate(parts):
        table(spark, part).coalesce(1).write.json(str(tmp_path / f"in/p{i:03d}"))
    rows = spark.readStream.schema(table(spark, parts[0]).schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    q = threat_stream(rows).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.json(str(tmp_path / "out"))


@pytest.mark.parametrize("order", ["in order", "late"])
def test_stream_equals_batch(spark, tmp_path, order):
    rows = history(7, 500)
    want = sorted(map(str, threats(table(spark, rows)).select(*SHOWN).collect()))
    assert {"BRUTE_FORCE", "PORT_SCAN", "C2_BEACON"} <= {w.split("'")[1] for w in want}
    if order == "late":
        random.Random(1).shuffle(rows)
    got = through(spark, [rows[i : i + 125] for i in range(0, 500, 125)], tmp_path)
    assert sorted(map(str, latest(got).select(*SHOWN).collect())) == want
    if order == "in order":  # rows of slow clocks only count among themselves, so hardly a row comes twice
        assert got.count() < 1.2 * len(want)


def test_a_clock_ahead_hides_nothing(spark, tmp_path):
    fail = lambda i, s: (i, s * 1_000_000, str(s), "linux", "a", None, "block", f"raw {i}")
    parts = [[fail(0, 100), fail(1, 110), (2, 9_000_000_000_000_000, "x", "linux", "cron", None, "allow", "r")], [fail(3, 120), fail(4, 130)], [fail(5, 140)]]
    got = through(spark, parts, tmp_path).collect()
    assert [(r.threat_type, r.source, r.timestamp) for r in got] == [("BRUTE_FORCE", "a", "140")]
