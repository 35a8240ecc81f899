"""Streaming detection against batch, and the line tail."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from sample import events

from sentrylake.operators import detect
from sentrylake.operators.conditions import of_columns, of_map
from sentrylake.operators.rules import build_rule, rulebook
from sentrylake.sources.events import parse_lines
from sentrylake.sources.tail import TailReader, TailSource
from sentrylake.streaming.detector import STORE, detect_stream
from sentrylake.streaming.sinks import Detections


COLUMNS = ["alert_id", "rule_id", "rule_name", "severity", "description", "recommendation", "mitre", "group", "group_key", "event_time", "evidence_count", "evidence"]


def plain(rows):
    return sorted(json.dumps([r[c] for c in COLUMNS], sort_keys=True) for r in rows)


def through_stream(spark, rules, schema, parts, tmp_path, make_hits, dedupe, **options):
    """The alerts of hits that arrive part by part, and the counters."""
    landing, out = tmp_path / "in", str(tmp_path / "out")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(landing / f"p{i:03d}"))
    for k, v in STORE.items():
        spark.conf.set(k, v)
    seen = Detections()
    spark.streams.addListener(seen)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landing / "*"))
        q = detect_stream(make_hits(rows), rules, dedupe, **options)
        q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if seen.emitted == spark.read.parquet(out).count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    return spark.read.parquet(out).collect(), seen


def test_sample_as_a_stream(spark, tmp_path):
    """Whole alerts are those of the batch."""
    names = ("AUTH-003", "FW-001", "LNX-001", "FILE-002", "DNS-002", "EDR-002")
    rules, now = [r for r in rulebook() if r.id in names], F.lit("2026-11-01").cast("timestamp")
    lines = [(i, json.dumps(e)) for i, e in enumerate(events())]
    make = lambda d: detect.hits(parse_lines(d, now).events, rules, of_map(), F.col("raw"))
    schema = "seq long, value string"
    got, seen = through_stream(spark, rules, schema, [lines[i : i + 250] for i in range(0, len(lines), 250)], tmp_path, make, 120)
    want = detect.alerts(make(spark.createDataFrame(lines, schema)), rules).collect()
    assert plain(got) == plain(want) and {r.rule_id for r in got} == set(names)
    assert (seen.emitted, seen.suppressed) == (len(want), 59)


@pytest.mark.parametrize("kind", ["number", "structure", "text"])
def test_random_streams(spark, tmp_path, kind):
    """Histories with many hits of one instant, whose arrivals count as numbers and not as texts."""
    rng = random.Random(3)
    common = {"name": "n", "severity": "low", "group_by": "key", "description": "d", "mitre": ["T1"]}
    steps = [{"conditions": {"v": "a"}, "count": 2}, {"conditions": {"v": "b"}}]
    rules = [
        build_rule({"id": "M", "type": "match", "conditions": {"v": "a"}, **common}, order=0), build_rule({"id": "T", "type": "threshold", "threshold": 3, "window": 6, **common}, order=1),
        build_rule({"id": "D", "type": "distinct_count", "field": "v", "threshold": 3, "window": 6, **common}, order=2), build_rule({"id": "S", "type": "sequence", "window": 6, "steps": steps, **common}, order=3),
    ]
    rows, t = [], 1_700_000_000
    for i in range(420):
        t += rng.choice([0, 0, 0, 0, 1, 4, 15])
        rows.append((t * 1_000_000, i, rng.choice(["k1", "k2", "k3", None]), rng.choice(["a", "b", "c", None])))
    schema = "ts_us long, n long, key string, v string"
    seq = {"number": F.col("n"), "structure": F.struct(F.floor(F.col("n") / 7).alias("file"), (F.col("n") % 7).alias("row")), "text": F.format_string("%05d", "n")}[kind]
    make = lambda d: detect.hits(d.withColumn("seq", seq), rules, of_columns(key=F.col("key"), v=F.col("v")), F.format_string("%d", "n"))
    got, seen = through_stream(spark, rules, schema, [rows[i : i + 37] for i in range(0, len(rows), 37)], tmp_path, make, 5)
    found = make(spark.createDataFrame(rows, schema))
    want = detect.alerts(found, rules, 5).collect()
    # a state that a timer dropped numbers its hits anew, which only the identifier shows
    strip = lambda xs: sorted(json.dumps([r[c] for c in COLUMNS[1:]], sort_keys=True) for r in xs)
    assert strip(got) == strip(want) and {r.rule_id for r in want} == set("MTDS")
    assert seen.suppressed == sum(r.suppressed for r in detect.suppressed(found, rules, 5).collect())
    assert seen.skipped == sum(r.skipped for r in detect.skipped(found, rules).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_within_the_lateness(spark, tmp_path, seed):
    """Hits that arrive up to twenty seconds late give the alerts of a batch once the watermark has passed them."""
    rng = random.Random(seed)
    common = {"name": "n", "severity": "low", "group_by": "key"}
    steps = [{"conditions": {"v": "a"}, "count": 2}, {"conditions": {"v": "b"}}]
    rules = [
        build_rule({"id": "M", "type": "match", "conditions": {"v": "a"}, **common}, order=0), build_rule({"id": "T", "type": "threshold", "threshold": 3, "window": 6, **common}, order=1),
        build_rule({"id": "D", "type": "distinct_count", "field": "v", "threshold": 3, "window": 6, **common}, order=2), build_rule({"id": "S", "type": "sequence", "window": 6, "steps": steps, **common}, order=3),
    ]
    rows, t = [], 1_700_000_000
    for i in range(300):
        t += rng.choice([0, 0, 0, 1, 4, 9])
        rows.append((t * 1_000_000, i, rng.choice(["k1", "k2"]), rng.choice(["a", "b", "c", None])))
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(20_000_000))
    assert arrival != rows
    parts = [arrival[i : i + 25] for i in range(0, len(arrival), 25)]
    far = [[((t + 1000 * i) * 1_000_000, 10_000 + i, "far", "c")] for i in (1, 2)]  # lets the watermark pass
    schema = "ts_us long, n long, key string, v string"
    make = lambda d: detect.hits(d.withColumn("seq", F.col("n")), rules, of_columns(key=F.col("key"), v=F.col("v")), F.format_string("%d", "n"))
    got, _ = through_stream(spark, rules, schema, parts + far, tmp_path, make, 5, lateness="20 seconds", ordered=True)
    want = detect.alerts(make(spark.createDataFrame(rows, schema)), rules, 5).collect()
    strip = lambda xs: sorted(json.dumps([r[c] for c in COLUMNS[1:]], sort_keys=True) for r in xs)
    assert strip(got) == strip(want) and {r.rule_id for r in want} == set("MTDS")
    # nothing waits but what the watermark has not passed, and chunks that the window has left are gone
    left = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "cp"))
    assert {r.key.group_key for r in left.select("key").collect()} <= {'["far"]'}


def test_two_steps_at_one_instant(spark, tmp_path):
    """Arrivals 9 and 10 of one instant are taken in this order."""
    rule = build_rule({"id": "S", "name": "s", "severity": "low", "type": "sequence", "window": 60, "group_by": "key", "steps": [{"conditions": {"v": "a"}}, {"conditions": {"v": "b"}}]})
    make = lambda d: detect.hits(d.withColumnRenamed("n", "seq"), [rule], of_columns(key=F.col("key"), v=F.col("v")), F.col("v"))
    got, _ = through_stream(spark, [rule], "ts_us long, n long, key string, v string", [[(5_000_000, 10, "k", "b"), (5_000_000, 9, "k", "a")]], tmp_path, make, 120)
    assert [(r.rule_id, r.evidence_count, r.evidence) for r in got] == [("S", 2, ["a", "b"])]


def test_idle_state_is_dropped(spark, tmp_path):
    """A much later event lets the state of idle keys go."""
    rule = build_rule({"id": "T", "name": "t", "severity": "low", "type": "threshold", "threshold": 5, "window": 60, "group_by": "key"})
    make = lambda d: detect.hits(d.withColumnRenamed("n", "seq"), [rule], of_columns(key=F.col("key")), F.lit("x"))
    late = 10_000_000_000
    parts = [[(1_000_000, i, f"k{i}", "v") for i in range(49)], [(late, 50, "last", "v")], [(late + 1, 51, "last", "v")], [(late + 2, 52, "last", "v")]]
    through_stream(spark, [rule], "ts_us long, n long, key string, v string", parts, tmp_path, make, 120)
    left = spark.read.format("statestore").option("stateVarName", "mark").load(str(tmp_path / "cp"))
    assert [r.key.group_key for r in left.select("key").collect()] == ['["last"]']


def test_tail_reader(tmp_path):
    path = tmp_path / "log"
    reader = TailReader(str(path), from_start=False, max_bytes=1 << 20)
    offset = reader.initialOffset()
    assert list(reader.read(offset)[0]) == []
    path.write_text("one\ntwo\nhal")
    rows, offset = reader.read(offset)
    assert [v for v, _ in rows] == ["one", "two"]
    with path.open("a") as f:
        f.write("f\n")
    rows, after = reader.read(offset)
    assert [v for v, _ in rows] == ["half"]
    assert [v for v, _ in reader.readBetweenOffsets(offset, after)] == ["half"]
    path.write_text("new\n")  # cut: begins anew
    rows, _ = reader.read(after)
    assert [v for v, _ in rows] == ["new"]


def test_tail_reads_lines_longer_than_a_batch(tmp_path):
    path = tmp_path / "log"
    path.write_bytes(b"a" * 5000 + b"\r\nshort\n\xff\nx\ny\n" + b"z" * 9000)
    reader, offset, got = TailReader(str(path), from_start=True, max_bytes=1000), {"inode": 0, "byte": 0}, []
    for _ in range(4):
        rows, after = reader.read(offset)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(offset, after))
        got += [v for v, _ in rows]
        offset = after
    assert got == ["a" * 5000, "short", "\ufffd", "x", "y"]
    with path.open("ab") as f:
        f.write(b"\nend\n")
    while rows := list(reader.read(offset)[0]):
        got += [v for v, _ in rows]
        offset = reader.read(offset)[1]
    assert got[5:] == ["z" * 9000, "end"]


def test_tail_goes_on_in_a_file_put_in_place_of_the_old(tmp_path):
    path = tmp_path / "log"
    path.write_text("old one\nold two\n")
    reader = TailReader(str(path), from_start=True, max_bytes=1 << 20)
    _, offset = reader.read({"inode": 0, "byte": 0})
    path.rename(tmp_path / "log.1")
    assert list(reader.read(offset)[0]) == []
    path.write_text("first of the new file, longer than the old\n")
    assert [v for v, _ in reader.read(offset)[0]] == ["first of the new file, longer than the old"]


def test_tail_stream(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("a\nb\nhalf")
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("line_tail").option("path", str(path)).option("fromStart", "true").load()
    q = lines.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.value for r in spark.table("tailed").collect()) == ["a", "b"]
    finally:
        q.stop()


def test_sinks(spark, tmp_path):
    from sentrylake.streaming.sinks import Status, counted, multiplex, to_handlers, to_json

    schema = "rule_id string, severity string, hostname string"
    for k in "ab":
        spark.createDataFrame([(k, "high", "h" + k), (k, "low", "h")], schema).coalesce(1).write.json(str(tmp_path / k))
    both = multiplex([spark.readStream.schema(schema).json(str(tmp_path / "a")), spark.readStream.schema(schema).json(str(tmp_path / "b"))])

    class Keep:
        seen: list = []

        def handle(self, alert):
            self.seen.append(alert["rule_id"])

    to_handlers(both, [Keep()], str(tmp_path / "cp1"), available_now=True).awaitTermination()
    assert sorted(Keep.seen) == ["a", "a", "b", "b"]
    status = Status()
    spark.streams.addListener(status)
    try:
        to_json(counted(both), str(tmp_path / "out"), str(tmp_path / "cp2"), available_now=True).awaitTermination()
        assert spark.read.json(str(tmp_path / "out")).count() == 4
        for _ in range(50):
            if status.rows == 4:
                break
            import time

            time.sleep(0.1)
        assert (status.rows, status.grave, status.machines(spark)) == (4, 2, 3)
    finally:
        spark.streams.removeListener(status)
