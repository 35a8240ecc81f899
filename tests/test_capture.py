"""The capture plan in batch and as a stream, and what stands around it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sentrylake.plans import capture, detection
from sentrylake.sources import live


def failures(seconds, ip="192.0.2.7"):
    return [f"Jan 15 10:{s // 60:02d}:{s % 60:02d} db-1 sshd[7]: Failed password for root from {ip} port 22 ssh2" for s in seconds]


def flows(ports):
    return ['{"src_ip": "192.0.2.8", "dst_ip": "192.0.2.9", "dport": %d, "proto": "tcp", "start": "2026-01-15T10:05:%02dZ"}' % (p, i) for i, p in enumerate(ports)]


AS_OF = "2026-02-01"


def test_capture_as_a_stream_equals_batch(spark, tmp_path):
    """Windows reach over micro-batches; lines that no parser reads are left out."""
    linux, net = failures([0, 10, 20, 30, 40, 50, 99, 170]), flows(range(100, 114))
    mixed = ["<34>" + x for x in failures([0, 5], "192.0.2.9")] + ["", "<13>nothing special"]
    parts = {"linux": [linux[:3] + ["junk"], linux[3:6], linux[6:]], "netflow": [net[:4], net[4:9] + ["{"], net[9:]], "syslog": [mixed[:1], mixed[1:3], mixed[3:]]}
    for kind, files in parts.items():
        (tmp_path / kind).mkdir()
        for i, lines in enumerate(files):
            f = tmp_path / kind / f"{i}.log"
            f.write_text("\n".join(lines) + "\n")
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    as_of = F.lit(AS_OF).cast("timestamp")
    batch = capture.run(spark, {k: spark.read.text(str(tmp_path / k)) for k in parts}, str(tmp_path / "batch"), as_of)
    want = sorted((r.threat_type, r.source, r.message) for r in batch.threats.collect())
    assert batch.rows == batch.log.count() == len(linux) + len(net) + 3
    assert {k for k, *_ in want} == {"BRUTE_FORCE", "PORT_SCAN"} and len([w for w in want if w[0] == "PORT_SCAN"]) == 5
    streams = {k: spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / k)) for k in parts}
    capture.follow(streams, str(tmp_path / "live"), str(tmp_path / "cp"), as_of, available_now=True).awaitTermination()
    got = spark.read.json(str(tmp_path / "live/threats"))
    assert sorted((r.threat_type, r.source, r.message) for r in got.collect()) == want
    assert spark.read.json(str(tmp_path / "live/log")).count() == batch.rows


def test_newest_capture_file(spark, tmp_path):
    for name, user, age in (("live_capture_a.jsonl", "new", 5), ("live_capture_b.jsonl", "old", 50), ("other.jsonl", "no", 1)):
        f = tmp_path / name
        f.write_text('{"timestamp": "t", "log_type": "dns", "message": "%s", "severity": "low"}\n' % user)
        os.utime(f, (1_700_000_000 - age, 1_700_000_000 - age))
    assert detection.export_csv(spark, str(tmp_path), str(tmp_path / "csv")).endswith("live_capture_a.jsonl")
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert [(r.message, r.log_type) for r in rows] == [("new", "dns")] and len(rows[0]) == 7
    assert detection.export_csv(spark, str(tmp_path), str(tmp_path / "none"), "nothing_*.jsonl") is None


def test_preview_marks_threats(spark):
    rows = spark.createDataFrame([("t", "netflow", "medium", "m", True), ("t", "dns", "medium", "m", None)], "timestamp string, related_log_type string, severity string, message string, THREAT boolean")
    assert [(r.log_type, r.alarm) for r in detection.preview(rows).collect()] == [("netflow", True), ("dns", False)]


def test_sensor_events(spark, tmp_path):
    eve = tmp_path / "eve.json"
    assert live.sensor_events(spark, (str(eve),)) is None
    eve.write_text('{"event_type": "alert", "src_ip": "192.0.2.1", "alert": {"signature": "S", "severity": 1}}\nnot an event\n')
    rows = live.sensor_events(spark, (str(tmp_path / "missing"), str(eve)), from_start=True)
    q = rows.writeStream.format("memory").queryName("sensor").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [(r.log_type, r.source_ip, r.action) for r in spark.table("sensor").collect()] == [("ids_ips", "192.0.2.1", "detect")]
    finally:
        q.stop()


def test_alerts_handled_in_tasks(spark, tmp_path):
    """Handlers that are sent to the tasks: what they write outside is there."""
    from sentrylake.streaming.sinks import to_handlers

    spark.range(5).select(F.col("id").cast("string").alias("rule_id")).write.json(str(tmp_path / "in"))

    class Write:
        def __init__(self, folder):
            self.folder = folder

        def handle(self, alert):
            with open(f"{self.folder}/{alert['rule_id']}", "w") as f:
                f.write("x")

    (tmp_path / "out").mkdir()
    stream = spark.readStream.schema("rule_id string").json(str(tmp_path / "in"))
    to_handlers(stream, [Write(str(tmp_path / "out"))], str(tmp_path / "cp"), available_now=True, on_driver=False).awaitTermination()
    assert sorted(os.listdir(tmp_path / "out")) == list("01234")
