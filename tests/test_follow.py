"""Many growing files read by tasks, cursors of channels, keys seen lately."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sentrylake.sources import live
from sentrylake.sources.follow import FolderReader
from sentrylake.streaming.cursors import Ranges, new_records
from sentrylake.streaming.detector import STORE


def drain(reader, start):
    end = reader.latestOffset()
    got = [(v, o) for p in reader.partitions(start, end) for b in reader.read(p) for v, o in zip(b.column("value").to_pylist(), b.column("offset").to_pylist(), strict=True)]
    return got, end


def test_ranges_cut_no_line(tmp_path):
    """Whatever the ranges, every line comes once and whole, and one without its end waits."""
    rng, path = random.Random(5), tmp_path / "a.log"
    lines = ["x" * rng.choice([0, 1, 7, 40, 300]) + str(i) for i in range(200)]
    path.write_bytes("".join(f"{x}\r\n" if i % 3 else f"{x}\n" for i, x in enumerate(lines)).encode() + b"\xffhal")
    for chunk in (1, 13, 64, 1 << 20):
        assert [v for v, _ in drain(FolderReader(str(tmp_path / "*.log"), True, chunk), {})[0]] == lines
    reader = FolderReader(str(tmp_path / "*.log"), True, 13)
    _, at = drain(reader, {})
    with path.open("ab") as f:
        f.write(b"f\nnext\n")
    assert [v for v, _ in drain(reader, at)[0]] == ["�half", "next"]


def test_rotation(tmp_path):
    reader, path = FolderReader(str(tmp_path / "a.log*"), False, 1 << 20), tmp_path / "a.log"
    path.write_text("before\n")
    at = reader.initialOffset()
    with path.open("a") as f:
        f.write("one\n")
    got, at = drain(reader, at)
    assert [v for v, _ in got] == ["one"]
    with path.open("a") as f:
        f.write("two\n")
    planned = reader.latestOffset()
    path.rename(tmp_path / "a.log.1")  # what it gained before it was renamed comes too
    path.write_text("new\n")
    assert [p.path for p in reader.partitions(at, planned)] == [str(tmp_path / "a.log.1")]
    got, at = drain(reader, at)
    assert sorted(v for v, _ in got) == ["new", "two"]
    path.write_text("other, and longer than before\n")  # replaced in place
    assert [v for v, _ in drain(reader, at)[0]] == ["other, and longer than before"]
    assert drain(reader, reader.latestOffset())[0] == [] and drain(FolderReader(str(tmp_path / "none*"), True, 9), {})[0] == []


def test_hundred_files_and_a_restart(spark, tmp_path):
    logs, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    logs.mkdir()
    for turn in range(2):
        for i in range(100):
            with (logs / f"f{i}.log").open("a") as f:
                f.writelines(f"{i} {turn} {n}\n" for n in range(5))
        (logs / f"late{turn}.log").write_text(f"100 {turn} 0\n")
        rows = live.followed(spark, str(logs / "*.log"), from_start=True)
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(out)
    assert sorted(r.value for r in got.collect()) == sorted([f"{i} {t} {n}" for i in range(100) for t in range(2) for n in range(5)] + ["100 0 0", "100 1 0"])


def test_number_ranges():
    rng, ranges, seen = random.Random(2), Ranges(), set()
    for _ in range(3000):
        n = rng.randrange(400)
        assert ranges.add(n) == (n not in seen)
        seen.add(n)
    assert [n for a, z in ranges.all() for n in range(a, z + 1)] == sorted(seen)
    assert all(z + 1 < a for (_, z), (a, _) in zip(ranges.all(), ranges.all()[1:], strict=False))


def test_channels_with_overlapping_numbers(spark, tmp_path):
    """Two channels of two hosts deliver some records again and some late: each comes once."""
    event = "<Event><System><EventRecordID>{}</EventRecordID><Channel>{}</Channel><Computer>{}</Computer></System></Event>"
    every = [(n, c, h) for n in range(1, 31) for c in ("Security", "System") for h in ("A", "B")]
    rng = random.Random(4)
    parts = [rng.sample(every, 60) for _ in range(3)] + [every]
    for i, part in enumerate(parts):
        spark.createDataFrame([(event.format(*r),) for r in [*part, ("", "System", "A")]], "value string").coalesce(1).write.text(str(tmp_path / "in" / f"p{i}"))
    for k, v in STORE.items():
        spark.conf.set(k, v)
    rows = new_records(live.event_rows(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in" / "*"))))
    q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.record_id, r.channel, r.host) for r in got.collect()) == sorted(every)
    left = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "cp"))
    assert [len(r.n) for r in left.select(F.col("value.ranges").alias("n")).collect()] == [1] * 4


def test_keys_seen_lately(spark, tmp_path):
    for i, part in enumerate(([1, 1, 2], [2, 3])):
        spark.createDataFrame([(p,) for p in part], "pid int").coalesce(1).write.json(str(tmp_path / "in" / f"p{i}"))
    rows = spark.readStream.schema("pid int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = live.processes(rows, keep="1 hour").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.pid for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2, 3]
