"""Lists as tables, posts landed and taken once, machines counted exactly."""

from __future__ import annotations

import json
import pickle
import random
import time

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import detect
from sentrylake.operators.conditions import of_columns
from sentrylake.operators.lists import ListTable, mark
from sentrylake.operators.rules import RuleError, build_rule
from sentrylake.plans.config import load_config
from sentrylake.plans.detection import newest_file
from sentrylake.sources import landing
from sentrylake.streaming.detector import STORE
from sentrylake.streaming.sinks import Fleet, fleet


def rule(conditions, lists, **more):
    return build_rule({"id": "R", "name": "n", "severity": "low", "type": "match", "conditions": conditions, **more}, lists)


def test_tables_equal_literals(spark):
    """Rules with a list as a table hit the same events as with the list in the plan, broadcast or salted."""
    values = ["A", "b ", "", "7", "7", None, "Ünï"]
    rows = [(i, i, random.Random(i).choice(["a", "B ", "7", "", None, "üNÏ", "x", "7.0"])) for i in range(300)] + [(i, i, "a") for i in range(300, 600)]
    events = spark.createDataFrame(rows, "ts_us long, seq long, v string")
    plain = [x for x in values if x is not None]
    table = ListTable("l", rows=spark.createDataFrame([(v,) for v in values], "any string"))
    fields = of_columns(v=F.col("v"), log_type=F.lit("x"))
    for conditions in ({"v": "$lists.l"}, {"v|nin": "$lists.l"}, {"v|in": "$lists.l", "log_type|nin": "$lists.l"}):
        got, want = (
            sorted(r.seq for r in detect.hits(events, [rule(conditions, {"l": x})], fields, F.lit("")).collect()) for x in (table, plain)
        )
        assert got == want and want
    for limit in (0, 1 << 20):
        made = mark(events, [("m", F.col("v"), table)], limit=limit, salts=5).collect()
        assert {(r.seq, r.m) for r in made} == {(i, (v or "").lower() in {p.lower() for p in plain}) for i, _, v in rows}


def test_empty_and_wrong_lists(spark):
    events = spark.createDataFrame([(1, 1, "a"), (2, 2, None)], "ts_us long, seq long, v string")
    none = ListTable("l", rows=spark.createDataFrame([], "x string"))
    fields = of_columns(v=F.col("v"))
    assert detect.hits(events, [rule({"v": "$lists.l"}, {"l": none})], fields, F.lit("")).count() == 0
    assert detect.hits(events, [rule({"v|nin": "$lists.l"}, {"l": none})], fields, F.lit("")).count() == 2
    assert detect.hits(events.limit(0), [rule({"v|nin": "$lists.l"}, {"l": none})], fields, F.lit("")).count() == 0
    with pytest.raises(RuleError, match="cannot take"):
        rule({"v|contains_any": "$lists.l"}, {"l": none})
    assert pickle.loads(pickle.dumps(rule({"v": "$lists.l"}, {"l": none}))).conditions["v"].name == "l"


def test_list_files_of_the_settings(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("Evil.example\nworse.example\n")
    (tmp_path / "c.yml").write_text(f"lists:\n  bad: {{path: {tmp_path}/bad.txt}}\n  few: [a]\n")
    lists = load_config(tmp_path / "c.yml").lists
    assert lists["few"] == ["a"]
    events = spark.createDataFrame([(1, 1, "evil.EXAMPLE"), (2, 2, "good.example")], "ts_us long, seq long, q string")
    hit = detect.hits(events, [rule({"q": "$lists.bad"}, lists)], of_columns(q=F.col("q")), F.lit("")).collect()
    assert [r.seq for r in hit] == [1]


def stream(rows, out):
    for k, v in STORE.items():
        rows.sparkSession.conf.set(k, v)
    rows.writeStream.format("json").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def test_posts_once(spark, tmp_path):
    """Posts sent again, to another receiver, in another order, split over files and after a restart: each record counts once."""
    rng, a, b = random.Random(3), tmp_path / "in" / "a", tmp_path / "in" / "b"
    posts = [(m, p, [{"raw": f"{m} {p} {i}", "_log_type": "dns"} for i in range(rng.choice([1, 3, 20]))]) for m in ("m1", "m2") for p in range(12)]
    rng.shuffle(posts)
    for m, p, records in posts[:14]:
        assert landing.put(str(a), m, p, records)
        assert not landing.put(str(a), m, p, records)
    assert not list((a / "_aside").iterdir())
    b.mkdir()
    m, p, records = posts[14]
    full = [json.dumps({**r, "source_machine": m, "run": "", "post": p, "place": i, "size": len(records)}) for i, r in enumerate(records)]
    (b / "half.json").write_text("\n".join(full[: len(full) // 2] + [json.dumps({"source_machine": None, "raw": "loose"})] * 2))
    read = lambda: landing.once(landing.landed(spark, str(tmp_path / "in" / "*")))
    stream(read(), tmp_path / "out")
    (b / "again.json").write_text("\n".join(reversed(full)))
    for m, p, records in posts:
        landing.put(str(b), m, p, records)
    landing.put(str(b), "m1", 0, [{"raw": "restarted"}], run="2")
    stream(read(), tmp_path / "out")
    got = sorted(r.raw for r in spark.read.schema(landing.SCHEMA).json(str(tmp_path / "out" / "rows")).collect())
    assert got == sorted([r["raw"] for _, _, rs in posts for r in rs] + ["loose", "loose", "restarted"])


def test_machines_are_exact(spark, tmp_path):
    seen, src = Fleet("machines-test"), tmp_path / "in"
    spark.streams.addListener(seen)
    try:
        for part in (range(0, 300), range(200, 500)):
            rows = [(f"h{i}", "high" if i % 2 else "info") for i in part] + [("h1", "info")] * 50 + [(None, "high"), ("", "high")]
            spark.createDataFrame(rows, "hostname string, severity string").write.mode("append").json(str(src))
            read = spark.readStream.schema("hostname string, severity string").json(str(src))
            fleet(read).writeStream.queryName("machines-test").format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(
                availableNow=True
            ).start().awaitTermination()
        for _ in range(50):
            if seen.machines == 500:
                break
            time.sleep(0.1)
        assert seen.machines == 500
        batch = {r.hostname: (r.rows, r.grave) for r in fleet(spark.read.schema("hostname string, severity string").json(str(src))).collect()}
        assert len(batch) == 500 and batch["h1"] == (101, 1) and batch["h250"] == (2, 0)
    finally:
        spark.streams.removeListener(seen)


def test_newest_capture(spark, tmp_path):
    assert newest_file(spark, str(tmp_path)) is None
    (tmp_path / "live_capture_9.jsonl").write_text("{}")
    (tmp_path / "other.jsonl").write_text("{}")
    time.sleep(1.1)
    (tmp_path / "live_capture_1.jsonl").mkdir()
    assert newest_file(spark, str(tmp_path)).endswith("/live_capture_1.jsonl")
