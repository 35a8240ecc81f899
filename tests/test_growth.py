"""What a row costs stays the same as rows, lines and tables grow."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sentrylake import queries
from sentrylake.functions import timestamps
from sentrylake.plans import bridge, capture
from sentrylake.sources import live, parsers


def test_long_words_are_read_in_linear_time(spark):
    long = "z" * 300_000
    lines = spark.createDataFrame([(0, f"<13>{long}"), (1, f"<13>{long} queries: query:")], "id long, value string")
    start = time.monotonic()
    got = parsers.parse_syslog(lines).orderBy("id").collect()
    assert [(r.log_type, r.message) for r in got] == [("application", "z" * 120)] * 2
    assert time.monotonic() - start < 20


def test_requests_are_tried_for_the_attacks_that_they_hint_at(spark):
    requests = ["/a?q=1 UNION  select 2", "/a?ſelect x from y", "/ſqlmap", "/a;ID", "/a?<SCRIPT>", "/unions", "/KK-nikto", "/%2E%2E%2Fx", "/wget http", "/curls"]
    want = ["sql_injection", "sql_injection", "scanner", "command_injection", "xss", None, "scanner", "path_traversal", "webshell", None]
    rows = spark.createDataFrame(list(enumerate(requests)), "id long, request string")
    assert [r.a for r in rows.orderBy("id").select(parsers.attack_type(F.col("request")).alias("a")).collect()] == want


def test_one_large_row_group_is_the_work_of_many_tasks(spark, tmp_path):
    spark.range(300_000).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01' AS ts", "id % 1000 AS user_id", "'click' AS event_type", "1.0D AS value", "uuid() AS props"
    ).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # more splits than cores, all but one of them empty
    try:
        sizes = queries._events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["count"] for r in sizes) == 300_000
    assert max(r["count"] for r in sizes) <= 150_000


@pytest.mark.parametrize("kind", ["firewall", "ids_ips", "webserver", "linux"])
def test_one_match_gives_all_groups(spark, kind):
    """A group with the separator in it is read as it was, others by a replacement that is made once."""
    line = {
        "firewall": "Jan 15 10:00:00 f%sw kernel: [UFW BLOCK] IN=eth0 SRC=1.2.3.4 DST=8.8.8.8 PROTO=TCP SPT=1 DPT=2", "linux": "Jan 15 10:00:00 w%s cron[3]: job",
        "ids_ips": "01/15-10:00:00.1  [**] [1:9:5] S%s [**] [Classification: x] [Priority: 1] {tcp} 1.2.3.4:7 -> 8.8.8.8:80",
        "webserver": '1.2.3.4 - - [x%s] "GET / HTTP/1.1" 200 5 "-" "agent"',
    }[kind]
    rows = spark.createDataFrame([(line % "",), (line % "\x01",)], "value string")
    plain, odd = parsers.parse(rows, kind).collect()
    assert odd.raw == line % "\x01"
    assert [str(x).replace("\x01", "").replace(r"\x01", "") for x in odd] == [str(x) for x in plain]
    assert "regexp_replace" in str(parsers.PARSERS[kind](F.col("value")))


def test_values_are_read_once(spark):
    value = F.col("value")
    assert str(parsers.file_audit(value)).count("regexp_extract") < 20
    assert str(live.w3c_to_ufw(value)).count("split") == 1
    assert str(timestamps.parse_micros(value, F.current_timestamp())).count("regexp_") < 6
    assert str(timestamps.normalize_timestamp(value, F.current_timestamp())).count("regexp_replace") < 4


def test_bridged_fields_are_made_once(spark):
    rows = parsers.parse(spark.createDataFrame([('{"hostname": "pc", "process": {"name": "a.exe"}}',)], "value string"), "edr")
    made = bridge.to_fields(rows, bridge=True)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("endpoint_edr") == 1
    assert made.first().fields["log_type"] == "endpoint_edr"


def test_export_parses_its_lines_once(spark, monkeypatch):
    plans, write = [], capture.write_normalized
    monkeypatch.setattr(capture, "write_normalized", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(rows, *a))
    queries.QUERIES["export_all_lines"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("regexp" in p for p in plans)


def test_sequences_of_buckets_are_found_once(spark):
    found, rules = queries._hits(spark, "/root/testdata/sf0.001", queries._SEQUENCE)
    for dedupe, passes in ((0, 3), (86_400, 6)):
        plan = queries.detect.fire(found, rules, dedupe)[1]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") <= passes
