"""The log engine: golden run, rules, timestamps, sources and random histories."""

from __future__ import annotations

import json
import operator
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from sample import GOLDEN, MORE, events, ordinary, write

from sentrylake.functions import timestamps
from sentrylake.operators import conditions, detect
from sentrylake.operators.conditions import split_key
from sentrylake.operators.rules import RuleError, build_rule, load_rules, rulebook
from sentrylake.plans import detection
from sentrylake.sources import events as source

def now():
    return F.lit("2026-11-01 00:00:00").cast("timestamp")


def run(spark, tmp_path, rows, name="in.jsonl", **options):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}-{name}"  # a name of its own, as kept hits belong to a path
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return detection.run(spark, str(path), as_of=now(), **options)


_TESTS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "in": lambda a, b: a in b, "nin": lambda a, b: a not in b, "contains": lambda a, b: b in a,
    "contains_any": lambda a, b: any(x in a for x in b), "startswith": lambda a, b: a.startswith(b), "endswith": lambda a, b: a.endswith(b),
}


def holds(event, conditions):
    """A group of conditions over one event, directly."""
    for key, value in conditions.items():
        name, op = split_key(key, value)
        got = event.get(name)
        low = lambda x: "" if x is None else str(x).lower()
        if op == "exists":
            ok = (got is not None) == bool(value)
        elif op == "regex":
            ok = got is not None and re.search(value, str(got), re.I) is not None
        elif op in ("gt", "gte", "lt", "lte"):
            ok = got is not None and getattr(operator, {"gte": "ge", "lte": "le"}.get(op, op))(float(got), float(value))
        else:
            ok = _TESTS[op](low(got), list(map(low, value)) if isinstance(value, list) else low(value))
        if not ok:
            return False
    return True


def direct(rows, rules, dedupe=120):
    """(time, rule, evidence count) of the alerts that rules raise over events in order, and how many each one suppressed."""
    out, lost = [], Counter()
    for rule in rules:
        held, last = {}, {}
        for e in rows:
            t = datetime.fromisoformat(e["timestamp"])
            group = tuple(e.get(g) for g in rule.group_by)
            if (rule.log_types and e["log_type"] not in rule.log_types) or (rule.type != "match" and None in group):
                continue
            if rule.type != "sequence" and not (holds(e, rule.conditions) and (not rule.any_of or any(holds(e, g) for g in rule.any_of))):
                continue
            mine, span = held.setdefault(group, []), timedelta(seconds=rule.window)
            if rule.type == "match":
                size = 1
            elif rule.type == "sequence":
                if mine and t - mine[0][0] > span:
                    mine.clear()
                needed = [s for s in rule.steps for _ in range(s.count)]
                if holds(e, needed[len(mine)].conditions):
                    mine.append((t, None))
                size = len(mine) if len(mine) == len(needed) else 0
            else:
                mine[:] = [x for x in [*mine, (t, e.get(rule.field))] if t - x[0] <= span]
                reached = len(mine) if rule.type == "threshold" else len({v for _, v in mine if v is not None})
                size = len(mine) if reached >= rule.threshold else 0
            if not size:
                continue
            fresh = group not in last or (t - last[group]).total_seconds() >= dedupe
            if fresh:
                last[group] = t
                out.append((t, rule.id, size))
            else:
                lost[rule.id] += 1
            if fresh or rule.type == "sequence":
                mine.clear()
    return sorted(out), lost


def test_every_rule_on_the_sample(spark, tmp_path):
    """The alerts of the sample traffic are those of a direct evaluation, those that it was timed for, and no others."""
    path = tmp_path / "sample.jsonl"
    write(path)
    table = [(f"2026-10-04T{t + '00000' if '.' in t else t}+00:00", r, int(n)) for t, r, n in zip(*[iter([*GOLDEN, *MORE])] * 3, strict=True)]
    report = detection.run(spark, str(path), as_of=now())
    found = report.alerts.collect()
    assert sorted((r.event_time, r.rule_id, r.evidence_count) for r in found) == sorted(table)
    want, lost = direct(events(), rulebook())
    assert sorted((datetime.fromisoformat(r.event_time), r.rule_id, r.evidence_count) for r in found) == want
    assert {r.rule_id for r in found} == {r.id for r in rulebook()}
    assert [r.event_time for r in found] == sorted(r.event_time for r in found)
    assert sorted(r.alert_id for r in found) == sorted({r.alert_id for r in found})
    assert {r.name: r.alerts for r in report.summary.filter("section = 'severity'").collect()} == {"critical": 8, "high": 16, "medium": 10}
    assert [r.name for r in report.summary.collect()][:3] == ["critical", "high", "medium"] and report.summary.count() == 37
    assert {r.rule_id: r.suppressed for r in report.suppressed.collect()} == dict(lost) == {"FILE-002": 59}
    file1 = next(r for r in found if r.rule_id == "FILE-001")
    assert len(file1.evidence) == 5 and json.loads(file1.evidence[-1])["file_path"].endswith("/49.dwg.lockbit")
    assert report.bad_lines.count() == 0
    out = tmp_path / "alerts"
    detection.write_alerts(report.alerts, str(out))
    assert spark.read.json(str(out)).count() == len(table)
    assert "AUTH-003" in detection.show(report.alerts)
    report.release()
    assert direct(ordinary(), rulebook())[0] == []


def test_nested_group_values(spark, tmp_path):
    """Objects are one group whatever the order of their keys, at every depth; so are distinct values."""
    rule = build_rule({"id": "N", "name": "n", "severity": "low", "type": "threshold", "threshold": 2, "window": 60, "group_by": "host"})
    rows = [ev(1, "x", host={"b": 1, "a": {"d": [1, 2], "c": 2}}), ev(2, "x", host={"a": {"c": 2, "d": [1, 2]}, "b": 1}), ev(3, "x", host={"a": {"c": 2, "d": [2, 1]}, "b": 1})]
    found = run(spark, tmp_path, rows, rules=[rule]).alerts.collect()
    assert [(r.evidence_count, json.loads(r.group["host"])) for r in found] == [(2, rows[0]["host"])]
    distinct = build_rule({"id": "D", "name": "n", "severity": "low", "type": "distinct_count", "field": "host", "threshold": 3, "window": 60})
    assert run(spark, tmp_path, rows, rules=[distinct]).alerts.count() == 0
    assert [r.evidence_count for r in run(spark, tmp_path, [*rows, ev(4, "x", host="z")], rules=[distinct]).alerts.collect()] == [4]


def ev(t, kind, **fields):
    return {"timestamp": 1_700_000_000 + t, "log_type": kind, **fields}


def ids(report):
    return sorted(r.rule_id for r in report.alerts.select("rule_id").collect())


def test_windows_groups_and_lists(spark, tmp_path):
    fail = [ev(i, "linux", src_ip="1.1.1.1", message="Failed password") for i in range(6)]
    slow = [ev(1000 + 30 * i, "linux", src_ip="2.2.2.2", message="Failed password") for i in range(6)]
    lost = [ev(i, "linux", message="Failed password") for i in range(10)]
    rows = fail + slow + lost + [ev(9, "windows", host={"name": "a", "id": 1}, event_id=1102)]
    report = run(spark, tmp_path, rows)
    found = {r.rule_id: r for r in report.alerts.collect()}
    assert sorted(found) == ["LNX-001", "WIN-001"]
    assert found["LNX-001"].group == {"src_ip": "1.1.1.1"} and found["WIN-001"].group["user"] == "unknown"
    assert [tuple(r) for r in report.skipped.collect()] == [("LNX-001", "src_ip", 10)]
    lists = {"approved_dhcp_servers": ["10.9.9.9"], "allowed_countries": ["FR"], "bad_domains": ["bad.example"]}
    rows = [
        ev(1, "authentication", user="a", status="success", geo_country="IN"), ev(2, "authentication", user="b", status="success", geo_country="FR"),
        ev(3, "authentication", user="c", status="success"), ev(4, "dhcp", action="offer", server_ip="10.0.0.1"), ev(5, "dhcp", action="offer", server_ip="10.9.9.9"),
        ev(6, "dns", src_ip="1.1.1.1", query="x.bad.example", record_type="A"),
    ]
    assert ids(run(spark, tmp_path, rows, rules=rulebook(lists))) == ["AUTH-004", "DHCP-001", "DNS-003"]


def test_epoch_milliseconds_and_severity_gate(spark, tmp_path):
    rows = [{**ev(0, "linux", src_ip="1.1.1.1", message="Failed password"), "timestamp": (1_700_000_000 + i) * 1000} for i in range(6)]
    rows.append(ev(1, "windows", event_id=4720))
    assert ids(run(spark, tmp_path, rows)) == ["LNX-001", "WIN-003"]
    assert ids(run(spark, tmp_path, rows, min_severity="high")) == ["LNX-001"]


def test_bad_lines(spark, tmp_path):
    rows = [ev(0, "dns"), "GARBAGE", '"text"', "7", "null", "[1,2]", '["ab"]', '{"log_type": "dns"}', '{"timestamp": "soon"}', ""]
    (tmp_path / "b.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    parsed = source.read_events(spark, str(tmp_path / "b.jsonl"), now())
    assert (parsed.events.count(), parsed.bad.count()) == (1, 8)
    with pytest.raises(FileNotFoundError):
        source.read_events(spark, str(tmp_path / "none.jsonl"), now())
    (tmp_path / "c.txt").write_text("{}\n")
    assert source.read_lines(spark, str(tmp_path)).count() == 10


def test_timestamps(spark):
    same = [
        "2026-10-04T09:01:40Z", "1791104500", "1.7911045E9", "1791104500.0", "1791104500000", "1791104500000000000", "2026-10-04 09:01:40", "2026-10-04T14:31:40+0530", "2026-10-04T14:31:40+05:30",
        "04/Oct/2026:09:01:40 +0000", "Sun, 04 Oct 2026 09:01:40 +0000", "2026/10/04 09:01:40", "04 Oct 2026 09:01:40", "Oct  4 09:01:40",
    ]
    none = ["", "garbage", "true", "nan", "2026-13-04T09:01:40Z"]
    rows = spark.createDataFrame([(t,) for t in [*same, *none, None, "2026-10-04T09:01:40.1234567Z", "Dec 31 23:59:59"]], "t string")
    got = [r[0] for r in rows.select(timestamps.parse_micros(F.col("t"), now())).collect()]
    assert got[: len(same)] == [1_791_104_500_000_000] * len(same)
    assert got[len(same) : -2] == [None] * (len(none) + 1)
    assert got[-2] == 1_791_104_500_123_456
    assert got[-1] == 1_767_225_599_000_000  # a December line read in November is of the year before
    iso = rows.select(timestamps.iso_utc(timestamps.parse_micros(F.col("t"), now()))).collect()
    assert iso[0][0] == "2026-10-04T09:01:40+00:00" and iso[-2][0] == "2026-10-04T09:01:40.123456+00:00"


def test_null_semantics_of_operators(spark):
    row = spark.createDataFrame([(None,)], "x string")
    want = {"eq": ("", True), "ne": ("a", True), "nin": (["a"], True), "in": (["a"], False), "contains": ("", True), "regex": (".*", False), "gt": (0, False), "exists": (False, True)}
    for op, (value, result) in want.items():
        assert row.select(conditions.OPERATORS[op](F.col("x"), value)).first()[0] is result, op
    nan = spark.createDataFrame([("nan", "5d", "1_000", "true")], "a string, b string, c string, d string")
    gt = conditions.OPERATORS["gt"]
    assert list(nan.select(gt(F.col("a"), 5), gt(F.col("b"), 1), gt(F.col("c"), 999), gt(F.col("d"), 0)).first()) == [False, False, True, True]


def test_dotted_fields(spark):
    fields = F.create_map(F.lit("a"), F.lit('{"b": {"c": "7"}}'), F.lit("x.y"), F.lit(None).cast("string"), F.lit("x"), F.lit('{"y": "1"}'))
    get = conditions.of_map()
    row = spark.range(1).withColumn("fields", fields).select(get("a.b.c"), get("x.y"), get("q.r")).first()
    assert list(row) == ["7", None, None]


@pytest.mark.parametrize(
    "doc",
    [
        {"name": "n", "severity": "low", "type": "match"},
        {"id": "X", "name": "n", "severity": "nope", "type": "match"},
        {"id": "X", "name": "n", "severity": "low", "type": "other"},
        {"id": "X", "name": "n", "severity": "low", "type": "threshold", "window": 5},
        {"id": "X", "name": "n", "severity": "low", "type": "sequence", "window": 5, "steps": []},
        {"id": "X", "name": "n", "severity": "low", "type": "match", "conditions": {"a|like": 1}},
        {"id": "X", "name": "n", "severity": "low", "type": "match", "conditions": {"a": "$lists.nope"}},
    ],
)
def test_bad_rules(doc):
    with pytest.raises(RuleError):
        build_rule(doc)


def test_rulebook(tmp_path):
    rules = rulebook()
    assert len(rules) == 34
    kinds = [r.type for r in rules]
    assert [kinds.count(k) for k in ("match", "threshold", "distinct_count", "sequence")] == [21, 8, 4, 1]
    one = "- {id: A, name: n, severity: low, type: match%s}\n"
    (tmp_path / "a.yml").write_text("rules:\n" + one % "" + one % ", enabled: false")
    with pytest.raises(RuleError):
        load_rules(tmp_path)
    with pytest.raises(RuleError):
        load_rules(tmp_path / "nothing.yml")


def simulate(rows, kind, n, window, dedupe):
    """Direct evaluation of one key's rows (ts, value), one after another."""
    held, last, out, lost = [], None, [], 0
    for ts, value in rows:
        held = [(t, v) for t, v in [*held, (ts, value)] if ts - t <= window]
        size = len(held) if kind == "threshold" else len({v for _, v in held if v is not None})
        if size < n:
            continue
        if last is not None and ts - last < dedupe:
            lost += 1
            continue
        out.append((ts, len(held)))
        held, last = [], ts
    return out, lost


@pytest.mark.parametrize("kind", ["threshold", "distinct_count"])
def test_random_histories(spark, kind):
    rng = random.Random(5)
    data, want, lost = [], {}, 0
    n, window, dedupe = 3, 6, 9
    for key in range(60):
        rows, t = [], 0
        for _ in range(rng.randrange(40)):
            t += rng.choice([0, 0, 1, 2, 5, 12])
            rows.append((t, rng.choice(["a", "b", "c", "d", None])))
        want[str(key)], k = simulate(rows, kind, n, window, dedupe)
        lost += k
        data += [(str(key), t * 1_000_000, i, v) for i, (t, v) in enumerate(rows)]
    events = spark.createDataFrame(data, "key string, ts_us long, seq long, v string")
    rule = build_rule({"id": "R", "name": "r", "severity": "low", "type": kind, "threshold": n, "window": window, "field": "v", "group_by": "key"})
    found = detect.hits(events, [rule], conditions.of_columns(key=F.col("key"), v=F.col("v")), F.lit("x"))
    _, fired = detect.fire(found, [rule], dedupe)
    got: dict[str, list] = {str(k): [] for k in range(60)}
    rows = fired.collect()
    for r in sorted(rows, key=lambda r: r.pos):
        if r.emitted:
            got[json.loads(r.group_key)[0]].append((r.ts_us // 1_000_000, r.evidence_count))
    assert got == want
    assert sum(not r.emitted for r in rows) == lost


def test_no_events(spark, tmp_path):
    report = run(spark, tmp_path, [""])
    assert report.alerts.count() == 0 and report.summary.count() == 0 and report.skipped.count() == 0


def test_no_active_rules(spark, tmp_path):
    low = build_rule({"id": "A", "name": "n", "severity": "low", "type": "match"})
    for rules in ([], [low]):
        report = run(spark, tmp_path, [ev(0, "dns")], rules=rules, min_severity="critical")
        assert [x.count() for x in (report.alerts, report.summary, report.suppressed, report.skipped)] == [0, 0, 0, 0]


def test_command_line(spark, tmp_path, capsys):
    from sentrylake.__main__ import main

    path = tmp_path / "in.jsonl"
    rows = [ev(i, "linux", origin="1.1.1.1", message="Failed password") for i in range(6)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + "junk\n")
    config = tmp_path / "c.yml"
    config.write_text("field_aliases: {src_ip: [origin], timestamp: [], log_type: []}\nalerts: {dedupe_seconds: 60, evidence_limit: 2}\n")
    assert main(["--validate"]) == 0
    (tmp_path / "bad.yml").write_text("rules:\n- {id: A, name: n, severity: odd, type: match}\n")
    assert main(["--validate", "--rules", str(tmp_path / "bad.yml")]) == 2
    assert main(["--logs", str(path), "--config", str(config), "--out", str(tmp_path / "out")]) == 0
    said = capsys.readouterr().out
    assert "34 rules" in said and "LNX-001" in said and "bad lines: 1" in said
    assert spark.read.json(str(tmp_path / "out")).first().evidence_count == 6


def test_collected_windows_events(spark):
    from sentrylake.sources import live

    xml = (
        "<Event><System><Provider Name='p'/><EventID>{eid}</EventID><Level>0</Level><EventRecordID>{rid}</EventRecordID>"
        "<TimeCreated SystemTime='2024-01-15T10:00:00.5Z'/></System><EventData><Data Name='ObjectName'>{obj}</Data></EventData></Event>"
    )
    docs = spark.createDataFrame([(xml.format(eid=4663, rid=1, obj="C:\\x\\SAM") + xml.format(eid=50066, rid=2, obj="a"),), ("no event",)], "value string")
    files = live.file_events(docs).collect()
    assert [(r.severity, r.extra["sensitive"]) for r in files] == [("critical", "true")]
    dhcp = {r.event_id: r for r in live.dhcp_events(docs).collect()}
    assert dhcp["50066"].action == "assign" and dhcp["50066"].hostname == "dhcpclient" and dhcp["50066"].extra["client_hostname"] == "WINDOWS-CLIENT"
    assert [r.severity for r in live.application_events(docs, 1).collect()] == ["info"]
    assert live.windows_events(docs, 2).count() == 0


def test_syslog_fallback_and_threats(spark):
    from sentrylake.operators import heuristics
    from sentrylake.sources import parsers

    lines = spark.createDataFrame([("<13>" + "x" * 300,), ("",), ("<34>Jan  5 10:00:00 fw kernel: [UFW BLOCK] SRC=1.1.1.1 DST=2.2.2.2",)], "value string")
    rows = {r.log_type: r for r in parsers.parse_syslog(lines).collect()}
    assert len(rows["application"].message) == 120 and set(rows) == {"application", "linux"}
    data = [("netflow", "connect", "9.9.9.9", i + 1, i * 1_000_000, i, {}) for i in range(11)] + [("edr", "x", None, None, 0, 99, {"attack_indicator": "known_tool:m"})]
    schema = "log_type string, action string, source_ip string, destination_port int, ts_us long, seq long, extra map<string,string>"
    frame = spark.createDataFrame(data, schema).selectExpr("*", "null as destination_ip", "'h' as hostname", "'t' as timestamp", "'r' as raw")
    found = [(r.threat_type, r.source) for r in heuristics.threats(frame).collect()]
    assert sorted(found) == [("KNOWN_MALWARE", "h"), ("PORT_SCAN", "9.9.9.9"), ("PORT_SCAN", "9.9.9.9")]


def test_small_functions(spark):
    from sentrylake.functions import text as T
    from sentrylake.plans.detection import preview

    row = spark.createDataFrame([("a=1 b=x,y a=2 =3", "critical", [{"a": "1", "_ts": "2"}, {"b": "3"}], "<34>x")], "kv string, sev string, ev array<map<string,string>>, line string")
    got = row.select(
        T.key_values(F.col("kv")), T.severity_rank(F.col("sev")), T.severity_rank(F.lit("odd")),
        T.strip_priority(F.col("line")), T.entropy(F.lit("")), T.entropy(F.lit("abab")), T.to_int(F.lit("7")), T.to_int(F.lit("7.5")), T.canon_log_type(F.lit(" Web--Server! ")),
    ).first()
    assert list(got) == [{"a": "2", "b": "x"}, 3, None, "x", 0.0, 1.0, 7, None, "web_server"]
    rows = spark.createDataFrame([("t", "dns", s, "m" * 150) for s in ("high", "info", None)], "timestamp string, log_type string, severity string, message string")
    assert [(len(r.message), r.alarm) for r in preview(rows, 5).collect()] == [(100, True), (100, False), (100, False)]


def test_normalized_timestamps(spark):
    want = {
        "2024-01-15T10:00:00": "2024-01-15T10:00:00Z", "2024-01-15T10:00:00-05:00": "2024-01-15T10:00:00-05:00", "Jan 15 10:23:45": "2026-01-15T10:23:45.000Z",
        "Jan  5 10:23:45": "2026-01-05T10:23:45.000Z", "1/15/2024 10:23:45 AM": "2024-01-15T10:23:45.000Z", "15/Jan/2024:10:23:45 +0100": "2024-01-15T09:23:45.000Z",
        "Jan 15 2024 10:23:45": "2024-01-15T10:23:45.000Z", "2024-01-15 10:23:45": "2024-01-15T10:23:45.000Z", "20240115102345": "2024-01-15T10:23:45.000Z",
        "15-Jan-2024 10:23:45.123": "2024-01-15T10:23:45.000Z", "01/15/24 10:23:45": "2024-01-15T10:23:45.000Z", "1705314225": "2024-01-15T10:23:45.000Z", "later": "later",
        "": "2026-11-01T00:00:00.000Z",
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.n for r in rows.select("t", timestamps.normalize_timestamp(F.col("t"), now()).alias("n")).collect()}
    assert got == want
