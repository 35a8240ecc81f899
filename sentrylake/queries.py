"""The registered queries of the log engine over the driver's tables, each with the SQL of the same result."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce, wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import timestamps as TS
from .operators import detect, heuristics, normalize
from .operators.conditions import OPERATORS, Fields, matches, of_columns, of_map
from .operators.lists import ListTable
from .operators.rules import build_rule, load_rules
from .plans import bridge, capture, detection
from .session import shared_dir, utc
from .sources import landing, live, parsers
from .sources.events import canonical_type, fill_aliases, parse_lines, read_lines, spread_table
from .streaming import sinks
from .streaming.detector import STORE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with utc(spark):
                return f(spark, sf_dir)

        key = name or f.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(_table(spark, sf_dir, "events")).withColumn("ts_us", _micros())


# conditions: operator, table, id, column, value and the SQL of the same test

_S = "lower(coalesce(CAST({c} AS VARCHAR), ''))"
_N = "TRY_CAST({c} AS DOUBLE)"
_CONDITIONS: dict[str, tuple[str, str, str, object, str]] = {
    "eq": ("events", "event_id", "event_type", "ERROR", f"{_S} = 'error'"),
    "ne": ("events", "event_id", "event_type", "error", f"{_S} <> 'error'"),
    "in": ("orders", "o_orderkey", "o_orderpriority", ["1-urgent", "2-HIGH"], f"{_S} IN ('1-urgent', '2-high')"),
    "nin": ("orders", "o_orderkey", "o_orderpriority", ["1-urgent", "2-HIGH"], f"{_S} NOT IN ('1-urgent', '2-high')"),
    "contains": ("documents", "doc_id", "text", "Token", f"contains({_S}, 'token')"),
    "contains_any": ("part", "p_partkey", "p_type", ["brass", "TIN"], f"(contains({_S}, 'brass') OR contains({_S}, 'tin'))"),
    "startswith": ("pages", "page_id", "url", "HTTPS://m.", f"starts_with({_S}, 'https://m.')"),
    "endswith": ("pages", "page_id", "url", "#TOP", f"ends_with({_S}, '#top')"),
    "regex": ("pages", "page_id", "url", r"/(fr|de)/[0-9]{3}\b", r"coalesce(regexp_matches({c}, '(?i)/(fr|de)/[0-9]{{3}}\b'), false)"),
    "gt": ("events", "event_id", "value", 50, f"coalesce({_N} > 50, false)"),
    "gte": ("orders", "o_orderkey", "o_totalprice", "200000", f"coalesce({_N} >= 200000, false)"),
    "lt": ("part", "p_partkey", "p_size", 10, f"coalesce({_N} < 10, false)"),
    "lte": ("customer", "c_custkey", "c_acctbal", 0, f"coalesce({_N} <= 0, false)"),
    "exists": ("events", "event_id", "props", True, "{c} IS NOT NULL"),
}


def _condition(op: str, table: str, key: str, column: str, value: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir, table)
        return t.filter(OPERATORS[op](F.col(column), value)).select(key)

    return run


for _op, (_t, _k, _c, _v, _sql) in _CONDITIONS.items():
    query(f"SELECT {_k} FROM {_t} WHERE {_sql.format(c=_c)}", f"cond_{_op}")(_condition(_op, _t, _k, _c, _v))


@query(
    """SELECT event_id FROM events WHERE lower(event_type) IN ('click', 'view') AND
((value > 90 AND contains(lower(event_type), 'click')) OR (value < 5 AND user_id IS NOT NULL))"""
)
def cond_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    fields = of_columns(event_type=F.col("event_type"), value=F.col("value"), user=F.col("user_id"))
    groups = [{"value|gt": 90, "event_type|contains": "click"}, {"value|lt": 5, "user|exists": True}]
    return e.filter(matches({"event_type": ["click", "VIEW"]}, groups, None, fields)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'click')")
def cond_log_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.filter(matches(None, None, ("error", "click"), of_columns(log_type=F.col("event_type")))).select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def field_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("fields", F.create_map(F.lit("props"), "props"))
    k = of_map()("props.k")
    return e.filter(OPERATORS["gte"](k, 50)).select("event_id", k.alias("k"))


@query("SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS kind FROM orders")
def canon_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.canon_log_type(F.col("o_orderpriority")).alias("kind"))


_STAMPS = {
    "iso_z": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "spaced": "yyyy-MM-dd HH:mm:ss.SSSSSS", "offset": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'",
    "apache": "dd/MMM/yyyy:HH:mm:ss '+0000'", "mail": "'Mon, 'dd MMM yyyy HH:mm:ss '+0000'", "slashes": "yyyy/MM/dd HH:mm:ss", "words": "dd MMM yyyy HH:mm:ss",
}


@query(
    "SELECT event_id, epoch_us(ts) AS "
    + ", epoch_us(ts) AS ".join(["iso_z", "spaced", "offset"])
    + ", epoch_us(date_trunc('second', ts)) AS "
    + ", epoch_us(date_trunc('second', ts)) AS ".join(["apache", "mail", "slashes", "words", "syslog", "epoch_s"])
    + ", epoch_us(date_trunc('millisecond', ts)) AS epoch_ms, epoch_us(ts) AS epoch_us, epoch_us(ts) AS epoch_ns FROM events"
)
def parse_ts_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("t", F.timestamp_micros("ts_us"))
    written = {k: F.date_format("t", p) for k, p in _STAMPS.items()}
    written["syslog"] = F.date_format("t", "MMM d HH:mm:ss")
    us = F.col("ts_us")
    written["epoch_s"], written["epoch_ms"] = F.floor(us / 1_000_000).cast("string"), F.floor(us / 1000).cast("string")
    written["epoch_us"], written["epoch_ns"] = us.cast("string"), F.concat(us.cast("string"), F.lit("000"))
    return e.select("event_id", *[TS.parse_micros(v, F.col("t")).alias(k) for k, v in written.items()])


@query(
    r"""WITH l AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '[1]' WHEN event_id % 10 = 1 THEN 'x' ELSE 'ok' END AS k FROM events)
SELECT k = 'ok' AS good, count(*) AS n FROM l GROUP BY 1"""
)
def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad lines of a text made from the events: arrays and unreadable times are bad, blank lines neither."""
    e = _events(spark, sf_dir)
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("ts_us").alias("time"), F.col("event_type").alias("type")))
    line = F.when(F.col("event_id") % 10 == 0, F.lit("[1]")).when(F.col("event_id") % 10 == 1, F.lit('{"time": "never"}')).otherwise(good)
    lines = e.select(F.explode(F.array(line, F.lit("  "))).alias("value"), F.col("event_id").alias("seq"))
    parsed = parse_lines(lines, F.lit("2024-01-01").cast("timestamp"))
    return parsed.lines.groupBy("good").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id ELSE NULL END AS "user", CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS src_ip,
trim(regexp_replace(lower('A ' || event_type), '[^a-z0-9]+', '_', 'g'), '_') AS log_type FROM events"""
)
def alias_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fields from aliases; a canonical field that is null stays so."""
    e = _events(spark, sf_dir)
    user = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    entries = [
        F.struct(F.lit("user").alias("key"), user.alias("value")),
        F.struct(F.lit("username").alias("key"), F.lit("other").alias("value")),
        F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("source_ip").alias("key"), F.col("user_id").cast("string").alias("value"))),
        F.struct(F.lit("source.ip").alias("key"), F.col("event_type").alias("value")),
        F.struct(F.lit("type").alias("key"), F.concat(F.lit("A "), "event_type").alias("value")),
    ]
    fields = T.let(F.map_from_entries(F.array_compact(F.array(*entries))), lambda m: T.let(fill_aliases(m), canonical_type))
    get = lambda k: F.element_at("f", F.lit(k)).alias(k)
    return e.withColumn("f", fields).select("event_id", get("user"), get("src_ip"), get("log_type"))


# detections

_DAY = 86_400_000_000


def _fields() -> Fields:
    return of_columns(log_type=F.col("event_type"), user=F.col("user_id").cast("string"), value=F.col("value"), event_type=F.col("event_type"))


def _hits(spark: SparkSession, sf_dir: str, *docs: dict) -> tuple[DataFrame, list]:
    rules = [build_rule({"id": f"Q{i}", "name": f"query {i}", "severity": "high", **d}, order=i) for i, d in enumerate(docs)]
    events = _events(spark, sf_dir).withColumn("seq", F.col("event_id"))
    return detect.hits(events, rules, _fields(), F.col("event_id").cast("string")), rules


def _emitted(spark: SparkSession, sf_dir: str, doc: dict, dedupe: int) -> DataFrame:
    found, rules = _hits(spark, sf_dir, doc)
    _, fired = detect.fire(found, rules, dedupe)
    user = F.get_json_object("group_key", "$[0]").cast("long")
    return fired.filter("emitted").select(user.alias("user_id"), "ts_us", F.col("evidence_count").cast("long").alias("evidence_count"))


_CHAIN = """, chain AS (
SELECT g, min(i) AS i, arg_min(t, i) AS t, CAST(0 AS BIGINT) AS c FROM cand WHERE start > 0 GROUP BY g
UNION ALL
SELECT k.g, min(k.i), arg_min(k.t, k.i), max(chain.i) FROM chain JOIN cand k ON k.g = chain.g AND k.start > chain.i AND k.t - chain.t >= {dedupe} GROUP BY k.g)"""
_HITS = """WITH RECURSIVE h AS (SELECT user_id AS g, epoch_us(ts) AS t, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
FROM events WHERE {where})"""
_EVIDENCE = """
SELECT chain.g AS user_id, chain.t AS ts_us, count(*) AS evidence_count FROM chain JOIN h ON h.g = chain.g AND h.i > chain.c AND h.i <= chain.i AND chain.t - h.t <= {window}
GROUP BY ALL"""
_ERRORS = {"log_type": "error", "group_by": "user"}


def _threshold_sql(n: int, window: int, dedupe: int) -> str:
    cand = f", cand AS (SELECT g, t, i, i - {n - 1} AS start FROM (SELECT *, lag(t, {n - 1}) OVER (PARTITION BY g ORDER BY i) AS s FROM h) WHERE t - s <= {window})"
    return _HITS.format(where="event_type = 'error'") + cand + _CHAIN.format(dedupe=dedupe) + _EVIDENCE.format(window=window)


@query(_HITS.format(where="event_type = 'error'") + ", cand AS (SELECT g, t, i, i AS start FROM h)" + _CHAIN.format(dedupe=2 * _DAY) + " SELECT g AS user_id, t AS ts_us, CAST(1 AS BIGINT) AS evidence_count FROM chain")
def match_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emitted(spark, sf_dir, {"type": "match", **_ERRORS}, 172_800)


@query(_threshold_sql(3, _DAY, 2 * _DAY))
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three errors of a user within a day, at most one alert in two days."""
    return _emitted(spark, sf_dir, {"type": "threshold", "threshold": 3, "window": 86_400, **_ERRORS}, 172_800)


@query(
    _HITS.format(where="true")
    + ", n AS (SELECT *, lead(i) OVER (PARTITION BY g, v ORDER BY i) AS nxt FROM h), p AS (SELECT a.g, a.t, a.i, list(b.i ORDER BY b.i DESC)[4] AS start "
    + "FROM n a JOIN n b ON a.g = b.g AND b.i <= a.i AND (b.nxt IS NULL OR b.nxt > a.i) GROUP BY ALL)"
    + f", cand AS (SELECT p.g, p.t, p.i, p.start FROM p JOIN h ON p.g = h.g AND p.start = h.i WHERE p.t - h.t <= {_DAY})"
    + _CHAIN.format(dedupe=2 * _DAY)
    + _EVIDENCE.format(window=_DAY)
)
def distinct_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of events of a user within a day."""
    return _emitted(spark, sf_dir, {"type": "distinct_count", "field": "event_type", "threshold": 4, "window": 86_400, "group_by": "user"}, 172_800)


_SEQUENCE = {"type": "sequence", "group_by": "user", "window": 259_200, "steps": [{"conditions": {"event_type": "click"}, "count": 3}, {"conditions": {"event_type": "purchase"}}]}


@query(
    _HITS.format(where="true")
    + f""", f AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, 0 AS cnt, CAST(NULL AS BIGINT) AS st, false AS done FROM h
UNION ALL
SELECT g, i, t, CASE WHEN fin THEN 0 WHEN c0 < 3 AND v = 'click' THEN c0 + 1 ELSE c0 END, CASE WHEN fin THEN NULL WHEN c0 < 3 AND v = 'click' THEN coalesce(s0, t) ELSE s0 END, fin
FROM (SELECT *, c0 = 3 AND v = 'purchase' AS fin FROM (SELECT h.g, h.i, h.t, h.v, CASE WHEN h.t - f.st > {3 * _DAY} THEN 0 ELSE f.cnt END AS c0,
CASE WHEN h.t - f.st > {3 * _DAY} THEN NULL ELSE f.st END AS s0 FROM f JOIN h ON h.g = f.g AND h.i = f.i + 1)))
SELECT g AS user_id, t AS ts_us, CAST(4 AS BIGINT) AS evidence_count FROM f WHERE done"""
)
def sequence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clicks and then a purchase of a user within three days of the first click."""
    return _emitted(spark, sf_dir, _SEQUENCE, 0)


@query(
    _HITS.format(where="event_type = 'error'")
    + f", cand AS (SELECT g, t, i, i - 2 AS start FROM (SELECT *, lag(t, 2) OVER (PARTITION BY g ORDER BY i) AS s FROM h) WHERE t - s <= {_DAY})"
    + _CHAIN.format(dedupe=2 * _DAY)
    + f""", e AS (SELECT h.g, h.i, CAST(x.event_id AS VARCHAR) AS id FROM h JOIN events x ON x.user_id = h.g AND epoch_us(x.ts) = h.t AND x.event_type = 'error')
SELECT 'Q0' AS rule_id, chain.g AS user_id, CASE WHEN chain.t % 1000000 = 0 THEN strftime(make_timestamp(chain.t), '%Y-%m-%dT%H:%M:%S+00:00') ELSE strftime(make_timestamp(chain.t), '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS event_time,
array_to_string(list(e.id ORDER BY e.i)[-2:], ',') AS evidence
FROM chain JOIN h ON h.g = chain.g AND h.i > chain.c AND h.i <= chain.i AND chain.t - h.t <= {_DAY} JOIN e ON e.g = h.g AND e.i = h.i GROUP BY ALL"""
)
def evidence_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alerts with the last two events as evidence."""
    found, rules = _hits(spark, sf_dir, {"type": "threshold", "threshold": 3, "window": 86_400, **_ERRORS})
    a = detect.alerts(found, rules, 172_800, evidence_limit=2)
    return a.select("rule_id", F.element_at("group", F.lit("user")).cast("long").alias("user_id"), "event_time", F.array_join("evidence", ",").alias("evidence"))


@query(
    _HITS.format(where="event_type = 'error'")
    + ", cand AS (SELECT g, t, i, i AS start FROM h)"
    + _CHAIN.format(dedupe=2 * _DAY)
    + " SELECT 'Q0' AS rule_id, (SELECT count(*) FROM h) - (SELECT count(*) FROM chain) AS suppressed"
)
def suppressed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rules = _hits(spark, sf_dir, {"type": "match", **_ERRORS})
    return detect.suppressed(found, rules, 172_800)


@query("SELECT 'Q0' AS rule_id, 'even_user' AS field, count(*) AS skipped FROM events WHERE event_type = 'error' AND user_id % 2 = 1")
def skipped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that a windowed rule leaves out because their group field is missing."""
    rules = [build_rule({"id": "Q0", "name": "q", "severity": "low", "type": "threshold", "threshold": 2, "window": 60, "log_type": "error", "group_by": "even_user"})]
    fields = of_columns(log_type=F.col("event_type"), even_user=F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")))
    found = detect.hits(_events(spark, sf_dir).withColumn("seq", F.col("event_id")), rules, fields, F.lit(""))
    return detect.skipped(found, rules)


@query("SELECT coalesce(CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END, 'unknown') AS grp, count(*) AS hits FROM events WHERE event_type = 'error' GROUP BY 1")
def group_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rules put ``unknown`` for a missing group field."""
    rules = [build_rule({"id": "Q0", "name": "q", "severity": "low", "type": "match", "log_type": "error", "group_by": "even_user"})]
    fields = of_columns(log_type=F.col("event_type"), even_user=F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")))
    found = detect.hits(_events(spark, sf_dir).withColumn("seq", F.col("event_id")), rules, fields, F.lit(""))
    return found.groupBy(F.element_at("group", F.lit("even_user")).alias("grp")).agg(F.count(F.lit(1)).alias("hits"))


_MIXED = [
    {"type": "match", "log_type": "purchase", "conditions": {"value|gt": 95}, "group_by": "user", "severity": "low", "id": "LOW"},
    {"type": "match", "log_type": "error", "conditions": {"value|gt": 90}, "group_by": "user", "severity": "critical", "id": "TOP"},
    {"type": "match", "log_type": "signup", "severity": "medium", "conditions": {"value|lt": 2}, "id": "MID"},
]


def _count_sql(where: str) -> str:
    return f"SELECT count(*) FROM events WHERE {where}"


@query(
    f"""WITH r(name, sev, n) AS (VALUES ('LOW', 'low', ({_count_sql("event_type = 'purchase' AND value > 95")})), ('TOP', 'critical', ({_count_sql("event_type = 'error' AND value > 90")})),
('MID', 'medium', ({_count_sql("event_type = 'signup' AND value < 2")})))
SELECT 'rule' AS section, name, n AS alerts FROM r WHERE n > 0 AND sev <> 'low' UNION ALL SELECT 'severity', sev, n FROM r WHERE n > 0 AND sev <> 'low'"""
)
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rules in one scan without a throttle, those under medium dropped, counted by severity and rule."""
    found, rules = _hits(spark, sf_dir, *_MIXED)
    kept = detect.active(rules, "medium")
    return detect.summary(detect.fire(found.filter(F.col("rule").isin([r.order for r in kept])), kept, 0)[1], kept)


# heuristics


def _trailing_sql(where: str, window: int, what: str) -> str:
    return f"SELECT event_id, {what} OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {window * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events WHERE {where}"


@query(f"SELECT event_id, n FROM ({_trailing_sql(chr(39).join(['event_type = ', 'error', '']), 432_000, 'count(*)')}) WHERE n >= 5")
def trailing_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type = 'error'")
    n = heuristics.trailing_count(["user_id"], "ts_us", 432_000, ["event_id"], F.lit(True))
    return e.withColumn("n", n).filter("n >= 5").select("event_id", "n")


@query(f"SELECT event_id, n FROM ({_trailing_sql('true', 172_800, 'count(DISTINCT event_type)')}) WHERE n >= 4")
def trailing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heuristics.trailing_distinct(_events(spark, sf_dir), ["user_id"], "ts_us", 172_800, ["event_id"], F.col("event_type"), "n")
    return rows.filter("n >= 4").select("event_id", "n")


_THREAT_ROWS = """SELECT event_id, epoch_us(ts) AS t, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
CASE event_type WHEN 'error' THEN 'linux' WHEN 'view' THEN 'netflow' WHEN 'signup' THEN 'edr' WHEN 'purchase' THEN 'file_audit' ELSE 'dns' END AS log_type FROM events"""


@query(
    f"""WITH r AS ({_THREAT_ROWS}),
f AS (SELECT *, CASE WHEN log_type = 'linux' THEN count(*) OVER (PARTITION BY user_id, log_type ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) END AS fails,
CASE WHEN log_type = 'netflow' THEN count(DISTINCT k) OVER (PARTITION BY user_id, log_type ORDER BY t RANGE BETWEEN 29999999 PRECEDING AND CURRENT ROW) END AS ports FROM r)
SELECT CASE WHEN fails >= 5 THEN 'BRUTE_FORCE' WHEN ports >= 10 THEN 'PORT_SCAN' WHEN log_type = 'netflow' AND k IN (4444, 1337, 31337, 5555, 6666, 8888, 1234, 65535) THEN 'C2_BEACON'
WHEN log_type = 'edr' AND value > 60 THEN 'KNOWN_MALWARE' WHEN log_type = 'file_audit' AND value > 90 THEN 'SENSITIVE_FILE' WHEN log_type = 'netflow' AND value > 80 THEN 'EXFILTRATION'
WHEN log_type = 'dns' AND k > 50 THEN 'DGA_DOMAIN' END AS threat_type, log_type AS related_log_type, 'u' || user_id AS source, count(*) AS n FROM f
WHERE threat_type IS NOT NULL GROUP BY ALL"""
)
def threat_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks over rows of five log types made from the events."""
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kinds = {"error": "linux", "view": "netflow", "signup": "edr", "purchase": "file_audit"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("dns"))
    value = F.coalesce("value", F.lit(0.0))
    domain = F.when(F.col("k") > 50, "qwertyuiopasdfghjklz.example").otherwise("example.com")
    entries = {
        "attack_indicator": F.when(value > 60, "known_tool:x"), "sensitive": (value > 90).cast("string"), "file_path": F.lit("/etc/x"),
        "bytes": F.when(value > 80, "99999999").otherwise("1"), "query_name": domain,
    }
    extra = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])), lambda k, v: v.isNotNull())
    rows = e.select(
        kind.alias("log_type"), F.lit("block").alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_ip"),
        F.lit(None).cast("string").alias("destination_ip"), F.col("k").cast("int").alias("destination_port"), F.lit(None).cast("string").alias("hostname"),
        F.col("ts_us").cast("string").alias("timestamp"), F.col("event_id").cast("string").alias("raw"), extra.alias("extra"), "ts_us", F.col("event_id").alias("seq"),
    )
    found = heuristics.threats(rows)
    return found.groupBy("threat_type", "related_log_type", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH h AS (SELECT page_id, replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '') AS host FROM pages),
c AS (SELECT page_id, host, unnest(string_split(host, '')) AS ch FROM h WHERE host <> ''), p AS (SELECT page_id, host, ch, count(*) / length(host) AS p FROM c GROUP BY page_id, host, ch),
e AS (SELECT page_id, host, -sum(p * log2(p)) AS e FROM p GROUP BY ALL)
SELECT page_id, host, round(e, 6) AS bits FROM e WHERE e > 3.5 AND length(host) > 15"""
)
def entropy_dga(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.replace(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("."), F.lit(""))
    p = _table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    return p.filter(T.is_dga(F.col("host"))).select("page_id", "host", F.round(T.entropy(F.col("host")), 6).alias("bits"))


@query(
    "WITH u AS (SELECT page_id, url || CASE page_id % 9 WHEN 0 THEN '?q=1 UNION  select 2' WHEN 1 THEN '?<SCRIPT>' WHEN 2 THEN '/../x' WHEN 3 THEN '?a;id' WHEN 4 THEN ' sqlmap/1' "
    "WHEN 5 THEN '/etc/passwd' WHEN 6 THEN '/cmd.exe' ELSE '' END AS u FROM pages) SELECT page_id, CASE "
    + " ".join(f"WHEN regexp_matches(u, '(?i){p}') THEN '{n}'" for n, p in parsers.ATTACKS)
    + " END AS attack FROM u"
)
def url_attack_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["?q=1 UNION  select 2", "?<SCRIPT>", "/../x", "?a;id", " sqlmap/1", "/etc/passwd", "/cmd.exe"]
    tail = F.coalesce(*[F.when(F.col("page_id") % 9 == i, F.lit(t)) for i, t in enumerate(tails)], F.lit(""))
    return _table(spark, sf_dir, "pages").select("page_id", parsers.attack_type(F.concat("url", tail)).alias("attack"))


# parsers: lines made of the events, read back

def _ip() -> Column:
    return F.concat(F.lit("10."), (F.col("user_id") % 200).cast("string"), F.lit(".0."), (F.col("event_id") % 250).cast("string"))


_IP_SQL = "'10.' || user_id % 200 || '.0.' || event_id % 250"
def _port() -> Column:
    return (F.col("event_id") % 60000 + 1).cast("string")


_PORT_SQL = "CAST(event_id % 60000 + 1 AS VARCHAR)"


def _line(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _t() -> Column:
    return F.date_format("t", "MMM dd HH:mm:ss")


def _bad() -> Column:
    return F.col("event_type") == "error"


def _e() -> Column:
    return F.col("event_type")


#: log type -> lines, the columns that are read back, and their SQL.
_PARSED: dict[str, tuple[Callable[[], Column], list[str], str]] = {
    "firewall": (
        lambda: F.when(F.col("event_id") % 2 == 0, _line(_t(), " fw01 kernel: [UFW ", F.when(_bad(), "BLOCK").otherwise("ALLOW"), "] IN=eth0 SRC=", _ip(), " DST=8.8.8.8 PROTO=TCP SPT=1 DPT=", _port())).otherwise(
            _line(F.date_format("t", "MMM dd yyyy HH:mm:ss"), " fw01 %ASA-4-106023: ", F.when(_bad(), "Deny").otherwise("Permit"), " tcp src outside:", _ip(), "/1 dst inside:8.8.8.8/", _port())
        ),
        ["source_ip", "destination_port", "action", "severity", "protocol", "message"],
        f"""{_IP_SQL} AS source_ip, {_PORT_SQL} AS destination_port, CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS action,
CASE WHEN event_type = 'error' THEN 'medium' ELSE 'info' END AS severity, 'TCP' AS protocol,
'Firewall ' || CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END || 'ed ' || CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE 'tcp' END || ' ' || {_IP_SQL} || ' -> 8.8.8.8:' || {_PORT_SQL} AS message""",
    ),
    "dns": (
        lambda: _line(F.date_format("t", "dd-MMM-yyyy HH:mm:ss.SSS"), " queries: info: client @0x7f ", _ip(), "#", _port(), " (", _e(), ".example): query: ", _e(), ".example IN A + (10.0.0.1)"),
        ["source_ip", "source_port", "action", "message"],
        f"{_IP_SQL} AS source_ip, {_PORT_SQL} AS source_port, 'query' AS action, 'DNS query from ' || {_IP_SQL} || ': ' || event_type || '.example (A)' AS message",
    ),
    "dhcp": (
        lambda: F.when(_bad(), _line("10,", F.date_format("t", "MM/dd/yy,HH:mm:ss"), ",Assign,", _ip(), ",PC-", F.col("user_id").cast("string"), ",aa-bb-cc-dd-ee-ff")).otherwise(
            _line(_t(), " dhcp01 dhcpd: DHCPREQUEST on ", _ip(), " to aa:bb:cc:dd:ee:ff (PC-", F.col("user_id").cast("string"), ") via eth0")
        ),
        ["action", "message"],
        f"""CASE WHEN event_type = 'error' THEN 'assign' ELSE 'request' END AS action, CASE WHEN event_type = 'error' THEN 'DHCP Assign: IP ' || {_IP_SQL} || ' to PC-' || user_id || ' (aa-bb-cc-dd-ee-ff)'
ELSE 'DHCP DHCPREQUEST: IP ' || {_IP_SQL} || ' assigned to PC-' || user_id || ' (aa:bb:cc:dd:ee:ff)' END AS message""",
    ),
    "linux": (
        lambda: F.when(_bad(), _line(_t(), " web01 sshd[7]: Failed password for invalid user ", _e(), " from ", _ip(), " port ", _port(), " ssh2"))
        .when(_e() == "click", _line(_t(), " web01 sudo: ", _e(), " : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/sh"))
        .when(_e() == "view", _line(_t(), " web01 sshd[7]: Accepted publickey for ", _e(), " from ", _ip(), " port ", _port()))
        .otherwise(_line(_t(), " web01 cron[3]: job of ", _e())),
        ["action", "user", "source_ip", "message"],
        f"""CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'privilege_escalation' WHEN 'view' THEN 'allow' ELSE 'event' END AS action,
CASE WHEN event_type IN ('error', 'click', 'view') THEN event_type END AS "user", CASE WHEN event_type IN ('error', 'view') THEN {_IP_SQL} END AS source_ip,
CASE event_type WHEN 'error' THEN 'SSH login FAILED for ''error'' from ' || {_IP_SQL} WHEN 'click' THEN 'sudo: ''click'' ran as root: /bin/sh'
WHEN 'view' THEN 'SSH login SUCCESS for ''view'' from ' || {_IP_SQL} || ' via publickey' ELSE 'job of ' || event_type END AS message""",
    ),
    "windows": (
        lambda: F.when(
            F.col("event_id") % 2 == 0,
            _line(
                "<Event xmlns='http://x'><System><EventID>", F.when(_bad(), "4625").otherwise("4624"), "</EventID><TimeCreated SystemTime='2024-01-15T10:00:00Z'/><Computer>PC",
                "</Computer></System><EventData><Data Name='TargetUserName'>", _e(), "</Data><Data Name='IpAddress'>", _ip(), "</Data></EventData></Event>",
            ),
        ).otherwise(_line("EventID=", F.when(_bad(), "4625").otherwise("4624"), " TargetUserName=", _e(), " IpAddress=", _ip(), " Computer=PC")),
        ["event_id", "user", "source_ip", "hostname", "action", "severity", "message"],
        f"""CASE WHEN event_type = 'error' THEN '4625' ELSE '4624' END AS event_id, event_type AS "user", {_IP_SQL} AS source_ip, 'PC' AS hostname,
CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS action, CASE WHEN event_type = 'error' THEN 'high' ELSE 'info' END AS severity,
CASE WHEN event_type = 'error' THEN 'Windows: FAILED logon attempt' ELSE 'Windows: Successful logon' END || ' [user=' || event_type || ', from=' || {_IP_SQL} || ']' AS message""",
    ),
    "authentication": (
        lambda: F.when(
            F.col("event_id") % 2 == 0,
            _line('{"time": "2024-01-15T10:00:00Z", "actor": {"login": "', _e(), '"}, "client": {"ip": "', _ip(), '"}, "outcome": {"result": "', F.when(_bad(), "failure").otherwise("success"), '"}}'),
        ).otherwise(_line(_t(), " srv login[9]: ", F.when(_bad(), "failed login").otherwise("accepted login"), " of ", _e())),
        ["action", "severity", "user", "source_ip", "message"],
        f"""CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS action, CASE WHEN event_type <> 'error' THEN 'info' WHEN event_id % 2 = 0 THEN 'high' ELSE 'medium' END AS severity,
CASE WHEN event_id % 2 = 0 THEN event_type END AS "user", CASE WHEN event_id % 2 = 0 THEN {_IP_SQL} END AS source_ip,
CASE WHEN event_id % 2 = 0 THEN 'Auth ' || CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END || ' for ' || event_type || ' from ' || {_IP_SQL}
ELSE 'Auth event [login]: ' || CASE WHEN event_type = 'error' THEN 'failed login' ELSE 'accepted login' END || ' of ' || event_type END AS message""",
    ),
    "webserver": (
        lambda: _line(_ip(), " - - [", F.date_format("t", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', _e(), F.when(_bad(), "/../x").otherwise(""), ' HTTP/1.1" ', F.when(_e() == "view", "404").otherwise("200"), ' 5 "-" "agent"'),
        ["source_ip", "action", "severity", "message"],
        f"""{_IP_SQL} AS source_ip, CASE event_type WHEN 'error' THEN 'detect' WHEN 'view' THEN 'event' ELSE 'allow' END AS action,
CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'low' ELSE 'info' END AS severity, 'HTTP GET /' || event_type || CASE event_type WHEN 'error' THEN '/../x -> 200 [ATTACK:path_traversal]'
WHEN 'view' THEN ' -> 404' ELSE ' -> 200' END AS message""",
    ),
    "application": (
        lambda: F.when(F.col("event_id") % 2 == 0, _line('{"level": "', F.when(_bad(), "error").otherwise("info"), '", "msg": "m ', _e(), '", "service": "svc", "user_id": ', F.col("user_id").cast("string"), "}")).otherwise(
            _line("[", F.date_format("t", "yyyy-MM-dd HH:mm:ss"), "] ", F.when(_bad(), "ERROR").otherwise("INFO"), " svc: m ", _e())
        ),
        ["action", "severity", "user", "message"],
        """CASE WHEN event_type = 'error' THEN 'error' ELSE 'event' END AS action, CASE WHEN event_type = 'error' THEN 'medium' ELSE 'info' END AS severity,
CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS "user", '[svc] ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ': m ' || event_type AS message""",
    ),
    "netflow": (
        lambda: F.when(
            F.col("event_id") % 2 == 0,
            _line('{"src_ip": "', _ip(), '", "dst_ip": "8.8.8.8", "sport": 7, "dport": ', F.when(_bad(), "4444").otherwise("443"), ', "proto": "tcp", "bytes": ', F.when(_e() == "view", "20000000").otherwise("10"), ', "packets": 2}'),
        ).otherwise(_line("2024-01-15T10:00:00,2024-01-15T10:00:01,1.5,", _ip(), ",8.8.8.8,7,", F.when(_bad(), "4444").otherwise("443"), ",TCP,.A,", "2,", F.when(_e() == "view", "20000000").otherwise("10"))),
        ["source_ip", "destination_port", "action", "severity"],
        f"""{_IP_SQL} AS source_ip, CASE WHEN event_type = 'error' THEN '4444' ELSE '443' END AS destination_port, CASE WHEN event_type = 'error' THEN 'detect' ELSE 'connect' END AS action,
CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'medium' ELSE 'info' END AS severity""",
    ),
    "ids_ips": (
        lambda: F.when(
            F.col("event_id") % 2 == 0,
            _line('{"event_type": "', F.when(_bad(), "drop").when(_e() == "view", "dns").otherwise("alert"), '", "src_ip": "', _ip(), '", "alert": {"signature": "S ', _e(), '", "severity": 1, "signature_id": 9}}'),
        ).otherwise(_line("01/15-10:00:00.1  [**] [1:9:5] S ", _e(), " [**] [Classification: x] [Priority: 1] {tcp} ", _ip(), ":7 -> 8.8.8.8:80")),
        ["source_ip", "action", "severity", "message"],
        f"""{_IP_SQL} AS source_ip, CASE WHEN event_id % 2 = 1 THEN 'detect' WHEN event_type = 'error' THEN 'block' WHEN event_type = 'view' THEN 'event' ELSE 'detect' END AS action,
CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 'info' ELSE 'critical' END AS severity, CASE WHEN event_id % 2 = 1 THEN 'IDS DETECT: S ' || event_type
WHEN event_type = 'view' THEN 'Suricata dns event' WHEN event_type = 'error' THEN 'IDS BLOCK: S error' ELSE 'IDS DETECT: S ' || event_type END AS message""",
    ),
    "file_audit": (
        lambda: F.when(F.col("event_id") % 2 == 0, _line('type=PATH msg=audit(1705312225.123:4): item=0 name="', F.when(_bad(), "/etc/shadow").otherwise(_line("/srv/", _e())), '" inode=1')).otherwise(
            _line("type=SYSCALL msg=audit(1705312225.123:4): arch=c syscall=", F.when(_bad(), "87").otherwise("2"), ' comm="c" exe="/bin/', _e(), '" key=', F.when(_bad(), "del").otherwise('"k"'))
        ),
        ["timestamp", "action", "severity", "message"],
        """'2024-01-15T09:50:25.123Z' AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'file_access' WHEN event_type = 'error' THEN 'file_unlink' ELSE 'file_open' END AS action,
CASE WHEN event_id % 2 = 1 THEN 'medium' WHEN event_type = 'error' THEN 'high' ELSE 'info' END AS severity, CASE WHEN event_id % 2 = 0 AND event_type = 'error' THEN 'File access: /etc/shadow [SENSITIVE]'
WHEN event_id % 2 = 0 THEN 'File access: /srv/' || event_type WHEN event_type = 'error' THEN 'Audit syscall=unlink exe=/bin/error key=del' ELSE 'Audit syscall=open exe=/bin/' || event_type || ' key=k' END AS message""",
    ),
    "edr": (
        lambda: _line('{"hostname": "pc", "user": "', _e(), '", "event_type": "Proc Start", "process": {"name": "', F.when(_bad(), "Mimikatz.exe").when(_e() == "view", "certutil.exe").otherwise("a.exe"), '", "cmdline": "', F.when(_e() == "click", "IEX (1)").otherwise("x"), '"}}'),
        ["action", "severity", "user", "message"],
        """CASE WHEN event_type IN ('error', 'view', 'click') THEN 'detect' ELSE 'proc_start' END AS action, CASE WHEN event_type IN ('error', 'view', 'click') THEN 'high' ELSE 'info' END AS severity,
event_type AS "user", 'EDR Proc Start [proc=' || CASE event_type WHEN 'error' THEN 'Mimikatz.exe' WHEN 'view' THEN 'certutil.exe' ELSE 'a.exe' END || ', user=' || event_type || ']' ||
CASE event_type WHEN 'error' THEN ' ALERT:known_tool:Mimikatz.exe' WHEN 'view' THEN ' ALERT:lolbin:certutil.exe' WHEN 'click' THEN ' ALERT:suspicious_cmdline' ELSE '' END AS message""",
    ),
}


_UNREADABLE = ["", "   ", "no log line at all", "{\"broken\": ", "[1, 2]", "7"]


def _lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    return _events(spark, sf_dir).withColumn("t", F.timestamp_micros("ts_us")).select("event_id", "event_type", "user_id", "ts_us", "t", line.alias("value"))


def _parse_query(kind: str, line: Callable[[], Column], columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # among the lines are such as no parser reads
        lines = _lines(spark, sf_dir, line()).select(F.col("event_id").alias("id"), F.explode(F.array("value", *map(F.lit, _UNREADABLE))).alias("value"))
        made = parsers.parse(lines, kind)
        return made.select("id", *columns)

    return run


for _kind, (_l, _cols, _sql) in _PARSED.items():
    query(f"SELECT event_id AS id, {_sql} FROM events", f"parse_{_kind}")(_parse_query(_kind, _l, _cols))


@query(
    f"""SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN 'application' ELSE 'linux' END AS log_type,
CASE WHEN event_id % 3 = 0 THEN 'job of ' || event_type WHEN event_id % 3 = 1 THEN 'SSH login FAILED for ''' || event_type || ''' from ' || {_IP_SQL} ELSE 'nothing ' || event_type END AS message FROM events"""
)
def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [_line("<34>", _t(), " web01 cron[3]: job of ", _e()), _line("<34>", _t(), " web01 sshd[7]: Failed password for ", _e(), " from ", _ip(), " port 22"), _line("<13>nothing ", _e())]
    line = F.coalesce(*[F.when(F.col("event_id") % 3 == i, k) for i, k in enumerate(kinds)])
    made = parsers.parse_syslog(_lines(spark, sf_dir, line).select(F.col("event_id").alias("id"), "value"))
    return made.select("id", "log_type", "message")


_EXPORT_SQL = f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, 'firewall' AS log_type, CASE WHEN event_type = 'error' THEN 'medium' ELSE 'info' END AS severity, {_IP_SQL} AS source_ip,
'8.8.8.8' AS destination_ip, CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS action, 'Firewall ' || CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END || 'ed ' ||
CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE 'tcp' END || ' ' || {_IP_SQL} || ' -> 8.8.8.8:' || {_PORT_SQL} AS message FROM events"""


def _firewall_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every firewall line made of the events, UFW and ASA, parsed and normalized."""
    lines = _lines(spark, sf_dir, _PARSED["firewall"][0]()).select("value", "t")
    as_of = F.lit("2024-12-31 00:00:00").cast("timestamp")
    return normalize.normalize(parsers.parse(lines, "firewall").withColumnRenamed("t", "parsed_at"), _year_end(spark, sf_dir, as_of))


@query(_EXPORT_SQL)
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firewall lines parsed, normalized and projected to the columns of the CSV export."""
    return normalize.csv_columns(_firewall_log(spark, sf_dir))


@query(_EXPORT_SQL)
def export_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV export itself: from the newest capture in a folder, beside an older one and other files, to CSV, read back."""
    out = shared_dir(spark, "export")
    # parsed once, as three captures are made of it
    _firewall_log(spark, sf_dir).write.parquet(f"{out}/log")
    log = spark.read.parquet(f"{out}/log")
    capture.write_normalized(log.filter("severity = 'medium'"), f"{out}/live_capture_1.jsonl")
    capture.write_normalized(log, f"{out}/live_capture_2.jsonl")
    capture.write_normalized(log.filter("severity = 'info'"), f"{out}/other_3.jsonl")
    detection.export_csv(spark, out, f"{out}/csv")
    return spark.read.option("header", True).csv(f"{out}/csv")


@query(
    f"""SELECT event_id, epoch_us(ts) AS ts_us, trim(regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g'), '_') AS log_type, CAST(user_id AS VARCHAR) AS "user" FROM events"""
)
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as a folder of JSON-lines files, with files of other kinds and bad lines among them, and scanned."""
    out = shared_dir(spark, "scan")
    e = _events(spark, sf_dir)
    good = F.to_json(F.struct(F.col("event_id").alias("n"), F.col("ts_us").alias("@timestamp"), F.upper("event_type").alias("type"), F.col("user_id").alias("account")))
    e.select(F.explode(F.array(good, F.lit(""), F.lit("no object"))).alias("value")).write.option("fileExtension", "x").text(f"{out}/text")
    _renamed(spark, f"{out}/text", f"{out}/logs")
    found = parse_lines(read_lines(spark, f"{out}/logs"), F.lit("2024-01-01").cast("timestamp")).events
    get = lambda k: F.element_at("fields", F.lit(k))
    return found.select(get("n").cast("long").alias("event_id"), "ts_us", get("log_type").alias("log_type"), get("user").alias("user"))


def _renamed(spark: SparkSession, source: str, target: str) -> None:
    """Puts the files of a folder into another one under names that end in .jsonl, and a file of another kind beside them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(source)))
    for i, n in enumerate(x for x in names if x.startswith("part-")):
        fs.rename(path(f"{source}/{n}"), path(f"{target}/{i:05d}.jsonl"))
    fs.create(path(f"{target}/readme.txt"), True).close()


@query(
    _HITS.format(where="event_type = 'error'")
    + ", cand AS (SELECT g, t, i, i AS start FROM h)"
    + _CHAIN.format(dedupe=2 * _DAY)
    + " SELECT 'Q0' AS rule_id, 'high' AS severity, g AS user_id, t AS ts_us, CAST(1 AS BIGINT) AS evidence_count FROM chain"
)
def sink_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written as JSON lines, in two parts of which the second is appended, and read back."""
    out = shared_dir(spark, "alerts")
    found, rules = _hits(spark, sf_dir, {"type": "match", **_ERRORS})
    a = detect.alerts(found, rules, 172_800)
    early = F.col("event_ts") < F.lit("2024-01-10").cast("timestamp")
    detection.write_alerts(a.filter(early), f"{out}/alerts")
    detection.write_alerts(a.filter(~early), f"{out}/alerts", append=True)
    back = spark.read.schema("rule_id string, severity string, group map<string,string>, event_time string, evidence_count long").json(f"{out}/alerts")
    ts = F.unix_micros(F.to_timestamp("event_time"))
    return back.select("rule_id", "severity", F.element_at("group", F.lit("user")).cast("long").alias("user_id"), ts.alias("ts_us"), "evidence_count")


@query(
    f"""WITH l AS (SELECT event_type, {_IP_SQL} AS ip, epoch_us(date_trunc('second', ts)) AS t FROM events)
SELECT 'log' AS part, 'linux' AS kind, CASE WHEN event_type IN ('error', 'view') THEN ip END AS source, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT 'log', 'edr', NULL, count(*) FROM l
UNION ALL SELECT 'threat', 'BRUTE_FORCE', ip, count(*) FROM (SELECT ip, count(*) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS fails FROM l WHERE event_type = 'error')
WHERE fails >= 5 GROUP BY ip
UNION ALL SELECT 'threat', 'KNOWN_MALWARE', 'pc', count(*) FROM l WHERE event_type IN ('error', 'view', 'click') HAVING count(*) > 0"""
)
def capture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of two sources through the whole plan: parsed, normalized, written, read back and checked for threats."""
    lines = lambda k: _lines(spark, sf_dir, _PARSED[k][0]())
    as_of = _year_end(spark, sf_dir, F.lit("2024-12-31 00:00:00").cast("timestamp"))
    got = capture.run(spark, {"linux": lines("linux"), "edr": lines("edr")}, shared_dir(spark, "capture"), as_of)
    log = got.log.groupBy(F.lit("log").alias("part"), F.col("log_type").alias("kind"), F.col("source_ip").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    found = got.threats.groupBy(F.lit("threat").alias("part"), F.col("threat_type").alias("kind"), "source").agg(F.count(F.lit(1)).alias("n"))
    return log.unionByName(found)


_RULE_FILES = {
    "b.yml": "rules:\n- {id: B1, name: second file, severity: low, type: match, conditions: {event_type: $lists.odd}}\n- {id: B2, name: idle, severity: low, type: match, enabled: false}\n",
    "a.yaml": "rules:\n- {id: A1, name: first file, severity: critical, type: threshold, threshold: 3, window: 60, conditions: {'value|gt': 99}}\n",
    "notes.txt": "no rules here",
}


@query(
    """SELECT 'A1' AS rule_id, count(*) AS hits FROM events WHERE value > 99 HAVING count(*) > 0 UNION ALL
SELECT 'B1', count(*) FROM events WHERE event_type IN ('error', 'signup') HAVING count(*) > 0"""
)
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of rules that were loaded from a folder of files, with a named list and a disabled rule."""
    with tempfile.TemporaryDirectory() as folder:  # rules stay on the driver
        for name, text in _RULE_FILES.items():
            (Path(folder) / name).write_text(text)
        rules = load_rules(folder, {"odd": ["ERROR", "signup"]})
    found = detect.hits(_events(spark, sf_dir).withColumn("seq", F.col("event_id")), rules, _fields(), F.lit(""))
    return found.groupBy(F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.order, r.id)]), F.col("rule")).alias("rule_id")).agg(F.count(F.lit(1)).alias("hits"))


@query(
    """WITH l AS (SELECT event_id AS id, event_id % 4 AS k, event_id % 500 + 1 AS n FROM events)
SELECT id, CASE k WHEN 0 THEN least(n, 200) WHEN 1 THEN 16 + least(n + 1, 80) WHEN 2 THEN NULL ELSE least(n, 120) END AS message,
CASE k WHEN 1 THEN least(n + 1, 200) WHEN 2 THEN least(n, 300) END AS field, CASE WHEN k = 1 THEN least(n, 200) END AS agent FROM l"""
)
def truncated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long messages, paths, agents and commands of up to 500 characters become."""
    n = (F.col("event_id") % 500 + 1).cast("int")
    long = lambda c: F.repeat(F.lit(c), n)
    forms = {
        "linux": _line(_t(), " web01 cron[3]: ", long("m")), "webserver": _line("10.0.0.1 - - [15/Jan/2024:10:00:00 +0000] \"GET /", long("p"), ' HTTP/1.1" 200 5 "-" "', long("a"), '"'),
        "edr": _line('{"hostname": "pc", "user": "u", "event_type": "x", "process": {"name": "a.exe", "cmdline": "', long("c"), '"}}'), "syslog": _line("<13>", long("z")),
    }
    parts = []
    for i, (kind, line) in enumerate(forms.items()):
        rows = _lines(spark, sf_dir, line).filter(F.col("event_id") % 4 == i).select(F.col("event_id").alias("id"), "value")
        made = parsers.parse_syslog(rows) if kind == "syslog" else parsers.parse(rows, kind)
        size = lambda k: F.length(F.element_at("extra", F.lit(k)))
        shown = F.length("message") if kind != "edr" else F.lit(None).cast("int")
        parts.append(made.select("id", shown.cast("long").alias("message"), F.coalesce(size("url_path"), size("cmdline")).cast("long").alias("field"), size("user_agent").cast("long").alias("agent")))
    return reduce(DataFrame.unionByName, parts)


def _year_end(spark: SparkSession, sf_dir: str, default: Column) -> Column:
    """The last day of the year that the events lie in, which dates their syslog times."""
    last = _table(spark, sf_dir, "events").agg(F.max(_micros())).first()[0]
    return default if last is None else F.timestamp_micros(F.lit(int(last)))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 70000 END AS source_port, CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'high' END AS severity, upper(event_type) AS protocol,
'[netflow] event' AS message, event_id % 70000 > 65535 AND event_id % 4 <> 0 AS wrong, CAST(user_id AS VARCHAR) AS note FROM events"""
)
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, coercions, defaults, packing and checks of records with odd fields."""
    e = _events(spark, sf_dir)
    port = F.when(F.col("event_id") % 4 == 0, F.lit("none")).otherwise((F.col("event_id") % 70000).cast("string"))
    rows = e.select(
        F.lit("netflow").alias("log_type"), port.alias("src_port"), F.when(_bad(), "odd").otherwise("high").alias("severity"), _e().alias("proto"),
        F.col("user_id").alias("note"), F.col("event_id").cast("string").alias("raw"), F.lit("2024-01-15T10:00:00Z").alias("timestamp"),
    )
    n = normalize.normalize(rows, F.lit("2024-01-01").cast("timestamp"))
    return n.select(
        F.col("raw").cast("long").alias("event_id"), F.coalesce("source_port", F.lit(-1)).cast("long").alias("source_port"), "severity", "protocol", "message",
        F.map_contains_key("extra", F.lit("_validation_errors")).alias("wrong"), F.element_at("extra", F.lit("note")).alias("note"),
    )


@query(
    """SELECT event_id, 'endpoint_edr' AS log_type, CASE event_type WHEN 'error' THEN 'Mimikatz.exe' WHEN 'view' THEN 'certutil.exe' ELSE 'a.exe' END AS process_name,
CASE WHEN event_type = 'click' THEN 'IEX (1)' ELSE 'x' END AS command_line FROM events"""
)
def bridge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.to_fields(_edr_rows(spark, sf_dir), bridge=True)
    get = lambda k: F.element_at("fields", F.lit(k)).alias(k)
    return rows.select(F.col("id").alias("event_id"), get("log_type"), get("process_name"), get("command_line"))


def _edr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parse(_lines(spark, sf_dir, _PARSED["edr"][0]()).select(F.col("event_id").alias("id"), "value"), "edr")


# collectors


@query(
    f"SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'block' ELSE 'allow' END AS action, {_IP_SQL} AS source_ip, {_PORT_SQL} AS destination_port FROM events WHERE event_id % 5 <> 0"
)
def live_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 5 == 0, "#Fields: date time").otherwise(
        _line(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), " ", F.when(_bad(), "DROP").otherwise("ALLOW"), " TCP ", _ip(), " 8.8.8.8 7 ", _port())
    )
    lines = _lines(spark, sf_dir, line).select(F.col("event_id").alias("id"), "value")
    return live.firewall_lines(lines).select("id", "action", "source_ip", "destination_port")


@query(
    """SELECT DISTINCT 'u' || user_id AS source_ip, '8.8.8.8' AS destination_ip, CASE WHEN event_type = 'error' THEN '4444' ELSE '443' END AS destination_port,
CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity FROM events WHERE event_type <> 'view'"""
)
def live_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.lit(7).alias("sport"), F.when(_e() == "view", "127.0.0.1").otherwise("8.8.8.8").alias("dst"),
        F.when(_bad(), 4444).otherwise(443).alias("dport"),
    )
    return live.connections(rows, F.lit("2024-01-15T10:00:00Z")).select("source_ip", "destination_ip", "destination_port", "severity")


@query("SELECT min(user_id) AS pid, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def live_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("pid"))
    return live.processes(rows).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT DISTINCT 'DNS query from 127.0.0.1: ' || event_type || '.example (A)' AS message, 'info' AS severity FROM events
UNION ALL SELECT 'DNS query from 127.0.0.1: qwertyuiopasdfghjklz.example (A) [DGA-SUSPECTED]', 'high'"""
)
def live_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    name = F.explode(F.array(_line(_e(), ".example"), F.lit("qwertyuiopasdfghjklz.example")))
    return live.dns_cache(e.select(name.alias("domain"), F.lit(None).cast("string").alias("record_type")), F.lit("15-Jan-2024 10:00:00.000")).select("message", "severity")


def _xml(spark: SparkSession, sf_dir: str, eid: Column) -> DataFrame:
    event = _line(
        "<Event><System><Provider Name='svc'/><EventID>", eid, "</EventID><Level>", F.when(_bad(), "1").when(_e() == "view", "4").otherwise("3"),
        "</Level><EventRecordID>", F.col("event_id").cast("string"), "</EventRecordID><TimeCreated SystemTime='2024-01-15T10:00:00.123Z'/><Computer>PC</Computer></System>",
        "<EventData><Data Name='TargetUserName'>", F.col("event_id").cast("string"), "</Data><Data Name='ObjectName'>C:\\", F.when(_bad(), "Windows\\SAM").otherwise("a"), "</Data></EventData></Event>",
    )
    return _lines(spark, sf_dir, _line("noise ", event, " ", F.lit(" noise"))).select("value")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS "user", CASE WHEN event_type = 'error' THEN '4625' ELSE '4624' END AS event_id, CASE WHEN event_type = 'error' THEN 'high' ELSE 'info' END AS severity,
'authentication' AS log_type FROM events WHERE event_id > 100 AND event_type <> 'view'"""
)
def live_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _xml(spark, sf_dir, F.when(_bad(), "4625").when(_e() == "view", "1").otherwise("4624"))
    return live.login_events(docs, 100).select("user", "event_id", "severity", "log_type")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS "user", CASE WHEN event_type = 'error' THEN 'critical' ELSE 'medium' END AS severity, 'svc' AS service FROM events
WHERE event_id > 100 AND event_type <> 'view'"""
)
def live_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _xml(spark, sf_dir, F.lit("1000"))
    return live.application_events(docs, 100).select("user", "severity", F.element_at("extra", F.lit("service")).alias("service"))


@query(
    """SELECT '2024-01-15T10:00:00.123Z' AS timestamp, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity,
CASE WHEN event_type = 'error' THEN 'File access: C:\\Windows\\SAM' ELSE 'File access: C:\\a' END AS message, count(*) AS n FROM events GROUP BY ALL""".replace("\\\\", "\\")
)
def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _xml(spark, sf_dir, F.lit("4663"))
    return live.file_events(docs).groupBy("timestamp", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE WHEN event_type = 'error' THEN 'assign' ELSE 'unknown' END AS action, CASE WHEN event_type = 'error' THEN 'DHCPACK' ELSE 'DHCPEVENT' END AS kind, count(*) AS n
FROM events GROUP BY ALL"""
)
def live_dhcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _xml(spark, sf_dir, F.when(_bad(), "50032").otherwise("1"))
    made = live.dhcp_events(docs).select("action", F.element_at("extra", F.lit("dhcp_message_type")).alias("kind"))
    return made.groupBy("action", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS \"user\", 'PC' AS hostname FROM events WHERE event_id > 50")
def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.windows_events(_xml(spark, sf_dir, F.lit("4624")), 50).select("user", "hostname")


@query(
    """SELECT 'h' || e.user_id AS host, e.event_type AS channel, e.event_id AS record_id FROM events e
LEFT JOIN (SELECT user_id, event_type, max(event_id) AS last FROM events WHERE event_id <= 500 GROUP BY ALL) m ON m.user_id = e.user_id AND m.event_type = e.event_type
WHERE e.event_id > coalesce(m.last, -1)"""
)
def live_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every channel of every host, above what an earlier delivery of each brought."""
    host, number = F.concat(F.lit("h"), F.col("user_id").cast("string")), F.col("event_id").cast("string")
    event = _line("<Event><System><EventRecordID>", number, "</EventRecordID><Channel>", _e(), "</Channel><Computer>", host, "</Computer></System></Event>")
    docs = _events(spark, sf_dir).select("event_id", event.alias("value"))
    return live.new_events(docs, live.bookmarks(docs.filter("event_id <= 500"))).select("host", "channel", "record_id")


@query("SELECT 'access.log' AS source_file, count(*) AS n FROM events")
def live_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, _PARSED["webserver"][0]()).select("value")
    made = live.web_lines(lines, F.lit("/var/log/nginx/access.log"))
    return made.groupBy(F.element_at("extra", F.lit("source_file")).alias("source_file")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS log_type, 'm' || user_id AS source_machine, count(*) AS n FROM events GROUP BY ALL")
def live_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(_e().alias("_log_type"), F.lit("{}").alias("raw"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("source_machine"))
    made = live.agent_records(rows).select("log_type", F.element_at("extra", F.lit("source_machine")).alias("source_machine"))
    return made.groupBy("log_type", "source_machine").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'm' || user_id AS source_machine, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL")
def live_agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that agents post, read by the parser of their type; those of an unknown type are left out."""
    kind = F.when(_bad(), "dns").when(_e() == "click", "edr").otherwise("other")
    raw = F.when(_bad(), _PARSED["dns"][0]()).otherwise(_PARSED["edr"][0]())
    rows = _events(spark, sf_dir).withColumn("t", F.timestamp_micros("ts_us"))
    rows = rows.select(kind.alias("_log_type"), raw.alias("raw"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("source_machine"))
    return live.agent_parsed(rows).groupBy(F.element_at("extra", F.lit("source_machine")).alias("source_machine")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(coalesce(p, -1) AS BIGINT) AS source_port, severity, ip AS source_ip, count(*) AS n FROM (SELECT event_id % 70000 AS p, CASE event_type WHEN 'error' THEN 'critical' ELSE 'medium' END AS severity,
"""
    + _IP_SQL
    + """ AS ip FROM events) GROUP BY ALL"""
)
def live_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an intrusion sensor writes, as a stream of its files."""
    out = shared_dir(spark, "sensor")
    alert = _line(
        '{"timestamp": "2024-01-15T10:00:00.000000+0000", "event_type": "alert", "src_ip": "', _ip(), '", "src_port": ', (F.col("event_id") % 70000).cast("string"),
        ', "dest_ip": "8.8.8.8", "dest_port": 443, "proto": "TCP", "alert": {"signature": "', _e(), '", "severity": ', F.when(_bad(), "1").otherwise("3"), "}}",
    )
    _lines(spark, sf_dir, alert).select("value").write.text(f"{out}/eve")
    made = parsers.parse(spark.readStream.text(f"{out}/eve"), "ids_ips")
    rows = _streamed(made.select(F.coalesce(F.col("source_port").cast("long"), F.lit(-1)).alias("source_port"), "severity", "source_ip"), out)
    return rows.groupBy("source_port", "severity", "source_ip").agg(F.count(F.lit(1)).alias("n"))


def _streamed(rows: DataFrame, out: str) -> DataFrame:
    """What a stream gives for what is there now, written as Parquet and read back."""
    spark = rows.sparkSession
    for k, v in STORE.items():
        spark.conf.set(k, v)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("SELECT 'm' || user_id AS source_machine, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY user_id")
def agent_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of agents, every one of them sent twice and landed in other files, each record taken once."""
    out = shared_dir(spark, "posts")
    e = _events(spark, sf_dir).withColumn("source_machine", F.concat(F.lit("m"), F.col("user_id").cast("string")))
    e = e.withColumn("post", F.floor(F.col("event_id") / 50))
    # a record's place in its post is its rank there, found within one post
    posts = e.groupBy("source_machine", "post").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    records = posts.select("source_machine", "post", F.size("ids").cast("long").alias("size"), F.posexplode("ids").alias("place", "id"))
    records = records.select("source_machine", "post", F.col("place").cast("long").alias("place"), "size", F.lit("dns").alias("_log_type"), F.col("id").cast("string").alias("raw"))
    for _ in range(2):
        records.write.mode("append").json(f"{out}/landing")
    rows = _streamed(landing.once(landing.landed(spark, f"{out}/landing")), out)
    return rows.groupBy("source_machine").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw").cast("long")).alias("ids"))


@query(
    """SELECT 'L1' AS rule_id, count(*) AS hits FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) HAVING count(*) > 0
UNION ALL SELECT 'L2', count(*) FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) HAVING count(*) > 0
UNION ALL SELECT 'L3', count(*) FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE value > 99.5) HAVING count(*) > 0"""
)
def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of rules whose lists are tables: joined, not written into the plan."""
    rich = ListTable("rich", rows=_table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey"))
    loud = ListTable("loud", rows=_events(spark, sf_dir).filter("value > 99.5").select("event_type"))
    docs = [{"user": "$lists.rich"}, {"event_type": "ERROR", "user|nin": "$lists.rich"}, {"event_type|nin": "$lists.loud"}]
    rules = [build_rule({"id": f"L{i + 1}", "name": "n", "severity": "low", "type": "match", "conditions": c}, {"rich": rich, "loud": loud}, i) for i, c in enumerate(docs)]
    found = detect.hits(_events(spark, sf_dir).withColumn("seq", F.col("event_id")), rules, _fields(), F.lit(""))
    return found.groupBy(F.concat(F.lit("L"), (F.col("rule") + 1).cast("string")).alias("rule_id")).agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT 'h' || user_id AS hostname, count(*) AS rows, count(*) FILTER (event_type = 'error') AS grave FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def machine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every machine had to say, and how much of it was grave."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("hostname"), F.when(_bad(), "high").otherwise("info").alias("severity"))
    return sinks.fleet(rows)


@query(
    """SELECT '{"a":' || (user_id % 7) || ',"b":[1,"' || event_type || '"]}' AS ctx, count(*) AS hits FROM events WHERE user_id IS NOT NULL GROUP BY ALL"""
)
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a nested object whose keys and white space come in either order: equal objects are one group."""
    a, b = _line('"a":', (F.col("user_id") % 7).cast("string")), _line('"b": [1,"', _e(), '"]')
    ctx = F.when(F.col("event_id") % 2 == 0, _line("{", a, ",", b, "}")).otherwise(_line("{", b, " , ", a, "}"))
    e = _events(spark, sf_dir).filter("user_id IS NOT NULL").withColumn("seq", F.col("event_id")).withColumn("ctx", ctx)
    rules = [build_rule({"id": "N", "name": "n", "severity": "low", "type": "threshold", "threshold": 3, "window": 60, "group_by": ["ctx"]})]
    found = detect.hits(e, rules, of_columns(log_type=_e(), ctx=F.col("ctx")), F.lit(""))
    return found.groupBy(F.element_at("group", F.lit("ctx")).alias("ctx")).agg(F.count(F.lit(1)).alias("hits"))


@query(
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_type AS log_type, CASE event_type WHEN 'error' THEN 'high' ELSE 'info' END AS severity,
left(repeat(event_type || event_id, 20), 100) AS message, event_type = 'error' OR user_id % 5 = 0 AS alarm FROM events ORDER BY event_id LIMIT 40"""
)
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of the first rows; here the limit is the feature."""
    e = _events(spark, sf_dir).orderBy("event_id")
    rows = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), _e().alias("log_type"), F.when(_bad(), "high").otherwise("info").alias("severity"),
        F.repeat(_line(_e(), F.col("event_id").cast("string")), F.lit(20)).alias("message"), (F.col("user_id") % 5 == 0).alias("THREAT"),
    )
    return detection.preview(rows, 40)


def entry(spark: SparkSession) -> DataFrame:
    """The threshold detection over the smallest table."""
    return QUERIES["threshold_alerts"](spark, "/root/testdata/sf0.001")
