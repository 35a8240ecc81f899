"""Batch detection from files to alerts, and its sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..operators.conditions import of_map
from ..operators.normalize import SCHEMA, csv_columns
from ..operators.rules import Rule, rulebook
from ..sources.events import ALIASES, read_events


@dataclass(frozen=True)
class Report:
    """Results that share the hits and the attempted alerts of one scan, which are kept with the executors until ``release``."""

    hits: DataFrame
    fired: DataFrame
    alerts: DataFrame
    suppressed: DataFrame
    skipped: DataFrame
    summary: DataFrame
    bad_lines: DataFrame

    def release(self) -> None:
        self.fired.unpersist()
        self.hits.unpersist()


def run(
    spark: SparkSession, path: str, rules: Sequence[Rule] | None = None, dedupe_seconds: int = 120, evidence_limit: int = 5, min_severity: str = "low",
    as_of: Column | None = None, aliases: dict[str, list[str]] = ALIASES,
) -> Report:
    """Reads normalized JSON lines and evaluates the rules over them."""
    rules = list(rules) if rules is not None else rulebook()
    parsed = read_events(spark, path, as_of, aliases)
    # fields of internal use, whose names start with an underscore, are no evidence
    hidden = F.exists(F.map_keys("fields"), lambda k: k.startswith("_"))
    raw = F.when(hidden, F.to_json(F.map_filter("fields", lambda k, v: ~k.startswith("_")))).otherwise(F.col("raw"))
    found = detect.hits(parsed.events, rules, of_map(), raw).persist(StorageLevel.MEMORY_AND_DISK)
    kept = detect.active(rules, min_severity)
    placed, fired = detect.fire(found.filter(F.col("rule").isin([r.order for r in kept])), kept, dedupe_seconds)
    fired = fired.persist(StorageLevel.MEMORY_AND_DISK)
    alerts = detect.alerts_of(placed, fired, kept, evidence_limit)
    return Report(found, fired, alerts, detect.suppressed_of(fired, kept), detect.skipped(found, rules), detect.summary(fired, kept), parsed.bad)


def write_alerts(alerts: DataFrame, path: str, append: bool = False) -> None:
    """Alerts as JSON lines."""
    alerts.drop("group_key", "event_ts").write.mode("append" if append else "overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def newest_file(spark: SparkSession, folder: str, pattern: str = "live_capture_*.jsonl") -> str | None:
    """The capture of a folder, a file or a folder of parts, that was changed last, of those whose name fits; of equal times the last by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found), default=(0, None))[1]


def export_csv(spark: SparkSession, folder: str, out: str, pattern: str = "live_capture_*.jsonl") -> str | None:
    """The newest capture file as CSV with the seven columns; returns the file, None if there is none."""
    found = newest_file(spark, folder, pattern)
    if found is not None:
        write_csv(csv_columns(spark.read.schema(SCHEMA).json(found)), out)
    return found


def preview(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first rows with their message cut to 100 characters; ``alarm`` marks grave ones and threats."""
    grave = F.coalesce(F.upper("severity").isin("CRITICAL", "HIGH"), F.lit(False))
    if "THREAT" in rows.columns:
        grave = grave | F.coalesce(F.col("THREAT"), F.lit(False))
    kind = F.coalesce(*[F.col(c) for c in ("log_type", "related_log_type") if c in rows.columns])
    return rows.select("timestamp", kind.alias("log_type"), "severity", F.substring("message", 1, 100).alias("message"), grave.alias("alarm")).limit(n)


def show(alerts: DataFrame, n: int = 50) -> str:
    """A console report of the first alerts."""
    rows = alerts.select("event_time", "severity", "rule_id", "rule_name", "group", "evidence_count").limit(n).collect()
    line = lambda r: f"{r.event_time} {r.severity.upper():8} {r.rule_id} {r.rule_name} {dict(r.group)} ({r.evidence_count} events)"
    return "\n".join(map(line, rows))
