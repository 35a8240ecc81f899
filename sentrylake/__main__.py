"""Command line: ``python -m sentrylake --logs FILE`` and the like."""

from __future__ import annotations

import argparse
import sys
from glob import has_magic

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import detect
from .operators.conditions import of_map
from .operators.rules import RuleError, load_rules, rulebook
from .plans import capture, detection
from .plans.config import load_config
from .session import utc
from .sources.events import parse_lines
from .sources.live import followed
from .sources.tail import TailSource
from .streaming.detector import STORE, detect_stream
from .streaming.sinks import Detections, Fleet, Status, to_json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sentrylake", description="Rules over normalized JSON-lines events.")
    p.add_argument("--logs", help="file or folder of normalized events")
    p.add_argument("--follow", help="one growing file to watch, or a pattern of many")
    p.add_argument("--lateness", help="with --follow: take events in order of time, waiting so long for late ones, such as '10 minutes'")
    p.add_argument("--capture", action="append", metavar="TYPE=PATH", help="raw lines of a log type, or of any under syslog; may be given again")
    p.add_argument("--watch", action="store_true", help="with --capture: go on as files arrive in the folders")
    p.add_argument("--rules", help="rule file or folder; the package's rulebook by default")
    p.add_argument("--config", help="settings file")
    p.add_argument("--out", help="where alerts go as JSON lines")
    p.add_argument("--checkpoint", default="checkpoint", help="with --follow: where its state is kept")
    p.add_argument("--min-severity", choices=("low", "medium", "high", "critical"))
    p.add_argument("--validate", action="store_true", help="only check the rules")
    args = p.parse_args(argv)
    config = load_config(args.config)
    try:
        rules = load_rules(args.rules, config.lists) if args.rules else rulebook(config.lists)
    except RuleError as e:
        print(f"rule error: {e}", file=sys.stderr)
        return 2
    if args.validate:
        print(f"{len(rules)} rules are fine")
        return 0
    if not (args.logs or args.follow or args.capture):
        p.error("--logs, --follow or --capture is needed")
    if args.capture and any("=" not in c for c in args.capture):
        p.error("--capture takes TYPE=PATH")
    severity, out = args.min_severity or config.min_severity, args.out or config.json_file
    spark = SparkSession.builder.appName("sentrylake").getOrCreate()
    with utc(spark):
        if args.capture:
            given = dict(c.split("=", 1) for c in args.capture)
            if args.watch:
                status, known = Status(), Fleet(capture.FLEET)
                for x in (status, known):
                    spark.streams.addListener(x)
                try:
                    capture.follow({k: spark.readStream.text(v) for k, v in given.items()}, args.out or "capture", args.checkpoint).awaitTermination()
                except KeyboardInterrupt:
                    pass
                print(f"rows: {status.rows}, grave: {status.grave}, machines: {known.machines}")
                return 0
            done = capture.run(spark, {k: spark.read.text(v) for k, v in given.items()}, args.out or "capture")
            print(f"rows: {done.rows}")
            for r in done.threats.groupBy("threat_type").count().orderBy("threat_type").collect():
                print(f"{r.threat_type}: {r['count']}")
            return 0
        if args.follow:
            for k, v in STORE.items():
                spark.conf.set(k, v)
            if has_magic(args.follow):
                lines = followed(spark, args.follow).select("value", F.struct("path", "offset").alias("seq"))
            else:
                spark.dataSource.register(TailSource)
                lines = spark.readStream.format("line_tail").option("path", args.follow).load().withColumnRenamed("offset", "seq")
            kept = detect.active(rules, severity)
            hits = detect.hits(parse_lines(lines, F.current_timestamp(), config.aliases).events, rules, of_map(), F.col("raw"))
            seen = Detections()
            spark.streams.addListener(seen)
            try:
                late = {"lateness": args.lateness, "ordered": True} if args.lateness else {}
                to_json(detect_stream(hits, kept, config.dedupe_seconds, config.evidence_limit, **late), out or "alerts", args.checkpoint).awaitTermination()
            except KeyboardInterrupt:
                pass
            print(f"alerts: {seen.emitted}, suppressed: {seen.suppressed}, skipped for want of a field: {seen.skipped}")
            return 0
        report = detection.run(spark, args.logs, rules, config.dedupe_seconds, config.evidence_limit, severity, aliases=config.aliases)
        alerts = report.alerts.persist()
        if out:
            detection.write_alerts(alerts, out)
        if config.console:
            print(detection.show(alerts))
        for r in report.summary.collect():
            print(f"{r.section} {r['name']}: {r.alerts}")
        for r in report.skipped.orderBy("rule_id", "field").collect():
            print(f"skipped by {r.rule_id} for want of {r.field}: {r.skipped}")
        print(f"bad lines: {report.bad_lines.count()}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
