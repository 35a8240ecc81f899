"""Seven threat checks over normalized rows, in event time; the first that holds names the threat.

Windows leave out their lower end: a row exactly ``window`` seconds older does
not count. Every row past a limit is reported, without de-duplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_label, is_dga

BRUTE_WINDOW, BRUTE_COUNT = 60, 5
SCAN_WINDOW, SCAN_PORTS = 30, 10
C2_PORTS = (4444, 1337, 31337, 5555, 6666, 8888, 1234, 65535)
EXFIL_BYTES = 50 * 1024 * 1024
_ORDER = ("BRUTE_FORCE", "PORT_SCAN", "C2_BEACON", "KNOWN_MALWARE", "SENSITIVE_FILE", "EXFILTRATION", "DGA_DOMAIN")
_SEVERITY = {"BRUTE_FORCE": "critical", "C2_BEACON": "critical", "KNOWN_MALWARE": "critical"}


def trailing_count(key: list[str], ts_us: str, window: int, order: list[str], when: Column) -> Column:
    """How many rows of the key, this one included, fall in the last ``window`` seconds, later arrivals of the same instant left out.

    It is the difference of two running counts, which takes the same time however many rows a window holds.
    """
    by_time = Window.partitionBy(*key).orderBy(ts_us)
    one = F.when(when, 1)
    so_far = F.count(one).over(Window.partitionBy(*key).orderBy(ts_us, *order).rowsBetween(Window.unboundedPreceding, 0))
    return so_far - F.count(one).over(by_time.rangeBetween(Window.unboundedPreceding, -window * 1_000_000))


def trailing_distinct(rows: DataFrame, key: list[str], ts_us: str, window: int, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the column ``name``: distinct non-null values of the key in the last ``window`` seconds, in arrival order.

    A value enters where its last occurrence is no longer in the window, and leaves ``window`` seconds after an
    occurrence that none follows in time; the count is the running sum of both, so no window is ever collected.
    """
    span, cols = window * 1_000_000, rows.columns
    occurrence = Window.partitionBy(*key, "__value").orderBy(ts_us, *order)
    ts, there = F.col(ts_us), F.col("__value").isNotNull()
    seen = rows.withColumn("__value", value).withColumn("__last", F.lag(ts_us).over(occurrence)).withColumn("__next", F.lead(ts_us).over(occurrence))
    enters = there & (F.col("__last").isNull() | (ts - F.col("__last") >= span))
    leaves = there & (F.col("__next").isNull() | (F.col("__next") - ts >= span))
    change = lambda at, row, by: F.struct(at.alias("at"), F.lit(row).alias("row"), by.alias("by"))
    both = F.array_compact(F.array(change(ts, 1, enters.cast("int")), F.when(leaves, change(ts + span, 0, F.lit(-1)))))
    steps = seen.withColumn("__change", F.explode(both))
    # a value that leaves needs its key only
    kept = [F.col(f"`{c}`") if c in key or c in order else F.when(F.col("__change.row") == 1, F.col(f"`{c}`")).alias(c) for c in cols]
    steps = steps.select(*kept, F.col("__change.at").alias("__at"), F.col("__change.row").alias("__row"), F.col("__change.by").alias("__by"))
    running = Window.partitionBy(*key).orderBy("__at", "__row", *order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(name, F.sum("__by").over(running)).filter("__row = 1").drop("__at", "__row", "__by")


def concerned() -> tuple[Column, Column, Column]:
    """The source of a normalized row, whether it counts as a failed login and whether it counts as a contact with a port."""
    src = F.coalesce("source_ip", F.lit(""))
    failed = F.col("log_type").isin("linux", "windows", "authentication") & F.coalesce(F.col("action") == "block", F.lit(False)) & (src != "")
    scanned = (F.col("log_type") == "netflow") & (src != "") & (F.coalesce("destination_port", F.lit(0)) != 0)
    return src, F.coalesce(failed, F.lit(False)), F.coalesce(scanned, F.lit(False))


def threats(rows: DataFrame, ts_us: str = "ts_us", order: tuple[str, ...] = ("seq",), keep: tuple[str, ...] = ()) -> DataFrame:
    """THREAT, threat_type, severity, source, message, timestamp, related_log_type of every row that a check fires on, and its columns ``keep``."""
    src, failed, scanned = concerned()
    # rows that a windowed check does not concern get a key of their own, so that they neither sort nor collect with it
    alone = F.xxhash64(ts_us, *order, "raw").cast("string")
    rows = rows.withColumn("__fail_key", F.when(failed, src).otherwise(alone)).withColumn("__scan_key", F.when(scanned, src).otherwise(alone))
    rows = rows.withColumn("__fails", F.when(failed, trailing_count(["__fail_key"], ts_us, BRUTE_WINDOW, list(order), failed)))
    rows = trailing_distinct(rows, ["__scan_key"], ts_us, SCAN_WINDOW, list(order), F.when(scanned, F.col("destination_port")), "__ports")
    return judged(rows, keep)


def judged(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``threats`` of rows whose trailing counts are known: ``__fails`` failures and ``__ports`` distinct ports of their source."""
    extra = lambda k: F.element_at("extra", F.lit(k))
    src, _, scanned = concerned()
    port, flow = F.col("destination_port"), F.col("log_type") == "netflow"
    size, name = extra("bytes").try_cast("double"), F.coalesce(extra("query_name"), F.lit(""))
    host = F.coalesce("hostname", F.lit("?"))
    checks = {
        "BRUTE_FORCE": (F.col("__fails") >= BRUTE_COUNT, F.format_string("BRUTE FORCE: %d failures from %s in " + f"{BRUTE_WINDOW}s", "__fails", src)),
        "PORT_SCAN": (scanned & (F.col("__ports") >= SCAN_PORTS), F.format_string("PORT SCAN: %s contacted %d different ports in " + f"{SCAN_WINDOW}s", src, "__ports")),
        "C2_BEACON": (flow & port.isin(*C2_PORTS), F.format_string("C2 BEACON: Connection to known C2 port %d from %s", port, src)),
        "KNOWN_MALWARE": (
            (F.col("log_type") == "edr") & (F.coalesce(extra("attack_indicator"), F.lit("")) != ""),
            F.concat(F.lit("MALWARE TOOL DETECTED: "), extra("attack_indicator"), F.lit(" on "), host),
        ),
        "SENSITIVE_FILE": (
            (F.col("log_type") == "file_audit") & ~F.coalesce(F.lower(extra("sensitive")), F.lit("")).isin("", "false", "0"),
            F.concat(F.lit("SENSITIVE FILE ACCESS: "), F.coalesce(extra("file_path"), F.lit("?"))),
        ),
        "EXFILTRATION": (flow & (size > EXFIL_BYTES), F.format_string("LARGE TRANSFER: %.1f MB from %s to %s", size / (1024 * 1024), src, F.coalesce("destination_ip", F.lit("?")))),
        "DGA_DOMAIN": ((F.col("log_type") == "dns") & is_dga(first_label(name)), F.concat(F.lit("POSSIBLE DGA DOMAIN: "), name, F.lit(" queried by "), src)),
    }
    kind = F.coalesce(*[F.when(checks[k][0], F.lit(k)) for k in _ORDER])
    message = F.coalesce(*[F.when(checks[k][0], checks[k][1]) for k in _ORDER])
    hosted = kind.isin("KNOWN_MALWARE", "SENSITIVE_FILE")
    source = F.when(hosted & (src == ""), host).otherwise(src)
    severity = F.when(kind.isin(*_SEVERITY), "critical").otherwise("high")
    made = rows.select(
        F.lit(True).alias("THREAT"), kind.alias("threat_type"), severity.alias("severity"), source.alias("source"), message.alias("message"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("log_type").alias("related_log_type"), *keep,
    )
    return made.filter(F.col("threat_type").isNotNull())
