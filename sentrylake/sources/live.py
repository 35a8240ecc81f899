"""What live collectors deliver, as transformations of the rows that land.

Collecting on hosts is left to agents that write to a landing folder or a
topic; from there on these functions do what the collectors did with each item.
They work on batches and on streams alike.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_dga, let, xml_events
from ..streaming.cursors import lately_new
from .follow import FolderSource
from .parsers import parse, parse_typed
from .tail import TailSource

#: Ports, event numbers and paths that collectors look for.
LIVE_C2_PORTS = (4444, 1337, 31337, 5555, 6666, 9999, 8888, 1234, 65535)
LOGIN_EVENTS = ("4624", "4625", "4648", "4672", "4720", "4723", "4740")
LOGIN_ALARMS = ("4625", "4648", "4740")
FILE_EVENTS = ("4663", "4660", "4656", "4659", "4670")
SENSITIVE_OBJECTS = ("\\sam", "\\ntds.dit", "\\system32\\config", "shadow", "\\hosts", "\\lsass")
_IDLE = ("0.0.0.0", "::", "127.0.0.1", "::1")


def w3c_to_ufw(line: Column) -> Column:
    """A Windows firewall log line as a UFW line; null for comments and short lines."""

    def made(part: Column) -> Column:
        at = lambda i: F.get(part, F.lit(i))
        when = F.try_to_timestamp(F.concat(at(0), F.lit(" "), at(1)), F.lit("yyyy-MM-dd HH:mm:ss"))
        stamp = F.coalesce(F.date_format(when, "MMM dd HH:mm:ss"), at(1))
        word = F.when(F.upper(at(2)) == "DROP", "BLOCK").otherwise("ALLOW")
        ufw = F.format_string("%s FIREWALL kernel: [UFW %s] IN=eth0 OUT= SRC=%s DST=%s PROTO=%s SPT=%s DPT=%s", stamp, word, at(4), at(5), F.upper(at(3)), at(6), at(7))
        return F.when(F.size(part) >= 8, ufw)

    return F.when(~F.trim(line).startswith("#"), let(F.split(F.trim(line), r"\s+"), made))


def firewall_lines(lines: DataFrame) -> DataFrame:
    # what is null no parser reads
    return parse(lines.withColumn("value", w3c_to_ufw(F.col("value"))), "firewall")


def _once(rows: DataFrame, keys: list[str], keep: str | None) -> DataFrame:
    """One row of each key; on a stream with ``keep``, one in so long a time, and the state is no larger than that."""
    return rows.dropDuplicates(keys) if keep is None else lately_new(rows, keys, keep)


def connections(rows: DataFrame, start: Column, keep: str | None = None) -> DataFrame:
    """Each connection (src, sport, dst, dport) to another machine once; backdoor ports are critical."""
    rows = _once(rows.filter(F.col("dst").isNotNull() & ~F.col("dst").isin("", *_IDLE)), ["src", "sport", "dst", "dport"], keep)
    flow = F.to_json(
        F.struct(
            start.alias("start"), F.col("src").alias("src_ip"), F.col("sport").alias("src_port"), F.col("dst").alias("dst_ip"), F.col("dport").alias("dst_port"),
            F.lit("TCP").alias("proto"), F.lit(0).alias("bytes"), F.lit(0).alias("packets"), F.lit(0.0).alias("duration"),
        )
    )
    made = parse(rows.select(flow.alias("value")), "netflow")
    odd = F.col("destination_port").cast("int").isin(*LIVE_C2_PORTS)
    return made.withColumn("severity", F.when(odd, "critical").otherwise(F.col("severity"))).withColumn(
        "message", F.when(odd, F.concat("message", F.lit(" [C2-PORT:"), "destination_port", F.lit("]"))).otherwise(F.col("message"))
    )


def processes(rows: DataFrame, keep: str | None = None) -> DataFrame:
    """Each process number once."""
    return _once(rows, ["pid"], keep)


def dns_cache(rows: DataFrame, stamp: Column, keep: str | None = None) -> DataFrame:
    """Each looked-up domain once, whatever its case; names that look generated are of high severity."""
    rows = _once(rows.filter(F.coalesce("domain", F.lit("")) != "").withColumn("__d", F.lower("domain")), ["__d"], keep).drop("__d")
    kind = F.coalesce("record_type", F.lit("A"))
    line = F.concat(
        stamp, F.lit(" queries: info: client @0x7f 127.0.0.1#53 ("), F.col("domain"), F.lit("): query: "), F.col("domain"), F.lit(" IN "), kind, F.lit(" + (127.0.0.1)")
    )
    made = parse(rows.select(line.alias("value")), "dns")
    label = F.substring_index(F.element_at("extra", F.lit("query_name")), ".", 1)
    return made.withColumn("severity", F.when(is_dga(label), "high").otherwise(F.col("severity"))).withColumn(
        "message", F.when(is_dga(label), F.concat("message", F.lit(" [DGA-SUSPECTED]"))).otherwise(F.col("message"))
    )


def event_rows(documents: DataFrame, value: str = "value") -> DataFrame:
    """One row per event element of XML documents: value, record_id, event_id, host and channel (empty where there is none)."""
    rows = documents.select(F.explode(xml_events(F.col(value))).alias("value"))
    number = lambda tag: F.regexp_extract("value", rf"<{tag}(?:\s[^>]*)?>(\d+)</{tag}>", 1)
    name = lambda tag: F.trim(F.regexp_extract("value", rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1))
    rows = rows.withColumn("record_id", number("EventRecordID").try_cast("long")).withColumn("event_id", number("EventID"))
    return rows.withColumn("host", name("Computer")).withColumn("channel", name("Channel"))


def bookmarks(documents: DataFrame) -> DataFrame:
    """How far each channel of each host has come: host, channel, last_record."""
    return event_rows(documents).filter("record_id IS NOT NULL").groupBy("host", "channel").agg(F.max("record_id").alias("last_record"))


def new_events(documents: DataFrame, last_record: int | DataFrame, event_ids: tuple[str, ...] | None = None) -> DataFrame:
    """Events numbered above the last one seen, of the given kinds. Channels number their records each for itself, so
    ``last_record`` may be a table of ``bookmarks``; on streams ``streaming.cursors.new_records`` keeps them in its state."""
    rows = event_rows(documents)
    if isinstance(last_record, int):
        rows = rows.filter(F.col("record_id") > last_record)
    else:
        rows = rows.join(last_record, ["host", "channel"], "left").filter(F.col("record_id") > F.coalesce("last_record", F.lit(-1))).drop("last_record")
    return rows if event_ids is None else rows.filter(F.col("event_id").isin(*event_ids))


def windows_events(documents: DataFrame, last_record: int | DataFrame = -1) -> DataFrame:
    return parse(new_events(documents, last_record).select("value"), "windows")


def login_events(documents: DataFrame, last_record: int | DataFrame = -1) -> DataFrame:
    made = parse(new_events(documents, last_record, LOGIN_EVENTS).select("value"), "windows").withColumn("log_type", F.lit("authentication"))
    return made.withColumn("severity", F.when(F.col("event_id").isin(*LOGIN_ALARMS), "high").otherwise(F.col("severity")))


def application_events(documents: DataFrame, last_record: int | DataFrame = -1) -> DataFrame:
    """Events of level 3 and graver; the provider becomes the service."""
    rows = new_events(documents, last_record).withColumn("level", F.regexp_extract("value", r"<Level>(\d+)</Level>", 1))
    rows = rows.withColumn("provider", F.regexp_extract("value", r"Provider[^>]*Name=['\"]([^'\"]+)['\"]", 1)).filter(F.col("level").isin("0", "1", "2", "3"))
    made = parse(rows.select("value", "level", "provider"), "windows").withColumn("log_type", F.lit("application"))
    graded = F.when(F.col("level") == "1", "critical").when(F.col("level") == "2", "high").when(F.col("level") == "3", "medium").otherwise("info")
    service = F.when(F.col("provider") != "", F.map_concat(F.map_filter("extra", lambda k, v: k != "service"), F.create_map(F.lit("service"), "provider")))
    return made.withColumn("severity", graded).withColumn("extra", F.coalesce(service, "extra")).drop("level", "provider")


def file_events(documents: DataFrame, last_record: int | DataFrame = -1) -> DataFrame:
    """Object accesses as audit PATH records, with the event's own time; system files are critical."""
    rows = new_events(documents, last_record, FILE_EVENTS)
    name = F.trim(F.regexp_extract("value", r"Name=[\"']ObjectName[\"'][^>]*>([^<]+)", 1))
    name = F.when(name == "", "/unknown/file").otherwise(name)
    time = F.regexp_extract("value", r"SystemTime=['\"]([^'\"]+)['\"]", 1)
    epoch = F.coalesce((F.unix_micros(time.try_cast("timestamp")) / 1_000_000).cast("decimal(20,3)").cast("string"), F.lit("0"))
    line = F.concat(F.lit("type=PATH msg=audit("), epoch, F.lit(":456): item=0 name="), name, F.lit(" inode=131073 dev=08:01 mode=0100640 nametype=NORMAL"))
    made = parse(rows.select(line.alias("value"), F.lower(name).alias("__object")), "file_audit")
    grave = F.greatest(*[F.col("__object").contains(s) for s in SENSITIVE_OBJECTS])
    marked = F.map_concat(F.map_filter("extra", lambda k, v: k != "sensitive"), F.create_map(F.lit("sensitive"), F.lit("true")))
    made = made.withColumn("severity", F.when(grave, "critical").otherwise(F.col("severity"))).withColumn("extra", F.when(grave, marked).otherwise(F.col("extra")))
    return made.drop("__object")


#: DHCP client events and the message that each stands for.
DHCP_EVENTS = {"50066": "DHCPACK", "50067": "DHCPACK", "50032": "DHCPACK", "50036": "DHCPSTART", "50037": "DHCPSTOP"}


def dhcp_events(documents: DataFrame, last_record: int | DataFrame = -1, names: dict[str, str] = DHCP_EVENTS) -> DataFrame:
    """DHCP client events as server lines without an address; events of other numbers are ``DHCPEVENT``."""
    rows = new_events(documents, last_record)
    time = F.regexp_extract("value", r"SystemTime=['\"]([^'\"]{19})", 1).try_cast("timestamp")
    table = F.create_map(*[x for kv in names.items() for x in map(F.lit, kv)])
    kind = F.coalesce(F.element_at(table, F.col("event_id")), F.lit("DHCPEVENT"))
    line = F.concat(F.date_format(time, "MMM dd HH:mm:ss"), F.lit(" dhcpclient dhcpd: "), kind, F.lit(" on 0.0.0.0 to 00:00:00:00:00:00 (WINDOWS-CLIENT) via eth0"))
    made = parse(rows.select(line.alias("value"), F.col("event_id").alias("__id")), "dhcp")
    return made.withColumn("event_id", F.col("__id")).drop("__id")


def agent_records(rows: DataFrame) -> DataFrame:
    """Records that agents post (raw, _log_type, source_machine): type ``application`` by default, the machine goes to ``extra``."""
    kind = F.coalesce("_log_type", F.lit("application"))
    return rows.select(kind.alias("log_type"), "raw", F.create_map(F.lit("source_machine"), F.coalesce("source_machine", F.lit("unknown"))).alias("extra"))


def agent_parsed(rows: DataFrame) -> DataFrame:
    """Agent records whose raw line the parser of their log type reads, with the machine in ``extra``."""
    rows = rows.withColumn("__machine", F.coalesce("source_machine", F.lit("unknown"))).withColumn("__kind", F.coalesce("_log_type", F.lit("application")))
    made = parse_typed(rows.select("__machine", "__kind", F.col("raw").alias("value")), F.col("__kind")).drop("__kind")
    return made.withColumn("extra", F.map_concat("extra", F.create_map(F.lit("source_machine"), "__machine"))).drop("__machine")


#: Where sensors write their events, in the order in which they are looked for.
EVE_PATHS = (
    r"C:\Suricata\log\eve.json", r"C:\Program Files\Suricata\log\eve.json", r"C:\Program Files (x86)\Suricata\log\eve.json",
    "/var/log/suricata/eve.json", "/var/log/snort/alert.json",
)


def eve_path(paths: tuple[str, ...] = EVE_PATHS) -> str | None:
    """The first of the files that is there."""
    return next((p for p in paths if os.path.exists(p)), None)


def sensor_events(spark: SparkSession, paths: tuple[str, ...] = EVE_PATHS, from_start: bool = False) -> DataFrame | None:
    """A stream of what the sensor on this machine writes from now on, parsed; None where there is no sensor."""
    path = eve_path(paths)
    if path is None:
        return None
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("line_tail").option("path", path).option("fromStart", str(from_start).lower()).load()
    return parse(lines.select("value"), "ids_ips")


def followed(spark: SparkSession, pattern: str, from_start: bool = False) -> DataFrame:
    """A stream of the lines of all files that a pattern finds, read by the tasks: value, path, offset."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("line_folder").option("path", pattern).option("fromStart", str(from_start).lower()).load()


def web_logs(spark: SparkSession, pattern: str, from_start: bool = False) -> DataFrame:
    """A stream of what all web servers' logs gain, parsed."""
    lines = followed(spark, pattern, from_start)
    return web_lines(lines, F.col("path"))


def web_lines(lines: DataFrame, file: Column) -> DataFrame:
    """Web server lines with the name of the file that they come from in ``extra``."""
    made = parse(lines.withColumn("__file", F.element_at(F.split(file, "/"), -1)), "webserver")
    return made.withColumn("extra", F.map_concat("extra", F.create_map(F.lit("source_file"), "__file"))).drop("__file")
