"""Normalized events from JSON lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canon_log_type, let
from ..functions.timestamps import parse_micros

#: The canonical fields and the names that fill them, in order of preference.
ALIASES: dict[str, list[str]] = {
    "timestamp": ["time", "@timestamp", "ts", "event_time"],
    "log_type": ["source_type", "logsource", "type"],
    "src_ip": ["source_ip", "src", "client_ip", "source.ip"],
    "dst_ip": ["destination_ip", "dest_ip", "dst", "destination.ip"],
    "src_port": ["source_port"],
    "dst_port": ["destination_port", "dest_port"],
    "user": ["username", "user_name", "account"],
    "host": ["hostname", "computer", "device"],
    "process_name": ["process", "image", "exe"],
    "command_line": ["cmdline", "command", "commandline"],
    "event_id": ["eventid", "event_code"],
    "status": ["outcome", "result"],
    "url": ["uri", "request_uri", "path"],
    "user_agent": ["ua", "useragent"],
    "bytes_out": ["bytes_sent", "out_bytes"],
}
_FILES = "*.{jsonl,json,log}"


@dataclass(frozen=True)
class Parsed:
    """Events and bad lines; ``lines`` has both, told apart by ``good``, for what needs them in one pass."""

    events: DataFrame
    bad: DataFrame
    lines: DataFrame


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` and ``seq``, which orders lines as they stand in the files, files by name.

    A folder gives its .jsonl, .json and .log files, not those of subfolders.
    """
    try:
        folder = spark.read.format("binaryFile").load(path).select("path").limit(2)
        single = folder.filter(F.regexp_replace("path", "^file:/+", "/") == path.removeprefix("file://")).limit(1).count() == 1
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    reader = spark.read if single else spark.read.option("pathGlobFilter", _FILES)
    lines = reader.text(path)
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return spread(lines.select("value", seq.alias("seq")))


#: A task of rows that are parsed one by one takes seconds with so many.
_ROWS_A_TASK = 100_000


def spread(rows: DataFrame) -> DataFrame:
    """Deals the rows of a scan of few splits out to all cores; a scan of many splits, as any large one, stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def spread_table(table: DataFrame) -> DataFrame:
    """Deals the rows of a Parquet table out by their number, which its footers tell.

    Splits go by bytes, but a row group is read by one of them: few large groups leave most splits of a file empty.
    """
    return table.repartition(max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // _ROWS_A_TASK)))


def fill_aliases(fields: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """Adds each missing canonical field from the first of its aliases that is there; a canonical field that is null stays."""
    added = []
    for canon, names in aliases.items():
        first = [F.when(F.map_contains_key(fields, F.lit(n)), F.struct(F.lit(canon).alias("key"), F.element_at(fields, F.lit(n)).alias("value"))) for n in names]
        if first:
            added.append(F.when(~F.map_contains_key(fields, F.lit(canon)), F.coalesce(*first)))
    return F.map_concat(fields, F.map_from_entries(F.array_compact(F.array(*added))))


def canonical_type(fields: Column) -> Column:
    kept = F.map_filter(fields, lambda k, v: k != "log_type")
    value = F.element_at(fields, F.lit("log_type"))
    return F.when(value.isNull(), fields).otherwise(F.map_concat(kept, F.create_map(F.lit("log_type"), canon_log_type(value))))


def parse_lines(lines: DataFrame, as_of: Column, aliases: dict[str, list[str]] = ALIASES) -> Parsed:
    """Events (raw, fields, ts_us, seq) and the bad lines (value, seq).

    Blank lines count as neither. Bad are lines that are no JSON object and
    objects without a readable time. Booleans are no times.
    """
    lines = lines.filter(F.trim("value") != "")
    read = F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    parsed = lines.withColumn("fields", let(read, lambda m: let(fill_aliases(m, aliases), canonical_type)))
    time = F.element_at("fields", F.lit("timestamp"))
    parsed = parsed.withColumn("ts_us", parse_micros(F.when(~F.lower(time).isin("true", "false", "nan"), time), as_of))
    good = F.col("fields").isNotNull() & F.col("ts_us").isNotNull()
    events = parsed.filter(good).select(F.col("value").alias("raw"), "fields", "ts_us", "seq")
    return Parsed(events, parsed.filter(~good).select("value", "seq"), parsed.select("value", "fields", "ts_us", "seq", good.alias("good")))


def read_events(spark: SparkSession, path: str, as_of: Column | None = None, aliases: dict[str, list[str]] = ALIASES) -> Parsed:
    """Events of a file or folder. ``as_of`` dates the texts that carry no year."""
    return parse_lines(read_lines(spark, path), as_of if as_of is not None else F.current_timestamp(), aliases)
