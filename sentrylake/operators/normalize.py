"""Parser records to the fixed fifteen-field schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_int
from ..functions.timestamps import normalize_timestamp

#: The known log types and severities.
LOG_TYPES = ("firewall", "dns", "dhcp", "linux", "windows", "authentication", "webserver", "application", "netflow", "ids_ips", "file_audit", "edr")
SEVERITIES = ("info", "low", "medium", "high", "critical", "unknown")
#: Other names of schema fields; where several are there, the last in this order counts, and the field's own name last of all.
RENAMES = {
    "destination_ip": ("dst_ip", "dest_ip", "destination"), "destination_port": ("dest_port", "dst_port"), "source_ip": ("src_ip",), "source_port": ("src_port",),
    "protocol": ("proto",),
}
_FIELDS = (
    "timestamp", "log_type", "message", "raw", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "action", "event_id", "severity",
    "user", "hostname",
)
#: The normalized schema.
SCHEMA = ", ".join(f"`{c}` {'int' if c.endswith('_port') else 'string'}" for c in _FIELDS) + ", extra map<string,string>"


def rename(records: DataFrame) -> DataFrame:
    """Schema fields under their own names; columns of other names go to ``extra`` as text, nulls left out."""
    known = {n for names in RENAMES.values() for n in names} | set(_FIELDS) | {"extra"}
    have = set(records.columns)

    def field(name: str) -> Column:
        order = [n for n in (name, *reversed(RENAMES.get(name, ()))) if n in have]
        return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in order]) if order else F.lit(None).cast("string")

    others = [c for c in records.columns if c not in known]
    packed = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in others])) if others else F.create_map()
    own = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>")) if "extra" in have else F.create_map().cast("map<string,string>")
    packed = packed.cast("map<string,string>")
    rest = F.map_filter(packed, lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    return records.select(*[field(n).alias(n) for n in _FIELDS], F.map_concat(rest, own).alias("extra"))


def errors() -> Column:
    """What is wrong with a normalized row, as an array of texts."""
    port = lambda c: F.when(~F.col(c).between(0, 65535), F.lit(f"{c}: out of range"))
    return F.array_compact(
        F.array(
            *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c}: missing")) for c in ("timestamp", "log_type", "message", "raw")],
            F.when(~F.col("log_type").isin(*LOG_TYPES), F.lit("log_type: unknown")),
            port("source_port"),
            port("destination_port"),
        )
    )


def normalize(records: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Renames, packs, coerces, fills defaults and checks. Rows are never dropped: what is wrong stands in ``extra``.

    ``as_of`` is the time of rows without one, and dates texts without a year.
    """
    now = as_of if as_of is not None else F.current_timestamp()
    rows = rename(records)
    severity = F.when(F.col("severity").isNull() | F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("unknown")
    raw = F.coalesce("raw", F.to_json(F.struct(*[F.col(f"`{c}`") for c in _FIELDS], F.col("extra"))))
    rows = rows.select(
        normalize_timestamp(F.col("timestamp"), now).alias("timestamp"), "log_type",
        F.coalesce("message", F.concat(F.lit("["), F.col("log_type"), F.lit("] event"))).alias("message"), raw.alias("raw"), "source_ip", "destination_ip",
        to_int(F.col("source_port")).cast("int").alias("source_port"), to_int(F.col("destination_port")).cast("int").alias("destination_port"),
        F.upper("protocol").alias("protocol"), F.lower("action").alias("action"), "event_id", severity.alias("severity"), "user", "hostname",
        F.map_filter("extra", lambda k, v: v.isNotNull()).alias("extra"),
    )
    found = errors()
    noted = F.map_concat(F.map_filter("extra", lambda k, v: k != "_validation_errors"), F.create_map(F.lit("_validation_errors"), F.to_json(found)))
    return rows.withColumn("extra", F.when(F.size(found) > 0, noted).otherwise(F.col("extra")))


def csv_columns(rows: DataFrame) -> DataFrame:
    """The seven columns of the CSV export."""
    return rows.select("timestamp", "log_type", "severity", "source_ip", "destination_ip", "action", "message")
