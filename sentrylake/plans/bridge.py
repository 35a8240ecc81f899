"""From the normalized schema to the field names that the rulebook expects.

Off by default: rules then see normalized rows as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.normalize import LOG_TYPES

#: Log types that are called otherwise in the rulebook.
TYPES = {"webserver": "web_server", "netflow": "network_flow", "edr": "endpoint_edr"}
#: Rule field -> where it is in a normalized row, by log type.
PROMOTED = {
    "dns": {"query": "query_name", "record_type": "query_type"},
    "dhcp": {"mac": "mac_address"},
    "application": {"level": "log_level", "app": "service"},
    "ids_ips": {"signature": "signature"},
    "file_audit": {"file_path": "file_path"},
    "webserver": {"url": "url_path", "status_code": "http_status", "user_agent": "user_agent"},
    "netflow": {"bytes_out": "bytes"},
    "edr": {"process_name": "process_name", "command_line": "cmdline", "parent_process": "parent_process"},
    "authentication": {"geo_country": "geo_country"},
}
_ACTIONS = {"file_rename": "rename", "file_open": "modify", "file_openat": "modify"}


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def to_fields(rows: DataFrame, bridge: bool = False) -> DataFrame:
    """``rows`` with the map ``fields`` of what is not null; with ``bridge``, log types and fields go by the rulebook's names."""
    plain = ["timestamp", "log_type", "message", "protocol", "action", "event_id", "severity", "user"]
    named = {"src_ip": "source_ip", "dst_ip": "destination_ip", "src_port": "source_port", "dst_port": "destination_port", "host": "hostname"}
    entries = [_entry(c, F.col(c)) for c in plain] + [_entry(k, F.col(c)) for k, c in named.items()]
    fields = F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: v.isNotNull())
    if not bridge:
        return rows.withColumn("fields", fields)
    kind, extra = F.col("log_type"), lambda k: F.element_at("extra", F.lit(k))
    added: dict[str, Column] = {}
    for log_type, names in PROMOTED.items():
        for target, source in names.items():
            added[target] = F.when(kind == log_type, extra(source)).otherwise(added.get(target, F.lit(None).cast("string")))
    added["log_type"] = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), kind), kind)
    added["status"] = F.when((kind == "authentication") & (F.col("action") == "block"), "failure").when((kind == "authentication") & (F.col("action") == "allow"), "success")
    added["priority"] = F.when(kind == "ids_ips", F.when(F.col("severity") == "critical", "1").when(F.col("severity") == "high", "2").when(F.col("severity") == "medium", "3"))
    added["direction"] = F.when(kind == "netflow", "outbound")
    # the wording that rules look for is in the raw line
    added["message"] = F.when(kind == "linux", F.col("raw")).otherwise(F.col("message"))
    added["action"] = F.when(kind == "file_audit", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ACTIONS.items() for x in kv]), F.col("action")), F.col("action"))).otherwise(
        F.col("action")
    )
    more = F.map_filter(F.map_from_entries(F.array(*[_entry(k, v) for k, v in added.items()])), lambda k, v: v.isNotNull())
    return rows.withColumn("fields", let(more, lambda m: F.map_concat(F.map_filter(fields, lambda k, v: ~F.map_contains_key(m, k)), m)))


assert set(PROMOTED) <= set(LOG_TYPES)
