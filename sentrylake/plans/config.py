"""Settings from a YAML file: aliases, named lists and how alerts are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..functions.text import SEVERITIES
from ..operators.lists import ListTable
from ..operators.rules import DEFAULT_LISTS
from ..sources.events import ALIASES


@dataclass(frozen=True)
class Config:
    aliases: dict[str, list[str]] = field(default_factory=lambda: dict(ALIASES))
    lists: dict[str, list | ListTable] = field(default_factory=lambda: dict(DEFAULT_LISTS))
    min_severity: str = "low"
    dedupe_seconds: int = 120
    evidence_limit: int = 5
    console: bool = True
    json_file: str | None = None


def load_config(path: str | Path | None = None) -> Config:
    """The file's settings; what it leaves out is as in ``Config``. A list given as ``{path: FILES}`` is a table (``ListTable``)."""
    if path is None:
        return Config()
    doc = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    alerts = doc.get("alerts") or {}
    severity = alerts.get("min_severity", "low")
    if severity not in SEVERITIES:
        raise ValueError(f"unknown min_severity {severity}")
    lists = {k: ListTable(k, v["path"]) if isinstance(v, dict) else v for k, v in (doc.get("lists") or {}).items()}
    return Config(
        aliases=doc.get("field_aliases") or dict(ALIASES),
        lists={**DEFAULT_LISTS, **lists},
        min_severity=severity,
        dedupe_seconds=int(alerts.get("dedupe_seconds", 120)),
        evidence_limit=int(alerts.get("evidence_limit", 5)),
        console=bool(alerts.get("console", True)),
        json_file=alerts.get("json_file"),
    )
