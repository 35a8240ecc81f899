"""Rules: loading, checking and list references. Rules stay on the driver; plans compile them to columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..functions.text import SEVERITIES
from .conditions import OPERATORS, split_key
from .lists import ListTable

KINDS = ("match", "threshold", "distinct_count", "sequence")
#: What a rule of each kind must have besides id, name, severity and type.
_NEEDS = {"match": (), "threshold": ("threshold", "window"), "distinct_count": ("field", "threshold", "window"), "sequence": ("steps", "window")}


class RuleError(ValueError):
    """A rule that cannot be used, with the reason."""


@dataclass(frozen=True)
class Step:
    conditions: dict[str, object]
    count: int = 1


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    type: str
    log_types: tuple[str, ...] | None = None
    conditions: dict[str, object] = field(default_factory=dict)
    any_of: tuple[dict[str, object], ...] = ()
    group_by: tuple[str, ...] = ()
    field: str | None = None
    threshold: int = 1
    window: int = 0
    steps: tuple[Step, ...] = ()
    mitre: tuple[str, ...] = ()
    description: str = ""
    recommendation: str = ""
    order: int = 0


def _tuple(x: object) -> tuple:
    return () if x is None else tuple(x) if isinstance(x, list | tuple) else (x,)


def _resolve(conditions: object, lists: dict[str, list | ListTable], where: str) -> dict[str, object]:
    """Puts the named list in place of every value ``$lists.name`` and checks the operators."""
    if conditions is None:
        return {}
    if not isinstance(conditions, dict):
        raise RuleError(f"{where}: conditions must be a mapping")
    out: dict[str, object] = {}
    for key, value in conditions.items():
        if isinstance(value, str) and value.startswith("$lists."):
            name = value.removeprefix("$lists.")
            if name not in lists:
                raise RuleError(f"{where}: unknown list {name}")
            value = lists[name] if isinstance(lists[name], ListTable) else list(lists[name])
        if split_key(key, value)[1] not in OPERATORS:
            raise RuleError(f"{where}: unknown operator in {key}")
        if isinstance(value, ListTable) and split_key(key, value)[1] not in ("in", "nin"):
            raise RuleError(f"{where}: {key} cannot take the table of list {value.name}")
        out[key] = value
    return out


def build_rule(doc: dict, lists: dict[str, list | ListTable] | None = None, order: int = 0) -> Rule:
    """A checked rule from its YAML mapping."""
    lists = lists or {}
    where = f"rule {doc.get('id', '?')}"
    if missing := [k for k in ("id", "name", "severity", "type") if not doc.get(k)]:
        raise RuleError(f"{where}: missing {', '.join(missing)}")
    if doc["severity"] not in SEVERITIES:
        raise RuleError(f"{where}: unknown severity {doc['severity']}")
    if doc["type"] not in KINDS:
        raise RuleError(f"{where}: unknown type {doc['type']}")
    if missing := [k for k in _NEEDS[doc["type"]] if doc.get(k) in (None, [], "")]:
        raise RuleError(f"{where}: {doc['type']} needs {', '.join(missing)}")
    steps = tuple(Step(_resolve(s.get("conditions"), lists, where), int(s.get("count", 1))) for s in doc.get("steps") or [])
    return Rule(
        id=str(doc["id"]), name=str(doc["name"]), severity=doc["severity"], type=doc["type"],
        log_types=None if doc.get("log_type") is None else tuple(map(str, _tuple(doc["log_type"]))),
        conditions=_resolve(doc.get("conditions"), lists, where),
        any_of=tuple(_resolve(g, lists, where) for g in doc.get("any_of") or []),
        group_by=tuple(map(str, _tuple(doc.get("group_by")))), field=doc.get("field"),
        threshold=int(doc.get("threshold", 1)), window=int(doc.get("window", 0)), steps=steps, mitre=tuple(map(str, _tuple(doc.get("mitre")))),
        description=str(doc.get("description", "")).strip(), recommendation=str(doc.get("recommendation", "")).strip(), order=order,
    )


def load_rules(path: str | Path, lists: dict[str, list | ListTable] | None = None) -> list[Rule]:
    """The enabled rules of a file or of all ``.yml`` and ``.yaml`` files in a folder, by file name and then by place.

    Identifiers must be unique among all rules, disabled ones included.
    """
    root = Path(path)
    files = sorted(p for p in root.iterdir() if p.suffix in (".yml", ".yaml")) if root.is_dir() else [root]
    if not files or not all(f.is_file() for f in files):
        raise RuleError(f"no rule files in {path}")
    rules: list[Rule] = []
    seen: set[str] = set()
    for file in files:
        for doc in (yaml.safe_load(file.read_text(encoding="utf-8")) or {}).get("rules") or []:
            rule = build_rule(doc, lists, len(rules))
            if rule.id in seen:
                raise RuleError(f"{file.name}: {rule.id} is there twice")
            seen.add(rule.id)
            if doc.get("enabled", True):
                rules.append(rule)
    return rules


#: The lists that the rulebook refers to.
DEFAULT_LISTS: dict[str, list] = {
    "approved_dhcp_servers": ["10.0.0.1"],
    "allowed_countries": ["IN", "US"],
    "bad_domains": ["evil-c2.example", "malware-drop.example", "badcdn.example"],
}


def rulebook(lists: dict[str, list | ListTable] | None = None) -> list[Rule]:
    """The rules that come with the package."""
    return load_rules(Path(__file__).resolve().parent.parent / "plans" / "rulebook.yml", {**DEFAULT_LISTS, **(lists or {})})
