"""Text and number functions with the comparison rules of the engine.

Comparisons are on lower-cased text in which null is the empty string; numbers
are what reads as a finite or infinite double, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DGA_LENGTH, DGA_ENTROPY = 15, 3.5
SEVERITIES = ("low", "medium", "high", "critical")


def text(value: Column) -> Column:
    return F.lower(F.coalesce(value.cast("string"), F.lit("")))


def number(value: Column) -> Column:
    """Double, or null where the text is not a number; ``true`` and ``false`` are 1 and 0."""
    s = F.trim(value.cast("string"))
    plain = s.rlike(r"(?i)^[+-]?(\d+(_?\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$")
    flag = F.when(F.lower(s) == "true", 1.0).when(F.lower(s) == "false", 0.0)
    return F.when(plain, F.regexp_replace(s, "_", "").try_cast("double")).otherwise(flag)


def to_int(value: Column) -> Column:
    """Whole numbers only; anything else is null."""
    s = F.trim(value.cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))


def canon_log_type(value: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits over the characters of a text; 0 for an empty one."""
    s = F.coalesce(value.cast("string"), F.lit(""))
    n = F.length(s).cast("double")
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def is_dga(label: Column) -> Column:
    """Long and random-looking: more than 15 characters and 3.5 bits."""
    return F.coalesce((F.length(label) > DGA_LENGTH) & (entropy(label) > DGA_ENTROPY), F.lit(False))


def canonical_text(value: Column) -> Column:
    """Text; an object or a list with the keys of its objects in order and without white space, so that equal ones are one text."""
    s = value.cast("string")
    return F.when(s.rlike(r"^\s*[\[{]"), F.coalesce(F.to_json(F.try_parse_json(s)), s)).otherwise(s)


def severity_rank(severity: Column) -> Column:
    """0 for low to 3 for critical; null for anything else."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(at > 0, (at - 1).cast("int"))


def key_values(line: Column) -> Column:
    """``key=value`` pairs as a map; of repeated keys the last counts."""
    found = F.regexp_extract_all(line, F.lit(r"(?U)\w+=[^\s,]+"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return F.map_from_entries(last)


def xml_events(document: Column) -> Column:
    """The ``<Event …>…</Event>`` elements of a text."""
    return F.regexp_extract_all(document, F.lit(r"(?s)<Event(?:\s[^>]*)?>.*?</Event>"), F.lit(0))


def strip_priority(line: Column) -> Column:
    """A syslog line without its leading ``<number>``."""
    return F.regexp_replace(line, r"^<\d+>", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
