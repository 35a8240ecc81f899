"""Timestamp parsing. All functions assume a session time zone of UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_ISO = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Layouts other than ISO, each with the shape of its texts, as a failed parse costs far more than a pattern; a leading weekday is cut off first.
_LAYOUTS = (
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:", "dd/MMM/yyyy:HH:mm:ss Z"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} .*[+-]\d{4}$", "d MMM yyyy HH:mm:ss Z"),
    (r"^\d{4}/", "yyyy/M/d H:m:s"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} ", "d MMM yyyy H:m:s"),
)
_SYSLOG_SHAPE = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:"


def epoch_micros(value: Column) -> Column:
    """Microseconds of an epoch number in text; its size tells seconds, milli-, micro- and nanoseconds apart."""
    return let(value.try_cast("decimal(38,9)"), _scaled)


def _scaled(x: Column) -> Column:
    size = F.abs(x)
    scale = F.when(size >= F.lit(10).cast("decimal(38,0)") * 10**16, F.lit("0.001")).when(size >= 10**14, F.lit("1")).when(size >= 10**11, F.lit("1000")).otherwise(F.lit("1000000"))
    return F.round(x * scale.cast("decimal(10,3)"), 0).try_cast("bigint")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _iso_micros(s: Column) -> Column:
    """Of a text of the form ``_ISO``, whose date and time stand at fixed places."""

    def read(tail: Column) -> Column:
        fraction = F.rpad(F.regexp_extract(tail, r"^[.,](\d{1,6})", 1), 6, "0")
        return let(F.regexp_replace(tail, r"^(?:[.,]\d+)?\s*", ""), lambda z: zoned(fraction, z))

    def zoned(fraction: Column, z: Column) -> Column:
        offset = F.concat(F.substring(z, 1, 3), F.lit(":"), F.rpad(F.replace(F.substring(z, 4, 5), F.lit(":")), 2, "0"))
        zone = F.when(z.isin("", "Z", "z"), F.lit("+00:00")).otherwise(offset)
        return _micros(F.concat(F.substring(s, 1, 10), F.lit(" "), F.substring(s, 12, 8), F.lit("."), fraction, zone).try_cast("timestamp"))

    return let(F.substring(s, 20, 1 << 30), read)


def _syslog_micros(s: Column, as_of: Column) -> Column:
    """No year in the text: that of ``as_of``, or the one before if that would lie over a day ahead."""

    def dated(flat: Column) -> Column:
        read = lambda year: F.unix_micros(F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), flat), F.lit("yyyy MMM d H:m:s")))
        limit = F.unix_micros(as_of) + 86_400_000_000
        return let(read(F.year(as_of)), lambda now: F.when(now > limit, read(F.year(as_of) - 1)).otherwise(now))

    return let(F.regexp_replace(s, r"\s+", " "), dated)


def parse_micros(value: Column, as_of: Column) -> Column:
    """Epoch microseconds of a text in any known layout, else null.

    Booleans are no timestamps; fractions beyond microseconds are cut off.
    """

    def shaped(plain: Column) -> Column:
        return F.coalesce(*[F.when(plain.rlike(shape), _micros(F.try_to_timestamp(plain, F.lit(p)))) for shape, p in _LAYOUTS])

    def parse(s: Column) -> Column:
        other = F.coalesce(let(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), shaped), F.when(s.rlike(_SYSLOG_SHAPE), _syslog_micros(s, as_of)))
        known = F.when(s.rlike(_NUMBER), epoch_micros(s)).when(s.rlike(_ISO), _iso_micros(s)).otherwise(other)
        return F.when((s == "") | s.isNull(), F.lit(None).cast("bigint")).otherwise(known)

    return let(F.trim(value.cast("string")), parse)


def iso_utc(micros: Column) -> Column:
    """ISO text with +00:00 and a six-digit fraction only where there is one."""
    ts = F.timestamp_micros(micros)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.pmod(micros, F.lit(1_000_000)) == 0, F.concat(whole, F.lit("+00:00"))).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))


def audit_iso(epoch: Column) -> Column:
    """Audit epoch seconds as ISO text with milliseconds and Z; unreadable text stays as it is."""
    micros = F.round(epoch.try_cast("decimal(20,6)") * 1_000_000, 0).cast("bigint")
    return F.coalesce(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), epoch)


#: Layouts that the normalizer reads besides ISO and syslog.
_NORMAL = (
    (r"^\d{1,2}/\d{1,2}/\d{4} .*[AaPp][Mm]$", "M/d/yyyy h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} ", "d/M/yyyy H:m:s"),
    (r"^\d{2}/[A-Za-z]{3}/\d{4}:", "dd/MMM/yyyy:HH:mm:ss Z"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4} ", "MMM d yyyy H:m:s"),
    (r"^\d{4}-\d{2}-\d{2} ", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4} ", "d-MMM-yyyy HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{2} ", "M/d/yy H:m:s"),
)


def normalize_timestamp(value: Column, as_of: Column) -> Column:
    """ISO UTC text for the normalized schema; what no layout reads stays as it is.

    Offsets are converted rather than dropped, and ISO texts with an offset keep it.
    """

    out = lambda micros: F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.000'Z'")

    def read(s: Column, flat: Column) -> Column:
        layouts = [F.when(flat.rlike(shape), _micros(F.try_to_timestamp(flat, F.lit(p)))) for shape, p in _NORMAL]
        start = let(F.regexp_extract(s, r"^(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})", 1), lambda x: F.when(x != "", _micros(F.try_to_timestamp(x, F.lit("dd/MMM/yyyy:HH:mm:ss")))))
        epoch = F.when(s.rlike(r"^[+-]?\d+(\.\d+)?$"), F.floor(s.try_cast("double")).cast("bigint") * 1_000_000)
        return out(F.coalesce(F.when(flat.rlike(_SYSLOG_SHAPE), _syslog_micros(flat, as_of)), *layouts, start, epoch))

    def read_text(s: Column) -> Column:
        iso = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")
        zoned = s.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$")
        flat = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"(?<=\d{2}:\d{2}:\d{2})\.\d+$", "")
        other = F.coalesce(let(flat, lambda f: read(s, f)), s)
        return F.when(F.coalesce(s, F.lit("")) == "", out(F.unix_micros(as_of))).when(iso, F.when(zoned, s).otherwise(F.concat(s, F.lit("Z")))).otherwise(other)

    return let(F.trim(value.cast("string")), read_text)
