"""FILETIME: 100 ns ticks since 1601-01-01 UTC, as whole numbers; time literals and display."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks from 1601-01-01 to 1970-01-01, and ticks of a second.
UNIX_EPOCH, SECOND = 116_444_736_000_000_000, 10_000_000
_LITERAL = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[ T](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,7}))?)?)?\s*(Z|z|[+-]\d\d:\d\d)?")


def zone_of(name: str) -> tzinfo:
    """UTC, a fixed offset such as UTC+03:00 or +03:00, or an IANA name."""
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d\d?):?(\d\d)?", name.strip()):
        return timezone((1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3] or 0)))
    return UTC if name.upper() in ("UTC", "Z") else ZoneInfo(name)


def from_datetime(t: datetime) -> int:
    d = t.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return UNIX_EPOCH + (d.days * 86_400 + d.seconds) * SECOND + d.microseconds * 10


def parse_time(text: str, zone: str = "UTC") -> int | None:
    """Ticks of a literal; without Z or an offset it is read in the zone. None if it is not a time."""
    m = _LITERAL.fullmatch(text.strip())
    if not m:
        return None
    try:
        t = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0))
        tz = zone_of(zone) if m[8] is None else zone_of("UTC" if m[8] in "Zz" else m[8])
    except (ValueError, KeyError):
        return None
    return from_datetime(t.replace(tzinfo=tz)) + int((m[7] or "").ljust(7, "0"))


def iso(ticks: int, digits: int = 7) -> str:
    """UTC text with so many digits of a second."""
    seconds, rest = divmod(ticks - UNIX_EPOCH, SECOND)
    t = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return f"{t:%Y-%m-%dT%H:%M:%S}{'.' * (digits > 0)}{f'{rest:07d}'[:digits]}Z"


def ticks(ts: Column, zoned: bool = True) -> Column:
    """FILETIME of a timestamp column; one without a zone is read as UTC."""
    if zoned:
        return F.unix_micros(ts) * 10 + UNIX_EPOCH
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 10 + UNIX_EPOCH


def timestamp(ft: Column) -> Column:
    return F.timestamp_micros(F.floor((ft - UNIX_EPOCH) / 10))


def iso_text(ft: Column, digits: int = 7) -> Column:
    """UTC text of ticks, in Spark; the session's zone is not used."""
    seconds = F.floor((ft - UNIX_EPOCH) / SECOND)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    rest = F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    part = F.substring(F.lpad(F.pmod(ft - UNIX_EPOCH, F.lit(SECOND)).cast("string"), 7, "0"), 1, digits)
    return F.concat(day.cast("string"), F.lit("T"), clock, *([F.lit("."), part] if digits else []), F.lit("Z"))


def local_text(ft: Column, zone: str, digits: int = 3) -> Column:
    """Text in a display zone: date, blank, time."""
    seconds = F.timestamp_seconds(F.floor((ft - UNIX_EPOCH) / SECOND))
    offset = F.unix_micros(F.from_utc_timestamp(seconds, zone_name(zone))) - F.unix_micros(seconds)
    return F.translate(F.substring(iso_text(ft + offset * 10, digits), 1, 19 + (digits + 1) * (digits > 0)), "T", " ")


def zone_name(zone: str) -> str:
    """A name that Spark knows for a display zone."""
    z = zone_of(zone)
    if isinstance(z, timezone):
        minutes = int(z.utcoffset(None).total_seconds() // 60)
        return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    return str(z)


def zone_label(zone: str) -> str:
    """Header label of a display zone."""
    return "UTC" if zone_name(zone) == "+00:00" else f"UTC{zone_name(zone)}" if isinstance(zone_of(zone), timezone) else zone_name(zone)
