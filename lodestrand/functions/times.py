"""Instants: strict parsing, look-back expressions, formats and relative times. The clock is always an argument."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An RFC 3339 instant; the offset is mandatory.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_UNITS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def parse_rfc3339(s: Column | str) -> Column:
    """Timestamp of an RFC 3339 string, null for any other."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(s.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(F.upper(s), r"(\.\d{6})\d+", "$1")))


def parse_since(text: str, now: datetime) -> datetime:
    """N followed by m, h, d or w as that long before now (negative: after), or a date as its UTC midnight."""
    text = text.strip()
    if found := re.fullmatch(r"([+-]?\d+)([mhdw])", text):
        return now - timedelta(**{_UNITS[found[2]]: int(found[1])})
    try:
        return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC)
    except ValueError:
        raise ValueError(f"neither a duration such as 7d nor a date: {text!r}") from None


def relative_time(then: Column | str, now: Column) -> Column:
    then = F.col(then) if isinstance(then, str) else then
    secs = F.floor(F.unix_micros(now) / 1_000_000.0 - F.unix_micros(then) / 1_000_000.0)
    whole = lambda n: F.floor(secs / n)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    days = whole(86_400)
    return (
        F.when(secs < 0, "future").when(secs < 60, "just now").when(secs < 3600, say(whole(60), "min")).when(secs < 86_400, say(whole(3600), "hr"))
        .when(days < 30, F.concat(days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago"))).otherwise(say(F.floor(days / 30), "mo"))
    )


def day(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minute(ts: Column | str) -> Column:
    return F.date_format(ts, "HH:mm")


def file_stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm")
