"""Clock times as text that may pass 24 hours, service dates as YYYYMMDD, and the calendar rules on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: blanks of any width.
BLANK = r"\s\u00a0\u2000-\u200a\u202f\u205f\u3000"
_HMS = rf"^[{BLANK}]*([0-9]{{1,2}}):([0-9]{{1,2}})(?::([0-9]{{1,2}}))?[{BLANK}]*$"


def _part(c: Column, i: int) -> Column:
    return F.coalesce(F.expr("try_cast(null as int)") if i > 3 else F.nullif(F.regexp_extract(c, _HMS, i), F.lit("")).cast("int"), F.lit(0))


def normal(c: Column) -> Column:
    """H:MM or H:MM:SS as HH:MM:SS, hours past 24 kept; anything else unchanged; null stays null."""
    pad = [F.lpad(_part(c, i).cast("string"), 2, "0") for i in (1, 2, 3)]
    return F.when(c.rlike(_HMS), F.concat_ws(":", *pad)).otherwise(c)


def seconds(c: Column) -> Column:
    """Seconds of a clock time since the day's start, past 24 hours too; null if it is none."""
    return F.when(c.rlike(_HMS), _part(c, 1) * 3600 + _part(c, 2) * 60 + _part(c, 3))


def minutes(c: Column) -> Column:
    """Whole minutes of a clock time; null if it is none."""
    return F.when(c.rlike(_HMS), _part(c, 1) * 60 + _part(c, 2))


def from_minutes(m: Column) -> Column:
    """HH:MM:00 of minutes, rounded half to even."""
    r = F.bround(m).cast("int")
    return F.when(m.isNotNull(), F.concat_ws(":", F.lpad(F.floor(r / 60).cast("string"), 2, "0"), F.lpad((r % 60).cast("string"), 2, "0"), F.lit("00")))


def cell(c: Column) -> Column:
    """The first clock time written inside a cell, as HH:MM:SS; null if there is none."""
    found = F.regexp_extract(c, r"([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)", 1)
    return F.when(found != "", normal(found))


def shown(c: Column) -> Column:
    """H:MM for display, without seconds; other text unchanged."""
    m = r"^([0-9]{1,2}:[0-9]{2}):[0-9]{2}$"
    return F.when(c.rlike(m), F.regexp_extract(c, m, 1)).otherwise(c)


def day(c: Column) -> Column:
    """Date of YYYYMMDD text; null if it is none."""
    return F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd")))


def ymd(d: Column) -> Column:
    """YYYYMMDD of a date."""
    return F.date_format(d, "yyyyMMdd")


def fiscal_end(c: Column) -> Column:
    """Last day of the fiscal year (April to March) of a start date; 20991231 for null and bad dates."""
    d = day(c)
    y = F.year(d) + (F.month(d) >= 4).cast("int")
    return F.coalesce(F.concat(y.cast("string"), F.lit("0331")), F.lit("20991231"))


def in_season(d: Column, first: str, last: str) -> Column:
    """Whether a date's MM-DD lies in a yearly span, which may wrap over the new year."""
    m = F.date_format(d, "MM-dd")
    return m.between(first, last) if first <= last else (m >= first) | (m <= last)


def days(a: Column, b: Column) -> Column:
    """All dates from a to b; an empty array if b is before a or one is null."""
    return F.when(a.isNotNull() & b.isNotNull() & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<date>"))


def era_date(c: Column) -> Column:
    """Date of 令和N年M月D日 in a text (digits of either width); null if there is none."""
    t = F.translate(c, "０１２３４５６７８９", "0123456789")
    rx = r"令和([0-9]{1,2}|元)年([0-9]{1,2})月([0-9]{1,2})日"
    y = F.regexp_extract(t, rx, 1)
    year = F.lit(2018) + F.when(y == "元", 1).otherwise(F.expr("1") * F.nullif(y, F.lit("")).try_cast("int"))
    return F.when(t.rlike(rx), F.to_date(F.try_to_timestamp(F.concat_ws("-", year.cast("string"), F.lpad(F.regexp_extract(t, rx, 2), 2, "0"), F.lpad(F.regexp_extract(t, rx, 3), 2, "0")), F.lit("yyyy-MM-dd"))))


def stale(d: Column, today: str, days_back: int = 730) -> Column:
    """Whether a single date lies more than ``days_back`` days before ``today``."""
    return d < F.date_sub(F.lit(today).cast("date"), days_back)
