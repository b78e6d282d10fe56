"""Date expressions on wall-clock timestamps; the clock is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_recent(date: Column, as_of: Column, max_age_days: int | None = 7) -> Column:
    """Whole days of age (rounded down) are at most the limit; future dates pass."""
    if max_age_days is None:
        return F.lit(True)
    return F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(date.cast("timestamp"))) / 86400) <= max_age_days


_TIME = r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$"


def iso(c: Column) -> Column:
    """ISO 8601 in its extended and basic forms, days by date or by week; an offset is dropped, not applied."""
    by_date, by_week = r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))" + _TIME, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?" + _TIME
    part = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    number = lambda pattern, *groups: F.coalesce(*[part(pattern, g) for g in groups]).cast("int")

    def at(pattern: str, first: int, day: Column) -> Column:
        h, m, s = (F.coalesce(part(pattern, first + i).cast("int"), F.lit(0)) for i in range(3))
        micro = F.coalesce(F.rpad(part(pattern, first + 3), 6, "0").cast("int"), F.lit(0))
        return F.when((h < 24) & (m < 60) & (s < 60), F.try_make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), h, m, (s + micro / 1e6).cast("decimal(16,6)")))

    day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", number(by_date, 1), number(by_date, 2, 4), number(by_date, 3, 5)), F.lit("yyyy-MM-dd"))
    monday = week_start(F.format_string("%04d-W%02d", number(by_week, 1), number(by_week, 2)))
    weekly = F.date_add(monday, F.coalesce(part(by_week, 3).cast("int"), F.lit(1)) - 1)
    known = F.weekofyear(monday) == number(by_week, 2)
    return F.when(c.rlike(by_date), at(by_date, 6, day)).when(c.rlike(by_week), F.when(known, at(by_week, 4, weekly)))


def parsed(c: Column) -> Column:
    """Four fixed formats (one month first, with a time), then ISO; an offset is dropped, not applied."""
    text = F.trim(c)
    shapes = ((r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"), (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"))
    return F.coalesce(*[F.when(text.rlike(r), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for r, f in shapes], iso(text))


def lastmod(c: Column) -> Column:
    """Of a url in a sitemap: with a T as ISO, else a date in its first ten characters."""
    head = F.left(c, F.lit(10))
    day = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(head, F.lit("yyyy-M-d")).cast("timestamp_ntz"))
    return F.when(F.contains(c, F.lit("T")), iso(c)).otherwise(day)


def iso_week(c: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def week_start(key: Column) -> Column:
    """Monday of an ISO week key."""
    fourth = F.make_date(F.substring(key, 1, 4).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), (F.substring(key, 7, 2).cast("int") - 1) * 7)


def previous_weeks(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: iso_week(F.date_sub(c.cast("date"), i * 7)))


def sitemap_month(u: Column) -> Column:
    """First of the month that a sitemap's name tells; null for none or an impossible one."""
    y, m = (F.regexp_extract(u, r"/(\d{4})-(\d{1,2})\.xml(?:\.gz)?$", i) for i in (1, 2))
    return F.when((y != "") & F.try_to_number(m, F.lit("99")).between(1, 12), F.make_date(F.nullif(y, F.lit("")).cast("int"), F.nullif(m, F.lit("")).cast("int"), F.lit(1)))


def trend_window(start: dt.date | None, end: dt.date | None, as_of: dt.date) -> tuple[dt.date, dt.date, int]:
    """Half-open window and its length in days, from bounds of which either may be missing."""
    after = lambda d: (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    if start and end:
        lo, hi = start, end + dt.timedelta(days=1)
    elif start:
        lo, hi = start, after(start)
    elif end:
        lo, hi = end.replace(day=1), end + dt.timedelta(days=1)
    else:
        lo, hi = as_of.replace(day=1), after(as_of)
    return lo, hi, max(1, (hi - lo).days)
