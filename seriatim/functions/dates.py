"""Dates: parsing to ISO strings, dates in running text, and the next time of a delivery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months as they are written in texts, and the formats of days that are tried in order.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DAY_FORMATS = ("yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d")
DEFAULT_ZONE, DEFAULT_HOUR = "America/New_York", 9


def parse_date(text: Column) -> Column:
    """ISO form of a date or date-time; null for null or empty text; any other text as it came. An offset is kept as it was written."""
    t = F.trim(text)
    clock = r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})"
    plain = F.when(t.rlike(clock + "$"), F.date_format(F.try_to_timestamp(t, F.lit("yyyy-M-d'T'H:m:s")), "yyyy-MM-dd'T'HH:mm:ss"))
    zoned = rf"{clock}(?:\.(\d{{1,6}}))?(Z|[+-]\d{{2}}:?\d{{2}})$"
    micros = F.rpad(F.regexp_extract(t, zoned, 2), 6, "0")
    offset = F.regexp_extract(t, zoned, 3)
    shown = F.when(offset == "Z", "+00:00").otherwise(F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, -2, 2)))
    base = F.date_format(F.try_to_timestamp(F.regexp_extract(t, zoned, 1), F.lit("yyyy-M-d'T'H:m:s")), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when((F.regexp_extract(t, zoned, 2) == "") | (micros == "000000"), "").otherwise(F.concat(F.lit("."), micros))
    with_zone = F.when(t.rlike(zoned), F.concat(base, fraction, shown))
    days = [F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM-dd'T'00:00:00") for f in DAY_FORMATS]
    return F.when(text != "", F.coalesce(plain, with_zone, *days, text))


def first_date(text: Column) -> Column:
    """The first ``Month D, YYYY`` as written."""
    return F.nullif(F.regexp_extract(text, rf"((?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}})", 1), F.lit(""))


def last_date(text: Column) -> Column:
    """The last ``Month D, YYYY`` (comma optional) in ISO form; null without one."""
    pattern = rf"(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}"
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.lit(-1))
    plain = F.regexp_replace(F.regexp_replace(found, ",", ""), r"\s+", " ")
    return F.date_format(F.try_to_timestamp(plain, F.lit("MMMM d yyyy")), "yyyy-MM-dd'T'HH:mm:ss")


def month_date(text: Column, within: int = 2000, keep_august: bool = False) -> Column:
    """A date by month's name in the first characters, without st, nd, rd, th; unless ``keep_august``, that also spoils August, which then stays as written."""
    raw = F.regexp_extract(F.substring(text, 1, within), rf"((?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})", 1)
    bare = F.regexp_replace(raw, r"(\d)(?:st|nd|rd|th)", "$1") if keep_august else F.regexp_replace(raw, "st|nd|rd|th", "")
    return F.when(raw != "", parse_date(bare))


def serial_date(number: Column, first: str = "1787-10-27") -> Column:
    """``first`` and ``number`` days."""
    return F.date_add(F.lit(first).cast("date"), number.cast("int"))


def weekday(day: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(day) - 1


def _hours(hour: Column) -> Column:
    return F.make_dt_interval(F.lit(0), hour.cast("int"))


def next_send_local(now: Column, days: Column, day: Column, hour: Column, zone: Column) -> Column:
    """Calendar days on from now in local time, at the preferred hour, then on to the preferred weekday if the pace is weekly or slower."""
    zone, hour = F.coalesce(zone, F.lit(DEFAULT_ZONE)), F.coalesce(hour.cast("int"), F.lit(DEFAULT_HOUR))
    d = F.date_add(F.to_date(F.from_utc_timestamp(now, zone)), days.cast("int"))
    step = F.when(day.isNotNull() & (days >= 7), F.pmod(day.cast("int") - weekday(d), F.lit(7))).otherwise(0)
    return F.to_utc_timestamp(F.date_add(d, step).cast("timestamp") + _hours(hour), zone)


def next_send_instant(now: Column, days: Column, day: Column, hour: Column, zone: Column) -> Column:
    """As a browser counts: days of 24 hours, the local date of that instant at the hour, and steps of 24 hours to the weekday."""
    later = F.timestamp_add("HOUR", days.cast("int") * 24, now)
    d = F.to_date(F.from_utc_timestamp(later, zone))
    at = F.to_utc_timestamp(d.cast("timestamp") + _hours(hour), zone)
    step = F.when(day.isNotNull() & (days >= 7), F.pmod(day.cast("int") - weekday(d), F.lit(7))).otherwise(0)
    return F.timestamp_add("HOUR", step * 24, at)


def next_send_simple(now: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), now)
