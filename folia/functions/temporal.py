"""Temporal kinds and phrases as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of ranges and of times of day.  [-–—to] takes the letters t and o too, since results must match.
RANGES = [
    r"^\d{1,2}:\d{2}\s*[-–—to]\s*\d{1,2}:\d{2}$",
    r"^\d{1,2}:\d{2}\s*(?:am|pm)\s*[-–—to]\s*\d{1,2}:\d{2}\s*(?:am|pm)$",
    r"^\d{1,2}\s*(?:am|pm)\s*[-–—to]\s*\d{1,2}\s*(?:am|pm)$",
    r"^\d{1,2}[-–—]\d{1,2}\s*(?:am|pm)$",
]
TIMES = [r"^\d{1,2}:\d{2}(:\d{2})?(\s*[ap]\.?m\.?)?$", r"^\d{1,2}\s*[ap]\.?m\.?$", r"^([01]?\d|2[0-3])([.:][0-5]\d)?([.:][0-5]\d)?$", r"^(noon|midnight)$"]
# The date forms that are read (the common ones of a free-form reader).
DATES = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "dd MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyyMMdd"]
DATETIMES = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss"]
_WEEKS = ["first", "second", "third", "fourth", "fifth"]
_DECADES = [*_WEEKS, "sixth", "seventh", "eighth", "ninth", "tenth"]


def _once(value: Column, say: Callable[[Column], Column]) -> Column:
    """``say(value)``, with ``value`` had once for a row, however often it is named there."""
    return F.get(F.transform(F.array(value), lambda x: say(x)), F.lit(0))


def _pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), i.cast("int"))


#: What the letters of a form can stand for at most.
_LETTERS = {"yyyy": r"[+-]?\d+", "MMMM": r"\D+", "MMM": r"\D+", "MM": r"\d\d", "M": r"[+-]?\d+", "dd": r"\d\d", "d": r"[+-]?\d+", "HH": r"\d\d", "mm": r"\d\d", "ss": r"\d\d"}


def shape(format_: str) -> str:
    """A pattern that every string of a date form meets; few others do, and those the reader itself refuses."""
    parts = re.findall(r"'([^']*)'|([A-Za-z])(\2*)|(.)", format_, re.S)
    return "(?is)^" + "".join(_LETTERS[a + b] if a else re.escape(quoted or plain) for quoted, a, b, plain in parts) + r"\z"


def parsed(c: Column, formats: list[str]) -> Column:
    """A reader fails by an exception, which is slow, so strings without its form's shape don't reach it."""
    c = F.trim(c)
    return F.coalesce(*(F.when(c.rlike(shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats))


def temporal_kind(c: Column) -> Column:
    """NONE, DATE, TIME, DATETIME or TIME_RANGE; long strings are NONE."""
    low = F.lower(F.trim(c))
    any_of = lambda patterns: low.rlike("|".join(f"(?:{p})" for p in patterns))
    plain = ~low.rlike("[0-9]|noon|midnight")  # no kind does without these
    long = (F.char_length(c) > 50) | (F.size(F.split(F.trim(c), r"\s+")) > 8)
    return (
        F.when(c.isNull() | (c == "") | plain | long, "NONE")
        .when(any_of(RANGES), "TIME_RANGE")
        .when(any_of(TIMES), "TIME")
        .when(parsed(c, DATETIMES).isNotNull(), "DATETIME")
        .when(parsed(c, DATES).isNotNull(), "DATE")
        .otherwise("NONE")
    )


def time_phrase(t: Column) -> Column:
    """A timestamp's time of day in words."""
    h, m, s = F.hour(t), F.minute(t), F.second(t)
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    half = F.when(h < 12, "AM").otherwise("PM")
    day = F.when((h >= 4) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 21), "evening").otherwise("night")
    say = lambda label, hour: F.concat(F.lit(label + " "), hour.cast("string"), F.lit(" "), half)
    plain = F.concat(h12.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(" "), half)
    desc = F.when(s != 0, plain).when(m == 0, say("o'clock", h12)).when(m == 15, say("quarter past", h12)).when(m == 30, say("half past", h12)).when(m == 45, say("quarter to", h12 % 12 + 1)).otherwise(plain)
    minute = F.when(m != 0, F.concat(F.lit(", at minute "), m.cast("string"))).otherwise("")
    second = F.when(s != 0, F.concat(F.lit(", at second "), s.cast("string"))).otherwise("")
    return F.concat(F.lit("at "), desc, F.lit(" in the "), day, minute, second)


def date_phrase(t: Column) -> Column:
    """A timestamp's date in words; the century counts from year 0."""
    y, d = F.year(t), F.dayofmonth(t)
    century = F.floor(y / 100) + 1
    return F.concat(
        F.lit("the month of "), F.date_format(t, "MMMM"), F.lit(" ("), _pick(_WEEKS[:4], F.quarter(t)), F.lit(" quarter), in the "), _pick(_WEEKS, F.floor((d - 1) / 7) + 1),
        F.lit(" week, on "), F.date_format(t, "EEEE"), F.lit(" day "), d.cast("string"), F.lit(", in the year "), y.cast("string"), F.lit(", during the "),
        _pick(_DECADES, F.floor((y % 100) / 10) + 1), F.lit(" decade of the "), century.cast("string"), F.when(century == 1, "st").when(century == 2, "nd").when(century == 3, "rd").otherwise("th"), F.lit(" century"),
    )


def datetime_phrase(t: Column) -> Column:
    return F.concat(date_phrase(t), F.lit(", "), time_phrase(t))


def clock(c: Column) -> Column:
    """A time of day (``3pm``, ``14:00``, ``noon``) as a timestamp of 1970-01-01; null if it is none."""
    low = F.regexp_replace(F.lower(F.trim(c)), r"\.(?=m)|(?<=m)\.", "")
    h = F.regexp_extract(low, r"^(\d{1,2})", 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(low, r"^\d{1,2}[.:](\d{2})", 1).try_cast("int"), F.lit(0))
    s = F.coalesce(F.regexp_extract(low, r"^\d{1,2}[.:]\d{2}[.:](\d{2})", 1).try_cast("int"), F.lit(0))
    h = F.when(low.rlike("pm?$") & (h < 12), h + 12).when(low.rlike("am?$") & (h == 12), 0).otherwise(h)
    at = F.timestamp_seconds(h * 3600 + m * 60 + s)
    return F.when(low == "noon", F.timestamp_seconds(F.lit(43200))).when(low == "midnight", F.timestamp_seconds(F.lit(0))).when((h < 24) & (m < 60), at)


def time_range(c: Column) -> Column:
    """struct(start, end); a half of the day that only the end names holds for both."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(c)), r"\s*(?:[-–—]|to)+\s*", "-"), "-")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    half = F.regexp_extract(b, r"([ap]m)$", 1)
    return F.struct(clock(F.when(a.rlike("[ap]m$"), a).otherwise(F.concat(a, half))).alias("start"), clock(b).alias("end"))


def temporal_phrase(c: Column) -> Column:
    """What a temporal string says in words; other strings come back as they are."""
    range_ = lambda span: F.concat(F.lit("from "), _once(span["start"], time_phrase), F.lit(" until "), _once(span["end"], time_phrase))
    said = lambda kind: (
        F.when(kind == "TIME", _once(clock(c), time_phrase))
        .when(kind == "DATE", _once(parsed(c, DATES), date_phrase))
        .when(kind == "DATETIME", _once(parsed(c, DATETIMES), datetime_phrase))
        .when(kind == "TIME_RANGE", _once(time_range(c), range_))
    )
    return F.coalesce(_once(temporal_kind(c), said), c)
