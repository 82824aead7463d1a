"""Timestamp parsing, truncation and text forms. All work on TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Shape of a date that is not in ISO form -> layout. The shapes exclude each other, so
# that at most one layout is tried per value. A month is a name or its first three letters.
_MONTH, _SHORT = "[A-Z][a-z]{3,}", "[A-Z][a-z]{2}"
DAYS = {
    r"\d{1,2}/\d{1,2}/\d{4}": "M/d/yyyy",
    r"\d{4}/\d{1,2}/\d{1,2}": "yyyy/M/d",
    r"\d{4}\.\d{1,2}\.\d{1,2}": "yyyy.M.d",
    r"\d{1,2}-\d{1,2}-\d{4}": "M-d-yyyy",
    r"\d{8}": "yyyyMMdd",
    rf"\d{{1,2}} {_SHORT} \d{{4}}": "d MMM yyyy",
    rf"\d{{1,2}} {_MONTH} \d{{4}}": "d MMMM yyyy",
    rf"\d{{1,2}}-{_SHORT}-\d{{4}}": "d-MMM-yyyy",
    rf"{_SHORT} \d{{1,2}},? \d{{4}}": "MMM d[,] yyyy",
    rf"{_MONTH} \d{{1,2}},? \d{{4}}": "MMMM d[,] yyyy",
    r"\d{4}-\d{1,2}-\d{1,2}": "yyyy-M-d",
}
# Shape of a time behind a date -> layout.
TIMES = {
    r" \d{1,2}:\d{2}": " H:mm",
    r" \d{1,2}:\d{2}:\d{2}": " H:mm:ss",
    r" \d{1,2}:\d{2} [AaPp][Mm]": " h:mm a",
    r" \d{1,2}:\d{2}:\d{2} [AaPp][Mm]": " h:mm:ss a",
}

# Frequency letter -> (truncation unit, one step, season length in steps).
FREQUENCIES = {
    "D": ("day", "1 day", 7),
    "W": ("week", "7 days", 52),
    "M": ("month", "1 month", 12),
    "Q": ("quarter", "3 months", 4),
}


def _parsed(t: Column) -> Column:
    clock = F.upper(F.regexp_extract(t, r"(?: \d{1,2}:\d{2}(?::\d{2})?(?: [AaPp][Mm])?)?$", 0))
    day = F.substring(t, F.lit(1), F.length(t) - F.length(clock))
    day = F.when(day.rlike(r"^[A-Z][a-z]{2,} \d{4}$"), F.concat(F.lit("1 "), day)).otherwise(day)  # a month is its first day
    century = F.when(F.substring(day, -2, 2) >= "69", "19").otherwise("20")  # as Python reads two digits
    day = F.when(day.rlike(rf"^\d{{1,2}}-{_SHORT}-\d{{2}}$"), F.regexp_replace(day, r"(?=\d{2}$)", century)).otherwise(day)
    date, seconds = F.when(F.lit(False), None), F.when(clock == "", F.lit(0).cast("bigint"))
    for shape, layout in DAYS.items():
        date = date.when(day.rlike(f"^{shape}$"), F.try_to_timestamp(day, F.lit(layout)))
    for shape, layout in TIMES.items():
        moment = F.try_to_timestamp(F.concat(F.lit("1970-01-01"), clock), F.lit("yyyy-MM-dd" + layout))
        seconds = seconds.when(clock.rlike(f"^{shape}$"), (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)).cast("bigint"))
    other = F.timestamp_add("SECOND", seconds, date.cast("timestamp_ntz"))
    return F.when(t.rlike(r"^\d{4}-\d{1,2}") & ~t.rlike("[AaPp][Mm]$"), t.try_cast("timestamp_ntz")).otherwise(other)


def coerce_timestamp(text: Column) -> Column:
    """Text to timestamp; NULL where no layout fits. A bare year or a bare time is no date."""
    # the lambda's argument is computed once, however often the layouts refer to it
    return F.transform(F.array(strip(text)), _parsed)[0]


# Dates in which the first number may be the day or the month.
_TWO_WAYS = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})(?!\d)"


def day_first_votes(text: Column) -> list[Column]:
    """Two aggregates: how many values fit with the day first, and with the month first."""
    t = strip(text)
    first, second = (F.regexp_extract(t, _TWO_WAYS, i).try_cast("int") for i in (1, 3))
    return [F.count_if((first <= 31) & (second <= 12)), F.count_if((first <= 12) & (second <= 31))]


def swap_day_and_month(text: Column, swap: Column) -> Column:
    """Text in which, if `swap`, day-first dates read month first; what else it holds stays."""
    return F.when(swap, F.regexp_replace(strip(text), _TWO_WAYS, "$3$2$1$2$4")).otherwise(text)


def strict_timestamp(text: Column) -> Column:
    """As coerce_timestamp, but a non-null value that does not parse fails the query."""
    parsed = coerce_timestamp(text)
    problem = F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("timestamp_ntz")
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(problem)


def truncate(unit: str, ts: Column) -> Column:
    """Start of the day, week (Monday), month or quarter; no time zone comes into it."""
    day = ts.cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, order-preserving."""
    minutes = (F.unix_date(ts.cast("date")) * F.lit(24).cast("bigint") + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECONDS"), ts) * 1_000_000).cast("bigint")


def _text(ts: Column, separator: str) -> Column:
    layout = f"yyyy-MM-dd{separator}HH:mm:ss"
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", F.date_format(ts, layout)).otherwise(
        F.date_format(ts, layout + ".SSSSSS")
    )


def timestamp_text(ts: Column) -> Column:
    """'2024-01-01 00:00:07.179500'; the fraction only where there is one."""
    return _text(ts, " ")


def iso_text(ts: Column) -> Column:
    return _text(ts, "'T'")
