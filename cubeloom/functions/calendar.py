"""Calendar arithmetic as column expressions.

A dekad is a third of a month: days 1-10, 11-20, and the rest. Months count from year 0 where they are added up
(``year * 12 + month - 1``), so that arithmetic may pass any number of year ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def month_end(index: Column) -> Column:
    """The last day of a month by its index."""
    return F.last_day(F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1)))


def minus_months(day: Column, n: int) -> dict[str, Column]:
    """Year, month and month end of ``n`` months before."""
    end = F.last_day(F.add_months(day, -n))
    return {"year": F.year(end), "month": F.month(end), "month_end": end}


def season(day: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    return (
        F.when(F.month(day).isin(12, 1, 2), "DJF").when(F.month(day).isin(3, 4, 5), "MAM")
        .when(F.month(day).isin(6, 7, 8), "JJA").when(F.month(day).isNotNull(), "SON")
    )


def quarter_end(day: Column) -> Column:
    """The last day of the calendar quarter."""
    return F.last_day(F.make_date(F.year(day), F.quarter(day) * 3, F.lit(1)))


def week_end_monday(day: Column) -> Column:
    """The Monday that closes the week Tuesday to Monday: the day itself if it is one."""
    return F.next_day(F.date_sub(day, 1), "MON")


def bucket(day: Column, rule: str) -> Column:
    """The label of the period that holds ``day``: D, M (month end), Y (December 31), Q-DEC, W-MON or DEKAD (its start)."""
    day = day.cast("date")
    if rule == "D":
        return day
    if rule == "M":
        return F.last_day(day)
    if rule == "Y":
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    if rule == "Q-DEC":
        return quarter_end(day)
    if rule == "W-MON":
        return week_end_monday(day)
    if rule == "DEKAD":
        return dekad_start(day)
    raise ValueError(f"unknown period {rule}")


def group_key(day: Column, period: str) -> Column:
    """The calendar group of a climatology: month, season, dayofyear or year."""
    return {"month": F.month, "season": season, "dayofyear": F.dayofyear, "year": F.year}[period](day)


def dekad_of_month(day: Column) -> Column:
    return F.least(F.floor((F.dayofmonth(day) - 1) / 10).cast("int") + 1, F.lit(3))


def dekad_of_year(day: Column) -> Column:
    """1 to 36."""
    return ((F.month(day) - 1) * 3 + dekad_of_month(day)).cast("int")


def dekad_start(day: Column) -> Column:
    return F.make_date(F.year(day), F.month(day), (dekad_of_month(day) * 10 - 9).cast("int"))


def dekad_end(day: Column) -> Column:
    return F.when(dekad_of_month(day) == 3, F.last_day(day)).otherwise(
        F.make_date(F.year(day), F.month(day), (F.least(dekad_of_month(day), F.lit(2)) * 10).cast("int"))
    )


def is_dekad_start(day: Column) -> Column:
    return day == dekad_start(day)


def is_dekad_end(day: Column) -> Column:
    return day == dekad_end(day)


def dekad_date(year: Column, number: Column) -> Column:
    """The last day of a year's dekad 1 to 36."""
    start = F.make_date(year.cast("int"), (F.floor((number - 1) / 3) + 1).cast("int"), (((number - 1) % 3) * 10 + 1).cast("int"))
    return dekad_end(start)


def days_in_month(day: Column, calendar: str = "standard") -> Column:
    """Length of the month under a climate-model calendar."""
    lengths = F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])
    month, year = F.month(day), F.year(day)
    fixed = F.element_at(lengths, month)
    julian = year % 4 == 0
    gregorian = julian & ((year % 100 != 0) | (year % 400 == 0))
    if calendar == "360_day":
        return F.when(month.isNotNull(), F.lit(30))
    if calendar in ("noleap", "365_day"):
        return fixed
    if calendar in ("all_leap", "366_day"):
        return fixed + (month == 2).cast("int")
    leap = julian if calendar == "julian" else gregorian
    if calendar in ("standard", "gregorian", "proleptic_gregorian", "julian"):
        return fixed + ((month == 2) & leap).cast("int")
    raise ValueError(f"unknown calendar {calendar}")


def valid_time(start: Column, horizon_days: Column) -> Column:
    """When a forecast is for."""
    return F.date_add(start, horizon_days.cast("int"))


def months_ahead(horizon_days: Column) -> Column:
    """1, 2 or 3 for horizons that are whole months; null for any other."""
    return F.when(horizon_days.between(28, 31), 1).when(horizon_days.between(59, 62), 2).when(horizon_days.between(89, 92), 3)


def week_of_name(year: Column, week: Column) -> Column:
    """The Monday of week ``week``, where week 1 begins with the year's first Monday."""
    return F.date_add(F.next_day(F.make_date(year.cast("int") - 1, F.lit(12), F.lit(31)), "MON"), (7 * (week - 1)).cast("int"))


def time_of_file(name: Column, kind: str, base: int = 0) -> Column:
    """The acquisition date in a file name.

    Kinds: ``week`` (P, year, 0, week), ``dekad`` (.t, year, number of the dekad, counted from ``base``), ``day`` (.A, year, day of
    year), ``month`` (_, year, month) and ``year`` (-, year, -; December 31).
    """
    part = lambda pattern, k: F.nullif(F.regexp_extract(name, pattern, k), F.lit("")).cast("int")
    if kind == "week":
        named = r"P(\d{4,})0(\d{2})(?!\d)"  # years beyond 9999 too
        return week_of_name(part(named, 1), part(named, 2))
    if kind == "dekad":
        return dekad_date(part(r"\.t(\d{4})(\d{2})", 1), part(r"\.t(\d{4})(\d{2})", 2) + 1 - base)
    if kind == "day":
        return F.date_add(F.make_date(part(r"\.A(\d{4})(\d{3})", 1), F.lit(1), F.lit(1)), part(r"\.A(\d{4})(\d{3})", 2) - 1)
    if kind == "month":
        return F.last_day(F.make_date(part(r"_(\d{4})(\d{2})(?!\d)", 1), part(r"_(\d{4})(\d{2})(?!\d)", 2), F.lit(1)))
    if kind == "year":
        return F.make_date(part(r"-(\d{4})-", 1), F.lit(12), F.lit(31))
    raise ValueError(f"unknown kind of file name {kind}")
