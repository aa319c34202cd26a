"""Calendar columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# German weekday names, Monday first.
WEEKDAYS = ["Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag"]
# Sorted factor levels; the first one is the regression baseline.
WEEKDAY_LEVELS = sorted(WEEKDAYS)
WEEKDAY_BASE = WEEKDAY_LEVELS[0]
WEEKEND = ["Samstag", "Sonntag"]
# Summer holidays and the freezing point in degrees Fahrenheit.
SUMMER_HOLIDAY = ("2022-06-25", "2022-08-28")
FREEZING_F = 32


def weekday_name(date: Column) -> Column:
    """German weekday name, whatever the locale of the machine."""
    names = F.create_map(*chain.from_iterable((F.lit(i), F.lit(n)) for i, n in enumerate(WEEKDAYS)))
    return F.element_at(names, F.weekday(date))


def weekday_short(name: Column) -> Column:
    return F.substring(name, 1, 2)


def weekday_order(short: Column) -> Column:
    """1..7 display order Mo, Di, Mi, Do, Fr, Sa, So."""
    out = F.lit(None).cast("int")
    for i, n in enumerate(WEEKDAYS, start=1):
        out = F.when(short == n[:2], i).otherwise(out)
    return out


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({"month": F.month(d), "day": F.dayofmonth(d), "weekday": weekday_name(d)})


def in_dates(df: DataFrame, col: str, first: str, last: str) -> Column:
    """True from the first to the last date, both included.

    A timestamp column is compared as it is with the day limits, so the filter
    reaches the file scan; a cast of the column to a date would hide it.
    """
    kind = df.schema[col].dataType.simpleString()
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    if kind == "date":
        return F.col(col).between(lo, hi)
    return (F.col(col) >= lo.cast(kind)) & (F.col(col) < F.date_add(hi, 1).cast(kind))


def flag(cond: Column) -> Column:
    """0/1 double; null when the condition is null."""
    return cond.cast("int").cast("double")


def add_flags(
    df: DataFrame,
    date: str = "date",
    month: str = "month",
    weekday: str = "weekday",
    temperature: str = "mean_temperature",
    holiday: tuple[str, str] = SUMMER_HOLIDAY,
    freezing: float = FREEZING_F,
) -> DataFrame:
    """Month slope, weekend, holiday and freezing flags."""
    first, last = (F.lit(h).cast("date") for h in holiday)
    return df.withColumns(
        {
            "JanuarySlope": flag(F.col(month) == 1),
            "FebruarySlope": flag(F.col(month) == 2),
            "MarchSlope": flag(F.col(month) == 3),
            "NovemberSlope": flag(F.col(month) == 11),
            "IsWeekend": flag(F.col(weekday).isin(WEEKEND)),
            "IsSummerHoliday": flag(F.col(date).between(first, last)),
            "IsFreezing": flag(F.col(temperature) <= freezing),
        }
    )
