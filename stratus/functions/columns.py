"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NON_WORD = re.compile(r"\W")


def sanitize_name(name: str) -> str:
    """Drop every character that is not a word character: ``Max Temp (°C)`` -> ``MaxTempC``."""
    return _NON_WORD.sub("", name)


def col_of(name: str) -> Column:
    """A column by its literal name (backticked, so dots and spaces are safe)."""
    return F.col("`" + name.replace("`", "``") + "`")


def rain_flag(precip: Column) -> Column:
    """PRJ4: 1 when precipitation > 0, else 0; NULL precipitation gives 0."""
    return F.when(precip > 0, F.lit(1)).otherwise(F.lit(0))


def blank_to(c: Column, default: str) -> Column:
    """PRJ5: a trimmed-blank string becomes ``default``; NULL stays NULL."""
    return F.when(F.trim(c) == "", F.lit(default)).otherwise(c)


def is_blank_or_missing(c: Column, numeric_float: bool) -> Column:
    """AGG1 test: NULL, NaN (float columns only) or blank after trim."""
    cond = c.isNull()
    if numeric_float:
        cond = cond | F.isnan(c)
    else:
        cond = cond | (F.trim(c.cast("string")) == "")
    return cond


def season(d: Column) -> Column:
    """Meteorological season of a date (DJF winter, MAM spring, JJA summer, SON autumn)."""
    m = F.month(d)
    return (
        F.when(m.isin(12, 1, 2), F.lit("Winter"))
        .when(m.isin(3, 4, 5), F.lit("Spring"))
        .when(m.isin(6, 7, 8), F.lit("Summer"))
        .otherwise(F.lit("Autumn"))
    )


def same_calendar_day(d: Column, as_of: str, years: int) -> Column:
    """FLT8: same month and day as ``as_of`` within the last ``years`` years (inclusive).

    The year range is written as a date range so it reaches the scan as a
    pushed filter; month/day equality is evaluated after.  Feb 29 only
    matches leap years.
    """
    a = F.lit(as_of).cast("date")
    start = F.make_date(F.year(a) - F.lit(years), F.lit(1), F.lit(1))
    end = F.make_date(F.year(a) + F.lit(1), F.lit(1), F.lit(1))
    return (
        (d >= start)
        & (d < end)
        & (F.month(d) == F.month(a))
        & (F.dayofmonth(d) == F.dayofmonth(a))
    )


def json_array(json_rows: Column) -> Column:
    """AGG6 fold: JSON object strings -> ``[a, b, ...]`` sorted; empty -> ``[]``."""
    return F.concat(
        F.lit("["), F.concat_ws(", ", F.array_sort(F.collect_list(json_rows))), F.lit("]")
    )
