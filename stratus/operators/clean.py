"""Cleaning of landed daily observations (raw -> staging).

Order of the staging job: select the used columns, de-duplicate, drop rows
without temperatures, default blank precipitation, parse the day, type the
columns.  All steps are narrow except the de-duplication, which is a hash
aggregate with map-side partial de-duplication (a hot row repeated a
billion times collapses before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.functions.columns import (
    blank_to,
    col_of,
    is_blank_or_missing,
    sanitize_name,
)
from stratus.schema import MEASURE_COLUMNS, OBSERVATION_COLUMNS


def sanitize_columns(df: DataFrame) -> DataFrame:
    """PRJ2: strip non-word characters from every column name.

    Raises ValueError when two names collide after cleaning, instead of
    silently keeping one of them.
    """
    new = [sanitize_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, cleaned in zip(df.columns, new):
        key = cleaned.lower()
        if key in seen:
            raise ValueError(f"columns {seen[key]!r} and {old!r} both clean to {cleaned!r}")
        seen[key] = old
    return df.select([col_of(o).alias(n) for o, n in zip(df.columns, new)])


def blank_profile(df: DataFrame) -> DataFrame:
    """AGG1: per column, the number of NULL / NaN / blank values; one row, one scan."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        [
            F.count_if(is_blank_or_missing(col_of(c), c in floats)).alias(c)
            for c in df.columns
        ]
    )


def select_observations(df: DataFrame) -> DataFrame:
    """PRJ1: the eight columns used downstream."""
    return df.select(*OBSERVATION_COLUMNS)


def drop_missing_temperatures(df: DataFrame) -> DataFrame:
    """FLT3: keep rows whose max and min temperature are ``!= ''``.

    A NULL compares to NULL and is dropped; a lone space is kept (and later
    casts to NULL), exactly like the string comparison it replaces.
    """
    return df.filter((F.col("MaxTempC") != "") & (F.col("MinTempC") != ""))


def default_blank_precipitation(df: DataFrame, default: str = "0.0") -> DataFrame:
    """PRJ5: blank precipitation -> ``default``; NULL stays NULL."""
    return df.withColumn("TotalPrecipmm", blank_to(F.col("TotalPrecipmm"), default))


def parse_day(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """PRJ8: ``DateTime`` text -> ``Datetime`` date; unparsable text -> NULL."""
    return df.withColumn("DateTime", F.try_to_date(F.col("DateTime"), fmt)).withColumnRenamed(
        "DateTime", "Datetime"
    )


def type_columns(df: DataFrame) -> DataFrame:
    """PRJ6 / PRJ12: measures to decimal(18,2) with ``try_cast`` (bad text -> NULL).

    ``ClimateID`` stays a string: ids such as ``1018F`` exist, and the
    station dimension joins on the string id.
    """
    return df.withColumns(
        {c: F.col(c).try_cast(T.DecimalType(18, 2)) for c in MEASURE_COLUMNS if c in df.columns}
    )


def clean_observations(raw: DataFrame) -> DataFrame:
    """The staging job: PRJ1, SET3, FLT3, PRJ5, PRJ8, PRJ6 as one lazy plan."""
    return (
        raw.transform(select_observations)
        .dropDuplicates()
        .transform(drop_missing_temperatures)
        .transform(default_blank_precipitation)
        .transform(parse_day)
        .transform(type_columns)
    )


def with_date_string(df: DataFrame, date_col: str = "Datetime") -> DataFrame:
    """PRJ9: the day again as ``yyyy-MM-dd`` text (``DatetimeStrg``)."""
    return df.withColumn(date_col + "Strg", F.col(date_col).cast("string"))


def station_dimension(stations: DataFrame, province: str | None = None) -> DataFrame:
    """FLT1, FLT2, PRJ7: stations with an id, id as string, optionally one province."""
    out = stations.filter(F.col("ClimateID").isNotNull())
    if province is not None:
        out = out.filter(F.col("Province") == province)
    return out.select(
        F.col("ClimateID").cast("string").alias("ClimateID"), "Name", "Province"
    )


def drop_header_rows(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """FLT7: remove rows where a column holds its own header text.

    ``eqNullSafe`` keeps NULL rows, as the model's ``<>`` does.
    """
    cond = None
    for c, text in headers.items():
        term = ~col_of(c).eqNullSafe(F.lit(text))
        cond = term if cond is None else cond & term
    return df if cond is None else df.filter(cond)


def retype(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """PRJ12: bulk type change where a failed conversion becomes NULL."""
    return df.withColumns({c: col_of(c).try_cast(t) for c, t in types.items()})
