"""Calendar and date features (FEA1, FEA2, FOR3)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_FEATURES = ["year", "month", "day_of_year"]


def calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """FEA1: year, month, day of month, day of year, day of week (Sunday = 1)."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "day_of_year": F.dayofyear(d),
            "day_of_week": F.dayofweek(d),
        }
    )


def assemble(df: DataFrame, cols: list[str] | None = None, out: str = "features") -> DataFrame:
    """FEA2: numeric columns -> one vector column (the same list for fit and score)."""
    return VectorAssembler(inputCols=cols or BASE_FEATURES, outputCol=out, handleInvalid="skip").transform(df)


def calendar_between(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """FOR3: one row per day from ``start`` to ``end`` (inclusive) with year/month/day.

    The day list is one ``sequence`` (bounded by the number of days in the
    span, ~36,500 per century), exploded into rows.
    """
    days = F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    one = spark.range(1).select(F.explode(days).alias("date"))
    return one.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
    )


def forecast_calendar(spark: SparkSession, start: str = "2003-01-01", end: str = "2033-12-31") -> DataFrame:
    """FOR3 with the reference's span as default (11,323 days)."""
    return calendar_between(spark, F.lit(start).cast("date"), F.lit(end).cast("date"))


def calendar_for(df: DataFrame, date_col: str, years_ahead: int = 0) -> DataFrame:
    """A calendar covering the days of ``df`` plus ``years_ahead`` years.

    Both bounds come from one aggregate (one scalar subquery, referenced
    once), so ``df`` is evaluated a single time for them.
    """
    bounds = df.select(
        F.struct(
            F.min(date_col).alias("lo"), F.add_months(F.max(date_col), 12 * years_ahead).alias("hi")
        )
    ).scalar()
    b = df.sparkSession.range(1).select(bounds.alias("b"))
    days = b.select(F.explode(F.sequence(F.col("b.lo"), F.col("b.hi"), F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
    )
