"""Measures of the weather semantic model (MEA1-MEA17, AGG11-12).

A measure is evaluated as "apply the selection, then aggregate".  A measure
over ``ALLSELECTED`` / ``ALL`` is one value for the whole selection / table;
it is attached to every row as a scalar subquery (computed once, no join).

The bodies of MEA1-4, 6-11 are not published by the model (they are
external measures).  The definitions below are ours, derived from the
measure names, and say so:

* metric ids follow the icons: 1 = MaxTempC with max ("fire"),
  2 = MinTempC with min ("ice"), 3 = TotalPrecipmm with sum ("rain").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric_Param rows and icon labels (fixed values).
METRICS = {1: ("MaxTempC", "max", "fire"), 2: ("MinTempC", "min", "ice"), 3: ("TotalPrecipmm", "sum", "rain")}
TITLE_SUFFIX = " Real and Forecast by date"
PERIOD_PREFIX = "This will cover period of : "


def metric_agg(metric_id: int, suffix: str = "") -> Column:
    """MEA1/MEA2 (our definition): the aggregate chosen by a metric id."""
    col, fn, _ = METRICS[metric_id]
    return getattr(F, fn)(F.col(col + suffix))


def in_selection(date_col: str, start: str | None, end: str | None) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (F.col(date_col) <= F.lit(end).cast("date"))
    return cond


def max_real_date(history: DataFrame, date_col: str = "Datetime") -> Column:
    """MEA10 / MEA17 / AGG11: ``MAX(Datetime)`` over the unfiltered table."""
    return history.select(F.max(date_col)).scalar()


def real_series_with_axis(
    history: DataFrame, metric_id: int, start: str | None, end: str | None, date_col: str = "Datetime"
) -> DataFrame:
    """MEA1 per date plus MEA12 (metric over ALLSELECTED dates) on every row."""
    sel = history.filter(in_selection(date_col, start, end))
    per_date = sel.groupBy(date_col).agg(metric_agg(metric_id).cast("double").alias("metric_real"))
    axis = sel.select(metric_agg(metric_id).cast("double")).scalar()
    return per_date.withColumn("axis_real", axis)


def forecast_series_with_axis(
    forecast: DataFrame,
    history: DataFrame,
    metric_id: int,
    start: str | None,
    end: str | None,
    date_col: str = "date",
) -> DataFrame:
    """MEA2 per date plus MEA13: the metric over selected dates later than MaxRealDate."""
    sel = forecast.filter(in_selection(date_col, start, end))
    per_date = sel.groupBy(date_col).agg(
        metric_agg(metric_id, "_predicted").cast("double").alias("metric_forecast")
    )
    later = sel.filter(F.col(date_col) > max_real_date(history))
    axis = later.select(metric_agg(metric_id, "_predicted").cast("double")).scalar()
    return per_date.withColumn("axis_forecast", axis)


def period_text(day_count: Column) -> Column:
    """MEA14: ``This will cover period of : <n>days`` (``day`` when n <= 1; no space)."""
    return F.concat(
        F.lit(PERIOD_PREFIX),
        day_count.cast("string"),
        F.when(day_count > 1, F.lit("days")).otherwise(F.lit("day")),
    )


def selected_value(values: Column) -> Column:
    """SELECTEDVALUE: the value when exactly one distinct value is selected, else NULL."""
    return F.when(F.count_distinct(values) == 1, F.max(values))


def series_title(selected_metric: Column) -> Column:
    """MEA15: metric name + title suffix; a blank selection leaves the suffix alone."""
    return F.concat(F.coalesce(selected_metric, F.lit("")), F.lit(TITLE_SUFFIX))


def metric_icon(selected_id: Column) -> Column:
    """MEA16: the icon label of the selected metric id (a label, not an image)."""
    out = None
    for mid, (_, _, icon) in METRICS.items():
        out = (F.when(selected_id == mid, F.lit(icon)) if out is None else out.when(selected_id == mid, F.lit(icon)))
    return out


def metric_param(spark) -> DataFrame:
    """The Metric_Param slicer table (three fixed rows)."""
    return spark.createDataFrame(
        [(mid, name) for mid, (name, _, _) in METRICS.items()], "id long, Metric string"
    )


def history_metrics(history: DataFrame) -> DataFrame:
    """MEA1 of every metric id over the whole history, one row per id.

    One aggregate pass computes the three metrics; ``stack`` turns the one
    row into three, so no join or cross product is needed.
    """
    one = history.agg(*[metric_agg(m).cast("double").alias(f"m{m}") for m in METRICS])
    stacked = ", ".join(f"{m}L, m{m}" for m in METRICS)
    return one.selectExpr(f"stack({len(METRICS)}, {stacked}) AS (id, metric_real)")


def mean_rain_measures(history: DataFrame, by: list[str]) -> DataFrame:
    """MEA6-8 (our definitions): MeanTempReal = avg(MeanTempC),
    MeanRainReal = avg(TotalPrecipmm), RainReal = sum(TotalPrecipmm)."""
    return history.groupBy(*by).agg(
        F.round(F.avg("MeanTempC"), 6).alias("mean_temp_real"),
        F.round(F.avg("TotalPrecipmm"), 6).alias("mean_rain_real"),
        F.round(F.sum("TotalPrecipmm"), 6).alias("rain_real"),
    )


def extreme_text(value: Column, day: Column) -> Column:
    """Text of an extreme value and its day: ``<value> on <yyyy-MM-dd>``."""
    return F.concat(value.cast("string"), F.lit(" on "), day.cast("string"))


def extremes(
    real_daily: DataFrame, forecast_daily: DataFrame, real_date: str = "Datetime", fc_date: str = "date"
) -> DataFrame:
    """MEA9, MEA4, MEA11 (our definitions) over per-date metric series.

    The extreme is the largest value; ties go to the earliest day
    (``max`` over a struct of (value, -day)).  The error is
    |forecast - real| on the forecast's extreme day (NULL if no real value
    that day): the one-row forecast extreme is left-joined to the real
    series on the day (a one-row probe side), and the real extreme's text is
    one scalar subquery.
    """
    def top(df: DataFrame, val: str, d: str) -> DataFrame:
        t = F.max(F.struct(F.col(val), (-F.unix_date(F.col(d))).alias("nd"))).alias("t")
        return df.agg(t).select(
            F.col("t." + val).alias("v"), F.date_from_unix_date(-F.col("t.nd")).alias("d")
        )

    r_text = top(real_daily, "metric_real", real_date).select(extreme_text(F.col("v"), F.col("d"))).scalar()
    f = top(forecast_daily, "metric_forecast", fc_date)
    real = real_daily.select(F.col(real_date).alias("_rd"), F.col("metric_real").alias("_rv"))
    j = f.join(real, f["d"] == real["_rd"], "left")
    return j.select(
        extreme_text(F.col("v"), F.col("d")).alias("forecast_maximal_value"),
        F.abs(F.col("v") - F.col("_rv")).alias("forecast_maximal_value_error"),
        r_text.alias("real_maximal_value"),
    )
