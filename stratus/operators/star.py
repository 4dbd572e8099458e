"""Star schema: facts joined to the station and date dimensions (JON2-JON4, AGG10).

Joins are plain equi-joins; Spark picks the strategy.  A dimension is
broadcast only when Spark's own size estimate (or AQE's runtime size) is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise the join is a
sort-merge join whose hot keys AQE splits.  Where an aggregate follows the
join, the fact side is aggregated to (key, group) first, so the shuffle
carries one row per station and period, not one per observation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.columns import col_of, rain_flag, season

# Columns summed by default in each table of the model (fixed values); all other columns are not aggregated.
DEFAULT_SUMS = {
    "forecast": ["Rain_predicted", "MaxTempC_predicted", "MinTempC_predicted", "TotalPrecipmm_predicted", "Precipitation_predicted_fbp"],
    "history": ["MaxTempC", "MinTempC", "MeanTempC", "TotalPrecipmm"],
    "live": ["Temperature", "TemperatureMin", "TemperatureMax", "Humidity", "Pressure", "Rain"],
    "station": [],
    "date": ["year", "month", "day"],
    "metric": ["id"],
    "external": ["Max Temp", "Min Temp", "Heat Deg Days", "Total Precip (mm)"],
    "anomalies": ["currentTemp"],
}


def date_dimension(calendar: DataFrame) -> DataFrame:
    """The ``Date`` dimension: calendar rows plus a meteorological season."""
    return calendar.withColumn("season", season(F.col("date")))


def join_dimension(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None) -> DataFrame:
    """JON2/JON4: many-to-one left join; facts without a dimension row are kept."""
    dim_key = dim_key or fact_key
    if fact_key == dim_key:
        return fact.join(dim, on=fact_key, how="left")
    return fact.join(dim, fact[fact_key] == dim[dim_key], "left")


def join_by_name(fact: DataFrame, stations: DataFrame, name_col: str = "Station") -> DataFrame:
    """JON3: many-to-many join of a station-name column to ``Station.Name``.

    A name that appears twice in the dimension doubles the matching facts;
    that multiplication is the relationship's meaning.
    """
    return fact.join(stations, fact[name_col] == stations["Name"], "inner")


def star_history(obs: DataFrame, stations: DataFrame, dates: DataFrame) -> DataFrame:
    """History facts with station and date attributes (JON2 + JON4)."""
    with_station = join_dimension(obs, stations, "ClimateID")
    return with_station.join(dates, with_station["Datetime"] == dates["date"], "left").drop("date")


def summarize(df: DataFrame, by: list[str], table: str) -> DataFrame:
    """AGG10: the columns that ``table`` of the model sums by default, grouped by ``by``."""
    exprs = [F.sum(col_of(c)).alias(c) for c in DEFAULT_SUMS[table] if c in df.columns and c not in by]
    return df.groupBy(*by).agg(*exprs)


def monthly_summary(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Monthly summary per province: mean max/min temperature, total precipitation,
    rainy station-days and observation count.

    Plan: partial aggregate per (station, year, month) -> join the (small)
    station dimension -> final aggregate per (province, year, month).  The
    averages are carried as sum and count so the two-level aggregation is
    exact.
    """
    per_station = (
        obs.select(
            "ClimateID",
            F.year("Datetime").alias("year"),
            F.month("Datetime").alias("month"),
            "MaxTempC",
            "MinTempC",
            "TotalPrecipmm",
        )
        .groupBy("ClimateID", "year", "month")
        .agg(
            F.sum("MaxTempC").alias("s_max"),
            F.count("MaxTempC").alias("n_max"),
            F.sum("MinTempC").alias("s_min"),
            F.count("MinTempC").alias("n_min"),
            F.sum("TotalPrecipmm").alias("s_precip"),
            F.sum(rain_flag(F.col("TotalPrecipmm"))).alias("s_rain"),
            F.count(F.lit(1)).alias("n_obs"),
        )
    )
    joined = join_dimension(per_station, stations.select("ClimateID", "Province"), "ClimateID")
    return joined.groupBy("Province", "year", "month").agg(
        F.round((F.sum("s_max") / F.sum("n_max")).cast("double"), 6).alias("avg_max_temp"),
        F.round((F.sum("s_min") / F.sum("n_min")).cast("double"), 6).alias("avg_min_temp"),
        F.round(F.sum("s_precip").cast("double"), 6).alias("total_precip"),
        F.sum("s_rain").cast("bigint").alias("rainy_station_days"),
        F.sum("n_obs").cast("bigint").alias("n_obs"),
    )
