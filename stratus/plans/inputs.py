"""Inputs of the registered queries: driver tables mapped to weather views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratus.operators.clean import clean_observations, station_dimension
from stratus.sources.tables import read_table
from stratus.sources.views import (
    live_readings,
    observation_values,
    raw_observations,
    station_raw,
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name)


def raw_obs(spark: SparkSession, root: str) -> DataFrame:
    return raw_observations(table(spark, root, "lineitem"))


def clean_obs(spark: SparkSession, root: str) -> DataFrame:
    return clean_observations(raw_obs(spark, root))


def obs_values(spark: SparkSession, root: str) -> DataFrame:
    return observation_values(table(spark, root, "lineitem"))


def stations_raw(spark: SparkSession, root: str) -> DataFrame:
    return station_raw(table(spark, root, "supplier"), table(spark, root, "nation"))


def stations(spark: SparkSession, root: str) -> DataFrame:
    return station_dimension(stations_raw(spark, root))


def live(spark: SparkSession, root: str) -> DataFrame:
    return live_readings(table(spark, root, "events"))
