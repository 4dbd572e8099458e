"""Scans of the landed parquet tables (SRC6, SRC7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table under ``root``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def table_scan(spark: SparkSession, name: str) -> DataFrame:
    """SRC7: scan a catalog table by name."""
    return spark.table(name)
