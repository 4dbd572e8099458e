"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.session import checkpoint_root, configure


def start(spark: SparkSession) -> None:
    """Ship the package to the executors, bound the rows of an Arrow batch (texts
    may be long) and make sure a checkpoint folder is set."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    checkpoint_root(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that columns made beside it can't meet the caller's names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def columns_of(row: str, names: list[str]) -> list[Column]:
    """The columns out of the struct ``row`` again."""
    return [F.col(row)[c].alias(c) for c in names]


def text_key(text: Column) -> Column:
    """Row identity beside the id: repeated ids with different texts stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
