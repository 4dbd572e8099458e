"""Row numbering within groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequential_index(df: DataFrame, by: list[str], order: list[str], name: str = "index") -> DataFrame:
    """1-based position of each row within its ``by`` group, ordered by ``order``.

    Equivalent to ``row_number() OVER (PARTITION BY by ORDER BY order)`` but
    scale-safe: rows are range-partitioned on (by, order), so a big group is
    spread over many tasks; each task numbers its rows locally, and a small
    table of per-(task, group) counts (bounded by tasks x groups) gives each
    task's offset.  The sorted frame is checkpointed to the shared folder so
    both uses read identical partitions (and survive an executor loss).
    ``order`` must make the order total (end with a unique key).
    """
    from stratus.session import checkpoint_root

    checkpoint_root(df.sparkSession)
    keys = [*by, *order]
    sorted_df = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    ).checkpoint(eager=True)
    counts = sorted_df.groupBy("_pid", *by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")
    )
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    joined = sorted_df.join(offsets.select("_pid", *by, "_off", "_first"), ["_pid", *by], "inner")
    return joined.withColumn(
        name, (F.col("_off") + F.col("_mid") - F.col("_first") + F.lit(1)).cast("bigint")
    ).drop("_pid", "_mid", "_off", "_first")
