"""Plan shape of every registered query: no cartesian or
nested-loop joins, no row-at-a-time Python, pruned scans, partial aggregation."""

import re

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF_SMALL

FILE_QUERIES = {"stream_ingest", "stream_latest_city", "stream_alerts", "csv_ingest", "api_pages",
                "stream_deviation_alerts", "staging_table"}
PLANNED = [k for k in oracle_sql() if k not in FILE_QUERIES]


def plan_of(df) -> str:
    """The final adaptive plan: run the DataFrame's own query execution first."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_no_python(spark, name):
    p = plan_of(queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python UDF


def test_scans_are_pruned(spark):
    p = plan_of(queries()["monthly_summary"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p) or re.findall(r"struct<([^>]*)>", p)
    lineitem = [s for s in schemas if "l_quantity" in s]
    assert lineitem and all("l_returnflag" not in s and "l_partkey" not in s for s in lineitem)


def test_partial_aggregation_before_shuffle(spark):
    p = plan_of(queries()["monthly_summary"](spark, SF_SMALL))
    assert "partial_sum" in p and "partial_count" in p
    assert "BroadcastHashJoin" in p  # the small station side is broadcast after its runtime size check


def test_hot_station_is_pre_aggregated(spark):
    """One station with a third of all rows: the join after the pre-aggregate
    sees one row per (station, month), whatever the skew."""
    from pyspark.sql import functions as F

    from stratus.operators.star import monthly_summary
    from stratus.plans import inputs as I

    obs = I.clean_obs(spark, SF_SMALL)
    hot = obs.withColumn(
        "ClimateID", F.when(F.pmod(F.xxhash64("Datetime", "MaxTempC"), F.lit(3)) == 0, F.lit("1")).otherwise(
            F.col("ClimateID"))
    )
    out = monthly_summary(hot, I.stations(spark, SF_SMALL))
    total = out.agg(F.sum("n_obs")).first()[0]
    assert total == obs.count()


def test_hot_station_row_join_is_split_when_not_broadcast(spark):
    """The row-level star join (no pre-aggregation possible) with a station
    holding a third of the rows and a dimension too big to broadcast: AQE's
    skew join splits the hot partition.  Several input splits are simulated
    with a round-robin repartition (the test file has one row group)."""
    from pyspark.sql import functions as F

    from stratus.operators.star import join_dimension
    from stratus.plans import inputs as I

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        obs = I.obs_values(spark, SF_SMALL).repartition(4)
        hot = obs.withColumn(
            "ClimateID",
            F.when(F.pmod(F.xxhash64("Datetime", "MaxTempC", "Longitudex"), F.lit(3)) == 0, F.lit("7"))
            .otherwise(F.col("ClimateID")),
        )
        joined = join_dimension(hot, I.stations(spark, SF_SMALL), "ClimateID")
        p = plan_of(joined)
        assert "SortMergeJoin(skew=true)" in p
        assert joined.count() == obs.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
