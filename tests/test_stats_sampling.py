"""Statistics, sampling and set operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratus.functions.indexing import sequential_index
from stratus.operators import sampling as S
from stratus.operators import stats as ST


def test_describe_and_zero_profile(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,), (None,)], "p double")
    d = ST.describe(df, ["p"]).first()
    assert (d["count"], d["mean"], d["min"], d["max"]) == (3, 2.0, 0.0, 4.0)
    assert d["stddev"] == pytest.approx(2.0)
    z = ST.zero_profile(df, "p").first()
    assert (z.zero_count, z.nonzero_count, z.null_count) == (1, 2, 1)


def test_regression_quality(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "label double, prediction double")
    q = ST.regression_quality(df).first()
    assert q.rmse == pytest.approx((1 / 3) ** 0.5)
    assert q.mae == pytest.approx(1 / 3)
    assert q.r2 == pytest.approx(1 - (1 / 3) / (2 / 3))


def test_correlation_key_influencers_narrative(spark):
    df = spark.createDataFrame(
        [(float(i), 2.0 * i, "a" if i % 2 else "b", 1 if i % 2 else 0) for i in range(10)],
        "x double, y double, f string, t int",
    )
    c = ST.correlation_matrix(df, ["x", "y"]).first()
    assert c.corr == pytest.approx(1.0)
    ki = {(r.factor, r.value): r for r in ST.key_influencers(df, "t", ["f"]).collect()}
    assert ki[("f", "a")].lift == pytest.approx(2.0) and ki[("f", "a")].rank == 1
    series = spark.createDataFrame(
        [("g", dt.date(2000, 1, d), v) for d, v in [(1, 5.0), (2, 1.0), (3, 9.0), (4, 1.0), (5, 9.0)]],
        "g string, d date, v double",
    )
    n = ST.narrative_facts(series, ["g"], "d", "v").first()
    assert (n.first_value, n.last_value, n.min_value, n.max_value) == (5.0, 9.0, 1.0, 9.0)
    assert n.min_day == dt.date(2000, 1, 2) and n.max_day == dt.date(2000, 1, 3)


def test_balance_classes_hash_split_stable(spark):
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label")
    )
    b = S.balance_classes(df, "label", ["id"], 42)
    counts = {r.label: r["count"] for r in b.groupBy("label").count().collect()}
    assert counts[1] == 200 and 130 < counts[0] < 270
    a1 = S.hash_split(df, ["id"]).filter("split = 'train'").count()
    a2 = S.hash_split(df.repartition(7), ["id"]).filter("split = 'train'").count()
    assert a1 == a2 and 1500 < a1 < 1700


def test_balance_classes_with_repeated_rows_and_no_label(spark):
    """27,000 rows of one class share 5 keys; 3,000 rows of the other; some have no label."""
    df = spark.range(30_100).select(
        F.when(F.col("id") < 27_000, F.col("id") % 5).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 27_000, 0).when(F.col("id") < 30_000, 1).alias("label"),
    )
    counts = {r.label: r["count"] for r in S.balance_classes(df, "label", ["k"], 42).groupBy("label").count().collect()}
    assert counts[1] == 3000 and 2700 <= counts[0] <= 3300 and counts[None] == 100


def test_balance_classes_shuffles_no_class_into_one_task(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the rows were many
    try:
        out = S.balance_classes(df, "label", ["id"], 42)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert {r.label: r["count"] for r in out.groupBy("label").count().collect()}[1] == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_copies_are_made_in_pieces(spark):
    cut = S.pieces(spark.createDataFrame([("a", 5_000_000_000)], "row string, copies long"), "copies")
    found = cut.agg(F.sum("copies"), F.max("copies"), F.count("*")).first()
    assert tuple(found) == (5_000_000_000, S.PIECE, -(-5_000_000_000 // S.PIECE))
    big = spark.createDataFrame([("a", 30_000_000), ("b", 3), ("c", 0), ("c", None)], "row string, copies long")
    made = S.replicate(big, "copies").groupBy("row", F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made if r.row == "a") == 30_000_000 and sum(r["count"] for r in made if r.row == "b") == 3
    assert {r.row for r in made} == {"a", "b"} and len({r.task for r in made if r.row == "a"}) > 1
    assert max(r["count"] for r in made) < 20_000_000


def test_balance_classes_keeps_columns_of_any_name(spark):
    names = ["_n", "_label", "_rate", "_keep", "_i", "row", "n", "class", "class_n", "rate", "copies", "copy", "piece", "a.b"]
    df = spark.range(60).select((F.col("id") % 2).alias("label"), *[(F.col("id") * k).alias(c) for k, c in enumerate(names, 1)])
    out = S.balance_classes(df, "label", ["_n"], 42)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_half_split_subtract_union(spark):
    days = spark.createDataFrame([(dt.date(2000, 1, d),) for d in range(1, 11)], "d date")
    h = {r.half: r["count"] for r in S.half_split(days, "d").groupBy("half").count().collect()}
    assert h == {"first": 5, "second": 5}
    dup = spark.createDataFrame([(1,), (1,), (2,), (3,)], "v int")
    assert sorted(r.v for r in S.subtract_distinct(dup, dup.filter("v = 3")).collect()) == [1, 2]
    lab = spark.createDataFrame([(0,), (1,), (1,)], "label int")
    assert S.class_union(lab, "label").count() == 3
    m = S.concat_frames([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert m.columns == ["a", "b"] and m.count() == 2
    assert S.drop_incomplete(m, ["a"]).count() == 1


def test_sequential_index_matches_row_number(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7 % 101).alias("ts"), F.col("id").alias("k")
    ).repartition(5)
    out = sequential_index(df, ["g"], ["ts", "k"], "idx").collect()
    by_g = {}
    for r in out:
        by_g.setdefault(r.g, []).append((r.ts, r.k, r.idx))
    for rows in by_g.values():
        rows.sort()
        assert [x[2] for x in rows] == list(range(1, len(rows) + 1))


def test_size_for_input(spark):
    from stratus.session import size_for_input

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_for_input(spark, 100 << 40) == 409_600
        assert size_for_input(spark, 10 << 30) == 40
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(256 << 20)
        assert size_for_input(spark, 1 << 20) == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")


def test_profile_text_and_forecast_statistics_describe_all_columns(spark):
    import json

    from stratus.ml.models import forecast_statistics

    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("b", day, 1.0, 0.0), ("a", None, 2.0, 3.0), (None, day, None, 0.0)], "ClimateID string, date date, Rain_predicted double, p double")
    lines = ST.profile_text(ST.describe_all(df), df, "p").first()[0].split("\n")
    got = {r["column"]: r for r in map(json.loads, lines[:-1])}
    assert lines[-1] == " Count p = 0 : 2" and sorted(got) == sorted(df.columns)
    assert got["ClimateID"] == {"column": "ClimateID", "count": 2, "min_text": "a", "max_text": "b"} and got["date"] == {"column": "date", "count": 2}
    assert got["p"] == {"column": "p", "count": 3, "mean": 1.0, "stddev": 1.732051, "min": 0.0, "max": 3.0}
    stats = {r["column"]: r for r in forecast_statistics(df).collect()}
    assert sorted(stats) == sorted(df.columns)
    assert (stats["ClimateID"]["count"], stats["ClimateID"]["min_text"], stats["Rain_predicted"]["mean"], stats["p"]["max"]) == (1, "b", 1.0, 0.0)


def test_profile_query_holds_every_column(spark):
    import json

    from __spark_entry__ import queries
    from tests.conftest import SF_SMALL

    lines = queries()["precip_profile_text"](spark, SF_SMALL).first()[0].split("\n")
    described = {r["column"]: r for r in queries()["describe_all"](spark, SF_SMALL).collect()}
    got = {r["column"]: r for r in map(json.loads, lines[:-1])}
    assert got.keys() == described.keys() and "ClimateID" in got
    for c, r in described.items():
        want = {k: pytest.approx(v, abs=1e-4) if isinstance(v, float) else v for k, v in r.asDict().items() if v is not None}
        assert got[c] == want


def test_copies_are_drawn_once_and_told_apart_by_their_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 3, 2), ("c", S.PIECE + 5, 3), ("d", S.PIECE + 9, 0), ("e", S.PIECE + 9, S.PIECE + 2)], "row string, n long, copies long")
    made = {r["row"]: r["count"] for r in S.replicate(rows, "copies", "n").groupBy("row").count().collect()}
    assert made == {"b": 2, "c": 3, "e": S.PIECE + 2} and S.replicate(rows, "copies", "n").columns == ["row"]
    df = spark.range(600).select((F.col("id") % 200).alias("k"), F.when(F.col("id") % 200 < 150, 0).when(F.col("id") % 200 < 195, 1).alias("label"))
    drawn = {(r["row"]["k"], r["row"]["label"]): r["copies"] for r in S.class_draw(df, "label", ["k"]).collect() if r["copies"]}
    kept = {(r["k"], r["label"]): r["count"] for r in S.balance_classes(df, "label", ["k"]).groupBy("k", "label").count().collect()}
    assert kept == drawn and sum(n for (_, c), n in kept.items() if c is None) == 15
