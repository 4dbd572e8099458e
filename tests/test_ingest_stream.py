"""Sources and sinks on files written by the test; streaming equals batch."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from stratus.operators import live as L
from stratus.sources import ingest
from stratus.sources.tables import read_table
from stratus.streaming import live_stream as LS
from tests.conftest import SF_SMALL


def test_api_pages(spark, tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    (d / "p1.json").write_text(json.dumps({"results": [{"date": "2024-01-05T00:00:00", "value": 1.5},
                                                       {"date": "2023-12-31T00:00:00", "value": 2.0}]}))
    (d / "p2.json").write_text(json.dumps({"metadata": {"count": 0}}))
    df = ingest.load_api_pages(spark, str(d))
    got = sorted((r.years, r.months, r.value) for r in df.collect())
    assert got == [(2023, 12, 2.0), (2024, 1, 1.5)]


def test_daily_csv_sanitized_and_partitioned_roundtrip(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("Climate ID,Date/Time,Max Temp (°C)\n1018F,2001-06-15,20.5\n1018F,2001-06-16,\n")
    df = ingest.load_daily_csv(spark, str(csv))
    assert df.columns == ["ClimateID", "DateTime", "MaxTempC"]
    out = str(tmp_path / "landed")
    landed = df.withColumns({"Year": F.lit(2001), "Month": F.lit(6)})
    ingest.append_partitioned(landed, out, ["Year", "Month"])
    ingest.append_partitioned(landed.withColumn("Year", F.lit(2002)), out, ["Year", "Month"])
    back = ingest.load_partitioned(spark, out, years=(2001, 2001))
    assert back.count() == 2 and set(back.columns) >= {"Year", "Month", "MaxTempC"}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*Year", plan), plan


def test_station_catalogue_and_literal_rows(spark, tmp_path):
    p = tmp_path / "st.json"
    p.write_text(json.dumps({"id": "GHCND:1", "name": "X", "elevation": "12"}))
    st = ingest.load_station_catalogue(spark, str(p))
    assert st.schema.fieldNames()[0] == "elevation" and st.first().id == "GHCND:1"
    assert all(f.dataType.simpleString() == "string" for f in st.schema.fields)


def test_flatten_live_missing_rain_is_zero(spark, tmp_path):
    p = tmp_path / "live.json"
    docs = [
        {"name": "Paris", "main": {"temp": 7.5, "temp_min": 6.0, "temp_max": 9.0, "humidity": 80, "pressure": 1010},
         "weather": [{"description": "light rain"}, {"description": "mist"}], "rain": {"1h": 0.4},
         "observed_at": "2024-01-01 10:00:00"},
        {"name": "Lyon", "main": {"temp": 3.0, "temp_min": 2.0, "temp_max": 4.0, "humidity": 60, "pressure": 1020},
         "weather": [{"description": "clear"}], "observed_at": "2024-01-01 10:00:00"},
    ]
    p.write_text("\n".join(json.dumps(d) for d in docs))
    rows = {r.City: r for r in ingest.load_live_json(spark, str(p)).collect()}
    assert rows["Paris"].Rain == 0.4 and rows["Paris"].Description == "light rain"
    assert rows["Lyon"].Rain == 0.0


def test_sinks_overwrite_append_rewrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "2001-01-01")], "a int, d string")
    path, new = str(tmp_path / "t"), str(tmp_path / "t2")
    ingest.overwrite_path(df, path)
    ingest.append_files(df, path)
    assert spark.read.parquet(path).count() == 2
    out = ingest.rewrite_with_column(spark, path, new, lambda x: x.withColumn("e", F.col("d").cast("date")))
    assert "e" in out.columns and out.count() == 2


def test_stream_equals_batch_and_restart(spark, tmp_path):
    events = read_table(spark, SF_SMALL, "events")
    landing, table, ckpt = (str(tmp_path / k) for k in ("landing", "table", "ckpt"))
    LS.land_documents(LS.events_as_documents(events), landing, files=3)
    LS.ingest_stream(spark, landing, table, ckpt, files_per_trigger=1)
    from stratus.sources.views import live_readings

    batch = live_readings(events)
    streamed = spark.read.parquet(table)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0
    # restart on the same checkpoint: nothing is ingested twice
    LS.ingest_stream(spark, landing, table, ckpt)
    assert spark.read.parquet(table).count() == batch.count()
    # per-city state equals the batch operator
    state, sckpt = str(tmp_path / "state"), str(tmp_path / "sckpt")
    LS.latest_state_stream(spark, landing, state, sckpt, files_per_trigger=1)
    latest = LS.read_latest(spark, state)
    assert 1 <= len(LS.versions(spark, state)) <= 2
    expect = L.latest_per_city(batch)
    assert latest.exceptAll(expect.select(*latest.columns)).count() == 0
    assert latest.count() == expect.count()


def test_alert_stream_idempotent(spark, tmp_path):
    events = read_table(spark, SF_SMALL, "events")
    landing, out, ckpt = (str(tmp_path / k) for k in ("landing", "alerts", "ckpt"))
    LS.land_documents(LS.events_as_documents(events), landing, files=2)
    LS.alert_stream(spark, landing, out, ckpt, 5.0)
    first = spark.read.parquet(out).count()
    LS.alert_stream(spark, landing, out, ckpt, 5.0)
    assert spark.read.parquet(out).count() == first
    assert first == events.filter("value >= 5").count()
    assert os.path.isdir(out)


def test_managed_table_append_literal_and_sample(spark):
    rows = ingest.literal_rows(spark, [(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    name = "stratus_test_append"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    ingest.append_table(rows, name)
    ingest.append_table(rows, name)
    assert spark.table(name).count() == 6
    assert ingest.sample_rows(spark.table(name), 4).count() == 4
    spark.sql(f"DROP TABLE {name}")


def test_latest_state_survives_restart(spark, tmp_path):
    from stratus.sources.views import live_readings

    events = read_table(spark, SF_SMALL, "events")
    cut = events.selectExpr("percentile_approx(event_id, 0.5)").first()[0]
    landing, state, ckpt = (str(tmp_path / k) for k in ("landing", "state", "ckpt"))
    LS.land_documents(LS.events_as_documents(events.filter(F.col("event_id") <= cut)), landing, files=2)
    LS.latest_state_stream(spark, landing, state, ckpt)
    LS.land_documents(LS.events_as_documents(events.filter(F.col("event_id") > cut)), landing, files=2, mode="append")
    before = LS.read_latest(spark, state)
    n = before.count()
    os.makedirs(f"{state}/v=77")  # a version whose writer was killed before it committed
    assert LS.read_latest(spark, state).count() == n
    LS.latest_state_stream(spark, landing, state, ckpt)  # restart: state comes from the checkpoint
    assert before.count() == n  # a reader under way still has its version
    latest = LS.read_latest(spark, state)
    expect = L.latest_per_city(live_readings(events))
    assert latest.count() == expect.count()
    assert latest.exceptAll(expect.select(*latest.columns)).count() == 0


def test_deviation_alert_stream_equals_batch(spark, tmp_path):
    from stratus.sources.views import live_readings, observation_values

    events = read_table(spark, SF_SMALL, "events")
    hist = observation_values(read_table(spark, SF_SMALL, "lineitem"))
    landing, out, ckpt = (str(tmp_path / k) for k in ("landing", "alerts", "ckpt"))
    LS.land_documents(LS.events_as_documents(events), landing, files=3)
    LS.alert_stream(spark, landing, out, ckpt, 5.0, history=hist, years=30, files_per_trigger=1)
    streamed = LS.read_alerts(spark, out, deviation=True).drop("batch_id", "audit")
    batch = L.alert_records(
        L.deviation_alert(live_readings(events), hist, 5.0, years=30), extra=["normal", "deviation"]
    )
    assert batch.filter("normal is not null").count() > 0
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_api_pages_are_bounded(spark, tmp_path):
    rows = spark.range(2500).select(
        F.col("id").alias("k"), F.lit("2024-01-01T00:00:00").alias("date"), F.col("id").cast("double").alias("value")
    )
    path = str(tmp_path / "pages")
    ingest.land_api_pages(rows, path, "k", 1000)
    pages = spark.read.json(path)
    sizes = [r.n for r in pages.select(F.size("results").alias("n")).collect()]
    assert sorted(sizes) == [500, 1000, 1000]
    assert ingest.load_api_pages(spark, path, multi_line=False).count() == 2500


def test_hot_partition_folder_is_spread(spark, tmp_path):
    """A folder larger than the advisory size is written by several tasks."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        df = spark.range(0, 200000, 1, 6).select(F.lit(2001).alias("Year"), F.col("id"))  # one hot folder
        out = str(tmp_path / "hot")
        ingest.append_partitioned(df, out, ["Year"])
    finally:
        spark.conf.set(key, old)
    files = [f for f in os.listdir(os.path.join(out, "Year=2001")) if f.endswith(".parquet")]
    assert len(files) > 2
    assert spark.read.parquet(out).count() == 200000


def test_csv_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Climate ID,Max Temp (°C),Min Temp (°C)\n1,10,"a, b"\n')
    (tmp_path / "b c.csv").write_text("Min Temp (°C),Max Temp (°C),Climate ID,Extra\n-5,20,2,e\n")
    (tmp_path / "d.csv").write_text("Climate ID,Max Temp (°C),Min Temp (°C)\n3,30,\n")
    got = {r.ClimateID: r for r in ingest.load_daily_csv(spark, str(tmp_path)).collect()}
    assert (got["1"].MaxTempC, got["1"].MinTempC, got["1"].Extra) == ("10", "a, b", None)
    assert (got["2"].MaxTempC, got["2"].MinTempC, got["2"].Extra) == ("20", "-5", "e")
    assert (got["3"].MaxTempC, got["3"].MinTempC) == ("30", "")


def test_live_time_from_epoch_seconds_and_bad_text(spark, tmp_path):
    docs = [{"name": "A", "dt": 1704103200}, {"name": "B", "observed_at": "no time", "dt": 1704103200}, {"name": "C", "observed_at": "no time"}, {"name": "D", "observed_at": "2024-01-01 10:00:00.5"}]
    (tmp_path / "l.json").write_text("\n".join(json.dumps(d) for d in docs))
    got = {r.City: str(r.ObservationTime) for r in ingest.load_live_json(spark, str(tmp_path / "l.json")).collect()}
    assert got == {"A": "2024-01-01 10:00:00", "B": "2024-01-01 10:00:00", "C": "None", "D": "2024-01-01 10:00:00.500000"}


def test_alerts_can_be_read_when_there_are_none(spark, tmp_path):
    events = read_table(spark, SF_SMALL, "events")
    landing, out, ckpt = (str(tmp_path / k) for k in ("landing", "alerts", "ckpt"))
    LS.land_documents(LS.events_as_documents(events), landing)
    LS.alert_stream(spark, landing, out, ckpt, 1e9)
    assert LS.read_alerts(spark, out).count() == 0
    assert LS.read_alerts(spark, str(tmp_path / "nothing"), deviation=True).count() == 0


def test_deviation_uses_the_reading_s_own_day(spark):
    import datetime as dt

    hist = spark.createDataFrame([("S", dt.date(2020, 1, 10), -30.0), ("S", dt.date(2021, 1, 10), -28.0), ("S", dt.date(2020, 6, 15), 25.0), ("S", dt.date(2005, 1, 10), 99.0)], "ClimateID string, Datetime date, MaxTempC double")
    rows = [("S", dt.datetime(2023, 1, 10, 8), -29.0), ("S", dt.datetime(2023, 6, 15, 8), 10.0), ("T", dt.datetime(2023, 1, 10), 0.0)]
    current = spark.createDataFrame(rows, "City string, ObservationTime timestamp_ntz, Temperature double")
    got = {(r.City, r.ObservationTime.month): (r.normal, r.deviation) for r in L.deviation_alert(current, hist, 5.0).collect()}
    assert got == {("S", 6): (25.0, -15.0), ("T", 1): (None, None)}


def test_evidence_holds_every_history_row_with_all_columns(spark, tmp_path):
    from stratus.sources.views import live_readings, observation_values

    events = read_table(spark, SF_SMALL, "events")
    hist = observation_values(read_table(spark, SF_SMALL, "lineitem"))
    hist = hist.unionByName(hist.limit(500)).unionByName(hist.limit(500).withColumn("MaxTempC", F.lit(None).cast("double")))  # days of several rows, some equal, some without value
    landing, out, ckpt = (str(tmp_path / k) for k in ("landing", "alerts", "ckpt"))
    LS.land_documents(LS.events_as_documents(events), landing, files=2)
    LS.alert_stream(spark, landing, out, ckpt, 5.0, history=hist, years=30, files_per_trigger=1)
    by_day = {}
    for r in hist.collect():
        row = {k: str(v) if k == "Datetime" else v for k, v in r.asDict().items() if v is not None}
        by_day.setdefault((r.ClimateID, r.Datetime.month, r.Datetime.day), []).append((r.Datetime, row))
    key = lambda row: json.dumps(row, sort_keys=True)
    alerts, several = LS.read_alerts(spark, out, deviation=True).collect(), 0
    for a in alerts:
        on = a.ObservationTime.date()
        met = [(d, r) for d, r in by_day.get((a.City, on.month, on.day), []) if d <= on and d.year >= on.year - 30]
        got = json.loads(a.text)["history"]
        assert sorted(map(key, got)) == sorted(key(r) for _, r in met)
        assert [r["Datetime"] for r in got] == sorted(r["Datetime"] for r in got)
        several += len(met) > len({d for d, _ in met})
    assert len(alerts) == L.deviation_alert(live_readings(events), hist, 5.0, years=30).count() and several > 0


def test_hot_station_day_spreads_over_pages_and_tasks(spark):
    hot = spark.range(60_000).select(F.lit("S").alias("ClimateID"), F.lit("2020-01-10").cast("date").alias("Datetime"), F.col("id").cast("double").alias("MaxTempC"))
    same = spark.range(50_000).select(F.lit("S").alias("ClimateID"), F.lit("2020-01-10").cast("date").alias("Datetime"), F.lit(-1.0).alias("MaxTempC"))
    hist = hot.unionByName(same).unionByName(hot.limit(1).withColumn("ClimateID", F.lit(None).cast("string")))
    pages = L.history_pages(hist, page_rows=1000)
    assert "page" in pages.columns
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = pages.withColumns({"task": F.spark_partition_id(), "size": F.size("lines")}).filter("ClimateID = 'S'").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) == 61 and max(r["size"] for r in found) < 1300 and len({r.task for r in found}) > 1
    assert sum(x["n"] for r in found for x in r["lines"]) == 110_000
    import datetime as dt

    alerts = spark.createDataFrame([("S", dt.datetime(2023, 1, 10, 8)), ("S", dt.datetime(2023, 1, 11, 8))], "City string, ObservationTime timestamp_ntz")
    told = {r.ObservationTime.day: r.history for r in L.with_evidence(alerts, pages).collect()}
    lines = sorted(r.j for r in hist.filter("ClimateID = 'S'").select(F.to_json(F.struct("*")).alias("j")).collect())
    assert told == {10: "[" + ", ".join(lines) + "]", 11: None}


def test_micro_batches_do_not_shuffle_the_history(spark, tmp_path):
    from stratus.sources.views import live_readings, observation_values

    hist = observation_values(read_table(spark, SF_SMALL, "lineitem"))
    name = LS.bucketed_days(spark, hist, str(tmp_path / "days"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        readings = live_readings(read_table(spark, SF_SMALL, "events"))
        met = L.same_days(L.asked_days(readings), spark.table(name), 30)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Bucketed: true") == 1
        history_side = plan[plan.index("Bucketed: true") - 600 : plan.index("Bucketed: true")]
        assert "Exchange" not in history_side.split("SortMergeJoin")[-1].split("+- *(")[-1]
        assert plan.count("Exchange") == 2  # the distinct readings and their move to the buckets
        want = L.reading_normals(readings, L.station_days(hist), 30)
        got = L.reading_normals(readings, spark.table(name), 30)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_header_discovery_reads_a_buffer_of_each_file(spark, tmp_path):
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "w") as f:
            f.write(f"Climate ID,h{k % 2}\n")
            f.writelines(f"{i},{'x' * 300}\n" for i in range(9000))
    (tmp_path / "one.csv").write_text("Climate ID,h0\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = {r.file.rsplit("/", 1)[-1]: r.header for r in ingest.first_lines(spark, [str(tmp_path)]).collect()}
        rows = ingest.load_daily_csv(spark, str(tmp_path))
        assert rows.count() == 27_000 and set(rows.columns) == {"ClimateID", "h0", "h1"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {"0.csv": "Climate ID,h0", "1.csv": "Climate ID,h1", "2.csv": "Climate ID,h0", "one.csv": "Climate ID,h0"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1"


def test_named_table_is_rewritten_in_one_step(spark, tmp_path):
    name = "stratus_test_named"
    ingest.publish_table(spark.range(5).withColumn("d", F.lit("2020-01-02")), name, str(tmp_path))
    reader = spark.table(name)
    with pytest.raises(Exception, match="no such day"):
        ingest.rewrite_table(spark, name, lambda x: x.withColumn("e", F.raise_error(F.lit("no such day"))), str(tmp_path))
    assert spark.table(name).columns == ["id", "d"] and spark.table(name).count() == 5
    for k in range(3):
        out = ingest.rewrite_table(spark, name, lambda x, k=k: x.withColumn(f"e{k}", F.col("d").cast("date")), str(tmp_path))
        assert out.columns[-1] == f"e{k}" and out.count() == 5
        assert k or reader.count() == 5  # a reader under way still has the table before
    assert sum(t.name.startswith(f"{name}__") for t in spark.catalog.listTables()) == 2
    spark.sql(f"DROP VIEW {name}")


def test_folders_are_pruned_by_the_dimension(spark, tmp_path):
    from __spark_entry__ import queries

    plan = queries()["csv_partition_season"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
