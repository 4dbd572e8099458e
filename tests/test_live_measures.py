"""Live cards, alerts, history and measures on hand-made rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from stratus.functions.columns import json_array
from stratus.operators import live as L
from stratus.operators import measures as M
from stratus.operators import star
from stratus.schema import LIVE

T0 = dt.datetime(2024, 1, 1, 12, 0)
T1 = dt.datetime(2024, 1, 1, 13, 0)


def readings(spark, rows):
    return spark.createDataFrame(rows, LIVE)


def r(city, t, temp, desc="clear", rain=0.0):
    return (city, temp, temp - 1, temp + 1, 50, 1000, desc, t, rain)


def test_latest_cards_sum_ties(spark):
    df = readings(spark, [r("a", T0, 1.0, "zzz"), r("b", T1, 6.0, "rain"), r("c", T1, 4.0, "cloud", 2.0)])
    c = L.latest_cards(df).first()
    assert c.card_temperature == 10.0 and c.card_rain == 2.0
    assert c.card_time == T1 and c.card_city == "a"
    assert c.card_description == "zzz"  # unfiltered text max, as the report card
    assert c.latest_description == "rain"


def test_latest_per_city_and_absolute_alert(spark):
    df = readings(spark, [r("a", T0, 9.0), r("a", T1, 3.0), r("b", T0, 7.0)])
    latest = {x.City: x.Temperature for x in L.latest_per_city(df).collect()}
    assert latest == {"a": 3.0, "b": 7.0}
    alerts = L.alert_records(L.absolute_alert(L.latest_per_city(df), 5.0)).collect()
    assert [a.City for a in alerts] == ["b"]
    assert json.loads(alerts[0].text)["Temperature"] == 7.0 and alerts[0].go == 1


def hist(spark, rows):
    return spark.createDataFrame(rows, "ClimateID string, Datetime date, MaxTempC double, TotalPrecipmm double")


def test_same_day_history_window_and_leap_day(spark):
    h = hist(
        spark,
        [
            ("1", dt.date(1991, 6, 15), 10.0, 0.0),  # inside (as_of year - 10)
            ("1", dt.date(1990, 6, 15), 99.0, 0.0),  # too old
            ("1", dt.date(2001, 6, 15), 20.0, 1.0),  # as_of year included
            ("1", dt.date(2000, 6, 14), 50.0, 0.0),  # other day
            ("1", dt.date(2000, 2, 29), 5.0, 0.0),
        ],
    )
    got = sorted(x.MaxTempC for x in L.same_day_history(h, "2001-06-15", 10).collect())
    assert got == [10.0, 20.0]
    assert L.same_day_history(h, "2004-02-29", 10).count() == 1
    assert L.same_day_history(h, "2003-02-28", 10).count() == 0


def test_history_json_sorted_and_empty(spark):
    h = hist(spark, [("1", dt.date(2001, 6, 15), 20.0, 1.0), ("1", dt.date(1995, 6, 15), 10.0, 0.0)])
    h = h.unionByName(h.limit(1))  # a duplicated row stays twice
    out = L.history_json(h, ["ClimateID", "Datetime", "MaxTempC"]).first()
    assert out.history_json.startswith('[{"ClimateID":"1","Datetime":"1995-06-15"')
    assert len(json.loads(out.history_json)) == 3 and out.n_rows == 3
    empty = L.history_json(h.filter(F.lit(False)), ["ClimateID", "Datetime"]).agg(F.count("*")).first()[0]
    assert empty == 0
    one = h.filter(F.lit(False)).agg(json_array(F.lit("x")).alias("j"))
    assert one.first().j == "[]"


def test_deviation_alert(spark):
    h = hist(spark, [("a", dt.date(2000, 1, 1), 10.0, 0.0), ("a", dt.date(1999, 1, 1), 12.0, 0.0)])
    cur = readings(spark, [r("a", T1, 20.0), r("b", T1, 30.0)])
    out = {x.City: x for x in L.deviation_alert(cur, h, 5.0, years=30).collect()}
    assert out["a"].normal == 11.0 and out["a"].deviation == 9.0
    assert out["b"].normal is None  # no history: reported, not dropped


def test_measures_text_and_axis(spark):
    h = hist(spark, [("1", dt.date(2000, 1, d), float(d), 0.0) for d in range(1, 6)])
    rs = M.real_series_with_axis(h, 1, "2000-01-02", "2000-01-04").collect()
    assert len(rs) == 3 and {x.axis_real for x in rs} == {4.0}
    t = spark.range(1).select(M.period_text(F.lit(1)).alias("a"), M.period_text(F.lit(3)).alias("b")).first()
    assert t.a == "This will cover period of : 1day" and t.b == "This will cover period of : 3days"
    sel = M.metric_param(spark)
    title = sel.agg(M.series_title(M.selected_value(F.col("Metric"))).alias("t")).first().t
    assert title == " Real and Forecast by date"
    one = sel.filter("id = 2").agg(M.series_title(M.selected_value(F.col("Metric"))).alias("t")).first().t
    assert one == "MinTempC Real and Forecast by date"
    icons = {x.id: x.i for x in sel.select("id", M.metric_icon(F.col("id")).alias("i")).collect()}
    assert icons == {1: "fire", 2: "ice", 3: "rain"}


def test_star_left_join_keeps_unknown_and_name_join_doubles(spark):
    facts = spark.createDataFrame([("1", "S1"), ("9", "S9")], "ClimateID string, Station string")
    dim = spark.createDataFrame(
        [("1", "S1", "BC"), ("2", "S1", "ON")], "ClimateID string, Name string, Province string"
    )
    j = star.join_dimension(facts, dim.drop("Name"), "ClimateID").collect()
    assert {(x.ClimateID, x.Province) for x in j} == {("1", "BC"), ("9", None)}
    assert star.join_by_name(facts.drop("ClimateID"), dim).count() == 2


def test_sort_by_aggregate_directions(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "v double")
    assert [r.v for r in L.sort_by_aggregate(df, "v", 2).collect()] == [3.0, 2.0, 1.0]
    assert [r.v for r in L.sort_by_aggregate(df, "v", 1).collect()] == [1.0, 2.0, 3.0]


def test_history_lines_keep_columns_and_make_json_on_read(spark):
    rows = [("a", dt.date(2001, 1, 2), 1.5, 0.0, "x"), ("a", dt.date(2001, 1, 2), 1.5, -0.0, "x"), ("a", dt.date(2001, 1, 2), 1.5, 0.0, "x"), ("a", dt.date(2001, 1, 2), None, float("nan"), None), ("a", dt.date(2001, 3, 4), 1.0, 1.0, "y"), (None, dt.date(2001, 1, 2), 2.0, 2.0, "z")]
    hist = spark.createDataFrame(rows, "ClimateID string, Datetime date, MaxTempC double, `odd. name` double, t string")
    lines = L.history_lines(hist)
    assert dict(lines.dtypes)["lines"].startswith("array<struct<line:struct<ClimateID:string,Datetime:date,MaxTempC:double")  # no JSON is shuffled or stored
    assert sorted(r.lines[0].n for r in lines.collect()) == [1, 1, 1, 1, 2]
    alerts = spark.createDataFrame([("a", dt.datetime(2003, 1, 2, 8))], "City string, ObservationTime timestamp_ntz")
    told = L.with_evidence(alerts, lines).first().history
    json = sorted(r.j for r in hist.filter("ClimateID = 'a' and month(Datetime) = 1").select(F.to_json(F.struct("*")).alias("j")).collect())
    assert told == "[" + ", ".join(json) + "]" and "-0.0" in told
    assert L.with_evidence(alerts, L.history_pages(hist)).first().history == told
