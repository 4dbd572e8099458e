"""Cleaning operators on hand-made rows (edge cases of FIXTURES §2)."""

from decimal import Decimal

import pytest

from stratus.operators import clean
from stratus.schema import RAW_OBSERVATION


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_OBSERVATION)


def row(cid="1", day="2001-06-15", tmax="20.0", tmin="10.0", precip="1.5"):
    return (cid, day, "48.0", tmax, tmin, "15.0", precip, "-123.0")


def test_blank_and_null_max_dropped_space_kept(spark):
    df = raw(spark, [row(tmax=""), row(tmax=None), row(cid="2", tmax=" "), row(cid="3")])
    out = clean.clean_observations(df).orderBy("ClimateID").collect()
    assert [r.ClimateID for r in out] == ["2", "3"]
    assert out[0].MaxTempC is None  # a lone space casts to NULL
    assert out[1].MaxTempC == Decimal("20.00")


def test_blank_precip_defaults_null_stays(spark):
    df = raw(spark, [row(cid="1", precip=" "), row(cid="2", precip=None), row(cid="3", precip="")])
    out = {r.ClimateID: r.TotalPrecipmm for r in clean.clean_observations(df).collect()}
    assert out == {"1": Decimal("0.00"), "2": None, "3": Decimal("0.00")}


def test_duplicates_collapse_and_rounding(spark):
    df = raw(spark, [row(tmax="1.005"), row(tmax="1.005"), row(cid="9", tmax="-0.125")])
    out = {r.ClimateID: r.MaxTempC for r in clean.clean_observations(df).collect()}
    assert out == {"1": Decimal("1.01"), "9": Decimal("-0.13")}


def test_bad_date_and_alphanumeric_id(spark):
    df = raw(spark, [row(cid="1018F", day="x")])
    r = clean.clean_observations(df).first()
    assert r.ClimateID == "1018F" and r.Datetime is None


def test_sanitize_columns_and_collision(spark):
    df = spark.createDataFrame([(1, 2)], ["Max Temp (°C)", "Date/Time"])
    assert clean.sanitize_columns(df).columns == ["MaxTempC", "DateTime"]
    bad = spark.createDataFrame([(1, 2)], ["A b", "A-b"])
    with pytest.raises(ValueError):
        clean.sanitize_columns(bad)


def test_blank_profile_counts_null_nan_blank(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("", float("nan")), (" ", None), (None, 2.0)], "s string, x double"
    )
    r = clean.blank_profile(df).first()
    assert (r.s, r.x) == (3, 2)


def test_header_rows_removed_nulls_kept(spark):
    df = spark.createDataFrame([("Date", "x"), ("2001-01-01", "1.5"), (None, "M")], "_c0 string, _c1 string")
    out = clean.drop_header_rows(df, {"_c0": "Date"})
    assert out.count() == 2
    typed = clean.retype(out, {"_c1": "double"}).collect()
    assert sorted([r._c1 for r in typed], key=lambda v: (v is None, v)) == [1.5, None]


def test_station_dimension_filters(spark):
    st = spark.createDataFrame(
        [("1", "A", "BC"), (None, "B", "BC"), ("3", "C", "ON")], "ClimateID string, Name string, Province string"
    )
    assert clean.station_dimension(st).count() == 2
    assert [r.Name for r in clean.station_dimension(st, "BC").collect()] == ["A"]
