"""Schemas of the weather tables (layers raw -> staging -> warehouse)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D2 = T.DecimalType(18, 2)

# Column names of a daily climate CSV after sanitize_columns (fixed values).
OBSERVATION_COLUMNS = [
    "ClimateID",
    "DateTime",
    "Latitudey",
    "MaxTempC",
    "MinTempC",
    "MeanTempC",
    "TotalPrecipmm",
    "Longitudex",
]
MEASURE_COLUMNS = ["Latitudey", "MaxTempC", "MinTempC", "MeanTempC", "TotalPrecipmm", "Longitudex"]

RAW_OBSERVATION = T.StructType([T.StructField(c, S) for c in OBSERVATION_COLUMNS])

CLEAN_OBSERVATION = T.StructType(
    [
        T.StructField("ClimateID", S),
        T.StructField("Datetime", T.DateType()),
        T.StructField("Latitudey", D2),
        T.StructField("MaxTempC", D2),
        T.StructField("MinTempC", D2),
        T.StructField("MeanTempC", D2),
        T.StructField("TotalPrecipmm", D2),
        T.StructField("Longitudex", D2),
    ]
)

STATION_RAW = T.StructType(
    [T.StructField(c, S) for c in ["StationID", "ClimateID", "Name", "Province"]]
)

STATION = T.StructType([T.StructField(c, S) for c in ["ClimateID", "Name", "Province"]])

# Station catalogue of the API loader: all strings (fixed field order).
API_STATION = T.StructType(
    [
        T.StructField(c, S)
        for c in [
            "elevation",
            "mindate",
            "maxdate",
            "latitude",
            "name",
            "datacoverage",
            "id",
            "elevationUnit",
            "longitude",
        ]
    ]
)

CALENDAR = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
    ]
)

# Nested current-weather document as landed by the live poller.
LIVE_JSON = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("dt", T.LongType()),
        T.StructField(
            "main",
            T.StructType(
                [
                    T.StructField("temp", T.DoubleType()),
                    T.StructField("temp_min", T.DoubleType()),
                    T.StructField("temp_max", T.DoubleType()),
                    T.StructField("humidity", T.LongType()),
                    T.StructField("pressure", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "weather", T.ArrayType(T.StructType([T.StructField("description", S)]))
        ),
        T.StructField("rain", T.StructType([T.StructField("1h", T.DoubleType())])),
        T.StructField("observed_at", S),
    ]
)

LIVE = T.StructType(
    [
        T.StructField("City", S),
        T.StructField("Temperature", T.DoubleType()),
        T.StructField("TemperatureMin", T.DoubleType()),
        T.StructField("TemperatureMax", T.DoubleType()),
        T.StructField("Humidity", T.LongType()),
        T.StructField("Pressure", T.LongType()),
        T.StructField("Description", S),
        T.StructField("ObservationTime", T.TimestampNTZType()),
        T.StructField("Rain", T.DoubleType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("currentTemp", T.DecimalType(10, 2)),
        T.StructField("text", S),
        T.StructField("Datetime", T.TimestampType()),
    ]
)

METRIC_PARAM = T.StructType([T.StructField("id", T.LongType()), T.StructField("Metric", S)])
