"""The driver's tables seen as weather data.

The mapping is ours (the test tables are TPC-H shaped); each view is a pure
projection of a scan, so it adds no shuffle and its filters and column
pruning reach the parquet reader.

Fixed mapping:
    station id      l_suppkey / s_suppkey (as string)
    day             l_shipdate (as date)
    max temperature l_quantity
    min temperature l_quantity - 100 * l_discount
    mean            l_quantity - 50 * l_discount
    precipitation   100 * l_discount
    latitude        40 + 100 * l_tax
    longitude       -floor(l_extendedprice / 1000)
    live city       events.user_id, time ts, temperature value,
                    humidity props $.k, description event_type
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _num(c: Column) -> Column:
    return F.round(c, 2)


def observation_values(lineitem: DataFrame) -> DataFrame:
    """Typed daily observations (doubles) straight from ``lineitem``."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    return lineitem.select(
        F.col("l_suppkey").cast("string").alias("ClimateID"),
        F.col("l_shipdate").cast("date").alias("Datetime"),
        _num(F.lit(40.0) + F.lit(100.0) * F.col("l_tax")).alias("Latitudey"),
        q.alias("MaxTempC"),
        _num(q - F.lit(100.0) * d).alias("MinTempC"),
        _num(q - F.lit(50.0) * d).alias("MeanTempC"),
        _num(F.lit(100.0) * d).alias("TotalPrecipmm"),
        (-F.floor(F.col("l_extendedprice") / F.lit(1000.0))).cast("double").alias("Longitudex"),
    )


def raw_observations(lineitem: DataFrame) -> DataFrame:
    """Landed CSV shape: every column a string, with planted defects.

    Line number 1 -> blank max temperature (dropped by cleaning),
    2 -> a lone space as min temperature (kept, casts to NULL),
    3 -> a space as precipitation (defaults to 0.0),
    4 -> NULL precipitation (stays NULL).
    """
    q, d, ln = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")

    def s(c: Column) -> Column:
        return c.cast("string")

    return lineitem.select(
        s(F.col("l_suppkey")).alias("ClimateID"),
        F.col("l_shipdate").cast("date").cast("string").alias("DateTime"),
        s(_num(F.lit(40.0) + F.lit(100.0) * F.col("l_tax"))).alias("Latitudey"),
        F.when(ln == 1, F.lit("")).otherwise(s(q)).alias("MaxTempC"),
        F.when(ln == 2, F.lit(" ")).otherwise(s(_num(q - F.lit(100.0) * d))).alias("MinTempC"),
        s(_num(q - F.lit(50.0) * d)).alias("MeanTempC"),
        F.when(ln == 3, F.lit(" "))
        .when(ln == 4, F.lit(None).cast("string"))
        .otherwise(s(_num(F.lit(100.0) * d)))
        .alias("TotalPrecipmm"),
        s((-F.floor(F.col("l_extendedprice") / F.lit(1000.0))).cast("double")).alias("Longitudex"),
    )


def station_raw(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Station list (StationID, ClimateID, Name, Province), all strings."""
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"], "left").select(
        F.col("s_suppkey").cast("string").alias("StationID"),
        F.col("s_suppkey").cast("string").alias("ClimateID"),
        F.col("s_name").alias("Name"),
        F.col("n_name").alias("Province"),
    )


def live_readings(events: DataFrame) -> DataFrame:
    """Flattened live readings from ``events``."""
    return events.select(
        F.col("user_id").cast("string").alias("City"),
        F.col("value").alias("Temperature"),
        F.round(F.col("value") - F.lit(1.0), 2).alias("TemperatureMin"),
        F.round(F.col("value") + F.lit(1.0), 2).alias("TemperatureMax"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("Humidity"),
        F.col("event_id").alias("Pressure"),
        F.col("event_type").alias("Description"),
        F.col("ts").alias("ObservationTime"),
        F.when(F.col("event_type") == "error", F.lit(1.0)).otherwise(F.lit(0.0)).alias("Rain"),
    )


def forecast_rows(orders: DataFrame) -> DataFrame:
    """A forecast table shaped like the model's output, one row per order
    moved a year ahead (so part of it lies after the last real day)."""
    price = F.floor(F.col("o_totalprice") / F.lit(1000.0)) / F.lit(10.0)
    ck = F.col("o_custkey")
    return orders.select(
        F.date_add(F.col("o_orderdate").cast("date"), 365).alias("date"),
        F.when(F.pmod(ck, F.lit(7)) > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("Rain_predicted"),
        price.alias("MaxTempC_predicted"),
        (price - F.lit(10.0)).alias("MinTempC_predicted"),
        F.pmod(ck, F.lit(7)).cast("double").alias("TotalPrecipmm_predicted"),
        (F.pmod(F.col("o_orderkey"), F.lit(13)).cast("double") / F.lit(4.0)).alias("PrecipitationM2_predicted"),
    )


def daily_series(orders: DataFrame) -> DataFrame:
    """Daily series (ds, y): mean order total per order day."""
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("ds")).agg(
        F.avg("o_totalprice").alias("y")
    )


def run_metrics(orders: DataFrame) -> DataFrame:
    """Training-run metrics in long form (run_id, target, metric, value, ts),
    one run per order; runs of priority 5-LOW have no R2 (incomplete)."""
    target = (
        F.when(F.col("o_orderstatus") == "F", F.lit("MaxTempC"))
        .when(F.col("o_orderstatus") == "O", F.lit("MinTempC"))
        .otherwise(F.lit("TotalPrecipmm"))
    )
    wide = orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        target.alias("target"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / F.lit(10000.0)).alias("RMSE"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
        .otherwise(F.lit(1.0) - F.pmod(F.col("o_custkey"), F.lit(100)).cast("double") / F.lit(100.0))
        .alias("R2"),
        (F.col("o_totalprice") / F.lit(20000.0)).alias("MAE"),
    )
    return wide.unpivot(["run_id", "target", "ts"], ["RMSE", "R2", "MAE"], "metric", "value")


def external_station_rows(lineitem: DataFrame) -> DataFrame:
    """External CSV rows keyed by station *name* (Station, Date, TotalPrecip)."""
    return lineitem.select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("Station"),
        F.col("l_shipdate").cast("date").alias("Date"),
        _num(F.lit(100.0) * F.col("l_discount")).alias("TotalPrecip"),
    )


# Header texts of the external daily CSV, the used ones at their places (fixed values).
CSV_HEADERS = [f"Column {i}" for i in range(26)]
for _place, _text in {2: "Station Name", 4: "Date", 9: "Max Temp (°C)", 11: "Min Temp (°C)", 15: "Heat Deg Days (°C)", 23: "Total Precip (mm)"}.items():
    CSV_HEADERS[_place] = _text


def headerless_csv_rows(part: DataFrame) -> DataFrame:
    """Rows of a header-polluted 26-column external CSV (positional ``_c0``..``_c25``).

    Parts of size 1 stand for repeated header lines (each column holds its
    header text); brand ``Brand#11`` rows carry ``M`` (missing) precipitation.
    """
    is_header = F.col("p_size") == 1
    used = {
        2: F.col("p_brand"),
        4: F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_partkey").cast("int")).cast("string"),
        9: F.col("p_size").cast("string"),
        11: (F.col("p_size") - F.lit(10)).cast("string"),
        15: F.floor(F.col("p_retailprice") / F.lit(100.0)).cast("string"),
        23: F.when(F.col("p_brand") == "Brand#11", F.lit("M")).otherwise((F.pmod(F.col("p_partkey"), F.lit(40)).cast("double") / F.lit(4.0)).cast("string")),
    }
    return part.select(
        *[F.when(is_header, F.lit(h)).otherwise(used.get(i, F.lit(str(i)))).alias(f"_c{i}") for i, h in enumerate(CSV_HEADERS)]
    )
