"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on the driver tables registered as views.  Shared views
are spelled once below and prepended as ``WITH`` clauses.  ``+ 0.0`` after
``round`` turns a negative zero into zero, as Spark's decimal rounding does.
"""

from __future__ import annotations

RAW_OBS = """
raw_obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ClimateID,
         strftime(l_shipdate, '%Y-%m-%d') AS DateTime,
         CAST(round(40.0 + 100.0 * l_tax, 2) + 0.0 AS VARCHAR) AS Latitudey,
         CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS MaxTempC,
         CASE WHEN l_linenumber = 2 THEN ' '
              ELSE CAST(round(l_quantity - 100.0 * l_discount, 2) + 0.0 AS VARCHAR) END AS MinTempC,
         CAST(round(l_quantity - 50.0 * l_discount, 2) + 0.0 AS VARCHAR) AS MeanTempC,
         CASE WHEN l_linenumber = 3 THEN ' ' WHEN l_linenumber = 4 THEN NULL
              ELSE CAST(round(100.0 * l_discount, 2) + 0.0 AS VARCHAR) END AS TotalPrecipmm,
         CAST(CAST(-CAST(floor(l_extendedprice / 1000.0) AS BIGINT) AS DOUBLE) AS VARCHAR) AS Longitudex
  FROM lineitem
)"""

CLEAN_OBS = (
    RAW_OBS
    + """,
clean_obs AS (
  SELECT ClimateID,
         TRY_CAST(TRY_STRPTIME(DateTime, '%Y-%m-%d') AS DATE) AS Datetime,
         TRY_CAST(Latitudey AS DECIMAL(18,2)) AS Latitudey,
         TRY_CAST(MaxTempC AS DECIMAL(18,2)) AS MaxTempC,
         TRY_CAST(MinTempC AS DECIMAL(18,2)) AS MinTempC,
         TRY_CAST(MeanTempC AS DECIMAL(18,2)) AS MeanTempC,
         TRY_CAST(CASE WHEN trim(TotalPrecipmm) = '' THEN '0.0' ELSE TotalPrecipmm END
                  AS DECIMAL(18,2)) AS TotalPrecipmm,
         TRY_CAST(Longitudex AS DECIMAL(18,2)) AS Longitudex
  FROM (SELECT DISTINCT * FROM raw_obs) d
  WHERE MaxTempC <> '' AND MinTempC <> ''
)"""
)

STATIONS = """
stations AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS ClimateID, s_name AS Name, n_name AS Province
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  WHERE s_suppkey IS NOT NULL
)"""

OBS_VALUES = """
obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ClimateID,
         CAST(l_shipdate AS DATE) AS Datetime,
         round(40.0 + 100.0 * l_tax, 2) + 0.0 AS Latitudey,
         l_quantity AS MaxTempC,
         round(l_quantity - 100.0 * l_discount, 2) + 0.0 AS MinTempC,
         round(l_quantity - 50.0 * l_discount, 2) + 0.0 AS MeanTempC,
         round(100.0 * l_discount, 2) + 0.0 AS TotalPrecipmm,
         CAST(-CAST(floor(l_extendedprice / 1000.0) AS BIGINT) AS DOUBLE) AS Longitudex
  FROM lineitem
)"""

LIVE = """
live AS (
  SELECT CAST(user_id AS VARCHAR) AS City,
         value AS Temperature,
         round(value - 1.0, 2) AS TemperatureMin,
         round(value + 1.0, 2) AS TemperatureMax,
         TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS Humidity,
         event_id AS Pressure,
         event_type AS Description,
         ts AS ObservationTime,
         CAST(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS Rain
  FROM events
)"""


def with_(*views: str) -> str:
    return "WITH " + ",".join(v.strip("\n") for v in views) + "\n"


def dbl(expr: str, digits: int = 6) -> str:
    return f"CAST(round(CAST({expr} AS DOUBLE), {digits}) AS DOUBLE)"


ORACLE: dict[str, str] = {}

ORACLE["monthly_summary"] = with_(CLEAN_OBS, STATIONS) + f"""
SELECT s.Province,
       CAST(year(c.Datetime) AS INTEGER) AS year,
       CAST(month(c.Datetime) AS INTEGER) AS month,
       {dbl('avg(c.MaxTempC)')} AS avg_max_temp,
       {dbl('avg(c.MinTempC)')} AS avg_min_temp,
       {dbl('sum(c.TotalPrecipmm)')} AS total_precip,
       CAST(sum(CASE WHEN c.TotalPrecipmm > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rainy_station_days,
       CAST(count(*) AS BIGINT) AS n_obs
FROM clean_obs c LEFT JOIN stations s ON c.ClimateID = s.ClimateID
GROUP BY s.Province, year(c.Datetime), month(c.Datetime)
"""

ORACLE["clean_observations"] = with_(CLEAN_OBS) + """
SELECT ClimateID, Datetime,
       CAST(Latitudey AS DOUBLE) AS Latitudey, CAST(MaxTempC AS DOUBLE) AS MaxTempC,
       CAST(MinTempC AS DOUBLE) AS MinTempC, CAST(MeanTempC AS DOUBLE) AS MeanTempC,
       CAST(TotalPrecipmm AS DOUBLE) AS TotalPrecipmm, CAST(Longitudex AS DOUBLE) AS Longitudex,
       CAST(Datetime AS VARCHAR) AS DatetimeStrg
FROM clean_obs
"""

ORACLE["blank_profile"] = with_(RAW_OBS) + """
SELECT """ + ",\n       ".join(
    f"CAST(count_if({c} IS NULL OR trim({c}) = '') AS BIGINT) AS {c}"
    for c in [
        "ClimateID", "DateTime", "Latitudey", "MaxTempC", "MinTempC",
        "MeanTempC", "TotalPrecipmm", "Longitudex",
    ]
) + "\nFROM raw_obs\n"

ORACLE["station_dim"] = with_(STATIONS) + """
SELECT ClimateID, Name, Province FROM stations
"""

# ------------------------------------------------------------------ shared
FORECAST = """
fc AS (
  SELECT CAST(o_orderdate AS DATE) + 365 AS date,
         CAST(CASE WHEN o_custkey % 7 > 0 THEN 1 ELSE 0 END AS DOUBLE) AS Rain_predicted,
         floor(o_totalprice / 1000.0) / 10.0 AS MaxTempC_predicted,
         floor(o_totalprice / 1000.0) / 10.0 - 10.0 AS MinTempC_predicted,
         CAST(o_custkey % 7 AS DOUBLE) AS TotalPrecipmm_predicted,
         CAST(o_orderkey % 13 AS DOUBLE) / 4.0 AS PrecipitationM2_predicted
  FROM orders
)"""

SERIES = """
series AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, avg(o_totalprice) AS y FROM orders GROUP BY 1
)"""

LATEST_PER_CITY = """
latest AS (
  SELECT City, ObservationTime, Temperature, TemperatureMin, TemperatureMax, Humidity,
         Pressure, Description, Rain
  FROM (SELECT *, row_number() OVER (
          PARTITION BY City
          ORDER BY ObservationTime DESC, Temperature DESC, TemperatureMin DESC,
                   TemperatureMax DESC, Humidity DESC, Pressure DESC, Description DESC,
                   Rain DESC) AS rn
        FROM live) t
  WHERE rn = 1
)"""

AS_OF_DAY = (
    "Datetime >= DATE '1991-01-01' AND Datetime < DATE '2002-01-01' "
    "AND month(Datetime) = 6 AND day(Datetime) = 15"
)
UNIX_DAY = "date_diff('day', DATE '1970-01-01', {})"


def season_sql(d: str) -> str:
    return (
        f"CASE WHEN month({d}) IN (12, 1, 2) THEN 'Winter' WHEN month({d}) IN (3, 4, 5) THEN 'Spring' "
        f"WHEN month({d}) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"
    )


# ------------------------------------------------------------ live / history
ORACLE["latest_cards"] = with_(LIVE) + """
SELECT """ + ",\n       ".join(
    [
        f"{dbl(f'sum(CASE WHEN ObservationTime = (SELECT max(ObservationTime) FROM live) THEN {c} END)')} AS card_{c.lower()}"
        for c in ["Temperature", "Rain", "TemperatureMin", "TemperatureMax"]
    ]
    + [
        f"CAST(sum(CASE WHEN ObservationTime = (SELECT max(ObservationTime) FROM live) THEN {c} END) AS BIGINT) AS card_{c.lower()}"
        for c in ["Humidity", "Pressure"]
    ]
) + """,
       min(CASE WHEN ObservationTime = (SELECT max(ObservationTime) FROM live) THEN ObservationTime END) AS card_time,
       min(City) AS card_city,
       max(Description) AS card_description,
       max(CASE WHEN ObservationTime = (SELECT max(ObservationTime) FROM live) THEN Description END) AS latest_description
FROM live
"""

ORACLE["latest_per_city"] = with_(LIVE, LATEST_PER_CITY) + "SELECT * FROM latest\n"

ORACLE["temperature_alert"] = with_(LIVE, LATEST_PER_CITY) + """
SELECT City, ObservationTime,
       CAST(CAST(Temperature AS DECIMAL(10,2)) AS DOUBLE) AS currentTemp,
       CAST(to_json(struct_pack(ObservationTime := regexp_replace(strftime(ObservationTime, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0*$', ''),
                                Rain := Rain, Temperature := Temperature)) AS VARCHAR) AS text,
       1 AS go
FROM latest WHERE Temperature >= 5.0
"""

NORMALS = """
normals AS (
  SELECT r.City, r.day, avg(o.MaxTempC) AS normal
  FROM (SELECT DISTINCT City, CAST(ObservationTime AS DATE) AS day FROM live) r
  JOIN obs o ON o.ClimateID = r.City AND month(o.Datetime) = month(r.day) AND day(o.Datetime) = day(r.day)
            AND o.Datetime <= r.day AND year(o.Datetime) >= year(r.day) - 30
  GROUP BY r.City, r.day)"""

ORACLE["deviation_alert"] = with_(LIVE, LATEST_PER_CITY, OBS_VALUES, NORMALS) + f"""
SELECT c.City, c.ObservationTime, {dbl('c.Temperature')} AS Temperature, {dbl('n.normal')} AS normal,
       {dbl('c.Temperature - n.normal')} AS deviation
FROM latest c LEFT JOIN normals n ON c.City = n.City AND CAST(c.ObservationTime AS DATE) = n.day
WHERE n.normal IS NULL OR abs(c.Temperature - n.normal) >= 5.0
"""

ORACLE["same_day_history"] = with_(OBS_VALUES) + f"SELECT * FROM obs WHERE {AS_OF_DAY}\n"

ORACLE["history_json"] = with_(OBS_VALUES) + f"""
SELECT ClimateID, CAST(count(*) AS BIGINT) AS n_rows,
       '[' || array_to_string(list_sort(list(CAST(to_json(struct_pack(
            ClimateID := ClimateID, Datetime := Datetime, MaxTempC := MaxTempC,
            MinTempC := MinTempC, MeanTempC := MeanTempC, TotalPrecipmm := TotalPrecipmm)) AS VARCHAR))),
            ', ') || ']' AS history_json
FROM obs WHERE {AS_OF_DAY} GROUP BY ClimateID
"""

# ------------------------------------------------------------------ measures
ORACLE["metric_real_axis"] = with_(OBS_VALUES) + """
, sel AS (SELECT * FROM obs WHERE Datetime >= DATE '1996-01-01' AND Datetime <= DATE '1997-12-31')
SELECT Datetime, CAST(max(MaxTempC) AS DOUBLE) AS metric_real,
       (SELECT CAST(max(MaxTempC) AS DOUBLE) FROM sel) AS axis_real
FROM sel GROUP BY Datetime
"""

ORACLE["metric_forecast_axis"] = with_(OBS_VALUES, FORECAST) + f"""
, sel AS (SELECT * FROM fc WHERE date >= DATE '2001-01-01' AND date <= DATE '2002-12-31')
SELECT date, {dbl('max(MaxTempC_predicted)')} AS metric_forecast,
       (SELECT {dbl('max(MaxTempC_predicted)')} FROM sel
         WHERE date > (SELECT max(Datetime) FROM obs)) AS axis_forecast
FROM sel GROUP BY date
"""

ORACLE["max_real_date"] = with_(OBS_VALUES) + """
SELECT max(Datetime) AS max_real_date, max(Datetime) AS debug FROM obs
"""

ORACLE["period_text"] = with_(OBS_VALUES) + """
, cal AS (
  SELECT CAST(unnest(generate_series(CAST((SELECT min(Datetime) FROM obs) AS TIMESTAMP),
                                     CAST((SELECT max(Datetime) FROM obs) AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS d
)
SELECT CAST(count(*) AS BIGINT) AS n_days,
       'This will cover period of : ' || CAST(count(*) AS VARCHAR)
         || CASE WHEN count(*) > 1 THEN 'days' ELSE 'day' END AS textday
FROM cal WHERE d >= DATE '1996-01-01' AND d <= DATE '1997-12-31'
"""

ORACLE["metric_selection"] = with_(OBS_VALUES) + f"""
, v AS (SELECT max(MaxTempC) AS m1, min(MinTempC) AS m2, sum(TotalPrecipmm) AS m3 FROM obs)
SELECT CAST(id AS BIGINT) AS id, Metric, {dbl('val')} AS metric_real,
       Metric || ' Real and Forecast by date' AS titletimeseries, icon AS displayIcone
FROM (SELECT 1 AS id, 'MaxTempC' AS Metric, m1 AS val, 'fire' AS icon FROM v
      UNION ALL SELECT 2, 'MinTempC', m2, 'ice' FROM v
      UNION ALL SELECT 3, 'TotalPrecipmm', m3, 'rain' FROM v) t
"""

ORACLE["mean_rain_measures"] = with_(OBS_VALUES) + f"""
SELECT CAST(year(Datetime) AS INTEGER) AS year, {dbl('avg(MeanTempC)')} AS mean_temp_real,
       {dbl('avg(TotalPrecipmm)')} AS mean_rain_real, {dbl('sum(TotalPrecipmm)')} AS rain_real
FROM obs GROUP BY year(Datetime)
"""

ORACLE["metric_extremes"] = with_(OBS_VALUES, FORECAST) + f"""
, r AS (SELECT Datetime AS d, CAST(max(MaxTempC) AS DOUBLE) AS v FROM obs GROUP BY Datetime)
, f AS (SELECT date AS d, CAST(max(MaxTempC_predicted) AS DOUBLE) AS v FROM fc GROUP BY date)
, rt AS (SELECT max(v) AS v, min(d) AS d FROM r WHERE v = (SELECT max(v) FROM r))
, ft AS (SELECT max(v) AS v, min(d) AS d FROM f WHERE v = (SELECT max(v) FROM f))
SELECT CAST(ft.v AS VARCHAR) || ' on ' || CAST(ft.d AS VARCHAR) AS forecast_maximal_value,
       {dbl('abs(ft.v - (SELECT max(r.v) FROM r WHERE r.d = ft.d))')} AS forecast_maximal_value_error,
       (SELECT CAST(v AS VARCHAR) || ' on ' || CAST(d AS VARCHAR) FROM rt) AS real_maximal_value
FROM ft
"""

# ---------------------------------------------------------------- statistics
ORACLE["describe_precip"] = with_(OBS_VALUES) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS "count", {dbl(f'avg({c})')} AS mean,
       {dbl(f'stddev_samp({c})')} AS stddev, {dbl(f'min({c})')} AS "min", {dbl(f'max({c})')} AS "max" FROM obs"""
    for c in ["MaxTempC", "MinTempC", "TotalPrecipmm"]
) + "\n"

ORACLE["zero_precip_count"] = with_(CLEAN_OBS) + """
SELECT CAST(count_if(TotalPrecipmm = 0) AS BIGINT) AS zero_count,
       CAST(count_if(TotalPrecipmm <> 0) AS BIGINT) AS nonzero_count,
       CAST(count_if(TotalPrecipmm IS NULL) AS BIGINT) AS null_count
FROM clean_obs
"""

ORACLE["rain_class_counts"] = with_(OBS_VALUES) + """
, c AS (SELECT CASE WHEN TotalPrecipmm > 0 THEN 1 ELSE 0 END AS Rain, count(*) AS n FROM obs GROUP BY 1)
SELECT CAST(Rain AS INTEGER) AS Rain, CAST(n AS BIGINT) AS n,
       CAST((SELECT min(n) FROM c) AS BIGINT) AS minority_n
FROM c
"""

PAIRS = (
    SERIES
    + """,
pairs AS (
  SELECT s.ds, s.y AS label, p.prediction
  FROM series s JOIN (SELECT ds + 7 AS ds, y AS prediction FROM series) p ON s.ds = p.ds
)"""
)

ORACLE["pred_vs_real"] = with_(PAIRS) + f"""
SELECT ds, {dbl('label')} AS label, {dbl('prediction')} AS prediction FROM pairs
"""

ORACLE["regression_quality"] = with_(PAIRS) + f"""
SELECT CAST(count(*) AS BIGINT) AS n,
       {dbl('sqrt(avg((prediction - label) * (prediction - label)))')} AS rmse,
       {dbl('avg(abs(prediction - label))')} AS mae,
       {dbl('1 - avg((prediction - label) * (prediction - label)) / var_pop(label)')} AS r2
FROM pairs
"""

_CORR_COLS = ["MaxTempC", "MinTempC", "TotalPrecipmm", "Latitudey"]
ORACLE["correlations"] = with_(OBS_VALUES) + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {dbl(f'corr({a}, {b})')} AS corr FROM obs"
    for i, a in enumerate(_CORR_COLS)
    for b in _CORR_COLS[i + 1:]
) + "\n"

ORACLE["key_influencers"] = with_(OBS_VALUES, STATIONS) + f"""
, j AS (
  SELECT CASE WHEN o.TotalPrecipmm > 0 THEN 1 ELSE 0 END AS Rain, s.Province,
         CAST(month(o.Datetime) AS VARCHAR) AS month, {season_sql('o.Datetime')} AS season
  FROM obs o LEFT JOIN stations s ON o.ClimateID = s.ClimateID
)
, long AS (
  SELECT 'Province' AS factor, Province AS value, Rain FROM j
  UNION ALL SELECT 'month', month, Rain FROM j
  UNION ALL SELECT 'season', season, Rain FROM j
)
, g AS (SELECT factor, value, count(*) AS n, avg(Rain) AS mean_target FROM long GROUP BY factor, value)
, o AS (SELECT avg(Rain) AS overall FROM j)
SELECT factor, value, CAST(n AS BIGINT) AS n, {dbl('mean_target')} AS mean_target,
       {dbl('overall')} AS overall_mean, {dbl('mean_target / overall')} AS lift,
       CAST(row_number() OVER (PARTITION BY factor ORDER BY mean_target / overall DESC,
                               value ASC NULLS FIRST) AS INTEGER) AS rank
FROM g, o
"""

ORACLE["narrative_facts"] = with_(OBS_VALUES, STATIONS) + f"""
, daily AS (
  SELECT s.Province, o.Datetime, avg(o.MaxTempC) AS value
  FROM obs o LEFT JOIN stations s ON o.ClimateID = s.ClimateID
  GROUP BY s.Province, o.Datetime
)
, d2 AS (
  SELECT *, min(value) OVER (PARTITION BY Province) AS mv, max(value) OVER (PARTITION BY Province) AS xv
  FROM daily
)
SELECT Province, CAST(count(*) AS BIGINT) AS n_days,
       {dbl('arg_min(value, Datetime)')} AS first_value, {dbl('arg_max(value, Datetime)')} AS last_value,
       {dbl('min(value)')} AS min_value, {dbl('max(value)')} AS max_value,
       min(Datetime) FILTER (WHERE value = mv) AS min_day,
       min(Datetime) FILTER (WHERE value = xv) AS max_day,
       {dbl('avg(value)')} AS mean_value,
       {dbl("regr_slope(value, CAST(" + UNIX_DAY.format('Datetime') + " AS DOUBLE))")} AS slope_per_day
FROM d2 GROUP BY Province
"""

# ------------------------------------------------------- forecasts and runs
ORACLE["rain_gated"] = with_(FORECAST) + """
SELECT *, TotalPrecipmm_predicted * Rain_predicted AS TotalPrecipmm_predictedRain,
       PrecipitationM2_predicted * Rain_predicted AS PrecipitationM2_predictedRain
FROM fc
"""

ORACLE["runs_pivot"] = """
WITH runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
         CASE WHEN o_orderstatus = 'F' THEN 'MaxTempC' WHEN o_orderstatus = 'O' THEN 'MinTempC'
              ELSE 'TotalPrecipmm' END AS target,
         o_orderdate AS ts,
         o_totalprice / 10000.0 AS RMSE,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL
              ELSE 1.0 - CAST(o_custkey % 100 AS DOUBLE) / 100.0 END AS R2,
         o_totalprice / 20000.0 AS MAE
  FROM orders
)
SELECT run_id, target, RMSE, R2, MAE, ts,
       CAST(row_number() OVER (PARTITION BY target ORDER BY ts, run_id) AS BIGINT) AS "index"
FROM runs WHERE RMSE IS NOT NULL AND R2 IS NOT NULL AND MAE IS NOT NULL
"""

# ------------------------------------------------------- splits and set ops
ORACLE["half_split"] = with_(SERIES) + f"""
, cut AS (SELECT median({UNIX_DAY.format('ds')}) AS c FROM series)
SELECT CASE WHEN {UNIX_DAY.format('ds')} <= (SELECT c FROM cut) THEN 'first' ELSE 'second' END AS half,
       CAST(count(*) AS BIGINT) AS n_days, min(ds) AS first_day, max(ds) AS last_day
FROM series GROUP BY 1
"""

ORACLE["subtract_distinct"] = with_(OBS_VALUES) + f"""
SELECT ClimateID, Datetime, MaxTempC, TotalPrecipmm FROM obs
EXCEPT
SELECT ClimateID, Datetime, MaxTempC, TotalPrecipmm FROM obs
WHERE {UNIX_DAY.format('Datetime')} <= (SELECT median({UNIX_DAY.format('Datetime')}) FROM obs)
"""

ORACLE["class_union"] = with_(OBS_VALUES) + """
, r AS (SELECT ClimateID, Datetime, TotalPrecipmm,
               CAST(CASE WHEN TotalPrecipmm > 0 THEN 1 ELSE 0 END AS INTEGER) AS Rain FROM obs)
SELECT * FROM r WHERE Rain = 0
UNION ALL
SELECT * FROM r WHERE Rain = 1
"""

# ---------------------------------------------------------- calendar / star
ORACLE["forecast_calendar"] = with_(OBS_VALUES) + f"""
, cal AS (
  SELECT CAST(unnest(generate_series(CAST((SELECT min(Datetime) FROM obs) AS TIMESTAMP),
                                     CAST((SELECT max(Datetime) FROM obs) + INTERVAL 10 YEAR AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS date
)
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(day(date) AS INTEGER) AS day, {season_sql('date')} AS season
FROM cal
"""

ORACLE["calendar_features"] = with_(SERIES) + f"""
SELECT ds, {dbl('y')} AS y, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month,
       CAST(day(ds) AS INTEGER) AS day, CAST(dayofyear(ds) AS INTEGER) AS day_of_year,
       CAST(dayofweek(ds) + 1 AS INTEGER) AS day_of_week
FROM series
"""

ORACLE["star_history"] = with_(CLEAN_OBS, STATIONS) + f"""
, cal AS (
  SELECT CAST(unnest(generate_series(CAST((SELECT min(Datetime) FROM clean_obs) AS TIMESTAMP),
                                     CAST((SELECT max(Datetime) FROM clean_obs) AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS date
)
SELECT c.ClimateID, c.Datetime,
       CAST(c.Latitudey AS DOUBLE) AS Latitudey, CAST(c.MaxTempC AS DOUBLE) AS MaxTempC,
       CAST(c.MinTempC AS DOUBLE) AS MinTempC, CAST(c.MeanTempC AS DOUBLE) AS MeanTempC,
       CAST(c.TotalPrecipmm AS DOUBLE) AS TotalPrecipmm, CAST(c.Longitudex AS DOUBLE) AS Longitudex,
       s.Name, s.Province,
       CAST(year(d.date) AS INTEGER) AS year, CAST(month(d.date) AS INTEGER) AS month,
       CAST(day(d.date) AS INTEGER) AS day,
       CASE WHEN d.date IS NULL THEN NULL ELSE {season_sql('d.date')} END AS season
FROM clean_obs c
LEFT JOIN stations s ON c.ClimateID = s.ClimateID
LEFT JOIN cal d ON c.Datetime = d.date
"""

ORACLE["station_name_match"] = with_(STATIONS) + f"""
, r AS (
  SELECT 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS Station,
         round(100.0 * l_discount, 2) + 0.0 AS TotalPrecip
  FROM lineitem
)
, p AS (SELECT Station, count(*) AS n_rows, sum(TotalPrecip) AS total FROM r GROUP BY Station)
SELECT s.Name, s.Province, CAST(p.n_rows AS BIGINT) AS n_rows, {dbl('p.total')} AS total_precip
FROM p JOIN stations s ON p.Station = s.Name
"""

EXTERNAL = """
external AS (
  SELECT p_brand AS "Station", DATE '1995-01-01' + CAST(p_partkey AS INTEGER) AS "Date", CAST(p_size AS DOUBLE) AS "Max Temp",
         CAST(p_size - 10 AS DOUBLE) AS "Min Temp", CAST(floor(p_retailprice / 100.0) AS DOUBLE) AS "Heat Deg Days",
         CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE CAST(p_partkey % 40 AS DOUBLE) / 4.0 END AS "Total Precip (mm)"
  FROM part WHERE p_size <> 1
)"""

ORACLE["csv_header_rows"] = with_(EXTERNAL) + "SELECT * FROM external\n"

ORACLE["csv_dates"] = with_(EXTERNAL) + f"""
SELECT CAST(year("Date") AS INTEGER) AS year, {season_sql('"Date"')} AS season, count(*) AS n_rows,
       {dbl('sum("Total Precip (mm)")')} AS total_precip
FROM external GROUP BY 1, 2
"""

# ------------------------------------------------------------------ streaming
ORACLE["stream_ingest"] = with_(LIVE) + "SELECT * FROM live\n"

ORACLE["stream_latest_city"] = ORACLE["latest_per_city"]

ORACLE["stream_alerts"] = with_(LIVE) + """
SELECT City, ObservationTime,
       CAST(CAST(Temperature AS DECIMAL(10,2)) AS DOUBLE) AS currentTemp,
       CAST(to_json(struct_pack(ObservationTime := regexp_replace(strftime(ObservationTime, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0*$', ''),
                                Rain := Rain, Temperature := Temperature)) AS VARCHAR) AS text,
       1 AS go
FROM live WHERE Temperature >= 5.0
"""

# ------------------------------------------------------------ file ingestion
ORACLE["csv_ingest"] = with_(RAW_OBS) + """
SELECT * EXCLUDE (d) REPLACE (d AS DateTime), TRY_CAST(substr(d, 1, 4) AS INTEGER) AS Year, TRY_CAST(substr(d, 6, 2) AS INTEGER) AS Month
FROM (SELECT *, CASE CAST(ClimateID AS INTEGER) % 7 WHEN 0 THEN NULL WHEN 1 THEN '1850-06-15' WHEN 2 THEN 'no day' ELSE DateTime END AS d FROM raw_obs)
"""

ORACLE["csv_partition_range"] = with_(OBS_VALUES) + """
SELECT ClimateID, Datetime, MaxTempC, CAST(year(Datetime) AS INTEGER) AS Year, CAST(month(Datetime) AS INTEGER) AS Month
FROM obs WHERE year(Datetime) BETWEEN 1995 AND 1996 AND month(Datetime) BETWEEN 4 AND 6
"""

ORACLE["csv_partition_season"] = with_(OBS_VALUES) + """
SELECT ClimateID, Datetime, MaxTempC, CAST(year(Datetime) AS INTEGER) AS Year, CAST(month(Datetime) AS INTEGER) AS Month
FROM obs WHERE year(Datetime) = 1996 AND month(Datetime) IN (12, 1, 2)
"""

ORACLE["api_pages"] = """
SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS date, o_totalprice AS value,
       CAST(o_custkey AS VARCHAR) AS station,
       CAST(year(o_orderdate) AS INTEGER) AS years, CAST(month(o_orderdate) AS INTEGER) AS months
FROM orders
"""

ORACLE["stream_deviation_alerts"] = with_(LIVE, OBS_VALUES, NORMALS) + f"""
, days AS (
  SELECT ClimateID, Datetime AS day, CAST(to_json(struct_pack(ClimateID := ClimateID, Datetime := Datetime, Latitudey := Latitudey,
         MaxTempC := MaxTempC, MinTempC := MinTempC, MeanTempC := MeanTempC, TotalPrecipmm := TotalPrecipmm, Longitudex := Longitudex)) AS VARCHAR) AS line
  FROM obs)
, texts AS (
  SELECT r.City, r.day, '[' || string_agg(d.line, ', ' ORDER BY d.day, d.line) || ']' AS history
  FROM (SELECT DISTINCT City, CAST(ObservationTime AS DATE) AS day FROM live) r
  JOIN days d ON d.ClimateID = r.City AND month(d.day) = month(r.day) AND day(d.day) = day(r.day)
            AND d.day <= r.day AND year(d.day) >= year(r.day) - 30
  GROUP BY r.City, r.day)
SELECT l.City, l.ObservationTime,
       CAST(CAST(l.Temperature AS DECIMAL(10,2)) AS DOUBLE) AS currentTemp,
       '{{"current": ' || CAST(to_json(struct_pack(ObservationTime := regexp_replace(strftime(l.ObservationTime, '%Y-%m-%d %H:%M:%S.%f'), '\\.?0*$', ''),
                                Rain := l.Rain, Temperature := l.Temperature)) AS VARCHAR)
         || ', "history": ' || coalesce(t.history, '[]') || '}}' AS text,
       1 AS go, {dbl('n.normal')} AS normal, {dbl('l.Temperature - n.normal')} AS deviation
FROM live l LEFT JOIN normals n ON l.City = n.City AND CAST(l.ObservationTime AS DATE) = n.day
LEFT JOIN texts t ON l.City = t.City AND CAST(l.ObservationTime AS DATE) = t.day
WHERE n.normal IS NULL OR abs(l.Temperature - n.normal) >= 5.0
"""

ORACLE["default_summary"] = with_(CLEAN_OBS, STATIONS) + """
SELECT s.Province, CAST(year(c.Datetime) AS INTEGER) AS year,
       CAST(sum(c.MaxTempC) AS DOUBLE) AS MaxTempC, CAST(sum(c.MinTempC) AS DOUBLE) AS MinTempC,
       CAST(sum(c.MeanTempC) AS DOUBLE) AS MeanTempC, CAST(sum(c.TotalPrecipmm) AS DOUBLE) AS TotalPrecipmm
FROM clean_obs c LEFT JOIN stations s ON c.ClimateID = s.ClimateID
GROUP BY s.Province, year(c.Datetime)
"""


def hash60_sql(cols: list[str], seed: int) -> str:
    parts = ", ".join([f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols] + [f"'{seed}'"])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15)) AS BIGINT)"


_SPLIT_KEY = ["ClimateID", "Datetime", "MaxTempC", "MinTempC", "Latitudey"]

ORACLE["hash_split"] = with_(OBS_VALUES) + f"""
SELECT *, CASE WHEN {hash60_sql(_SPLIT_KEY, 1042)} % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM obs
"""

ORACLE["balanced_sample"] = with_(OBS_VALUES) + f"""
, r AS (SELECT *, CASE WHEN TotalPrecipmm > 0 THEN 1 ELSE 0 END AS Rain, count(*) AS n FROM obs GROUP BY ALL)
, c AS (SELECT Rain, sum(n) AS class_n FROM r GROUP BY Rain)
, f AS (SELECT Rain, CAST((SELECT min(class_n) FROM c) AS DOUBLE) / class_n AS rate FROM c)
, k AS (
  SELECT r.*, CAST(floor(r.n * f.rate + CAST({hash60_sql(_SPLIT_KEY, 42)} AS DOUBLE) / CAST({1 << 60}.0 AS DOUBLE)) AS BIGINT) AS keep
  FROM r JOIN f ON r.Rain = f.Rain)
SELECT ClimateID, Datetime, Latitudey, MaxTempC, MinTempC, MeanTempC, TotalPrecipmm, Longitudex, Rain
FROM (SELECT *, unnest(range(keep)) AS i FROM k WHERE keep > 0)
"""

ORACLE["latest_rows"] = with_(LIVE) + """
SELECT * FROM live WHERE ObservationTime = (SELECT max(ObservationTime) FROM live)
"""

ORACLE["staging_table"] = ORACLE["clean_observations"]

ORACLE["live_star"] = with_(LIVE, STATIONS) + f"""
, per_city_day AS (
  SELECT City, CAST(ObservationTime AS DATE) AS "Date", CAST(count(*) AS BIGINT) AS n_readings,
         {dbl('avg(Temperature)')} AS avg_temperature, {dbl('sum(Rain)')} AS total_rain
  FROM live GROUP BY City, CAST(ObservationTime AS DATE)
)
SELECT p.City, p."Date", p.n_readings, p.avg_temperature, p.total_rain, s.Name, s.Province,
       {season_sql('p."Date"')} AS season
FROM per_city_day p LEFT JOIN stations s ON p.City = s.ClimateID
"""

ORACLE["forecast_star"] = with_(FORECAST) + f"""
SELECT CAST(year(date) AS INTEGER) AS year, {season_sql('date')} AS season,
       {dbl('sum(Rain_predicted)')} AS Rain_predicted, {dbl('sum(MaxTempC_predicted)')} AS MaxTempC_predicted,
       {dbl('sum(MinTempC_predicted)')} AS MinTempC_predicted,
       {dbl('sum(TotalPrecipmm_predicted)')} AS TotalPrecipmm_predicted
FROM fc GROUP BY 1, 2
"""

ORACLE["station_catalogue"] = """
SELECT s_acctbal::VARCHAR AS elevation, NULL::VARCHAR AS mindate, NULL::VARCHAR AS maxdate, NULL::VARCHAR AS latitude,
       s_name AS name, NULL::VARCHAR AS datacoverage, 'ST:' || s_suppkey AS id, NULL::VARCHAR AS "elevationUnit", NULL::VARCHAR AS longitude
FROM supplier
"""

ORACLE["province_stations"] = with_(STATIONS) + "SELECT * FROM stations WHERE Province = 'CANADA'\n"

_METRIC_SQL = {1: ("max", "MaxTempC"), 2: ("min", "MinTempC"), 3: ("sum", "TotalPrecipmm")}
ORACLE["metric_axes"] = with_(OBS_VALUES, FORECAST) + """
, rs AS (SELECT * FROM obs WHERE Datetime >= DATE '1996-01-01' AND Datetime <= DATE '1997-12-31')
, fs AS (SELECT * FROM fc WHERE date >= DATE '2001-01-01' AND date <= DATE '2002-12-31')
""" + "UNION ALL\n".join(
    f"""SELECT {i} AS id, 'real' AS axis, Datetime AS day, {dbl(f'{agg}({c})')} AS metric, (SELECT {dbl(f'{agg}({c})')} FROM rs) AS axis_value
FROM rs GROUP BY Datetime
UNION ALL
SELECT {i}, 'forecast', date, {dbl(f'{agg}({c}_predicted)')},
       (SELECT {dbl(f'{agg}({c}_predicted)')} FROM fs WHERE date > (SELECT max(Datetime) FROM obs))
FROM fs GROUP BY date
""" for i, (agg, c) in _METRIC_SQL.items()
)

ORACLE["selected_title"] = """
SELECT CAST(r_regionkey AS BIGINT) AS region,
       CASE WHEN r_regionkey = 1 THEN 'MaxTempC' ELSE '' END || ' Real and Forecast by date' AS titletimeseries
FROM region
"""

ORACLE["run_union"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
       CASE o_orderstatus WHEN 'F' THEN 'MaxTempC' WHEN 'O' THEN 'MinTempC' ELSE 'TotalPrecipmm' END AS target,
       o_totalprice / 10000.0 AS "RMSE", 1.0 - CAST(o_custkey % 100 AS DOUBLE) / 100.0 AS "R2",
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice / 20000.0 END AS "MAE"
FROM orders WHERE o_orderpriority <> '5-LOW'
"""

_CUT_COLS = ["Rain_predicted", "MaxTempC_predicted", "MinTempC_predicted", "TotalPrecipmm_predicted", "PrecipitationM2_predicted"]
ORACLE["forecast_stats_cut"] = with_(FORECAST) + "UNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", {dbl(f'avg({c})')} AS mean, {dbl(f'stddev_samp({c})')} AS stddev,
       {dbl(f'min({c})')} AS "min", {dbl(f'max({c})')} AS "max", CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text
FROM fc WHERE date < DATE '1999-01-01'
""" for c in _CUT_COLS
) + """UNION ALL
SELECT 'date', count(date), NULL, NULL, NULL, NULL, NULL, NULL FROM fc WHERE date < DATE '1999-01-01'
"""

ORACLE["forecast_stations"] = with_(STATIONS) + """
SELECT Province, CAST(sum(n) AS BIGINT) AS n_days
FROM (SELECT CAST(o_custkey % 120 AS VARCHAR) AS ClimateID, count(*) AS n FROM orders GROUP BY 1) f
LEFT JOIN stations s USING (ClimateID) GROUP BY Province
"""

ORACLE["model_default_sums"] = with_(LIVE, OBS_VALUES, EXTERNAL) + """
, cal AS (
  SELECT CAST(unnest(generate_series(CAST((SELECT min(Datetime) FROM obs) AS TIMESTAMP),
                                     CAST((SELECT max(Datetime) FROM obs) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d)
""" + "UNION ALL\n".join(
    f"""SELECT '{t}' AS "table", {key} AS key, '{name}' AS "column", {dbl(f'sum({expr})')} AS total FROM {src} GROUP BY {key}
""" for t, src, key, cols in (
        ("live", "live", "City", [(c, c) for c in ("Temperature", "TemperatureMin", "TemperatureMax", "Humidity", "Pressure", "Rain")]),
        ("date", "cal", season_sql("d"), [("year", "year(d)"), ("month", "month(d)"), ("day", "day(d)")]),
        ("external", "external", '"Station"', [(c, f'"{c}"') for c in ("Max Temp", "Min Temp", "Heat Deg Days", "Total Precip (mm)")]),
    ) for name, expr in cols
)

_ALL_COLS = [("ClimateID", "text"), ("Datetime", ""), ("Latitudey", "number"), ("MaxTempC", "number"), ("MinTempC", "number"),
             ("MeanTempC", "number"), ("TotalPrecipmm", "number"), ("Longitudex", "number"), ("DatetimeStrg", "text")]
_NUMBER = "{mean} AS mean, {sd} AS stddev, {mn} AS \"min\", {mx} AS \"max\", {tmn} AS min_text, {tmx} AS max_text"


def _described(c: str, kind: str) -> str:
    null, text = "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    d = f"CAST({c} AS DOUBLE)"
    num = kind == "number"
    return f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", " + _NUMBER.format(
        mean=dbl(f"avg({d})") if num else null, sd=dbl(f"stddev_samp({d})") if num else null,
        mn=dbl(f"min({d})") if num else null, mx=dbl(f"max({d})") if num else null,
        tmn=f"min({c})" if kind == "text" else text, tmx=f"max({c})" if kind == "text" else text,
    ) + " FROM described\n"


ORACLE["describe_all"] = with_(CLEAN_OBS) + """
, described AS (SELECT *, strftime(Datetime, '%Y-%m-%d') AS DatetimeStrg FROM clean_obs)
""" + "UNION ALL\n".join(_described(c, k) for c, k in _ALL_COLS)


def _profile_line(c: str, kind: str) -> str:
    """A described column as Spark writes it to JSON: fields without value are left out."""
    d = f"CAST({c} AS DOUBLE)"
    fields = {
        "number": f', mean := round(avg({d}), 6), stddev := round(stddev_samp({d}), 6), "min" := round(min({d}), 6), "max" := round(max({d}), 6)',
        "text": f", min_text := min({c}), max_text := max({c})",
    }.get(kind, "")
    return f"""  SELECT CAST(to_json(struct_pack("column" := '{c}', "count" := CAST(count({c}) AS BIGINT){fields})) AS VARCHAR) AS line FROM described
"""


ORACLE["precip_profile_text"] = with_(CLEAN_OBS) + """
, described AS (SELECT *, strftime(Datetime, '%Y-%m-%d') AS DatetimeStrg FROM clean_obs)
, d AS (
""" + "UNION ALL\n".join(_profile_line(c, k) for c, k in _ALL_COLS) + """)
SELECT array_to_string(list_sort(list(line)), chr(10)) || chr(10) || ' Count TotalPrecipmm = 0 : '
       || CAST((SELECT count_if(TotalPrecipmm = 0) FROM clean_obs) AS VARCHAR) AS profile_text
FROM d
"""

ORACLE["forecast_gates"] = with_(OBS_VALUES) + """
, cal AS (
  SELECT CAST(unnest(generate_series(CAST((SELECT min(Datetime) FROM obs) AS TIMESTAMP),
                                     CAST((SELECT max(Datetime) FROM obs) + INTERVAL 10 YEAR AS TIMESTAMP),
                                     INTERVAL 1 DAY)) AS DATE) AS date)
SELECT date, 'all' AS "ClimateID", true AS rain_is_class, true AS gate_total, true AS gate_m2 FROM cal
"""
