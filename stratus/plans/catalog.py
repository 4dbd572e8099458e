"""Registered queries: name -> ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or frames Spark derives from them)
whole; none caps, samples or subsets its input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratus.operators import clean, star
from stratus.plans import inputs as I
from stratus.sources.tables import table_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Final projection for comparison: decimals as doubles."""
    return df.withColumns(
        {
            f.name: F.col(f.name).cast("double")
            for f in df.schema.fields
            if isinstance(f.dataType, T.DecimalType)
        }
    )


@query("monthly_summary")
def monthly_summary(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: raw -> clean -> per-station pre-aggregate -> station join -> province summary."""
    return star.monthly_summary(I.clean_obs(spark, root), I.stations(spark, root))


@query("clean_observations")
def clean_observations(spark: SparkSession, root: str) -> DataFrame:
    return I.clean_obs(spark, root).transform(clean.with_date_string).transform(decimals_to_double)


@query("blank_profile")
def blank_profile(spark: SparkSession, root: str) -> DataFrame:
    return clean.blank_profile(I.raw_obs(spark, root))


@query("station_dim")
def station_dim(spark: SparkSession, root: str) -> DataFrame:
    return I.stations(spark, root)


# ---------------------------------------------------------------- parameters
AS_OF = "2001-06-15"  # history queries' "today"
LOOKBACK_YEARS = 10
DEVIATION_YEARS = 30  # readings are of 2024, the history ends in 2001
ALERT_THRESHOLD = 5.0
REAL_SELECTION = ("1996-01-01", "1997-12-31")
FORECAST_SELECTION = ("2001-01-01", "2002-12-31")
HISTORY_JSON_COLS = ["ClimateID", "Datetime", "MaxTempC", "MinTempC", "MeanTempC", "TotalPrecipmm"]


def _forecast(spark: SparkSession, root: str) -> DataFrame:
    from stratus.sources.views import forecast_rows

    return forecast_rows(I.table(spark, root, "orders"))


def _series(spark: SparkSession, root: str) -> DataFrame:
    from stratus.sources.views import daily_series

    return daily_series(I.table(spark, root, "orders"))


# ------------------------------------------------------------ live / history
@query("latest_cards")
def latest_cards(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.live import latest_cards as cards

    return cards(I.live(spark, root)).transform(_round)


@query("latest_per_city")
def latest_per_city(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.live import latest_per_city as per_city

    return per_city(I.live(spark, root))


@query("temperature_alert")
def temperature_alert(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators import live

    current = live.latest_per_city(I.live(spark, root))
    return live.alert_records(live.absolute_alert(current, ALERT_THRESHOLD)).transform(decimals_to_double)


@query("deviation_alert")
def deviation_alert(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators import live

    current = live.latest_per_city(I.live(spark, root))
    out = live.deviation_alert(current, I.obs_values(spark, root), ALERT_THRESHOLD, DEVIATION_YEARS, evidence=False)
    return out.select("City", "ObservationTime", "Temperature", "normal", "deviation").transform(_round)


@query("same_day_history")
def same_day_history(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.live import same_day_history as sdh

    return sdh(I.obs_values(spark, root), AS_OF, LOOKBACK_YEARS)


@query("history_json")
def history_json(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators import live

    hist = live.same_day_history(I.obs_values(spark, root), AS_OF, LOOKBACK_YEARS)
    return live.history_json(hist, HISTORY_JSON_COLS)


# ------------------------------------------------------------------ measures
@query("metric_real_axis")
def metric_real_axis(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.measures import real_series_with_axis

    return real_series_with_axis(I.obs_values(spark, root), 1, *REAL_SELECTION)


@query("metric_forecast_axis")
def metric_forecast_axis(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.measures import forecast_series_with_axis

    return forecast_series_with_axis(
        _forecast(spark, root), I.obs_values(spark, root), 1, *FORECAST_SELECTION
    ).transform(_round)


@query("max_real_date")
def max_real_date(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.measures import max_real_date as mrd

    obs = I.obs_values(spark, root)
    return obs.agg(F.max("Datetime").alias("max_real_date")).select(
        "max_real_date", mrd(obs).alias("debug")
    )


@query("period_text")
def period_text(spark: SparkSession, root: str) -> DataFrame:
    from stratus.ml.features import calendar_for
    from stratus.operators.measures import in_selection, period_text as text

    dates = calendar_for(I.obs_values(spark, root), "Datetime")
    sel = dates.filter(in_selection("date", *REAL_SELECTION))
    n = sel.agg(F.count("day").alias("n_days"))
    return n.select("n_days", text(F.col("n_days")).alias("textday"))


@query("metric_selection")
def metric_selection(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators import measures as M

    vals = M.history_metrics(I.obs_values(spark, root))
    params = M.metric_param(spark)  # three fixed rows
    j = vals.join(F.broadcast(params), "id", "inner")
    return j.select(
        "id",
        "Metric",
        F.round("metric_real", 6).alias("metric_real"),
        M.series_title(F.col("Metric")).alias("titletimeseries"),
        M.metric_icon(F.col("id")).alias("displayIcone"),
    )


@query("mean_rain_measures")
def mean_rain_measures(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.measures import mean_rain_measures as mrm

    obs = I.obs_values(spark, root).withColumn("year", F.year("Datetime"))
    return mrm(obs, ["year"])


@query("metric_extremes")
def metric_extremes(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators import measures as M

    real = M.real_series_with_axis(I.obs_values(spark, root), 1, None, None)
    fc = M.forecast_series_with_axis(_forecast(spark, root), I.obs_values(spark, root), 1, None, None)
    return M.extremes(real, fc).transform(_round)


# ---------------------------------------------------------------- statistics
@query("describe_precip")
def describe_precip(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.stats import describe

    return describe(I.obs_values(spark, root), ["MaxTempC", "MinTempC", "TotalPrecipmm"]).transform(_round)


@query("zero_precip_count")
def zero_precip_count(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.stats import zero_profile

    return zero_profile(I.clean_obs(spark, root), "TotalPrecipmm")


@query("rain_class_counts")
def rain_class_counts(spark: SparkSession, root: str) -> DataFrame:
    from stratus.functions.columns import rain_flag
    from stratus.operators.stats import class_counts

    obs = I.obs_values(spark, root).withColumn("Rain", rain_flag(F.col("TotalPrecipmm")))
    return class_counts(obs, "Rain")


def _naive_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Real daily values beside a seasonal-naive prediction (the value 7 days before)."""
    s = _series(spark, root)
    pred = s.select(F.date_add("ds", 7).alias("ds"), F.col("y").alias("prediction"))
    return s.join(pred, "ds", "inner").select("ds", F.col("y").alias("label"), "prediction")


@query("pred_vs_real")
def pred_vs_real(spark: SparkSession, root: str) -> DataFrame:
    return _naive_pairs(spark, root).transform(_round)


@query("regression_quality")
def regression_quality(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.stats import regression_quality as rq

    return rq(_naive_pairs(spark, root)).transform(_round)


@query("correlations")
def correlations(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.stats import correlation_matrix

    return correlation_matrix(
        I.obs_values(spark, root), ["MaxTempC", "MinTempC", "TotalPrecipmm", "Latitudey"]
    ).transform(_round)


@query("key_influencers")
def key_influencers(spark: SparkSession, root: str) -> DataFrame:
    from stratus.functions.columns import rain_flag, season
    from stratus.operators.stats import key_influencers as ki

    # counted per station and month first: the join and the unpivot carry those few rows
    month = F.trunc("Datetime", "month")
    obs = I.obs_values(spark, root).groupBy("ClimateID", month.alias("start")).agg(
        F.sum(rain_flag(F.col("TotalPrecipmm"))).alias("Rain"), F.count(F.lit(1)).alias("rows")
    )
    counted = obs.select("ClimateID", "Rain", "rows", F.month("start").alias("month"), season(F.col("start")).alias("season"))
    j = star.join_dimension(counted, I.stations(spark, root).select("ClimateID", "Province"), "ClimateID")
    return ki(j, "Rain", ["Province", "month", "season"], weight="rows").transform(_round)


@query("narrative_facts")
def narrative_facts(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.stats import narrative_facts as nf

    obs = I.obs_values(spark, root)
    per_station_day = obs.groupBy("ClimateID", "Datetime").agg(
        F.sum("MaxTempC").alias("s"), F.count("MaxTempC").alias("n")
    )
    j = star.join_dimension(per_station_day, I.stations(spark, root).select("ClimateID", "Province"), "ClimateID")
    daily = j.groupBy("Province", "Datetime").agg((F.sum("s") / F.sum("n")).alias("value"))
    return nf(daily, ["Province"], "Datetime", "value").transform(_round)


# ------------------------------------------------------- forecasts and runs
@query("rain_gated")
def rain_gated(spark: SparkSession, root: str) -> DataFrame:
    from stratus.ml.models import rain_gate

    return rain_gate(_forecast(spark, root))


@query("runs_pivot")
def runs_pivot(spark: SparkSession, root: str) -> DataFrame:
    from stratus.ml.runs import metric_evolution
    from stratus.sources.views import run_metrics

    return metric_evolution(run_metrics(I.table(spark, root, "orders")))


# ------------------------------------------------------- splits and set ops
@query("half_split")
def half_split(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.sampling import half_split as hs

    s = hs(_series(spark, root), "ds")
    return s.groupBy("half").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day")
    )


@query("subtract_distinct")
def subtract_distinct(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.sampling import date_median, subtract_distinct as sd

    obs = I.obs_values(spark, root).select("ClimateID", "Datetime", "MaxTempC", "TotalPrecipmm")
    first = obs.filter(F.unix_date("Datetime") <= date_median(obs, "Datetime"))
    return sd(obs, first)


@query("class_union")
def class_union(spark: SparkSession, root: str) -> DataFrame:
    from stratus.functions.columns import rain_flag
    from stratus.operators.sampling import class_union as cu

    obs = I.obs_values(spark, root).select(
        "ClimateID", "Datetime", "TotalPrecipmm", rain_flag(F.col("TotalPrecipmm")).alias("Rain")
    )
    return cu(obs, "Rain")


@query("balanced_sample")
def balanced_sample(spark: SparkSession, root: str) -> DataFrame:
    from stratus.functions.columns import rain_flag
    from stratus.operators.sampling import balance_classes

    obs = I.obs_values(spark, root).withColumn("Rain", rain_flag(F.col("TotalPrecipmm")))
    return balance_classes(obs, "Rain", ["ClimateID", "Datetime", "MaxTempC", "MinTempC", "Latitudey"])


@query("hash_split")
def hash_split(spark: SparkSession, root: str) -> DataFrame:
    from stratus.operators.sampling import hash_split as hsplit

    obs = I.obs_values(spark, root)
    return hsplit(obs, ["ClimateID", "Datetime", "MaxTempC", "MinTempC", "Latitudey"])


# ---------------------------------------------------------- calendar / star
@query("forecast_calendar")
def forecast_calendar(spark: SparkSession, root: str) -> DataFrame:
    from stratus.functions.columns import season
    from stratus.ml.features import calendar_for

    return calendar_for(I.obs_values(spark, root), "Datetime", 10).withColumn("season", season(F.col("date")))


@query("calendar_features")
def calendar_features(spark: SparkSession, root: str) -> DataFrame:
    from stratus.ml.features import calendar_features as cf

    return cf(_series(spark, root), "ds").transform(_round)


@query("star_history")
def star_history(spark: SparkSession, root: str) -> DataFrame:
    from stratus.ml.features import calendar_for

    obs = I.clean_obs(spark, root)
    # calendar bounds from the one-column day scan, not from the de-duplicated frame: the span
    # can only be wider, which a left join from the facts ignores
    dates = star.date_dimension(calendar_for(I.obs_values(spark, root).select("Datetime"), "Datetime"))
    return star.star_history(obs, I.stations(spark, root), dates).transform(decimals_to_double)


@query("station_name_match")
def station_name_match(spark: SparkSession, root: str) -> DataFrame:
    from stratus.sources.views import external_station_rows

    rows = external_station_rows(I.table(spark, root, "lineitem"))
    # aggregate per name first: the join then carries one row per name
    per_name = rows.groupBy("Station").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("TotalPrecip").alias("total_precip")
    )
    j = star.join_by_name(per_name, I.stations(spark, root))
    return j.select("Name", "Province", "n_rows", F.round("total_precip", 6).alias("total_precip"))


def _external_csv(spark: SparkSession, root: str) -> DataFrame:
    """The 26-column external CSV landed as files without header line, loaded by position and cleaned."""
    from stratus.session import shared_dir
    from stratus.sources import ingest
    from stratus.sources.views import headerless_csv_rows

    path = f"{shared_dir(spark, 'external-csv')}/csv"
    ingest.land_csv(headerless_csv_rows(I.table(spark, root, "part")), path, null_value="", header=False)
    return ingest.clean_headerless_csv(ingest.load_headerless_csv(spark, path, ingest.CSV_WIDTH))


@query("csv_header_rows")
def csv_header_rows(spark: SparkSession, root: str) -> DataFrame:
    """SRC9 + FLT7 + PRJ12 through files."""
    return _external_csv(spark, root)


@query("csv_dates")
def csv_dates(spark: SparkSession, root: str) -> DataFrame:
    """JON4: external CSV rows left-joined to the Date dimension, summed per year and season."""
    from stratus.ml.features import calendar_for

    rows = _external_csv(spark, root)
    dates = star.date_dimension(calendar_for(rows.select("Date"), "Date")).select(F.col("date").alias("_day"), "year", "season")
    per_day = rows.groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.sum("Total Precip (mm)").alias("s"))
    joined = per_day.join(dates, per_day["Date"] == dates["_day"], "left")
    return joined.groupBy("year", "season").agg(F.sum("n").alias("n_rows"), F.round(F.sum("s"), 6).alias("total_precip"))


def _round(df: DataFrame) -> DataFrame:
    from stratus.operators.stats import rounded

    return rounded(df, 6)


# ------------------------------------------------------------ machine learning
ALL_TARGETS = ("Rain", "MaxTempC", "MinTempC", "TotalPrecipmm")


def _training(spark: SparkSession, root: str) -> DataFrame:
    """The training rows with their split and folds, stored by the first who asks: every fit reads them."""
    from stratus.ml import models as MD
    from stratus.ml.runs import table_once

    def make() -> DataFrame:
        return MD.split_rows(MD.training_frame(I.obs_values(spark, root)))

    return MD.stored_frame(table_once(spark, _store(spark, root, "rows"), make))


def _store(spark: SparkSession, root: str, name: str) -> str:
    """Folder of what is learned from the present state of the table (names, sizes
    and times of its files), in the shared folder: a changed file asks for new models."""
    import hashlib

    from stratus.session import checkpoint_root, table_state

    state = hashlib.sha256(repr(table_state(spark, f"{root}/lineitem.parquet")).encode()).hexdigest()[:24]
    return f"{checkpoint_root(spark)}/stratus/models/{state}/{name}"


def _fitted(spark: SparkSession, root: str, targets: tuple[str, ...]) -> dict:
    """RUN5: the requested models, loaded from the store; the first who asks fits and stores
    them, side by side (their fits are many short jobs)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from stratus.ml import models as MD
    from stratus.ml.runs import fitted_once, is_made

    paths = {t: _store(spark, root, t) for t in targets}
    frame = _training(spark, root) if not all(is_made(spark, p) for p in paths.values()) else None
    ready = {}

    def rain():
        return (ready["Rain"].result() if "Rain" in ready else _fitted(spark, root, ("Rain",))["Rain"]).model

    def fit(target: str):
        if target == "Rain":
            return MD.fit_rain_classifier(frame)
        if target == "TotalPrecipmm":
            return MD.fit_precipitation(frame, rain)
        return MD.fit_temperature(frame, target)

    with ThreadPoolExecutor(len(targets)) as pool:
        for t in targets:  # ALL_TARGETS' order: rain before the model that asks for it
            ready[t] = pool.submit(inheritable_thread_target(fitted_once), spark, paths[t], lambda t=t: fit(t))
        return {t: ready[t].result() for t in targets}


@query("rain_classifier")
def rain_classifier(spark: SparkSession, root: str) -> DataFrame:
    """CLS1: balanced random-forest rain classifier; predictions on the held-out split."""
    fitted = _fitted(spark, root, ("Rain",))["Rain"]
    return fitted.held_out.select("ClimateID", "date", "Rain", "prediction").withColumn(
        "auc", F.lit(fitted.metrics["AUC"])
    )


def _forecast_calendar(spark: SparkSession, root: str) -> DataFrame:
    from stratus.ml.features import calendar_for

    return calendar_for(I.obs_values(spark, root), "Datetime", 10)


@query("temp_forecast")
def temp_forecast(spark: SparkSession, root: str) -> DataFrame:
    """REG1 + FOR4: rain, max and min temperature scored over the forecast calendar."""
    from stratus.ml.models import score_as
    from stratus.ml.features import calendar_features as cf

    m = _fitted(spark, root, ("Rain", "MaxTempC", "MinTempC"))
    cal = cf(_forecast_calendar(spark, root).select("date"), "date")
    f = score_as(m["Rain"].model, cal, "Rain_predicted")
    f = score_as(m["MaxTempC"].model, f, "MaxTempC_predicted")
    f = score_as(m["MinTempC"].model, f, "MinTempC_predicted")
    return f.select("date", "Rain_predicted", "MaxTempC_predicted", "MinTempC_predicted")


@query("precip_forecast")
def precip_forecast(spark: SparkSession, root: str) -> DataFrame:
    """REG2 + FOR5 + FOR6: full forecast chain with rain-gated precipitation."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from stratus.ml.additive import fit_additive
    from stratus.ml.models import forecast_frame

    with ThreadPoolExecutor(1) as pool:  # beside the other models
        beside = pool.submit(inheritable_thread_target(fit_additive), _daily_weather(spark, root).persist(), "ds", "y", ["Rain"])
        m = _fitted(spark, root, ALL_TARGETS)
        additive, _ = beside.result()
    return forecast_frame(
        _forecast_calendar(spark, root), m["Rain"].model, m["MaxTempC"].model, m["MinTempC"].model,
        m["TotalPrecipmm"].model, additive,
    )


@query("model_quality")
def model_quality(spark: SparkSession, root: str) -> DataFrame:
    """AGG13 / AGG14 / RUN1-2: every model's held-out quality appended to a
    ``model_runs`` table in the shared folder, read back and pivoted."""
    from stratus.ml.runs import log_run, metric_table
    from stratus.session import shared_dir

    m = _fitted(spark, root, ALL_TARGETS)
    path = shared_dir(spark, "model-runs")
    for target, fitted in m.items():
        log_run(spark, path, target, fitted.params, fitted.metrics)
    return metric_table(spark.read.parquet(path)).drop("run_id", "ts")


ANOMALY_FEATURES = ["TotalPrecipmm", "MinTempC", "MaxTempC"]


def _forest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The observations and their stored forest."""
    from stratus.ml.isolation import grow_forest
    from stratus.ml.runs import table_once

    obs = I.obs_values(spark, root).select("ClimateID", "Datetime", *ANOMALY_FEATURES)
    return obs, table_once(spark, _store(spark, root, "forest"), lambda: grow_forest(obs, ANOMALY_FEATURES, seed=0))


@query("isolation_scores")
def isolation_scores(spark: SparkSession, root: str) -> DataFrame:
    """ANO1: isolation forest over (precipitation, min, max temperature), every row scored."""
    from stratus.ml.isolation import isolation_forest

    obs, nodes = _forest(spark, root)
    return isolation_forest(obs, ANOMALY_FEATURES, nodes=nodes)


@query("anomaly_counts")
def anomaly_counts(spark: SparkSession, root: str) -> DataFrame:
    """ANO2: rows per anomaly label, by the same forest."""
    from stratus.ml.isolation import anomaly_counts as ac

    obs, nodes = _forest(spark, root)
    return ac(obs, ANOMALY_FEATURES, nodes)


def _daily_weather(spark: SparkSession, root: str) -> DataFrame:
    from stratus.functions.columns import rain_flag

    obs = I.obs_values(spark, root)
    return obs.groupBy(F.col("Datetime").alias("ds")).agg(
        F.avg("TotalPrecipmm").alias("y"), F.max(rain_flag(F.col("TotalPrecipmm"))).cast("double").alias("Rain")
    ).filter("ds is not null")


@query("additive_forecast")
def additive_forecast(spark: SparkSession, root: str) -> DataFrame:
    """FOR1: additive model fitted on the first half of the days, scored on the second."""
    from stratus.ml.additive import fit_additive
    from stratus.operators.sampling import half_split as hs

    s = hs(_daily_weather(spark, root).persist(), "ds")
    score, _ = fit_additive(s.filter(F.col("half") == "first"), "ds", "y", ["Rain"])
    return score(s.filter(F.col("half") == "second").drop("half"))


@query("additive_rain_forecast")
def additive_rain_forecast(spark: SparkSession, root: str) -> DataFrame:
    """FOR2: additive model over the future calendar, Rain taken from the classifier."""
    from stratus.ml.additive import fit_additive
    from stratus.ml.features import calendar_features as cf
    from stratus.ml.models import score_as

    daily = _daily_weather(spark, root).persist()
    score, _ = fit_additive(daily, "ds", "y", ["Rain"])
    last = daily.select(F.max("ds")).scalar()
    future = _forecast_calendar(spark, root).filter(F.col("date") > last).select("date")
    rain = score_as(_fitted(spark, root, ("Rain",))["Rain"].model, cf(future, "date"), "Rain")
    return score(rain.select(F.col("date").alias("ds"), "Rain"))


# ------------------------------------------------------------------ streaming
@query("stream_ingest")
def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """STR1 + SRC8: events landed as nested JSON files, streamed into a table."""
    from stratus.streaming.live_stream import ingest_stream, replay_events

    p = replay_events(spark, I.table(spark, root, "events"), "stream-ingest")
    ingest_stream(spark, p["landing"], p["table"], p["checkpoint"])
    return spark.read.parquet(p["table"])


@query("stream_latest_city")
def stream_latest_city(spark: SparkSession, root: str) -> DataFrame:
    """STR2: latest reading per city kept as streaming state."""
    from stratus.streaming.live_stream import latest_state_stream, read_latest, replay_events

    p = replay_events(spark, I.table(spark, root, "events"), "stream-latest")
    latest_state_stream(spark, p["landing"], p["table"], p["checkpoint"])
    return read_latest(spark, p["table"])


@query("stream_alerts")
def stream_alerts(spark: SparkSession, root: str) -> DataFrame:
    """STR3-5: absolute alerts per micro-batch, idempotent by batch id."""
    from stratus.streaming.live_stream import alert_stream, read_alerts, replay_events

    p = replay_events(spark, I.table(spark, root, "events"), "stream-alerts")
    alert_stream(spark, p["landing"], p["table"], p["checkpoint"], ALERT_THRESHOLD)
    return read_alerts(spark, p["table"]).drop("batch_id", "audit").transform(decimals_to_double)


# ------------------------------------------------------------ file ingestion
CSV_HEADER_NAMES = {
    "ClimateID": "Climate ID",
    "DateTime": "Date/Time",
    "Latitudey": "Latitude (y)",
    "MaxTempC": "Max Temp (°C)",
    "MinTempC": "Min Temp (°C)",
    "MeanTempC": "Mean Temp (°C)",
    "TotalPrecipmm": "Total Precip (mm)",
    "Longitudex": "Longitude (x)",
}


@query("csv_ingest")
def csv_ingest(spark: SparkSession, root: str) -> DataFrame:
    """SRC4 + PRJ2 + SNK2 + SRC5: observations landed as symbol-headed CSV in two
    column orders (with NULL, bad and very old dates among them), each file
    read by its own header, names sanitised, appended as Year/Month parquet
    and read back whole."""
    from stratus.session import shared_dir
    from stratus.sources import ingest

    base = shared_dir(spark, "csv-ingest")
    station = F.col("ClimateID").cast("int")
    day = F.when(station % 7 == 0, F.lit(None)).when(station % 7 == 1, "1850-06-15").when(station % 7 == 2, "no day").otherwise(F.col("DateTime"))
    raw = I.raw_obs(spark, root).withColumn("DateTime", day)
    heads = list(CSV_HEADER_NAMES.items())
    ingest.land_csv(raw.filter(station % 2 == 0).select([F.col(c).alias(h) for c, h in heads]), f"{base}/csv")
    ingest.land_csv(raw.filter(station % 2 == 1).select([F.col(c).alias(h) for c, h in heads[::-1]]), f"{base}/csv", mode="append")
    loaded = ingest.load_daily_csv(spark, f"{base}/csv")
    parts = loaded.withColumns(
        {"Year": F.substring("DateTime", 1, 4).try_cast("int"), "Month": F.substring("DateTime", 6, 2).try_cast("int")}
    )
    ingest.append_partitioned(parts, f"{base}/landed", ["Year", "Month"])
    return ingest.load_partitioned(spark, f"{base}/landed").select(*CSV_HEADER_NAMES, "Year", "Month")


@query("csv_partition_range")
def csv_partition_range(spark: SparkSession, root: str) -> DataFrame:
    """SRC5: the range of partitions 1995-1996, quarter two, of the Year/Month tree (pruned folders)."""
    from stratus.session import shared_dir
    from stratus.sources import ingest

    base = shared_dir(spark, "csv-range")
    obs = I.obs_values(spark, root).select("ClimateID", "Datetime", "MaxTempC", F.year("Datetime").alias("Year"), F.month("Datetime").alias("Month"))
    ingest.append_partitioned(obs, f"{base}/landed", ["Year", "Month"])
    found = ingest.load_partitioned(spark, f"{base}/landed", years=(1995, 1996), months=(4, 6))
    return found.select("ClimateID", "Datetime", "MaxTempC", "Year", "Month")


@query("csv_partition_season")
def csv_partition_season(spark: SparkSession, root: str) -> DataFrame:
    """SRC5 + JON2: the Year/Month tree joined to the winter days of the Date dimension; folders are pruned at run time."""
    from stratus.ml.features import calendar_for
    from stratus.session import shared_dir
    from stratus.sources import ingest

    base = shared_dir(spark, "csv-season")
    obs = I.obs_values(spark, root).select("ClimateID", "Datetime", "MaxTempC", F.year("Datetime").alias("Year"), F.month("Datetime").alias("Month"))
    ingest.append_partitioned(obs, f"{base}/landed", ["Year", "Month"])
    tree = ingest.load_partitioned(spark, f"{base}/landed")
    winter = star.date_dimension(calendar_for(I.obs_values(spark, root), "Datetime")).filter((F.col("season") == "Winter") & (F.col("year") == 1996))
    return ingest.load_days(tree, winter).select("ClimateID", "Datetime", "MaxTempC", "Year", "Month")


@query("api_pages")
def api_pages(spark: SparkSession, root: str) -> DataFrame:
    """SRC1 + SRC2 + SNK1: orders landed as API pages of <= 1000 results,
    exploded back to rows with years/months, appended partitioned by years."""
    from stratus.session import shared_dir
    from stratus.sources import ingest

    base = shared_dir(spark, "api-pages")
    orders = I.table(spark, root, "orders")
    rows = orders.select(
        "o_orderkey",
        F.translate(F.col("o_orderdate").cast("timestamp_ntz").cast("string"), " ", "T").alias("date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_custkey").cast("string").alias("station"),
    )
    ingest.land_api_pages(rows, f"{base}/pages", "o_orderkey", 1000)
    loaded = ingest.load_api_pages(spark, f"{base}/pages", multi_line=False, schema="results array<struct<date: string, value: double, station: string>>")
    ingest.append_partitioned(loaded, f"{base}/landed", ["years"])
    return spark.read.parquet(f"{base}/landed")


@query("stream_deviation_alerts")
def stream_deviation_alerts(spark: SparkSession, root: str) -> DataFrame:
    """STR3 deviation mode + JON7 on a stream: every reading beside the normal of
    its own station and calendar day; evidence holds reading and history."""
    from stratus.streaming.live_stream import alert_stream, read_alerts, replay_events

    p = replay_events(spark, I.table(spark, root, "events"), "stream-deviation")
    alert_stream(spark, p["landing"], p["table"], p["checkpoint"], ALERT_THRESHOLD,
                 history=I.obs_values(spark, root), years=DEVIATION_YEARS)
    out = read_alerts(spark, p["table"], deviation=True).drop("batch_id", "audit").transform(decimals_to_double)
    return out.transform(_round)


@query("forecast_stats")
def forecast_stats(spark: SparkSession, root: str) -> DataFrame:
    """FOR8: describe of the forecast for days before 2024."""
    from stratus.ml.models import forecast_statistics

    return forecast_statistics(precip_forecast(spark, root))


@query("forecast_vs_real")
def forecast_vs_real(spark: SparkSession, root: str) -> DataFrame:
    """EVL1 / JON6: forecast beside the real daily means, joined on the date."""
    from stratus.ml.models import predicted_vs_real

    return predicted_vs_real(precip_forecast(spark, root), I.obs_values(spark, root))


@query("default_summary")
def default_summary(spark: SparkSession, root: str) -> DataFrame:
    """AGG10: every measure column by its default aggregation (sum), per province
    and year; summed per station first, so the join carries one row per
    station-year."""
    obs = I.clean_obs(spark, root).select(
        "ClimateID", F.year("Datetime").alias("year"), "MaxTempC", "MinTempC", "MeanTempC", "TotalPrecipmm"
    )
    per_station = star.summarize(obs, ["ClimateID", "year"], "history")
    j = star.join_dimension(per_station, I.stations(spark, root).select("ClimateID", "Province"), "ClimateID")
    return star.summarize(j.drop("ClimateID"), ["Province", "year"], "history").transform(decimals_to_double)


@query("latest_rows")
def latest_rows(spark: SparkSession, root: str) -> DataFrame:
    """JON5 / SRT1: every reading at the latest observation time (ties kept)."""
    from stratus.operators.live import latest_rows as lr

    return lr(I.live(spark, root))


@query("precip_profile_text")
def precip_profile_text(spark: SparkSession, root: str) -> DataFrame:
    """AGG15: describe of all columns of the cleaned observations, text ones too, plus
    the zero-precipitation count, as text."""
    from stratus.operators.stats import describe_all as da, profile_text

    obs = I.clean_obs(spark, root)
    return profile_text(da(obs.transform(clean.with_date_string)), obs, "TotalPrecipmm")


@query("staging_table")
def staging_table(spark: SparkSession, root: str) -> DataFrame:
    """SNK4 + SNK6 + SRC7: the cleaned table written by overwrite, registered, and rewritten
    by name with the added ``DatetimeStrg`` column; the rows are a scan of the named table."""
    from stratus.session import shared_dir
    from stratus.sources import ingest

    base = shared_dir(spark, "staging")
    ingest.overwrite_path(I.clean_obs(spark, root), f"{base}/clean")
    name = "staging_" + base.rsplit("-", 1)[-1]
    ingest.publish_table(spark.read.parquet(f"{base}/clean"), name, base)
    ingest.rewrite_table(spark, name, clean.with_date_string, base)
    return table_scan(spark, name).transform(decimals_to_double)


@query("forecast_table")
def forecast_table(spark: SparkSession, root: str) -> DataFrame:
    """FOR7 / SNK4: the gated forecast written to its table and read back."""
    from stratus.session import shared_dir
    from stratus.sources import ingest

    path = f"{shared_dir(spark, 'forecast')}/weather_forecast"
    ingest.overwrite_path(precip_forecast(spark, root), path)
    return spark.read.parquet(path)


@query("live_star")
def live_star(spark: SparkSession, root: str) -> DataFrame:
    """JON2 for the live fact: readings aggregated per city and day first, then
    joined to the Station (left, by id) and Date (left, by day) dimensions."""
    from stratus.ml.features import calendar_for

    readings = I.live(spark, root).withColumn("Date", F.col("ObservationTime").cast("date"))
    per_city_day = readings.groupBy("City", "Date").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.round(F.avg("Temperature"), 6).alias("avg_temperature"),
        F.round(F.sum("Rain"), 6).alias("total_rain"),
    )
    dates = star.date_dimension(calendar_for(readings.select("Date"), "Date")).select(
        F.col("date").alias("_day"), "season"
    )
    stations = I.stations(spark, root)
    j = star.join_dimension(per_city_day, stations, "City", "ClimateID").drop("ClimateID")
    return j.join(dates, j["Date"] == dates["_day"], "left").drop("_day")


@query("forecast_star")
def forecast_star(spark: SparkSession, root: str) -> DataFrame:
    """JON2 for the forecast fact: forecast rows joined to the Date dimension,
    summed per year and season with the default aggregation (AGG10)."""
    from stratus.ml.features import calendar_for

    fc = _forecast(spark, root)
    dates = star.date_dimension(calendar_for(fc.select("date"), "date")).select(
        F.col("date").alias("_day"), "year", "season"
    )
    j = fc.join(dates, fc["date"] == dates["_day"], "left").drop("_day", "date")
    return star.summarize(j, ["year", "season"], "forecast").transform(_round)


# ------------------------------------------------- operators one by one
@query("station_catalogue")
def station_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """SRC3 + SNK3: suppliers landed as station catalogue documents in two appends, loaded with the all-string schema."""
    from stratus.session import shared_dir
    from stratus.sources import ingest

    path = f"{shared_dir(spark, 'stations')}/json"
    docs = I.table(spark, root, "supplier").select(
        F.concat(F.lit("ST:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("string").alias("elevation")
    )
    low = F.col("elevation").cast("double") < 0
    ingest.append_files(docs.filter(low), path, "json")
    ingest.append_files(docs.filter(~low), path, "json")
    return ingest.load_station_catalogue(spark, path, multi_line=False)


@query("province_stations")
def province_stations(spark: SparkSession, root: str) -> DataFrame:
    """FLT1: the stations of one province."""
    from stratus.operators.clean import station_dimension

    return station_dimension(I.stations_raw(spark, root), "CANADA")


@query("metric_axes")
def metric_axes(spark: SparkSession, root: str) -> DataFrame:
    """MEA1, MEA2, MEA12, MEA13: every metric id on the real and the forecast axis."""
    from stratus.operators import measures as M

    parts = []
    for mid in M.METRICS:
        real = M.real_series_with_axis(I.obs_values(spark, root), mid, *REAL_SELECTION)
        fc = M.forecast_series_with_axis(_forecast(spark, root), I.obs_values(spark, root), mid, *FORECAST_SELECTION)
        parts.append(real.select(F.lit(mid).alias("id"), F.lit("real").alias("axis"), F.col("Datetime").alias("day"), F.col("metric_real").alias("metric"), F.col("axis_real").alias("axis_value")))
        parts.append(fc.select(F.lit(mid).alias("id"), F.lit("forecast").alias("axis"), F.col("date").alias("day"), F.col("metric_forecast").alias("metric"), F.col("axis_forecast").alias("axis_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.transform(_round)


@query("selected_title")
def selected_title(spark: SparkSession, root: str) -> DataFrame:
    """MEA15 with SELECTEDVALUE: the title for each region's selection of metrics
    (region r selects the metrics with id <= r): blank name for none or several."""
    from stratus.operators import measures as M

    regions = I.table(spark, root, "region").select(F.col("r_regionkey").cast("long").alias("region"))
    ids = F.filter(F.array(*[F.lit(i).cast("long") for i in M.METRICS]), lambda i: i <= F.col("region"))
    chosen = regions.withColumn("id", F.explode_outer(ids)).join(M.metric_param(spark), "id", "left")
    return chosen.groupBy("region").agg(M.series_title(M.selected_value(F.col("Metric"))).alias("titletimeseries"))


@query("run_union")
def run_union(spark: SparkSession, root: str) -> DataFrame:
    """SET4 + RUN3: per-target metric tables put together; the MAE column is missing in one of them."""
    from stratus.ml.runs import metric_table, union_targets
    from stratus.sources.views import run_metrics

    runs = run_metrics(I.table(spark, root, "orders"))
    tables = [metric_table(runs.filter(F.col("target") == t)) for t in ("MaxTempC", "MinTempC", "TotalPrecipmm")]
    tables[1] = tables[1].drop("MAE")
    return union_targets(tables).drop("ts")


@query("forecast_stats_cut")
def forecast_stats_cut(spark: SparkSession, root: str) -> DataFrame:
    """FLT6 + FOR8: describe of the mapped forecast for the days before a cut within its span."""
    from stratus.ml.models import forecast_statistics

    return forecast_statistics(_forecast(spark, root), before="1999-01-01").transform(_round)


@query("forecast_stations")
def forecast_stations(spark: SparkSession, root: str) -> DataFrame:
    """JON2, Forecast -> Station: forecast rows per station id (the order's clerk stands
    for it), left-joined to the Station dimension; counted per province."""
    orders = I.table(spark, root, "orders")
    per_station = orders.groupBy(F.pmod(F.col("o_custkey"), F.lit(120)).cast("string").alias("ClimateID")).agg(F.count(F.lit(1)).alias("n"))
    j = star.join_dimension(per_station, I.stations(spark, root), "ClimateID")
    return j.groupBy("Province").agg(F.sum("n").alias("n_days"))


@query("model_default_sums")
def model_default_sums(spark: SparkSession, root: str) -> DataFrame:
    """AGG10 table by table: default sums of the live fact per city, of the date
    dimension per season and of the external CSV per station, in one long table."""
    from stratus.ml.features import calendar_for

    dates = star.date_dimension(calendar_for(I.obs_values(spark, root), "Datetime"))
    parts = [("live", I.live(spark, root), "City"), ("date", dates, "season"), ("external", _external_csv(spark, root), "Station")]
    out = None
    for name, frame, by in parts:
        sums = star.summarize(frame, [by], name)
        names = [c for c in sums.columns if c != by]
        sums = sums.select(F.col(by).alias("key"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
        rows = sums.unpivot("key", [F.col(f"`{c}`") for c in names], "column", "total").select(F.lit(name).alias("table"), "key", "column", "total")
        out = rows if out is None else out.unionByName(rows)
    return out.transform(_round)


@query("describe_all")
def describe_all(spark: SparkSession, root: str) -> DataFrame:
    """AGG5 over all columns of the cleaned observations and their date text."""
    from stratus.operators.stats import describe_all as da

    return da(I.clean_obs(spark, root).transform(clean.with_date_string)).transform(_round)


@query("forecast_gates")
def forecast_gates(spark: SparkSession, root: str) -> DataFrame:
    """FOR6 + FOR7 + PRJ10 on the written table read back: the date axis, the constant
    id, and whether both gated columns are prediction times rain prediction."""
    t = forecast_table(spark, root)
    gate = {c: F.col(f"{c}_predictedRain") == F.col(f"{c}_predicted") * F.col("Rain_predicted") for c in ("TotalPrecipmm", "PrecipitationM2")}
    return t.select("date", "ClimateID", F.col("Rain_predicted").isin(0.0, 1.0).alias("rain_is_class"), gate["TotalPrecipmm"].alias("gate_total"), gate["PrecipitationM2"].alias("gate_m2"))
