"""Forecast models on Spark ML (CLS1, REG1-2, FOR4-8, EVL1, AGG14).

Training runs on executors (Spark ML random forests aggregate split
statistics with tree aggregation, so they scale with rows).  Models on
calendar features alone are trained on folded cells (sufficient statistics per
day), not on rows; the precipitation model, whose features hold the
temperatures, on cells of its features' bins, as many as its trees tell apart.
The split and the class balancing are hashes of row columns, so they are
deterministic and recompute identically after an executor loss.  All models
share one split and its folds, so a stored frame (``split_rows``) is hashed
once for all of them.

Differences from the reference, on purpose (documented defects):
* one feature list is used for fitting and scoring (FEA3);
* the precipitation model is scored on held-out rows, and evaluated on rows
  predicted rainy and truly rainy (REG2);
* the forecast is one frame scored by a chain of models, not per-target
  frames joined back on date (JON1).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.functions.columns import rain_flag
from stratus.ml.features import BASE_FEATURES, calendar_features
from stratus.operators.sampling import class_draw, hash_split, replicate
from stratus.operators.stats import regression_quality, row_hash60
from stratus.session import checkpoint_root, shared_dir

# Grid of the reference (fixed values): numTrees x maxDepth, 3 folds, RMSE.
NUM_TREES = [10, 20]
MAX_DEPTH = [5, 10]
FOLDS = 3
SEED = 42
PRECIP_FEATURES = BASE_FEATURES + ["MaxTempC", "MinTempC"]
BINS = 32  # of a feature: a tree of Spark ML tells no more apart (its default ``maxBins``)
QUANTILES = 1000
CELLS = 50_000  # of a task: each holds statistics of all nodes of a level, so a few cells a task would cost more than they save
KEY = ["ClimateID", "date", "MaxTempC", "MinTempC", "TotalPrecipmm"]


@dataclass
class Fitted:
    target: str
    model: object
    metrics: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    held_out: DataFrame | None = None  # predictions on the test split


def training_frame(obs: DataFrame, date_col: str = "Datetime") -> DataFrame:
    """Base frame: date, temperatures, precipitation, rain flag and calendar features."""
    base = obs.select(
        "ClimateID",
        F.col(date_col).cast("date").alias("date"),
        F.col("MaxTempC").cast("double").alias("MaxTempC"),
        F.col("MinTempC").cast("double").alias("MinTempC"),
        F.col("TotalPrecipmm").cast("double").alias("TotalPrecipmm"),
    ).filter(F.col("date").isNotNull())
    return _with_features(base)


def _with_features(base: DataFrame) -> DataFrame:
    return calendar_features(base.withColumn("Rain", rain_flag(F.col("TotalPrecipmm")).cast("double")), "date")


def split_rows(frame: DataFrame) -> DataFrame:
    """The rows of a training frame with their ``split`` and ``fold``, to be stored for all models."""
    return _split(frame).select(*KEY, "split", "fold")


def stored_frame(rows: DataFrame) -> DataFrame:
    """The training frame behind stored ``split_rows``."""
    return _with_features(rows)


def _split(frame: DataFrame) -> DataFrame:
    """``frame`` with ``split`` and ``fold``; a stored one has them."""
    return frame if {"split", "fold"} <= set(frame.columns) else _folds(hash_split(frame, KEY, 80))


def _assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip")


def score_all(model: PipelineModel, df: DataFrame, cols: list[str]) -> DataFrame:
    """Predictions for every row; NULL where a feature is NULL (rows a model skips stay)."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    keeping = [s.copy().setHandleInvalid("keep") if isinstance(s, VectorAssembler) else s for s in model.stages]
    scored = strip_ml(PipelineModel(stages=keeping).transform(df))
    return scored.withColumn("prediction", F.when(whole, F.col("prediction")))


def fit_rain_classifier(frame: DataFrame) -> Fitted:
    """CLS1 + AGG14: balanced rain classifier (random forest defaults), AUC on the test split.

    The draw of the balanced rows is stored once.  The features are calendar
    values, so its rows are folded to one row per (split, features, label) with
    its weight; trees and AUC use the weights.  The held-out rows meet their
    cell's prediction by a join.
    """
    spark = frame.sparkSession
    rows = frame.filter(F.col("Rain").isNotNull()).drop("split", "fold")
    path = shared_dir(spark, "balanced")
    class_draw(rows, "Rain", KEY, SEED).filter("copies > 0").select("row.*", "n", "copies").write.parquet(path)
    split = hash_split(spark.read.parquet(path), KEY, 80)
    cells = split.groupBy("split", "Rain", *BASE_FEATURES).agg(F.sum("copies").cast("double").alias("weight")).checkpoint(eager=True)
    rf = RandomForestClassifier(labelCol="Rain", featuresCol="features", weightCol="weight", seed=SEED)
    assembler = _assembler(BASE_FEATURES)
    pipeline = PipelineModel(stages=[assembler, rf.fit(assembler.transform(cells.filter("split = 'train'")))])
    preds = pipeline.transform(cells.filter("split = 'test'"))
    auc = BinaryClassificationEvaluator(labelCol="Rain", rawPredictionCol="rawPrediction", weightCol="weight").evaluate(preds)
    known = strip_ml(preds).select(*BASE_FEATURES, "prediction").distinct()
    # one row per day
    held_out = replicate(split.filter("split = 'test'"), "copies", "n").join(F.broadcast(known), BASE_FEATURES).select(*KEY, "Rain", "prediction")
    return Fitted("Rain", pipeline, {"AUC": auc}, held_out=held_out)


def _folds(df: DataFrame) -> DataFrame:
    """Fold 0 to 2 of each row by a hash of its key: the same after a lost task."""
    return df.withColumn("fold", F.pmod(row_hash60([*[F.col(c) for c in KEY], F.lit(SEED + 2000)]), F.lit(FOLDS)).cast("int"))


def fold_rows(df: DataFrame, target: str, by: list[str]) -> DataFrame:
    """Sufficient statistics of ``target`` per cell: ``weight`` rows, their mean ``label``, sum and sum of squares."""
    y = F.col(target)
    cells = df.filter(y.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    return cells.withColumn("label", F.col("s") / F.col("weight"))


def folded_errors(preds: DataFrame) -> dict:
    """RMSE and R2 over the rows behind folded cells, exact: a cell's rows share one prediction."""
    p = F.col("prediction")
    row = preds.agg(
        F.sum("weight").alias("n"),
        F.sum(F.col("ss") - 2 * p * F.col("s") + p * p * F.col("weight")).alias("sse"),
        (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("weight")).alias("sst"),
    ).first()
    if not row["n"]:
        return {"RMSE": None, "R2": None, "n": 0}
    return {"RMSE": math.sqrt(max(row["sse"], 0.0) / row["n"]), "R2": 1 - row["sse"] / row["sst"] if row["sst"] else None, "n": int(row["n"])}


class FoldedRmse(Evaluator):
    """Cross-validation's measure over folded cells: the RMSE of the rows behind them."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return folded_errors(dataset)["RMSE"] or 0.0

    def isLargerBetter(self) -> bool:
        return False


def _cv_regressor(train: DataFrame, label: str, features: list[str], weight: str | None = None, parallelism: int = 6) -> tuple[PipelineModel, dict]:
    """REG1: random-forest regressor chosen by 3-fold CV (column ``fold``) over the grid (RMSE).
    With ``weight`` the rows are folded cells (``fold_rows``).

    ``parallelism`` of the 12 fits run at once, whatever their fold: a forest
    is many short jobs, one a level, that leave most cores idle when only the
    fits of one fold run (``CrossValidator``).
    """
    assembler = _assembler(features)
    rf = RandomForestRegressor(labelCol=label, featuresCol="features", seed=SEED)
    if weight:
        rf = rf.setWeightCol(weight)
    evaluator = FoldedRmse() if weight else RegressionEvaluator(labelCol=label, metricName="rmse")
    grid = ParamGridBuilder().addGrid(rf.numTrees, NUM_TREES).addGrid(rf.maxDepth, MAX_DEPTH).build()
    data = assembler.transform(train)
    folds = {r["fold"] for r in data.select("fold").distinct().collect()}  # at most FOLDS
    if folds != set(range(FOLDS)):
        raise ValueError(f"cross-validation needs rows in each of {FOLDS} folds; there are rows in {sorted(folds)}")

    def error(at: tuple[int, int]) -> float:
        k, fold = at
        model = rf.fit(data.filter(F.col("fold") != fold), grid[k])
        return evaluator.evaluate(model.transform(data.filter(F.col("fold") == fold)))

    runs = [(k, fold) for k in reversed(range(len(grid))) for fold in range(FOLDS)]  # the largest forests first
    with ThreadPoolExecutor(parallelism) as pool:
        # wrapped one by one: a wrapper holds the local properties of one thread
        errors = {at: found.result() for at, found in [(at, pool.submit(inheritable_thread_target(error), at)) for at in runs]}
    best = rf.fit(data, min(enumerate(grid), key=lambda g: sum(errors[g[0], fold] for fold in range(FOLDS)))[1])
    params = {"numTrees": best.getNumTrees, "maxDepth": best.getOrDefault("maxDepth")}
    return PipelineModel(stages=[assembler, best]), params


def quality(preds: DataFrame, label: str) -> dict:
    """AGG13 as a dict (one aggregate pass)."""
    row = regression_quality(preds, label, "prediction").first()
    return {"RMSE": row["rmse"], "MAE": row["mae"], "R2": row["r2"], "n": row["n"]}


def fit_temperature(frame: DataFrame, target: str) -> Fitted:
    """REG1 for MaxTempC / MinTempC on calendar features.

    All rows of a day have the same features, so the table is folded once to
    (split, fold, features) cells; cross-validation (12 fits and the refit)
    reads the cells alone, weighted by their rows.  Bagging draws cells.  RMSE
    and R2 come from the cells' sums, MAE from one more pass over the rows,
    which meet their cell's prediction by a join.
    """
    checkpoint_root(frame.sparkSession)
    split = _split(frame.filter(F.col(target).isNotNull()))
    cells = fold_rows(split, target, ["split", "fold", *BASE_FEATURES]).checkpoint(eager=True)
    model, params = _cv_regressor(cells.filter("split = 'train'"), "label", BASE_FEATURES, weight="weight")
    preds = strip_ml(model.transform(cells.filter("split = 'test'")))
    metrics = folded_errors(preds)
    known = preds.select(*BASE_FEATURES, "prediction").distinct()
    error = split.filter("split = 'test'").join(F.broadcast(known), BASE_FEATURES).agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]
    return Fitted(target, model, metrics | {"MAE": error}, params)


def bin_edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Inner edges of at most ``BINS`` bins of each feature, from one pass: a bin per value
    where there are few, else of about equal numbers of rows."""
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10 * QUANTILES).alias(c) for c in features]).first()
    edges = []
    for c in features:
        at = found[c] or [0.0]
        if len(set(at)) > BINS:
            at = [at[0], *(at[QUANTILES * k // BINS] for k in range(1, BINS))]
        edges.append(sorted(set(at))[1:])
    return edges


def binned(edges: list[list[float]], features: list[str]) -> Bucketizer:
    """Features to bin numbers ``bin_<feature>``."""
    # a feature of one value keeps one edge above it: Bucketizer asks for two bins
    splits = [[-math.inf, *(e or [math.nextafter(math.inf, 0)]), math.inf] for e in edges]
    return Bucketizer(splitsArray=splits, inputCols=features, outputCols=[f"bin_{c}" for c in features], handleInvalid="keep")


def fit_precipitation(frame: DataFrame, rain_model: PipelineModel | Callable[[], PipelineModel]) -> Fitted:
    """REG2: trained on rainy rows; evaluated on test rows predicted rainy and truly rainy.
    The rain model (or who gets it) is asked for the evaluation alone, day by day.

    A tree tells at most ``BINS`` bins of a feature apart, so all training rows
    are folded to (fold, bins) cells, whose number doesn't grow with the rows;
    cross-validation (12 fits and the refit) reads the cells, weighted by their
    rows.  Bagging draws cells.  The stored model bins what it scores; the test
    rows meet the prediction of their bins by a join.
    """
    checkpoint_root(frame.sparkSession)
    split = _split(frame.filter(F.col("TotalPrecipmm") > 0))
    for c in PRECIP_FEATURES:
        split = split.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    train = split.filter("split = 'train'")
    bins = binned(bin_edges(train, PRECIP_FEATURES), PRECIP_FEATURES)
    places = bins.getOutputCols()
    by = ["fold", *places]
    cells = fold_rows(bins.transform(train), "TotalPrecipmm", by).checkpoint(eager=True)
    parts = max(4, -(-cells.count() // CELLS))
    cells = cells.repartition(parts, *by).sortWithinPartitions(*by).checkpoint(eager=True)  # bagging draws in this order
    forest, params = _cv_regressor(cells, "label", places, weight="weight")
    model = PipelineModel(stages=[_assembler(PRECIP_FEATURES, "given_features"), bins, *forest.stages])
    test = split.filter("split = 'test'")
    rain = rain_model() if callable(rain_model) else rain_model
    days = rain.transform(test.select(*BASE_FEATURES).distinct()).filter(F.col("prediction") == 1).select(*BASE_FEATURES)
    rainy = bins.transform(test.join(F.broadcast(days), BASE_FEATURES, "left_semi")).select(*places, "TotalPrecipmm")
    known = forest.transform(rainy.select(*places).distinct()).select(*places, "prediction")
    metrics = quality(rainy.join(known, places), "TotalPrecipmm")
    return Fitted("TotalPrecipmm", model, metrics, params)


def strip_ml(df: DataFrame) -> DataFrame:
    """Drop the vector / probability / bin columns a model adds (keeps ``prediction``)."""
    return df.drop("features", "rawPrediction", "probability", "given_features", *[f"bin_{c}" for c in PRECIP_FEATURES])


def score_as(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Score every row with ``model`` and keep only its prediction, renamed to ``name``."""
    return score_all(model, df, model.stages[0].getInputCols()).withColumnRenamed("prediction", name)


def forecast_frame(calendar: DataFrame, rain: PipelineModel, tmax: PipelineModel, tmin: PipelineModel,
                   precip: PipelineModel, additive) -> DataFrame:
    """FOR2 + FOR4-FOR6: calendar -> Rain, MaxTempC, MinTempC -> precipitation from the
    predicted temperatures, and from the additive model with the predicted rain ->
    both gated by the rain prediction.  One frame, a chain of transforms."""
    cal = calendar_features(calendar.select("date"), "date")
    f = score_as(rain, cal, "Rain_predicted")
    f = score_as(tmax, f, "MaxTempC_predicted")
    f = score_as(tmin, f, "MinTempC_predicted")
    f = f.withColumns({"MaxTempC": F.col("MaxTempC_predicted"), "MinTempC": F.col("MinTempC_predicted")})
    f = score_as(precip, f, "TotalPrecipmm_predicted").drop("MaxTempC", "MinTempC")
    f = additive(f.withColumns({"ds": F.col("date"), "Rain": F.col("Rain_predicted")})).withColumnRenamed("yhat", "PrecipitationM2_predicted")
    return rain_gate(f).select(
        "date",
        F.lit("all").alias("ClimateID"),  # PRJ10: one forecast for all stations
        "Rain_predicted", "MaxTempC_predicted", "MinTempC_predicted",
        "TotalPrecipmm_predicted", "TotalPrecipmm_predictedRain",
        "PrecipitationM2_predicted", "PrecipitationM2_predictedRain",
    )


def rain_gate(forecast: DataFrame) -> DataFrame:
    """FOR6 / PRJ11: precipitation predictions multiplied by the rain prediction."""
    rain = F.col("Rain_predicted")
    return forecast.withColumns(
        {
            "TotalPrecipmm_predictedRain": F.col("TotalPrecipmm_predicted") * rain,
            "PrecipitationM2_predictedRain": F.col("PrecipitationM2_predicted") * rain,
        }
    )


def forecast_statistics(forecast: DataFrame, before: str = "2024-01-01") -> DataFrame:
    """FOR8: describe of all columns of the forecast for days before ``before`` (a date range, pushable)."""
    from stratus.operators.stats import describe_all

    return describe_all(forecast.filter(F.col("date") < F.lit(before).cast("date")))


def predicted_vs_real(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """EVL1 / JON6: forecast beside the real values of the same day (inner join on
    the date, not by position); gated precipitation on the forecast side."""
    real = history.groupBy(F.col("Datetime").alias("date")).agg(
        F.avg("MaxTempC").alias("MaxTempC"),
        F.avg("MinTempC").alias("MinTempC"),
        F.avg("TotalPrecipmm").alias("TotalPrecipmm"),
    )
    return forecast.join(real, "date", "inner")
