"""Training-run tracking as tables (RUN1-RUN5), in place of a tracking server.

Runs are appended to a long table ``model_runs(run_id, target, metric,
value, ts)``; the per-target metric table is a pivot of it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions.indexing import sequential_index
from stratus.ml.models import Fitted
from stratus.operators.sampling import concat_frames, drop_incomplete

METRIC_NAMES = ["RMSE", "R2", "MAE"]
RUN_SCHEMA = "run_id string, target string, metric string, value double, ts timestamp"


def run_rows(spark: SparkSession, target: str, params: dict, metrics: dict, run_id: str | None = None) -> DataFrame:
    """RUN1: one run's params and metrics as rows (params are stored as metrics
    named ``param.<name>`` with a numeric value when they have one)."""
    run_id = run_id or uuid.uuid4().hex
    ts = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, target, k, float(v), ts) for k, v in metrics.items()]
    for k, v in params.items():
        try:
            rows.append((run_id, target, f"param.{k}", float(v), ts))
        except (TypeError, ValueError):
            continue
    return spark.createDataFrame(rows, RUN_SCHEMA)


def log_run(spark: SparkSession, path: str, target: str, params: dict, metrics: dict) -> str:
    """RUN1: append a run to the ``model_runs`` parquet table at ``path``."""
    run_id = uuid.uuid4().hex
    run_rows(spark, target, params, metrics, run_id).write.mode("append").parquet(path)
    return run_id


def metric_table(runs: DataFrame) -> DataFrame:
    """RUN2: one row per (run, target) with RMSE / R2 / MAE and the run's first
    time; a metric logged twice counts by its last time; incomplete runs
    dropped.  One aggregate, one shuffle."""
    last = [F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.struct("ts", "value"))).alias(m) for m in METRIC_NAMES]
    wide = runs.groupBy("run_id", "target").agg(*last, F.min("ts").alias("ts"))
    return drop_incomplete(wide, METRIC_NAMES)


def metric_evolution(runs: DataFrame) -> DataFrame:
    """RUN3 + RUN4: per target, runs numbered by time (``index``), with their metrics."""
    table = metric_table(runs)
    return sequential_index(table, ["target"], ["ts", "run_id"], "index")


def union_targets(frames: list[DataFrame]) -> DataFrame:
    """RUN3: per-target tables put together; columns a frame lacks are NULL."""
    return concat_frames(frames)


def save_model(model, path: str) -> str:
    """RUN5: persist the best model (Spark ML writer, overwrite)."""
    model.write().overwrite().save(path)
    return path


def _file_system(spark: SparkSession, path: str):
    """Spark's own client of the store that holds ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_made(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at(path))


def made_once(spark: SparkSession, path: str, make: Callable[[str], None]) -> str:
    """``path``, made by ``make(folder)`` if it isn't there yet.

    It is made in a folder beside it that gets its name when it is whole, so a
    reader never sees a part of it and a failed maker leaves none.
    """
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        draft = f"{path}-{uuid.uuid4().hex[:12]}"
        make(draft)
        if not fs.exists(at(path)):
            fs.rename(at(draft), at(path))
    return path


def save_fitted(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """RUN5: the model by the ML writer, its parameters, metrics and held-out predictions beside it."""
    save_model(fitted.model, f"{path}/model")
    facts = json.dumps({"target": fitted.target, "params": fitted.params, "metrics": fitted.metrics})
    spark.range(1).select(F.lit(facts).alias("value")).coalesce(1).write.text(f"{path}/facts")
    if fitted.held_out is not None:
        fitted.held_out.write.parquet(f"{path}/held_out")


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    """What ``save_fitted`` wrote, ready to score."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    fs, at = _file_system(spark, path)
    held_out = spark.read.parquet(f"{path}/held_out") if fs.exists(at(f"{path}/held_out")) else None
    return Fitted(facts["target"], PipelineModel.load(f"{path}/model"), facts["metrics"], facts["params"], held_out)


def fitted_once(spark: SparkSession, path: str, fit: Callable[[], Fitted]) -> Fitted:
    """The model stored at ``path``; it is fitted and stored by the first who asks."""
    return load_fitted(spark, made_once(spark, path, lambda draft: save_fitted(spark, fit(), draft)))


def table_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored at ``path``; it is made and stored by the first who asks."""
    return spark.read.parquet(made_once(spark, path, lambda draft: make().write.parquet(draft)))
