"""Structured Streaming for live readings (STR1-STR5, SNK7).

* STR1 ``ingest_stream``: new JSON snapshot files -> flattened readings ->
  appended parquet table; the file source's checkpoint makes a replayed
  file count once.
* STR2 ``latest_state_stream``: latest reading per city kept as streaming
  state (one ``max(struct(time, ...))`` per city: state bounded by the
  number of cities, so no watermark is needed); each trigger merges the
  changed cities into a new version of the table.
* STR3-5 ``alert_stream``: per micro-batch, absolute or deviation alerts
  appended to an alert table partitioned by batch id; a replayed batch
  overwrites its own partition instead of adding duplicates (idempotent
  ``foreachBatch``).  The history is summed to station days once per start,
  into a bucketed table that no micro-batch shuffles; its distinct rows are written
  once, as columns, and an alert's evidence text is folded from them on read.
* SNK7: the sink is a ``format`` parameter of ``foreachBatch`` writers.

Landing helpers write the driver's ``events`` table as nested live JSON
documents, so the streams can be checked against the batch operators.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.operators import live as L
from stratus.schema import LIVE_JSON
from stratus.session import shared_dir
from stratus.sources.ingest import flatten_live


def events_as_documents(events: DataFrame) -> DataFrame:
    """``events`` rows as nested current-weather documents (``rain`` only on
    'error' events; elsewhere the field is absent, as in the live service)."""
    return events.select(
        F.col("user_id").cast("string").alias("name"),
        F.struct(
            F.col("value").alias("temp"),
            F.round(F.col("value") - F.lit(1.0), 2).alias("temp_min"),
            F.round(F.col("value") + F.lit(1.0), 2).alias("temp_max"),
            F.get_json_object("props", "$.k").try_cast("bigint").alias("humidity"),
            F.col("event_id").alias("pressure"),
        ).alias("main"),
        F.array(F.struct(F.col("event_type").alias("description"))).alias("weather"),
        F.when(F.col("event_type") == "error", F.struct(F.lit(1.0).alias("1h"))).alias("rain"),
        F.col("ts").cast("timestamp_ntz").cast("string").alias("observed_at"),  # no time-zone shift
    )


def land_documents(docs: DataFrame, folder: str, files: int | None = None, mode: str = "overwrite") -> str:
    """Write documents as JSON files, one per task (``files`` tasks if given);
    ``mode="append"`` adds new files next to already-landed ones."""
    (docs.repartition(files) if files else docs).write.mode(mode).json(folder)
    return folder


def read_live_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """STR1 source: JSON snapshot files with a fixed schema, flattened.
    ``files_per_trigger`` bounds a micro-batch; by default a trigger takes all new files."""
    raw = spark.readStream.schema(LIVE_JSON)
    if files_per_trigger:
        raw = raw.option("maxFilesPerTrigger", files_per_trigger)
    return flatten_live(raw.json(folder))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "parquet",
                  files_per_trigger: int | None = None):
    """STR1 + SNK7: append flattened readings to ``target`` until the landed files are consumed."""
    q = (
        read_live_stream(spark, source, files_per_trigger)
        .writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def latest_state_stream(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "parquet",
                        files_per_trigger: int | None = None):
    """STR2: per-city latest reading as streaming state, in update mode.

    Each trigger merges the changed cities with the last version of the table
    and writes version ``batch_id`` beside it; readers take the newest whole
    version (``read_latest``), so there is always one to read, and a replayed
    batch writes its own version again.  The version before the last is kept
    for readers under way, older ones are deleted.
    """
    state = L.latest_per_city(read_live_stream(spark, source, files_per_trigger))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # used on both sides below; the stateful plan runs once
        try:
            merge(batch, batch_id)
        finally:
            batch.unpersist()

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = [v for v in versions(spark, target) if v < batch_id]
        out = batch
        if known:
            old = spark.read.format(fmt).load(f"{target}/v={known[-1]}")
            out = old.join(batch, old["City"].eqNullSafe(batch["City"]), "left_anti").unionByName(batch)
        out.write.format(fmt).mode("overwrite").save(f"{target}/v={batch_id}")
        for v in known[:-1]:
            _path(spark, target)[1].delete(_path(spark, f"{target}/v={v}")[0], True)

    q = (
        state.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def _path(spark: SparkSession, text: str):
    """Hadoop path of ``text`` and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, target: str) -> list[int]:
    """Whole versions below ``target`` (those whose writer has committed), ascending."""
    path, fs = _path(spark, target)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_path(spark, f"{target}/{n}/_SUCCESS")[0]))


def read_latest(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """The newest whole version written by ``latest_state_stream``."""
    return spark.read.format(fmt).load(f"{target}/v={versions(spark, target)[-1]}")


def alert_batches(batch: DataFrame, threshold: float, days: DataFrame | None, years: int = 10) -> DataFrame:
    """STR3-5 on one micro-batch: absolute (no station days) or deviation alerts."""
    if days is None:
        return L.alert_records(L.absolute_alert(batch, threshold))
    return L.alert_records(L.deviation_from_days(batch, days, threshold, years), extra=["normal", "deviation"])


def alert_schema(deviation: bool) -> str:
    """Columns of the alert table, so that it can be read before any alert was written."""
    base = "City string, ObservationTime timestamp_ntz, currentTemp decimal(10,2), text string, go int"
    return base + (", normal double, deviation double, start string, years int" if deviation else "") + ", audit timestamp, batch_id bigint"


def read_alerts(spark: SparkSession, target: str, deviation: bool = False, fmt: str = "parquet") -> DataFrame:
    """The alert table; empty where no alert was written.

    Deviation alerts refer to the rows of history that their stream wrote
    when it started; the evidence text is folded here, for the alerts' days.
    """
    path, fs = _path(spark, target)
    if not fs.exists(path):
        return spark.createDataFrame([], alert_schema(deviation)).drop("start", "years")
    alerts = spark.read.format(fmt).schema(alert_schema(deviation)).load(target)
    if not deviation:
        return alerts
    parts = []
    for row in alerts.select("start", "years").distinct().collect():  # one per start of the stream
        some = alerts.filter(F.col("start") == row["start"])
        told = L.with_evidence(some, spark.read.parquet(f"{target}-history/{row['start']}"), row["years"])
        text = F.concat(F.lit('{"current": '), F.col("text"), F.lit(', "history": '), F.coalesce("history", F.lit("[]")), F.lit("}"))
        parts.append(told.withColumn("text", text).select(alerts.columns).drop("start", "years"))
    return reduce(DataFrame.unionByName, parts) if parts else alerts.drop("start", "years")


def bucketed_days(spark: SparkSession, history: DataFrame, path: str) -> str:
    """Station days as a table in buckets of station, month and day of month: a join
    of readings with their calendar days takes them as they lie.  Returns its name."""
    name = f"stratus_days_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["ClimateID", "_m", "_d"]
    days = L.station_days(history).repartition(buckets, *place)
    days.write.bucketBy(buckets, *place).sortBy(*place).option("path", path).saveAsTable(name)
    return name


def alert_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, threshold: float = 5.0,
    history: DataFrame | None = None, fmt: str = "parquet", years: int = 10, files_per_trigger: int | None = None,
):
    """STR3-STR5 + SNK7: alerts appended per micro-batch with their audit time, idempotent by batch id.

    In deviation mode the history is summed to station days once, when the
    stream starts, into a bucketed table that no micro-batch shuffles, and its
    distinct rows are written with their counts beside the alerts
    (``<target>-history``), to which the alerts refer by ``start`` (and
    ``years``, the evidence's span).
    """
    name, start = None, uuid.uuid4().hex[:12]
    if history is not None:
        name = bucketed_days(spark, history, shared_dir(spark, "station-days"))
        L.history_lines(history).write.parquet(f"{target}-history/{start}")

    def write(batch: DataFrame, batch_id: int) -> None:
        # the table of the batch's own session: the stream runs in a copy of the caller's
        days = batch.sparkSession.table(name) if name else None
        out = alert_batches(batch, threshold, days, years)
        out = out.withColumns({"start": F.lit(start), "years": F.lit(years)}) if name else out
        (
            out.withColumns({"audit": F.current_timestamp(), "batch_id": F.lit(batch_id)})
            .write.format(fmt)
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .save(target)
        )

    q = (
        read_live_stream(spark, source, files_per_trigger)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return q


def replay_events(spark: SparkSession, events: DataFrame, name: str) -> dict[str, str]:
    """Fresh folders under the shared checkpoint folder, with ``events`` landed as documents."""
    base = shared_dir(spark, name)
    paths = {k: f"{base}/{k}" for k in ("landing", "table", "checkpoint")}
    land_documents(events_as_documents(events), paths["landing"])
    return paths
