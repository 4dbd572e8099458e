"""Session construction and the shared scratch folder.

Settings here are the ones that matter at scale:

* AQE on, with partition coalescing and skew-join splitting, so the
  shuffle-partition count can be sized for the largest stage and a hot key
  (one station holding a third of all rows) is split at run time.
* Broadcast joins are left to Spark's own size check
  (``spark.sql.autoBroadcastJoinThreshold`` plus AQE's runtime statistics);
  the library never forces a broadcast of a side whose size grows with data.
* Lineage is cut only through ``spark.checkpoint.dir`` (a shared folder on a
  cluster); a private folder is created only when the session has none, as
  in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Runtime SQL settings every stratus job relies on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    master: str | None = None,
    app: str = "stratus",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with stratus' settings; UI stays off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(RUNTIME_CONF)
    conf.update(
        {
            "spark.ui.enabled": "false",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
            "spark.ui.showConsoleProgress": "false",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            "spark.sql.session.timeZone": "UTC",
            "spark.driver.memory": os.environ.get("STRATUS_DRIVER_MEMORY", "16g"),
        }
    )
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply stratus' runtime SQL settings to an existing session and make the
    package importable by the executors' Python workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the ``stratus`` sources to the executors once per application
    (what ``spark-submit --py-files`` does), so Arrow UDFs defined in the
    package deserialize on any worker, whatever its working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    archive = os.path.join(tempfile.mkdtemp(prefix="stratus-pyfiles-"), "stratus.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def size_for_input(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Size shuffles for an input of ``input_bytes``.

    Sets ``spark.sql.shuffle.partitions`` so the largest shuffle (at most the
    input size) gets ~``partition_bytes`` per partition, with scan splits and
    AQE's advisory size matched to it; AQE then coalesces the smaller
    shuffles.  100 TB at 256 MiB gives ~400,000; a larger ``partition_bytes``
    gives fewer.
    """
    n = max(spark.sparkContext.defaultParallelism, -(-input_bytes // partition_bytes))
    for key, value in {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
    }.items():
        spark.conf.set(key, value)
    return n


def input_bytes(spark: SparkSession, root: str) -> int:
    """Size of all files below ``root``, asked of the file system by Spark's own client."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def table_state(spark: SparkSession, root: str) -> tuple:
    """Names, sizes and times of the files at ``root``: changes when the table does."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)))


def raise_shuffles(spark: SparkSession, root: str, partition_bytes: int = 256 << 20) -> int:
    """At least one shuffle partition per ``partition_bytes`` of the tables at
    ``root``; a larger setting of the session stays.  AQE coalesces what a
    small stage doesn't need, but can't split an aggregate's partitions, so
    the count must follow the input."""
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    need = -(-input_bytes(spark, root) // partition_bytes)
    if need > now:
        spark.conf.set("spark.sql.shuffle.partitions", str(need))
    return max(now, need)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session without one gets a private folder: on a cluster each
    executor would write to its own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratus-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job."""
    return f"{checkpoint_root(spark)}/stratus/{name}-{uuid.uuid4().hex[:12]}"
