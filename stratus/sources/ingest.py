"""Sources and sinks (SRC1-SRC11, SNK1-SNK7).

The reference fetches from web services on the driver and lands one file
per page; here every loader starts from landed files and reads all of them
in one distributed scan (no per-file driver loop).  Table format is a
parameter: Parquet by default; Delta works where its package is installed.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.functions.columns import col_of
from stratus.operators.clean import drop_header_rows, retype, sanitize_columns
from stratus.operators.sampling import concat_frames
from stratus.schema import API_STATION, LIVE_JSON
from stratus.session import checkpoint_root
from stratus.sources.views import CSV_HEADERS


# ------------------------------------------------------------------ sources
API_PAGE = "results array<struct<date: string, value: double, station: string, datatype: string, attributes: string>>"


def load_api_pages(spark: SparkSession, path: str | Iterable[str], multi_line: bool = True, schema: str = API_PAGE) -> DataFrame:
    """SRC1 + SRC2: landed API page documents ``{results: [...]}`` -> one row per
    result, with ``years``/``months`` from the ISO ``date``.  A page without
    ``results`` contributes nothing.  ``multi_line=False`` reads one page per
    line (JSON Lines).  The stated ``schema`` saves an inference pass and keeps
    types the same from batch to batch; a field a page lacks is NULL."""
    paths = [path] if isinstance(path, str) else list(path)
    pages = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(paths)
    return with_year_month(pages.select(F.inline("results")), "date")


def iso_day(text: Column) -> Column:
    """Day of an ISO date or date-time text; NULL for anything else."""
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), day)


def with_year_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """SRC2: ``years`` and ``months`` of an ISO date text."""
    d = iso_day(F.col(date_col).cast("string"))
    return df.withColumns({"years": F.year(d), "months": F.month(d)})


def load_station_catalogue(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC3: station catalogue JSON with an explicit all-string schema."""
    return spark.read.schema(API_STATION).option("multiLine", str(multi_line).lower()).json(path)


NULL_MARK = "\\N"


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, header)``: the first line of every file.

    A task reads one split of one file and stops after its first line, so of a
    long file a buffer is read, not the whole.
    """

    def head(parts):
        for part in parts:
            if part.num_rows:
                yield part.slice(0, 1)
                return

    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("header"))
    # a split counts as a full partition: no two share a task; one row a batch: no more lines are read than asked for
    held = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        checkpoint_root(spark)
        return lines.mapInArrow(head, "file string, start long, header string").filter("start = 0").select("file", "header").checkpoint(eager=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def load_daily_csv(spark: SparkSession, paths: str | Iterable[str], sanitize: bool = True,
                   null_value: str = NULL_MARK) -> DataFrame:
    """SRC4 (+PRJ2): daily climate CSV files, header row, every column a
    string; names cleaned of symbols.

    Each file is read by its own header: files are grouped by their header
    line (``first_lines``), one scan per distinct header, and united by name; a column that a
    file lacks is NULL there.  An empty field stays the empty string (as a CSV
    dictionary reader gives it), so the blank rules of the cleaning step apply;
    only ``null_value`` text reads as NULL.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = first_lines(spark, paths).groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # file names, one list per header
    frames = []
    for group in sorted(groups, key=lambda g: g["header"]):
        names = next(csv.reader([group["header"].lstrip("\ufeff")]))
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        files = [unquote(f) for f in sorted(group["files"])]
        frames.append(spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("escape", '"').csv(files))
    if not frames:
        raise ValueError("no CSV files to read")
    # Spark's reader gives NULL for an empty field
    frames = [f.select(*[F.when(col_of(c) == null_value, None).otherwise(F.coalesce(col_of(c), F.lit(""))).alias(c) for c in f.columns]) for f in frames]
    if sanitize:
        frames = [sanitize_columns(f) for f in frames]
    return concat_frames(frames)


def load_partitioned(
    spark: SparkSession, root: str, years: tuple[int, int] | None = None, months: tuple[int, int] | None = None,
    year_col: str = "Year", month_col: str = "Month",
) -> DataFrame:
    """SRC5: one scan of a ``Year=/Month=`` tree; the ranges become partition
    filters (pruned folders), instead of one read per folder."""
    df = spark.read.parquet(root)
    if years:
        df = df.filter(F.col(year_col).between(*years))
    if months:
        df = df.filter(F.col(month_col).between(*months))
    return df


def load_days(tree: DataFrame, dates: DataFrame, date_col: str = "Datetime", year_col: str = "Year", month_col: str = "Month") -> DataFrame:
    """SRC5 + JON2: rows of a ``Year=/Month=`` tree on the days of ``dates`` (date, year, month).

    The folder columns stand in the join beside the day, so the folders to
    read follow from the dimension's rows at run time (dynamic partition pruning).
    """
    days = dates.select(F.col("date").alias("_date"), F.col("year").alias("_year"), F.col("month").alias("_month"))
    on = (F.col(date_col) == F.col("_date")) & (F.col(year_col) == F.col("_year")) & (F.col(month_col) == F.col("_month"))
    return tree.join(days, on).drop("_date", "_year", "_month")


def load_parquet_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: a single parquet part file."""
    return spark.read.parquet(path)


def flatten_live(df: DataFrame) -> DataFrame:
    """SRC8: nested current-weather documents -> the nine live columns.

    First ``weather`` element gives the description; a missing ``rain.1h``
    gives 0.  The time is ``observed_at``, or ``dt`` (epoch seconds) where that
    is absent or no time; NULL where neither is.
    """
    seconds = F.timestamp_seconds("dt")
    utc = F.to_utc_timestamp(seconds, F.current_timezone()).cast("timestamp_ntz")
    return df.select(
        F.col("name").alias("City"),
        F.col("main.temp").cast("double").alias("Temperature"),
        F.col("main.temp_min").cast("double").alias("TemperatureMin"),
        F.col("main.temp_max").cast("double").alias("TemperatureMax"),
        F.col("main.humidity").cast("long").alias("Humidity"),
        F.col("main.pressure").cast("long").alias("Pressure"),
        F.get(F.col("weather"), 0).getField("description").alias("Description"),
        F.coalesce(F.col("observed_at").try_cast("timestamp_ntz"), utc).alias("ObservationTime"),
        F.coalesce(F.col("rain").getField("1h").cast("double"), F.lit(0.0)).alias("Rain"),
    )


def load_live_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC8 batch form: landed live JSON documents, flattened."""
    return flatten_live(spark.read.schema(LIVE_JSON).json(path))


def load_headerless_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """SRC9: CSV read with ``header=False``; columns are ``_c0``.. (of ``width``, or of Spark's first file)."""
    reader = spark.read.option("header", "false")
    if width:
        reader = reader.schema(", ".join(f"_c{i} string" for i in range(width)))
    return reader.csv(path)


# Places of the used columns in the external file, from 0 (fixed values).
CSV_PLACES = {"Station": 2, "Date": 4, "Max Temp": 9, "Min Temp": 11, "Heat Deg Days": 15, "Total Precip (mm)": 23}
CSV_WIDTH = 26
CSV_TYPES = {
    "Date": "date",
    "Max Temp": "double",
    "Min Temp": "double",
    "Heat Deg Days": "double",
    "Total Precip (mm)": "double",
}


def clean_headerless_csv(df: DataFrame) -> DataFrame:
    """SRC9 + FLT7 + PRJ3 + PRJ12: drop repeated header lines (those whose
    precipitation column holds its header; NULLs kept), name the positional
    columns, type them (bad text -> NULL)."""
    precip = CSV_PLACES["Total Precip (mm)"]
    kept = drop_header_rows(df, {f"_c{precip}": CSV_HEADERS[precip]})
    named = kept.select([col_of(f"_c{i}").alias(n) for n, i in CSV_PLACES.items()])
    return retype(named, CSV_TYPES)


def land_csv(df: DataFrame, path: str, null_value: str = NULL_MARK, header: bool = True, mode: str = "overwrite") -> str:
    """Write rows as CSV files exactly (blanks and spaces kept, NULL as ``null_value``), one per task."""
    (
        df.write.mode(mode)
        .option("header", str(header).lower())
        .option("nullValue", null_value)
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )
    return path


def land_api_pages(rows: DataFrame, path: str, page_key: str, page_size: int = 1000) -> str:
    """Write rows as API page documents ``{"results": [...]}`` of at most
    ``page_size`` results, pages keyed by ``floor(page_key / page_size)`` of a
    dense integer key (so no page grows with the data)."""
    page = F.floor(F.col(page_key) / F.lit(page_size))
    docs = rows.groupBy(page.alias("page")).agg(
        F.collect_list(F.struct(*[c for c in rows.columns if c != page_key])).alias("results")
    )
    docs.select("results").write.mode("overwrite").json(path)
    return path


def literal_rows(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """SRC10: literal rows with a schema."""
    return spark.createDataFrame(rows, schema)


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """SRC11: a ``take n`` look at a table (a sample is the feature here)."""
    return df.limit(n)


# -------------------------------------------------------------------- sinks
def append_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """SNK1 / SNK2: append, partitioned by ``by``.

    ``REBALANCE`` clusters rows by the partition columns and lets AQE split a
    hot folder over as many tasks as its size asks for and merge small ones:
    few files per folder, no bound on a folder's writers.
    ``maxRecordsPerFile`` bounds file size in place of optimize-write bins.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in by])
        .write.format(fmt)
        .mode("append")
        .option("maxRecordsPerFile", 5_000_000)
        .partitionBy(*by)
        .save(path)
    )


def append_files(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK3: append, unpartitioned."""
    df.write.format(fmt).mode("append").save(path)


def overwrite_path(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK4: overwrite a table by path."""
    df.write.format(fmt).mode("overwrite").save(path)


def append_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """SNK5: append to a managed table."""
    df.write.format(fmt).mode("append").saveAsTable(name)


def publish_table(df: DataFrame, name: str, folder: str | None = None, fmt: str = "parquet") -> None:
    """``df`` as the new content of the named table, whatever its schema.

    The rows are written to a table beside it, then the name, a view, is turned
    to it in one step of the catalog: readers by name see the old table or the
    new one, and a failed writer changes nothing.  The table before stays for
    readers under way, older ones are dropped.  ``folder`` is where the files
    go (default: the warehouse).
    """
    spark = df.sparkSession
    version = f"{name}__{uuid.uuid4().hex[:12]}"
    before = spark.catalog.getTable(name).description if spark.catalog.tableExists(name) else None
    writer = df.write.format(fmt)
    (writer.option("path", f"{folder}/{version}") if folder else writer).saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} COMMENT '{version}' AS SELECT * FROM {version}")
    for t in spark.catalog.listTables():
        if t.name.startswith(f"{name}__") and t.name not in (version, before):
            spark.sql(f"DROP TABLE {t.name}")


def rewrite_table(spark: SparkSession, name: str, fn: Callable[[DataFrame], DataFrame], folder: str | None = None, fmt: str = "parquet") -> DataFrame:
    """SNK6: rewrite a named table with a changed schema, in place for all who read it by name."""
    publish_table(fn(spark.table(name)), name, folder, fmt)
    return spark.table(name)


def rewrite_with_column(spark: SparkSession, source_path: str, target_path: str, fn, fmt: str = "parquet") -> DataFrame:
    """SNK6: rewrite a table with a changed schema.

    By path: a Parquet table cannot overwrite itself while being read, so the
    result goes to a new path (``rewrite_table`` swaps by name); Delta's
    overwriteSchema does the same in place where available.
    """
    out = fn(spark.read.format(fmt).load(source_path))
    out.write.format(fmt).mode("overwrite").option("overwriteSchema", "true").save(target_path)
    return spark.read.format(fmt).load(target_path)
