"""Live readings: latest cards, per-city state, alerts and history comparison.

JON5 / AGG7-9 / STR2 / STR3 / JON7 / FLT8 / AGG6.

"Latest" is found with aggregates only: the global latest time is a scalar
subquery (one value, no join); the latest row per city is ``max`` over a
struct led by the time, which Spark combines map-side, so a city holding a
third of all readings never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.functions.columns import json_array, same_calendar_day

TIME = "ObservationTime"
CARD_SUMS = ["Temperature", "Rain", "Humidity", "TemperatureMin", "TemperatureMax", "Pressure"]


def latest_time(df: DataFrame, time_col: str = TIME) -> Column:
    """SRT1: the top-1 time, as a scalar subquery."""
    return df.select(F.max(time_col)).scalar()


def latest_rows(df: DataFrame, time_col: str = TIME) -> DataFrame:
    """JON5: rows whose time equals the latest time (ties all kept)."""
    return df.filter(F.col(time_col) == latest_time(df, time_col))


def sort_by_aggregate(df: DataFrame, col: str, direction: int = 2) -> DataFrame:
    """SRT2: a visual's sort on its aggregate; direction 2 = descending, 1 = ascending."""
    return df.orderBy(F.col(col).desc() if direction == 2 else F.col(col).asc())


def latest_cards(df: DataFrame, time_col: str = TIME) -> DataFrame:
    """AGG7-9 in one pass: sums over the latest row(s); min City and max
    Description over all rows (as the report's unfiltered cards do); plus the
    description of the latest reading itself (``max_by``, our addition).

    The latest time is one scalar subquery, projected once into a flag
    column, so the table is scanned twice in total (max, then the cards).
    """
    flagged = df.withColumn("_latest", F.col(time_col) == latest_time(df, time_col))
    is_latest = F.col("_latest")
    sums = [
        F.sum(F.when(is_latest, F.col(c))).alias(f"card_{c.lower()}") for c in CARD_SUMS
    ]
    return flagged.agg(
        *sums,
        F.min(F.when(is_latest, F.col(time_col))).alias("card_time"),
        F.min("City").alias("card_city"),
        F.max("Description").alias("card_description"),
        F.max(F.when(is_latest, F.col("Description"))).alias("latest_description"),
    )


def latest_per_city(df: DataFrame, cols: list[str] | None = None, time_col: str = TIME) -> DataFrame:
    """STR2 (batch form): the latest reading of each city.

    ``max(struct(time, ...))`` picks the latest row; equal times are broken
    by the following fields, so the result is deterministic.  This is the
    same aggregate the streaming version keeps as state.
    """
    cols = cols or ["Temperature", "TemperatureMin", "TemperatureMax", "Humidity", "Pressure", "Description", "Rain"]
    latest = F.max(F.struct(F.col(time_col), *[F.col(c) for c in cols])).alias("_l")
    return df.groupBy("City").agg(latest).select(
        "City", F.col(f"_l.{time_col}").alias(time_col), *[F.col(f"_l.{c}").alias(c) for c in cols]
    )


def absolute_alert(df: DataFrame, threshold: float = 5.0, temp_col: str = "Temperature") -> DataFrame:
    """STR3 absolute mode: readings at or above ``threshold``."""
    return df.filter(F.col(temp_col) >= F.lit(threshold))


def alert_records(
    df: DataFrame, temp_col: str = "Temperature", time_col: str = TIME, extra: list[str] | None = None
) -> DataFrame:
    """STR4 / STR5: alert rows with decimal(10,2) temperature, the evidence
    JSON of the reading (time, rain, temperature) and the pipeline flag
    ``go``; ``extra`` columns (e.g. normal, deviation) are carried along.
    With a ``history`` column the evidence holds the current reading and the
    history both."""
    current = F.to_json(F.struct(F.col(time_col).cast("timestamp_ntz").cast("string").alias(time_col), F.col("Rain"), F.col(temp_col)))
    evidence = current
    if "history" in df.columns:
        evidence = F.concat(F.lit('{"current": '), current, F.lit(', "history": '), F.coalesce("history", F.lit("[]")), F.lit("}"))
    return df.select(
        "City",
        F.col(time_col),
        F.col(temp_col).cast("decimal(10,2)").alias("currentTemp"),
        evidence.alias("text"),
        F.lit(1).alias("go"),
        *(extra or []),
    )


def same_day_history(
    history: DataFrame, as_of: str, years: int = 10, station: str | None = None, date_col: str = "Datetime"
) -> DataFrame:
    """FLT8: history rows on the calendar day of ``as_of`` in the last ``years`` years."""
    out = history.filter(same_calendar_day(F.col(date_col), as_of, years))
    if station is not None:
        out = out.filter(F.col("ClimateID") == station)
    return out


#: Distinct history rows of one page, about: a station-day with more has several pages.
PAGE_ROWS = 1000


def station_days(history: DataFrame, value_col: str = "MaxTempC", date_col: str = "Datetime") -> DataFrame:
    """Per station and day: sum and count of the value; ``_m`` and ``_d`` are its month and day of month."""
    days = history.groupBy(F.col("ClimateID"), F.col(date_col).alias("day")).agg(F.sum(value_col).alias("_s"), F.count(value_col).alias("_n"))
    return days.withColumns({"_m": F.month("day"), "_d": F.dayofmonth("day")})


def history_lines(history: DataFrame, cols: list[str] | None = None, key: str = "ClimateID", date_col: str = "Datetime") -> DataFrame:
    """The distinct history rows with their counts, in lists of one: ``(ClimateID, day, lines)``.

    ``line`` holds the row's columns as they are: they shuffle and store in a
    fraction of their JSON text, which who reads the evidence makes.  Equal
    rows are counted map-side.
    """
    names = cols or history.columns
    # equal numbers group as one: which zeros of a row are negative is kept beside it
    floats = {f.name: k for k, f in enumerate(f for f in history.schema.fields if f.name in names and f.dataType.typeName() in ("double", "float"))}
    minus = F.filter(F.array(*[F.when((F.col(f"`{c}`") == 0) & (F.col(f"`{c}`").cast("string") == "-0.0"), F.lit(k)) for c, k in floats.items()]).cast("array<int>"), lambda k: k.isNotNull())
    lines = history.select(F.col(key).alias("ClimateID"), F.col(date_col).alias("day"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("line"), minus.alias("minus"))
    lines = lines.groupBy("ClimateID", "day", "line", "minus").agg(F.count(F.lit(1)).alias("n"))
    given = {c: F.col("line")[c] for c in names}
    shown = {c: F.when(F.array_contains("minus", floats[c]), -v).otherwise(v) if c in floats else v for c, v in given.items()}
    line = F.struct(*[v.alias(c) for c, v in shown.items()])
    return lines.select("ClimateID", "day", F.array(F.struct(line.alias("line"), "n")).alias("lines"))


def history_pages(history: DataFrame, cols: list[str] | None = None, key: str = "ClimateID", date_col: str = "Datetime", page_rows: int = PAGE_ROWS) -> DataFrame:
    """The history rows in pages of bounded size: ``(ClimateID, day, page, lines)``.

    Equal rows are one line with its count (combined map-side); the distinct
    lines of a station-day are dealt to as many pages as their number asks
    for by a hash, so a hot station-day spreads over tasks and no fold grows
    with it.  Who reads a day's evidence writes its lines as JSON and sorts them.
    """
    lines = history_lines(history, cols, key, date_col).select("ClimateID", "day", F.col("lines")[0].alias("x"))
    large = lines.groupBy("ClimateID", "day").agg(F.ceil(F.count(F.lit(1)) / page_rows).cast("int").alias("pages")).filter("pages > 1")
    of = lines.alias("l").join(large.alias("p"), F.expr("l.ClimateID <=> p.ClimateID and l.day <=> p.day"), "left")
    page = F.pmod(F.xxhash64("x.line"), F.coalesce("pages", F.lit(1))).cast("int")
    dealt = of.select("l.ClimateID", "l.day", page.alias("page"), "x")
    return dealt.groupBy("ClimateID", "day", "page").agg(F.collect_list("x").alias("lines"))


def _told(lines: Column) -> Column:
    """Lines as ``(line, n)`` with the row's JSON text."""
    return F.transform(lines, lambda x: F.struct(F.to_json(x["line"]).alias("line"), x["n"].alias("n")))


def _text(lines: Column) -> Column:
    """Collected pages as one JSON array text, lines sorted, repeated ones written as often."""
    each = F.transform(F.array_sort(F.flatten(lines)), lambda x: F.array_repeat(x["line"], x["n"].cast("int")))
    return F.concat(F.lit("["), F.array_join(F.flatten(each), ", "), F.lit("]"))


def same_days(asked: DataFrame, days: DataFrame, years: int) -> DataFrame:
    """``asked(City, on)`` beside the rows of ``days`` of the same station and calendar day in
    the ``years`` years up to it; the join is on station, month and day of month."""
    return asked.join(
        days,
        (F.col("City") == F.col("ClimateID")) & (F.month("on") == F.col("_m")) & (F.dayofmonth("on") == F.col("_d"))
        & (F.col("day") <= F.col("on")) & (F.year("day") >= F.year("on") - F.lit(years)),
    )


def asked_days(readings: DataFrame, time_col: str = TIME) -> DataFrame:
    """Distinct ``(City, on)`` of the readings."""
    return readings.select("City", F.col(time_col).cast("date").alias("on")).filter("on is not null").distinct()


def reading_normals(readings: DataFrame, days: DataFrame, years: int = 10, time_col: str = TIME) -> DataFrame:
    """JON7: for each city and day of ``readings``, the mean of the same calendar
    day in the ``years`` years up to it: at most ``years + 1`` station days each."""
    met = same_days(asked_days(readings, time_col), days, years)
    return met.groupBy("City", "on").agg((F.sum("_s") / F.sum("_n")).alias("normal"))


def with_evidence(alerts: DataFrame, pages: DataFrame, years: int = 10, time_col: str = TIME) -> DataFrame:
    """Alerts with ``history``: the history rows of their calendar days as JSON array
    text, folded from the pages of those days alone.  Each line begins with the
    station, then the day: their order is the text's.  Pages of calendar days
    (at most 366) that no alert asks for go before the join."""
    asked = asked_days(alerts, time_col)
    dates = asked.select(F.month("on").alias("_m"), F.dayofmonth("on").alias("_d")).distinct()
    days = pages.withColumns({"_m": F.month("day"), "_d": F.dayofmonth("day")})
    met = same_days(asked, days.join(F.broadcast(dates), ["_m", "_d"], "left_semi"), years)
    met = met.select("City", "on", "day", _told(F.col("lines")).alias("lines"))
    told = met.groupBy(F.col("City").alias("_city"), "on").agg(F.array_sort(F.collect_list(F.struct("day", "lines"))).alias("_days"))
    told = told.select("_city", "on", _day_texts("_days").alias("history"))
    return alerts.join(told, (F.col("City") == F.col("_city")) & (F.col(time_col).cast("date") == F.col("on")), "left").drop("_city", "on")


def _day_texts(days: str) -> Column:
    """Pages of several days as one text: by day, then by line."""
    lines = F.flatten(F.transform(days, lambda p: F.transform(p["lines"], lambda x: F.struct(p["day"].alias("day"), x["line"].alias("line"), x["n"].alias("n")))))
    each = F.transform(F.array_sort(lines), lambda x: F.array_repeat(x["line"], x["n"].cast("int")))
    return F.concat(F.lit("["), F.array_join(F.flatten(each), ", "), F.lit("]"))


def deviation_alert(
    current: DataFrame,
    history: DataFrame,
    threshold: float = 5.0,
    years: int = 10,
    value_col: str = "MaxTempC",
    evidence: bool = True,
) -> DataFrame:
    """STR3 deviation mode + JON7: |reading - normal of the reading's own day| >= threshold.
    With ``evidence`` the alerts' history rows stand in ``history``."""
    out = deviation_from_days(current, station_days(history, value_col), threshold, years)
    return with_evidence(out, history_pages(history), years) if evidence else out


def deviation_from_days(current: DataFrame, days: DataFrame, threshold: float = 5.0, years: int = 10) -> DataFrame:
    """The join and test of ``deviation_alert`` against already summed station days.

    Readings of a city or day without history are reported too, with NULL
    normal and deviation: no reading vanishes unseen.
    """
    normals = reading_normals(current, days, years).withColumnRenamed("City", "_city")
    joined = current.join(normals, (F.col("City") == F.col("_city")) & (F.col(TIME).cast("date") == F.col("on")), "left").drop("_city", "on")
    joined = joined.withColumn("deviation", F.col("Temperature") - F.col("normal"))
    return joined.filter(F.col("deviation").isNull() | (F.abs("deviation") >= F.lit(threshold)))


def history_json(history: DataFrame, cols: list[str], key: str = "ClimateID", day: str = "Datetime") -> DataFrame:
    """AGG6: per station, the history rows as one sorted JSON array text.

    The rows come in pages of bounded size (``history_pages``); a station's
    text is folded from them.  ``cols`` must start with ``key`` and ``day``:
    every text then begins with the station and the ISO day.  Empty input
    gives no row; an empty group's fold is ``[]`` (``json_array``).
    """
    if cols[:2] != [key, day]:
        raise ValueError(f"cols must start with {key!r}, {day!r}")
    pages = history_pages(history, cols, key, day)
    rows = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    folded = pages.groupBy(F.col("ClimateID").alias(key)).agg(F.sum(rows).alias("n_rows"), F.collect_list(_told(F.col("lines"))).alias("_lines"))
    return folded.select(key, "n_rows", _text(F.col("_lines")).alias("history_json"))
