"""Sampling, splits and set operations (SPL1-3, SET1-5).

Random choices are hashes of the row's own columns, so a split or sample
is the same however the data is partitioned and survives a recomputed
task after an executor loss.  Where a rate has to hold although rows repeat,
equal rows are counted first and the draw decides how many of them stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.stats import row_hash60, uniform


#: Copies that one array makes at most; more go through pieces of this many.
PIECE = 1 << 16


def pieces(rows: DataFrame, copies: str) -> DataFrame:
    """``rows`` cut into pieces of at most ``PIECE`` copies: the counts ``copies`` of a
    row's pieces add up to its own.  Each level makes at most ``PIECE`` pieces of
    a piece of the level before, so no array grows with the count."""
    for width in (PIECE**3, PIECE**2, PIECE):
        many = F.expr(f"({copies} - 1) div {width}")
        rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), many)))
        rows = rows.withColumn(copies, F.least(F.lit(width).cast("long"), F.col(copies) - F.col("piece") * F.lit(width)))
    return rows.drop("piece")


def replicate(rows: DataFrame, copies: str, most: str | None = None) -> DataFrame:
    """Each row ``copies`` times (rows without copies go); the column is dropped.

    A row of more than ``PIECE`` copies is cut into pieces first, which are
    dealt evenly over the shuffle partitions, so its copies are made by many
    tasks; the other rows aren't shuffled.  ``most``, a column no smaller than
    ``copies`` and dropped like it, tells them apart where the copies are dear
    to compute.
    """
    upto = F.col(most or copies)

    def exploded(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in (copies, most)]
        return df.withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int")))).select(*kept)

    few = rows.filter(upto <= PIECE)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pieces(rows.filter((upto > PIECE) & (F.col(copies) > 0)), copies).repartition(parts)
    return exploded(few).unionByName(exploded(many))


def balance_classes(df: DataFrame, label: str, key_cols: list[str], seed: int = 42) -> DataFrame:
    """SPL1: undersample every class to (about) the minority size.

    Of equal rows ``class_draw`` says how many stay; the copies of a very
    common row are made piece by piece in many tasks (``replicate``).  Columns
    pass through whatever their names.
    """
    copies = replicate(class_draw(df, label, key_cols, seed), "copies", "n")
    return copies.select(*[F.col("row")[c].alias(c) for c in df.columns])


def class_draw(df: DataFrame, label: str, key_cols: list[str], seed: int = 42) -> DataFrame:
    """How many ``copies`` of the ``n`` equal rows ``row`` stay when classes are balanced.

    Equal rows are counted once (combined map-side, so a row repeated a
    billion times is one row of the shuffle); of ``c`` equal rows
    ``floor(c * rate + u)`` stay, ``u`` a hash of the row's ``key_cols`` in
    [0, 1).  The expected number of a class is exact whatever repeats.  Rows
    without a label belong to no class and all stay.  The class sizes, one row
    per class, are broadcast, so the rows aren't shuffled by class.
    """
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    counted = given.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    of = F.col("row")[label]
    sizes = df.select(F.col(f"`{label}`").alias("class")).filter("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("class_n"))
    sizes = sizes.select("class", (F.min("class_n").over(Window.partitionBy()) / F.col("class_n")).alias("rate"))
    # one row per class: a shuffle of the counted rows by class would put a class into one task
    rated = counted.join(F.broadcast(sizes), of == F.col("class"), "left")
    u = uniform([F.col("row")[c] for c in key_cols], seed)
    keep = F.floor(F.col("n") * F.coalesce(F.col("rate"), F.lit(1.0)) + F.when(F.col("rate").isNull(), F.lit(0.0)).otherwise(u))
    return rated.select("row", "n", keep.cast("long").alias("copies"))


def hash_split(df: DataFrame, key_cols: list[str], train_pct: int = 80, seed: int = 1042) -> DataFrame:
    """SPL2: stable 80/20 split; adds ``split`` = 'train' | 'test'.  Its seed
    differs from the balancing draw's, so the two are independent."""
    bucket = F.pmod(row_hash60([*[F.col(c) for c in key_cols], F.lit(seed)]), F.lit(100))
    return df.withColumn("split", F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("test")))


def date_median(df: DataFrame, date_col: str) -> "F.Column":
    """Median day (epoch days, interpolated) as a scalar subquery.

    ``percentile`` keeps a value->count map, so its state is bounded by the
    number of distinct days, not by the number of rows.
    """
    return df.select(F.percentile(F.unix_date(F.col(date_col)), F.lit(0.5))).scalar()


def half_split(df: DataFrame, date_col: str) -> DataFrame:
    """SPL3 (re-aimed): split at the median day instead of ``limit(n//2)``;
    adds ``half`` = 'first' (on or before the cut) | 'second'."""
    cut = date_median(df, date_col)
    return df.withColumn(
        "half", F.when(F.unix_date(F.col(date_col)) <= cut, F.lit("first")).otherwise(F.lit("second"))
    )


def class_union(df: DataFrame, label: str) -> DataFrame:
    """SET1: the two classes selected apart and put back together (bag union)."""
    return df.filter(F.col(label) == 0).unionAll(df.filter(F.col(label) == 1))


def subtract_distinct(df: DataFrame, other: DataFrame) -> DataFrame:
    """SET2: rows of ``df`` not in ``other``, duplicates collapsed (EXCEPT DISTINCT).

    Both sides are de-duplicated first (hash aggregates, combined map-side,
    so a row repeated a billion times shrinks to one before any shuffle),
    then the unique rows are anti-joined null-safely on every column.
    """
    left, right = df.distinct(), other.distinct()
    cond = None
    for c in df.columns:
        term = left[c].eqNullSafe(right[c])
        cond = term if cond is None else cond & term
    return left.join(right, cond, "left_anti")


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """SET4: union by name; a column missing in a frame becomes NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """SET5: drop rows with a NULL in any of ``cols``."""
    return df.dropna(how="any", subset=cols)
