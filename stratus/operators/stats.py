"""Statistics: describe, zero profile, class counts, regression quality,
correlations, key influencers and narrative facts (AGG2-5, AGG13, AGG15-18).

All are single-pass aggregates (partial aggregation map-side, one small
final merge); wide results are reshaped with ``stack``/``unpivot`` after the
aggregate, never by re-scanning per column.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG5: count, mean, sample stddev, min, max per numeric column (long form)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}__count"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__stddev"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    one = df.agg(*aggs)
    parts = ", ".join(
        f"'{c}', `{c}__count`, `{c}__mean`, `{c}__stddev`, `{c}__min`, `{c}__max`" for c in cols
    )
    return one.selectExpr(
        f"stack({len(cols)}, {parts}) AS (column, count, mean, stddev, min, max)"
    )


def describe_all(df: DataFrame) -> DataFrame:
    """AGG5 over every column: numbers as in ``describe``, texts by count and least and
    greatest text (``min_text``, ``max_text``); dates and times by count alone."""
    aggs, rows = [], []
    for f in df.schema.fields:
        c, x = f.name, F.col(f"`{f.name}`")
        aggs.append(F.count(x).alias(f"{c}__n"))
        if isinstance(f.dataType, T.NumericType):
            v = x.cast("double")
            aggs += [F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__sd"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
            rows.append(f"'{c}', `{c}__n`, `{c}__mean`, `{c}__sd`, `{c}__min`, `{c}__max`, cast(null as string), cast(null as string)")
        elif isinstance(f.dataType, T.StringType):
            aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
            rows.append(f"'{c}', `{c}__n`, cast(null as double), cast(null as double), cast(null as double), cast(null as double), `{c}__min`, `{c}__max`")
        else:
            rows.append(f"'{c}', `{c}__n`, cast(null as double), cast(null as double), cast(null as double), cast(null as double), cast(null as string), cast(null as string)")
    return df.agg(*aggs).selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (column, count, mean, stddev, min, max, min_text, max_text)")


def zero_profile(df: DataFrame, col: str) -> DataFrame:
    """AGG15 / FLT9: rows where ``col`` is zero, non-zero and NULL."""
    c = F.col(col)
    return df.agg(
        F.count_if(c == 0).alias("zero_count"),
        F.count_if(c != 0).alias("nonzero_count"),
        F.count_if(c.isNull()).alias("null_count"),
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """AGG2 + AGG4: rows per class and the minority-class size on every row.

    The minimum is taken over the counts table (one row per label, so the
    un-partitioned window holds a handful of rows), not by re-scanning ``df``.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("minority_n", F.min("n").over(Window.partitionBy()))


def regression_quality(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """AGG13: RMSE, MAE and R^2 in one aggregate pass."""
    err = F.col(prediction) - F.col(label)
    one = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(F.col(label)).alias("var_y"),
    )
    return one.select(
        "n",
        F.sqrt("mse").alias("rmse"),
        F.col("mae"),
        (F.lit(1.0) - F.col("mse") / F.col("var_y")).alias("r2"),
    )


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG16: Pearson correlation of every column pair, one aggregate pass."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    parts = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return one.selectExpr(f"stack({len(pairs)}, {parts}) AS (col_a, col_b, corr)")


def key_influencers(df: DataFrame, target: str, factors: list[str], weight: str | None = None) -> DataFrame:
    """AGG17: for each factor value, rows, mean target, overall mean and lift.

    Factors are unpivoted to (factor, value) and grouped once.  Every factor
    partitions all rows, so the overall mean is the sum over one factor's
    groups - a window over the grouped table (one row per factor value), not
    a second pass over the data.  The rank is a window over the same small
    table.  With ``weight`` a row of ``df`` stands for that many rows and
    ``target`` is their sum (rows counted beforehand, before a join).
    """
    n = F.col(weight) if weight else F.lit(1)
    nt = F.when(F.col(target).isNotNull(), n)
    long = df.select(
        F.col(target).cast("double").alias("_t"), n.alias("_w"), nt.alias("_wt"),
        *[F.col(f).cast("string").alias(f) for f in factors],
    ).unpivot(["_t", "_w", "_wt"], factors, "factor", "value")
    g = long.groupBy("factor", "value").agg(
        F.sum("_w").cast("bigint").alias("n"), F.sum("_t").alias("_s"), F.sum("_wt").alias("_nt")
    )
    per_factor = Window.partitionBy("factor")
    g = g.withColumns(
        {
            "mean_target": F.col("_s") / F.col("_nt"),
            "overall_mean": F.sum("_s").over(per_factor) / F.sum("_nt").over(per_factor),
        }
    ).withColumn("lift", F.col("mean_target") / F.col("overall_mean"))
    w = Window.partitionBy("factor").orderBy(F.desc("lift"), F.asc_nulls_first("value"))
    return g.withColumn("rank", F.row_number().over(w)).drop("_s", "_nt")


def narrative_facts(series: DataFrame, by: list[str], date_col: str, value_col: str) -> DataFrame:
    """AGG18: per group, first/last value, min/max with their (earliest) day,
    mean and the linear slope per day."""
    d, v = F.col(date_col), F.col(value_col)
    nd = -F.unix_date(d)
    return series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min_by(v, d).alias("first_value"),
        F.max_by(v, d).alias("last_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.min(F.struct(v, d)).getField(date_col).alias("min_day"),
        F.date_from_unix_date(-F.max(F.struct(v, nd.alias("nd"))).getField("nd")).alias("max_day"),
        F.avg(v).alias("mean_value"),
        F.regr_slope(v, F.unix_date(d).cast("double")).alias("slope_per_day"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (for stable comparison of float sums)."""
    from pyspark.sql.types import DoubleType

    return df.withColumns(
        {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    )


def row_hash60(cols: list[Column]) -> Column:
    """A 60-bit hash of a row's columns: the first 15 hex digits of the MD5 of
    their ``|``-joined text (NULL spelled ``\\N``).  Built-in and JVM-side,
    and the same in any SQL engine with md5, so samples can be re-derived."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(cols: list[Column], seed: int) -> Column:
    """A deterministic U[0,1) per row from a hash of its columns and a seed."""
    return row_hash60([*cols, F.lit(seed)]).cast("double") / F.lit(float(1 << 60))


def profile_text(described: DataFrame, data: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """AGG15: the statistics payload as one text: each ``describe`` row as a JSON
    line (sorted by column name), then `` Count <col> = 0 : <n>``.

    The described table has one row per column, so the fold is small; the
    zero count is one aggregate over ``data`` (a scalar subquery).
    """
    rows = rounded(described, digits).select(F.to_json(F.struct("column", *[c for c in described.columns if c != "column"])).alias("j"))
    zeros = data.select(F.count_if(F.col(col) == 0)).scalar()
    return rows.agg(
        F.concat(
            F.concat_ws("\n", F.array_sort(F.collect_list("j"))),
            F.lit(f"\n Count {col} = 0 : "),
            zeros.cast("string"),
        ).alias("profile_text")
    )
