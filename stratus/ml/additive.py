"""Additive time-series forecaster on Spark (FOR1, FOR2).

Model (Taylor & Letham, "Forecasting at Scale", 2018):

    y(t) = k*t + sum_j d_j * max(0, t - c_j)        piecewise-linear trend
         + sum_k a_k sin(2 pi k t_d / 365.25) + b_k cos(...)   yearly, order 10
         + sum_k a_k sin(2 pi k t_d / 7) + b_k cos(...)        weekly, order 3
         + beta * Rain                                        extra regressor
         + intercept

``t`` is time scaled to [0, 1] over the training days, ``t_d`` is days since
1970-01-01, changepoints ``c_j`` are spread evenly over the first 80 % of
the training span.  Daily seasonality is constant on daily rows (collinear
with the intercept) and is left out.

Fit: every feature is a SQL expression of the date.  One pass over the rows
gives the design's cross products (a matrix of about 55 x 55, whatever the
input); the posterior's mode is found on them.  The slope changes ``d_j`` have
a Laplace prior, so most of them end at zero; the other coefficients have wide
normal priors.

Score: a linear SQL expression.  The 80 % interval holds the noise and, beyond
the training days, the changes the trend may still make: changepoints as
frequent as in training, with slope changes of the mean size found there, are
simulated from a fixed seed, so the interval widens with the horizon.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARLY_ORDER = 10
WEEKLY_ORDER = 3
N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
# Prior scales, for y divided by its largest size.
CHANGEPOINT_SCALE = 0.05
SEASON_SCALE = 10.0
LEVEL_SCALE = 5.0
PATHS = 1000
SEED = 5


def _fourier(day: Column, period: float, order: int, prefix: str) -> dict[str, Column]:
    cols = {}
    for k in range(1, order + 1):
        ang = F.lit(2.0 * math.pi * k / period) * day
        cols[f"{prefix}_s{k}"] = F.sin(ang)
        cols[f"{prefix}_c{k}"] = F.cos(ang)
    return cols


def design(df: DataFrame, ds: str, t0: Column, t1: Column, regressors: list[str]) -> tuple[DataFrame, list[str]]:
    """Add the feature columns; return (frame, feature names)."""
    day = F.unix_date(F.col(ds)).cast("double")
    span = F.greatest((t1 - t0).cast("double"), F.lit(1.0))
    t = (day - t0.cast("double")) / span
    cols = {"trend_t": t}
    for j in range(1, N_CHANGEPOINTS + 1):
        c = CHANGEPOINT_RANGE * j / (N_CHANGEPOINTS + 1)
        cols[f"trend_cp{j}"] = F.greatest(t - F.lit(c), F.lit(0.0))
    cols.update(_fourier(day, 365.25, YEARLY_ORDER, "yearly"))
    cols.update(_fourier(day, 7.0, WEEKLY_ORDER, "weekly"))
    for r in regressors:
        cols[f"reg_{r}"] = F.col(r).cast("double")
    return df.withColumns(cols), list(cols)


def cross_products(x: DataFrame, names: list[str], y: str) -> np.ndarray:
    """``Z'Z`` of ``Z = (1, features, y)`` over all rows, in one pass; tasks add up their own rows first."""
    columns = [F.lit(1.0), *[F.col(f"`{n}`") for n in names], F.col(f"`{y}`").cast("double")]
    p = len(columns)

    def run(parts):
        total = np.zeros((p, p))
        for part in parts:
            z = np.array(part["z"].tolist(), dtype=np.float64)
            total += z.T @ z
        yield pd.DataFrame({"at": np.arange(p * p), "s": total.ravel()})

    rows = x.select(F.array(*columns).alias("z")).filter(F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v))).mapInPandas(run, "at int, s double")
    out = np.zeros(p * p)
    for r in rows.groupBy("at").agg(F.sum("s").alias("s")).collect():  # p * p numbers
        out[r["at"]] = r["s"]
    return out.reshape(p, p)


def posterior_mode(z: np.ndarray, names: list[str], size: float, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first) and noise of the posterior's mode, from the cross products.

    The Laplace terms are majorised by quadratics around the last solution
    until it stands still; slope changes that vanish are zero.  ``penalty``
    scales the priors' pull (0: least squares).
    """
    n, p = z[0, 0], len(names) + 1
    gram, cross, total = z[:p, :p], z[:p, p] / size, z[p, p] / size**2
    ridge = np.array([LEVEL_SCALE**-2] + [LEVEL_SCALE**-2 if c == "trend_t" else SEASON_SCALE**-2 for c in names])
    jump = np.array([False] + [c.startswith("trend_cp") for c in names])

    def noise(w: np.ndarray) -> float:
        return math.sqrt(max(float(total - 2 * w @ cross + w @ gram @ w), 1e-12 * max(total, 1e-12)) / n)

    w = np.linalg.lstsq(gram, cross, rcond=None)[0]
    sigma = noise(w)
    if penalty:
        w = np.where(jump, 0.1, w)
        for _ in range(500):
            pull = np.where(jump, 1 / (CHANGEPOINT_SCALE * np.maximum(np.abs(w), 1e-9)), ridge)
            new = np.linalg.solve(gram / sigma**2 + penalty * np.diag(pull), cross / sigma**2)
            still = np.abs(new - w).max() < 1e-9
            w, sigma = new, noise(new)
            if still:
                break
        w = np.where(jump & (np.abs(w) < 1e-6), 0.0, w)
    return w * size, sigma * size


@lru_cache(maxsize=8)
def _block(rate: float, jump: float, b: int, many: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Gaps and slope changes of each path's changepoints ``b * many`` to ``(b + 1) * many``."""
    rng = np.random.default_rng([SEED, b])
    return rng.exponential(1 / rate, (PATHS, many)), rng.laplace(0, jump, (PATHS, many))


def interval_offsets(ahead: np.ndarray, rate: float, jump: float, sigma: float, share: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper offsets from the forecast, ``ahead`` of the training span (in its length).

    The same simulated trends serve all horizons; within the span there is the noise alone.
    """
    normal = NormalDist()
    noise = sigma * np.random.default_rng(SEED).permutation([normal.inv_cdf((i + 0.5) / PATHS) for i in range(PATHS)])
    moved = np.zeros((len(ahead), PATHS))
    at, b = np.zeros(PATHS), 0
    far = float(ahead.max(initial=0.0))
    while jump > 0 and rate > 0 and at.min() < far:
        gaps, jumps = _block(rate, jump, b)
        for j in range(gaps.shape[1]):
            at = at + gaps[:, j]
            moved += np.maximum(ahead[:, None] - at, 0) * jumps[:, j]
        b += 1
    spread = np.quantile(moved + noise, [(1 - share) / 2, (1 + share) / 2], axis=1)
    edge = normal.inv_cdf((1 + share) / 2) * sigma
    return np.where(ahead > 0, np.minimum(spread[0], -edge), -edge), np.where(ahead > 0, np.maximum(spread[1], edge), edge)


def fit_additive(train: DataFrame, ds: str = "ds", y: str = "y", regressors: list[str] | None = None,
                 reg_param: float = 1.0):
    """FOR1: fit on the training rows; returns a scorer ``(frame) -> frame`` that adds
    ``yhat``, ``yhat_lower`` and ``yhat_upper`` (NULL where the date or a regressor is).

    ``reg_param`` scales the priors; 0 is least squares.
    """
    regressors = regressors or []
    day = F.unix_date(F.col(ds))
    bounds = train.agg(F.min(day).alias("t0"), F.max(day).alias("t1"), F.max(F.abs(F.col(y))).alias("size")).first()
    if bounds["size"] is None:
        raise ValueError("no training row has a date and a value")
    t0, t1 = F.lit(bounds["t0"]), F.lit(bounds["t1"])
    x, names = design(train.filter(F.col(y).isNotNull()), ds, t0, t1, regressors)
    weights, sigma = posterior_mode(cross_products(x, names, y), names, float(bounds["size"]) or 1.0, reg_param)
    jumps = np.array([w for c, w in zip(names, weights[1:]) if c.startswith("trend_cp")])
    rate, jump = N_CHANGEPOINTS / 1.0, float(np.abs(jumps).mean())

    @F.pandas_udf("struct<lower:double,upper:double>")
    def offsets(ahead: pd.Series) -> pd.DataFrame:
        places, back = np.unique(np.nan_to_num(ahead.to_numpy(dtype=float)), return_inverse=True)
        low, high = [np.zeros(0)], [np.zeros(0)]
        for k in range(0, len(places), 500):
            part = interval_offsets(places[k : k + 500], rate, jump, sigma)
            low.append(part[0])
            high.append(part[1])
        return pd.DataFrame({"lower": np.concatenate(low)[back], "upper": np.concatenate(high)[back]})

    def score(frame: DataFrame) -> DataFrame:
        given = frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row"), F.col(ds).alias("ds"), *[F.col(f"`{r}`").alias(r) for r in regressors if r != "ds"])
        f, _ = design(given, "ds", t0, t1, regressors)
        yhat = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(c) for c, w in zip(names, weights[1:])], F.lit(float(weights[0])))
        f = f.select("row", yhat.alias("yhat"), offsets(F.greatest(F.col("trend_t") - 1.0, F.lit(0.0))).alias("off"))  # NULL, not dropped
        return f.select(
            *[F.col("row")[c].alias(c) for c in frame.columns],
            "yhat",
            (F.col("yhat") + F.col("off.lower")).alias("yhat_lower"),
            (F.col("yhat") + F.col("off.upper")).alias("yhat_upper"),
        )

    return score, {"sigma": sigma, "t0": bounds["t0"], "t1": bounds["t1"], "changes": jumps.tolist()}
