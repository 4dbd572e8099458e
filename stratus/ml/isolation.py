"""Distributed isolation forest (ANO1, ANO2).

Method: Liu, Ting & Zhou, "Isolation Forest", ICDM 2008.  ``t`` trees, each
grown on a sub-sample of ``psi = min(256, n)`` rows, to height
``ceil(log2(psi))``.  Score ``s = 2 ** (-E[h(x)] / c(psi))``; a row is an
anomaly (-1) when ``s > 0.5`` and normal (1) otherwise.

Spark plan:
1. Sampling: each row joins ``floor(t psi / n + u)`` of the ``t`` trees, ``u``
   a random number of the row (not of its values: equal rows are drawn apart),
   and which trees is a random choice; so each tree gets a uniform sub-sample
   of ~``psi`` different rows.  The sample (``t psi`` rows, whatever ``n``) is
   checkpointed, so a recomputed task can't draw again.
2. Growing: ``groupBy(tree_id).applyInPandas`` - one group per tree, each
   ~``psi`` rows, so every task's memory is bounded regardless of ``n``.
3. The forest (``t * (2 psi - 1)`` nodes at most, independent of ``n``) is
   shipped to the executors with the scoring function.
4. Scoring: equal feature vectors are counted first (combined map-side); the
   distinct ones walk all trees together in Arrow batches, as (rows x trees)
   arrays, one level per step.  Rows get their vector's score by a join; the
   label counts need no join.
Rows with a NULL feature are not scored (label NULL), never dropped.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.session import checkpoint_root

EULER = 0.5772156649015329
NODE_SCHEMA = (
    "tree_id int, node int, feature int, threshold double, left int, right int, size long"
)


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _c_vec(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros_like(sizes, dtype=float)
    big = sizes > 2
    n = sizes[big].astype(float)
    out[big] = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    out[sizes == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """One isolation tree as node rows (node, feature, threshold, left, right, size)."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, None)]
    while stack:
        idx, depth, parent = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if parent is not None:
            p, side = parent
            nodes[p][3 if side == 0 else 4] = me
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[me][1], nodes[me][2] = f, thr
        stack.append((idx[~go_left], depth + 1, (me, 1)))
        stack.append((idx[go_left], depth + 1, (me, 0)))
    return [tuple(n) for n in nodes]


def _tree_builder(features: list[str], max_depth: int, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree_id])
        rows = _grow(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "threshold", "left", "right", "size"])
        out.insert(0, "tree_id", tree_id)
        return out.astype({"tree_id": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int64"})

    return build


def _pack(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The forest as padded (trees x nodes) arrays; padding nodes are leaves."""
    groups = [g for _, g in nodes.sort_values(["tree_id", "node"]).groupby("tree_id")]
    t, m = len(groups), max(len(g) for g in groups)
    feature = np.full((t, m), -1, dtype=np.int64)
    thr = np.zeros((t, m))
    left = np.zeros((t, m), dtype=np.int64)
    right = np.zeros((t, m), dtype=np.int64)
    leaf_c = np.zeros((t, m))
    for i, g in enumerate(groups):
        k = len(g)
        feature[i, :k] = g["feature"].to_numpy(np.int64)
        thr[i, :k] = g["threshold"].to_numpy(float)
        left[i, :k] = g["left"].to_numpy(np.int64)
        right[i, :k] = g["right"].to_numpy(np.int64)
        leaf_c[i, :k] = _c_vec(g["size"].to_numpy(np.int64))
    return feature, thr, left, right, leaf_c


def mean_path_length(x: np.ndarray, forest: tuple[np.ndarray, ...]) -> np.ndarray:
    """E[h(x)] over all trees; every (row, tree) pair advances one level per step."""
    feature, thr, left, right, leaf_c = forest
    trees = np.arange(feature.shape[0])[None, :]
    rows = np.arange(len(x))[:, None]
    node = np.zeros((len(x), feature.shape[0]), dtype=np.int64)
    depth = np.zeros(node.shape)
    while True:
        f = feature[trees, node]
        active = f >= 0
        if not active.any():
            break
        xv = x[rows, np.where(active, f, 0)]
        nxt = np.where(xv < thr[trees, node], left[trees, node], right[trees, node])
        node = np.where(active, nxt, node)
        depth += active
    return (depth + leaf_c[trees, node]).mean(axis=1)


def tree_sample(clean: DataFrame, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """Rows with the ``tree_id`` they are drawn for; ~``psi`` rows a tree."""
    checkpoint_root(clean.sparkSession)
    drawn = clean.withColumn("_m", F.floor(F.rand(seed) + F.lit(n_trees * psi / n)).cast("int")).filter("_m > 0")
    trees = F.slice(F.shuffle(F.sequence(F.lit(0), F.lit(n_trees - 1)), seed + 1), F.lit(1), F.col("_m"))
    return drawn.withColumn("tree_id", F.explode(trees)).drop("_m").checkpoint(eager=True)


def grow_forest(df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256, seed: int = 0) -> DataFrame:
    """Node rows of the forest; no rows for an input without complete rows."""
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features]).dropna(subset=features)
    n = clean.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], f"{NODE_SCHEMA}, psi long")
    psi = min(max_samples, n)
    depth = max(1, math.ceil(math.log2(max(psi, 2))))
    sample = tree_sample(clean, n, n_trees, psi, seed)
    nodes = sample.groupBy("tree_id").applyInPandas(_tree_builder(features, depth, seed), NODE_SCHEMA)
    return nodes.withColumn("psi", F.lit(psi).cast("long"))


def scored_vectors(df: DataFrame, features: list[str], nodes: DataFrame) -> DataFrame:
    """Distinct complete feature vectors: ``(x, n, score, anomaly_score)``, n their rows.

    The scores are null without trees, or with samples of one row."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    vectors = df.select(x.alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    grown = nodes.toPandas()  # t * (2 psi - 1) nodes at most
    forest = _pack(grown) if len(grown) else None
    c_psi = c_factor(float(grown["psi"].max())) if len(grown) else 0.0

    def score(batches):
        for pdf in batches:
            s = np.full(len(pdf), np.nan)
            if c_psi > 0 and len(pdf):
                s = np.power(2.0, -mean_path_length(np.array(pdf["x"].tolist(), dtype=float), forest) / c_psi)
            yield pdf.assign(score=s)

    scored = vectors.mapInPandas(score, "x array<double>, n long, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    return scored.withColumn("anomaly_score", F.when(F.col("score") > 0.5, -1).when(F.col("score").isNotNull(), 1))


def isolation_forest(
    df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256, seed: int = 0, nodes: DataFrame | None = None,
) -> DataFrame:
    """ANO1: every row of ``df`` with ``score`` and ``anomaly_score`` (-1 / 1).

    ``nodes`` is a grown forest (``grow_forest``); without it one is grown here.
    Equal feature vectors are scored once and joined back."""
    nodes = grow_forest(df, features, n_trees, max_samples, seed) if nodes is None else nodes
    known = scored_vectors(df, features, nodes).drop("n")
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("of"))
    out = given.join(known, F.col("of") == F.col("x"), "left")
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns], "score", "anomaly_score")


def anomaly_counts(df: DataFrame, features: list[str], nodes: DataFrame) -> DataFrame:
    """ANO2: rows per label (NULL for rows with a missing feature), from the distinct vectors alone."""
    known = scored_vectors(df, features, nodes).groupBy("anomaly_score").agg(F.sum("n").alias("count"))
    missing = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) for c in features])
    rest = df.filter(missing).groupBy(F.lit(None).cast("int").alias("anomaly_score")).agg(F.count(F.lit(1)).alias("count"))
    return known.unionByName(rest).groupBy("anomaly_score").agg(F.sum("count").alias("count"))
