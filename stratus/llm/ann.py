"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

1. Vectors of one direction (equal once scaled by their largest component) have
   one cosine with anything and become one point with its least ids; only a
   point's first ``k + 1`` ids can be among anybody's k nearest, so nothing is lost.
2. Points are dealt to shards of bounded size by a hash.
3. A task per shard builds the graph: greedy searches from the shard's centre
   propose neighbours, and pruning keeps a neighbour only if no kept one is
   closer to it by the factor ``alpha``, so edges are diverse.
4. A shard is one packed row.  Queries are dealt to all shards; a task holds a
   shard and streams its queries past it by beam search.  The best of all shards
   are ranked by their exact cosine, which the scaled vectors give as well.

A task holds one shard and one batch of queries, both of bounded size; more
data give more tasks, and no shard is copied.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import cut

SHARD = 4096  # points of a graph, about
BLOCK = 512  # queries searched together
DEGREE, BEAM, ALPHA = 32, 64, 1.2


def nearest_first(dist: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by distance (ties by id), repeated ids dropped, cut to ``keep``; -1 is no id."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    again = np.zeros_like(ids, dtype=bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    dist = np.where(again | (ids < 0), np.inf, dist)
    order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isinf(dist), -1, ids), dist


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` points for each query, nearest first, by greedy steps along
    the graph: the nearest point of the beam not yet left is expanded until none is.

    Distances are 1 - cosine of unit vectors; all queries step together.
    """
    n = len(queries)
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf)
    ids[:, 0], dist[:, 0] = start, 1 - queries @ points[start]
    left = np.zeros((n, beam), dtype=bool)  # already expanded
    active = np.arange(n)
    while len(active):
        open_ = ~left[active] & (ids[active] >= 0)
        some = open_.any(1)
        active, open_ = active[some], open_[some]
        if not len(active):
            break
        at = open_.argmax(1)
        node = ids[active, at]
        left[active, at] = True
        new = graph[node]
        near = np.where(new >= 0, 1 - np.einsum("rd,rkd->rk", queries[active], points[new]), np.inf)
        both_ids = np.concatenate([ids[active], new], axis=1)
        both_dist = np.concatenate([dist[active], near], axis=1)
        both_left = np.concatenate([left[active], np.zeros(new.shape, dtype=bool)], axis=1)
        # the known entry of a repeated id comes first in a stable sort by id
        order = np.argsort(both_ids, axis=1, kind="stable")
        both_ids, both_dist, both_left = (np.take_along_axis(x, order, 1) for x in (both_ids, both_dist, both_left))
        again = np.zeros(both_ids.shape, dtype=bool)
        again[:, 1:] = both_ids[:, 1:] == both_ids[:, :-1]
        both_dist = np.where(again | (both_ids < 0), np.inf, both_dist)
        order = np.argsort(both_dist, axis=1, kind="stable")[:, :beam]
        both_ids, both_dist, both_left = (np.take_along_axis(x, order, 1) for x in (both_ids, both_dist, both_left))
        ids[active], dist[active], left[active] = np.where(np.isinf(both_dist), -1, both_ids), both_dist, both_left
    return ids, dist


def robust_prune(points: np.ndarray, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of each point ``own``: the nearest candidate is kept, and
    drops every candidate that is ``alpha`` times closer to it than to the point."""
    ids = np.where(ids == own[:, None], -1, ids)
    ids, dist = nearest_first(np.where(ids < 0, np.inf, dist), ids, ids.shape[1])
    alive = ids >= 0
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    vectors = points[ids]
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        pick = ids[rows, at]
        out[some, k] = pick[some]
        between = 1 - np.einsum("rd,rkd->rk", points[pick], vectors)
        alive &= ~((alpha * between <= dist) & some[:, None])
        alive[rows, at] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """``(neighbours, start)`` for unit vectors: points join in batches of growing
    size, each by a search of the graph so far; a second pass relaxes with ``alpha``."""
    n = len(points)
    start = int((points @ points.mean(0)).argmax())
    graph = np.full((n, degree), -1)
    rng = np.random.default_rng(seed)
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        done, size = 0, 1 if factor == 1.0 else 512
        while done < n:
            batch = order[done : done + size]
            done, size = done + size, min(size * 2, 512)
            ids, dist = beam_search(points, graph, start, points[batch], beam)
            known = graph[batch]
            kd = np.where(known >= 0, 1 - np.einsum("rd,rkd->rk", points[batch], points[known]), np.inf)
            graph[batch] = robust_prune(points, batch, np.concatenate([ids, known], 1), np.concatenate([dist, kd], 1), degree, factor)
            # the batch's points become neighbours of their neighbours
            source = np.repeat(batch, degree)
            target = graph[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            sort = np.argsort(target, kind="stable")
            source, target = source[sort], target[sort]
            nodes, first, many = np.unique(target, return_index=True, return_counts=True)
            width = int(many.max()) if len(many) else 0
            if not width:
                continue
            extra = np.full((len(nodes), width), -1)
            extra[np.repeat(np.arange(len(nodes)), many), np.arange(len(source)) - np.repeat(first, many)] = source
            for lo in range(0, len(nodes), 512):
                some = nodes[lo : lo + 512]
                cand = np.concatenate([graph[some], extra[lo : lo + 512]], axis=1)
                cd = np.where(cand >= 0, 1 - np.einsum("rd,rkd->rk", points[some], points[cand]), np.inf)
                full = robust_prune(points, some, cand, cd, degree, factor)
                held = np.sort(cand, axis=1)
                short = ((held[:, 1:] != held[:, :-1]) & (held[:, 1:] >= 0)).sum(1) < degree  # room for all: keep them, nearest first
                if short.any():
                    full[short] = nearest_first(cd[short], cand[short], degree)[0]
                graph[some] = full
    return graph, start


def usable(vector: str) -> F.Column:
    """Non-empty, all components finite, not all zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce((F.size(x) > 0) & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def shard_counts(sizes: dict[int, int], shard: int) -> F.Column:
    """Number of shards for each vector length."""
    return F.create_map(*[F.lit(x) for d, n in (sizes or {0: 1}).items() for x in (d, max(1, math.ceil(n / shard)))])


def points_of(vectors: DataFrame, id_col: str, vector_col: str, k: int, shard: int) -> tuple[DataFrame, dict[int, int]]:
    """Distinct directions with their least ``k + 1`` ids, dealt to shards: ``(dim, shard, v, ids)``; points by vector length.

    A direction is the vector divided by its largest component, as ``unit``
    does first: the cosine comes out the same to the last bit.
    """
    rows = vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("most", F.array_max(F.transform("v", F.abs)))
    rows = rows.select("id", F.transform("v", lambda c: c / F.col("most") + F.lit(0.0)).alias("v"))  # -0.0 equals 0.0
    # Spark cuts each task's rows of a vector to k + 1 before they are dealt by vector
    least = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    points = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    sizes = {r["dim"]: r["n"] for r in points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    shards = F.element_at(shard_counts(sizes, shard), F.size("v"))
    return points.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), shards).cast("int").alias("shard"), "v", "ids"), sizes


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row of ``queries`` among all other ids of ``vectors``.

    Nearness is the largest cosine in double precision, ties to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without id; vectors of another length than the
    query's aren't candidates.  Rows that repeat an id with the same vector are
    one; an empty table gives an empty result.
    """
    points, sizes = points_of(vectors, id_col, vector_col, k, shard)
    asked = queries.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda c: c + F.lit(0.0)).alias("q")).distinct()
    many = shard_counts(sizes, shard)
    index = cut(points.groupBy("dim", "shard").applyInPandas(_build, SHARD_ROW))
    asked = asked.withColumn("dim", F.size("q"))  # a length without vectors has no shards
    dealt = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(many, F.col("dim")) - 1))).withColumn("kind", F.lit(1))
    rows = index.withColumn("kind", F.lit(0)).unionByName(dealt, allowMissingColumns=True).select("dim", "shard", "kind", "v", "owners", "owned", "edges", "start", "query_id", "q")
    rows = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = rows.mapInArrow(_searched(k, beam, block), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: A shard as one row: vectors, ids of each point (``owners``, ``owned`` of them), out-neighbours, first point.
SHARD_ROW = "dim int, shard int, v binary, owners binary, owned binary, edges binary, start int"


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # first by the largest component: squares stay finite
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    raw = np.array(pdf["v"].tolist(), dtype=np.float64)
    order = np.lexsort(raw.T[::-1])  # the same graph whatever order the rows came in
    raw, owners = raw[order], [pdf["ids"].iloc[i] for i in order]
    graph, start = build_graph(unit(raw).astype(np.float32))
    row = [int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), raw.tobytes(), np.concatenate(owners).astype(np.int64).tobytes(), np.array([len(o) for o in owners], dtype=np.int32).tobytes(), graph.astype(np.int32).tobytes(), start]
    return pd.DataFrame([row], columns=["dim", "shard", "v", "owners", "owned", "edges", "start"])


def _searched(k: int, beam: int, block: int):
    """mapInArrow function over rows sorted by (dim, shard, kind): a task holds one shard and streams its queries."""

    def run(parts):
        held, shard = None, None
        for part in parts:
            place = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            kinds = part.column(2).to_pylist()
            lo = 0
            while lo < len(place):
                hi = lo + 1
                while hi < len(place) and place[hi] == place[lo] and kinds[hi] == kinds[lo]:
                    hi += 1
                if kinds[lo] == 0:
                    row = part.slice(lo, 1).to_pylist()[0]
                    exact = unit(np.frombuffer(row["v"], np.float64).reshape(-1, row["dim"]))
                    ends = np.cumsum(np.frombuffer(row["owned"], np.int32))
                    owners = np.split(np.frombuffer(row["owners"], np.int64), ends[:-1])
                    held, shard = place[lo], (exact, exact.astype(np.float32), np.frombuffer(row["edges"], np.int32).reshape(len(exact), -1).astype(np.int64), row["start"], owners)
                elif place[lo] == held:
                    some = part.slice(lo, hi - lo)
                    yield _search(shard, some.column(8).to_pylist(), unit(np.array(some.column(9).to_pylist(), dtype=np.float64)), k, beam, block)
                lo = hi

    return run


def _search(shard: tuple, names: list[int], asked: np.ndarray, k: int, beam: int, block: int) -> pa.RecordBatch:
    exact, points, graph, start, owners = shard
    out_q, out_v, out_s = [], [], []
    for lo in range(0, len(asked), block):
        found, _ = beam_search(points, graph, start, asked[lo : lo + block].astype(np.float32), beam)
        for i, ids in enumerate(found, start=lo):
            ids = ids[ids >= 0]
            scores = exact[ids] @ asked[i]
            pairs = sorted(((-s, v) for s, p in zip(scores.tolist(), ids.tolist()) for v in owners[p].tolist() if v != names[i]))[:k]
            out_q += [names[i]] * len(pairs)
            out_v += [v for _, v in pairs]
            out_s += [-s for s, _ in pairs]
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])
