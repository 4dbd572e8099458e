"""Embedding near-duplicates by randomised-rotation binary codes.

1. Vectors of one label and direction become one point; copies aren't compared.
2. Seeded random rotations turn a point's unit vector o; the signs are its
   binary code, and stored with it is the sum F of its rotated coordinates'
   sizes, which corrects estimates, and a 4-bit form of the first rotation,
   rounded up or down at random so that it is right on average.
3. Points meet in buckets, by bands of code bits.  The number of bits of a band
   follows the size of the largest label; the number of bands is such that a
   pair at the threshold misses all of them with probability ``MISS`` at most.
4. Where two points meet, ``<signs of o, rotated q> / F`` estimates their inner
   product without bias, for the part of the signs beside o points anywhere
   with equal chance.  Pairs whose upper confidence bound is below the
   threshold are done with; the others need the exact product.  Only their
   points, not the pairs, are passed on, with the group they belong to.
5. Vectors join the groups and the pairs are computed in double precision.  A
   pair counts in the first band that both share, so each link counts once;
   tasks pass on counts and a spanning forest of the links.

A bucket of more than ``block`` points is dealt to several tasks; each holds
one block and streams the others past it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.ann import unit, usable
from stratus.llm.common import cut
from stratus.llm.components import components

SEED = 11
MISS = 1e-6  # chance that a pair at the threshold shares no band
SURE = 6.0  # standard deviations of an estimate's bound
BUCKET = 16  # points of a bucket, about, were they spread evenly
PAIRS = 8_000_000  # numbers held for one step over pairs


@lru_cache(maxsize=4)
def rotations(dim: int, bits: int) -> np.ndarray:
    """``bits`` rows of random rotations of ``dim`` dimensions, one rotation below the other."""
    rng = np.random.default_rng([SEED, dim])
    many = -(-bits // dim)
    rows = [(lambda q, r: q * np.sign(np.diag(r)))(*np.linalg.qr(rng.standard_normal((dim, dim)))) for _ in range(many)]
    return np.concatenate(rows)[:bits]


def scheme(n: int, threshold: float) -> tuple[int, int]:
    """``(bands, bits of a band)`` for labels of up to n points."""
    same = 1 - math.acos(threshold) / math.pi  # chance that a code bit agrees at the threshold
    width = min(32, max(8, math.ceil(math.log2(max(n, 1) / BUCKET))))
    return math.ceil(math.log(MISS) / math.log(1 - same**width)), width


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows, dtype=np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]), pa.py_buffer(rows)]).cast(pa.binary())


def matrix(column: pa.Array, kind=np.uint8) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _encode(bands: int, width: int):
    """mapInArrow function: code, 4-bit coordinates, ``(F, bound, low, step)`` and band keys of each point."""

    def run(parts):
        for part in parts:
            dims = np.array([len(v) for v in part.column(1)])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                some = part.take(pa.array(at))
                x = unit(np.array(some.column(1).to_pylist(), dtype=np.float64))
                bits = -(-max(bands * width, dim) // 8) * 8
                turned = x @ rotations(dim, bits).T
                code = turned > 0
                first = turned[:, :dim]
                size = np.abs(first).sum(1)
                low, step = first.min(1), np.maximum(np.ptp(first, axis=1) / 15, 1e-12)
                level = (first - low[:, None]) / step[:, None]
                dice = np.random.default_rng(SEED).random(level.shape)
                level = np.clip(np.floor(level + dice), 0, 15).astype(np.uint8)
                level = np.concatenate([level, np.zeros((len(x), dim % 2), dtype=np.uint8)], axis=1)
                # what varies: the signs beside o, over the other dimensions, and the rounding of q
                beside = np.maximum(dim - size**2, 0) / max(dim - 1, 1)
                keys = np.packbits(code[:, : bands * width].reshape(len(x), bands, width), axis=2, bitorder="little").astype(np.int64)
                keys = (keys << (8 * np.arange(keys.shape[2]))).sum(2)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([dim] * len(x), pa.int32()),
                        packed(np.packbits(code, axis=1, bitorder="little")),
                        packed(level[:, 0::2] | (level[:, 1::2] << 4)),
                        packed(np.stack([size, beside, low, step], axis=1).astype(np.float32).view(np.uint8)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    ],
                    names=["node", "dim", "code", "coarse", "factors", "keys"],
                )

    return run


def labels_of(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component, given components so far and links a - b."""
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def met(parts: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Rows sorted by group (the first columns) and ``probe`` (the next): ``(rows, first row of each row's
    group, stored rows of it, rows seen before)``.

    A group's stored rows come all at once, together with its first probes;
    further probes come with the stored rows again, which are then marked as
    seen.  Rows of one yield have one ``dim`` (the first column).
    """
    held, seen = None, 0

    def edges(batch):
        new = np.zeros(len(batch), dtype=bool)
        new[:1] = True
        for c in range(n_keys):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return new

    def ready(batch, before):
        first = np.flatnonzero(edges(batch))
        of = np.repeat(np.arange(len(first)), np.diff([*first, len(batch)]))
        probe = batch.column(n_keys).to_numpy(zero_copy_only=False)
        return batch, first[of], np.bincount(of, weights=probe == 0, minlength=len(first)).astype(np.int64)[of], before

    def segments():
        for part in parts:
            dim = part.column(0).to_numpy(zero_copy_only=False)
            cutting = [0, *(np.flatnonzero(dim[1:] != dim[:-1]) + 1).tolist(), len(dim)]
            for lo, hi in zip(cutting, cutting[1:]):
                if hi > lo:
                    yield part.slice(lo, hi - lo)

    def join(x, y):
        return pa.Table.from_batches([x, y]).combine_chunks().to_batches()[0] if x is not None and len(x) else y

    for part in segments():
        if held is not None and held.column(0)[0] != part.column(0)[0]:
            if len(held) > seen:
                yield ready(held, seen)
            held, seen = None, 0
        if held is not None and seen:  # the last group had probes: only more of them need its stored rows
            if any(held.column(c)[0] != part.column(c)[0] for c in range(n_keys)):
                held, seen = None, 0
        batch = join(held, part)
        new = np.flatnonzero(edges(batch))
        last = int(new[-1])
        probe = batch.column(n_keys).to_numpy(zero_copy_only=False)
        if probe[-1] == 0:  # stored rows of the last group may follow
            if last:
                yield ready(batch.slice(0, last), seen)
            held, seen = batch.slice(last), 0
        else:
            yield ready(batch, seen)
            tail = batch.slice(last)
            held = tail.slice(0, int((probe[last:] == 0).sum()))
            seen = len(held)
            held = held if seen else None
    if held is not None and not seen:
        yield ready(held, 0)


def pair_chunks(rows: np.ndarray, first: np.ndarray, many: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of ``rows`` with the ``many`` rows from ``first`` on, some at a time."""
    rows = rows[many[rows] > 0]
    ends = np.cumsum(many[rows])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        some = rows[lo:hi]
        n = many[some]
        yield np.repeat(some, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[some], n)
        lo = hi


def shared_before(keys: np.ndarray, left: np.ndarray, right: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Pairs that share a band before this one."""
    out = np.zeros(len(left), dtype=bool)
    for s in range(int(band.max(initial=0))):
        out |= (keys[left, s] == keys[right, s]) & (s < band[left])
    return out


def _candidates(bands: int, width: int, threshold: float):
    """mapInArrow function over bucket rows: the points with a pair that needs the exact product, by group."""
    across = math.sqrt(1 - threshold * threshold)

    def run(parts):
        lab_before = hit_before = None
        for batch, first, stored, seen in met(parts, 5):
            n, dim = len(batch), batch.column(0)[0].as_py()
            band, block, probe, node = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("band", "block", "probe", "node"))
            code = np.unpackbits(matrix(batch.column("code")), axis=1, bitorder="little")
            sign = code[:, :dim].astype(np.float32) * 2 - 1
            half = matrix(batch.column("coarse"))
            size, beside, low, step = matrix(batch.column("factors"), np.float32).T
            q = np.stack([half & 15, half >> 4], axis=2).reshape(n, -1)[:, :dim] * step[:, None] + low[:, None]
            keys = code[:, : bands * width].reshape(n, bands, width)
            keys = (keys.astype(np.int64) << np.arange(width)).sum(2)

            def needed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                guess = np.einsum("ij,ij->i", sign[right], q[left]) / size[right]
                off = np.sqrt(across**2 * beside[right] + dim * step[left] ** 2 / 4) / size[right]
                ok = guess + SURE * off >= threshold
                ok[ok] = ~shared_before(keys, left[ok], right[ok], band)
                return ok

            lab, hit = np.arange(n), np.zeros(n, dtype=bool)
            if seen:
                lab[:seen], hit[:seen] = lab_before, hit_before
            at = np.arange(n)
            told = hit.copy()
            own = at[(probe == 0) & (at >= seen)]
            for left, right in pair_chunks(own, first, at - first, PAIRS // dim):
                ok = needed(left, right)
                lab = labels_of(lab, left[ok], right[ok])
                hit[left[ok]] = hit[right[ok]] = True
            asked, groups = [], []
            for left, right in pair_chunks(at[probe == 1], first, stored, PAIRS // dim):
                ok = needed(left, right)
                hit[right[ok]] = True
                both = np.unique(np.stack([left[ok], lab[right[ok]]], axis=1), axis=0)
                asked.append(both[:, 0])
                groups.append(both[:, 1])
            new = np.flatnonzero(hit & ~told & (probe == 0))
            rows, roots = np.concatenate([new, *asked]).astype(np.int64), np.concatenate([lab[new], *groups]).astype(np.int64)
            tail = int(first[-1])
            lab_before, hit_before = lab[tail : tail + int(stored[-1])] - tail, hit[tail : tail + int(stored[-1])]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(band[rows]), pa.array(block[rows]), pa.array(node[roots]), pa.array(node[rows]), pa.array(probe[rows])], names=["band", "block", "root", "node", "probe"])

    return run


def _exact(bands: int, width: int, threshold: float):
    """mapInArrow function over group rows: ``(a, null, links)`` counts and ``(a, b, null)`` links that connect what is linked."""

    def run(parts):
        for batch, first, stored, seen in met(parts, 4):
            n = len(batch)
            band, probe, node, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "probe", "node", "copies"))
            code = np.unpackbits(matrix(batch.column("code")), axis=1, bitorder="little", count=bands * width).reshape(n, bands, width)
            keys = (code.astype(np.int64) << np.arange(width)).sum(2)
            x = unit(np.array(batch.column("v").to_pylist(), dtype=np.float64))
            lab, links, at = np.arange(n), np.zeros(n, dtype=np.int64), np.arange(n)
            own = np.where(probe == 0, np.where(at >= seen, at - first, 0), stored)
            for left, right in pair_chunks(at, first, own, PAIRS // x.shape[1]):
                ok = np.einsum("ij,ij->i", x[left], x[right]) >= threshold
                ok[ok] = ~shared_before(keys, left[ok], right[ok], band)
                left, right = left[ok], right[ok]
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                lab = labels_of(lab, left, right)
            some, tied = np.flatnonzero(links), np.flatnonzero(lab != at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[some], node[tied]])), pa.array([None] * len(some) + node[lab[tied]].tolist(), pa.int64()), pa.array(links[some].tolist() + [None] * len(tied), pa.int64())],
                names=["a", "b", "n"],
            )

    return run


def links(points: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """``(a, b, n)`` for ``points(node, label, dim, copies, v)``: n is set in rows that count a node's
    linked vectors (to be added up), b in links between nodes that connect all that are linked."""
    largest = points.groupBy("label", "dim").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    bands, width = scheme(largest, threshold)
    coded = points.select("node", "v").mapInArrow(_encode(bands, width), "node long, dim int, code binary, coarse binary, factors binary, keys array<long>")
    coded = cut(points.select("node", "label", "copies", "v").join(coded, "node"))
    rows = coded.select("dim", "label", F.posexplode("keys").alias("band", "key"), "node", "code", "coarse", "factors")
    place = ["dim", "label", "band", "key"]
    large = cut(rows.groupBy(*place).agg(F.count("*").alias("c")).filter(F.col("c") > block).select(*place, F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    if large.isEmpty():
        rows = rows.withColumn("block", F.lit(0)).withColumn("probe", F.lit(0))
    else:  # a point is stored in its block and probes the blocks before it
        rows = rows.join(large, place, "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("probe", (F.col("block") < F.col("own")).cast("int"))
    rows = rows.select("dim", "band", "key", "block", F.col("label").cast("string").alias("label"), "probe", "node", "code", "coarse", "factors")
    rows = rows.repartition("dim", "band", "key", "block", "label").sortWithinPartitions("dim", "band", "key", "block", "label", "probe")
    found = rows.mapInArrow(_candidates(bands, width, threshold), "band int, block int, root long, node long, probe int")
    groups = found.join(coded.select("node", "dim", "copies", "code", "v"), "node").select("dim", "band", "block", "root", "probe", "node", "copies", "code", "v")
    groups = groups.repartition("dim", "band", "block", "root").sortWithinPartitions("dim", "band", "block", "root", "probe")
    return cut(groups.mapInArrow(_exact(bands, width, threshold), "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Two vectors of one label and length are linked by a cosine of ``threshold``
    or more, in double precision.  ``n_links`` counts the other vectors linked
    directly; ``component_id`` is the smallest id reachable, ``kept`` marks it.

    Rows with a null label, and vectors that are null, empty, zero or hold null
    or non-finite components, have no links and stand for themselves; so do
    rows without id, which are never kept.  Rows that repeat id, label and
    direction count as one vector and share their result.  An empty table gives
    an empty result; other columns are neither read nor returned.
    """
    able = usable(vector_col) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull()
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"), able.alias("able"))
    named = named.withColumn("x", F.when(F.col("able"), F.col("v").cast("array<double>"))).withColumn("most", F.array_max(F.transform("x", F.abs)))
    named = named.withColumn("x", F.transform("x", lambda c: c / F.col("most") + F.lit(0.0)))  # equal for vectors of one direction; -0.0 equals 0.0
    named = named.select("vec_id", "label", "v", F.size("x").alias("dim"), F.when(F.col("able"), F.xxhash64("x")).alias("h1"), F.when(F.col("able"), F.xxhash64(F.lit(1), "x")).alias("h2"))
    place = ["label", "dim", "h1", "h2"]  # 128 bits stand for the direction
    once = named.filter("h1 is not null").groupBy(*place, "vec_id").agg(F.first("v").alias("v"))
    points = once.groupBy(*place).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    points = cut(points.withColumn("node", F.monotonically_increasing_id()))
    found = links(points.select("node", "label", "dim", "copies", "v"), threshold, block)
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b"))
    known = points.select("node", *place, "least", "copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(*place, "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = named.drop("v").join(known, place, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT a, b FROM link
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
found AS (SELECT a, min(least(a, b)) AS least FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN found ON found.a = vec_id LEFT JOIN many ON many.a = vec_id
"""
