"""Embedding near-duplicates against all pairs; estimates against true products."""

import math
import random

import numpy as np
import pytest

from stratus.llm import embdedup
from stratus.llm.ann import unit

ROWS = "vec_id long, label int, embedding array<double>, node string, n_links int"


def slow(rows, threshold):
    fine, ids = {}, {}
    for i, label, v, *_ in rows:
        ok = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            fine[i, label, tuple(v)] = unit(np.array([v], dtype=np.float64))[0]
    nodes = list(fine)
    parent, links = {n: n for n in nodes}, dict.fromkeys(nodes, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if a[1] == b[1] and len(a[2]) == len(b[2]) and fine[a] @ fine[b] >= threshold:
                links[a] += 1
                links[b] += 1
                ra, rb = sorted((root(a), root(b)), key=lambda n: n[0])
                parent[rb] = ra
    least = {}
    for n in nodes:
        least[root(n)] = min(n[0], least.get(root(n), n[0]))
    out = []
    for i, label, v, *_ in rows:
        key = (i, label, tuple(v)) if v else None
        c = least[root(key)] if key in fine else i
        out.append((i, links.get(key, 0), c, i is not None and i == c))
    return out


def make_rows(seed, dim, groups=12, noise=0.02):
    rng = np.random.default_rng(seed)
    rows, i = [], 100
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            v = centre + rng.standard_normal(dim) * noise * rng.uniform(0.2, 2)
            rows.append((i, label, (v * rng.uniform(0.1, 9)).tolist(), "x", 1))
            i += 1
    first = rows[0]
    odd = [(1, 0, None, "x", 1), (2, 0, [], "x", 1), (3, 0, [0.0] * dim, "x", 1), (4, 0, [float("nan")] + [1.0] * (dim - 1), "x", 1), (5, 0, [None] + [1.0] * (dim - 1), "x", 1)]
    odd += [(6, None, first[2], "x", 1), (None, 0, first[2], "x", 1), (7, 0, [1.0, 2.0, 3.0], "x", 1), (8, 0, [2.0, 4.0, 6.0], None, 1), (9, 0, [float("inf")] * dim, "x", 1)]
    copies = [(5000 + k, first[1], [x * 2.0**k for x in first[2]], "x", 1) for k in range(6)]
    return rows + odd + copies + [first, first] + [(6000, (first[1] + 1) % 3, first[2], "x", 1)]


@pytest.mark.parametrize("seed,dim,block,noise", [(1, 32, 4096, 0.02), (2, 32, 7, 0.02), (3, 5, 4096, 0.05), (4, 96, 40, 0.012)])
def test_equals_all_pairs(spark, seed, dim, block, noise):
    rows = make_rows(seed, dim, noise=noise)
    random.Random(seed).shuffle(rows)
    got = embdedup.near_duplicates(spark.createDataFrame(rows, ROWS), 0.98, block=block).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow(rows, 0.98)))


def test_many_batches_of_one_crowded_bucket(spark):
    """Stored rows and probes of one bucket come in several Arrow batches."""
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(k, 1, (centre + rng.standard_normal(16) * 0.09).tolist(), "x", 1) for k in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = embdedup.near_duplicates(spark.createDataFrame(rows, ROWS), 0.98, block=90).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(slow(rows, 0.98))


def test_empty_table(spark):
    assert embdedup.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def test_estimates_are_unbiased_and_inside_their_bounds():
    rng = np.random.default_rng(8)
    dim, errors, scaled = 48, [], []
    o = unit(rng.standard_normal((1, dim)))[0]
    for cosine in (0.98, 0.9, 0.3):
        for _ in range(1500):
            turn, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            turn = turn * np.sign(np.diag(r))
            beside = rng.standard_normal(dim)
            beside -= (beside @ o) * o
            q = cosine * o + math.sqrt(1 - cosine**2) * beside / np.linalg.norm(beside)
            y = turn @ o
            size = np.abs(y).sum()
            error = np.sign(y) @ (turn @ q) / size - cosine
            errors.append(error)
            scaled.append(error / (math.sqrt((1 - cosine**2) * (dim - size**2) / (dim - 1)) / size))
    assert abs(np.mean(errors)) < 4 * np.std(errors) / math.sqrt(len(errors))
    assert 0.9 < np.std(scaled) < 1.1 and np.abs(scaled).max() < embdedup.SURE


def test_scheme_bounds_the_misses():
    for n in (0, 1, 5000, 10**6, 10**9):
        bands, width = embdedup.scheme(n, 0.98)
        same = 1 - math.acos(0.98) / math.pi
        assert (1 - same**width) ** bands <= embdedup.MISS and n / 2**width <= embdedup.BUCKET or width == 32
