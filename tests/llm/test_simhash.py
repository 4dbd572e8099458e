"""SimHash near-duplicates against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import types as T

from stratus.llm import simhash
from stratus.llm.components import components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def slow_fingerprint(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def least(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b) and root(a) != root(b):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {n: root(n) for n in nodes}


def test_fingerprint_is_spark_compatible_xxhash(spark):
    assert spark.sql("select xxhash64('a b c d') h").first()["h"] % 2**64 == xxhash.xxh64(b"a b c d", seed=42).intdigest()
    for text in (None, "", " \n", "one", "One TWO three four five six", "é È\x0bx y z", "a " * 500):
        assert simhash.fingerprint(text, 4) == slow_fingerprint(text, 4)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in edges if a is not None and a != b}
    nodes = {x for p in pairs for x in p}
    assert got == least(sorted(nodes), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block,choices", [(4096, (1, 2, 3, 4, 5)), (3, (3,)), (3, (5,)), (50, (2,))])
def test_links_connect_what_all_pairs_connect(spark, block, choices):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for c in centres:
        for _ in range(rng.choice((1, 4, 40))):
            values.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, choices, block).collect()
    want = least(signed, lambda a, b: (a ^ b) % 2**64 in range(2**64) and bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in edges)
    linked = {(a, b) for a, b in edges}
    assert least(signed, lambda a, b: (a, b) in linked or (b, a) in linked) == want


def make_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.choice((3, 60, 300)))]
        rows.append((100 + i, " ".join(text), "x"))
        for j in range(rng.choice((0, 0, 3))):
            copy = list(text)
            copy[rng.randrange(len(copy))] = "edited"
            rows.append((1000 + 10 * i + j, "\n".join(copy).upper(), "y"))
    return rows + [(1, None, "n"), (2, "", None), (3, "  ", "n"), (None, "lonely null id text", "n"), (5, "same row", "n"), (5, "same row", "n"), (5, "but other words here under one id", "n")]


def test_near_duplicates_match_brute_force(spark):
    rows = make_rows()
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 4).collect()
    assert len(got) == len(rows)
    fps = {(r[0], r[1]): slow_fingerprint(r[1], 4) for r in rows}
    comp = least(set(fps.values()), lambda a, b: bin(a ^ b).count("1") <= 4)
    ids = {}
    for (i, t), fp in fps.items():
        if i is not None:
            ids[comp[fp]] = min(i, ids.get(comp[fp], 10**9))
    want = sorted((str(i), fps[i, t], str(ids.get(comp[fps[i, t]]))) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want


def test_drop_keeps_one_row_of_each_component(spark):
    rows = make_rows()
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.drop_near_duplicates(docs, 4, 4)
    assert kept.columns == docs.columns
    fps = [slow_fingerprint(r["text"], 4) for r in kept.collect()]
    comp = least({slow_fingerprint(t, 4) for _, t, _ in rows}, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert sorted(comp[f] for f in fps) == sorted(set(comp.values()))
    assert simhash.drop_near_duplicates(docs.limit(0), 4, 4).count() == 0
