"""Rule ensemble: rules from trees, compiled scores against plain Python, held-out accuracy."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratus.llm import quality

TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 5 <= 0.25)
   If (feature 0 <= 12.5)
    Predict: 1.0
   Else (feature 0 > 12.5)
    Predict: 0.0
  Else (feature 5 > 0.25)
   Predict: 0.0
"""


def test_paths_become_rules():
    got = quality.tree_rules(TREE)
    assert got == [((5, "<=", 0.25),), ((5, "<=", 0.25), (0, "<=", 12.5)), ((5, "<=", 0.25), (0, ">", 12.5)), ((5, ">", 0.25),)]
    assert quality.merged(((1, "<=", 3.0), (1, "<=", 2.0), (0, ">", 1.0))) == ((0, ">", 1.0), (1, "<=", 2.0))


def test_statistics_of_plain_and_odd_texts(spark):
    rows = [(1, "ab ab ab c."), (2, ""), (3, None), (4, "a|b | c\nD 12"), (5, "x " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in docs.select("doc_id", *[v.alias(k) for k, v in quality.statistics(F.col("text")).items()]).collect()}
    assert list(quality.statistics(F.col("text"))) == quality.STATS
    assert got[1]["repeated_words"] == 0.5 and got[1]["distinct_words"] == 0.5 and got[1]["stops"] == 0.25
    assert got[4]["symbols"] == 2 / 12 and got[4]["capitals"] == 1 / 12 and got[4]["digits"] == 2 / 12 and got[4]["lines"] == 1 / 5
    assert got[2]["chars"] == got[3]["chars"] == 0 and got[5]["words"] == 60_000
    assert all(v is not None and math.isfinite(v) for r in got.values() for v in r)


def test_compiled_score_matches_python(spark):
    model = quality.RuleModel(0.5, [(((5, "<=", 0.1), (0, ">", 3.0)), 1.25), (((4, ">", 0.2),), -2.0)])
    rows = [(i, t) for i, t in enumerate(["", None, "a a a", "fine text here.", "## $$ %%", "word " * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    stats = {r["doc_id"]: r for r in docs.select("doc_id", *[v.alias(k) for k, v in quality.statistics(F.col("text")).items()]).collect()}
    for r in quality.scored(docs, model).collect():
        s = stats[r["doc_id"]]
        z = 0.5 + (1.25 if s["symbols"] <= 0.1 and s["chars"] > 3 else 0) - (2.0 if s["repeated_words"] > 0.2 else 0)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)))


def corpus(n):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        docs.append((i, " ".join(w + rng.choice(("***", "###")) if bad else w for w in words), "en"))
        labels.append((i, int(not bad), None))
    return docs, labels + [(1, 1, 0), (None, 1, 0), (2, None, 0), (10**9, 0, 0)]


def test_learns_and_generalises(spark):
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.judge(d, lab).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and 40 < len(held) < 120
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_without_usable_labels(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.judge(d, none).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.judge(d, one).collect())
    assert quality.judge(d.limit(0), none).count() == 0


def test_query_on_held_out_labels(spark):
    from stratus.llm.queries import QUERIES

    root = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, root).collect()}
    labels = [r for r in spark.read.parquet(f"{root}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels) / len(labels)
    assert len(labels) > 40 and right > 0.9
