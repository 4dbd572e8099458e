"""Connected components of an edge table, as Spark joins.

Alternating star contraction: every node hands its larger neighbours to its
smallest neighbour (large star), then its smaller neighbours to the smallest
of them (small star).  The edges shrink to one star per component, whose
centre is the component's smallest node.  Each round is checkpointed to the
shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a")
    return kept.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)`` for every node that has
    an edge to another node; ``component`` is the smallest node reachable.

    Edges with a null end and self loops are ignored; repeated edges count
    once; an empty table gives an empty result.
    """
    now = cut(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .filter("a is not null and b is not null and a <> b")
        .distinct()
    )
    before = None
    while True:
        now = cut(_small_star(_large_star(now)).filter("a <> b").distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
