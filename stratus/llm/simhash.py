"""SimHash near-duplicates by the generalised pigeonhole principle.

Two 64-bit fingerprints within ``distance`` bits agree, for every division of
the bits into m partitions and thresholds t_i that add up to
``distance - m + 1``, to within t_i bits on at least one partition.  So:

1. fingerprint every text (Arrow batches), reduce to distinct fingerprints;
2. count how bits go together over all fingerprints and put correlated bits
   into one partition;
3. count how many pairs share each partition's value, and let a dynamic
   programme give every partition its own threshold at the least estimated
   cost (probe rows plus candidate pairs);
4. deal every fingerprint to its own value of each partition and to the values
   within the threshold, and verify candidates there by their bit distance;
5. contract the verified links to components.

Candidates are verified where their rows meet, and a task passes on only a
spanning forest of its links, so a group of copies yields no more rows than it
has members.  A value shared by more than ``block`` fingerprints is dealt to
several tasks; each holds one block in memory and streams the probes past it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import columns_of, cut, text_key, whole_row
from stratus.llm.components import components

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the XXH64 hashes of all word shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` per row; ``fp`` is the fingerprint as a signed long."""

    def run(parts):
        for part in parts:
            texts = part.column(2)
            fps = np.array([fingerprint(x.as_py(), shingle) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_key", "fp"])

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, "doc_id long, text_key long, fp long")


def bit_pairs(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints in which both bits are set, over all rows (row 64: the number of rows)."""

    def run(parts):
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for part in parts:
            x = np.unpackbits(part.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel().tolist(), n]], pa.list_(pa.int64()))], names=["c"])

    rows = fps.select("fp").mapInArrow(run, "c array<long>").select(F.posexplode("c")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:  # a fixed 4,097 numbers
        flat[r["pos"]] = r["n"]
    return flat


def correlated_groups(flat: np.ndarray, m: int) -> list[list[int]]:
    """Divide the bits into m groups of (nearly) equal size, correlated bits together."""
    n = max(flat[-1], 1.0)
    both, p = flat[:-1].reshape(BITS, BITS) / n, np.diag(flat[:-1].reshape(BITS, BITS)) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for i in range(m):
        size = len(free) // (m - i)
        seed = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(width: int, t: int) -> int:
    """Number of values within t bits of one value."""
    return sum(math.comb(width, k) for k in range(t + 1)) if t >= 0 else 0


def allocate(widths: list[int], same: list[float], n: int, distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``distance - m + 1`` of least estimated cost.

    Cost of partition i at t: probe rows ``n * within(t)`` plus candidate pairs,
    estimated as pairs that share the value times the values within t.
    """
    m = len(widths)
    budget = distance - m + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # thresholds used + one for each partition
    for w, s in zip(widths, same):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance + 1):
                v = within(w, t)
                if v > 50_000:
                    continue
                total = cost + n * v + max(s, n * (n - 1.0) / 2 / 2.0**w) * v
                key = used + t + 1
                if key <= budget + m and (key not in step or total < step[key][0]):
                    step[key] = (total, [*ts, t])
        best = step
    return best.get(budget + m, (math.inf, []))


def scheme(fps: DataFrame, distance: int, choices: tuple[int, ...]) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each partition, from counts over all fingerprints."""
    flat = bit_pairs(fps)
    n = int(flat[-1])
    options = {m: correlated_groups(flat, m) for m in choices}
    parts = [(m, i, bits) for m, groups in options.items() for i, bits in enumerate(groups)]
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), gathered(F.col("fp"), bits).alias("v")) for m, i, bits in parts])
    counts = fps.select(F.explode(keys).alias("k")).groupBy("k.m", "k.i", "k.v").agg(F.count("*").alias("c"))
    same = {(r["m"], r["i"]): float(r["s"]) for r in counts.groupBy("m", "i").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("s")).collect()}
    found = {m: allocate([len(g) for g in groups], [same.get((m, i), 0.0) for i in range(m)], n, distance) for m, groups in options.items()}
    m = min(found, key=lambda k: found[k][0])
    return list(zip(options[m], found[m][1]))


def gathered(fp, bits: list[int]):
    """The partition's bits of a fingerprint, in place (other bits zero)."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def flips(bits: list[int], t: int) -> list[int]:
    """XOR masks of 1 to t of the partition's bits, as signed longs."""
    from itertools import combinations

    masks = [sum(1 << b for b in chosen) for k in range(1, t + 1) for chosen in combinations(bits, k)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def _forest(distance: int):
    """mapInArrow function over rows sorted by (part, value, block, probe): verified links, as a spanning forest."""

    def run(parts):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            r = parent.setdefault(x, x)
            while parent[r] != r:
                r = parent[r]
            while parent[x] != r:
                parent[x], x = r, parent[x]
            return r

        held = None  # stored rows of the run that the last batch ended in: key, fps
        for part in parts:
            p, v, k, probe, fp = (part.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            skip = 0
            if held is not None and len(fp) and (p[0], v[0], k[0]) == held[0]:
                skip = len(held[1])
                p, v, k, probe, fp = (np.concatenate([a, b]) for a, b in zip((np.full(skip, p[0], p.dtype), np.full(skip, v[0], v.dtype), np.full(skip, k[0], k.dtype), np.zeros(skip, probe.dtype), held[1]), (p, v, k, probe, fp)))
            if not len(fp):
                continue
            new = np.empty(len(fp), dtype=bool)
            new[0] = True
            new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1]) | (k[1:] != k[:-1])
            run_of = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            stored = np.bincount(run_of, weights=probe == 0, minlength=len(first)).astype(np.int64)
            at = np.arange(len(fp))
            many = np.minimum(at - first[run_of], stored[run_of])
            many[:skip] = 0
            a_out, b_out = [], []
            todo = np.flatnonzero(many)
            done = 0
            while done < len(todo):  # at most some millions of pairs at a time
                upto = done + max(1, int(np.searchsorted(np.cumsum(many[todo[done:]]), 2_000_000)))
                rows = todo[done:upto]
                left = np.repeat(rows, many[rows])
                right = np.arange(len(left)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows]) + first[run_of[left]]
                near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= distance
                for x, y in zip(fp[left[near]].tolist(), fp[right[near]].tolist()):
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
                        a_out.append(x)
                        b_out.append(y)
                done = upto
            last = first[-1]
            held = ((p[-1], v[-1], k[-1]), fp[last:][probe[last:] == 0])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def links(fps: DataFrame, distance: int, choices: tuple[int, ...] = (1, 2, 3, 4, 5), block: int = 4096) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``fps(fp)`` that connect
    exactly what all pairs within ``distance`` bits connect."""
    found = scheme(fps, distance, tuple(m for m in choices if m <= distance + 1))
    own, probes = [], []
    for i, (bits, t) in enumerate(found):
        if t < 0:
            continue
        value = gathered(F.col("fp"), bits)
        own.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
        if t > 0:
            masks = F.array(*[F.lit(x).cast("long") for x in flips(bits, t)])
            probes.append(F.transform(masks, lambda x: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(x).alias("value"))))
    stored = fps.select("fp", F.explode(F.array(*own)).alias("k")).select(F.col("k.part").alias("part"), F.col("k.value").alias("value"), "fp")
    large = stored.groupBy("part", "value").agg(F.count("*").alias("c")).filter(F.col("c") > block).withColumn("blocks", F.ceil(F.col("c") / block).cast("int")).drop("c")
    large = cut(large)
    rows = stored.withColumn("probe", F.lit(0))
    if probes:
        asked = fps.select("fp", F.explode(F.concat(*probes)).alias("k")).select(F.col("k.part").alias("part"), F.col("k.value").alias("value"), "fp", F.lit(1).alias("probe"))
        rows = rows.unionByName(asked)
    if large.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:  # each block of a crowded value is a key of its own; every row of the value, stored ones too, probes all of them
        rows = rows.join(large, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(j.alias("block"), F.when((F.col("probe") == 0) & (j == mine), F.lit(0)).otherwise(F.lit(1)).alias("probe")))
        rows = rows.select("part", "value", "fp", F.explode(spread).alias("s")).select("part", "value", "fp", F.col("s.block").alias("block"), F.col("s.probe").alias("probe"))
    rows = rows.select("part", "value", "block", "probe", "fp").repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "probe")
    return rows.mapInArrow(_forest(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int, distance: int, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """``(doc_id, text_key, fp, component_id, kept)``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` bits; ``kept`` marks the rows that carry the smallest
    ``(doc_id, text_key)`` of their component (null ids come last).  Null and
    empty texts have fingerprint 0 and link to each other; rows that repeat id
    and text share their result; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("first")
    distinct = cut(rows.groupBy("fp").agg(first))
    parts = components(links(distinct.select("fp"), distance, block=block))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_key").alias("least_key"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("least_key"))
    return rows.join(by_fp, "fp").select("doc_id", "text_key", "fp", "component_id", same.alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, columns unchanged, whatever their
    names; of rows that repeat the kept row's id and text, one stays."""
    found = near_duplicates(docs, shingle, distance, id_col, text_col).filter("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    found = cut(found)
    keyed = docs.select(whole_row(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    once = keyed.join(found.filter("copies = 1"), same, "left_semi")
    again = keyed.join(found.filter("copies > 1"), same, "left_semi").dropDuplicates(["id", "key"])
    return once.unionByName(again).select(*columns_of("row", docs.columns))
