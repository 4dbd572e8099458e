"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q that repeats it at least
``times`` times and can't be extended.  The texts of an Arrow batch are laid
end to end, longest first, with separators that equal nothing, and for each
dyadic scale t = 1, 2, 4, ...

1. stretches of t words get one name per content (doubled from t / 2);
2. a position is in the synchronising set if the least hashed name among the
   stretches that begin in ``[i, i + t]`` is the first or the last of them.
   That depends on the next 2 t words alone, and some position among any t
   neighbours is chosen;
3. stretches inside a known run of period t / 4 or less aren't considered:
   such highly periodic regions were found at the smaller scales, which
   supply their periods;
4. neighbouring positions of the set with equal next 2 t words, t <= q < 2 t
   apart, propose the period q, and the names of all scales extend it to the
   maximal stretch by binary steps.

A run of period q holds a chosen position i at the scale t with
t <= q < 2 t within its first t words, ``i + q`` is chosen too, and no equal
context lies between them, for it would make the period smaller.  So every run
is proposed, and with its smallest period.

A task holds a batch of texts; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # words searched together, about; a longer text goes alone
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def hashed(names: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random order of names; different names never tie."""
    x = (names.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.minimum(x, NONE - np.uint64(1))


def stretch_names(codes: np.ndarray, ends: list[int]) -> list[np.ndarray]:
    """``names[k][i]`` is equal for equal stretches of 2^k codes; ``ends[k]`` is where texts of 2^k codes or more end."""
    names = [codes]
    for k in range(1, len(ends)):
        half = names[-1]
        n = ends[k] - (1 << k) + 1
        a, b = half[:n], half[1 << (k - 1) : n + (1 << (k - 1))]
        names.append(pd.factorize(a * (int(half.max()) + 1) + b)[0])
    return names


def extended(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Move both ends on (step 1) or back (-1) while the codes beside them are equal; a < b."""
    a, b = a.copy(), b.copy()
    for k in range(len(names) - 1, -1, -1):
        width, known = 1 << k, names[k]
        at, to = (a, b) if step > 0 else (a - width, b - width)
        ok = (at >= 0) & (to < len(known))
        ok[ok] = known[at[ok]] == known[to[ok]]
        a, b = a + step * width * ok, b + step * width * ok
    return a, b


def runs_of(codes: np.ndarray, lengths: np.ndarray, times: int = 4) -> np.ndarray:
    """``(start, length, period)`` rows, sorted by start and period, of every run of ``times`` periods or more.

    ``codes`` holds the texts, each followed by one code found nowhere else,
    longest text first; ``lengths`` are the texts' lengths without that code.
    """
    if times < 4:
        raise ValueError("the scales guarantee runs of four periods or more")
    ends = np.cumsum(lengths + 1)

    def end_of(least: int) -> int:
        n = int(np.searchsorted(-lengths, -least, side="right"))
        return int(ends[n - 1]) if n else 0

    top = int(lengths[0]).bit_length() if len(lengths) else 0
    names = stretch_names(codes, [end_of(1 << k) for k in range(top)])
    found = np.zeros((0, 3), dtype=np.int64)
    for k in range(top):
        t = 1 << k
        end = end_of(times * t)
        if not end or k + 1 >= top:
            break
        ids = hashed(names[k][: end - t + 1])
        inner = found[(found[:, 2] * 4 <= t) & (found[:, 1] >= t) & (found[:, 0] < end)]
        if len(inner):
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edge, inner[:, 0], 1)
            np.add.at(edge, inner[:, 0] + inner[:, 1] - t + 1, -1)
            ids[np.cumsum(edge[:-1]) > 0] = NONE
        least, n = ids, len(ids) - t
        for j in range(k):
            least = np.minimum(least[: -(1 << j)], least[1 << j :])
        least = np.minimum(least[:-1], least[1:])[:n]
        chosen = np.flatnonzero(((least == ids[:n]) | (least == ids[t : t + n])) & (least != NONE))
        context = names[k + 1][chosen]
        again = np.bincount(context)[context] > 1 if len(context) else np.zeros(0, dtype=bool)
        chosen, context = chosen[again], context[again]
        order = np.argsort(context, kind="stable")
        chosen, context = chosen[order], context[order]
        gap = chosen[1:] - chosen[:-1]
        good = np.flatnonzero((context[1:] == context[:-1]) & (gap >= t) & (gap < 2 * t))
        if not len(good):
            continue
        a, q = chosen[good], gap[good]
        first, _ = extended(names, a, a + q, -1)
        _, last = extended(names, a + 2 * t, a + q + 2 * t, 1)
        rows = np.unique(np.stack([first, last - first, q], axis=1), axis=0)
        found = np.concatenate([found, rows[rows[:, 1] >= times * rows[:, 2]]])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def searched(texts: list[list[bytes]], times: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text's words: its runs, and which words stay."""
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    known = pa.array([w for i in order for w in texts[i]], pa.large_binary()).dictionary_encode()
    sorted_lengths = lengths[order]
    stops = np.cumsum(sorted_lengths + 1)
    codes = np.empty(int(stops[-1]), dtype=np.int64)
    separator = np.zeros(len(codes), dtype=bool)
    separator[stops - 1] = True
    codes[~separator] = known.indices.to_numpy()
    codes[separator] = len(known.dictionary) + np.arange(len(texts))
    runs = runs_of(codes, sorted_lengths, times)
    runs = runs[runs[:, 1] >= least]
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(edge[:-1]) == 0
    starts = stops - sorted_lengths - 1
    lo, hi = np.searchsorted(runs[:, 0], starts), np.searchsorted(runs[:, 0], stops)
    out: list = [None] * len(texts)
    for j, i in enumerate(order.tolist()):
        own = runs[lo[j] : hi[j]].copy()
        own[:, 0] -= starts[j]
        out[i] = (own, stays[starts[j] : stops[j] - 1])
    return out


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 6,
    times: int = 4,
    edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``runs`` lists every run of at least
    ``least`` words and ``times`` (4 or more) periods as ``(start, length,
    period)``, by start, then period.  ``collapsed`` is the text's words joined
    by one space without those that some run holds after its first period.
    ``edit`` may change a row's words (given its id) before the search.

    Null and empty texts have no words and no runs; repeated rows are searched
    each; a null id is passed on; an empty table gives an empty result; other
    columns are neither read nor returned.  A text is held whole in one task,
    with some 30 bytes a word and scale.
    """

    def result(held: list[tuple[object, list[bytes]]]) -> pa.RecordBatch:
        found = searched([w for _, w in held], times, least)
        every = np.concatenate([r for r, _ in found]) if found else np.zeros((0, 3), dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in found])]).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], fields=list(RUN)))
        texts = [b" ".join(w if stays.all() else [x for x, s in zip(w, stays.tolist()) if s]).decode("utf-8") for (_, w), (_, stays) in zip(held, found)]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array([len(w) for _, w in held], pa.int64()), runs, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for part in parts:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = (text.as_py() or "").encode("utf-8").split()
                words = edit(doc, words) if edit else words
                held.append((doc, words))
                many += len(words) + 1
                if many >= WORDS:
                    yield result(held)
                    held, many = [], 0
        if held:
            yield result(held)

    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The query's input: in a tenth of the documents, by the CRC32 of the id, the words from some place on repeat a period."""
    import zlib

    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of runs and collapsed text."""

    def longest(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] > best["length"]), run).otherwise(best)

    # the list is sorted by start, then period: of equal lengths the first wins
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), longest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
