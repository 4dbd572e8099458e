"""Phrase collocations by mergeable Misra-Gries summaries.

First pass: tasks count the n-grams of their texts by a hash and deal the
counts to hash partitions; within one, 32 bits of the hash name the n-gram, a
few thousand times more than a partition holds.  A partition's task adds up its mass first and
then merges the counts into one Misra-Gries summary whose capacity exceeds
mass divided by threshold, so what is subtracted from a counter in all stays
below the threshold and every n-gram that reaches it survives.  (Two n-grams
of one hash share a counter, which can only keep more.)  A summary's size is
bound by its partition's mass, and the number of partitions follows the
input.

Second pass: the texts are read again, n-grams whose hash doesn't survive are
dropped where the texts are, by a filter of fixed size, and the others are
counted exactly, by their words; those below the threshold go.  (Beyond some
10^8 survivors the filter lets more and more through, which costs shuffle, not
correctness.)

The counts of a phrase's parts, cuts, scores and ranks are DataFrame steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import cut

MASS = 4_000_000  # n-gram occurrences of a hash partition, about
SLACK = 4  # capacity, in multiples of the least one: a larger summary lets fewer rare n-grams survive
CHUNK = 12 << 20  # bytes of text counted together, about (of short words fewer: a word counts as WORD bytes at least)
WORD = 6
SLICE = 1 << 18  # n-grams looked up in the filter together
BITS, PROBES = 27, 3  # the filter has 2^BITS bits (16 MiB), whatever the input, PROBES of them for each hash

#: A-Z to a-z; ends of pieces to \n.
FOLD = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of some texts: codes into a dictionary, and the piece each stands in."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        texts.clear()
        raw = np.frombuffer((joined + b"\n").translate(FOLD), dtype=np.uint8)
        del joined
        gap = (raw == 32) | (raw == 9) | (raw == 10)
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        begin, end = edge[0::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(raw == 10), begin).astype(np.int32)
        offsets = np.zeros(len(begin) + 1, dtype=np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        del begin, end, edge
        letters = raw[~gap]
        del raw, gap
        packed = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        known = packed.dictionary_encode()
        self.codes, self.known = known.indices.to_numpy(), known.dictionary

    def hashes(self, lang: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For n = 1 .. longest: the hash of the n words from each word on (those of one piece only count, see ``whole``)."""
        import xxhash

        seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
        own = np.array([xxhash.xxh64_intdigest(w.as_py(), seed) for w in self.known], dtype=np.uint64)[self.codes]
        last = mixed(own)
        for n in range(1, longest + 1):
            if n > 1 and len(last):
                last = mixed(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 :] + np.uint64(n))
            yield n, last

    def whole(self, n: int) -> np.ndarray:
        """Places from which n words stand in one piece."""
        last = len(self.piece) - n + 1
        return np.flatnonzero(self.piece[: max(last, 0)] == self.piece[n - 1 :])


def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Texts of one language, about CHUNK bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def dealt():  # a language's texts go as its words come
        while held:
            lang, texts = held.popitem()
            yield lang, Words(texts)

    for part in parts:
        for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
            raw = text.as_py().encode("utf-8")
            held.setdefault(lang, []).append(raw)
            size += max(len(raw), WORD * sum(map(raw.count, (b" ", b"\t", b"\n")))) + 64
            if size >= CHUNK:
                yield from dealt()
                size = 0
    yield from dealt()


def named(x: np.ndarray, partitions: int) -> np.ndarray:
    """The hash partition (high) and the 32 bits within it (low) of 64-bit hashes."""
    return (x % np.uint64(partitions)) << np.uint64(32) | (x // np.uint64(partitions)) & np.uint64(0xFFFFFFFF)


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all first bytes first: small ones leave long runs of zeros to the shuffle's compression."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unsqueezed(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters (during a merge, twice as many).

    After merging counts of mass M in all, no counter is ``M / (capacity + 1)``
    or more below the key's true count; keys without counter have count 0.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        for lo in range(0, len(keys), self.capacity):
            self.waiting.append((keys[lo : lo + self.capacity], counts[lo : lo + self.capacity]))
            self.many += len(self.waiting[-1][0])
            if self.many >= self.capacity:
                self.merge()

    def merge(self) -> None:
        keys, counts = summed(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), np.concatenate([self.counts, *(c for _, c in self.waiting)]))
        self.waiting, self.many = [], 0
        if len(keys) > self.capacity:  # take the (capacity + 1)th largest count from all
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.lost += off
            kept = counts > off
            keys, counts = keys[kept], counts[kept] - off
        self.keys, self.counts = keys, counts

    def possible(self, threshold: int) -> np.ndarray:
        """Every key whose true count may reach the threshold."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def grams(words: Words, lang: str, longest: int, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Named hashes of the n-grams of 1 to ``longest`` words, sorted, with their counts."""
    found = np.empty(longest * len(words.codes), dtype=np.uint64)
    many = 0
    for n, h in words.hashes(lang, longest):
        at = words.whole(n)
        found[many : many + len(at)] = named(h[at], partitions)
        many += len(at)
    found = found[:many]
    found.sort()
    new = np.flatnonzero(np.concatenate([np.ones(min(many, 1), dtype=bool), found[1:] != found[:-1]]))
    return found[new], np.diff(new, append=many).astype(np.uint32)


def _counted(partitions: int, longest: int):
    """mapInArrow function: mass rows (kind 0), counts by hash (kind 1) and words of each language (kind 2)."""

    def run(parts):
        for lang, words in chunks(parts):
            found, counts = grams(words, lang, longest, partitions)
            some, first = np.unique(found >> np.uint64(32), return_index=True)
            some, ends = some.astype(np.int64), [*first[1:].tolist(), len(found)]
            spans = list(zip(first.tolist(), ends))
            mass = [int(counts[a:b].sum(dtype=np.int64)) for a, b in spans]
            n = len(some)
            low = found.astype(np.uint32)  # sorted within a partition: kept as differences
            keys = [squeezed(np.diff(low[a:b], prepend=np.uint32(0))) for a, b in spans]
            out = [(some, 0, None, mass, None, None)]
            out.append((some, 1, None, [0] * n, keys, [squeezed(counts[a:b]) for a, b in spans]))
            out.append((some[:1], 2, lang, [len(words.codes)], None, None))
            for part_, kind, lang_, many, k, c in out:
                m = len(part_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_, pa.int64()), pa.array([kind] * m, pa.int32()), pa.array([lang_] * m, pa.string()), pa.array(many[:m], pa.int64()), pa.array(k or [None] * m, pa.binary()), pa.array(c or [None] * m, pa.binary())],
                    names=["part", "kind", "lang", "mass", "keys", "counts"],
                )

    return run


def _summarised(threshold: int):
    """mapInArrow function over rows sorted by (part, kind): surviving hashes, and the words of each language."""

    def done(part: int | None, summary: Summary | None):
        if summary is not None:
            keys = (summary.possible(threshold) | np.uint64(part << 32)).view(np.int64)
            for lo in range(0, len(keys), 1 << 16):
                some = keys[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64())], names=["h", "lang", "n"])

    def run(parts):
        now, mass, summary = None, 0, None
        for batch in parts:
            for row in batch.to_pylist():
                if row["part"] != now:
                    yield from done(now, summary)
                    now, mass, summary = row["part"], 0, None
                if row["kind"] == 0:
                    mass += row["mass"]
                elif row["kind"] == 1:
                    summary = summary or Summary(SLACK * (mass // threshold + 1))
                    summary.add(np.cumsum(unsqueezed(row["keys"]), dtype=np.uint64), unsqueezed(row["counts"]).astype(np.int64))
                else:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([row["lang"]], pa.string()), pa.array([row["mass"]], pa.int64())], names=["h", "lang", "n"])
        yield from done(now, summary)

    return run


def given(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def hash_partitions(texts: DataFrame, longest: int) -> int:
    """As many as the input asks for; a word takes about 6 bytes."""
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    return int(max(1, -(-longest * size // (6 * MASS))))


def survivors(texts: DataFrame, longest: int, threshold: int, partitions: int) -> DataFrame:
    """``(h, lang, n)``: hashes of n-grams that may occur ``threshold`` times (lang and n null), and word counts of languages (h null)."""
    counted = texts.mapInArrow(_counted(partitions, longest), "part long, kind int, lang string, mass long, keys binary, counts binary")
    return cut(counted.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_summarised(threshold), "h long, lang string, n long"))


def places(h: np.ndarray) -> list[np.ndarray]:
    """Bits of the filter for each hash."""
    return [mixed(h + np.uint64(k)) >> np.uint64(64 - BITS) for k in range(1, PROBES + 1)]


def present(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have all their bits in the filter."""
    kept = np.ones(len(h), dtype=bool)
    for p in places(h):
        kept &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return kept


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The filter's bits of the surviving hashes."""

    def run(parts):
        for part in parts:
            at = np.concatenate(places(part.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

    found = hashes.mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2^(BITS - 6) rows
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _exact(bits, longest: int, partitions: int):
    """mapInArrow function: exact counts, by their words, of each chunk's n-grams whose hash has its bit."""

    def run(parts):
        held = bits.value
        for lang, words in chunks(parts):
            text, base = words.known.cast(pa.large_string()), len(words.known)
            for n, gram in words.hashes(lang, longest):
                at = words.whole(n)
                at = np.concatenate([at[:0], *(some[present(held, named(gram[some], partitions))] for some in (at[lo : lo + SLICE] for lo in range(0, len(at), SLICE)))])
                if not len(at):
                    continue
                key = words.codes[at].astype(np.int64)
                for k in range(1, n):  # one number for equal word sequences
                    key = np.unique(key, return_inverse=True)[1] * base + words.codes[at + k]
                _, first, many = np.unique(key, return_index=True, return_counts=True)
                place = at[first]
                phrase = pc.binary_join_element_wise(*[text.take(pa.array(words.codes[place + k])) for k in range(n)], pa.scalar(" ", pa.large_string()))
                for lo in range(0, len(place), 1 << 16):
                    hi = min(lo + (1 << 16), len(place))
                    m = hi - lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * m, pa.string()), pa.array([n] * m, pa.int32()), phrase[lo:hi].cast(pa.string()), pa.array(many[lo:hi].astype(np.int64))],
                        names=["lang", "size", "phrase", "f"],
                    )

    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, threshold: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of every phrase of 1 to ``longest`` words that occurs
    ``threshold`` times in its language, with its exact count, and ``(lang, n)``, the words of each language."""
    spark, texts = docs.sparkSession, given(docs, lang_col, text_col)
    partitions = hash_partitions(texts, longest)
    found = survivors(texts, longest, threshold, partitions)
    hashes = found.filter("h is not null").select("h")
    bits = spark.sparkContext.broadcast(bitmap(hashes))
    rows = texts.mapInArrow(_exact(bits, longest, partitions), "lang string, size int, phrase string, f long")
    counts = rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= threshold)
    return cut(counts), found.filter("h is null").groupBy("lang").agg(F.sum("n").alias("n"))


def _part(phrase: str, first: Column, many: Column) -> Column:
    """``many`` words of a phrase from the ``first`` on."""
    return F.array_join(F.slice(F.split(F.col(phrase), " ", -1), first, many), " ")


def cut_score() -> Column:
    """``floor(10^6 a a / (l r))``, exact: the products are decimals of 38 digits."""
    return F.expr("cast((cast(a as decimal(38, 0)) * cast(a as decimal(19, 0)) * 1000000) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as long)")


def collocations(docs: DataFrame, longest: int = 3, threshold: int = 10, share: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces,
    and those at spaces and tabs into words; counts are of occurrences within
    pieces, overlaps included.  A phrase that occurs ``threshold`` times is a
    candidate; its score is the least, over its cuts, of
    ``floor(10^6 a a / (l r))``.  A candidate inside a longer one that has at
    least ``share`` percent of its count is dropped.  Order: score, then count,
    falling, then phrase.

    A null language counts as ``und``, a null text as empty; repeated rows
    count each; a language without candidates has no rows, and an empty table
    gives an empty result; other columns are neither read nor returned.  A
    text is held whole in one task.
    """
    counts, totals = frequent_phrases(docs, longest, threshold, lang_col, text_col)
    wide = counts.filter("size > 1")
    # every cut asks for the counts of its two parts
    cuts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.col("size") - 1),
            lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), _part("phrase", F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), _part("phrase", k + 1, F.col("size") - k).alias("part"))),
        )
    )
    asked = wide.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", "c.side", "c.part")
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    # at most 2 (longest - 1) counts of a phrase
    sides = asked.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k") * 2 + F.col("side"), F.col("of")))).alias("of"))
    parts = sides.withColumn("k", F.explode(F.sequence(F.lit(1), F.expr("cast(size(of) / 2 as int)")))).select("lang", "phrase", "a", "k", F.element_at("of", F.col("k") * 2).alias("l"), F.element_at("of", F.col("k") * 2 + 1).alias("r"))
    scored = parts.select("lang", "phrase", "a", F.struct(cut_score().alias("score"), "k", "l", "r").alias("best")).groupBy("lang", "phrase", "a").agg(F.min("best").alias("best"))
    inside = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part("phrase", i, m)))
    )
    longer = wide.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    rows = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH piece AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
c AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS s FROM c WHERE size > 1 AND f >= 10),
places AS (
  SELECT lang, phrase, a, size, s, unnest(range(1, size)) AS k FROM cand),
cut AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS p, array_to_string(s[k + 1:], ' ') AS q FROM places),
side AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * cut.a * cut.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = cut.p
           JOIN c y ON y.lang = cut.lang AND y.phrase = cut.q),
low AS (SELECT * FROM side QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, s[1] || ' ' || s[2] AS phrase, a FROM cand WHERE size = 3
    UNION ALL SELECT lang, s[2] || ' ' || s[3], a FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""
