"""Collocations: summaries keep what is frequent, results equal plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from stratus.llm import phrases

DOCS = "doc_id long, lang string, text string, phrase string, n int"


def slow(rows, longest, threshold, share, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in cand.items():
            inside = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def make_rows(seed=4, many=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "ünder", "a-b", "\x85x", "日本"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(many):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(("New York City", "of the", rng.choice(words), rng.choice(words), "x y z")) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0c"))
        rows.append((i, rng.choice(("en", "en", "de", None, "und")), text, "p", 1))
    long = (9000, "en", "very common " * 20_000 + "!", "p", 1)
    return rows + [rows[0], rows[0], (None, "fr", "rare words only", None, 1), (5, "fr", None, "p", 1), (6, None, "", "p", None), long]


@pytest.mark.parametrize("longest,threshold,share,top", [(3, 10, 50, 2000), (3, 10, 50, 7), (4, 5, 80, 2000), (2, 12, 50, 2000)])
def test_equals_plain_counting(spark, longest, threshold, share, top):
    rows = make_rows()
    got = phrases.collocations(spark.createDataFrame(rows, DOCS), longest, threshold, share, top).collect()
    assert sorted(tuple(r) for r in got) == slow([(r[1], r[2]) for r in rows], longest, threshold, share, top)


def test_reductions_and_small_chunks_lose_nothing(spark, monkeypatch):
    rows = make_rows(8, 200)
    want = slow([(r[1], r[2]) for r in rows], 3, 10, 50, 2000)
    found = phrases.survivors(phrases.given(spark.createDataFrame(rows, DOCS), "lang", "text"), 3, 10, 7)
    assert found.filter("h is not null").count() >= len(want)
    rng = np.random.default_rng(3)
    keys = rng.zipf(1.3, 60_000).astype(np.uint64) % np.uint64(20_000)
    true = Counter(keys.tolist())
    for threshold in (5, 10, 60):
        s = phrases.Summary(len(keys) // threshold + 1)
        for lo in range(0, len(keys), 3000):
            s.add(*map(np.asarray, np.unique(keys[lo : lo + 3000], return_counts=True)))
        kept = set(s.possible(threshold).tolist())
        assert {k for k, n in true.items() if n >= threshold} <= kept
        assert s.lost < threshold and len(s.keys) <= s.capacity
        assert all(true[k] - s.lost <= n <= true[k] for k, n in zip(s.keys.tolist(), s.counts.tolist()))


def test_squeezed_numbers_come_back():
    for numbers in ([], [0], [1, 255, 256, 2**32 - 1, 7]):
        x = np.array(numbers, dtype=np.uint32)
        assert phrases.unsqueezed(phrases.squeezed(x)).tolist() == numbers


def test_merged_summaries_keep_the_bound():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 9000, 50_000).astype(np.uint64)
    keys[::7] = 4
    true, parts = Counter(keys.tolist()), []
    capacity = len(keys) // 40 + 1
    for lo in range(0, len(keys), 10_000):
        s = phrases.Summary(capacity)
        s.add(*map(np.asarray, np.unique(keys[lo : lo + 10_000], return_counts=True)))
        s.merge()
        parts.append(s)
    whole = phrases.Summary(capacity)
    for s in parts:
        whole.add(s.keys, s.counts)
    whole.merge()
    lost = whole.lost + sum(s.lost for s in parts)
    assert lost <= len(keys) / (capacity + 1) < 40
    assert all(n - lost <= dict(zip(whole.keys.tolist(), whole.counts.tolist())).get(k, 0) <= n for k, n in true.items())


def test_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 4_000_000_000)], "a long, l long, r long")
    assert counts.select(phrases.cut_score()).first()[0] == 10**6 * 3_000_000_000**2 // (3_000_000_001 * 4_000_000_000)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(empty).count() == 0


def test_chunks_of_short_words_are_bounded_by_their_words(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(phrases, "CHUNK", 600_000)
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdef", k=1000)) for _ in range(400)] + [None, ""]
    part = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 201), pa.array([t or "" for t in texts])], names=["lang", "text"])
    sizes = [(lang, len(w.codes)) for lang, w in phrases.chunks(iter([part]))]
    assert sum(n for _, n in sizes) == 400_000 and {lang for lang, _ in sizes} == {"en", "de"}
    assert max(n for _, n in sizes) <= 600_000 // phrases.WORD + 1000  # as many words as 6-byte words would be
    words = phrases.Words([t.encode() for t in texts[:100]])
    tracemalloc.start()
    found, counts = phrases.grams(words, "en", 3, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 3 * 100_000 - 3 * 100 and len(found) == 6 + 36 + 216
    assert peak < 90 * len(words.codes)  # bytes a word
