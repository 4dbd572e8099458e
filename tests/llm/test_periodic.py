"""Periodic runs against a search of all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stratus.llm import periodic

DOCS = "doc_id long, text string, runs string, n_words int"


def slow_runs(w, least=6, times=4):
    out, n = set(), len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                part = w[i : j + q]
                smaller = any(part[p:] == part[: len(part) - p] for p in range(1, q))
                if len(part) >= max(least, times * q) and not smaller:
                    out.add((i, len(part), q))
            i = j + 1
    return sorted(out)


def slow_plant(doc, w):
    h = zlib.crc32(str(doc).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def some_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        alphabet = rng.choice((1, 2, 2, 3, 6, 60))
        w = [b"%d" % rng.randrange(alphabet) for _ in range(rng.randint(0, 130))]
        for _ in range(rng.randint(0, 3)):
            block = [b"%d" % rng.randrange(alphabet) for _ in range(rng.randint(1, 14))]
            at = rng.randint(0, len(w))
            w[at:at] = (block * 9)[: rng.randint(len(block), 9 * len(block))] * rng.choice((1, 1, 1, 5))
        yield w


@pytest.mark.parametrize("times,least", [(4, 6), (4, 0), (5, 12)])
def test_every_run_is_found(times, least):
    texts = list(some_texts(times + least, 400))
    for k in range(0, len(texts), 9):
        some = texts[k : k + 9]
        for w, (runs, stays) in zip(some, periodic.searched(some, times, least)):
            want = slow_runs(w, least, times)
            assert [tuple(r) for r in runs.tolist()] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert stays.tolist() == [i not in gone for i in range(len(w))]


def test_long_periods_and_nested_runs():
    rng = random.Random(2)
    inner = [b"x"] * 9 + [b"%d" % rng.randrange(50) for _ in range(300)] + [b"a", b"b"] * 30
    text = [b"head"] + inner * 5 + inner[:77] + [b"tail"]
    (runs, _), = periodic.searched([text], 4, 6)
    got = [tuple(r) for r in runs.tolist()]
    assert got == slow_runs(text) and (1, 5 * len(inner) + 77, len(inner)) in got
    same = [b"z"] * 40_000
    assert [tuple(r) for r in periodic.searched([same], 4, 6)[0][0].tolist()] == [(0, 40_000, 1)]
    with pytest.raises(ValueError):
        periodic.runs_of(np.array([0, 1]), np.array([1]), times=3)


def test_query_columns_match_a_plain_loop(spark):
    rng = random.Random(9)
    texts = [(b" ".join(w)).decode() for w in some_texts(7, 60)]
    rows = [(i, t.replace(" ", rng.choice((" ", "\n", "\t \x0b"))), "x", i) for i, t in enumerate(texts)]
    rows += [(900, None, "x", 1), (901, "", None, 1), (902, " \n", "x", 1), (3, rows[3][1], "x", 1), (3, rows[3][1], "x", 1), (None, "é é é é é é é", "x", 1), (5, "w " * 30_000 + "end", "x", None)]
    got = periodic.digests(periodic.periodic_runs(spark.createDataFrame(rows, DOCS), edit=periodic.planted)).collect()
    want = []
    for doc, text, *_ in rows:
        w = [x for x in (text or "").encode().split()]
        w = slow_plant(doc, w) if doc is not None else w
        runs = slow_runs(w) if len(w) < 5000 else [(0, 30_000, 1)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert periodic.digests(periodic.periodic_runs(spark.createDataFrame([], DOCS))).count() == 0


def test_real_outputs(spark):
    row = periodic.periodic_runs(spark.createDataFrame([(1, "a b a b a b a b c", "", 0)], DOCS)).first()
    assert row["n_words"] == 9 and row["collapsed"] == "a b c" and [tuple(r) for r in row["runs"]] == [(0, 8, 2)]
