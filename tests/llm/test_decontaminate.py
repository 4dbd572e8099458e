"""Decontamination against a brute-force scan, on small tables with odd rows."""

import hashlib
import random
import re

from stratus.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string"


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def slow(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t, *_ in docs:
        w = words(t)
        hit, ids = set(), set()
        for win, owners in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= owners - {None}
        ids = sorted(map(str, ids))
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables():
    rng = random.Random(6)
    vocabulary = ["the", "of", "Ärger", "x1", "no", "été", "ΑΣ", "b", "cat", "Rare"] + [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice((10, 12, 30)))) for i in range(12)] + [(50, "lonely phrase"), (51, ""), (52, None), (53, say(9)), (None, say(11)), (54, "a a a a a a a a a a a"), (55, "zebra")]
    items += [items[0], (99, items[1][1])]
    docs = []
    for d in range(60):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            i = rng.choice(items)[1] or ""
            parts += [rng.choice((i, i.upper(), i.replace(" ", " -- "), " ".join(i.split()[1:]))), say(rng.randint(0, 15))]
        docs.append((d, rng.choice((" ", "\n", "|")).join(parts), "z"))
    docs += [(None, "zebra", "n"), (7, None, "n"), (8, "", None), (9, "a " * 30, "n"), docs[3], docs[3], (5, "one id, LONELY phrase; two texts", "n"), (77, "very long " * 5000 + items[2][1], "n")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = tables()
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == slow(docs, items)


def test_drop_keeps_the_clean_rows(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, DOCS)
    kept = decontaminate.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    bad = {(r[0], r[1]) for r in slow(docs, items) if r[5]}
    assert sorted((str(r["doc_id"]), len(words(r["text"]))) for r in kept.collect()) == sorted((r[0], r[1]) for r in slow(docs, items) if not r[5])
    assert bad


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(tables()[0], DOCS), spark.createDataFrame(tables()[1], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0))
    assert clean.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and clean.count() == docs.count()


def test_no_python_in_the_plan(spark, capsys):
    docs, items = tables()
    frame = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    frame.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
