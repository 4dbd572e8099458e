"""Line dedup against a plain loop over all windows."""

import random

from stratus.llm import linededup

DOCS = "doc_id long, text string, n_lines string"


def slow(rows):
    """Texts in the order of ``rows`` after dedup; keys in (id, text) order stand for the hash order (ids are unique per text here)."""
    keys = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    first, gone = {}, {k: set() for k in keys}
    for key in keys:
        said = [x.strip(" \t\r") for x in key[2].split("\n")]
        said = [x for x in said if x]
        for i in range(len(said) - 2):
            win = tuple(said[i : i + 3])
            if win not in first:
                first[win] = (key, i)
            else:
                k, at = first[win]
                gone[key] |= {p for p in range(i, i + 3) if k != key or p >= at + 3}
    out = []
    for d, t, *_ in rows:
        key = (d is None, d or 0, t or "")
        if t is None or not gone[key]:
            out.append((str(d), t))
            continue
        kept, o = [], 0
        for line in t.split("\n"):
            if line.strip(" \t\r"):
                if o not in gone[key]:
                    kept.append(line)
                o += 1
            else:
                kept.append(line)
        out.append((str(d), "\n".join(kept)))
    return sorted(out, key=str)


def make_rows():
    rng = random.Random(9)
    passages = [[f"p{k} line {j} " + rng.choice("abc") for j in range(rng.randint(2, 6))] for k in range(8)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"own {d} {rng.random()}"] * rng.choice((1, 1, 1, 2, 6))
            if rng.random() < 0.3:
                lines += ["", "  "]
        rows.append((d, "\n".join(lines), "x"))
    rows += [(200, None, "x"), (201, "", "x"), (None, "\n".join(passages[0] * 2), "n"), rows[5], rows[5], (300, "same\n" * 3000, "x"), (301, "\n\n\n\n", "x"), (302, "x\r\ny \n z\nx\ny\nz", None)]
    return rows


def test_matches_brute_force(spark):
    rows = make_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((str(r["doc_id"]), r["text"]) for r in got.collect()), key=str) == slow(rows)


def test_counts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "z\na\nb\nc\n\nq"), (3, "a\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs, counts=True).collect()}
    assert got[2]["text"] == "z\n\nq" and (got[2]["n_lines"], got[2]["n_removed"]) == (5, 3)
    assert got[1]["n_removed"] == got[3]["n_removed"] == 0
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
