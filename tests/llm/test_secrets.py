"""Base spans against the plain patterns; the field against brute force over all tag sequences."""

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from stratus.llm import secrets

HEXES = ["0f" * 12, "deadbeef" * 5, "a" * 23, "0123456789abcdef" * 2 + "g"]
ODD = ["", "token=abcdef", "TOKEN: 'x1-y2.z3/==' and more", "token=token=abcdef", "password: secret: abcdefgh", "passwd=abc", "api_key\" : \"A+/_.=-9\"", "apikey = AKIA" + "A" * 16, "AKIAAKIA" + "B" * 15, "ſecret=abcdef toKen=abcdef", "secret\n=abcdef", "é" * 30 + " token = " + "f" * 40, "AKIA" + "C" * 15]


def plain(text):
    out = [("assign", *m.span()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    parts = ODD + HEXES + ["AKIA", "0", "af", "=", ":", '"', " ", "token", "Secret", "x", "AKIA7"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        assert secrets.base_spans(text) == plain(text)


def make_field(seed=0):
    rng = random.Random(seed)
    texts = []
    for i in range(300):
        words = [rng.choice(["alpha", "Beta", "gamma,", "delta.", "token", "see", "44", "1999"]) for _ in range(30)]
        if i % 2:
            words[10:10] = [rng.choice(["token", "api_key", "password"]), "=", f'"{rng.getrandbits(160):040x}"']
        texts.append(" ".join(words))
    return secrets.train([w for t in texts for w in secrets.training_windows(t)])


FIELD = make_field()


def test_viterbi_is_the_best_sequence():
    rng = random.Random(2)
    kinds = ["worda", "hex9e", "=", "num9b", '"']
    for _ in range(60):
        cs = [(rng.choice(kinds), rng.choice(kinds), rng.choice(kinds), rng.choice(["0", "sign"]), "k=-") for _ in range(rng.randint(1, 6))]

        def value(tags):
            path = [0, *tags, 0]
            return sum(FIELD.trans[a, b] for a, b in zip(path, path[1:])) + sum(FIELD.emission(c)[t] for c, t in zip(cs, tags))

        assert value(FIELD.viterbi(cs)) == pytest.approx(max(value(t) for t in product(range(3), repeat=len(cs))))


def test_splitting_at_sure_tokens_changes_nothing():
    assert FIELD.sure
    whole = secrets.Field(FIELD.weights, FIELD.trans)
    whole.sure, whole.seen = False, lambda c: (FIELD.emission(c), False)
    rng = random.Random(3)
    parts = ["alpha", "Beta,", "token", "=", '"', "44", "x" * 40, "é²٣", "|", "password:", "\n", "zz9zz9zz9zz9zz", *HEXES]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert FIELD.spans(text) == whole.spans(text)


def test_gradient_step_raises_the_likelihood():
    text = 'say token = "' + "ab12" * 10 + '" now, or 1999 alone'
    windows = secrets.training_windows(text)
    before, after = secrets.train(windows, rounds=1), secrets.train(windows, rounds=80)

    def loss(field):
        total = 0.0
        for cs, ts in windows:
            e = np.array([field.emission(c) for c in cs])
            logs = [sum(field.trans[a, b] for a, b in zip([0, *t], [*t, 0])) + sum(e[i, x] for i, x in enumerate(t)) for t in product(range(3), repeat=len(ts))] if len(ts) <= 8 else None
            if logs is None:
                f = field.trans[0] + e[0]
                for i in range(1, len(ts)):
                    f = np.logaddexp.reduce(f[:, None] + field.trans, axis=0) + e[i]
                norm = np.logaddexp.reduce(f + field.trans[:, 0])
            else:
                norm = np.logaddexp.reduce(logs)
            total += sum(field.trans[a, b] for a, b in zip([0, *ts], [*ts, 0])) + sum(e[i, x] for i, x in enumerate(ts)) - norm
        return total

    assert loss(after) > loss(before) and loss(after) > -1.0
    assert [field for field in [after.spans(text)]] == [[(text.index("ab12"), text.index('" now'))]]


def test_field_adds_secrets_the_patterns_miss():
    text = "see gamma, auth token value was = 'Zk3" + "Q9x7" * 8 + "' delta. 1999"
    spans = secrets.all_spans(text, FIELD)
    assert all(s[0] in secrets.KINDS for s in spans) and [s for s in spans if s[0] != "crf"] == plain(text)


def test_frames_and_query(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "n"), (5, "token=abcdef", None), (5, "token=abcdef", None), (99, "word " * 30_000 + "token=abcdef", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = secrets.digests(secrets.find_secrets(docs, FIELD)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _ in rows:
        by.setdefault(i, set()).add(t or "")
    for r in got:
        want = {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t)).encode()).hexdigest() for t in by[r["doc_id"]]}
        assert r["base_sha256"] in want
        assert sum(s.split(":")[0] == "assign" for s in r["spans"].split(",")) == r["n_assign"]
    field = secrets.learn(docs.limit(0))
    assert secrets.digests(secrets.find_secrets(docs.limit(0), field)).count() == 0
    assert secrets.find_secrets(docs, field).count() == len(rows)


def test_query_finds_base_spans_of_whole_texts(spark):
    from stratus.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op4_secret_scan"](spark, SF_SMALL).collect():
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[0] == k for b in base) for k in secrets.KINDS[:3])


def test_field_adds_planted_secrets_and_nothing_on_clean_texts():
    # the key word stands within REACH, another word between it and the sign: no base pattern fits
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "see", "44", "1999"]
    planted = 0
    for _ in range(60):
        value = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + rng.choice("0123456789") for _ in range(rng.randint(18, 24)))
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(2))
        text = f'{before} {rng.choice(["token", "password", "api_key"])} value = "{value}" {after}'
        assert plain(text) == []
        at = text.index(value)
        planted += secrets.all_spans(text, FIELD) == [("crf", at, at + len(value))]
        clean = " ".join(rng.choice([*words, "token", "password"]) for _ in range(40))
        assert secrets.all_spans(clean, FIELD) == []
    assert planted >= 57


def test_windows_are_drawn_from_the_whole_text():
    words = [f"w{i}" if i % 16 else "77" for i in range(16 * 400)]
    text = " ".join(words)
    seen = secrets.contexts(words, secrets.file_features(text))
    windows = secrets.training_windows(text)
    assert len(windows) == secrets.PER_TEXT and windows == secrets.training_windows(text)
    marked = " ".join(words[: 16 * 200]) + " " + " ".join(["1234567"] * 16 * 200)  # the second half has another shape
    late = [w for w, _ in secrets.training_windows(marked) if w[1][0] == "num9b"]
    assert 8 <= len(late) <= 32
    assert all(list(w) in [seen[i : i + 16] for i in range(0, len(seen), 16)] for w, _ in windows)
