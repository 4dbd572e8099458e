"""Secret scan: base patterns, and a linear-chain conditional random field.

Base spans come from three patterns.  The field tags a text's tokens as
beginning, inside or outside of a secret from their shape, the neighbouring
words and features of the file, and Viterbi decoding gives further spans where
no base span lies.  It is trained on windows around the base spans and
elsewhere in a bounded sample of texts.

Texts are scanned whole.  Where a token's margin for "outside" exceeds all that
transitions can win, every best path is outside there, so decoding splits at
such tokens, with the same result as over the whole sequence.  A text without
digits, key words, quotes, ``=``, ``:`` and long tokens is skipped if the weights prove that margin
for all contexts such a text can have; else it is decoded like the others.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import cut, text_key

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "crf")

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the maximal runs that reach 20 characters
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_DIGIT = re.compile("[0-9]")
_SEPARATORS = "\"'`=:;,|(){}<>[]"
_TOKEN = re.compile(r"""["'`=:;,|(){}<>\[\]]|[^\s"'`=:;,|(){}<>\[\]]+""")
_SEED = re.compile(r"""[0-9=:"']|(?i:password|passwd|secret|token|api_?key)|(?<![^\s"'`=:;,|(){}<>\[\]])[^\s"'`=:;,|(){}<>\[\]]{20,}""", re.A)
REACH = 4  # tokens over which a key word is seen
SAMPLE = 1_000  # texts the field is trained on, at most (about)
PER_TEXT = 40  # windows for training from each of them, at most
BOUND = 1.5  # largest transition weight; tags are O, B, I


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches, by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(token: str) -> str:
    """Class and length class of a token; a class with a digit in it ends in 9."""
    if token in _SEPARATORS:
        return token if token in "=:\"'" else "sep"
    core = token.rstrip(".!?") or token
    if core.isalpha():
        kind = "word" if core[0].islower() else "CAPS" if core.isupper() else "Word"
    elif not core.strip("0123456789"):
        kind = "num9"
    elif not _DIGIT.search(core):
        kind = "mark"
    elif not core.strip("0123456789abcdef"):
        kind = "hex9"
    elif core.isalnum():
        kind = "UP9" if core.isupper() else "mix9"
    else:
        kind = "part9"
    return kind + "abcde"[(len(core) >= 6) + (len(core) >= 12) + (len(core) >= 20) + (len(core) >= 32)]


def file_features(text: str) -> str:
    """Whether the whole text has a key word, a sign of assignment, a table."""
    return ("k" if _KEY.search(text) else "-") + ("=" if "=" in text else "-") + ("|" if " | " in text else "-")


def contexts(tokens: list[str], file: str) -> list[tuple]:
    """What the field sees of each token: shape, shapes beside it, key word nearby, file."""
    shapes = [shape(t) for t in tokens]
    out, last_key, last_sign = [], -REACH - 1, -REACH - 1
    for i, t in enumerate(tokens):
        key = "0" if i - last_key > REACH else "sign" if last_sign > last_key else "near"
        out.append((shapes[i], shapes[i - 1] if i else "", shapes[i + 1] if i + 1 < len(tokens) else "", key, file))
        if t in "=:":
            last_sign = i
        elif _KEY.search(t):
            last_key = i
    return out


def features(context: tuple) -> list[str]:
    own, before, after, key, file = context
    return ["bias", f"s {own}", f"p {before}", f"n {after}", f"k {key}", f"ks {key} {own}", f"f {file}", f"fs {file} {'9' in own}"]


def tags_of(spans: list[tuple[int, int]], inside: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens at ``spans`` for secrets at ``inside`` (both sorted)."""
    out, k, open_ = [], 0, False
    for a, b in spans:
        while k < len(inside) and inside[k][1] <= a:
            k, open_ = k + 1, False
        hit = k < len(inside) and inside[k][0] < b
        out.append(0 if not hit else 2 if open_ else 1)
        open_ = hit
    return out


class Field:
    """Weights of a linear-chain field over the tags outside, begin, inside."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray):
        self.weights, self.trans = weights, trans
        # most that transitions can win by tagging a token B or I rather than O, whatever the tags beside it
        self.gain = [max(trans[a, x] + trans[x, c] - trans[a, 0] - trans[0, c] for a in range(3) for c in range(3)) for x in (1, 2)]
        self.known: dict[tuple, tuple[np.ndarray, bool]] = {}
        self.sure = self.proven()

    def seen(self, context: tuple) -> tuple[np.ndarray, bool]:
        """Scores of the tags, and whether any path is bettered by tagging this token O."""
        found = self.known.get(context)
        if found is None:
            e = sum((self.weights[f] for f in features(context) if f in self.weights), np.zeros(3))
            found = e, bool(e[0] - e[1] > self.gain[0] and e[0] - e[2] > self.gain[1])
            if len(self.known) < 100_000:
                self.known[context] = found
        return found

    def emission(self, context: tuple) -> np.ndarray:
        return self.seen(context)[0]

    def proven(self) -> bool:
        """Whether every token of a text without digits, key words, quotes, signs of
        assignment and tokens of 20 characters is outside for sure, in each context it can have."""
        plain = [k + c for k in ("word", "Word", "CAPS", "mark") for c in "abc"] + ["sep"]
        files = ["--|", "---"]
        contexts = ((own, p, n, "0", f) for own in plain for p in [*plain, ""] for n in [*plain, ""] for f in files)
        return all(self.seen(c)[1] for c in contexts)

    def viterbi(self, contexts: list[tuple]) -> list[int]:
        """Best tags of a sequence that stands between outside tokens."""
        score, back = self.trans[0] + self.emission(contexts[0]), []
        for c in contexts[1:]:
            step = score[:, None] + self.trans
            back.append(step.argmax(0))
            score = step.max(0) + self.emission(c)
        tags = [int((score + self.trans[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Decoded secrets of a whole text."""
        if self.sure and not _SEED.search(text):
            return []
        matches = [m.span() for m in _TOKEN.finditer(text)]
        tokens = [text[a:b] for a, b in matches]
        seen = contexts(tokens, file_features(text))
        open_ = [not self.seen(c)[1] for c in seen]  # the others are outside for sure
        out, i = [], 0
        while i < len(tokens):
            if not open_[i]:
                i += 1
                continue
            j = i
            while j < len(tokens) and open_[j]:
                j += 1
            for k, tag in enumerate(self.viterbi(seen[i:j]), start=i):
                if tag == 1 or tag == 2 and not (out and out[-1][2] == k):
                    out.append([matches[k][0], matches[k][1], k + 1])
                elif tag == 2:
                    out[-1][1:] = [matches[k][1], k + 1]
            i = j
        return [(a, b) for a, b, _ in out]


def train(windows: list[tuple[list[tuple], list[int]]], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Penalised maximum likelihood by gradient steps; forward and backward sums run over all windows at once."""
    names: dict[str, int] = {}
    size = max((len(c) for c, _ in windows), default=1)
    n_features = len(features(("", "", "", "", "")))
    ids = np.zeros((len(windows), size, n_features), dtype=np.int64)
    gold = np.zeros((len(windows), size), dtype=np.int64)
    there = np.zeros((len(windows), size), dtype=bool)
    for w, (cs, ts) in enumerate(windows):
        for t, c in enumerate(cs):
            ids[w, t] = [names.setdefault(f, len(names) + 1) for f in features(c)]
        gold[w, : len(ts)], there[w, : len(ts)] = ts, True
    weights, trans = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    sum_w, sum_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    total = max(there.sum(), 1)
    onehot = np.eye(3)[gold]

    def logsum(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds if windows else 0):
        e = weights[ids].sum(2)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = trans[0] + e[:, 0]  # a window stands between outside tokens
        for t in range(1, size):
            forward[:, t] = np.where(there[:, t, None], logsum(forward[:, t - 1, :, None] + trans, 1) + e[:, t], forward[:, t - 1])
        last = there.sum(1) - 1
        rows = np.arange(len(windows))
        norm = logsum(forward[rows, last] + trans[:, 0], 1)
        backward[:, size - 1] = trans[:, 0]
        for t in range(size - 2, -1, -1):
            nxt = logsum(trans + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], nxt, trans[:, 0])
        p = np.exp(forward + backward - norm[:, None, None]) * there[:, :, None]
        grad_e = (onehot - p) * there[:, :, None]
        grad_w = np.zeros_like(weights)
        np.add.at(grad_w, ids.reshape(-1), np.repeat(grad_e.reshape(-1, 3), n_features, axis=0))
        grad_t = np.zeros_like(trans)
        for t in range(1, size):
            on = there[:, t]
            pair = np.exp(forward[on, t - 1, :, None] + trans + (e[on, t] + backward[on, t])[:, None, :] - norm[on, None, None])
            grad_t += onehot[on, t - 1].T @ onehot[on, t] - pair.sum(0)
        grad_t[0] += (onehot[:, 0] - p[:, 0]).sum(0)
        grad_t[:, 0] += (onehot[rows, last] - p[rows, last]).sum(0)
        for x, g, s in ((weights, grad_w, sum_w), (trans, grad_t, sum_t)):
            g = g / total * 100 - ridge * x
            s += g * g
            x += rate * g / np.sqrt(s)
        np.clip(trans, -BOUND, BOUND, out=trans)  # small transitions let clear tokens stand by themselves
    weights[0] = 0
    return Field({f: weights[i] for f, i in names.items()}, trans)


def training_windows(text: str, size: int = 16) -> list[tuple[list[tuple], list[int]]]:
    """Windows of a text that hold a base span or a token with a digit, and two plain
    ones; at most ``PER_TEXT``.  Which ones, a hash of place and text decides."""
    matches = [m.span() for m in _TOKEN.finditer(text)]
    seen = contexts([text[a:b] for a, b in matches], file_features(text))
    inner = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    inner += [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]
    merged: list[list[int]] = []
    for a, b in sorted(inner):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    tags = tags_of(matches, [tuple(m) for m in merged])
    some, plain = [], []
    for i in range(0, len(seen), size):
        held = any(tags[i : i + size]) or any("9" in c[0] or c[3] != "0" for c in seen[i : i + size])
        said = text[matches[i][0] : matches[min(i + size, len(seen)) - 1][1]]
        (some if held else plain).append((hashlib.blake2b(f"{i} {said}".encode(errors="replace"), digest_size=8).digest(), i))
    drawn = sorted(some + sorted(plain)[:2])[:PER_TEXT]
    return [(seen[i : i + size], tags[i : i + size]) for i in sorted(i for _, i in drawn)]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> Field:
    """Train the field on at most about ``size`` texts, half of them with base matches, drawn by a hash of row and text."""
    base = F.col(text_col).rlike(f"(?i:{ASSIGN})") | F.col(text_col).rlike(r"AKIA[A-Z0-9]{16}") | F.col(text_col).rlike("[0-9a-f]{24}")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), base.alias("base"), F.pmod(F.xxhash64(F.col(id_col), text_key(F.col(text_col)), F.lit(5)), F.lit(1 << 40)).alias("draw"))
    count = {r["base"]: r["n"] for r in rows.groupBy("base").agg(F.count("*").alias("n")).collect()}
    share = {b: min(1.0, size / 2 / max(count.get(b, 0), 1)) for b in (True, False)}
    drawn = rows.filter(F.col("draw") < F.when(F.col("base"), share[True]).otherwise(share[False]) * (1 << 40)).select("text")

    def run(parts):
        for part in parts:
            made = [json.dumps(w) for x in part.column(0) for w in training_windows(x.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["w"])

    found = cut(drawn.mapInArrow(run, "w string").distinct())  # at most PER_TEXT windows of each of about ``size`` texts
    windows = [json.loads(w) for w in sorted(r["w"] for r in found.collect())]
    return train([([tuple(c) for c in cs], ts) for cs, ts in windows])


def all_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Base spans, and the field's where no base span lies, by start, then kind as listed."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more, k = [], 0
    for a, b in field.spans(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and y > a for x, y in taken[max(0, k - 3) : k + 3]):
            more.append(("crf", a, b))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind,start,end>>)`` of every row (code points, end exclusive).
    Null and empty texts have no spans; repeated rows each have theirs."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(parts):
        for part in parts:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(x.as_py() or "", field)] for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind, digest of the base spans, and all spans as text."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    base, more = [c for c, k in zip(counts, KINDS) if k != "crf"], [c for c, k in zip(counts, KINDS) if k == "crf"]
    return found.select("doc_id", *base, F.sha2(said(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), *more)
