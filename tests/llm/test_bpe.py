"""BPE by tree reduction against tiktoken, and exact round trips."""

import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from stratus.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = bpe.read_ranks(f.read())
OURS = bpe.Encoder(RANKS, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(text):
    ids = OURS.encode(text)
    got = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
    assert got == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@given(st.text(max_size=200))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    same(text)


@given(st.text(alphabet="ab \n\t'sé1.\x1c\x85\xa0 ", max_size=300))
@settings(max_examples=400, deadline=None)
def test_few_characters(text):
    same(text)


@pytest.mark.parametrize("unit", ["a", " ", "\n", "ab", "é", "=", "0", "antidisestablishment", "\U0001f600", "-=", "xyz'll"])
def test_long_runs(unit):
    for n in (1, 7, 50, 999, 5000):
        same(unit * n)
        same("x" + unit * n + " y")


def test_long_mixed_words():
    rng = random.Random(4)
    for _ in range(60):
        same("".join(rng.choice("thereinganonatöß") for _ in range(rng.randint(10, 900))))


def test_frame_round_trip(spark):
    rows = [(1, "One two  three\n\nfour", 5), (1, "One two  three\n\nfour", 5), (None, None, None), (3, "", 1), (4, "ß" * 40_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    tokenizer = bpe.Tokenizer(spark, PATH, P.PATTERN)
    coded = tokenizer.encode(docs)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = tokenizer.decode(coded).collect()
    assert sorted((str(r["doc_id"]), r["decoded"].decode()) for r in back) == sorted((str(a), b or "") for a, b, _ in rows)
    assert bpe.round_trip(docs.limit(0), tokenizer).count() == 0


def test_query_matches_tiktoken(spark):
    import hashlib

    import numpy as np

    from stratus.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op8_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = THEIRS.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
