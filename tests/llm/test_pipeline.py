"""The pipeline's stages against brute-force versions, each on its own input."""

import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from stratus.llm import bpe, quality
from stratus.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import slow as slow_contamination
from tests.llm.test_linededup import slow as slow_lines
from tests.llm.test_simhash import least, slow_fingerprint


def test_stages_and_run(spark, tmp_path):
    docs = table(spark, SF_SMALL, "documents")
    names, states = [n for n, _ in corpus_pipeline.STAGES], [docs]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, states[-1], SF_SMALL)
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        states.append(spark.read.parquet(str(tmp_path / name)))
    rows = [[tuple(r) for r in s.select("doc_id", "text").collect()] for s in states[:-1]]
    scored = {r["doc_id"]: r["predicted"] for r in quality.judge(docs, table(spark, SF_SMALL, "labels")).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scored[r[0]])
    assert sorted((str(a), b) for a, b in rows[2]) == slow_lines(rows[1])
    assert states[2].filter(F.char_length("text") != F.col("n_chars")).count() == 0
    fps = {d: slow_fingerprint(t, 4) for d, t in rows[2]}
    comp = least(set(fps.values()), lambda a, b: bin(a ^ b).count("1") <= 4)
    first = {}
    for d in sorted(fps):
        first.setdefault(comp[fps[d]], d)
    assert sorted(r[0] for r in rows[3]) == sorted(first.values())
    items = [tuple(r) for r in table(spark, SF_SMALL, "benchmark").select("item_id", "text").collect()]
    assert sorted(str(r[0]) for r in rows[4]) == sorted(r[0] for r in slow_contamination(rows[3], items) if not r[5])
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    texts = dict(rows[4])
    last = [tuple(r) for r in states[5].select("doc_id", "n_tokens", "decoded_sha256").collect()]
    assert sorted(last) == sorted((d, len(coder.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts.items())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "n_tokens", "decoded_sha256").collect()) == sorted(last)


NAMES = ["__key", "__id", "__of", "__gone", "__lines", "__said", "__text_key", "__keep_id", "__keep_key", "__stat_chars", "__score", "__k0", "__k1", "row", "id", "key", "of_id", "of_key", "gone", "lines", "said", "copies", "score", "text_key", "a.b"]


def test_stages_keep_columns_of_any_name(spark):
    """Null, empty, repeated and very long texts under extra columns named like those the operators make."""
    from stratus.llm import decontaminate, linededup, quality, simhash

    passage = "\n".join(f"line {i} of a passage that stands in two documents" for i in range(4))
    item = "one two three four five six seven eight nine ten"
    texts = [(1, passage), (2, f"before\n{passage}\nafter"), (3, None), (4, ""), (5, "same text here"), (5, "same text here"), (6, f"x {item} y"), (None, "no id"), (7, "long words " * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs = docs.select("*", *[(F.coalesce("doc_id", F.lit(0)) * 1.5 + k).alias(c) for k, c in enumerate(NAMES)])
    extra = {tuple(r) for r in docs.drop("text").collect()}
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {
        "lines": linededup.dedup_lines(docs),
        "near": simhash.drop_near_duplicates(docs, 4, 0),
        "bench": decontaminate.drop_contaminated(docs, items),
        "good": quality.keep_good(docs, labels, threshold=0.0),
    }
    rows = {k: v.collect() for k, v in out.items()}
    for k, df in out.items():
        assert df.columns == docs.columns and {tuple(x for c, x in zip(df.columns, r) if c != "text") for r in rows[k]} <= extra
    assert len(rows["lines"]) == len(rows["good"]) == 9 and len(rows["bench"]) == 8 and len(rows["near"]) == 7
    said = {r["doc_id"]: r["text"] for r in rows["lines"]}
    assert said[2] == "before\nafter" and said[1] == passage and said[3] is None
