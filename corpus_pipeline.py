"""Corpus pipeline: five operators over ``documents``, each stage written and read again.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame;
all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import decontaminate, linededup, quality, simhash
from stratus.llm.common import start, table
from stratus.llm.queries import tokenizer
from stratus.session import shared_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules learned from ``labels.quality`` score 0.3 or more.

    Null and empty texts are scored like others, repeated rows each; no labels
    give every row 0.5, so all stay; an empty table gives an empty one.
    """
    start(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows; every document stays, ``n_chars`` follows its text.

    Null texts stay null; rows that repeat id and text are one document; an
    empty table gives an empty one.
    """
    start(spark)
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: 4-word shingles, at most 4 bits apart.

    Texts without words (null ones too) are one group; of rows that repeat id
    and text one stays; null ids come last; an empty table gives an empty one.
    """
    start(spark)
    return simhash.drop_near_duplicates(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no ten-word window of a benchmark item.

    Null and empty texts contain none; rows that repeat id and text go or stay
    together; an empty table gives an empty one.
    """
    start(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian 32-bit, base64) with digests of ids and decoded bytes.

    Null and empty texts have no tokens; repeated rows have their ids each; an
    empty table gives an empty result.
    """
    start(spark)
    coder = tokenizer(spark)
    back = coder.decode(coder.encode(docs.select("doc_id", "text")).drop("text"))
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.base64("ids").alias("ids_base64"),
    )


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("bpe", tokens),
]

#: SQL can't express the learned rules and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies in the shared folder."""
    start(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
