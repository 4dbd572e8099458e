"""The registered query of each operator; QUERIES and ORACLE are added to the driver's entry points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import ann, bpe, chat, decontaminate, embdedup, htmltext, linededup, periodic, phrases, quality, secrets, simhash, urlfilter
from stratus.llm.common import start, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            start(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links of at most 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the 50k byte-level ranks, and the decoded bytes."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer(spark))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the rules learned from the labels outside fold 0."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_decontaminate", decontaminate.ORACLE_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items, and the items they belong to."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query("op9_line_dedup", linededup.ORACLE_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier three-line window: counts and digest of the text."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op6_chat_format", chat.ORACLE_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and a hostile one, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(probe)))


@query("op5_url_filter")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; hosts no rule decides are judged by their labelled pages."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns and spans of the trained field."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.find_secrets(docs, secrets.learn(docs)))


@query("op2_nearest")
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return htmltext.main_text(pages, htmltext.learn(pages))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document (a tenth of them with a repeated tail): number, longest, digests."""
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), least=6, times=4, edit=periodic.planted))


@query("op13_collocations", phrases.ORACLE_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, threshold=10, share=50, top=2000)


@query("op11_embedding_dedup", embdedup.ORACLE_SQL)
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among vectors of one label: their number and component for every vector."""
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)
