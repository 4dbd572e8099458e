"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on a labelled sample give conjunctive rules (every path from the
root), a lasso logistic regression gives most rules the weight zero, and the
rest are compiled into one Spark column expression.  Scoring is a projection:
no join, no shuffle, no Python.

The sample is bounded by ``SAMPLE`` rows, drawn by a hash of the id at a rate
set from the count of all labelled ids; everything else covers all rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import columns_of, cut, whole_row

SAMPLE = 20_000  # labelled rows the model is fitted on, at most (about)
FOLDS = 5
PREFIX = "__stat_"


def statistics(text: Column) -> dict[str, Column]:
    """The statistics the rules speak about; null and empty texts give zeros."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.split(F.trim(text), r"\s+")
    n_words = F.size(words).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {
        "chars": F.char_length(text).cast("double"),
        "words": n_words,
        "word_chars": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_words": count(r"(?<!\S)(\S++)(?=\s+\1(?!\S))") / n_words,
        "symbols": count(r"[#$%&*+/<=>@^_`{|}~\\\[\]]") / n,
        "digits": count(r"[0-9]") / n,
        "capitals": count(r"[A-Z]") / n,
        "stops": count(r"[.!?]") / n_words,
        "commas": count(r"[,;:]") / n_words,
        "lines": count(r"\n") / n_words,
    }


STATS = ["chars", "words", "word_chars", "distinct_words", "repeated_words", "symbols", "digits", "capitals", "stops", "commas", "lines"]


def held_out(doc_id: Column) -> Column:
    """Fold 0 by CRC-32 of the id's text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


Condition = tuple[int, str, float]  # statistic, "<=" or ">", threshold


def tree_rules(text: str) -> list[tuple[Condition, ...]]:
    """All paths from the root, as conditions, out of a tree model's description."""
    rules, path = [], []
    for line in text.splitlines():
        found = re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
        if found:
            depth = len(line) - len(line.lstrip())
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (int(found[2]), found[3], float(found[4]))))
            rules.append(tuple(c for _, c in path))
    return rules


def merged(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest bound for each statistic and direction, in a fixed order."""
    tight: dict[tuple[int, str], float] = {}
    for i, op, x in rule:
        old = tight.get((i, op), x)
        tight[i, op] = min(old, x) if op == "<=" else max(old, x)
    return tuple(sorted((i, op, x) for (i, op), x in tight.items()))


@dataclass
class RuleModel:
    """``score = sigmoid(intercept + sum of the weights of the rules that hold)``."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, stats: list[Column]) -> Column:
        terms = [F.when(holds(rule, stats), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1.0 / (1.0 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def holds(rule: tuple[Condition, ...], stats: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [stats[i] <= x if op == "<=" else stats[i] > x for i, op, x in rule])


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumns({PREFIX + k: v for k, v in statistics(F.col(text_col)).items()})


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """Statistics and label of labelled documents outside the held-out fold, one row per id."""
    label = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    label = label.groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
    n = label.count()
    share = 1 << 30 if n <= size else int((1 << 30) * size / n)
    chosen = cut(label.filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30)) < share))
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = with_statistics(given.join(F.broadcast(chosen), "__id"), "__text").drop("__text")  # bounded by ``size``
    return cut(rows.groupBy("__id").agg(*[F.min(F.struct(*[PREFIX + s for s in STATS])).alias("s"), F.first("label").alias("label")]).select("label", "s.*").coalesce(8))


def fit(rows: DataFrame, trees: int = 16, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleModel:
    """Rules from the paths of a random forest, weighted by a lasso logistic fit.

    Without both labels in the sample the model is the share of label 1 (0.5
    for no labels at all).
    """
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, ones = sum(count.values()), count.get(1.0, 0)
    share = (ones + 0.5) / (n + 1)
    if not 0 < ones < n:
        return RuleModel(math.log(share / (1 - share)))
    stats = [PREFIX + s for s in STATS]
    framed = VectorAssembler(inputCols=stats, outputCol="features").transform(rows).select("features", "label", *stats)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.6", minInstancesPerNode=2, seed=seed).fit(framed)
    rules = sorted({merged(r) for t in forest.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        return RuleModel(math.log(share / (1 - share)))
    columns = [F.col(s) for s in stats]
    fired = framed.select("label", F.array(*[holds(r, columns).cast("double") for r in rules]).alias("fired"))
    from pyspark.ml.functions import array_to_vector

    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(fired.select("label", array_to_vector("fired").alias("features")))
    weights = lasso_fit.coefficients.toArray().tolist()
    return RuleModel(float(lasso_fit.intercept), [(r, w) for r, w in zip(rules, weights) if w != 0.0])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> RuleModel:
    return fit(sample(docs, labels, label_col, id_col, text_col, size))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the model's score (0 to 1, higher: label 1 likelier) in ``out``; a column of that name is replaced, others stay."""
    rows = docs.select(whole_row(docs).alias("row"), *[v.alias(PREFIX + k) for k, v in statistics(F.col(f"`{text_col}`")).items()])
    return rows.select(*columns_of("row", [c for c in docs.columns if c != out]), model.score([F.col(PREFIX + s) for s in STATS]).alias(out))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, the model learned from the labels of the other folds."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(given, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns unchanged, whatever their names.

    Null and empty texts are scored like any other text, repeated rows each;
    labels that are null or not 0 or 1 don't count; without labels every score
    is 0.5; an empty table gives an empty result.  A text is one row of a task,
    however long.
    """
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    score = model.score([F.col(PREFIX + s) for s in STATS])
    # the score leaves through a generator: a filter on a plain column would be pushed below the
    # statistics, and compute each of them anew for every rule that speaks of it
    rows = docs.select(whole_row(docs).alias("row"), *[v.alias(PREFIX + k) for k, v in statistics(F.col(f"`{text_col}`")).items()])
    rows = rows.select("row", F.explode(F.array(score)).alias("score"))
    return rows.filter(F.col("score") >= threshold).select(*columns_of("row", docs.columns))
