"""Line dedup over overlapping three-line windows.

Every three consecutive non-blank lines are hashed (128 bits); a window that
occurs more than once anywhere is kept at its first place, and the lines that
its later occurrences cover are removed.  Overlapping later occurrences merge,
so a repeated passage of any length goes as a whole.

The counts are pre-aggregated before the shuffle; later occurrences are found
by a join on the window's hash, which Spark splits where one passage is very
common.  All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.common import text_key, whole_row

WINDOW = 3
BLANKS = " \t\r"


def all_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_key, h1, h2, at)``: two hashes of each window of non-blank lines; ``at`` counts non-blank lines."""
    said = F.filter(F.transform(all_lines(F.col(f"`{text_col}`")), bare), lambda x: x != "")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_key(F.col(f"`{text_col}`")).alias("text_key"), said.alias("said"))
    hashed = base.select("doc_id", "text_key", F.transform("said", lambda x: F.xxhash64(x)).alias("a"), F.transform("said", lambda x: F.xxhash64(F.lit(1), x)).alias("b"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("a") - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get("a", i + k) for k in range(WINDOW)]).alias("h1"), F.xxhash64(*[F.get("b", i + k) for k in range(WINDOW)]).alias("h2")),
    )
    # outer: a plain explode adds a filter on the array's size, which computes all arrays again for each line
    rows = hashed.select("doc_id", "text_key", F.when(F.size("a") >= WINDOW, pairs).alias("w")).select("doc_id", "text_key", F.posexplode_outer("w").alias("at", "w"))
    return rows.filter("w is not null").select("doc_id", "text_key", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), "at")


def removed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_key, gone)``: the non-blank lines to remove, counted from 0."""
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key", "at")
    first = windows(docs, id_col, text_col).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = windows(docs, id_col, text_col).join(first, ["h1", "h2"])
    same_doc = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    later = later.filter(~(same_doc & (F.col("at") == F.col("first.at"))))
    begin = F.when(same_doc, F.greatest("at", F.col("first.at") + WINDOW)).otherwise(F.col("at"))
    covered = later.select("doc_id", "text_key", F.explode(F.filter(F.transform(F.array(*[F.lit(k) for k in range(WINDOW)]), lambda k: F.col("at") + k), lambda p: p >= begin)).alias("line"))
    return covered.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the lines of later occurrences removed from the text; every row and column stays.

    The first occurrence is the one with the least ``(id, text hash, line)``,
    null ids last.  Within one document a later occurrence that overlaps the
    first loses only its lines beyond it.  Blank lines are skipped by the
    windows and stay; texts of fewer than three non-blank lines are never
    changed; null texts stay null.  Rows that repeat id and text are one
    document and keep the same lines.  An empty table gives an empty result;
    other columns pass through whatever their names.  A text is one row of a
    task, however long.  ``counts`` adds ``n_lines`` (non-blank) and
    ``n_removed``.
    """
    gone = removed(docs, id_col, text_col).select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "gone")
    keyed = docs.select(whole_row(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("key"))
    joined = keyed.join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    joined = joined.withColumn("lines", F.when(F.col("gone").isNotNull() | F.lit(counts), all_lines(F.col("row")[text_col])))
    said = F.array_compact(F.transform("lines", lambda x, i: F.when(bare(x) != "", i)))
    joined = joined.withColumn("said", said)
    # the second use of said keeps the optimizer from computing it anew for every removed line
    drop = F.when(F.size("said") > 0, F.transform("gone", lambda k: F.get("said", k)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), drop)
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    given = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*given, *([F.size("said").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []))


ORACLE_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
said AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o
  FROM line WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
win AS (
  SELECT doc_id, o, t || chr(10) || lead(t, 1) OVER (PARTITION BY doc_id ORDER BY o) || chr(10) || lead(t, 2) OVER (PARTITION BY doc_id ORDER BY o) AS k
  FROM said),
least AS (
  SELECT k, min(struct_pack(d := doc_id, o := o)) AS f FROM win WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
covered AS (
  SELECT win.doc_id, unnest(range(CASE WHEN win.doc_id = f.d THEN greatest(win.o, f.o + 3) ELSE win.o END, win.o + 3)) AS o
  FROM win JOIN least USING (k) WHERE win.doc_id <> f.d OR win.o <> f.o),
gone AS (SELECT DISTINCT doc_id, o FROM covered),
marked AS (
  SELECT line.doc_id, line.i, line.line, said.o IS NOT NULL AS said, gone.o IS NOT NULL AS gone
  FROM line LEFT JOIN said USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = said.doc_id AND gone.o = said.o)
SELECT doc_id, count(*) FILTER (WHERE said) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
