"""Benchmark decontamination as a prefix-filtered containment join, in SQL functions only.

An item of ten or more words gives its windows of ten consecutive words, a
shorter one gives itself.  A document is matched if it contains a window
whole.  For containment of all of a window's words the necessary prefix is one
word, so:

1. count the items' words over all documents, and order each window's words by
   rarity; its rarest word is its anchor;
2. scan the documents for anchors: a fixed-size bitmap of the anchors' hashes
   drops nearly all words before any row is made, and each survivor leaves with
   the words around it (at most one window on either side);
3. join survivors and windows on the anchor; the positional bound (the window
   must start at or after the first word), the length bound (and end within the
   document) and the exact comparison are conditions of the join.

The join is an ordinary equi-join on the anchor: Spark broadcasts the windows
if it has measured them as small, and splits a hot anchor otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.llm.common import ascii_lower, columns_of, cut, text_key, whole_row

WINDOW = 10
BITMAP = 1 << 20  # bits; more anchors than it can tell apart only weaken the filter
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words (fixed value)


def raw_words(text: Column) -> Column:
    """Words in their own case; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def lowered(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), ascii_lower(word)).otherwise(word)


def windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, win)``: every item's windows, as arrays of lower-case words."""
    words = F.transform(raw_words(F.col(text_col)), lowered)
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - (WINDOW - 1), F.lit(1)))
    return (
        items.select(F.col(id_col).alias("item_id"), words.alias("words"))
        .filter(size > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW))).alias("win"))
    )


def bitmap(words: DataFrame, column: str) -> Column:
    """Literal array of longs in which the bits of the words' hashes are set (``BITMAP`` bits, whatever their number)."""
    bit = F.xxhash64(column).bitwiseAND(F.lit(BITMAP - 1))
    cells = words.select(F.shiftright(bit, 6).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))").alias("bits"))
    found = dict(cells.groupBy("cell").agg(F.bit_or("bits")).collect())
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(BITMAP // 64))), ",").cast("array<bigint>")


def places(hashes: str, bits: Column) -> Column:
    """Positions (from 0) of the words whose hash bit is set."""

    def known(h, i):
        return F.when(F.getbit(F.get(bits, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1, i)

    return F.array_compact(F.transform(hashes, known))


def with_hashes(docs: DataFrame, text_col: str, kept: list[Column]) -> DataFrame:
    """``kept`` columns, the words of each text, and each word's hash within the bitmap."""
    rows = docs.select(*kept, raw_words(F.col(text_col)).alias("words"))
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(lowered(w)).bitwiseAND(F.lit(BITMAP - 1))))


def anchors(wins: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``(win, anchor, offset)``: the word of each distinct window that is rarest over all documents (ties: the lesser word, then the first place)."""
    vocabulary = cut(wins.select(F.explode("win").alias("word")).distinct())
    bits = bitmap(vocabulary, "word")
    # outer: a plain explode adds a filter on the array's size, which computes the array twice
    found = with_hashes(docs, text_col, []).select(F.explode_outer(F.transform(places("hashes", bits), lambda i: F.get("words", i))).alias("word"))
    counts = found.filter("word is not null").groupBy("word").count()
    counts = counts.groupBy(lowered(F.col("word")).alias("word")).agg(F.sum("count").alias("n"))
    rarity = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    placed = wins.select("win", F.posexplode("win").alias("offset", "word")).join(rarity, "word")
    return placed.groupBy("win").agg(F.min(F.struct("n", "word", "offset")).alias("least")).select("win", F.col("least.word").alias("anchor"), F.col("least.offset").alias("offset"))


def hits(docs: DataFrame, items: DataFrame, text_col: str, item_text: str, item_id: str, keys: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``(key columns, n_words, win, start)`` of each occurrence, and ``(win, item_id)``."""
    owned = cut(windows(items, item_id, item_text).distinct())
    wins = owned.select("win").distinct()
    found = cut(anchors(wins, docs, text_col))
    bits = bitmap(found.select("anchor").distinct(), "anchor")
    names = [f"__k{i}" for i in range(len(keys))]
    scan = with_hashes(docs, text_col, [k.alias(n) for k, n in zip(keys, names)])
    at = places("hashes", bits)
    first = lambda p: F.greatest(p - (WINDOW - 1), F.lit(0))
    around = F.transform(at, lambda p: F.struct(p.alias("at"), first(p).alias("first"), F.transform(F.slice("words", first(p) + 1, p - first(p) + WINDOW), lowered).alias("near")))
    rows = scan.select(*names, F.size("words").alias("n_words"), around.alias("around")).select(*names, "n_words", F.explode_outer("around").alias("c"))
    rows = rows.filter("c is not null").select(*names, "n_words", "c.at", "c.first", "c.near", F.expr("c.near[c.at - c.first]").alias("anchor"))
    start = F.col("at") - F.col("offset")
    size = F.size("win")
    same = F.slice("near", F.greatest(start - F.col("first") + 1, F.lit(1)), size) == F.col("win")
    joined = rows.alias("r").join(found.alias("f"), (F.col("r.anchor") == F.col("f.anchor")) & (start >= 0) & (start + size <= F.col("n_words")) & same)
    return joined.select(*names, "win", start.alias("start"), size.alias("size")), owned


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items``
    the items with occurring windows; items with a null id count for ``n_hit``
    alone.  Null and empty texts have no words; rows that repeat id and text
    have equal results; no items or no documents give no hits or no rows; other
    columns are neither read nor returned.  A text is one row of a task, however
    long.
    """
    keys = [F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key")]
    found, owned = hits(docs, items, text_col, item_text, item_id, keys)
    found = cut(found.distinct())
    by_doc = Window.partitionBy("__k0", "__k1").orderBy("start")
    ends = found.groupBy("__k0", "__k1", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = ends.withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0))).groupBy("__k0", "__k1").agg(F.sum("new").alias("n_hit"))
    ids = found.select("__k0", "__k1", "win").distinct().join(owned, "win").groupBy("__k0", "__k1").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    summed = n_hit.alias("n").join(ids.alias("i"), F.expr("n.__k0 <=> i.__k0 and n.__k1 = i.__k1")).select("n.__k0", "n.__k1", "n_hit", "ids")
    rows = docs.select(*keys, F.size(raw_words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(summed, F.expr("doc_id <=> __k0 and text_key = __k1"), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain a window of an item; columns unchanged, whatever their names.

    Null and empty texts contain none and stay; rows that repeat id and text go
    or stay together; without items all rows stay; an empty table gives an
    empty result.  A text is one row of a task, however long.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.select(whole_row(docs).alias("row"), doc.alias("id"), text_key(text).alias("key"))
    found, _ = hits(docs, items, text_col, item_text, item_id, [doc, text_key(text)])
    bad = cut(found.select("__k0", "__k1").distinct())
    clean = keyed.join(bad, F.col("id").eqNullSafe(F.col("__k0")) & (F.col("key") == F.col("__k1")), "left_anti")
    return clean.select(*columns_of("row", docs.columns))


ORACLE_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc),
gram AS (
  SELECT doc_id, i, word, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS g FROM word),
hit AS (
  SELECT gram.doc_id, gram.i, win.item_id, len(win.win) AS n
  FROM gram JOIN win ON gram.word = win.win[1] AND gram.g[1 : len(win.win)] = win.win),
n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN n_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
