"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window). A window occurs in a document only if all
its shingles do, so for full containment one shingle is a sufficient prefix:
the rarest in the corpus. Document shingles are joined with those prefix
shingles only; length and position bounds and an exact comparison of the words
in place decide. Documents are read twice (shingle counts, then the join) and
never shuffled: what moves is one row for each document and each match.

A benchmark too large to be broadcast is joined by shuffling hashes and
positions instead; only documents with a candidate are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, bounded_broadcast, columns, digest, settle, stored, table, unused, words

#: Windows of a benchmark that are broadcast, at most; at about 200 bytes each, 40 MB.
BLOCK_WINDOWS = 200_000
#: Digests of contaminated texts that are broadcast, at most: 32 bytes each and the table around them, 40 MB.
BROADCAST_TEXTS = 400_000
#: Parts into which copies of one text are dealt where digests are joined by shuffling.
SALTS = 32


def _shingle(tokens: Column, at: Column, width: int) -> Column:
    """Hash of the ``width`` words that start at ``at`` (0-based)."""
    return F.xxhash64(*[F.get(tokens, at + i) for i in range(width)])


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win): each window of each item once. A null item id counts as the item ``null``."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        words(ascii_lower(F.col(text_col)), ALNUM_WORD).alias("ws"),
    ).where(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1)))
    return items.select("item", "ws", starts.alias("at")).select("item", F.slice("ws", F.col("at"), window).alias("win")).distinct()


def _hashed(docs: DataFrame, widths: list[int], first: bool) -> DataFrame:
    """(..., n, pos, nth, h): the shingle of each width at each word of ``docs`` (columns and ``ws``).

    With ``first`` there is a row for the first place of each document too,
    of null ``pos`` without words, whether or not a shingle fits there.
    ``h`` is never null and rows are chosen by what is cheap, so that it is
    computed once.
    """
    each = docs.select("*", F.size("ws").alias("n"), F.posexplode_outer("ws").alias("pos", "w")).drop("w")
    width = F.lit(widths[0])
    if len(widths) > 1:
        each = each.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1))))
        width = F.element_at(F.array(*[F.lit(k) for k in widths]), F.col("nth") + 1)
    else:
        each = each.withColumn("nth", F.lit(0))
    fits = F.coalesce(F.col("pos") <= F.col("n") - width, F.lit(False))
    each = each.where(fits | (F.col("nth") == 0) & F.coalesce(F.col("pos") == 0, F.lit(True)) if first else fits)
    h = _shingle(F.col("ws"), F.col("pos"), widths[-1])
    for nth, k in enumerate(widths[:-1]):
        h = F.when(F.col("nth") == nth, _shingle(F.col("ws"), F.col("pos"), k)).otherwise(h)
    return each.withColumn("h", h)


def _anchors(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, len, win, h, off): the rarest shingle of each window. A window of which a shingle never occurs cannot occur."""
    found = shingles.join(counts, "h").groupBy("wid", "len", "width")
    found = found.agg(F.count("*").alias("k"), F.min(F.struct("seen", "h", "off")).alias("a"), F.first("win").alias("win"))
    return found.where(F.col("k") == F.col("len") - F.col("width") + 1).select("wid", "len", "win", F.col("a.h").alias("h"), F.col("a.off").alias("off"))


def _matches(docs: DataFrame, wins: DataFrame, widths: list[int], shingle: int, block_windows: int, total: int) -> DataFrame:
    """(rid, id, n, start, len, wid) from (rid, id, ws): occurrences of windows, and at least one row for each document."""
    wins = wins.withColumn("len", F.size("win")).withColumn("width", F.least(F.lit(shingle), F.col("len")))
    wins = wins.withColumn("wid", F.md5(F.array_join("win", " ")))
    placed = wins.select("wid", "win", "len", "width", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("width"))).alias("off"))
    shingles = settle(placed.withColumn("h", F.coalesce(*[F.when(F.col("width") == k, _shingle(F.col("win"), F.col("off"), k)) for k in widths])))
    vocabulary = shingles.select("h").distinct()
    small = total <= block_windows
    seen = _hashed(docs.select("ws"), widths, False).select("h")
    if small:
        counts = seen.join(F.broadcast(vocabulary), "h", "left_semi").groupBy("h").agg(F.count("*").alias("seen"))
    else:
        counts = seen.groupBy("h").agg(F.count("*").alias("seen")).join(vocabulary, "h", "left_semi")
    anchors = settle(_anchors(shingles, counts))
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    same = F.slice("ws", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")) == F.col("win")
    found = ["rid", "id", "n", "start", "len", "wid"]
    if small:
        d, a = _hashed(docs, widths, True), F.broadcast(anchors)
        there = F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")
        hit = d.join(a, (d["h"] == a["h"]) & fits & there, "left")
        one = (F.col("pos").isNull() | (F.col("pos") == 0)) & (F.col("nth") == 0)
        return hit.where(F.col("wid").isNotNull() | one).withColumn("start", start).select(*found)
    # Hashes and positions meet the anchors by shuffling; only then are the texts of candidates joined.
    d = _hashed(docs, widths, False).select("rid", "n", "pos", "h")
    met = d.join(anchors, "h").where(fits).select("rid", start.alias("start"), "len", "wid", "win")
    hits = docs.select("rid", "id", "ws", F.size("ws").alias("n")).join(met, "rid").where(same).select(*found)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("len", "int"), ("wid", "string"))]
    return hits.union(docs.select("rid", "id", F.size("ws").alias("n"), *none))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, shingle: int = 5, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """For each row of ``docs``: id, n_words, spans, n_hit and items.

    ``spans`` are the maximal runs of words [start, end) inside occurrences of
    windows, ``items`` the sorted ids of the items with an occurring window.

    Null or wordless texts have no words and no hits. Null ids are kept, and
    repeated rows or ids give a row each. Windows that items share count for
    each of them; items of one id and repeated items count once. An empty
    benchmark hits nothing; extra columns are ignored. A benchmark of more
    than ``block_windows`` distinct windows is not broadcast but shuffled.
    """
    of_item = settle(benchmark_windows(benchmark, item_col, item_text_col, window).withColumn("wid", F.md5(F.array_join("win", " "))))
    wins = of_item.select("win").distinct().withColumn("k", F.least(F.lit(shingle), F.size("win")))
    sizes = {r["k"]: r["n"] for r in wins.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most `shingle` rows
    widths, total = sorted(sizes, reverse=True), sum(sizes.values())
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    # The shuffled join reads documents again by their number, which therefore has to be stored.
    numbered = stored(given, "rid") if total > block_windows else given.withColumn("rid", F.monotonically_increasing_id())
    rows = numbered.select("rid", "id", words(ascii_lower(F.col("t")), ALNUM_WORD).alias("ws"))
    if total:
        found = _matches(rows, wins.select("win"), widths, shingle, block_windows, total)
    else:
        found = rows.select("rid", "id", F.size("ws").alias("n"), *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("len", "int"), ("wid", "string"))])
    end = F.col("start") + F.col("len")
    before = Window.partitionBy("rid").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        found.withColumn("reach", F.max(end).over(before))
        .withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))
        .withColumn("run", F.sum("new").over(upto))
        .groupBy("rid", "run")
        .agg(F.first("id").alias("id"), F.max("n").alias("n"), F.min("start").alias("start"), F.max(end).alias("end"), F.collect_set("wid").alias("wids"))
    )
    spans = F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end"))))
    each = runs.groupBy("rid").agg(
        F.first("id").alias("id"), F.max("n").alias("n_words"), spans.alias("spans"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("wids"))).alias("wids"),
    )
    owners = of_item.select("wid", "item")
    if total <= block_windows and of_item.count() <= block_windows:
        owners = F.broadcast(owners)
    listed = each.select("rid", "id", "n_words", "spans", "n_hit", F.explode_outer("wids").alias("wid")).join(owners, "wid", "left")
    return listed.groupBy("rid").agg(
        F.first("id").alias("id"), F.first("n_words").cast("long").alias("n_words"), F.first("spans").alias("spans"), F.first("n_hit").cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"),
    ).drop("rid")


def contaminated() -> Column:
    """A twentieth of the words, or more, is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop contaminated documents, keep the others unchanged, with all their columns.

    The decision is one on the text, so rows are found again by its digest:
    copies go together. Null and empty texts stay, as do null ids and repeated
    rows; an empty table or benchmark drops nothing.
    """
    mark = unused(docs, "__text")
    found = decontaminate(docs.select(digest(F.col("text")).alias("id"), "text"), table(spark, sf_dir, "benchmark"), id_col="id")
    bad = settle(found.where(contaminated()).select("id").distinct())
    bad = bad.withColumnRenamed("id", mark)
    keyed = docs.withColumn(mark, digest(F.col("text")))
    if (n := bad.count()) <= BROADCAST_TEXTS:
        clean = keyed.join(bounded_broadcast(bad, n, BROADCAST_TEXTS), mark, "left_anti")
    else:
        salt = unused(docs, "__salt")
        salted = bad.select(mark, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        clean = keyed.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [mark, salt], "left_anti")
    return clean.select(*columns(docs))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(ws[s:s + 12], ' ') AS w, least(len(ws), 13) AS l FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s FROM b WHERE len(ws) > 0)),
p AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS s FROM d),
hit AS (
  SELECT p.rid, p.s, win.l, win.item FROM (SELECT DISTINCT l FROM win) AS ls JOIN p ON p.s + ls.l - 1 <= len(p.ws)
  JOIN win ON win.l = ls.l AND win.w = array_to_string(p.ws[p.s:p.s + ls.l - 1], ' ')),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS k FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
