"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word target. A document is expected to be taken
``level x weight`` times, at most ``most`` times, where the weight grows with
its size (fragments of a few words are taken least) and the level of a source
is such that the words expected meet its target. The whole part of that number
is certain; the rest is an inclusion probability, different for documents of
different weight. Documents are ranked by random odds over inclusion odds, and
the order is cut where the words taken come nearest the target. The cut is
found from a histogram of ranks, so that no task ever holds the documents of
one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, bounded_broadcast, columns, settle, table, unused, words

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Cells of the rank histogram for each source; a source's cut is looked for inside one cell.
CELLS = 16384
_BITS = 52
#: Rows of targets (a source and a size class each) and of cuts that are broadcast; with more, the joins shuffle.
BROADCAST_SOURCES = 20_000


def _draw(id_col: Column, text_col: Column) -> Column:
    """A number in [0, 2^52) that depends on id and text alone, so reruns agree."""
    key = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(key, 1, _BITS // 4), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """The number of bits of a size, which is the weight of documents of that size."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """From (source, source_size): the word target of each source.

    Sources in code point order, null last, take the weights in turn. Targets
    share ``budget`` times all sizes by weight, none above ``most`` times its
    source's size: the level at which the capped sources are full and the
    others stand at level x weight is found in one ordered pass. One task
    sees one row for each source.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    levelled = (
        weighed.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)))
        .withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
        .withColumn("place", F.row_number().over(order))
    )
    # The first source in this order that is not full at its level: those before it are.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    capped = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return levelled.select("source", "source_size", "weight", capped.alias("target"))


def classes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """From (source, class, words): source_size and target of the source, times (how often a document of the class is expected) and want.

    ``want`` are the words of the target that whole copies leave to be drawn.
    Times are level x class, ``most`` at most: classes are filled from the
    highest down until the words that are left share one level. There are as
    many rows as sources times the bits of the longest text.
    """
    by_source = targets(sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    by_source = by_source.select(F.col("source").alias("src"), "source_size", "target")
    each = sizes.join(by_source, sizes["source"].eqNullSafe(by_source["src"])).drop("src")
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    whole = Window.partitionBy("source")
    levelled = (
        each.withColumn("full", F.coalesce(F.sum(F.col("words") * most).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum(F.col("words") * F.col("class")).over(down.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(F.col("rest") > 0, (F.col("target") - F.col("full")) / F.col("rest")))
        .withColumn("place", F.row_number().over(down))
    )
    # The first class from above that is not full at its level: those before it are.
    level = F.min(F.when(F.col("level") * F.col("class") <= most, F.struct("place", "level"))).over(whole)
    levelled = levelled.withColumn("found", level)
    times = F.when(F.col("words") == 0, F.lit(0.0)).when(F.col("found").isNull() | (F.col("place") < F.col("found.place")), F.lit(float(most)))
    timed = levelled.withColumn("times", times.otherwise(F.col("found.level") * F.col("class")))
    want = F.col("target") - F.sum(F.floor("times") * F.col("words")).over(whole)
    return timed.select("source", "class", "source_size", "target", "times", want.alias("want"))


def _ranked(sized: DataFrame, of: DataFrame) -> DataFrame:
    """Add to (source, size, draw, ...): source_size, target, want, whole, p and q, Pareto's rank variable; the smallest q come first."""
    u = (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << _BITS))
    joined = sized.join(of, sized["source"].eqNullSafe(of["src"]) & (size_class(sized["size"]) == of["class"]), "left").drop("src", "class")
    joined = joined.withColumn("whole", F.floor("times")).withColumn("p", F.col("times") - F.floor("times"))
    joined = joined.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    return joined.withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * CELLS)).drop("times", "p")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    id_, text = F.col(id_col), F.col(text_col)
    return docs.select(id_.alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(text, SPACE_WORD)).cast("long").alias("size"), _draw(id_, text).alias("draw"), *more)


def plan(sized: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(classes, cuts) from (id, source, size, draw): for each source and size class how often it is taken, and where a source's order is cut."""
    sizes = sized.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    of = settle(classes(sizes, **how).withColumnRenamed("source", "src"))
    of = bounded_broadcast(of, of.count(), BROADCAST_SOURCES)
    drawn = _ranked(sized, of).where("q is not null")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = drawn.groupBy("source", "cell", "want").agg(F.sum("size").alias("words")).withColumn("sum", F.sum("words").over(upto))
    # The cell in which the words reach what is wanted; if none does, all are taken.
    cut_cells = cells.where((F.col("sum") >= F.col("want")) & (F.col("sum") - F.col("words") < F.col("want")))
    cut_cells = settle(cut_cells.select(F.col("source").alias("csrc"), F.col("cell").alias("ccell"), (F.col("sum") - F.col("words")).alias("before")))
    cut_cells = bounded_broadcast(cut_cells, cut_cells.count(), BROADCAST_SOURCES)
    inside = drawn.join(cut_cells, drawn["source"].eqNullSafe(cut_cells["csrc"]) & (drawn["cell"] == cut_cells["ccell"]))
    order = Window.partitionBy("source").orderBy("q", "draw", "id").rowsBetween(Window.unboundedPreceding, 0)
    steps = inside.withColumn("sum", F.col("before") + F.sum("size").over(order))
    # The last rank taken: the longest run of ranks that comes nearest; a step counts if it is no farther than the one before it.
    near = F.abs(F.col("sum") - F.col("want")) <= F.abs(F.col("sum") - F.col("size") - F.col("want"))
    cuts = steps.groupBy("source", "ccell").agg(F.max(F.when(near, F.struct("q", "draw", "id"))).alias("last"))
    cuts = settle(cuts.select(F.col("source").alias("csrc"), "ccell", F.col("last.q").alias("last_q"), F.col("last.draw").alias("last_draw"), F.col("last.id").alias("last_id")))
    return of, bounded_broadcast(cuts, cuts.count(), BROADCAST_SOURCES)


def _taken(sized: DataFrame, of: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add source_size, target and copies to (id, source, size, draw, ...), each row judged by itself."""
    ranked = _ranked(sized, of)
    joined = ranked.join(cuts, ranked["source"].eqNullSafe(cuts["csrc"]), "left")
    before = F.struct("q", "draw", "id") <= F.struct(F.col("last_q").alias("q"), F.col("last_draw").alias("draw"), F.col("last_id").alias("id"))
    cut = F.when(F.col("ccell").isNull(), True).when(F.col("last_q").isNull(), F.col("cell") < F.col("ccell")).otherwise(before)
    copies = F.col("whole") + F.when(F.col("q").isNotNull() & cut, 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """For each row: id, source, size, source_size, target, copies (0, 1 or 2 whole copies) and taken = copies x size.

    Sizes count words between ASCII white space. A null text has size 0 and is
    a member of its source like any other; a null source is a source of its
    own, the last. Rows alike in id and text share a rank: at a cut they are
    taken together. Empty tables give no rows; other columns are ignored.
    """
    sized = settle(_sized(docs, id_col, text_col, source_col))
    found = _taken(sized, *plan(sized, **how))
    return found.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents of the mix, each as often as it is taken, with ``copy`` from 1.

    What is taken of a row follows from its id, text and source alone, so no
    row has to be found again. All columns are passed on unchanged; one that
    is named ``copy`` already keeps its name, and the number is then called
    ``copy_``. Null and wordless texts are taken no times.
    """
    of, cuts = plan(settle(_sized(docs, "doc_id", "text", "source")))
    kept = F.struct(*[c.alias(f"keep{i}") for i, c in enumerate(columns(docs))]).alias("kept")
    taken = _taken(_sized(docs, "doc_id", "text", "source", kept), of, cuts).where("copies > 0")
    repeated = taken.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"))
    return repeated.select(*[F.col(f"kept.keep{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("nth").alias(unused(docs, "copy")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS BIGINT) AS size,
    CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')))[1:13] AS BIGINT) AS draw FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN length(ltrim(bin(size), '0')) ELSE 0 END AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 2 AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(arg_min(level, place) FILTER (WHERE level * weight <= cap) OVER () * weight, CAST(cap AS DOUBLE))) AS target FROM l),
c1 AS (SELECT source, class, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY source, class),
c2 AS (SELECT c1.*, source_size, target, CAST(coalesce(sum(words * 2) OVER (PARTITION BY c1.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_words,
    CAST(sum(words * class) OVER (PARTITION BY c1.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest, row_number() OVER (PARTITION BY c1.source ORDER BY class DESC) AS place
  FROM c1 JOIN t ON c1.source IS NOT DISTINCT FROM t.source),
c3 AS (SELECT *, CASE WHEN rest > 0 THEN (target - full_words) / rest END AS level FROM c2),
c4 AS (SELECT *, min(place) FILTER (WHERE level * class <= 2) OVER (PARTITION BY source) AS found, arg_min(level, place) FILTER (WHERE level * class <= 2) OVER (PARTITION BY source) AS at_level FROM c3),
c5 AS (SELECT *, CASE WHEN words = 0 THEN 0::DOUBLE WHEN found IS NULL OR place < found THEN 2::DOUBLE ELSE at_level * class END AS times FROM c4),
c6 AS (SELECT *, target - CAST(sum(floor(times) * words) OVER (PARTITION BY source) AS BIGINT) AS want FROM c5),
k AS (SELECT e.*, source_size, target, want, floor(times) AS whole, times - floor(times) AS p, (draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM e JOIN c6 ON e.source IS NOT DISTINCT FROM c6.source AND e.class = c6.class),
r AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM k),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r),
n AS (SELECT *, min(abs(upto - want)) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY source) AS nearest FROM c),
m AS (SELECT *, max(CASE WHEN q IS NOT NULL AND abs(upto - want) = nearest AND abs(upto - want) <= want THEN upto END) OVER (PARTITION BY source) AS cut FROM n)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN q IS NOT NULL AND upto <= cut THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
