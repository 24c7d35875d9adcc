"""SimHash near-duplicates over pivot distance tables.

Every fingerprint gets its Hamming distances to a table of reference
fingerprints. Two fingerprints that differ in ``d`` bits differ by at most
``d`` in every coordinate, so a pair with a larger coordinate difference is
discarded unseen, and the survivors are verified bit by bit.

The references are a base and the base with one bit flipped each. The
difference of the base's coordinate and a bit's tells that bit's distance
alone. Coordinates are joined in four groups, and as at most two bits differ,
two groups agree in every coordinate: candidates share one of six pairs of
groups, 32 bits, which is what makes the pivot table searchable without
comparing all pairs.

A cell with many members (a large group of near copies) is divided again in
the same way: the coordinates that are not agreed on yet form four groups, two
of which agree. Each time half of the rest is agreed on, until a cell has few
members; with two coordinates left it has four at most.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, ascii_lower, columns, settle, stored, table, unused, words

#: The base reference, a fixed value.
BASE = 0x5851F42D4C957F2D
GROUPS = 4
#: Fingerprints of a cell that are compared in pairs; larger cells are divided by further coordinates.
CELL = 64
#: Shingles for each partial count, so that a 16-bit lane cannot overflow into the sign.
CHUNK = 32767
_LANES = 0x0001000100010001


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, row_col: str | None = None) -> DataFrame:
    """(rid, id, fp): a row for each row, fp zero where there are no words; ``row_col`` names a unique number of the row, if there is one."""
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).alias("id"), words(ascii_lower(F.col(text_col)), SPACE_WORD).alias("ws"))
    each = rows.select("rid", "id", "ws", F.posexplode_outer("ws").alias("pos", "w"))
    each = each.where(F.col("pos").isNull() | (F.col("pos") == 0) | (F.col("pos") <= F.size("ws") - shingle))
    h = F.when(F.col("pos").isNotNull(), F.xxhash64(F.concat_ws(" ", "w", *[F.get("ws", F.col("pos") + i) for i in range(1, shingle)])))
    hashed = each.select("rid", "id", F.floor(F.col("pos") / CHUNK).alias("chunk"), h.alias("h"))
    lanes = [F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(16)]
    part = hashed.groupBy("rid", "id", "chunk").agg(F.count("h").alias("n"), *lanes)
    bits = [F.sum(F.shiftright(f"s{i % 16}", 16 * (i // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"b{i}") for i in range(64)]
    whole = part.groupBy("rid", "id").agg(F.sum("n").alias("n"), *bits)
    marks = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(_long(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(64)]
    return whole.select("rid", "id", functools.reduce(lambda a, b: a.bitwiseOR(b), marks).alias("fp"))


def pivots() -> list[int]:
    return [BASE, *[BASE ^ (1 << i) for i in range(64)]]


def distances(fp: Column) -> Column:
    """The row of the pivot table: Hamming distances to all references."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_long(p)))).cast("byte") for p in pivots()])


def _near(most: int) -> Column:
    """The coordinates allow it, and the bits confirm it."""
    apart = F.greatest(*[F.abs(F.get("a.d", F.lit(i)).cast("int") - F.get("b.d", F.lit(i)).cast("int")) for i in range(65)])
    return (apart <= most) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most)


def _choices(rest: list[int]) -> list[list[int]]:
    """The coordinates of each two of four groups."""
    groups = [rest[i * len(rest) // GROUPS : (i + 1) * len(rest) // GROUPS] for i in range(GROUPS)]
    return [a + b for a, b in itertools.combinations(groups, 2)]


def _flags(places: list[int]) -> Column:
    """For each of the places a bit: whether the fingerprint differs from the base there, by its coordinates."""
    bits = [F.when(F.get("d", F.lit(0)) > F.get("d", F.lit(i + 1)), F.lit(_long(1 << i))).otherwise(F.lit(0).cast("long")) for i in places]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def links(fps: DataFrame, most: int = 2, cell: int = CELL) -> DataFrame:
    """(src, dst), src < dst: all pairs of the distinct fingerprints ``fp`` that are within ``most`` (1 or 2) bits."""
    if most not in (1, 2):
        raise ValueError("the coordinate groups are laid out for one or two bits")
    table = settle(fps.withColumn("d", distances(F.col("fp"))).select("fp", "d", _flags(list(range(64))).alias("flags")))
    # What a cell agrees on: the coordinates (as a mask) and their values.
    choices = [functools.reduce(lambda a, i: a | 1 << i, places, 0) for places in _choices(list(range(64)))]
    cells = table.select("fp", "flags", F.explode(F.array(*[F.lit(_long(m)) for m in choices])).alias("mask")).withColumn("key", F.col("flags").bitwiseAND(F.col("mask")))
    found, left = None, 32
    while True:
        size = settle(cells.groupBy("mask", "key").agg(F.count("*").alias("members")).where("members > 1"))
        small = cells.join(size.where(F.col("members") <= (cell if left > 2 else 4)).drop("members"), ["mask", "key"]).join(table.select("fp", "d"), "fp")
        a, b = small.alias("a"), small.alias("b")
        same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        pairs = settle(a.join(b, same & _near(most)).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).distinct())
        found = pairs if found is None else found.union(pairs)
        large = size.where(F.col("members") > cell).drop("members")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()] if left > 2 else []  # as many as there are choices
        if not masks:
            return found.distinct()
        divided = {m: [_long(m & (1 << 64) - 1 | functools.reduce(lambda x, i: x | 1 << i, p, 0)) for p in _choices([i for i in range(64) if not m >> i & 1])] for m in masks}
        finer = F.create_map(*itertools.chain.from_iterable((F.lit(m), F.array(*[F.lit(x) for x in parts])) for m, parts in divided.items()))
        cells = settle(cells.join(large, ["mask", "key"]).select("fp", "flags", F.explode(F.element_at(finer, F.col("mask"))).alias("mask")).distinct().withColumn("key", F.col("flags").bitwiseAND(F.col("mask"))))
        left //= 2


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst): root is the least node reachable.

    Each round takes the least label among neighbours and then the label of
    that label, so paths shorten by doubling. Rows of the rounds are as many
    as nodes and links; the labels are checkpointed each round.
    """
    both = settle(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("root").alias("up"))
        jumped = settle(nearer.join(up, "near").select("node", F.col("root").alias("old"), F.least("near", "up").alias("root")))
        moved = jumped.where("old <> root").limit(1).count()
        labels = jumped.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2, row_col: str | None = None) -> DataFrame:
    """(rid, id, fp, root, component): rows whose fingerprints are linked share the least id of all of them.

    Texts without words, null ones included, have fingerprint zero and are
    linked like any other. A null id is no candidate for the least id; a
    component of null ids alone has a null one. Repeated rows are rows of
    their own in one component. Extra columns are ignored.
    """
    fps = settle(fingerprints(docs, id_col, text_col, shingle, row_col))
    distinct = settle(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), most))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(named, "root").select("fp", "root", "component")
    return fps.join(known, "fp").select("rid", "id", "fp", "root", "component")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row of the least id stays (of several, the first; null ids come last).

    Groups are those of op4: three-word shingles and at most two bits. Near
    copies beyond two bits stay, among them about a ninth of the pairs whose
    five-word similarity is 0.8 or more (12 of 102 on sf0.01). Rows are stored
    with a number first, by which they are found again; all columns are
    passed on unchanged. Texts without words, null ones included, are copies
    of each other. An empty table gives an empty one.
    """
    row = unused(docs, "__row")
    kept = stored(docs, row)
    found = near_duplicates(kept.select(row, "doc_id", "text"), row_col=row)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid")).alias("m")).select(F.col("m.rid").alias(row))
    return kept.join(first, row, "left_semi").select(*columns(docs))
