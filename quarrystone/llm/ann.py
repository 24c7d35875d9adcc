"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions several times, each time with its own
random projection and shift, and ordered along a Hilbert curve. Spark sorts
each order by range partitioning; a query looks at the vectors within a window
of ranks on every curve, and the windows are merged and reranked by the exact
cosine. The half-width of the windows is the smallest that finds enough true
neighbours for a bounded sample of queries. Every vector is in every order,
and is compared in full where a window meets it.

Equal vectors are one entry with the few smallest ids it can ever contribute,
so ties and large groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

CURVES = 16
#: Dimensions of a projection and bits of each; their product fits a signed 64-bit key.
PROJECTED, BITS = 10, 6
#: Queries on which the window is fitted, at most, and the share of true neighbours it must reach there.
FIT_QUERIES = 128
FIT_RECALL = 0.92
#: Vectors of a block, within which queries and vectors are multiplied; queries that meet a block in one task at most.
BLOCK = 2048
QUERY_CHUNK = 20_000
#: Numbers of the pairs that are scored in double precision at once; bounds memory only.
PAIR_VALUES = 1 << 22
SEED = 20240607


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates in [0, 2^bits)."""
    x = cells.astype(np.uint64)
    dims, one = x.shape[1], np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the reflections and exchanges of each level, from the coarsest
        q = np.uint64(1 << b)
        low = q - one
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[:, dims - 1] & np.uint64(1 << b), turn ^ np.uint64((1 << b) - 1), turn)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: projected to normal coordinates, shifted, cut into cells."""
    rng = np.random.default_rng((SEED, curve))
    plane, shift = rng.standard_normal((vectors.shape[1], PROJECTED)), rng.random(PROJECTED)
    inside = np.clip((vectors @ plane + 4 + shift) / 9, 0, 1 - 1e-9)
    return hilbert_keys((inside * (1 << BITS)).astype(np.int64), BITS)


def _unit(column: pd.Series) -> np.ndarray:
    v = np.array(column.tolist(), np.float64).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the same order wherever a pair is met."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _single(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows of its k nearest vectors and their cosines; ties to the smaller id.

    Single precision only rules out rows that cannot be among the k nearest.
    A product of unit vectors of d components, rounded to 24 bits and summed
    in any order, is off by less than (d + 4) / 2^24, so whatever comes within
    twice that of the k-th is scored in double precision, however many.
    """
    scaled, dims, n = _single(vectors), vectors.shape[1], len(vectors)
    apart = 2 * (dims + 4) * 2.0**-24
    pairs = max(PAIR_VALUES // max(dims, 1), 1)
    for a in range(0, len(queries), 512):
        some = queries[a : a + 512]
        near = np.nan_to_num(_single(some) @ scaled.T, copy=False, nan=-np.inf)
        last = np.partition(near, n - k, axis=1)[:, n - k] if k < n else np.full(len(some), -np.inf)
        q, rows = np.nonzero(near >= (last.astype(np.float64) - apart)[:, None])
        exact = np.concatenate([_cosines(some[q[i : i + pairs]], vectors[rows[i : i + pairs]]) for i in range(0, len(q), pairs)])
        order = np.lexsort((ids[rows], -exact, q))
        starts = np.searchsorted(q, np.arange(len(some) + 1))
        for i in range(len(some)):
            best = order[starts[i] : min(starts[i] + k, starts[i + 1])]
            yield a + i, rows[best], exact[best]


def _true_best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same from all cosines in double precision."""
    for i, query in enumerate(queries):
        exact = _cosines(query[None, :], vectors)
        best = np.lexsort((ids, -exact))[:k]
        yield i, best, exact[best]


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(valid rows, entries): (id, h, v), and for each different vector (vid, h, v, ids): its least id and the k + 1 least."""
    v = F.col(vector_col)
    if dict(vectors.dtypes)[vector_col] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).select("id", F.xxhash64("v").alias("h"), "v")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()  # one row
    rows = rows.where(F.size("v") == (dims[0]["d"] if dims else 0))
    least = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    return rows, settle(least.groupBy("h", "v").agg(F.min("id").alias("vid"), F.array_sort(F.collect_set("id")).alias("ids")))


def curve_ranks(entries: DataFrame, curves: int) -> DataFrame:
    """(curve, vid, rank): the place of each entry on each curve, over all entries."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                unit = _unit(frame["v"])
                for c in range(curves):
                    yield pd.DataFrame({"curve": np.int32(c), "key": curve_keys(unit, c), "vid": frame["vid"]})

    keyed = entries.select("vid", "v").mapInPandas(keys, "curve int, key long, vid long")
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = settle(keyed.repartitionByRange(parts, "curve", "key", "vid").sortWithinPartitions("curve", "key", "vid"))
    numbered = ordered.select("curve", "vid", F.monotonically_increasing_id().alias("m"))  # partition x 2^33 + place
    held = numbered.groupBy(F.shiftright("m", 33).alias("part"), "curve").agg(F.count("*").alias("n")).orderBy("part").collect()  # partitions and curves, not rows
    # Where a curve's rows of a partition begin in the partition, and how many of the curve came before.
    offsets, seen, begun = {}, dict.fromkeys(range(curves), 0), {}
    for r in sorted(held, key=lambda r: (r["part"], r["curve"])):
        offsets[(r["part"], r["curve"])] = seen[r["curve"]] - begun.get(r["part"], 0)
        begun[r["part"]] = begun.get(r["part"], 0) + r["n"]
        seen[r["curve"]] += r["n"]
    shift = entries.sparkSession.createDataFrame([(p, c, o) for (p, c), o in offsets.items()], "part long, curve int, shift long")
    place = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = numbered.withColumn("part", F.shiftright("m", 33)).join(F.broadcast(shift), ["part", "curve"])
    return settle(placed.select("curve", "vid", (place + F.col("shift")).alias("rank")))


def fitted_width(entries: DataFrame, ranks: DataFrame, asked: DataFrame, k: int, sample: int = FIT_QUERIES, recall: float = FIT_RECALL) -> int:
    """Half-width in ranks at which ``recall`` of the true neighbours of up to ``sample`` queries lie in a window."""
    drawn = asked.orderBy(F.xxhash64("vid"), "vid").limit(sample).collect()
    if not drawn:
        return 0
    ids, queries = [r["vid"] for r in drawn], np.array([r["v"] for r in drawn], np.float64)
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast((ids, queries))

    def truth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qs = shared.value
        for frame in frames:
            if len(frame):
                v, own = np.array(frame["v"].tolist(), np.float64), frame["vid"].to_numpy()
                for i, rows, cos in _true_best(qs, v, own, k + 1):
                    yield pd.DataFrame({"q": qids[i], "vid": own[rows], "cos": cos})

    near = entries.select("vid", "v").mapInPandas(truth, "q long, vid long, cos double").where("q <> vid")
    order = Window.partitionBy("q").orderBy(F.desc("cos"), "vid")
    pairs = F.broadcast(settle(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "vid")))
    own = F.broadcast(settle(ranks.join(pairs.select(F.col("q").alias("vid")).distinct(), "vid").select("curve", F.col("vid").alias("q"), F.col("rank").alias("at"))))
    apart = ranks.join(pairs, "vid").join(own, ["curve", "q"]).groupBy("q", "vid").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("apart"))
    need = sorted(r["apart"] for r in apart.collect())  # sample x k numbers
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))))] if need else 0


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, curves: int = CURVES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``. Candidates are all ids
    but the query's own. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those of another length than
    the most common, nor null ids. Repeated ids of one vector count once.
    """
    rows, entries = distinct_vectors(vectors, id_col, vector_col, k)
    mine = rows.where(is_query).select("id", "h", "v").join(entries.select("h", "v", "vid"), ["h", "v"]).select("id", "vid").distinct()
    mine = settle(mine)
    asked = settle(entries.select("vid", "v").join(mine.select("vid").distinct(), "vid", "left_semi"))
    ranks = curve_ranks(entries, curves)
    width = fitted_width(entries, ranks, asked, k)
    # A block is at most a quarter of a window wide, but no smaller than is worth a multiplication.
    block = max(min(block, width // 4), 128)
    chunks = max(1, -(-(2 * width + block) // (block * QUERY_CHUNK)), -(-asked.count() // (QUERY_CHUNK * 64)))
    placed = ranks.join(entries.select("vid", "v", "ids"), "vid")
    placed = placed.select("curve", F.floor(F.col("rank") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vid", "v", "ids")
    seen = F.sequence(F.floor(F.greatest(F.col("rank") - width, F.lit(0)) / block), F.floor((F.col("rank") + width) / block))
    looks = ranks.join(asked, "vid").select(F.col("curve").alias("curve2"), F.explode(seen).alias("block2"), F.pmod(F.xxhash64("vid"), F.lit(chunks)).cast("int").alias("chunk2"), F.col("vid").alias("q"), F.col("v").alias("qv"))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            v, ids, lists = np.array(left["v"].tolist(), np.float64), left["vid"].to_numpy(), left["ids"].tolist()
            qids = right["q"].tolist()
            for i, best, cos in _best(np.array(right["qv"].tolist(), np.float64), v, ids, k + 1):
                found += [(qids[i], ids[r], lists[r], c) for r, c in zip(best, cos, strict=True)]
        return pd.DataFrame(found, columns=["q", "vid", "ids", "score"])

    met = placed.groupBy("curve", "block", "chunk").cogroup(looks.groupBy("curve2", "block2", "chunk2")).applyInPandas(meet, "q long, vid long, ids array<long>, score double")
    # What a vector finds is found for all queries that have it; each leaves out its own id.
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vid")
    kept = met.groupBy("q", "vid").agg(F.first("ids").alias("ids"), F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    listed = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x.alias("id")))))), 1, k + 1)
    per_vector = kept.groupBy("q").agg(listed.alias("near"))
    others = mine.join(per_vector, mine["vid"] == per_vector["q"]).select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    out = others.select(F.col("id").alias("query_id"), F.posexplode("near").alias("rank", "c"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.far")).alias("score"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
