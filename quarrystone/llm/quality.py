"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (toxic), 1 (of low quality) or 2 (good). One vector of
weights over hashed text features is shared by all grades; ordered thresholds
cut its score into them: P(grade <= j) = sigmoid(threshold_j - score). The
model gives the expected grade and the tail probabilities P(grade >= j), of
which selection takes the top one.

Features are present or absent, so one telling word counts the same in a long
text as in a short one; a sparse penalty keeps words that tell nothing at 0.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled_texts, smallest, table

GRADES = 3
#: Rated documents of each grade in the training sample at most, and their length at most.
SAMPLE = 1500
SAMPLE_CHARS = 20_000
FEATURES = 1 << 18
ROUNDS = 400
PENALTY = 1e-3
STEP = 1.0
#: Lengths of word beginnings that are features beside the words, for inflected and compound words.
PREFIXES = (4, 6)
#: A feature is learned only if so many training documents have it.
LEAST_DOCS = 4
#: A document counts as toxic below this P(grade >= 1), and is kept from this P(grade >= 2) on.
TOXIC_BELOW, KEPT_FROM = 0.8, 0.25
_RUNS = re.compile(r"[!-/:-@\[-`{-~]{2,}")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _share(part: int, whole: int) -> int:
    """A share in tenths, 0 only for none."""
    return 0 if part == 0 else 1 + min(9, 10 * part // max(1, whole))


def features(text: str) -> set[str]:
    """Words without case and punctuation around them, and the shape of the whole text in coarse steps."""
    tokens = text.split()
    n = len(tokens)
    different = set(tokens)
    found = {t.strip(_EDGES) for t in text.lower().split()} if n else set()
    found.discard("")
    found |= {f"\1{w[:size]}" for size in PREFIXES for w in found if len(w) > size}
    same = sum(map(operator.eq, tokens, tokens[1:]))
    shape = (
        ("again", _share(same, n)), ("different", _share(len(different), n)), ("upper", _share(sum(map(str.isupper, tokens)), n)), ("runs", _share(len(_RUNS.findall(text)), n)),
        ("bars", _share(text.count("|"), n)), ("digits", _share(sum(map(str.isdigit, tokens)), n)), ("length", min(n, 1 << 20).bit_length()), ("line", min(n // (text.count("\n") + 1), 1 << 10).bit_length()),
    )
    return found | {f"\0{name}={step}" for name, step in shape}


def feature_id(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % FEATURES


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str, cache: dict[str, float]) -> float:
        total = 0.0
        for f in features(text):
            w = cache.get(f)
            if w is None:
                w = float(self.weights[feature_id(f)])
                if len(cache) < 1_000_000:
                    cache[f] = w
            total += w
        return total

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None], -40, 40)))


def fit(samples: list[tuple[str, int]]) -> Model:
    """Maximum likelihood with an L1 penalty by proximal gradient steps of AdaGrad size; each grade counts alike."""
    grades = np.array([g for _, g in samples], int)
    rows = [np.array(sorted({feature_id(f) for f in features(t)}), int) for t, _ in samples]
    model = Model(np.zeros(FEATURES, np.float32), np.arange(GRADES - 1) - 0.5)
    if not rows:
        return model
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ids, cols = np.unique(np.concatenate(rows), return_inverse=True)
    common = np.bincount(cols, minlength=len(ids)) >= LEAST_DOCS
    keep = common[cols]
    doc, cols = doc[keep], (np.cumsum(common) - 1)[cols[keep]]
    ids = ids[common]
    per_grade = np.bincount(grades, minlength=GRADES)
    each = 1 / (per_grade[grades] * np.count_nonzero(per_grade))
    w, cuts, seen_w, seen_c = np.zeros(len(ids)), np.array(model.thresholds, float), np.full(len(ids), 1e-8), np.full(GRADES - 1, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(ROUNDS):
        s = np.bincount(doc, weights=w[cols], minlength=len(rows))
        below = np.hstack([np.zeros((len(s), 1)), sigmoid(cuts[None] - s[:, None]), np.ones((len(s), 1))])
        low, high = np.take_along_axis(below, grades[:, None], 1)[:, 0], np.take_along_axis(below, grades[:, None] + 1, 1)[:, 0]
        p = np.maximum(high - low, 1e-9)
        slope_low, slope_high = low * (1 - low) / p * each, high * (1 - high) / p * each
        down = slope_high - slope_low  # of the loss, by the score
        grad = np.bincount(cols, weights=down[doc], minlength=len(ids))
        grad_c = np.array([slope_low[grades == j + 1].sum() - slope_high[grades == j].sum() for j in range(GRADES - 1)])
        seen_w += grad * grad
        seen_c += grad_c * grad_c
        rate = STEP / np.sqrt(seen_w)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        cuts = np.maximum.accumulate(cuts - STEP / np.sqrt(seen_c) * grad_c)
    model.weights[ids] = w
    model.thresholds = cuts
    return model


def rated(labels: DataFrame) -> DataFrame:
    """(rated_id, grade) from quality and toxic of 0 or 1; the lowest of several ratings counts, nulls are no rating."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").alias("rated_id"), grade.alias("grade")).where("rated_id is not null and grade is not null").groupBy("rated_id").agg(F.min("grade").alias("grade"))


def training_sample(docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE, max_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``per_grade`` different rated whole texts of each grade, none over ``max_chars``, the same ones at every run."""
    ids = smallest(rated(labels).withColumn("draw", F.xxhash64("rated_id")), "grade", "draw", per_grade).select("rated_id", "grade")
    usable = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= max_chars)).select("doc_id", "text")
    # As many ids as the sample has texts at most, but any number of rows may have them.
    rows = sampled_texts(usable.join(F.broadcast(ids), usable["doc_id"] == ids["rated_id"]), "grade", "text", per_grade).collect()
    return sorted((r["text"], r["group"]) for r in rows)


def grade(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality") -> DataFrame:
    """Add the struct ``out``: expected (grade), tail1 and tail2 (P(grade >= 1), P(grade >= 2)).

    A null text is graded as an empty one. All other columns stay.
    """
    @F.pandas_udf("expected double, tail1 double, tail2 double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, cache = model, {}
        for texts in batches:
            tails = own.tails(np.array([own.score(t or "", cache) for t in texts], float))
            yield pd.DataFrame({"expected": tails.sum(1), "tail1": tails[:, 0], "tail2": tails[:, 1]})

    # Not deterministic, as else a filter on the result would compute it twice.
    return docs.withColumn(out, graded.asNondeterministic()(F.col(text_col)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = grade(docs, fit(training_sample(docs, table(spark, sf_dir, "labels"))))
    q = F.col("quality")
    return found.select("doc_id", q["expected"].alias("expected_grade"), q["tail1"].alias("p_not_toxic"), q["tail2"].alias("p_good"), (q["tail1"] < TOXIC_BELOW).alias("toxic"), ((q["tail1"] >= TOXIC_BELOW) & (q["tail2"] >= KEPT_FROM)).alias("keep"))
