"""Language identification with error-correcting output codes.

Every language gets a codeword; for each of its bits a linear classifier over
hashed n-grams of UTF-8 bytes predicts the bit. A text is decoded to the
codeword with the least loss over the bits, each weighted by how well its
classifier did in training; a narrow lead over the runner-up is flagged.

The model is fitted on the driver from a bounded sample and is a small array;
prediction is a vectorised UDF over whole texts.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, sampled_texts, table, unused

#: Training texts of each language, of all languages together, and their length, at most: the bound on what is fetched.
SAMPLE = 300
SAMPLE_TEXTS = 6_000
SAMPLE_CHARS = 20_000
#: Languages that are learned, at most; of more, those with most rows.
MOST_LANGUAGES = 200
#: Languages with a codeword table by enumeration; with more, codewords are drawn.
EXHAUSTIVE = 5
FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: A text is ambiguous if the second language is at least this likely.
AMBIGUOUS = 0.4
UNKNOWN = "und"
#: Numbers that ``\w`` takes for letters: superscripts, fractions, Roman numerals and the like.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: What stands around each text, so that no n-gram reaches into another.
_PAD = b" " * 2
#: Bytes of text whose n-grams are hashed at a time, and texts that are prepared at a time.
_SLAB = 1 << 16
_TEXTS = 512


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits of the languages for a few, else the best of several random codes."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= EXHAUSTIVE:
        return np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=k - 1)][1:], np.float32).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(k)))
    best, most = None, -1.0
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        apart = (bits - np.abs(code @ code.T) + 1e9 * np.eye(k)).min() if (np.abs(code.sum(0)) < k).all() else -1
        if apart > most:
            best, most = code, apart
    return best


def prepared(text: str) -> bytes:
    """Letters in lower case, a space for all else."""
    letters = _NOT_LETTERS.sub(" ", text.lower())
    if not letters.isascii() and (numbers := _NUMBERS.intersection(letters)):
        letters = " ".join(letters.translate(dict.fromkeys(map(ord, numbers), " ")).split())
    return (" " + letters.strip() + " ").encode("utf-8", "replace")


def ngram_ids(raw: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the hashed n-gram that ends at each byte (the first few look back at zeros)."""
    x = raw.astype(np.uint32)
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        back = x if n == 1 else np.concatenate((np.zeros(n - 1, np.uint32), x[: 1 - n]))
        h = h * np.uint32(0x01000193) + back + np.uint32(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (mixed ^ (mixed >> np.uint32(13))) % np.uint32(FEATURES)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with a pad before and after each, and where each begins; its share goes on to the next begin."""
    begins = np.cumsum([len(_PAD)] + [len(t) + len(_PAD) for t in texts])
    return np.frombuffer(_PAD + b"".join(t + _PAD for t in texts), np.uint8), begins


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    slope: np.ndarray  # bits: from mean log-odds to a margin
    trust: np.ndarray  # bits: weight of a bit in decoding

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """texts x bits: how far each bit leans to +1, by the mean over n-grams, surer in longer texts."""
        out = np.zeros((len(texts), self.code.shape[1]))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= _SLAB):
                size, j = size + len(texts[j]), j + 1
            out[i:j] = self._slab(texts[i:j])
            i = j
        return out

    def _slab(self, texts: list[bytes]) -> np.ndarray:
        raw, begins = joined(texts)
        starts, ends, total = begins[:-1], begins[1:], np.zeros((len(texts), self.weights.shape[1]))
        for a in range(0, len(raw), _SLAB):  # a long text goes piece by piece
            piece = raw[max(0, a - max(ORDERS)) : a + _SLAB]
            skip = min(a, max(ORDERS))
            inside = np.flatnonzero((starts < a + _SLAB) & (ends > a))
            if not len(inside):
                continue
            at = np.clip(starts[inside] - a, 0, None)
            for ids in ngram_ids(piece):
                total[inside] += np.add.reduceat(self.weights[ids[skip:]].astype(np.float64), at, axis=0)
        return total * (self.slope / np.sqrt([len(t) for t in texts])[:, None])

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods of the languages from loss-weighted distances to their codewords, and their order."""
        loss = np.logaddexp(0, -np.clip(margins, -30, 30)[:, None, :] * self.code[None]) @ self.trust
        like = np.exp(-(loss - loss.min(1, keepdims=True)))
        return like / like.sum(1, keepdims=True), np.argsort(loss, axis=1, kind="stable")


def fit(samples: list[tuple[str, str]]) -> Model:
    """From (text, language). Each text is also cut into pieces, so that short texts are learned too."""
    pieces: list[tuple[bytes, str]] = []
    for text, lang in samples:
        got = prepared(text)
        if len(got) > 2:
            pieces.append((got, lang))
            tokens = got.split()
            for width in (1, 3, 10):
                step = max(width, len(tokens) // 4)
                pieces += [(b" " + b" ".join(tokens[i : i + width]) + b" ", lang) for i in range(0, len(tokens), step)]
    languages = sorted({lang for _, lang in pieces})
    code = codewords(len(languages))
    index = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), FEATURES))
    for got, lang in pieces:
        raw, _ = joined([got])
        for ids in ngram_ids(raw):
            counts[index[lang]] += np.bincount(ids[len(_PAD) :], minlength=FEATURES)
    rate = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # each language counts alike
    weights = np.zeros((FEATURES, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        up, down = rate[code[:, b] > 0].sum(0), rate[code[:, b] < 0].sum(0)
        weights[:, b] = np.log(up + 1e-6) - np.log(down + 1e-6) if len(languages) > 1 else 0
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) > 1:
        truth = code[[index[lang] for _, lang in pieces]]
        margins = model.margins([got for got, _ in pieces])
        for b in range(code.shape[1]):  # the slope by Newton steps on the logistic loss, the trust from the errors left
            s, m = 1.0, margins[:, b] * truth[:, b]
            for _ in range(20):
                p = 1 / (1 + np.exp(np.clip(s * m, -30, 30)))
                s = min(max(s + (p * m).sum() / max((p * (1 - p) * m * m).sum(), 1e-9), s / 2, 1e-3), 2 * s, 50.0)
            model.slope[b], model.trust[b] = s, max(1e-3, 1 - 2 * (m <= 0).mean())
        model.trust /= model.trust.mean()
    return model


def training_sample(docs: DataFrame, text_col: str, lang_col: str, per_language: int = SAMPLE, max_texts: int = SAMPLE_TEXTS, max_chars: int = SAMPLE_CHARS, most: int = MOST_LANGUAGES) -> list[tuple[str, str]]:
    """(text, language): whole different texts, ``per_language`` and ``max_texts`` at most, none over ``max_chars``, the same ones at every run."""
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.char_length(text_col) <= max_chars)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counted:
        return []
    known = usable.where(F.col("lang").isin([r["lang"] for r in counted]))
    rows = sampled_texts(known, "lang", "text", max(1, min(per_language, max_texts // len(counted)))).collect()
    return sorted((r["text"], r["group"]) for r in rows)


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """Add the struct ``out``: lang, score (0 to 1), ambiguous.

    ``und`` with score 0 for null texts, texts without a letter, and if no
    language was learned. All other columns stay as they are.
    """
    own = model

    def judged(texts: pd.Series) -> pd.DataFrame:
        got = [prepared(t) if t is not None else b"" for t in texts]
        known = np.array([i for i, t in enumerate(got) if len(t) > 2], int) if own.languages else np.array([], int)
        lang, score, unsure = np.full(len(got), UNKNOWN, object), np.zeros(len(got)), np.zeros(len(got), bool)
        if len(known):
            like, order = own.decode(own.margins([got[i] for i in known]))
            lang[known] = np.array(own.languages, object)[order[:, 0]]
            score[known] = np.take_along_axis(like, order[:, :1], 1)[:, 0]
            if len(own.languages) > 1:
                unsure[known] = np.take_along_axis(like, order[:, 1:2], 1)[:, 0] >= AMBIGUOUS
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": unsure})

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [judged(texts.iloc[i : i + _TEXTS]) for i in range(0, len(texts), _TEXTS)]
            yield pd.concat(parts, ignore_index=True) if parts else judged(texts)

    # Not deterministic, as else a filter on the result would compute it twice.
    return docs.withColumn(out, identify.asNondeterministic()(F.col(text_col)))


def held_out(id_col: Column) -> Column:
    """The part that is never learned from: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows that are not held out; a row of a null id is left out as well."""
    return fit(training_sample(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), text_col, lang_col))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"), F.col("lang_id.ambiguous").alias("ambiguous"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identifiable language go; ``lang`` of the others is what was identified.

    Null texts and texts without a letter go, and all if nothing was learned.
    All other columns are passed on unchanged, repeated rows are kept.
    """
    out = unused(docs, "__lang_id")
    found = predict(docs, trained(docs), out=out).where(F.col(out)["lang"] != UNKNOWN)
    return found.select(*[F.col(out)["lang"].alias(name) if name == "lang" else c for name, c in zip(docs.columns, columns(docs), strict=True)])
