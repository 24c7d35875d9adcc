"""The trained operators against plain versions of what they compute."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import langid, quality, registry

WORDS = {"aa": "der die und ist ein nicht mit auf", "bb": "the and of to is in that was", "cc": "le la les des une est que dans", "dd": "el los una por con para del", "ee": "il lo gli che non per sono", "ff": "og det er en til av som"}


def samples(n=40, seed=1):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(w.split(), k=rng.randint(1, 60))), lang) for lang, w in WORDS.items() for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return langid.fit(samples())


def plain_margin(model, text, bit):
    """The sum over all n-grams, one by one."""
    raw, total = b"  " + text + b"  ", 0.0
    for n in langid.ORDERS:
        for i in range(2, len(raw)):
            h = 0
            for k in range(1, n + 1):  # the byte itself first, then those before it
                back = raw[i - k + 1] if i - k + 1 >= 0 else 0
                h = (h * 0x01000193 + back + k) % 2**32
            h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
            total += float(model.weights[(h ^ (h >> 13)) % langid.FEATURES, bit])
    return total * model.slope[bit] / math.sqrt(len(text))


def test_margins(model, monkeypatch):
    texts = [langid.prepared(t) for t in ("der Hund und", "x", "Été à l'école " * 30, "the cat " * 200, "そして")]
    want = [[plain_margin(model, t, b) for b in range(model.code.shape[1])] for t in texts]
    assert model.margins(texts) == pytest.approx(np.array(want), rel=1e-6, abs=1e-9)
    monkeypatch.setattr(langid, "_SLAB", 100)  # texts longer than a slab
    assert model.margins(texts) == pytest.approx(np.array(want), rel=1e-6, abs=1e-9)
    assert np.concatenate([model.margins([t]) for t in texts]) == pytest.approx(np.array(want), rel=1e-6, abs=1e-9), "neighbours make no difference"


def test_decoding_is_the_least_weighted_loss(model):
    rng = np.random.default_rng(4)
    margins = rng.normal(0, 4, (50, model.code.shape[1]))
    like, order = model.decode(margins)
    for m, own, found in zip(margins, like, order, strict=True):
        loss = [sum(t * math.log1p(math.exp(-x * c)) for x, c, t in zip(m, code, model.trust, strict=True)) for code in model.code]
        assert found[0] == min(range(len(loss)), key=loss.__getitem__)
        share = [math.exp(-x) for x in loss]
        assert own.tolist() == pytest.approx([s / sum(share) for s in share], rel=1e-6)


def test_one_wrong_bit_is_corrected(model):
    code = model.code
    assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= 3
    for lang, bit in itertools.product(range(len(code)), range(code.shape[1])):
        margins = code[lang] * 3.0
        margins[bit] *= -1
        assert model.decode(margins[None])[1][0, 0] == lang


def test_ambiguous_is_a_narrow_lead(spark, model):
    docs = spark.createDataFrame([("der und",), ("the of der die",), (None,)], "text string")
    for r in langid.predict(docs, model).collect():
        if r["text"] is None:
            assert tuple(r["lang_id"]) == ("und", 0.0, False)
        else:
            like = np.sort(model.decode(model.margins([langid.prepared(r["text"])]))[0][0])
            assert r["lang_id"]["score"] == pytest.approx(like[-1]) and r["lang_id"]["ambiguous"] == (like[-2] >= langid.AMBIGUOUS)


@pytest.mark.parametrize("text,letters", [("² ½ ① Ⅷ", False), ("१२", False), ("__", False), ("ª", True), ("ʰ", True), ("12a", True), ("🙂", False), ("漢", True)])
def test_letters_are_those_of_unicode(text, letters):
    assert (len(langid.prepared(text)) > 2) == letters == any(c.isalpha() for c in text)


def test_samples_are_bounded_by_texts(spark):
    docs = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"), F.lit("s").alias("source"))
    got = langid.training_sample(docs, "text", "lang", per_language=20)
    assert len(got) == len(set(got)) == 60 and {lang for _, lang in got} == {"l0", "l1", "l2"}
    assert got == langid.training_sample(docs.repartition(5), "text", "lang", per_language=20)
    assert len(langid.training_sample(docs, "text", "lang", max_texts=15)) == 15
    assert {lang for _, lang in langid.training_sample(docs.union(docs.where("lang = 'l1'")), "text", "lang", most=1)} == {"l1"}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rated = quality.training_sample(docs, labels, per_grade=10)
    assert len(rated) == 30 and {g for _, g in rated} == {0, 1, 2}


def ordinal_loss(w, cuts, x, grades, each):
    s = x @ w
    below = np.hstack([np.zeros((len(s), 1)), 1 / (1 + np.exp(-(cuts[None] - s[:, None]))), np.ones((len(s), 1))])
    i = np.arange(len(s))
    return -(each * np.log(np.maximum(below[i, grades + 1] - below[i, grades], 1e-12))).sum() + quality.PENALTY * np.abs(w).sum()


def test_ordinal_fit_comes_near_the_least_loss():
    """Within a twentieth of the same penalised likelihood minimised by coordinate search."""
    rng = random.Random(2)
    kinds = {0: "bad vile", 1: "dull poor bad", 2: "good fine dull"}
    rows = [(" ".join(rng.choices(kinds[g].split() + ["filler"], k=6)), g) for g in (0, 1, 2) for _ in range(40)]
    model = quality.fit(rows)
    ids = np.flatnonzero(model.weights)
    held = [{quality.feature_id(f) for f in quality.features(t)} for t, _ in rows]
    used = sorted(i for i in set().union(*held) if sum(i in own for own in held) >= quality.LEAST_DOCS)
    x = np.array([[float(i in own) for i in used] for own in held])
    grades = np.array([g for _, g in rows])
    each = 1 / (np.bincount(grades)[grades] * 3)
    w, cuts = model.weights[used].astype(float), model.thresholds.copy()
    assert set(ids) <= set(used) and (np.diff(cuts) >= 0).all()
    own = best = ordinal_loss(w, cuts, x, grades, each)
    assert model.tails(x @ w)[:, 0].tolist() == pytest.approx([model.tails(np.array([model.score(t, {})]))[0, 0] for t, _ in rows], rel=1e-5)
    for step in (0.5, 0.1, 0.02):
        for _ in range(30):
            for v in (w, cuts):
                for i in range(len(v)):
                    for d in (step, -step):
                        v[i] += d
                        if (got := ordinal_loss(w, cuts, x, grades, each)) < best:
                            best = got
                        else:
                            v[i] -= d
    assert own - best < 0.05 * own


def test_op6_grades_like_its_model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.training_sample(docs, labels))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = registry.queries()["op6_quality"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        s = sum(float(model.weights[quality.feature_id(f)]) for f in sorted(quality.features(texts[r["doc_id"]] or "")))
        t1, t2 = (1 / (1 + math.exp(-(s - c))) for c in model.thresholds)
        assert (r["p_not_toxic"], r["p_good"], r["expected_grade"]) == pytest.approx((t1, t2, t1 + t2), abs=1e-9)
        assert r["toxic"] == (r["p_not_toxic"] < quality.TOXIC_BELOW) and r["keep"] == (not r["toxic"] and r["p_good"] >= quality.KEPT_FROM)


def test_ann_scores_few_rows_of_structured_vectors(spark, monkeypatch):
    """Vectors near a curved surface of few dimensions: windows are narrow, and what they score is a small share of the table."""
    from quarrystone.llm import ann

    rng = np.random.default_rng(9)
    n = 12_000
    t = rng.random((n, 3)) * 3
    v = np.hstack([np.sin(t @ rng.normal(0, 1, (3, 40)) + rng.random(40)), 0.01 * rng.standard_normal((n, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    widths = []
    fitted = ann.fitted_width
    monkeypatch.setattr(ann, "fitted_width", lambda *a: widths.append(fitted(*a)) or widths[-1])
    rows = ann.search(df, F.col("id") % 200 == 0).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q in range(0, n, 200):
        s = u @ u[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hit / (n / 200 * 5) >= 0.9
    scored = ann.CURVES * (2 * widths[0] + 2 * 128)
    assert widths[0] < 64 and scored < 0.6 * n


def test_op7_recall_over_all_queries(spark, sf_dir):
    rows = registry.queries()["op7_ann"](spark, sf_dir).collect()
    data = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r["embedding"] is not None and any(r["embedding"])}
    ids = np.array(sorted(data))
    u = np.array([data[i] for i in ids.tolist()], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = total = 0
    for q in ids[ids % 50 == 0].tolist():
        s = u @ u[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        want = ids[np.lexsort((ids, -s))[:5]]
        got = [r for r in rows if r["query_id"] == q]
        assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
        hit, total = hit + len(set(want.tolist()) & {r["vec_id"] for r in got}), total + 5
    assert hit >= 0.9 * total
