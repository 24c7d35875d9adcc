"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import ann, decontam, html, langid, mixing, quality, simhash, suffixdedup, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 997}" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old mill by the river bank today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog near the old mill by the river bank today", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog near the old mill by the river bank today", "en", "a", 1),
    (3, "", None, None, None),
    (4, None, "de", "b", None),
    (None, "der schnelle braune fuchs springt immer wieder gern über den faulen hund", "de", "b", 7),
    (None, None, None, None, None),
    (5, LONG, "de", None, 3),
    (6, " \t\n 123 !!! ", "xx", "b", 3),
    (7, "der schnelle braune fuchs springt immer wieder gern über den faulen hund", "de", "c", 7),
]
#: Names the operators use inside.
CLASH = ["rid", "id", "ws", "n", "h", "g", "fp", "root", "component", "size", "draw", "target", "taken", "host", "path", "rule", "verdict", "lang_id", "kept", "spans", "blob", "key", "block", "rank", "score", "v"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, DOCS))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(10, "quick brown fox jumps over the lazy dog near the old mill by the river"), (11, "fuchs springt"), (12, None), (13, " ... "), (11, "fuchs springt"), (None, "faulen hund")], "item_id long, text string")


def by_text(rows, column):
    return {r["id"]: r[column] for r in rows}


def test_decontaminate(docs, bench):
    rows = decontam.decontaminate(docs, bench).collect()
    assert len(rows) == len(ROWS)
    got = {(r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows}
    assert {(1, 18, 15, ("10",)), (2, 18, 15, ("10",)), (3, 0, 0, ()), (4, 0, 0, ()), (None, 12, 4, ("11", "null")), (7, 12, 4, ("11", "null")), (5, 40000, 0, ())} <= got
    assert [tuple(s) for s in next(r for r in rows if r["id"] == 1)["spans"]] == [(1, 16)]
    assert [tuple(s) for s in next(r for r in rows if r["id"] == 7)["spans"]] == [(3, 5), (10, 12)]


def test_decontaminate_in_blocks(docs, bench):
    key = lambda rows: sorted(map(repr, rows))
    assert key(decontam.decontaminate(docs, bench, block_windows=1).collect()) == key(decontam.decontaminate(docs, bench).collect())


def test_decontaminate_empty(docs, bench):
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_langid(docs):
    model = langid.trained(docs)
    assert set(model.languages) <= {"de", "en"}
    rows = langid.predict(docs.drop("lang_id"), model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        no_letters = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_id"]["lang"] == "und") == no_letters and 0 <= r["lang_id"]["score"] <= 1


def test_langid_without_training(docs):
    model = langid.trained(docs.limit(0))
    assert {r["lang_id"]["lang"] for r in langid.predict(docs.drop("lang_id"), model).collect()} == {"und"}
    assert langid.predict(docs.limit(0).drop("lang_id"), model).count() == 0


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2) for r in rows)
    assert {r["size"] for r in rows if r["id"] in (3, 4)} == {0}
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.where("text is null")).collect()} == {0}


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["component"] for r in rows if r["id"] in (1, 2)} == {1}
    assert {r["component"] for r in rows if r["id"] in (3, 4)} == {3} and {r["fp"] for r in rows if r["id"] in (3, 4)} == {0}
    assert sum(r["component"] == 7 for r in rows) == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_suffixdedup(docs):
    rows = suffixdedup.dedup(docs, keep=("lang",)).collect()
    assert len(rows) == len(ROWS)
    kept = [(r["id"], bytes(r["kept"])) for r in rows]
    text = {r[0]: (r[1] or "").encode() for r in ROWS if r[0] is not None}
    assert (1, text[1]) in kept and kept.count((2, b"")) == 2 and (3, b"") in kept and (4, b"") in kept
    assert (7, text[7]) in kept and (None, b"") in kept, "a null id comes after all others"
    assert suffixdedup.dedup(docs.limit(0)).count() == 0


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (7, 0, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.training_sample(docs, labels))
    rows = quality.grade(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["quality"]["tail2"] <= r["quality"]["tail1"] <= 1 for r in rows)
    nothing = quality.fit([])
    assert quality.grade(docs, nothing).count() == len(ROWS) and quality.grade(docs.limit(0), model).count() == 0


PAGES = [
    (1, "http://a.example.com/en/7", "<p>x</p><a href='//b.org/'>y</a>"), (1, "http://a.example.com/en/7", "<p>x</p><a href='//b.org/'>y</a>"), (2, None, None), (3, "no scheme", ""),
    (4, "HTTP://B.ORG/es/1?q#f", "<a href=http://A.example.com/z>z</a>"), (None, "http://?x", "<<<>>> & <"), (5, "http://net", "<p>" + "long " * 50_000), (6, "http://x.com/en/", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


def test_extract(pages):
    rows = html.extract(pages.drop("text")).collect()
    assert len(rows) == len(PAGES)
    assert {r["text"] for r in rows if r["page_id"] in (2, 3, 6)} == {""}
    assert next(r["text"] for r in rows if r["page_id"] == 5) == " ".join(["long"] * 50_000)
    assert html.extract(pages.limit(0)).count() == 0


def test_urlfilter(pages):
    rows = urlfilter.judge(pages, keep=("page_id",), rounds=6).collect()
    assert len(rows) == len(PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[4] == ("b.org", "/es/1", "org/es/", "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[6] == ("x.com", "/en/", "com/en/", "block") and got[None][:2] == ("", "") and got[5] == ("net", "", None, "allow")
    assert urlfilter.judge(pages.limit(0), keep=("page_id",)).count() == 0


def test_warc(pages):
    rows = warc.derive_pages(pages).collect()
    assert len(rows) == 2 * len(PAGES)
    assert warc.derive_pages(pages.limit(0)).count() == 0
    assert {r["target_uri"] for r in rows if r["key"] == 2} == {None}


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (100, None)]
    df = clashing(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    rows = ann.search(df, F.col("id") % 50 == 0).collect()
    got = {q: [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100)}
    assert got == {0: [1, 50, 8, 2], 50: [0, 1, 8, 2], 100: []}
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
