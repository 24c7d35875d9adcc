"""The pipeline's stages on tables with nulls, ties, repeated rows, large ids, clashing names and rows that move between runs of a plan."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_brute_force import LOWER, fingerprint, linked, removed

import corpus_pipeline
from quarrystone.llm import common, mixing, suffixdedup

STAGES = dict(corpus_pipeline.STAGES)
BIG = 2**53 + 1
EXTRA = "id long, kept string, spans string, n_bytes long, copy string, __row long, __text string, __lang_id string, rid string, n int, ws string, h string, class string, q string, cell string, size string, draw string, `a.b` string, v array<long>"
ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture(scope="module")
def table(spark, sf_dir, tmp_path_factory):
    """A folder with documents and benchmark; half of the documents are special cases."""
    base = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("length(text) < 3000").limit(60).collect()]
    passage = base[0][1]
    rows = base + [
        (BIG, passage, "en", "a", None), (BIG - 1, passage + " and more of it", "en", "a", 1), (None, passage, None, None, None), (None, "Ein ganz anderer kurzer Text hier", "de", "a", 3),
        (7, None, "de", "b", 3), (8, "", None, "b", None), (9, " \t\n ", "xx", None, 2), (10, "12 34 ²½①", "de", "b", 1), (BIG, passage, "en", "a", None), (BIG + 1, "words before " + ITEM, "en", "c", 5), (BIG + 2, ITEM + " é" * 40, "en", "c", 5),
        (11, "x " + " ".join(f"w{i % 50}" for i in range(30_000)), "en", "c", 0),
    ]
    names = re.findall(r"(?:^|, )`?([^ `]+)`? ", EXTRA)
    more = lambda i: tuple([BIG + i, None, 2**62 + i][i % 3] if c in ("id", "n_bytes", "__row") else [BIG, None, i] if c == "v" else i if c == "n" else f"{c}{i}" for c in names)
    folder = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([r + more(i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "...")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def inputs(spark, table):
    """The input of each stage, read from Parquet."""
    found, docs = {}, spark.read.parquet(f"{table}/documents.parquet")
    for name, stage in STAGES.items():
        found[name] = docs
        stage(spark, docs, table).write.parquet(f"{table}/{name}")
        docs = spark.read.parquet(f"{table}/{name}")
    return found


def plain(rows, names=None):
    return Counter(repr(tuple(r[c] for c in (names or r.asDict()))) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_moving_rows_change_nothing(spark, table, inputs, name):
    """A shuffled input, whose rows have no fixed places, gives the same rows; those of one id and text may stand for each other."""
    docs, stage = inputs[name], STAGES[name]
    moved = docs.repartition("text").sortWithinPartitions(F.rand(3))
    names = ["doc_id", "text"] if name.startswith("SimHash") else None
    want, got = stage(spark, docs, table).collect(), stage(spark, moved, table).collect()
    assert plain(got, names) == plain(want, names) and want


@pytest.mark.parametrize("name", list(STAGES))
def test_other_columns_are_passed_on(spark, table, inputs, name):
    docs = inputs[name]
    own = [c for c in docs.columns if c not in ("text", "lang", "n_chars")]
    out = STAGES[name](spark, docs, table)
    assert out.columns == docs.columns + (["copy_"] if name == "mixing" else [])
    before = plain(docs.collect(), own)
    assert set(plain(out.collect(), own)) <= set(before)
    assert dict(out.dtypes) | dict(docs.dtypes) == dict(out.dtypes)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_and_all_null(spark, table, inputs, name):
    docs = inputs[name]
    assert STAGES[name](spark, docs.limit(0), table).count() == 0
    nulls = spark.createDataFrame([(None,) * len(docs.columns)] * 3, docs.schema)
    assert STAGES[name](spark, nulls, table).count() == {"SimHash near-dedup": 1, "benchmark decontamination": 3}.get(name, 0)


def test_language_id_drops_what_has_no_letter(spark, table, inputs):
    docs = inputs["language ID"]
    want = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert plain(STAGES["language ID"](spark, docs, table).collect(), ["id", "doc_id", "text"]) == plain(want, ["id", "doc_id", "text"])


def test_one_document_of_each_group_stays(spark, table, inputs):
    rows = spark.read.parquet(f"{table}/documents.parquet")  # with null and empty texts
    got = STAGES["SimHash near-dedup"](spark, rows, table).collect()
    rows = rows.collect()
    groups = linked({i: fingerprint(r["text"]) for i, r in enumerate(rows)})
    least = {}
    for i, r in enumerate(rows):
        least[groups[i]] = min(least.get(groups[i], (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == Counter(least.values())


def test_ids_and_columns_are_exact(spark, table, inputs):
    docs = inputs["suffix-array dedup"]
    rows = docs.collect()
    last = max(r["doc_id"] for r in rows if r["doc_id"] is not None) + 1
    keyed = [(r["doc_id"] if r["doc_id"] is not None else last, r["text"].encode()) for r in rows]
    left = Counter((None if i == last else i, b.decode("utf-8", "ignore")) for i, b in removed(keyed, 50) if b.decode("utf-8", "ignore").strip(" \t\n\v\f\r"))
    got = STAGES["suffix-array dedup"](spark, docs, table).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == left
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("frequent", [1, 3, 10**9])
def test_suffixdedup_with_large_ids_nulls_and_frequent_anchors(spark, frequent):
    common_line = "this very line is in every one of them, "
    docs = [(BIG - 1, common_line * 3), (BIG, common_line * 2 + "and ends here with something else that is long enough"), (None, "x" + common_line * 2), (BIG + 1, "é" * 10 + common_line + "é" * 60), (5, None), (BIG + 1, ""), (BIG + 2, "è" + "é" * 55)]
    docs += [(100 + i, f"{i * 7919 % 1000:03d} {common_line}{i * 104729 % 997} tail of {i}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["id"] if r["id"] is not None else 2**62, bytes(r["kept"])) for r in suffixdedup.dedup(df, group_bytes=300, frequent=frequent).collect())
    assert got == removed([(i if i is not None else 2**62, (t or "").encode()) for i, t in docs], 50)


def test_suffixdedup_runs_where_the_package_is_not_installed(spark, tmp_path):
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {__file__.rsplit("/tests/", 1)[0]!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from quarrystone.llm import suffixdedup
docs = spark.createDataFrame([(1, "a passage that is in both of these documents, word for word"), (2, "a passage that is in both of these documents, word for word")], "doc_id long, text string")
print(sorted((r["id"], len(r["kept"])) for r in suffixdedup.dedup(docs).collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "[(1, 59), (2, 0)]" in out.stdout, out.stderr[-2000:]


def contaminated(text, items):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    own, hit = ws(text), set()
    for item in map(ws, items):
        for win in {tuple(item[s : s + 13]) for s in range(max(1, len(item) - 12))} if item else ():
            for s in range(len(own) - len(win) + 1):
                if tuple(own[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
    return bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contaminated_documents_go(spark, table, inputs, monkeypatch, broadcast):
    from quarrystone.llm import decontam

    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_TEXTS", 0)
    docs = spark.read.parquet(f"{table}/documents.parquet")
    got = decontam.stage(spark, docs, table).collect()
    want = [r for r in docs.collect() if not contaminated(r["text"], [ITEM])]
    assert 0 < len(docs.collect()) - len(want) and plain(got, ["doc_id", "text", "id"]) == plain(want, ["doc_id", "text", "id"])


def test_mixing_takes_what_the_sql_takes(spark, table, inputs):
    docs = inputs["mixing"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{table}/benchmark decontamination/*.parquet'")
    taken = con.execute(f"SELECT doc_id, size, sum(taken) FROM ({mixing.ORACLE_SQL}) WHERE taken > 0 GROUP BY doc_id, size").fetchall()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    got = Counter()
    for r in STAGES["mixing"](spark, docs, table).collect():
        got[(r["doc_id"], size(r["text"]))] += size(r["text"])
    assert got == Counter({(i, n): t for i, n, t in taken})


def test_inclusion_follows_the_odds(spark):
    """Documents of another weight in one source are drawn with their own probability, in the order of odds over odds."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.array_join(F.array_repeat(F.lit("w"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(15), F.lit(200)), (F.col("id") % 4 + 1).cast("int"))), " ").alias("text"))
    rows = mixing.mix(docs, budget=0.4).groupBy("size").agg(F.avg("copies").alias("copies"), F.first("target").alias("t")).orderBy("size").collect()
    level = rows[0]["t"] / sum(7500 * r["size"] * r["size"].bit_length() for r in rows)
    for r in rows:
        assert r["copies"] == pytest.approx(level * r["size"].bit_length(), abs=0.02)
    assert rows[0]["copies"] < 0.08 < 0.4 < rows[-1]["copies"]


def test_classes_fill_up_to_the_most(spark):
    sizes = spark.createDataFrame([("a", 1, 10), ("a", 4, 1000), ("a", 9, 90), ("b", 0, 0), ("b", 3, 50), (None, 2, 5), ("c", 0, 0)], "source string, class int, words long")
    rows = mixing.classes(sizes).collect()
    for source in ("a", "b", None, "c"):
        own = [r for r in rows if r["source"] == source]
        words = {r["class"]: r["words"] for r in sizes.collect() if r["source"] == source}
        assert sum(r["times"] * words[r["class"]] for r in own) == pytest.approx(own[0]["target"])
        assert all(0 <= r["times"] <= 2 for r in own) and sorted(own, key=lambda r: r["class"]) == sorted(own, key=lambda r: (r["times"], r["class"]))


def test_stored_rows_keep_their_numbers(spark):
    df = spark.range(1000).repartition(5).withColumn("nothing", F.lit(None))
    kept = common.stored(df, "row")
    a, b = kept.select("id", "row").collect(), kept.select("row", "id", "nothing").collect()
    assert {r["id"]: r["row"] for r in a} == {r["id"]: r["row"] for r in b} and len({r["row"] for r in a}) == 1000


def test_what_a_stage_stores_goes_with_it(spark):
    from pathlib import Path

    def folders():
        return {p for p in Path(common.checkpoint_dir(spark).removeprefix("file:")).glob("rows-*")}

    before = folders()
    with common.temporary(spark):
        assert common.stored(spark.range(5), "row").count() == 5 and len(folders() - before) == 1
    assert folders() == before


def test_run_leaves_the_result_only(spark, table):
    from pathlib import Path

    top = Path(common.checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.glob("*-*"))
    out = corpus_pipeline.run(spark, table)
    made = [p for p in set(top.glob("pipeline-*")) - before]
    assert len(made) == 1 and [p.name for p in made[0].iterdir()] == ["4"] and set(top.glob("rows-*")) <= before and out.count() > 0
