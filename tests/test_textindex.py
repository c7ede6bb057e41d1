"""The text index on disk: scores, early termination, segments, pruned reads; and searches over a built corpus."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.corpus import Corpus
from quillspark.operators.index import bm25
from quillspark.operators.textindex import TextIndex
from quillspark.storage import KeyedTable

WORDS = [f"w{i}" for i in range(40)]


def texts(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[: 3 + i % 38]) for _ in range(rnd.randrange(1, 120)))) for i in range(n)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = texts(900, 1)
    docs = spark.createDataFrame(rows, "dense_id long, docs string")
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), {"docs": 1.0}, buckets=4, block=8, direct=0)
    for segment, condition in (("first", "dense_id < 600"), ("second", "dense_id >= 600")):
        index.add(docs.where(condition).select(F.col("dense_id").alias("id"), X.prose_tokens("docs").alias("docs")), segment)
    return index, docs


def full(docs, terms):
    rows = bm25(docs, X.prose_tokens("docs"), terms, ["dense_id"]).collect()
    return sorted(((r.dense_id, round(r.score, 9), r.matched) for r in rows), key=lambda r: (-r[1], r[0]))


def test_scores_equal_a_scan(built):
    index, docs = built
    for terms in (["w1"], ["w1", "w7", "w39"], ["w39", "nowhere"]):
        assert sorted((r.id, round(r.score, 9), r.matched) for r in index.score(terms).collect()) == sorted(full(docs, terms))
    assert index.score(["nowhere"]).count() == 0 and index.score([]).count() == 0
    assert index.count() == 900


@pytest.mark.parametrize("terms,k", [(["w1"], 10), (["w38"], 25), (["w2", "w30"], 15), (["w5", "w20", "w35"], 40), (["w39"], 5000)])
def test_pool_is_the_top_of_all(built, terms, k):
    index, docs = built
    report = {}
    got = [r.id for r in index.pool(terms, k, report=report).collect()]
    assert got == [r[0] for r in full(docs, terms)[:k]]
    assert report["scored"] <= report["blocks"]
    strict = [r.id for r in index.pool(terms, k, strict=True).collect()]
    assert strict == [r[0] for r in full(docs, terms) if r[2] == len(terms)][:k]


def test_blocks_are_skipped(built):
    index, _ = built
    report = {}
    index.pool(["w38"], 3, report=report).collect()
    assert report["scored"] < report["blocks"] / 2


def test_ties_by_id(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["same", "word"]) for i in range(300)], "id long, docs array<string>")
    index = TextIndex(spark, str(tmp_path), {"docs": 1.0}, buckets=2, block=4, direct=0)
    index.add(docs, "a")
    assert [r.id for r in index.pool(["same"], 7).collect()] == list(range(7))


def test_a_segment_leaves_others_alone(spark, built):
    index, _ = built
    folder = f"{index.root}/postings/segment=first"
    before = index.postings.files.state(f"{folder}/bucket=0")
    assert index.segments() == ["first", "second"]
    with pytest.raises(ValueError, match="there already"):
        index.add(spark.createDataFrame([], "id long, docs array<string>"), "first")
    assert index.postings.files.state(f"{folder}/bucket=0") == before


def test_uncommitted_segments_are_not_read(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "key", 3)
    table.write(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"), "one")
    table.write(spark.createDataFrame([("a", 3)], "key string, v int"), "two")
    table.files.delete(f"{tmp_path}/_commits/two")
    assert [(r.key, r.v) for r in table.read(["a"]).collect()] == [("a", 1)]
    table.write(spark.createDataFrame([("a", 4)], "key string, v int"), "two")
    assert sorted(r.v for r in table.read(["a"]).collect()) == [1, 4]
    assert table.read(["zz"]) is None or table.read(["zz"]).count() == 0


def test_reads_open_their_buckets_only(built):
    index, _ = built
    plan = index.postings.read(["w1"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w1)" in plan or "In(term, [w1])" in plan
    assert len(index.postings.read(["w1"]).inputFiles()) < len(index.postings.read().inputFiles())
    header = index.headers.read(["w1"])
    assert "ids" not in header.columns


def test_empty_texts_and_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, []), (3, ["a", "a", "b"])], "id long, docs array<string>")
    index = TextIndex(spark, str(tmp_path), {"docs": 1.0}, buckets=2)
    index.add(docs, "s")
    assert index.count() == 3 and [r.id for r in index.pool(["a"], 5).collect()] == [3]


def test_several_fields(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["red"], ["blue"]), (2, ["blue"], ["red", "red"]), (3, ["green"], ["x"])], "id long, name array<string>, docs array<string>")
    index = TextIndex(spark, str(tmp_path), {"name": 4.0, "docs": 1.0}, buckets=2)
    index.add(docs, "s")
    got = {r.id: r for r in index.score(["red", "blue"]).collect()}
    assert set(got) == {1, 2} and got[1].matched == 2 and got[1].score > 0
    assert [r.id for r in index.search(["red", "green"], 10).orderBy("id").collect()] == [1, 2, 3]


def test_corpus_in_two_segments(spark, tmp_path):
    """Symbols, words and texts of both segments are found; caps hold over all of them."""
    rows = [(i, "rustdoc", "struct", f"Thing{i % 3}", None, f"m::Thing{i % 3}", "m", f"text of number{i}", "", None, f"h{i}") for i in range(90)]
    records = spark.createDataFrame(rows, "dense_id long, source string, kind string, name string, owner string, full_path string, module string, docs string, signature string, source_ref string, hash string")
    corpus = Corpus(spark, str(tmp_path), records, buckets=4)
    corpus.add(records.where("dense_id < 45"), "a")
    corpus.add(records.where("dense_id >= 45"), "b")
    assert sorted(r.dense_id for r in corpus.lookup("Thing1").collect()) == list(range(1, 90, 3))
    assert [r.dense_id for r in corpus.search("number77 text").collect()][0] == 77
    assert corpus.search("").count() == 0
