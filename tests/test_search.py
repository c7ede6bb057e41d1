import pytest
from pyspark.sql import functions as F

from quillspark.operators import features as G
from quillspark.operators import index as I
from quillspark.operators import listing as L
from quillspark.operators import search as S
from quillspark.operators.corpus import Corpus

SCHEMA = "dense_id long, source string, kind string, name string, owner string, full_path string, module string, docs string, signature string, source_ref string, hash string"


def records(spark):
    rows = [
        (0, "rustdoc", "struct", "Event", "", "core::event::Event", "core::event", "An event of the ecs event system.", "struct Event", "", "h0"),
        (1, "rustdoc", "trait", "System", "", "core::system::System", "core::system", "System ordering and running.", "trait System", "", "h1"),
        (2, "rustdoc", "struct", "Commands", "", "core::system::Commands", "core::system", "Queue to spawn entities.", "struct Commands", "", "h2"),
        (3, "rustdoc", "method", "spawn", "Commands", "core::system::Commands::spawn", "core::system", "Spawns.", "fn spawn(&mut self, bundle: B)", "", "h3"),
        (4, "website", "news", "Systems", "", "news::systems", "news", "system ordering system ordering", "", "", "h4"),
        (5, "rustdoc", "field", "0", "Event", "core::event::Event::0", "core::event", "system", "", "", "h5"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = Corpus(spark, str(tmp_path_factory.mktemp("corpus")), records(spark), buckets=4)
    c.add(records(spark), "all")
    return c


@pytest.mark.parametrize("query,first", [("ECS event system", 0), ("system ordering", 1), ("commands spawn", 2), ("Commands::spawn", 3)])
def test_ranking(corpus, query, first):
    got = corpus.search(query).collect()
    assert got[0].dense_id == first
    assert 5 not in [g.dense_id for g in got]


def test_lookup_and_indexes(spark, corpus):
    r = I.drop_tuple_fields(records(spark))
    assert r.count() == 5
    assert [x.dense_id for x in corpus.lookup("core::system::Commands<T>").collect()] == [2]
    assert corpus.lookup("core::system::Commands").first().score == 1100.0
    assert corpus.lookup("commands").first().score == 1000.0
    assert not I.token_index(r).where("dense_id = 4").count()


def test_equal_definitions_collapse_by_the_rounded_score(spark, corpus, monkeypatch):
    noisy = spark.createDataFrame([(0, 5.0), (1, 5.000000000001), (4, 7.0)], "dense_id long, score double")
    monkeypatch.setattr("quillspark.operators.corpus.merge", lambda text, names: noisy)
    assert [r.dense_id for r in corpus.search("ordering", key=["source"]).collect()] == [4, 0]


def test_no_record_of_a_common_word_or_key_is_left_out(spark, tmp_path):
    """Equal records beyond the postings' caps of old (1,000 a word, 60 a key) score like the first ones."""
    same = spark.range(1100).select(F.col("id").alias("dense_id"), *(F.lit(v).alias(c) for c, v in (("source", "rustdoc"), ("kind", "struct"), ("name", "BlueGear"), ("owner", ""), ("full_path", "a::BlueGear"), ("module", "a"), ("docs", "A gear."), ("signature", "struct BlueGear"), ("source_ref", ""), ("hash", ""))))
    c = Corpus(spark, str(tmp_path), same, buckets=2)
    c.add(same, "all")
    for query in ("gear handling", "BlueGear"):
        got = c.search(query, limit=2000)
        assert got.count() == 1100 and got.select("score").distinct().count() == 1, query
    assert c.lookup("BlueGear").count() == 60


def test_suggestions(spark):
    assert S.suggestions(records(spark), "Comands").first().dense_id == 2
    assert S.suggestions(records(spark), "EventSystem").first().dense_id == 1
    assert not S.suggestions(records(spark), "xy").count()


def test_filters(spark):
    r = records(spark)
    assert {x.dense_id for x in r.where(S.passes(kind="struct", module="CORE")).collect()} == {0, 2}


def test_dedup_merge_rules(spark):
    rows = spark.createDataFrame([("k", 0, "a", "", None), ("k", 1, "longer", "sig", None), ("k", 2, "equal!", "other", "ref")], "id string, ord int, docs string, signature string, source_ref string")
    rows = rows.withColumnRenamed("id", "key").withColumn("source", F.lit("s"))
    m = I.dedup_merge(rows, "key", "ord", ["source"], "docs", {"signature": "", "source_ref": "null"}).first()
    assert (m.docs, m.signature, m.source_ref, m.copies) == ("longer", "sig", "ref", 3)
    with pytest.raises(Exception, match="share the id"):
        clash = spark.createDataFrame([("k", 0, "d", "a"), ("k", 1, "d", "b")], "key string, ord int, docs string, source string")
        I.dedup_merge(clash, "key", "ord", ["source"], "docs", {}).collect()


def test_closure_terminates_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "name string")
    assert {r.name for r in G.closure(edges, seeds).collect()} == {"a", "b", "c"}
    assert {(r.src, r.dst) for r in G.closures(edges).collect()} == {("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("x", "y")}


def test_pages(spark):
    r = spark.range(7).withColumnRenamed("id", "dense_id")
    rows, cursor = L.page(r, "q", None, 5)
    assert [x.dense_id for x in rows.collect()] == [0, 1, 2, 3, 4]
    rows, end = L.page(r, "q", cursor, 5)
    assert [x.dense_id for x in rows.collect()] == [5, 6] and end is None
    assert L.page(r, "q", cursor.replace(":5", ":7"), 5)[0].count() == 0
    for bad in (cursor.replace(":5", ":8"), "other:5"):
        with pytest.raises(ValueError):
            L.page(r, "q", bad, 5)


def test_fields_examples_order(spark):
    rows = spark.createDataFrame([("k", 0, ["a", "a"]), ("k", 1, ["a", "b"])], "key string, o int, examples array<string>")
    assert I.merge_examples(rows, "key", "o").first().examples == ["a", "a", "b"]
