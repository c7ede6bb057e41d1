import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import uri as U
from quillspark.functions import versions as V


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(column("v").alias("x")).collect()
    return [r.x for r in rows]


def test_norm_key_at_any_depth(spark):
    deep = "A<B<C<D<E<F<G<H<i>>>>>>>>::run"
    assert one(spark, X.norm_key, deep, "A :: <B>::c()", "a<b") == ["a::run", "a::c", "a"]
    assert [X.py_norm_key(v) for v in (deep, "A :: <B>::c()", "a<b")] == ["a::run", "a::c", "a"]


def test_norm_key(spark):
    values = ["Vec<T>::new()", "a::B<C<D>>::e", "::Core Name", "Iter::<Item>::next", "A -> B", "x<y>z>", "open<never"]
    expected = ["vec::new", "a::b::e", "corename", "iter::next", "a->b", "xz", "open"]
    assert one(spark, X.norm_key, *values) == expected
    assert [X.py_norm_key(v) for v in values] == expected


def test_name_tokens(spark):
    values = ["HTTPServer", "Camera2dBundles", "snake_case_names", "EventReader", "Ünï", ""]
    expected = [["http", "server"], ["camera", "2d", "bundle"], ["snake", "case", "name"], ["event", "reader"]]
    assert one(spark, X.name_tokens, *values)[:4] == expected
    assert [X.py_name_tokens(v) for v in values[:4]] == expected


def test_singular(spark):
    words = ["entities", "ties", "classes", "boxes", "bus", "glass", "systems", "as", "quizzes"]
    got = one(spark, X.singular, *words)
    assert got == [X.py_singular(w) for w in words] == ["entity", "tie", "classe", "box", "bus", "glass", "system", "as", "quizz"]


def test_query_terms(spark):
    q = "How do I spawn the ECS Systems_x with Camera2d?"
    assert one(spark, X.query_terms, q)[0] == X.py_query_terms(q)
    assert "how" not in X.py_query_terms(q) and "spawn" in X.py_query_terms(q) and "spawn" not in X.py_subjects(q)


def test_bytes_are_cut_between_characters(spark):
    assert one(spark, lambda c: X.truncate_bytes(c, 4), "abé€", "abcd", "ééé") == ["abé", "abcd", "éé"]


@pytest.mark.parametrize("requirement,version,expected", [("^0.20.0", "0.20.5", True), ("^0.0.3", "0.0.4", False), ("~1.2", "1.2.9", True), ("0.20.0", "0.20.1", False), ("0.20", "0.20.1", True), (">=1", "2.0.0", None), ("*", "9.9.9", True), ("1.*", "1.5.0", True), ("=1.0.0", "1.0.0", None), ("^1.0.0-rc.1", "1.0.0", None), ("0.20.X", "0.20.7", True), ("x", "3.0.0", True), ("~1", "1.9.0", True)])
def test_requirements(spark, requirement, version, expected):
    row = spark.createDataFrame([(requirement, version)], "r string, v string").select(V.satisfies("v", "r").alias("x")).first()
    assert row.x is expected


def test_uri_round_trip(spark):
    values = ["a b+c%~*é/:", "plain-_.~", ""]
    d = spark.createDataFrame([(v,) for v in values], "v string").select(U.encode("v").alias("e"), U.decode(U.encode("v")).alias("d")).collect()
    assert [r.d for r in d] == values
    assert d[0].e == "a%20b%2Bc%25~%2A%C3%A9%2F%3A" and d[1].e == values[1]
    u = spark.createDataFrame([("docs://api/0.20/a%3A%3Ab?cursor=x:5",)], "v string").select(U.parse("v").alias("u")).first().u
    assert (u.label, u.version, u.value, u.cursor) == ("api", "0.20", "a::b", "x:5")


def test_common_prefix(spark):
    d = spark.createDataFrame([("abc", "abd"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r.x for r in d.select(X.common_prefix("a", "b").alias("x")).collect()] == [2, 0, 4]
    assert d.select(F.size(X.prose_tokens(F.lit("Ça va, l'été!"))).alias("n")).first().n == 4


def test_names_of_folders_files_and_addresses(spark):
    df = spark.createDataFrame([("0-43-1", "B0004.md", "Query<A>"), ("main-1", "B004.md", "two words"), ("a b/c", "b0004.md", "a b::c"), ("---", "B0004.md\n", ""), (None, None, None)], "v string, f string, q string")
    got = df.select(V.display("v"), V.directory_name("v"), X.is_error_page("f"), X.is_symbol("q")).collect()
    assert [tuple(r) for r in got] == [("0.43.1", "0-43-1", True, True), ("main-1", "main-1", False, False), ("a b/c", "a_b_c", False, True), ("---", "---", False, False), (None, None, None, None)]
    names = spark.createDataFrame([("a",), ("Ab",), ("abc",), ("Serde",), ("",)], "n string")
    assert [r[0].removeprefix("https://index.crates.io/") for r in names.select(V.index_address("n")).collect()] == ["1/a", "2/ab", "3/a/abc", "se/rd/serde", ""]
    at = spark.createDataFrame([("2024-01-01T00:00:00+02:00",), ("2024-01-09T00:00:00Z",), ("2024-01-01",), ("2024-13-01T00:00:00Z",)], "t string")
    assert [r[0] for r in at.select(V.age_days("t", F.lit("2024-01-03T00:00:00Z").cast("timestamp"))).collect()] == [2, 0, None, None]
