"""Edit-distance, interval and nearest-earlier joins, places, closures and feature checks against plain programs."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import versions as V
from quillspark.operators import compat as C
from quillspark.operators import features as G
from quillspark.operators import intervals as N
from quillspark.operators import ordinal as O
from quillspark.operators import similar as S
from quillspark.operators import systems as Y
from quillspark.plans import releases


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_near_names(spark, k):
    rnd = random.Random(k)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 13, 20])))
    names = {word() for _ in range(150)}
    queries = {""}
    for _ in range(80):
        w = list(rnd.choice(sorted(names)))
        for _ in range(rnd.randrange(5)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randrange(2)] = rnd.choice(["", "c", "b"])
        queries.add("".join(w))
    rows = lambda x, c: spark.createDataFrame([(v,) for v in [*x, *list(x)[:9], None]], f"{c} string")
    out = S.near(rows(queries, "query"), rows(names, "name"), k)
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    assert sorted(map(tuple, out.collect())) == sorted((q, n, distance(q, n)) for q in queries for n in names if distance(q, n) <= k)


@pytest.mark.parametrize("cells", [2, 8, 500])
def test_interval_join(spark, cells):
    rnd = random.Random(cells)
    some = [None, *range(60), 7, 7, 7]
    points = [(i, rnd.choice(some)) for i in range(200)]
    spans = [(i, rnd.choice(some), rnd.choice(some)) for i in range(80)]
    out = N.interval_join(spark.createDataFrame(points, "i long, at long"), "at", spark.createDataFrame(spans, "j long, lo long, hi long"), "lo", "hi", cells=cells)
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    expected = [(i, j) for i, a in points for j, lo, hi in spans if a is not None and lo is not None and lo <= a and (hi is None or a < hi)]
    assert sorted((r.i, r.j) for r in out.collect()) == sorted(expected)
    assert N.interval_join(spark.createDataFrame([], "i long, at long"), "at", spark.createDataFrame(spans, "j long, lo long, hi long"), "lo", "hi").count() == 0


def test_interval_join_of_versions(spark):
    versions = ["0.1.0", "0.19.2", "0.20.0", "0.20.3", "1.0.0", "1.4000000.0", "junk", None]
    requirements = ["^0.20", "*", "~1", ">=0.1", "1.x", "0.19.2", None]
    got = {(r.version, r.requires) for r in C.range_join(spark.createDataFrame([(v,) for v in versions], "version string"), spark.createDataFrame([(r,) for r in requirements], "requires string")).collect()}
    pairs = spark.createDataFrame([(v, r) for v in versions for r in requirements], "version string, requires string")
    assert got == {(r.version, r.requires) for r in pairs.where(V.satisfies("version", "requires")).collect()}


def test_nearest_earlier(spark):
    rnd = random.Random(4)
    left = [(i, rnd.choice([None, "a", "a", "a", "b", "c"]), rnd.choice([None, *range(50)])) for i in range(500)]
    right = [(rnd.choice(["a", "a", "b", "d", None]), rnd.choice([None, *range(50)]), rnd.randrange(1000)) for _ in range(70)]
    out = N.asof_join(spark.createDataFrame(left, "i long, k string, t long").repartition(5), spark.createDataFrame(right, "k string, t long, v long"), ["k"], "t", ["v"])

    def best(k, t):
        found = [(b, v) for a, b, v in right if a == k and None not in (a, b, t) and b <= t]
        return max(found)[1] if found else None

    assert sorted((r.i, r.v) for r in out.collect()) == sorted((i, best(k, t)) for i, k, t in left)


@pytest.fixture
def narrow(spark):
    """Small reads, so that a shuffle of one megabyte keeps several partitions."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_nearest_earlier_over_several_ranges(spark, narrow):
    left = spark.range(20_000).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("t"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    right = spark.range(3_000).select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).alias("k"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).alias("t"), F.col("id").alias("v"))
    got = {r.id: r.v for r in N.asof_join(left.repartition(8), right.repartition(8), ["k"], "t", ["v"]).select("id", "v").collect()}
    pairs = left.alias("l").join(right.alias("r"), "k").where("r.t <= l.t").groupBy("id").agg(F.max_by("v", F.struct("r.t", "v")).alias("v"))
    expected = {r.id: r.v for r in left.select("id").join(pairs, "id", "left").collect()}
    assert len(got) == 20_000 and got == expected


def test_fallback(spark):
    have = spark.createDataFrame([(v,) for v in ("0.20.0", "0.20.1", "0.19.9", "1.0.0-rc.1", "0.20.1+b")], "version string")
    asked = spark.createDataFrame([(v,) for v in ("0.20.0", "0.20.7", "0.19.0", "1.0.3", "2.0.0", None)], "wanted string")
    got = {r.wanted: r.version for r in C.fallback(asked, have).collect()}
    assert got == {"0.20.0": "0.20.0", "0.20.7": "0.20.1+b", "0.19.0": "0.19.9", "1.0.3": "1.0.0-rc.1", "2.0.0": None, None: None}


def test_fallback_over_several_ranges(spark, narrow):
    have = spark.range(900).select(F.concat_ws(".", (F.col("id") % 3).cast("string"), (F.col("id") % 30).cast("string"), F.floor(F.col("id") / 90).cast("string")).alias("version"))
    asked = spark.range(20_000).select("id", F.concat_ws(".", (F.col("id") % 3).cast("string"), (F.col("id") % 37).cast("string"), F.lit("77")).alias("wanted"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    got = {r.id: r.version for r in C.fallback(asked.repartition(8), have.repartition(8)).select("id", "version").collect()}
    newest = {}
    for v in (tuple(map(int, r.version.split("."))) for r in have.collect()):
        newest[v[:2]] = max(v, newest.get(v[:2], v))
    show = lambda v: v and ".".join(map(str, v))
    assert len(got) == 20_000 and got == {i: show(newest.get((i % 3, i % 37))) for i in range(20_000)}


def test_fallback_of_requests_without_a_line(spark):
    have = spark.createDataFrame([(v,) for v in ("0.0.3", "0.0.6-rc.1", "0.5.1", "junk")], "version string")
    wanted = ["0.-5.2", "-1.0.3", "-1.-6.-7", "junk", "trash", "", "0", "null.0.null", "0.null.4", "0.5.-2", "0.0.9"]
    got = {r.wanted: r.version for r in C.fallback(spark.createDataFrame([(w,) for w in wanted], "wanted string"), have).collect()}
    assert got == dict.fromkeys(wanted) | {"junk": "junk", "0.5.-2": "0.5.1", "0.0.9": "0.0.6-rc.1"}


def test_version_fallback_of_odd_keys_equals_sql(spark, tmp_path):
    """Keys without a value and below zero, on both sides."""
    duckdb = pytest.importorskip("duckdb")
    hole = lambda value, k: F.when(F.col("id") % k > 0, value)
    orders = spark.range(3000).select(hole(F.col("id") - 1000, 53).alias("o_orderkey"), hole(F.col("id") * 7 % 3000 - 1500, 31).alias("o_custkey"))
    part = spark.range(900).select(hole(F.col("id") - 300, 37).alias("p_partkey"), F.lit("x").alias("p_name"), hole((F.col("id") % 50).cast("int"), 41).alias("p_size"))
    con = duckdb.connect()
    for name, rows in (("orders", orders), ("part", part)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in releases.version_fallback(spark, str(tmp_path)).select("o_orderkey", "wanted", "version").collect()]
    assert sorted(got, key=repr) == sorted(con.execute(releases.SQL["version_fallback"]).fetchall(), key=repr)


def test_newest_release_of_equal_numbers(spark):
    vers = ["0.2.0", "0.2.0+b5", "0.2.0+a", "0.1.9+z", "0.3.0-rc.1", "0.3.0-rc.1+b", "0.3.0-rc.0"]
    for rows in (vers, vers[::-1]):
        got = C.newest_release(spark.createDataFrame([("x", v, False) for v in rows], "name string, vers string, yanked boolean").coalesce(1)).first()
        assert (got.stable, got.preview) == ("0.2.0+b5", "0.3.0-rc.1+b")


def test_places_stay_under_repartitioning(spark):
    rows = spark.range(500).withColumn("k", F.pmod(F.hash("id"), F.lit(40)))
    order = sorted((r.k, r.id) for r in rows.collect())
    for n in (1, 3, 11):
        got = [(r.k, r.id) for r in O.dense_ids(rows.repartition(n), ["k", "id"], "place").orderBy("place").collect()]
        assert got == order
    assert O.dense_ids(rows.where("false"), ["k"], "place").count() == 0
    two = O.in_order([rows.limit(3).select("id"), rows.select("id").where("id < 2")], ["id"])
    assert [r.dense_id for r in two.orderBy("dense_id").collect()] == list(range(5))


def test_project_closure(spark):
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    name = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    features = frame([("default", "ui"), ("ui", "ui"), ("ui", "render"), ("render", "ui"), ("x", "y")])
    got = {r.name: (r.depth, r.rule) for r in G.project_closure(features, frame([("ui", "fast"), ("ui", "render")]), frame([("fast", "simd"), ("simd", "fast")]), name("z"), name("ui")).collect()}
    assert got == {"z": (0, "explicit"), "ui": (0, "default"), "default": (0, "default"), "render": (1, "feature"), "fast": (1, "profile"), "simd": (2, "vendored")}
    assert {r.name for r in G.project_closure(features, frame([]), frame([]), name("x")).collect()} == {"x", "y"}
    states = {r.name: r.state for r in G.report(name("a", "b", "c"), name("a", "zz"), name("a", "b", "zz")).collect()}
    assert states == {"a": "explicit", "b": "transitive", "c": "disabled", "zz": "unknown"}


def test_feature_rules_in_order(spark):
    name = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    crates = spark.createDataFrame([("e_a", False, []), ("e_b", True, []), ("e_c", True, ["on", "off"]), ("e_d", True, ["off"])], "crate string, optional boolean, features array<string>")
    gates = spark.createDataFrame([(1, "UiPlugin", "off"), (2, "Ui", "on")], "ord long, plugin string, requires_feature string")
    asked = spark.createDataFrame([(q,) for q in ("DefaultPlugins", "MinimalPlugins", "on", "off", "ui", "e::a::X", "e::b", "e::c", "e::d", "e::zz", "e::ui", "e::Bad", "UiPluginOfMine", "iPlu", "nobody", None)], "query string")
    known, enabled = name("on", "off", "e_ui", "default"), name("on", "e_ui")
    got = {r.query: (r.rule, r.gating_feature, r.available) for r in G.check(asked, known, enabled, crates, gates, "e").collect()}
    assert got == {
        "DefaultPlugins": ("plugin group", "default", False), "MinimalPlugins": ("plugin group", None, True), "on": ("feature", None, True), "off": ("feature", None, False), "ui": ("prefixed feature", "e_ui", True),
        "e::a::X": ("sub-crate", None, True), "e::b": ("sub-crate", None, None), "e::c": ("sub-crate", "on", True), "e::d": ("sub-crate", "off", False), "e::zz": ("sub-crate", None, None), "e::ui": ("sub-crate", "e_ui", True),
        "e::Bad": ("unrecognised", None, False), "UiPluginOfMine": ("plugin", "off", False), "iPlu": ("plugin", "off", False), "nobody": ("unrecognised", None, False),
    }
    open_ = {r.query: r.available for r in G.check(asked, known, enabled, crates, gates, "e", resolved=False).collect()}
    assert open_["off"] is None and open_["iPlu"] is None and open_["on"] and open_["nobody"] is False


def test_conflicts_send_no_side_through_the_driver(spark):
    code = "fn a(x: Query<&mut C, Without<T>>, y: Query<&C>, z: Query<&C, Or<(With<T>, With<T>)>>, r: Res<R>, s: ResMut<R>, w: &mut World) {}"
    out = Y.conflicts(Y.extract(spark.createDataFrame([(code,), ("no code",), (None,)], "code string"), "code"))
    got = sorted((r.rule, r.name, r.owner_a, r.owner_b, r.code) for r in out.collect())
    assert got == [("R1", "C", 0, 1, "B0001"), ("R3", "R", 3, 4, "B0002"), *(("R5", "World", 5, k, "B0002") for k in range(5))]
    assert "Broadcast" not in plan(out)


def test_messages(spark):
    d = spark.createDataFrame([("error[B0002]: ResMut<A<B<C<D<E>>>>> here",), ("B0001 Res<X",), ("B0001 Res<>",), (None,)], "m string")
    got = [r.e for r in d.select(Y.parse_error("m").alias("e")).collect()]
    assert got[0].resource_type == "A<B<C<D<E>>>>" and got[1].resource_type is None and got[2].resource_type is None
    guide = spark.createDataFrame([("# T\nx\n### fix no\n## Solutions\n body \n## Next\ny",), ("no section",)], "t string")
    assert [r.g for r in guide.select(Y.short_guide("t").alias("g")).collect()] == ["body", "no section"]
