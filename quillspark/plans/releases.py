"""Queries on versions, requirements, migrations, features and listings. Versions, releases, guides and feature edges are made
from the keys of the tables, in Spark and in SQL alike, so that the work grows with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import uri as U
from ..functions import versions as V
from ..operators import compat as C
from ..operators import features as G
from ..operators import intervals as N
from ..operators import listing as L
from ..operators import ordinal as O
from ..sources import records as R

QUERIES, SQL = {}, {}
PARTS = R.PARTS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


PART = lambda c, i: f"coalesce(try_cast(list_extract(string_split(split_part(split_part({c}, '+', 1), '-', 1), '.'), {i}) AS BIGINT), 0)"
CORE = lambda c: f"row({PART(c, 1)}, {PART(c, 2)}, {PART(c, 3)})"

# A version of each part: some with a pre-release or a build.
VERSION_SQL = "(p_partkey % 2) || '.' || (p_partkey % 23) || '.' || (p_size % 7) || CASE p_partkey % 17 WHEN 0 THEN '-rc.1' WHEN 1 THEN '+b5' ELSE '' END"
VERSIONS_SQL = f"(SELECT DISTINCT {VERSION_SQL} AS version FROM part)"
# A requirement of each order: every mark, full and short, and some that nothing understands.
REQUIREMENT_SQL = """SELECT o_orderkey, o_orderkey % 15 AS mark, o_orderkey % 2 AS a, o_orderkey % 23 AS b, o_orderkey % 7 AS c,
  CASE o_orderkey % 15 WHEN 0 THEN '^' || a || '.' || b || '.' || c WHEN 1 THEN '^' || a || '.' || b WHEN 2 THEN '^' || a WHEN 3 THEN '~' || a || '.' || b || '.' || c WHEN 4 THEN '~' || a || '.' || b
  WHEN 5 THEN '~' || a WHEN 6 THEN a || '.' || b || '.' || c WHEN 7 THEN a || '.' || b WHEN 8 THEN CAST(a AS VARCHAR) WHEN 9 THEN '*' WHEN 10 THEN a || '.' || b || '.*' WHEN 11 THEN a || '.x'
  WHEN 12 THEN '>=' || a || '.' || b || '.' || c WHEN 13 THEN 'junk' ELSE '^' || a || '.' || b || '.' || c || '-rc.1' END AS requires FROM orders"""
RANGES_SQL = f"""(SELECT DISTINCT requires, CASE WHEN mark IN (0, 3, 6) THEN row(a, b, c) WHEN mark IN (1, 4, 7, 10) THEN row(a, b, 0) WHEN mark IN (2, 5, 8, 11) THEN row(a, 0, 0) WHEN mark = 9 THEN row(0, 0, 0) END AS lo,
  CASE WHEN mark = 6 THEN row(a, b, c + 1) WHEN mark IN (3, 4, 10) THEN row(a, b + 1, 0) WHEN mark IN (2, 5, 8, 11) THEN row(a + 1, 0, 0)
  WHEN mark IN (1, 7) THEN CASE WHEN a > 0 THEN row(a + 1, 0, 0) ELSE row(0, b + 1, 0) END
  WHEN mark = 0 THEN CASE WHEN a > 0 THEN row(a + 1, 0, 0) WHEN b > 0 THEN row(0, b + 1, 0) ELSE row(0, 0, c + 1) END END AS hi FROM ({REQUIREMENT_SQL}))"""


def dotted(*numbers):
    """The numbers with dots between; null if one is null, as with SQL's ||."""
    return F.concat(numbers[0], *(x for n in numbers[1:] for x in (F.lit("."), n)))


def versions(spark, sf):
    """p_partkey and a version of every part."""
    suffix = F.when(F.col("p_partkey") % 17 == 0, "-rc.1").when(F.col("p_partkey") % 17 == 1, "+b5").otherwise("")
    numbers = dotted(F.col("p_partkey") % 2, F.col("p_partkey") % 23, F.col("p_size") % 7)
    return R.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.concat(numbers, suffix).alias("version"))


def requirements(spark, sf):
    key = F.col("o_orderkey")
    a, b, c = key % 2, key % 23, key % 7
    shapes = ["^{a}.{b}.{c}", "^{a}.{b}", "^{a}", "~{a}.{b}.{c}", "~{a}.{b}", "~{a}", "{a}.{b}.{c}", "{a}.{b}", "{a}", "*", "{a}.{b}.*", "{a}.x", ">={a}.{b}.{c}", "junk", "^{a}.{b}.{c}-rc.1"]
    text = F.element_at(F.array(*map(F.lit, shapes)), (key % 15 + 1).cast("int"))
    for name, value in (("a", a), ("b", b), ("c", c)):
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    return R.table(spark, sf, "orders").select("o_orderkey", "o_custkey", text.alias("requires"))


@query(f"SELECT version, CAST(row_number() OVER (ORDER BY {CORE('version')}, version) - 1 AS BIGINT) AS place FROM {VERSIONS_SQL}")
def version_sort(spark, sf):
    """Places of all versions in version order, by ranges and not in one window."""
    v = versions(spark, sf).select("version").distinct().withColumn("core", V.core("version"))
    return O.dense_ids(v, ["core", "version"], "place").select("version", "place")


STEP_SQL = f"""SELECT o_orderkey, (o_orderkey % 2) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 3) AS old, (o_custkey % 3) || '.' || (o_custkey % 5) || '.' || (o_custkey % 2) AS new FROM orders"""


@query(f"""SELECT o_orderkey, old, new, CASE WHEN x = y THEN 'none' WHEN x > y THEN 'downgrade' WHEN x[1] <> y[1] THEN 'major' WHEN x[2] <> y[2] THEN 'minor' ELSE 'patch' END AS level,
 CASE WHEN x = y THEN false WHEN x > y THEN true WHEN x[1] <> y[1] THEN true WHEN x[2] <> y[2] THEN x[1] = 0 ELSE false END AS breaks_api,
 CASE WHEN x = y THEN 'same' WHEN x > y THEN 'downgrade' ELSE 'upgrade' END AS direction FROM (SELECT *, CAST(string_split(old, '.') AS INTEGER[]) AS x, CAST(string_split(new, '.') AS INTEGER[]) AS y FROM ({STEP_SQL}))""")
def version_bump(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    steps = R.table(spark, sf, "orders").select("o_orderkey", F.format_string("%d.%d.%d", o % 2, o % 5, o % 3).alias("old"), F.format_string("%d.%d.%d", c % 3, c % 5, c % 2).alias("new"))
    return steps.withColumn("b", V.bump("old", "new")).select("o_orderkey", "old", "new", "b.level", "b.breaks_api", "b.direction")


@query(f"""WITH installed AS (SELECT DISTINCT {VERSION_SQL} AS version FROM part WHERE p_partkey % 3 = 0),
lines AS (SELECT *, {PART('version', 1)} AS a, {PART('version', 2)} AS b, {PART('version', 3)} AS c FROM installed),
newest AS (SELECT a, b, c, max(version) AS version FROM lines GROUP BY a, b, c),
asked AS (SELECT o_orderkey, (o_orderkey % 2) || '.' || (o_custkey % 29) || '.' || (o_orderkey % 9) AS wanted, o_orderkey % 2 AS a, o_custkey % 29 AS b, CAST(1000000 AS BIGINT) AS c FROM orders)
SELECT o_orderkey, wanted, coalesce(i.version, n.version) AS version FROM asked q ASOF LEFT JOIN newest n ON q.a = n.a AND q.b = n.b AND q.c >= n.c LEFT JOIN installed i ON i.version = q.wanted""")
def version_fallback(spark, sf):
    """The installed version that answers each order's: its own, else the newest of its minor line."""
    asked = R.table(spark, sf, "orders").select("o_orderkey", dotted(F.col("o_orderkey") % 2, F.col("o_custkey") % 29, F.col("o_orderkey") % 9).alias("wanted"))
    return C.fallback(asked, versions(spark, sf).where("p_partkey % 3 = 0")).select("o_orderkey", "wanted", "version")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events), o AS (SELECT o_custkey, o_orderdate + to_days(CAST(9600 - o_orderkey % 500 AS INTEGER)) AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.at""")
def asof_orders(spark, sf):
    """The last order of an event's user before it: the general nearest-earlier join, hot users and all."""
    shifted = F.expr("o_orderdate + make_dt_interval(int(9600 - o_orderkey % 500))")
    orders = R.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), shifted.alias("ts"), "o_orderkey")
    return N.asof_join(R.table(spark, sf, "events").select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


@query(f"""WITH v AS (SELECT *, {PART('version', 1)} AS a, {PART('version', 2)} AS b, {PART('version', 3)} AS c FROM {VERSIONS_SQL}), top AS (SELECT a AS x, b AS y, c AS z FROM v ORDER BY a DESC, b DESC, c DESC LIMIT 1)
SELECT version, CASE WHEN a = x AND b = y AND c = z THEN 'none' WHEN row(x, y, z) > row(a, b, c) THEN 'downgrade' WHEN a <> x THEN 'major' WHEN b <> y THEN 'minor' ELSE 'patch' END AS relative FROM v, top""")
def versions_table(spark, sf):
    """Every version against the newest one."""
    v = versions(spark, sf).select("version").distinct()
    top = v.agg(F.max_by("version", V.core("version")).alias("active"))  # one row
    return v.crossJoin(F.broadcast(top)).select("version", V.bump("active", "version")["level"].alias("relative"))


SHOW = lambda c: f"CASE WHEN {c} IS NOT NULL THEN {c}[1] || '.' || {c}[2] || '.' || {c}[3] END"


@query(f"SELECT requires, {SHOW('lo')} AS lo, {SHOW('hi')} AS hi FROM {RANGES_SQL}")
def parse_requirement(spark, sf):
    d = requirements(spark, sf).select("requires").distinct().withColumn("p", V.requirement("requires"))
    show = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(".", *(F.col(f"{c}.{x}").cast("string") for x in ("major", "minor", "patch"))))
    return d.select("requires", show("p.lo").alias("lo"), show("p.hi").alias("hi"))


@query(f"SELECT version, requires FROM {RANGES_SQL} JOIN {VERSIONS_SQL} ON {CORE('version')} >= lo AND (hi IS NULL OR {CORE('version')} < hi)")
def range_compat(spark, sf):
    return C.range_join(versions(spark, sf), requirements(spark, sf))


COMPAT_SQL = f"SELECT 'plugin' || o_custkey AS plugin, (o_orderkey % 3) || '.' || (o_orderkey % 11) || '.' || o_orderkey AS plugin_version, requires, o_orderkey AS ord FROM ({REQUIREMENT_SQL}) JOIN orders USING (o_orderkey)"
ASKED_SQL = "SELECT DISTINCT 'plugin' || l_orderkey // 10 AS plugin, CASE WHEN l_partkey % 9 > 0 THEN (l_partkey % 2) || '.' || (l_partkey % 23) || '.' || (l_linenumber % 7) END AS version FROM lineitem"


@query(f"""WITH j AS (SELECT plugin, version, plugin_version, ord, CASE WHEN lo IS NULL OR version IS NULL THEN NULL ELSE {CORE('version')} >= lo AND (hi IS NULL OR {CORE('version')} < hi) END AS ok
  FROM ({COMPAT_SQL}) JOIN ({ASKED_SQL}) USING (plugin) JOIN {RANGES_SQL} USING (requires))
SELECT plugin, version, CASE WHEN bool_or(ok) THEN true WHEN bool_or(ok IS NULL) THEN NULL ELSE false END AS compatible, arg_max(plugin_version, row({PART('plugin_version', 1)}, {PART('plugin_version', 2)}, {PART('plugin_version', 3)})) AS newest,
 arg_max(plugin_version, row({PART('plugin_version', 1)}, {PART('plugin_version', 2)}, {PART('plugin_version', 3)})) FILTER (ok) AS newest_matching, coalesce(string_agg(plugin_version, ',' ORDER BY ord) FILTER (ok), '') AS matching FROM j GROUP BY plugin, version""")
def compat_matrix(spark, sf):
    """Verdict, newest and matching releases for each question of the line items about a plugin and a version."""
    key = F.col("o_orderkey")
    compat = requirements(spark, sf).select(F.concat(F.lit("plugin"), F.col("o_custkey")).alias("plugin"), F.format_string("%d.%d.%d", key % 3, key % 11, key).alias("plugin_version"), "requires", key.alias("ord"))
    wanted = F.when(F.col("l_partkey") % 9 > 0, F.format_string("%d.%d.%d", F.col("l_partkey") % 2, F.col("l_partkey") % 23, F.col("l_linenumber") % 7))
    asked = R.table(spark, sf, "lineitem").select(F.concat(F.lit("plugin"), F.expr("l_orderkey div 10")).alias("plugin"), wanted.alias("version"))
    return C.matrix(asked, compat)


ITEMS_SQL = f"SELECT p_name AS symbol, {VERSION_SQL} AS version, lower(p_type) AS kind, 'fn ' || replace(p_name, ' ', '_') || '(' || repeat('x', CAST(p_size % 3 AS INTEGER)) || ')' AS signature, p_brand AS docs, p_partkey AS ord FROM part"


@query(f"""WITH items AS ({ITEMS_SQL}), asked AS (SELECT symbol, version FROM (SELECT DISTINCT p_name AS symbol FROM part), (SELECT unnest(['1.1.1', '0.0.0', '1.21.3', '1.3.5', '0.8.2', '0.22.1', '1.7.0', '1.22.6']) AS version)),
best AS (SELECT symbol, version, arg_min(kind, ord) AS kind, arg_min(signature, ord) AS signature, CAST(arg_min(length(docs), ord) AS INTEGER) AS docs_chars FROM items GROUP BY ALL),
base AS (SELECT symbol, arg_max(signature, {CORE('version')}) FILTER (version = '1.22.6') AS base FROM best GROUP BY symbol)
SELECT symbol, version, kind IS NOT NULL AS found, kind, signature, docs_chars, CASE WHEN kind IS NULL THEN '-' WHEN base IS NULL THEN 'only here' WHEN base = signature THEN 'same' ELSE 'changed' END AS vs_newest
FROM asked LEFT JOIN best USING (symbol, version) LEFT JOIN base USING (symbol)""")
def api_diff(spark, sf):
    """Every name in eight versions, each against the newest of the eight."""
    signature = F.concat(F.lit("fn "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.expr("repeat('x', int(p_size % 3))"), F.lit(")"))
    items = R.table(spark, sf, "part").join(versions(spark, sf).select("p_partkey", "version"), "p_partkey").select(F.col("p_name").alias("symbol"), "version", F.lower("p_type").alias("kind"), signature.alias("signature"), F.col("p_brand").alias("docs"), F.col("p_partkey").alias("ord"))
    asked = items.select("symbol").distinct().withColumn("version", F.explode(F.array(*map(F.lit, ["1.1.1", "0.0.0", "1.21.3", "1.3.5", "0.8.2", "0.22.1", "1.7.0", "1.22.6"]))))
    return C.api_diff(asked, items)


INDEX_SQL = f"SELECT 'crate' || p_partkey % 150 AS name, {VERSION_SQL} AS vers, p_partkey % 5 = 0 AS yanked FROM part"


@query(f"""WITH r AS (SELECT *, {CORE('vers')} AS core FROM ({INDEX_SQL}) WHERE NOT yanked),
s AS (SELECT name, max(struct_pack(core := core, vers := vers)) FILTER (NOT contains(vers, '-')) AS stable, max(struct_pack(core := core, vers := vers)) FILTER (contains(vers, '-')) AS p FROM r GROUP BY name)
SELECT name, stable.vers AS stable, CASE WHEN stable IS NULL OR p.core > stable.core THEN p.vers END AS preview FROM s""")
def newest_release(spark, sf):
    p = versions(spark, sf)
    return C.newest_release(p.select(F.concat(F.lit("crate"), F.col("p_partkey") % 150).alias("name"), F.col("version").alias("vers"), (F.col("p_partkey") % 5 == 0).alias("yanked")))


@query(f"""SELECT name, vers, '^1' AS requires, CAST(ord AS INTEGER) AS ord FROM (SELECT name, vers, row_number() OVER (PARTITION BY name ORDER BY {CORE('vers')} DESC, vers) AS ord
 FROM (SELECT 'part' || p_size % 5 AS name, '0.' || p_partkey % 70 || '.' || p_partkey % 7 AS vers FROM part GROUP BY 1, 2)) WHERE ord <= 24""")
def release_topn(spark, sf):
    p = R.table(spark, sf, "part").select(F.concat(F.lit("part"), (F.col("p_size") % 5).cast("string")).alias("name"), F.format_string("0.%d.%d", F.col("p_partkey") % 70, F.col("p_partkey") % 7).alias("vers")).distinct()
    deps = F.array(F.struct(F.lit("core_math").alias("name"), F.lit("^1").alias("req")))
    return C.top_releases(p.withColumns({"yanked": F.lit(False), "deps": deps}), "core")


DECISION_SQL = """SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN '0.' || o_custkey % 4 || '.' || o_orderkey % 3 END AS installed, CASE WHEN o_orderkey % 11 > 0 THEN '0.' || o_orderkey % 4 || '.' || o_custkey % 3 END AS available,
  CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 3 END AS installed_revision, CASE WHEN o_custkey % 6 > 0 THEN o_orderkey % 3 END AS available_revision, o_orderkey % 13 = 0 AS offline, CASE WHEN o_orderkey % 17 = 0 THEN 'timed out' END AS error FROM orders"""


@query(f"""SELECT o_orderkey, reason, CASE WHEN reason IN ('missing', 'corpus', 'revision') THEN true WHEN reason IN ('installed_newer', 'current') THEN false END AS update_available FROM (SELECT *,
  CASE WHEN offline THEN 'offline' WHEN error IS NOT NULL THEN 'network_error' WHEN available IS NULL THEN 'unavailable' WHEN installed IS NULL THEN 'missing' WHEN {CORE('installed')} < {CORE('available')} THEN 'corpus'
  WHEN {CORE('installed')} > {CORE('available')} THEN 'installed_newer' WHEN installed_revision IS NULL OR available_revision IS NULL THEN 'revision_unknown' WHEN installed_revision < available_revision THEN 'revision' ELSE 'current' END AS reason FROM ({DECISION_SQL}))""")
def release_decision(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = R.table(spark, sf, "orders").select(
        "o_orderkey", F.when(c % 7 > 0, F.format_string("0.%d.%d", c % 4, o % 3)).alias("installed"), F.when(o % 11 > 0, F.format_string("0.%d.%d", o % 4, c % 3)).alias("available"),
        F.when(o % 6 > 0, c % 3).alias("installed_revision"), F.when(c % 6 > 0, o % 3).alias("available_revision"), (o % 13 == 0).alias("offline"), F.when(o % 17 == 0, "timed out").alias("error"),
    )
    return C.release_decision(d).select("o_orderkey", "reason", "update_available")


# Guides, entries and notes with the documents' texts; two words of the corpus as the topic.
GUIDES_SQL = """(SELECT doc_id AS dense_id, ['migration_guide', 'migration_entry', 'release_notes', 'guide'][doc_id % 4 + 1] AS kind, 'g' || doc_id % 97 AS full_path, '0.' || doc_id % 5 || '.0' AS from_version, '0.' || doc_id % 7 || '.0' AS to_version,
  '0.' || doc_id % 6 || '.' || doc_id % 3 AS version, source AS title, substr(split_part(text, chr(10), 1), 1, 60) AS heading, text AS docs FROM documents)"""
MINOR = lambda c: f"CAST(split_part({c}, '.', 2) AS INTEGER)"
BASE_SQL = f"""CASE WHEN kind = 'migration_guide' THEN CASE WHEN {MINOR('from_version')} = 2 AND {MINOR('to_version')} = 4 THEN 100 WHEN {MINOR('to_version')} = 4 THEN 90
 WHEN 2 <= {MINOR('from_version')} AND {MINOR('from_version')} < {MINOR('to_version')} AND {MINOR('to_version')} <= 4 THEN 80 WHEN {MINOR('from_version')} = 2 THEN 70 END
 WHEN kind = 'migration_entry' AND {MINOR('version')} = 4 THEN 50 WHEN kind = 'release_notes' AND {MINOR('version')} = 4 THEN 45 END"""
HEAD = "lower(title || ' ' || heading || ' ' || heading)"
HAS = lambda text, word: f"CASE WHEN contains({text}, '{word}') THEN 1 ELSE 0 END"
TOPIC_SQL = f"""CAST(CASE WHEN contains({HEAD}, 'the and') THEN 40 WHEN contains({HEAD}, 'the') AND contains({HEAD}, 'and') THEN 30 ELSE 8 * ({HAS(HEAD, 'the')} + {HAS(HEAD, 'and')}) END
 + CASE WHEN contains(lower(docs), 'the and') THEN 4 ELSE {HAS('lower(docs)', 'the')} + {HAS('lower(docs)', 'and')} END AS INTEGER)"""


def guides(spark, sf):
    key = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ["migration_guide", "migration_entry", "release_notes", "guide"])), (key % 4 + 1).cast("int"))
    heading = F.substring(F.substring_index("text", "\n", 1), 1, 60)
    return R.table(spark, sf, "documents").select(
        key.alias("dense_id"), kind.alias("kind"), F.concat(F.lit("g"), key % 97).alias("full_path"), F.format_string("0.%d.0", key % 5).alias("from_version"), F.format_string("0.%d.0", key % 7).alias("to_version"),
        F.format_string("0.%d.%d", key % 6, key % 3).alias("version"), F.col("source").alias("title"), heading.alias("heading"), F.array(heading).alias("breadcrumb"), F.col("text").alias("docs"),
    )


@query(f"""WITH t AS (SELECT *, {BASE_SQL} AS base, {TOPIC_SQL} AS topic FROM {GUIDES_SQL}), a AS (SELECT * FROM t WHERE base IS NOT NULL), b AS (SELECT max(topic) AS best FROM a),
r AS (SELECT dense_id, base + topic AS score, row_number() OVER (PARTITION BY full_path ORDER BY base + topic DESC, dense_id) AS n FROM a, b WHERE topic > 0 AND (best < 20 OR topic >= 20))
SELECT dense_id, CAST(score AS INTEGER) AS score FROM r WHERE n <= 2""")
def migrations(spark, sf):
    """Guides, entries and notes for the step from 0.2 to 0.4 on a topic, at most two of a document."""
    return C.migrations(guides(spark, sf), "0.2.0", "0.4.0", ["the", "and"], 2).select("dense_id", F.col("score").cast("int").alias("score"))


@query(f"SELECT dense_id FROM {GUIDES_SQL} WHERE 1 <= {MINOR('from_version')} AND {MINOR('from_version')} < {MINOR('to_version')} AND {MINOR('to_version')} <= 5")
def migration_range(spark, sf):
    return guides(spark, sf).where(C.in_range("0.1.0", "0.5.0")).select("dense_id")


@query(f"SELECT dense_id, {TOPIC_SQL} AS topic FROM {GUIDES_SQL}")
def topic_score(spark, sf):
    return guides(spark, sf).select("dense_id", C.topic_score(["the", "and"]).alias("topic"))


# Feature edges: nations, suppliers and customers; some features enable themselves, some each other.
EDGES_SQL = """(SELECT 'f' || n_nationkey AS src, 'f' || (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT 'f' || s_nationkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0
  UNION SELECT 's' || s_suppkey, 's' || s_suppkey // 3 FROM supplier UNION SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)"""
PROFILES_SQL = "(SELECT DISTINCT 'f' || c_nationkey AS src, 'p' || lower(c_mktsegment) AS dst FROM customer WHERE c_custkey % 9 = 0)"
VENDORED_SQL = "(SELECT DISTINCT 'p' || lower(c_mktsegment) AS src, 'v' || c_custkey % 50 AS dst FROM customer WHERE c_nationkey = 3)"
SEEDS_SQL = "(SELECT 'f' || r_regionkey AS name FROM region WHERE r_regionkey < 2)"
REACH = f"r AS (SELECT name FROM {SEEDS_SQL} UNION SELECT dst FROM r JOIN {EDGES_SQL} e ON r.name = e.src)"


def edges(spark, sf):
    n, s = R.table(spark, sf, "nation"), R.table(spark, sf, "supplier")
    named = lambda letter, c: F.concat(F.lit(letter), F.expr(c).cast("string"))
    parts = [
        n.select(named("f", "n_nationkey").alias("src"), named("f", "(n_nationkey * 7 + 3) % 25").alias("dst")),
        s.where("s_suppkey % 3 = 0").select(named("f", "s_nationkey"), named("s", "s_suppkey")),
        s.select(named("s", "s_suppkey"), named("s", "s_suppkey div 3")),
        s.where("s_suppkey % 10 = 0").select(named("s", "s_suppkey"), named("s", "s_suppkey")),
    ]
    return reduce(lambda a, b: a.union(b), parts).distinct()


def profiles(spark, sf):
    c = R.table(spark, sf, "customer")
    segment = F.concat(F.lit("p"), F.lower("c_mktsegment"))
    mine = c.where("c_custkey % 9 = 0").select(F.concat(F.lit("f"), "c_nationkey").alias("src"), segment.alias("dst")).distinct()
    vendored = c.where("c_nationkey = 3").select(segment.alias("src"), F.concat(F.lit("v"), F.col("c_custkey") % 50).alias("dst")).distinct()
    return mine, vendored


def seeds(spark, sf):
    return R.table(spark, sf, "region").where("r_regionkey < 2").select(F.concat(F.lit("f"), "r_regionkey").alias("name"))


@query(f"WITH RECURSIVE {REACH} SELECT name FROM r")
def feature_closure(spark, sf):
    return G.closure(edges(spark, sf), seeds(spark, sf))


@query(f"""WITH RECURSIVE every AS (SELECT src, dst, 'feature' AS rule FROM {EDGES_SQL} UNION ALL SELECT src, dst, 'profile' FROM {PROFILES_SQL} UNION ALL SELECT src, dst, 'vendored' FROM {VENDORED_SQL}),
start AS (SELECT name FROM {SEEDS_SQL} UNION SELECT 'f9' UNION SELECT 'default'),
r AS (SELECT name, 0 AS depth FROM start UNION SELECT e.dst, r.depth + 1 FROM r JOIN every e ON r.name = e.src WHERE r.depth < 200),
d AS (SELECT name, min(depth) AS depth FROM r GROUP BY name),
via AS (SELECT e.dst AS name, min(CASE rule WHEN 'feature' THEN 1 WHEN 'profile' THEN 2 ELSE 3 END) AS via FROM d JOIN every e ON d.name = e.src JOIN d t ON t.name = e.dst WHERE t.depth = d.depth + 1 GROUP BY e.dst)
SELECT d.name, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN CASE WHEN d.name IN (SELECT name FROM {SEEDS_SQL}) THEN 'explicit' ELSE 'default' END ELSE ['feature', 'profile', 'vendored'][via] END AS rule FROM d LEFT JOIN via USING (name)""")
def project_closure(spark, sf):
    """The fixpoint over features, profiles and vendored closures at once, from explicit features and defaults."""
    mine, vendored = profiles(spark, sf)
    defaults = frame(spark, [("f9",)], "name string")
    return G.project_closure(edges(spark, sf), mine, vendored, seeds(spark, sf), defaults).select("name", "depth", "rule")


@query(f"WITH RECURSIVE p AS (SELECT src, dst FROM {EDGES_SQL} UNION SELECT p.src, e.dst FROM p JOIN {EDGES_SQL} e ON p.dst = e.src) SELECT DISTINCT src, dst FROM p WHERE src <> dst")
def feature_closures(spark, sf):
    return G.closures(edges(spark, sf))


KNOWN_SQL = f"(SELECT src AS name FROM {EDGES_SQL} UNION SELECT dst FROM {EDGES_SQL})"


@query(f"WITH RECURSIVE {REACH} SELECT name FROM {KNOWN_SQL} WHERE name NOT IN (SELECT name FROM r)")
def features_disabled(spark, sf):
    e = edges(spark, sf)
    return G.disabled(e.select(F.explode(F.array("src", "dst")).alias("name")), G.closure(e, seeds(spark, sf)))


@query(f"""WITH RECURSIVE {REACH} SELECT name, CASE WHEN name IN (SELECT name FROM {SEEDS_SQL}) THEN 'explicit' WHEN name IN (SELECT name FROM r) THEN 'transitive' ELSE 'disabled' END AS state FROM {KNOWN_SQL}""")
def feature_report(spark, sf):
    e = edges(spark, sf)
    return G.report(e.select(F.explode(F.array("src", "dst")).alias("name")), seeds(spark, sf), G.closure(e, seeds(spark, sf)))


# Queries about features: groups, features, prefixed ones, paths of sub-crates, plugins and nonsense, from the suppliers' keys.
CHECK_SQL = """(SELECT DISTINCT CASE s_suppkey % 8 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN CAST(s_suppkey % 7 AS VARCHAR) WHEN 2 THEN 'x::' || s_suppkey % 9 || '::Thing' WHEN 3 THEN 'Plugin' || s_suppkey || 'More' WHEN 4 THEN 'lugin1'
  WHEN 5 THEN 'nothing ' || s_suppkey WHEN 6 THEN 'x::q' || s_suppkey ELSE ['DefaultPlugins', 'MinimalPlugins'][s_suppkey % 2 + 1] END AS query FROM supplier)"""


@query(f"""WITH RECURSIVE {REACH}, more AS (SELECT name FROM {KNOWN_SQL} UNION SELECT 'x_' || r_regionkey FROM region UNION SELECT 'default'), enabled AS (SELECT name FROM r UNION SELECT 'x_1'),
crates AS (SELECT 'x_' || n_nationkey AS crate, n_nationkey % 2 = 0 AS optional, CASE WHEN n_nationkey = 6 THEN [] WHEN n_nationkey = 4 THEN ['s1', 'f0'] ELSE ['s999', 's998'] END AS features FROM nation WHERE n_nationkey BETWEEN 3 AND 8),
gates AS (SELECT s_suppkey AS ord, 'Plugin' || s_suppkey AS plugin, 'f' || s_nationkey AS gate FROM supplier),
q AS (SELECT query, CASE WHEN regexp_full_match(query, 'x::[a-z0-9_]+(::.*)?') THEN 'x_' || regexp_extract(query, '^x::([a-z0-9_]+)', 1) END AS crate FROM {CHECK_SQL}),
p AS (SELECT query, min(ord) AS ord FROM q JOIN gates ON contains(plugin, query) OR contains(query, plugin) GROUP BY query)
SELECT query, CASE WHEN query IN ('DefaultPlugins', 'MinimalPlugins') THEN 'plugin group' WHEN query IN (SELECT name FROM more) THEN 'feature' WHEN 'x_' || query IN (SELECT name FROM more) THEN 'prefixed feature'
    WHEN q.crate IS NOT NULL THEN 'sub-crate' WHEN plugin IS NOT NULL THEN 'plugin' ELSE 'unrecognised' END AS rule,
  CASE WHEN query IN ('DefaultPlugins', 'MinimalPlugins') THEN query WHEN query IN (SELECT name FROM more) THEN query WHEN 'x_' || query IN (SELECT name FROM more) THEN 'x_' || query WHEN q.crate IS NOT NULL THEN q.crate ELSE plugin END AS name,
  CASE WHEN query = 'DefaultPlugins' THEN 'default' WHEN query = 'MinimalPlugins' OR query IN (SELECT name FROM more) THEN NULL WHEN 'x_' || query IN (SELECT name FROM more) THEN 'x_' || query
    WHEN q.crate IS NOT NULL THEN CASE WHEN optional THEN features[1] WHEN optional IS NULL AND q.crate IN (SELECT name FROM more) THEN q.crate END ELSE gate END AS gating_feature,
  CASE WHEN query = 'DefaultPlugins' THEN 'default' IN (SELECT name FROM enabled) WHEN query = 'MinimalPlugins' THEN true WHEN query IN (SELECT name FROM more) THEN query IN (SELECT name FROM enabled)
    WHEN 'x_' || query IN (SELECT name FROM more) THEN 'x_' || query IN (SELECT name FROM enabled)
    WHEN q.crate IS NOT NULL THEN CASE WHEN NOT optional THEN true WHEN optional AND len(features) = 0 THEN NULL WHEN optional THEN features[1] IN (SELECT name FROM enabled) OR features[2] IN (SELECT name FROM enabled)
      WHEN q.crate IN (SELECT name FROM more) THEN q.crate IN (SELECT name FROM enabled) END
    WHEN plugin IS NOT NULL THEN gate IN (SELECT name FROM enabled) ELSE false END AS available
FROM q LEFT JOIN crates ON q.crate = crates.crate LEFT JOIN p USING (query) LEFT JOIN gates USING (ord)""")
def feature_check(spark, sf):
    """What each name depends on, and whether it is on, by the ordered rules."""
    s, n, key = R.table(spark, sf, "supplier"), R.table(spark, sf, "nation"), F.col("s_suppkey")
    text = key.cast("string")
    q = [text, (key % 7).cast("string"), F.concat(F.lit("x::"), key % 9, F.lit("::Thing")), F.concat(F.lit("Plugin"), text, F.lit("More")), F.lit("lugin1"), F.concat(F.lit("nothing "), text), F.concat(F.lit("x::q"), text)]
    groups = F.element_at(F.array(F.lit("DefaultPlugins"), F.lit("MinimalPlugins")), (key % 2 + 1).cast("int"))
    asked = s.select(F.element_at(F.array(F.concat(F.lit("s"), q[0]), *q[1:], groups), (key % 8 + 1).cast("int")).alias("query"))
    e = edges(spark, sf)
    extra = R.table(spark, sf, "region").select(F.concat(F.lit("x_"), "r_regionkey").alias("name"))
    known = e.select(F.explode(F.array("src", "dst")).alias("name")).unionByName(extra).unionByName(frame(spark, [("default",)], "name string"))
    on = G.closure(e, seeds(spark, sf)).unionByName(frame(spark, [("x_1",)], "name string"))
    needs = F.when(F.col("n_nationkey") == 6, F.array().cast("array<string>")).when(F.col("n_nationkey") == 4, F.array(F.lit("s1"), F.lit("f0"))).otherwise(F.array(F.lit("s999"), F.lit("s998")))
    crates = n.where("n_nationkey BETWEEN 3 AND 8").select(F.concat(F.lit("x_"), "n_nationkey").alias("crate"), (F.col("n_nationkey") % 2 == 0).alias("optional"), needs.alias("features"))
    gates = s.select(key.alias("ord"), F.concat(F.lit("Plugin"), text).alias("plugin"), F.concat(F.lit("f"), "s_nationkey").alias("requires_feature"))
    return G.check(asked, known, on, crates, gates, "x")


@query(f"SELECT dense_id, name FROM {PARTS} ORDER BY dense_id LIMIT 50 OFFSET 100")
def paged_listing(spark, sf):
    import hashlib

    mark = hashlib.sha256(b"module/1/part").hexdigest()[:16]
    return L.read(R.parts(spark, sf), f"docs://module/1/part?cursor={mark}:100")[0].select("dense_id", "name")


@query(f"SELECT value, count(*) OVER () AS total FROM (SELECT DISTINCT name AS value FROM {PARTS} WHERE lower(name) LIKE 're%') ORDER BY value LIMIT 100")
def complete_prefix(spark, sf):
    return L.complete(R.parts(spark, sf), "name", "RE")


@query(f"SELECT dense_id FROM {PARTS} WHERE full_path = 'Brand#17::RedWidget' ORDER BY dense_id LIMIT 1")
def api_by_path(spark, sf):
    return L.read(R.parts(spark, sf), "docs://api/1/Brand%2317%3A%3ARedWidget")[0].select("dense_id")


def _listing(name: str, label: str, value: str, where: str):
    def run(spark, sf):
        p = R.parts(spark, sf).withColumns({"source_ref": F.concat(F.lit("https://docs.rs/"), F.lower("owner"), F.lit("/1.0")), "crate_name": F.lit(""), "file": F.concat("kind", F.lit(".html"))})
        return p.where(L.matches(label, value)).select("dense_id")

    run.__name__ = name
    query(f"SELECT dense_id FROM {PARTS} WHERE {where}")(run)


_listing("listing_kind", "kind", "standard", "kind = 'standard'")
_listing("listing_module", "module", "par", "module LIKE 'par%'")
_listing("listing_crate", "crate", "brand#7", "lower(owner) = 'brand#7'")
_listing("listing_owner", "owner", "Brand#7", "owner = 'Brand#7'")
_listing("listing_doc", "doc", "economy.html", "kind = 'economy'")


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS label FROM pages WHERE contains(split_part(url, '://', 2), '/')")
def parse_uri(spark, sf):
    p = R.table(spark, sf, "pages").withColumn("u", U.parse(F.regexp_replace("url", "#.*$", "")))
    return p.where("u.label IS NOT NULL").select("page_id", "u.scheme", "u.label")


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26').replace('#', '%23') AS encoded, url AS decoded FROM pages")
def uri_codec(spark, sf):
    p = R.table(spark, sf, "pages").withColumn("encoded", U.encode("url"))
    return p.select("page_id", "encoded", U.decode("encoded").alias("decoded"))


@query("""
SELECT p_partkey AS id, regexp_replace(p_name || '/' || p_brand || '+' || p_partkey, '[^A-Za-z0-9._+-]', '_', 'g') AS directory,
  (p_partkey % 3) || '.' || (p_partkey % 50) || '.' || (p_partkey % 7) AS numeric, p_brand || '-' || p_partkey AS other
FROM part""")
def version_directories(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_brand")
    key = lambda n: (F.col("p_partkey") % n).cast("string")
    return p.select(
        F.col("p_partkey").alias("id"),
        V.directory_name(F.concat("p_name", F.lit("/"), "p_brand", F.lit("+"), F.col("p_partkey").cast("string"))).alias("directory"),
        V.display(F.concat_ws("-", key(3), key(50), key(7))).alias("numeric"),
        V.display(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("other"),
    )


@query("""
WITH n AS (SELECT p_partkey AS id, lower(left(replace(p_name, ' ', '-'), CAST(p_partkey % 6 AS INTEGER))) AS name FROM part)
SELECT id, 'https://index.crates.io/' || list_aggregate(list_filter(
  CASE length(name) WHEN 0 THEN [] WHEN 1 THEN ['1', name] WHEN 2 THEN ['2', name] WHEN 3 THEN ['3', name[1], name] ELSE [name[1:2], name[3:4], name] END, lambda x: true), 'string_agg', '/') AS address
FROM n WHERE name <> '' UNION ALL SELECT id, 'https://index.crates.io/' FROM n WHERE name = ''""")
def index_addresses(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    name = F.initcap(F.expr("left(replace(p_name, ' ', '-'), int(p_partkey % 6))"))
    return p.select(F.col("p_partkey").alias("id"), V.index_address(name).alias("address"))


@query("""
WITH q AS (SELECT p_partkey AS id, unnest([p_name, ' ' || p_brand || ' ', p_name || '::' || p_type, '']) AS query FROM part)
SELECT id, query, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) = 1 OR position('::' IN query) > 0 AS symbol FROM q""")
def symbol_shape(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    texts = F.array("p_name", F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.concat("p_name", F.lit("::"), "p_type"), F.lit(""))
    return p.select(F.col("p_partkey").alias("id"), F.explode(texts).alias("query")).withColumn("symbol", X.is_symbol("query"))


@query("""
WITH f AS (SELECT unnest(['B' || p_partkey || '.md', 'B' || right('000' || p_partkey, 4) || '.md', p_brand || '.md', 'B' || right('000' || p_partkey, 4) || '.txt']) AS file FROM part)
SELECT file, count(*) AS n FROM f WHERE length(file) = 8 AND file[1] = 'B' AND file[6:8] = '.md' AND try_cast(file[2:5] AS INTEGER) IS NOT NULL GROUP BY file""")
def error_pages(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    key = F.col("p_partkey").cast("string")
    padded = F.concat(F.lit("B"), F.expr("right(concat('000', string(p_partkey)), 4)"))
    files = F.array(F.concat(F.lit("B"), key, F.lit(".md")), F.concat(padded, F.lit(".md")), F.concat("p_brand", F.lit(".md")), F.concat(padded, F.lit(".txt")))
    return p.select(F.explode(files).alias("file")).where(X.is_error_page("file")).groupBy("file").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT event_id, date_trunc('second', ts) AS moment, min(date_trunc('second', ts)) OVER () + INTERVAL 36 HOUR AS now FROM events)
SELECT event_id, CAST(greatest(0, floor((epoch(now) - epoch(moment)) / 86400)) AS BIGINT) AS days, CAST(NULL AS BIGINT) AS none FROM e""")
def snapshot_age(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    now = (F.col("first").cast("timestamp").cast("double") + 36 * 3600)
    e = e.crossJoin(F.broadcast(e.agg(F.min("at").alias("first"))))  # one row
    return e.select("event_id", V.age_days("at", now).alias("days"), V.age_days(F.substring("at", 1, 10), now).alias("none"))
