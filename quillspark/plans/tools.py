"""Queries on results of tools, folders of files and source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as T
from ..sources import folders as D
from ..sources import records as R
from . import ingest, prepared, releases

QUERIES, SQL = {}, {}
PARTS = R.PARTS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT dense_id, '' AS id, source, kind, name, full_path, signature, docs, module, owner, 'part' AS crate, CAST(NULL AS VARCHAR) AS doc_version, CAST(NULL AS VARCHAR) AS heading, CAST(NULL AS VARCHAR) AS title FROM {PARTS}""")
def record_results(spark, sf):
    p = R.parts(spark, sf)
    return p.select("dense_id", *T.record_columns(p))


@query(f"""SELECT dense_id, name, kind, CAST(11000 AS DOUBLE) AS score, 'results' AS part, '0.20.0' AS project_version, '0.20.1' AS corpus_version, true AS fallback FROM {PARTS} WHERE lower(name) = 'redwidget' ORDER BY dense_id LIMIT 20""")
def search_tool(spark, sf):
    """The search tool's rows for a name, more asked for than it gives."""
    return T.search(prepared.parts(spark, sf), "RedWidget", 99, None, "0.20.0", "0.20.1").select("dense_id", "name", "kind", F.round("score", 6).alias("score"), "part", "project_version", "corpus_version", "fallback")


@query(f"""SELECT dense_id, name, 'results' AS part FROM (SELECT * FROM {PARTS} WHERE lower(name) = 'redwidget' ORDER BY dense_id LIMIT 6)""")
def api_tool(spark, sf):
    return T.api(prepared.parts(spark, sf), "RedWidget").select("dense_id", "name", "part")


@query(f"""WITH r AS (SELECT kind, source FROM {PARTS} UNION ALL SELECT lang, 'documents' FROM documents UNION ALL SELECT 'field', 'rustdoc' FROM supplier)
SELECT 'kind' AS part, kind AS name, count(*) AS n FROM r GROUP BY kind UNION ALL SELECT 'source', source, count(*) FROM r GROUP BY source UNION ALL SELECT 'total', 'records', count(*) FROM r
UNION ALL SELECT 'total', 'api_records', count(*) FROM r WHERE source = 'rustdoc' UNION ALL SELECT 'total', 'text_indexed', count(*) FROM r WHERE kind <> 'field'""")
def index_status(spark, sf):
    fields = R.table(spark, sf, "supplier").select(F.lit("field").alias("kind"), F.lit("rustdoc").alias("source"))
    rows = R.parts(spark, sf).select("kind", "source").union(R.documents(spark, sf).select("kind", "source")).union(fields)
    return T.status(rows).select("part", "name", "n")


@query(f"""WITH i AS (SELECT *, {releases.CORE('vers')} AS core FROM ({releases.INDEX_SQL}) WHERE NOT yanked AND name = 'crate7'),
s AS (SELECT max(struct_pack(core := core, vers := vers)) FILTER (NOT contains(vers, '-')) AS stable, max(struct_pack(core := core, vers := vers)) FILTER (contains(vers, '-')) AS p FROM i)
SELECT '0.7.1' AS indexed, stable.vers AS newest_stable, CASE WHEN stable IS NULL OR p.core > stable.core THEN p.vers END AS preview, CASE WHEN stable.core[1] > 0 THEN 'major' WHEN stable.core = row(0, 7, 1) THEN 'none' WHEN stable.core < row(0, 7, 1) THEN 'downgrade' WHEN stable.core[2] <> 7 THEN 'minor' ELSE 'patch' END AS level FROM s WHERE stable IS NOT NULL""")
def check_version(spark, sf):
    v = releases.versions(spark, sf)
    index = v.select(F.concat(F.lit("crate"), F.col("p_partkey") % 150).alias("name"), F.col("version").alias("vers"), (F.col("p_partkey") % 5 == 0).alias("yanked"))
    return T.release_check(index, "crate7", "0.7.1").select("indexed", "newest_stable", "preview", "level")


@query("SELECT doc_id, list_aggregate(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: regexp_matches(t, '^[A-Za-z]')), 'string_agg', ' ') AS tokens FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])[A-Za-z]')")
def identifier_runs(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", F.array_join(T.identifiers("text"), " ").alias("tokens")).where("tokens <> ''")


# Source text of each document: its lines, every ninth with a code, every thirteenth a gated plugin.
@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, 'B' || right('000' || doc_id % 50, 4) AS code, CAST(pos AS INTEGER) AS line FROM l WHERE (pos - 1) % 9 = 2 UNION ALL SELECT doc_id, 'B0001', CAST(pos AS INTEGER) FROM l WHERE (pos - 1) % 9 = 2 AND doc_id % 2 = 0""")
def panic_sites(spark, sf):
    marked = "transform(split(text, '\\n', -1), (x, i) -> CASE WHEN i % 9 = 2 THEN concat(x, ' error[B', right(concat('000', doc_id % 50), 4), ']', CASE WHEN doc_id % 2 = 0 THEN ' warning[B0001]' ELSE '' END) ELSE x END)"
    return D.panic_sites(R.table(spark, sf, "documents").select("doc_id", F.array_join(F.expr(marked), "\n").alias("code")), "doc_id", "code")


@query("""WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), g AS (SELECT * FROM l WHERE pos % 13 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS ord, 'feature_' || pos AS requires_feature, 'Plugin' || doc_id || 'x' || pos AS plugin FROM g""")
def plugin_gates(spark, sf):
    gate = "concat('#[cfg(feature = \"feature_', i, '\")]\\n    #[allow(x)]\\n  my::path::Plugin', doc_id, 'x', i, ' ;\\n')"
    marked = f"transform(split(text, '\\n', -1), (x, i) -> CASE WHEN i % 13 = 0 THEN concat({gate}, regexp_replace(x, '#', '')) ELSE regexp_replace(x, '#', '') END)"
    return D.plugin_gates(R.table(spark, sf, "documents").select("doc_id", F.array_join(F.expr(marked), "\n").alias("code")), "doc_id", "code")


@query(f"""SELECT path AS file, name, module, tags, line_count, description FROM (SELECT key, path, regexp_replace(split_part(path, '/', -1), '\\.rs$', '') AS name, replace(left(path, length(path) - length(split_part(path, '/', -1)) - 1), '/', '::') AS module,
  concat_ws(',', {ingest.TAG_SQL}) AS tags, CAST(key % 3 + 2 AS BIGINT) AS line_count, CASE WHEN key % 3 > 0 THEN 'About ' || key END AS description FROM {ingest.PATH_SQL})""")
def example_records(spark, sf):
    """Example files made of parts as records."""
    key = F.col("key")
    body = F.when(key % 3 == 0, "fn main() {}\n").when(key % 3 == 1, F.concat(F.lit("//! About "), key, F.lit("\n\nfn main() {}"))).otherwise(F.concat(F.lit("//! About "), key, F.lit("\n\nfn main() {}\n")))
    files = ingest.example_paths(spark, sf).select(key, "path", body.alias("text"))
    return D.example_records(files, "examples").select("file", "name", "module", F.array_join("categories", ",").alias("tags"), "line_count", "description")


@query(f"""WITH c AS ({ingest.SQL['chunk_headings']}), p AS ({ingest.SQL['classify_path']})
SELECT kind || ':' || path AS full_path, kind, coalesce(title, CASE WHEN doc_id % 3 = 0 THEN 'Page ' || doc_id ELSE regexp_replace(split_part(path, '/', -1), '\\.md$', '') END) AS title, replace(left(path, length(path) - length(split_part(path, '/', -1)) - 1), '/', '::') AS module,
  doc_id % 3 = 0 AND doc_id % 2 = 0 AS draft, line_start, heading, p.version, text AS docs FROM c JOIN p USING (doc_id) WHERE kind NOT IN ('foundation', 'donate', 'sponsorship')""")
def website_records(spark, sf):
    """Documents as Markdown files at paths of every kind, a third of them with a front matter, as records."""
    front = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('+++\ntitle = "Page '), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, '"\nstatus = "hidden"\n+++\n').otherwise('"\n+++\n'))).otherwise("")
    files = ingest.marked_documents(spark, sf).join(ingest.classified_paths(spark, sf), "doc_id").select("doc_id", "path", F.concat(front, "body").alias("text"))
    out = D.website_records(files, key="doc_id")
    return out.select("full_path", "kind", "title", "module", "draft", F.col("line_start").cast("long").alias("line_start"), "heading", "version", F.sha2(F.col("docs").cast("binary"), 256).alias("docs"))


@query("SELECT source, CASE WHEN count(DISTINCT version) = 1 THEN min(version) END AS version, string_agg(DISTINCT name || ' ' || version, ', ' ORDER BY name || ' ' || version) AS crates, count(DISTINCT version) > 1 AS ambiguous FROM (SELECT 'lock' || c_nationkey AS source, 'crate_' || lower(c_mktsegment) AS name, CASE WHEN c_nationkey % 2 = 0 THEN '0.2.' || c_custkey % 3 ELSE '0.3.1' END AS version FROM customer) GROUP BY source")
def detected_versions(spark, sf):
    """The version that each lock file's crates agree on, or what they differ in."""
    c = R.table(spark, sf, "customer")
    version = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("0.2."), F.col("c_custkey") % 3)).otherwise("0.3.1")
    return D.detected(c.select(F.concat(F.lit("lock"), "c_nationkey").alias("source"), F.concat(F.lit("crate_"), F.lower("c_mktsegment")).alias("name"), version.alias("version")))
