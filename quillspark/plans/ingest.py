"""Queries on pages, Markdown, paths, systems and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ordinal as O
from ..operators import systems as Y
from ..sources import html as H
from ..sources import markdown as M
from ..sources import records as R
from ..session import shared_dir

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1)) AS href FROM pages".replace("SELECT DISTINCT page_id, unnest", "SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest").replace(" AS href FROM pages", " AS href FROM pages) WHERE NOT regexp_matches(href, '^[a-z][a-z0-9+.-]*:|^//')"))
def href_extract(spark, sf):
    return R.table(spark, sf, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


@query()
def html_text(spark, sf):
    return H.page_text(R.table(spark, sf, "pages"), "page_id", "html")


@query()
def html_extract(spark, sf):
    p = R.table(spark, sf, "pages").withColumn("path", F.concat(F.lit("site/page.Page"), F.col("page_id").cast("string"), F.lit(".html")))
    return H.extract_items(p, "path", "html")


@query("SELECT page_id FROM pages WHERE NOT (string_split(url, '/')[-1] IN ('all.html', 'help.html', 'settings.html')) AND NOT (string_split(url, '/')[-1] = 'index.html' AND strlen(html) > 409600) AND NOT regexp_matches(url, '(^|/)src/|\\.lock/')")
def page_filter(spark, sf):
    return R.table(spark, sf, "pages").where(H.indexable(F.col("url"), F.octet_length("html"))).select("page_id")


@query("SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(replace(text, chr(13), ''), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')), '^$', '') AS text FROM documents")
def block_text(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", X.block_text("text").alias("text"))


# Paths made from documents: a shape by the id, numbers and a slug from it.
CLASSIFY_SQL = """(SELECT doc_id, 'slug_' || source || '_' || doc_id AS slug, '0.' || doc_id % 21 AS v, '0.' || doc_id % 21 + 1 AS w, doc_id % 16 AS shape, CASE doc_id % 16
  WHEN 0 THEN 'content/learn/migration-guides/' || '0.' || doc_id % 21 || '-to-0.' || (doc_id % 21 + 1) || '.md' WHEN 1 THEN 'content/learn/migration-guides/_index' || doc_id || '.md'
  WHEN 2 THEN 'release-content/0.' || doc_id % 21 || '/migration-guides/' || doc_id || '_slug_' || source || '_' || doc_id || '.md' WHEN 3 THEN 'release-content/0.' || doc_id % 21 || '/migration-guides/slug_' || source || '_' || doc_id || '.md'
  WHEN 4 THEN 'release-content/0.' || doc_id % 21 || '/release-notes/' || doc_id || '_slug_' || source || '_' || doc_id || '.md' WHEN 5 THEN 'content/learn/book/' || source || '.md' WHEN 6 THEN 'content/learn/quick-start/' || source || '/a.md'
  WHEN 7 THEN 'content/learn/advanced-examples/' || source || '.md' WHEN 8 THEN 'content/learn/' || source || '.md' WHEN 9 THEN 'content/faq/' || source || '.md' WHEN 10 THEN 'content/news/' || source || '.md' WHEN 11 THEN 'content/foundation/' || source || '.md'
  WHEN 12 THEN 'content/donate.md' WHEN 13 THEN 'content/sponsorship-pledge/' || source || '.md' WHEN 14 THEN 'release-content/0.' || doc_id % 21 || '/other/' || source || '.md' ELSE source || '/README.md' END AS path FROM documents)"""


def classified_paths(spark, sf):
    shapes = [
        "content/learn/migration-guides/0.{v}-to-0.{w}.md", "content/learn/migration-guides/_index{id}.md", "release-content/0.{v}/migration-guides/{id}_slug_{s}_{id}.md", "release-content/0.{v}/migration-guides/slug_{s}_{id}.md",
        "release-content/0.{v}/release-notes/{id}_slug_{s}_{id}.md", "content/learn/book/{s}.md", "content/learn/quick-start/{s}/a.md", "content/learn/advanced-examples/{s}.md", "content/learn/{s}.md", "content/faq/{s}.md", "content/news/{s}.md",
        "content/foundation/{s}.md", "content/donate.md", "content/sponsorship-pledge/{s}.md", "release-content/0.{v}/other/{s}.md", "{s}/README.md",
    ]
    key = F.col("doc_id")
    path = F.element_at(F.array(*map(F.lit, shapes)), (key % 16 + 1).cast("int"))
    for name, value in (("{v}", key % 21), ("{w}", key % 21 + 1), ("{id}", key), ("{s}", F.col("source"))):
        path = F.replace(path, F.lit(name), value.cast("string"))
    return R.table(spark, sf, "documents").select("doc_id", path.alias("path"))


@query(f"""SELECT doc_id, path, ['migration_guide', 'migration_guide', 'migration_entry', 'migration_entry', 'release_notes', 'book', 'tutorial', 'tutorial', 'guide', 'faq', 'news', 'foundation', 'donate', 'sponsorship', 'doc', 'doc'][shape + 1] AS kind,
  CASE shape WHEN 0 THEN 'Migration guide 0.' || doc_id % 21 || ' -> 0.' || (doc_id % 21 + 1) WHEN 1 THEN 'Migration guides (index)' WHEN 2 THEN replace(slug, '_', ' ') WHEN 3 THEN replace(slug, '_', ' ') WHEN 4 THEN replace(slug, '_', ' ') WHEN 9 THEN 'FAQ' END AS title,
  CASE WHEN shape IN (2, 3, 4) THEN '0.' || doc_id % 21 END AS version, CASE WHEN shape = 0 THEN '0.' || doc_id % 21 END AS from_version, CASE WHEN shape = 0 THEN '0.' || (doc_id % 21 + 1) END AS to_version, CASE WHEN shape = 2 THEN doc_id END AS pr FROM {CLASSIFY_SQL}""")
def classify_path(spark, sf):
    return classified_paths(spark, sf).withColumn("c", M.classify("path")).select("doc_id", "path", "c.kind", "c.title", "c.version", "c.from_version", "c.to_version", "c.pr")


# Paths made from parts: a folder and a file name by the key, some in capitals.
FOLDERS = ("2d", "ui", "ecs", "games", "shader/gltf", "input", "tools/mesh", "UI", "light", "time/state", "asset", "x/observer")
PATH_SQL = f"""(SELECT p_partkey AS key, 'examples/' || {list(FOLDERS)}[p_partkey % {len(FOLDERS)} + 1] || '/' || replace(p_name, ' ', '_') ||
  CASE p_partkey % 7 WHEN 0 THEN '_timer' WHEN 1 THEN '/ui' WHEN 2 THEN '_Camera' WHEN 3 THEN '_system_error' ELSE '' END || '.rs' AS path FROM part)"""
TAG_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains('/' || path, '{w}')" for w in a + b) + f" THEN '{tag}' END" for tag, (a, b) in M.TAGS.items())


@query(f"SELECT key, concat_ws(',', {TAG_SQL}) AS tags FROM {PATH_SQL}")
def categorise(spark, sf):
    return example_paths(spark, sf).select("key", F.array_join(M.categorise("path"), ",").alias("tags"))


def example_paths(spark, sf):
    key = F.col("p_partkey")
    end = F.when(key % 7 == 0, "_timer").when(key % 7 == 1, "/ui").when(key % 7 == 2, "_Camera").when(key % 7 == 3, "_system_error").otherwise("")
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (key % len(FOLDERS) + 1).cast("int"))
    path = F.concat(F.lit("examples/"), folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), end, F.lit(".rs"))
    return R.table(spark, sf, "part").select(key.alias("key"), path.alias("path"))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, doc_id FROM documents),
f AS (SELECT *, CASE WHEN trim(line) LIKE '```%' OR trim(line) LIKE '~~~%' OR pos % 7 = 0 THEN 1 ELSE 0 END AS fence FROM l)
SELECT doc_id, count(*) FILTER (inside % 2 = 1) AS inside FROM (SELECT *, coalesce(sum(fence) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM f) GROUP BY doc_id""")
def fence_parity(spark, sf):
    """Documents have no fences, so every seventh line gets one."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 7 == 0, F.concat(F.lit("```"), x)).otherwise(x))
    d = R.table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))
    return M.numbered_lines(d, "doc_id", "body").groupBy("doc_id").agg(F.count_if("inside").alias("inside"))


# Documents as Markdown: every fifth line a heading of some level, every eleventh a fence.
HEADED_SQL = """(SELECT doc_id, pos, CASE WHEN (pos - 1) % 11 = 3 THEN '```' WHEN (pos - 1) % 5 = 1 THEN repeat('#', CAST(1 + (doc_id + pos - 1) % 4 AS INTEGER)) || ' Part ' || (pos - 1) ELSE trim(regexp_replace(line, '[^a-zA-Z .,]', '', 'g'), ' ') END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""


def marked_documents(spark, sf):
    lines = F.expr("transform(split(text, '\n', -1), (x, i) -> CASE WHEN i % 11 = 3 THEN '```' WHEN i % 5 = 1 THEN concat(repeat('#', int(1 + (doc_id + i) % 4)), ' Part ', i) ELSE trim(regexp_replace(x, '[^a-zA-Z .,]', '')) END)")
    return R.table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))


@query(f"""WITH l AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM {HEADED_SQL}),
h AS (SELECT *, CASE WHEN NOT inside AND regexp_matches(line, '^#+ ') THEN length(split_part(line, ' ', 1)) ELSE 0 END AS level FROM l),
s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
t AS (SELECT doc_id, section, min(pos) AS line_start, max(CASE WHEN level > 0 THEN line[level + 2:] END) AS heading, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), chr(10) || ' ') AS text FROM s GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE strlen(text) >= 40),
heads AS (SELECT doc_id, section, level, line[level + 2:] AS name FROM s WHERE level > 0),
crumbs AS (SELECT k.doc_id, k.section, string_agg(a.name, ' > ' ORDER BY a.section) AS breadcrumb FROM k JOIN heads a ON a.doc_id = k.doc_id AND a.section <= k.section
  WHERE NOT EXISTS (SELECT 1 FROM heads b WHERE b.doc_id = a.doc_id AND b.section > a.section AND b.section <= k.section AND b.level <= a.level) GROUP BY ALL)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(line_start AS BIGINT) AS line_start, heading, coalesce(breadcrumb, '') AS breadcrumb, sha256(substr(text, 1, 4000)) AS text FROM k LEFT JOIN crumbs USING (doc_id, section) WHERE n > 1
UNION ALL SELECT doc_id, 0, 1, NULL, NULL, sha256(substr(body, 1, 6000)) FROM (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY pos), ' ') AS body FROM {HEADED_SQL} GROUP BY doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE n > 1)""")
def chunk_headings(spark, sf):
    """Sections of every document: heading, the headings above it, first line and text."""
    c = M.chunks(marked_documents(spark, sf), "doc_id", "body")
    return c.select("doc_id", F.col("section").cast("long").alias("section"), F.col("line_start").cast("long").alias("line_start"), "heading", F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.sha2(F.col("text").cast("binary"), 256).alias("text"))


# Source of each order: two queries and two resources; which are mutable, and what filters them, by its keys.
SYSTEM_SQL = """(SELECT o_orderkey AS k, 'sys' || o_orderkey AS system, 'C' || o_custkey % 3 AS c1, 'C' || o_orderkey % 3 AS c2, o_orderkey % 2 = 0 AS m1, o_custkey % 2 = 0 AS m2, o_orderkey % 5 AS f1, o_custkey % 5 AS f2,
  'R' || o_orderkey % 4 AS r1, 'R' || o_custkey % 4 AS r2, o_orderkey % 3 = 0 AS n1, o_custkey % 3 = 0 AS n2, o_orderkey % 7 = 0 AS world FROM orders)"""


@query(f"""WITH s AS (SELECT *, (f1 = 1 AND f2 = 2) OR (f1 = 2 AND f2 = 1) OR (f1 = 3 AND f2 = 4) OR (f1 = 4 AND f2 = 3) OR (f1 = 1 AND c2 = 'C9') AS apart FROM {SYSTEM_SQL})
SELECT system, CASE WHEN m1 AND m2 THEN 'R2' ELSE 'R1' END AS rule, c1 AS name, 0 AS owner_a, 1 AS owner_b, 'B0001' AS code FROM s WHERE c1 = c2 AND (m1 OR m2) AND NOT apart
UNION ALL SELECT system, 'R3', r1, 2, 3, 'B0002' FROM s WHERE r1 = r2 AND (n1 OR n2)
UNION ALL SELECT system, 'R5', 'World', 4, unnest([0, 1, 2, 3]), 'B0002' FROM s WHERE world""")
def access_conflicts(spark, sf):
    """Signatures of systems in source text, parsed, and their conflicting accesses by a join."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    filters = F.array(*map(F.lit, ["", ", With<A>", ", Without<A>", ", (With<B>, Changed<D>)", ", Or<(Without<B>, Without<B>)>"]))
    query_ = lambda k, name, mutable, f: F.concat(F.lit(f"{k}: Query<&"), F.when(mutable, "mut ").otherwise(""), F.lit("C"), name, F.element_at(filters, (f + 1).cast("int")), F.lit(">"))
    res = lambda k, name, mutable: F.concat(F.lit(f"{k}: Res"), F.when(mutable, "Mut").otherwise(""), F.lit("<R"), name, F.lit(">"))
    params = F.concat_ws(", ", query_("a", c % 3, o % 2 == 0, o % 5), query_("b", o % 3, c % 2 == 0, c % 5), res("c", o % 4, o % 3 == 0), res("d", c % 4, c % 3 == 0), F.when(o % 7 == 0, "w: &mut World"))
    code = F.concat(F.lit("// fn not_this(a: Query<&mut X>) {}\nfn sys"), o, F.lit("("), params, F.lit(") { let s = \"fn nor_this(q: Query<&mut X>)\"; }"))
    keys = R.table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file gives much text to parse
    return Y.conflicts(Y.extract(keys.select(code.alias("code")), "code"))


# Messages of each order: a code in brackets or alone, a type with nested generics, a reference.
MESSAGE_SQL = """(SELECT o_orderkey AS id, o_orderkey % 4 AS shape, 'B000' || o_custkey % 9 AS code, o_custkey % 3 AS kind, o_orderkey % 2 AS mutable, 'R' || o_custkey % 5 AS r FROM orders)"""
TYPE_SQL = "CASE kind WHEN 0 THEN r WHEN 1 THEN r || '<T>' ELSE r || '<A<B<C<D>>>>' END"


@query(f"""SELECT id, CASE WHEN shape < 3 THEN code END AS code, CASE shape WHEN 0 THEN 'panic' WHEN 1 THEN 'warning' WHEN 2 THEN 'unknown' END AS severity, CASE WHEN shape < 3 THEN {TYPE_SQL} END AS resource_type,
  CASE WHEN shape < 3 THEN CASE WHEN mutable = 1 THEN 'ResMut,&mut' ELSE 'Res,&' END END AS access FROM {MESSAGE_SQL}""")
def parse_error_text(spark, sf):
    return messages(spark, sf).withColumn("e", Y.parse_error("message")).select("id", "e.*")


def messages(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    code, name = F.concat(F.lit("B000"), c % 9), F.concat(F.lit("R"), c % 5)
    type_ = F.when(c % 3 == 0, name).when(c % 3 == 1, F.concat(name, F.lit("<T>"))).otherwise(F.concat(name, F.lit("<A<B<C<D>>>>")))
    held = F.when(o % 2 == 1, F.concat(F.lit("ResMut<"), type_, F.lit("> and &mut it"))).otherwise(F.concat(F.lit("Res<"), type_, F.lit("> and &it")))
    shape = F.when(o % 4 == 0, F.concat(F.lit("error["), code, F.lit("]: "))).when(o % 4 == 1, F.concat(F.lit("Warning: see "), code, F.lit(" for "))).when(o % 4 == 2, F.concat(F.lit("about "), code, F.lit(" with "))).otherwise(F.concat(F.lit("X"), code, F.lit("x no code ")))
    return R.table(spark, sf, "orders").select(o.alias("id"), F.concat(shape, held).alias("message"))


@query(f"""SELECT id, CASE WHEN shape < 3 THEN m.code END AS code, CASE WHEN shape < 3 AND doc_id IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'Use ' || source ELSE '# ' || m.code || chr(10) || 'only ' || source END END AS guide
FROM {MESSAGE_SQL} m LEFT JOIN (SELECT doc_id, source, 'B000' || doc_id AS code FROM documents WHERE doc_id < 7) g ON m.code = g.code""")
def explain_error(spark, sf):
    """Each message with its code's guide: the section that fixes it, else the page's beginning."""
    e = messages(spark, sf).withColumn("code", Y.parse_error("message")["code"])
    d = R.table(spark, sf, "documents").where("doc_id < 7")  # one page a code
    page = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "c", F.lit("\ntext\n## How to fix\nUse "), "source", F.lit("\n## More\nx"))).otherwise(F.concat(F.lit("# "), "c", F.lit("\nonly "), "source"))
    guides = d.withColumn("c", F.concat(F.lit("B000"), "doc_id")).select("c", page.alias("text"))
    return e.join(guides, F.col("code") == F.col("c"), "left").select("id", "code", Y.short_guide("text").alias("guide"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'is_changed()' END, CASE WHEN doc_id % 4 = 0 THEN 'is_added()' END) AS patterns FROM documents""")
def perf_patterns(spark, sf):
    code = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nif x.is_changed() {}").otherwise(""), F.when(F.col("doc_id") % 4 == 0, "\nif a.is_added() {}").otherwise(""))
    return R.table(spark, sf, "documents").select("doc_id", F.array_join(Y.anti_patterns(code), ",").alias("patterns"))


FOUR_SQL = """(SELECT 0 AS place, p_partkey AS key, 'rustdoc' AS source, p_name AS docs FROM part UNION ALL SELECT 1, doc_id, 'website', text FROM documents
  UNION ALL SELECT 2, page_id, 'examples', url FROM pages UNION ALL SELECT 3, item_id, 'meta', text FROM benchmark)"""


def four_sources(spark, sf):
    t = lambda name, key, source, docs: R.table(spark, sf, name).select(F.col(key).alias("key"), F.lit(source).alias("source"), F.col(docs).alias("docs"))
    return [t("part", "p_partkey", "rustdoc", "p_name"), t("documents", "doc_id", "website", "text"), t("pages", "page_id", "examples", "url"), t("benchmark", "item_id", "meta", "text")]


@query(f"SELECT row_number() OVER (ORDER BY place, key) - 1 AS dense_id, source, key, sha256(docs) AS docs FROM {FOUR_SQL}")
def union_sources(spark, sf):
    """The four sources one after the other, each in its own order, numbered through."""
    return O.in_order(four_sources(spark, sf), ["key"]).select("dense_id", "source", "key", F.sha2(F.col("docs").cast("binary"), 256).alias("docs"))


@query(f"""WITH u AS (SELECT row_number() OVER (ORDER BY place, key) - 1 AS ord, source, docs FROM {FOUR_SQL}), m AS (SELECT source, docs, min(ord) AS ord, count(*) AS copies FROM u GROUP BY source, docs)
SELECT row_number() OVER (ORDER BY ord) - 1 AS dense_id, source, copies, sha256(docs) AS docs FROM m""")
def dense_ids(spark, sf):
    """Places after the merge of equal records, by where each stood first."""
    from ..operators import index as I

    rows = O.in_order(four_sources(spark, sf), ["key"], "ord").withColumn("hash", F.sha2(F.concat_ws("|", "source", "docs"), 256))
    merged = I.dedup_merge(rows, "hash", "ord", ["source"], "docs", {})
    return O.dense_ids(merged, ["ord"]).select("dense_id", "source", "copies", F.sha2(F.col("docs").cast("binary"), 256).alias("docs"))


@query("SELECT 'n' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'struct' END AS kind, o_orderpriority AS docs, o_orderkey % 4 = 0 AS draft FROM orders")
def scan_ndjson(spark, sf):
    """Records of the orders written as line JSON, with unknown and absent keys and blank lines, and read again."""
    import uuid

    key = F.col("o_orderkey")
    path = f"{shared_dir(spark)}/ndjson-{uuid.uuid4().hex}"
    row = F.to_json(F.struct(F.concat(F.lit("n"), key).alias("name"), F.when(key % 3 > 0, "struct").alias("kind"), F.col("o_orderpriority").alias("docs"), F.when(key % 4 == 0, True).alias("draft"), key.alias("unknown")))
    R.table(spark, sf, "orders").select(F.when(key % 10 == 0, F.concat(row, F.lit("\n"))).otherwise(row).alias("value")).write.text(path)
    return R.read_ndjson(spark, path).select("name", "kind", "docs", "draft")
