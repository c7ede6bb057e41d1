"""Queries on names, indexes and search over the part and documents tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import DEFINITIONS, INTENTS, STOPWORDS  # noqa: F401
from ..operators import corpus as C
from ..operators import index as I
from ..operators import renames as Renames
from ..operators import search as S
from ..operators import similar as N
from ..sources import records as R
from . import prepared

TERMS = ["the", "and", "eau", "der", "que"]
QUERIES, SQL = {}, {}
PARTS = R.PARTS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bm25_sql(select: str, corpus: str | None = None, terms: list[str] = TERMS) -> str:
    """BM25 of TERMS over documents in SQL."""
    by = f"GROUP BY {corpus}" if corpus else ""
    on = f"USING ({corpus})" if corpus else "ON true"
    c = f"{corpus}, " if corpus else ""
    terms = ", ".join(f"'{t}'" for t in terms)
    return f"""
WITH t AS (SELECT doc_id, source AS module, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND strlen(w) < 40) AS w FROM documents),
n AS (SELECT {c}count(*) AS n, avg(len(w)) AS avgdl FROM t {by}),
p AS (SELECT {c}doc_id, len(w) AS dl, unnest(w) AS term FROM t),
tf AS (SELECT {c}doc_id, dl, term, count(*) AS tf FROM p WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT {c}term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT tf.{c.strip(', ') + ', ' if corpus else ''}doc_id AS dense_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched
  FROM tf JOIN df USING ({c}term) JOIN n {on} GROUP BY ALL)
{select}""".replace("tf.module, doc_id", "module, doc_id").replace("SELECT tf.doc_id AS", "SELECT doc_id AS")


@query(_bm25_sql("SELECT dense_id, round(score, 6) AS score, CAST(matched AS INTEGER) AS matched FROM s ORDER BY score DESC, dense_id LIMIT 20"))
def bm25_search(spark, sf):
    """The 20 best of the built index; it opens the folders of the five terms only."""
    best = prepared.documents(spark, sf).text.pool(TERMS, 20)
    return best.select(F.col("id").alias("dense_id"), F.round("score", 6).alias("score"), "matched").orderBy(F.desc("score"), "dense_id")


@query(_bm25_sql("SELECT dense_id, round(score, 6) AS score, CAST(matched AS INTEGER) AS matched FROM s"))
def text_scores(spark, sf):
    """BM25 of every document that has a term, from the postings of an index written in two segments."""
    return prepared.documents(spark, sf).text.score(TERMS).select(F.col("id").alias("dense_id"), F.round("score", 6).alias("score"), "matched")


@query(_bm25_sql("SELECT dense_id, round(score, 6) AS score FROM s WHERE matched = 2 ORDER BY round(score, 9) DESC, dense_id LIMIT 200", terms=["the", "and"]))
def text_pool_strict(spark, sf):
    """The 200 best documents that have both terms, found over block maxima."""
    return prepared.documents(spark, sf).text.pool(["the", "and"], 200, strict=True).select(F.col("id").alias("dense_id"), F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND strlen(w) < 40)) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term""")
def term_dictionary(spark, sf):
    """Document frequency of every term, from the dictionary of the index."""
    return prepared.documents(spark, sf).text.terms.read().groupBy("term").agg(F.sum("df").alias("df"))


@query(_bm25_sql("SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, (SELECT CAST(coalesce(sum(df), 0) AS BIGINT) FROM df) AS df FROM n"))
def bm25_stats(spark, sf):
    s = I.field_stats(R.documents(spark, sf), X.prose_tokens("docs"), TERMS)
    return s.select("n", F.round("avgdl", 6).alias("avgdl"), sum((F.col(f"df{i}") for i in range(1, len(TERMS))), F.col("df0")).alias("df"))


@query("SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '' AND strlen(w) < 40)) AS term, count(*) AS n FROM documents GROUP BY 1".replace("SELECT unnest", "SELECT term, count(*) AS n FROM (SELECT unnest").replace(" AS term, count(*) AS n FROM documents GROUP BY 1", " AS term FROM documents) GROUP BY 1"))
def tokenize_prose(spark, sf):
    return R.documents(spark, sf).select(F.explode(X.prose_tokens("docs")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT text AS docs, count(*) AS copies, min(doc_id) AS dense_id, arg_min(lang, doc_id) AS kind FROM documents GROUP BY text")
def dedup_merge(spark, sf):
    d = R.documents(spark, sf).withColumn("key", F.sha2("docs", 256)).withColumn("family", F.lit("documents"))
    m = I.dedup_merge(d, "key", "dense_id", ["family"], "docs", {"kind": ""})
    return m.select("docs", "copies", "dense_id", "kind")


@query(f"SELECT dense_id, substr(sha1(source || '|' || kind || '|' || full_path || '|' || name || '||'), 1, 16) AS hash FROM {PARTS}")
def record_hash(spark, sf):
    p = R.parts(spark, sf).withColumns({"heading": F.lit(""), "doc_version": F.lit("")})
    return p.select("dense_id", R.record_id().alias("hash"))


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def facet_counts(spark, sf):
    return I.facets(R.documents(spark, sf), "kind")


@query("SELECT event_type AS kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def status_summary(spark, sf):
    from pyspark.sql import Window

    c = I.facets(R.table(spark, sf, "events").withColumnRenamed("event_type", "kind"), "kind")
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "kind")).cast("long"))  # a row a kind


KEYS_SQL = f"""SELECT DISTINCT dense_id, unnest([lower(name), lower(owner || '::' || name), lower(full_path), lower(module || '::' || full_path)]) AS key FROM {PARTS}"""


@query(f"SELECT key, dense_id, ord FROM (SELECT key, dense_id, CAST(row_number() OVER (PARTITION BY key ORDER BY dense_id) AS INTEGER) AS ord FROM ({KEYS_SQL})) WHERE ord <= 60")
def symbol_index(spark, sf):
    return I.symbol_index(R.parts(spark, sf))


SPACED = "regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')"
SINGULAR = """CASE WHEN strlen(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y'
  WHEN regexp_matches(w, '(ches|shes|xes|zes)$') THEN w[:-3]
  WHEN strlen(w) > 3 AND regexp_matches(w, '[^su]s$') THEN w[:-2] ELSE w END"""
WORDS_SQL = f"SELECT *, {SINGULAR} AS term FROM (SELECT *, unnest(string_split(lower({SPACED}), ' ')) AS w FROM {PARTS})"


@query(f"SELECT term, dense_id, ord FROM (SELECT term, dense_id, CAST(row_number() OVER (PARTITION BY term ORDER BY dense_id) AS INTEGER) AS ord FROM (SELECT DISTINCT term, dense_id FROM ({WORDS_SQL}) UNION SELECT unnest(regexp_extract_all(lower(owner), '[a-z]+|[0-9]+')), dense_id FROM {PARTS})) WHERE ord <= 1000")
def token_index(spark, sf):
    return I.token_index(R.parts(spark, sf))


@query(f"SELECT dense_id, name, CAST(1000.0 AS DOUBLE) AS score FROM {PARTS} WHERE lower(name) = 'redwidget' ORDER BY dense_id LIMIT 60")
def lookup_exact(spark, sf):
    return prepared.parts(spark, sf).lookup("Red Widget<T>").orderBy(F.desc("score"), "rank", "dense_id").select("dense_id", "name", "score")


@query(f"SELECT dense_id, string_agg(term, ' ' ORDER BY i) AS tokens FROM (SELECT *, {SINGULAR} AS term FROM (SELECT *, unnest(string_split(lower({SPACED}), ' ')) AS w, generate_subscripts(string_split(lower({SPACED}), ' '), 1) AS i FROM {PARTS})) GROUP BY dense_id")
def ident_tokens(spark, sf):
    return R.parts(spark, sf).select("dense_id", F.array_join(X.name_tokens("name"), " ").alias("tokens"))


@query(f"""SELECT DISTINCT w AS word, {SINGULAR} AS one FROM (SELECT lower(x || e) AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part), (SELECT unnest(['', 's', 'es', 'ies', 'ss', 'us', 'ches', 'shes', 'xes', 'zes']) AS e))""")
def singularize(spark, sf):
    ends = F.array(*map(F.lit, ["", "s", "es", "ies", "ss", "us", "ches", "shes", "xes", "zes"]))
    words = R.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct().select("w", F.explode(ends).alias("e")).select(F.concat("w", "e").alias("word")).distinct()
    return words.select("word", X.singular("word").alias("one"))


@query(f"SELECT dense_id, lower(replace(full_path, ' ', '')) AS key FROM {PARTS}")
def norm_key(spark, sf):
    noisy = F.concat(F.lit("::"), F.col("owner"), F.lit("<T, Vec<U>>::"), F.col("name"), F.lit("::<A<B>>()"))
    return R.parts(spark, sf).select("dense_id", X.norm_key(noisy).alias("key"))


STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"""SELECT dense_id, string_agg(term, ' ' ORDER BY place) AS terms FROM (SELECT dense_id, term, min(place) AS place FROM (
  SELECT dense_id, unnest([w, {SINGULAR}]) AS term, 2 * i + unnest([0, 1]) AS place FROM (SELECT p_partkey AS dense_id, unnest(string_split(q, ' ')) AS w, generate_subscripts(string_split(q, ' '), 1) AS i
  FROM (SELECT p_partkey, 'how do i use the ' || lower(p_name) || 's' AS q FROM part)) WHERE w NOT IN ({STOPS}) AND strlen(w) > 1) GROUP BY dense_id, term) GROUP BY dense_id""")
def query_terms(spark, sf):
    q = F.concat(F.lit("How do I use the "), "p_name", F.lit("s"))
    return R.table(spark, sf, "part").select(F.col("p_partkey").alias("dense_id"), F.array_join(X.query_terms(q), " ").alias("terms"))


@query(f"SELECT dense_id, lower(name) || ' ' || array_to_string(list_transform(string_split(lower({SPACED}), ' '), lambda w: {SINGULAR}), ' ') AS tokens FROM {PARTS}")
def tokenize_ident(spark, sf):
    return R.parts(spark, sf).select("dense_id", F.array_join(X.identifier_tokens("name"), " ").alias("tokens"))


WEIGHT_SQL = "CASE kind WHEN 'doc' THEN 0.35 WHEN 'book' THEN 0.7 ELSE CASE source WHEN 'rustdoc' THEN 1.0 ELSE 0.4 END END"


@query("SELECT lang AS kind, CAST(0.4 AS DOUBLE) AS weight FROM documents GROUP BY lang UNION ALL SELECT lower(replace(p_type, ' ', '_')), CAST(1.0 AS DOUBLE) FROM part GROUP BY 1")
def record_weight(spark, sf):
    both = R.documents(spark, sf).select("kind", "source").union(R.parts(spark, sf).select("kind", "source")).distinct()
    return both.select("kind", S.record_weight().cast("double").alias("weight"))


@query(f"SELECT dense_id, CAST(round(1.0 + CASE WHEN name LIKE 'Red%' AND name LIKE '%Widget' THEN 3.7 + 2.2 + 1.2 + 3.0 WHEN name LIKE 'Red%' THEN 3.7 WHEN name LIKE '%Widget' THEN 2.2 ELSE 0 END, 6) AS DOUBLE) AS boost FROM {PARTS}")
def relevance_boost(spark, sf):
    return S.prepare(R.parts(spark, sf)).select("dense_id", F.round(S.relevance(["red", "widget"], ["reds", "widgets"]), 6).alias("boost"))


@query(f"SELECT dense_id FROM {PARTS} WHERE (kind = 'standard' OR kind LIKE '%standard%') AND lower(module) LIKE '%par%'")
def search_filtered(spark, sf):
    return R.parts(spark, sf).where(S.passes(kind="standard", module="PAR", draft=True)).select("dense_id")


@query(f"SELECT dense_id FROM {PARTS} WHERE lower(name) = 'redwidget' ORDER BY dense_id LIMIT 8")
def hybrid_search(spark, sf):
    return prepared.parts(spark, sf).search("RedWidget").select("dense_id")


@query(f"""WITH p AS {PARTS}, text AS (SELECT dense_id, 1.0 * length(signature) AS raw FROM p WHERE name LIKE '%Gear'),
names AS (SELECT dense_id, CASE WHEN name LIKE 'Red%' AND name LIKE '%Gear' THEN 240.0 * 11.1 ELSE 90.0 * CASE WHEN name LIKE 'Red%' THEN 4.7 ELSE 3.2 END END AS raw FROM p WHERE name LIKE 'Red%' OR (name LIKE '%Gear' AND dense_id % 2 = 0)),
m AS (SELECT dense_id, n.raw AS name, coalesce(t.raw / (SELECT max(raw) FROM text) * 850, 0) AS band FROM text t FULL JOIN names n USING (dense_id))
SELECT dense_id, round(CASE WHEN name > 0 THEN name + 0.3 * band ELSE band END, 6) AS score FROM m""")
def hybrid_merge(spark, sf):
    """Text and name evidence of all records that have either, by a full outer join: some have both, some one."""
    subj = ["red", "gear"]
    concept = (S.name_coverage(subj) > 0) & (F.col("kind").isin(*DEFINITIONS) | (S.name_coverage(subj) == len(subj)))
    raw = F.when(concept, 240.0).otherwise(90.0) * S.record_weight() * S.relevance(subj, subj)
    p = R.parts(spark, sf)
    names = S.prepare(p).where(S.name_coverage(subj) > 0).where("name LIKE 'Red%' OR dense_id % 2 = 0").select("dense_id", raw.alias("name_raw"))
    text = p.where("name LIKE '%Gear'").select("dense_id", F.length("signature").cast("double").alias("text_raw"))
    return C.merge(text, names).select("dense_id", F.round("score", 6).alias("score"))


CONCEPT = "small red gears"
CONCEPT_SQL = f"""
WITH p AS (SELECT * FROM {PARTS}),
words AS (SELECT dense_id, 'name' AS field, unnest([lower(name)] || list_transform(string_split(lower({SPACED}), ' '), lambda w: {SINGULAR})) AS term FROM p
  UNION ALL SELECT dense_id, 'signature', unnest(['fn', lower(name)] || list_transform(string_split(lower({SPACED}), ' '), lambda w: {SINGULAR}) || ['size', regexp_extract(signature, '[0-9]+')]) FROM p
  UNION ALL SELECT dense_id, 'docs', unnest(string_split(docs, ' ')) FROM p),
n AS (SELECT field, (SELECT count(*) FROM p) AS n, count(*) / (SELECT count(*) FROM p) AS mean FROM words GROUP BY field),
lengths AS (SELECT dense_id, field, count(*) AS length FROM words GROUP BY ALL),
tf AS (SELECT dense_id, field, term, count(*) AS tf FROM words WHERE term IN ('small', 'red', 'gears', 'gear') GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
one AS (SELECT dense_id, term, sum(CASE field WHEN 'name' THEN 4 WHEN 'signature' THEN 2 ELSE 1 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS w
  FROM tf JOIN df USING (field, term) JOIN n USING (field) JOIN lengths USING (dense_id, field) GROUP BY ALL),
bm AS (SELECT dense_id, sum(w) AS bm25, count(*) AS terms FROM one GROUP BY dense_id),
hits AS (SELECT dense_id, bm25 FROM (SELECT * FROM bm ORDER BY round(bm25, 9) DESC, dense_id LIMIT 2000)
  UNION SELECT dense_id, bm25 FROM (SELECT * FROM bm WHERE terms = 4 ORDER BY round(bm25, 9) DESC, dense_id LIMIT 2000)),
postings AS (SELECT DISTINCT dense_id FROM words WHERE field = 'name' AND term IN ('small', 'red', 'gear')),
seen AS (SELECT dense_id, owner, name, CAST(name LIKE 'Small%' AS INTEGER) AS small, CAST(name LIKE 'Red%' AS INTEGER) AS red, CAST(name LIKE '%Gear' AS INTEGER) AS gear,
  1 + 0.12 * (CAST(contains(lower(docs || chr(10) || signature), 'small') AS INTEGER) + CAST(contains(lower(docs || chr(10) || signature), 'red') AS INTEGER) + CAST(contains(lower(docs || chr(10) || signature), 'gear') AS INTEGER)) AS covered FROM p),
boosted AS (SELECT *, 1 + 3.7 * small + 2.2 * red + 2.2 * gear + CASE WHEN small + red + gear > 1 THEN (small + red + gear - 1) * 1.2 ELSE 0 END AS boost FROM seen),
text AS (SELECT dense_id, bm25 * boost * covered AS raw FROM hits JOIN boosted USING (dense_id)),
names AS (SELECT dense_id, 90 * boost AS raw FROM postings JOIN boosted USING (dense_id) WHERE small + red + gear > 0),
merged AS (SELECT dense_id, names.raw AS name, coalesce(text.raw / (SELECT max(raw) FROM text) * 850, 0) AS band FROM text FULL JOIN names USING (dense_id)),
scored AS (SELECT dense_id, round(CASE WHEN name > 0 THEN name + 0.3 * band ELSE band END, 6) AS score FROM merged),
best AS (SELECT *, row_number() OVER (PARTITION BY p.owner, p.name ORDER BY score DESC, dense_id) AS r FROM scored JOIN p USING (dense_id))
SELECT dense_id, score FROM best WHERE r = 1 ORDER BY score DESC, dense_id LIMIT 20"""


@query(CONCEPT_SQL)
def concept_search(spark, sf):
    """Concept query with text, names, filters and collapse of equal definitions."""
    return prepared.parts(spark, sf).search(CONCEPT, S.passes(source="rustdoc"), 20, key=["owner", "name"]).select("dense_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS dense_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_reexports(spark, sf):
    return S.first_of(R.documents(spark, sf).withColumn("k", F.sha2("docs", 256)), ["k"], ["dense_id"]).select("dense_id")


@query(f"SELECT dense_id, CAST(levenshtein(lower(name), 'redwidgit') AS INTEGER) AS distance FROM {PARTS}")
def edit_distance(spark, sf):
    return R.parts(spark, sf).select("dense_id", F.levenshtein(F.lower("name"), F.lit("redwidgit")).alias("distance"))


@query(f"SELECT dense_id, name FROM {PARTS} WHERE abs(length(name) - 9) <= 3 AND levenshtein(lower(name), 'redwidgit') <= 3")
def fuzzy_lookup(spark, sf):
    return R.parts(spark, sf).where((F.abs(F.length("name") - 9) <= 3) & F.levenshtein(F.lower("name"), F.lit("redwidgit"), 3).between(0, 3)).select("dense_id", "name")


PREFIX_SQL = "list_sum(list_transform(range(1, least(len(lower(name)), len('redwidgets')) + 1), lambda i: CASE WHEN lower(name)[:i] = 'redwidgets'[:i] THEN 1 ELSE 0 END))"


@query(f"SELECT dense_id, CAST({PREFIX_SQL} AS INTEGER) AS n FROM {PARTS}")
def common_prefix(spark, sf):
    return R.parts(spark, sf).select("dense_id", X.common_prefix(F.lower("name"), F.lit("redwidgets")).cast("int").alias("n"))


@query(f"""WITH s AS (SELECT dense_id, CASE WHEN name LIKE '%Widget' THEN 50 ELSE 0 END + CASE WHEN name LIKE 'Red%' THEN 12 ELSE 0 END + 2 * {PREFIX_SQL} - least(levenshtein(lower(name), 'redwidgets'), 12) AS score
  FROM {PARTS} WHERE name LIKE 'Red%' OR name LIKE '%Widget')
SELECT dense_id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 AND score >= (SELECT max(score) FROM s) - 60 ORDER BY score DESC, dense_id LIMIT 5""")
def suggest(spark, sf):
    return C.suggestions(prepared.parts(spark, sf), "RedWidgets").select("dense_id", F.col("score").cast("int").alias("score"))


@query(f"SELECT dense_id, 2 AS score FROM {PARTS} WHERE replace(signature, ' ', '') = 'fnRedWidget(size:7)'")
def signature_lookup(spark, sf):
    return S.signature_lookup(R.parts(spark, sf), "fn RedWidget( size: 7, )").select("dense_id", "score")


@query(f"SELECT dense_id, name FROM (SELECT * FROM {PARTS} WHERE owner = 'Brand#3' AND dense_id <> 3 ORDER BY dense_id LIMIT 12)")
def related_items(spark, sf):
    p = R.parts(spark, sf).withColumn("kind", F.lit("method"))
    return S.related(p, "Brand#3", 3).select("dense_id", "name")


@query(_bm25_sql("SELECT module, dense_id, score, rank FROM (SELECT module, dense_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY module ORDER BY round(score, 6) DESC, dense_id) AS INTEGER) AS rank FROM s) WHERE rank <= 8", "module"))
def fanout_search(spark, sf):
    return S.fanout(R.documents(spark, sf), "module", X.prose_tokens("docs"), TERMS)


@query("""WITH h AS (SELECT doc_id, text, length(text) AS score FROM documents ORDER BY length(text) DESC, doc_id LIMIT 50)
SELECT doc_id AS dense_id, CAST((CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'version') THEN 1 ELSE 0 END) AS INTEGER) AS relevance FROM h""")
def examples_rerank(spark, sf):
    hits = R.documents(spark, sf).withColumn("score", F.length("docs")).orderBy(F.desc("score"), "dense_id").limit(50)
    return S.examples_rerank(hits, ["license", "version"]).select("dense_id", "relevance")


# Documents with two parts' names put into their lines: one as an old name, both in back-ticks.
PROSE_SQL = f"""(SELECT doc_id, a.name AS n1, b.name AS n2, a.docs AS d1, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: x || CASE (i - 1) % 4 WHEN 0 THEN ' Old' || a.name || ' is renamed.' WHEN 1 THEN ' `' || b.name || '`' WHEN 2 THEN ' `' || a.name || '::' || b.name || ' gear`' ELSE '' END), 'string_agg', chr(10)) AS body
  FROM documents JOIN {PARTS} a ON a.dense_id = doc_id % 200 JOIN {PARTS} b ON b.dense_id = (doc_id * 7 + 3) % 200)"""


@query(f"""WITH d AS (SELECT *, 'Old' || n1 AS symbol FROM {PROSE_SQL}),
p AS (SELECT doc_id, symbol, n1, d1, string_split(body, symbol) AS cut, string_split(body, '`') AS ticks FROM d),
own AS (SELECT doc_id, symbol, d1, list_sum(list_transform(cut[:k], lambda x: strlen(x))) + (k - 1) * strlen(symbol) AS pos FROM (SELECT *, unnest(range(1, len(cut))) AS k FROM p)),
seg AS (SELECT doc_id, ticks[k] AS segment, list_sum(list_transform(ticks[:k - 1], lambda x: strlen(x))) + k - 1 AS start FROM (SELECT *, unnest(range(2, len(ticks), 2)) AS k FROM p)),
tok AS (SELECT doc_id, start, unnest(regexp_extract_all(segment, '[A-Za-z0-9_]+')) AS token FROM seg),
first AS (SELECT name, min(dense_id) AS record FROM {PARTS} GROUP BY name),
near AS (SELECT symbol, doc_id, token AS name, start, min(abs(start - pos)) AS distance, any_value(string_split(d1, ' ')[2]) AS noun FROM own JOIN tok USING (doc_id) WHERE abs(start - pos) <= 300 GROUP BY ALL),
scored AS (SELECT symbol, doc_id AS doc, record, n.name, distance, CAST(200 - distance // 2 + CASE WHEN lower(n.name) LIKE '%' || noun THEN 40 ELSE 0 END + 30 AS INTEGER) AS score FROM near n JOIN first f ON f.name = n.name),
best AS (SELECT symbol, max(row(score, doc))[2] AS doc FROM scored GROUP BY symbol)
SELECT symbol, doc, record, name, CAST(min(distance) AS BIGINT) AS distance, max(score) AS score FROM scored JOIN best USING (symbol, doc) GROUP BY ALL""")
def rename_candidates(spark, sf):
    """For every part's name with Old before it: the names that prose puts near it in back-ticks."""
    p = R.parts(spark, sf)
    one, two = p.select(F.col("dense_id").alias("k1"), F.col("name").alias("n1")), p.select(F.col("dense_id").alias("k2"), F.col("name").alias("n2"))
    d = R.table(spark, sf, "documents").withColumn("k1", F.col("doc_id") % 200).withColumn("k2", (F.col("doc_id") * 7 + 3) % 200).join(one, "k1").join(two, "k2")
    said = "CASE i % 4 WHEN 0 THEN concat(' Old', n1, ' is renamed.') WHEN 1 THEN concat(' `', n2, '`') WHEN 2 THEN concat(' `', n1, '::', n2, ' gear`') ELSE '' END"
    prose = d.select(F.col("doc_id").alias("dense_id"), F.array_join(F.expr(f"transform(split(text, '\\n', -1), (x, i) -> concat(x, {said}))"), "\n").alias("docs"))
    return Renames.rename_candidates(prose, p, p.select(F.concat(F.lit("Old"), "name").alias("symbol")).distinct())


@query(f"SELECT c_custkey, wanted AS name, wanted IN (SELECT name FROM {PARTS}) AS present FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'RedWidget' WHEN 1 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || 'Gear' ELSE 'NoSuch' || c_custkey END AS wanted FROM customer)")
def symbols_present(spark, sf):
    """Which of the names that each customer wants are there: a semi-join on distinct names."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, "RedWidget").when(key % 3 == 1, F.concat(F.initcap("c_mktsegment"), F.lit("Gear"))).otherwise(F.concat(F.lit("NoSuch"), key))
    have = R.parts(spark, sf).select(F.col("name").alias("found")).distinct()
    wanted = R.table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    return wanted.join(have, F.col("name") == F.col("found"), "left").select("c_custkey", "name", F.col("found").isNotNull().alias("present"))


# Each part's brand and name, and the same with one to three slips by its key: letters left out, put in or changed.
NEAR_NAMES_SQL = "(SELECT DISTINCT lower(replace(p_brand || p_name, ' ', '')) AS name FROM part)"
TYPO_SQL = """(SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN n[1:3] || n[5:] WHEN 1 THEN n[1:5] || 'zq' || n[6:] WHEN 2 THEN 'x' || n[2:7] || n[9:] || 'y' ELSE n[1:4] || 'q' || n[6:] END AS query
  FROM (SELECT p_partkey, lower(replace(p_brand || p_name, ' ', '')) AS n FROM part))"""


@query(f"SELECT query, name, CAST(levenshtein(query, name) AS INTEGER) AS distance FROM {TYPO_SQL}, {NEAR_NAMES_SQL} WHERE levenshtein(query, name) <= 3")
def fuzzy_names(spark, sf):
    """All names within edit distance 3 of each misspelt one, by the parts that they share."""
    n = F.lower(F.replace(F.concat("p_brand", "p_name"), F.lit(" "), F.lit("")))
    p = R.table(spark, sf, "part").select("p_partkey", n.alias("n"))
    typo = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(substr(n, 1, 3), substr(n, 5)) WHEN 1 THEN concat(substr(n, 1, 5), 'zq', substr(n, 6)) WHEN 2 THEN concat('x', substr(n, 2, 6), substr(n, 9), 'y') ELSE concat(substr(n, 1, 4), 'q', substr(n, 6)) END")
    return N.near(p.select(typo.alias("query")), p.select(F.col("n").alias("name")), 3)
