"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Each text is a sequence of line IDs (64-bit hashes of whole lines; lines without a word are left out of the
sequence and stay in the text). Lines that occur once end every repeat, so only suffixes that start with a
repeated line are ranked. Level k ranks suffixes by their first 2**k lines: the pair (rank here, rank 2**k lines
on) is counted, and its distinct values are put in order by a range-partitioned running sum, so no group of equal
lines ever meets in one task. A suffix alone with its pair is final
and takes no part in later levels. Unique lines and ends of texts sort before
repeated lines, by their place. The ranks of all levels give each neighbour pair of the finished suffix array its
longest common prefix: levels they share, then descending levels at shifted places. Neighbours with a common
prefix of ``min_lines`` or more form intervals, the inner nodes that hold every maximal run of repeated lines;
within an interval every suffix but the first in (doc_id, place) order is a later copy, and its lines go. A run of fewer lines
counts where it starts with a line of ``min_words`` words or more (an interval of depth one), so a long line or a text
of one line is a run by itself, while short lines repeat freely.

Cases: rows with null doc_id or text pass unchanged. Rows with equal doc_id and text count as one document (what
is decided holds for each of them); rows with equal doc_id and different texts are documents of their own. A run that
overlaps its own copy (A A A) keeps its first line. Empty texts and empty tables pass. Other columns are kept
(one named n_removed_lines gives way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables, join_small, running_sum

KEY = ["doc_id", "th"]
#: Lines of a run, or words of a single line, from which a later copy goes.
MIN_LINES, MIN_WORDS = 2, 10


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th (hash of the text), line (index in the text), pos (index among lines with a word), h, long."""
    t = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("l"))
    long = lambda x: x.rlike(f"^[ \\t-\\r]*([^ \\t-\\r]+[ \\t-\\r]+){{{min_words - 1}}}[^ \\t-\\r]")
    worded = F.filter(F.transform("l", lambda x, i: F.when(x.rlike("[^ \\t-\\r]"), F.struct(i.alias("line"), F.xxhash64(x).alias("h"), long(x).alias("long")))), lambda x: x.isNotNull())
    t = t.select(*KEY, F.posexplode(worded).alias("pos", "x"))
    return t.select(*KEY, "pos", F.col("x.line").alias("line"), F.col("x.h").alias("h"), F.col("x.long").alias("long"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[DataFrame, Tables]:
    """Suffixes in intervals of depth ``min_lines`` or more: doc_id, th, pos, line, depth, interval, first (is the first
    copy); and those that start with a long line, in intervals of depth 1.

    Also the run's depth: ``lcp`` with the neighbour before it in the suffix array (0 at an interval's start).
    """
    spark = docs.sparkSession
    tables = Tables(spark, "lines")
    lines = _lines(docs, min_words)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():  # reads the ids only
        lines = lines.distinct()
    lines = tables.save(lines, "lines")
    count = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # Level 0: ranks of repeated lines, by hash. g: suffixes before the group; o: suffixes of open groups before it.
    ranked = running_sum(tables, count, ["h"], {"n": "g"}, "h")
    r = lines.join(ranked.select("h", "g"), "h").select(*KEY, "pos", "line", "long", "g", F.col("g").alias("o"), F.array("g").alias("hist"))
    r = r.withColumns({"open": F.lit(True), "level": F.lit(0)})
    ranks = open_ = tables.save(r, "level0")  # ranks: the newest rank of every suffix; open_: those not alone yet
    paths, levels = [], 0
    while open_.limit(1).count():
        step = 1 << levels
        ahead = ranks.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("g").alias("g2"))
        j = open_.join(ahead, [*KEY, "pos"], "left")
        # the next key: the rank ahead, or (first in order) the place of a unique line or of the text's end
        none, zero = F.col("g2").isNull(), F.lit(0).cast("long")
        j = j.select(*KEY, "pos", "line", "long", "hist", "g", "o", *(x.cast("long").alias(c) for c, x in (("t", F.when(none, 0).otherwise(1)), ("a", F.when(none, F.col("doc_id")).otherwise(F.col("g2"))), ("b", F.when(none, F.col("th")).otherwise(zero)), ("c", F.when(none, F.col("pos")).otherwise(zero)))))
        pairs = tables.save(j, "pairs")
        key = ["g", "t", "a", "b", "c"]
        counts = pairs.groupBy(*key).agg(F.count("*").alias("n")).withColumn("n_open", F.when(F.col("n") > 1, F.col("n")).otherwise(0))
        ranked = running_sum(tables, counts, key, {"n": "before", "n_open": "o_new"}, "rank").select(*key, "n", "before", "o_new")
        new = pairs.join(ranked, key).withColumn("g_new", F.col("g") + F.col("before") - F.col("o"))
        hist = F.when(F.col("n") > 1, F.concat("hist", F.array("g_new"))).otherwise(F.col("hist"))
        levels += 1
        new = new.select(*KEY, "pos", "line", "long", F.col("g_new").alias("g"), F.col("o_new").alias("o"), hist.alias("hist"), (F.col("n") > 1).alias("open"), F.lit(levels).alias("level"))
        new = tables.save(new, f"level{levels}")
        tables.drop(pairs)
        paths.append(new._quill_path)
        ranks = spark.read.schema(new.schema).parquet(*paths).where((~F.col("open")) | (F.col("level") == levels))
        open_ = new.where("open")
    # ranks: the suffix array; g is the place. Neighbours: equality of the shared levels' ranks, then descent.
    r = ranks
    sa = r.select(*KEY, "pos", "line", "long", "g", "hist")
    prev = r.select((F.col("g") + 1).alias("g"), F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("pos").alias("p2"), F.col("hist").alias("hist2"))
    shared = F.size(F.filter(F.transform("hist", lambda x, i: F.get("hist2", i) == x), lambda x: x))
    p = sa.join(prev, "g").withColumn("k", shared - 1).where("k >= 0").select(*KEY, "pos", "g", "d2", "t2", "p2", "k", F.expr("cast(shiftleft(1L, k) as int)").alias("lcp"))
    p = tables.save(p, "neighbours")
    work = None  # pairs that share more than this level, with what they are known to share
    for level in range(levels - 2, -1, -1):
        more = p.where(F.col("k") == level + 1)
        todo = more if work is None else work.unionByName(more)
        names = r.where(F.size("hist") > level).select(*KEY, "pos", F.col("hist")[level].alias("name"))
        here = names.select("doc_id", "th", F.col("pos").alias("at"), "name")
        there = names.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("pos").alias("at2"), F.col("name").alias("name2"))
        todo = todo.withColumns({"at": F.col("pos") + F.col("lcp"), "at2": F.col("p2") + F.col("lcp")})
        met = todo.join(here, [*KEY, "at"], "left").join(there, ["d2", "t2", "at2"], "left")
        lcp = F.col("lcp") + F.when(F.col("name") == F.col("name2"), 1 << level).otherwise(0)
        before, work = work, tables.save(met.select(*KEY, "pos", "g", "d2", "t2", "p2", "k", lcp.alias("lcp")), f"lcp{level}")
        if before is not None:
            tables.drop(before)
    p = p.where("k = 0").unionByName(work) if work is not None else p
    # Intervals: a new one starts where the common prefix with the suffix before is shorter than min_lines.
    lcp = sa.select(*KEY, "pos", "line", "g").join(p.select("g", "lcp"), "g", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))
    lcp = running_sum(tables, lcp.withColumn("new", (F.col("lcp") < min_lines).cast("long")), ["g"], {"new": "before"}, "interval")
    lcp = lcp.withColumn("interval", F.col("before") + F.col("new"))
    first = lcp.groupBy("interval").agg(F.min(F.struct(*KEY, "pos")).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    columns = [*KEY, "pos", "line", "depth", "interval", "lcp", "copies", (F.struct(*KEY, "pos") == F.col("f")).alias("first")]
    runs = lcp.withColumn("depth", F.lit(min_lines)).join(first, "interval").select(*columns)
    if min_lines > 1:  # the suffixes of one line are the interval of depth 1 that its rank of level 0 names
        one = sa.where("long").select(*KEY, "pos", "line", F.lit(1).alias("depth"), F.get("hist", F.lit(0)).alias("interval"), F.lit(None).cast("int").alias("lcp"))
        first = tables.save(one.groupBy("interval").agg(F.min(F.struct(*KEY, "pos")).alias("f"), F.count("*").alias("copies")).where("copies > 1"), "long-lines")
        runs = runs.unionByName(join_small(one, first, ["interval"], "pos").select(*columns))
    return runs, tables


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th and the sorted array ``gone`` of line indexes that later copies of repeated runs cover."""
    runs, tables = repeated_runs(docs, min_lines, min_words)
    lines = tables.spark.read.parquet(f"{tables.root}/001-lines").select(*KEY, "pos", "line")
    covered = runs.where("NOT first").select(*KEY, F.explode(F.sequence("pos", F.col("pos") + F.col("depth") - 1)).alias("pos")).distinct()
    return covered.join(lines, [*KEY, "pos"]).groupBy(*KEY).agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the new text, and ``n_removed_lines`` (long); no row is dropped."""
    gone = deleted_lines(docs, min_lines, min_words).select(F.col("doc_id").alias("_q3_doc"), F.col("th").alias("_q3_hash"), F.col("gone").alias("_q3_gone"))
    j = docs.join(gone, (docs["doc_id"] == F.col("_q3_doc")) & (F.xxhash64(docs["text"]) == F.col("_q3_hash")), "left")
    j = j.withColumn("_q3_lines", F.split("text", "\n", -1))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_q3_lines") - 1), "_q3_gone"), lambda i: F.get("_q3_lines", i)), "\n")
    j = j.withColumn("text", F.when(F.col("_q3_gone").isNotNull(), kept).otherwise(F.col("text")))
    n = F.when(F.col("_q3_gone").isNull(), 0).otherwise(F.size("_q3_gone")).cast("long")
    return j.withColumn("n_removed_lines", n).select(*(c for c in docs.columns if c != "n_removed_lines"), "n_removed_lines")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; n_chars follows the text; emptied rows go."""
    out = dedup(docs).where("n_removed_lines = 0 OR text RLIKE '[^ \\\\t-\\\\r]'").drop("n_removed_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS line
  FROM documents),
w AS (SELECT doc_id, line, s, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos FROM l
  WHERE regexp_matches(s, '[^ \t\n\x0B\f\r]')),
p AS (SELECT doc_id, pos, s, lead(s) OVER (PARTITION BY doc_id ORDER BY pos) AS s2 FROM w),
c AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, pos) AS copy FROM p WHERE s2 IS NOT NULL),
b AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS copy FROM w
  WHERE len(regexp_extract_all(s, '[^ \t\n\x0B\f\r]+')) >= 10),
g AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM c WHERE copy > 1 UNION ALL SELECT doc_id, pos + 1 FROM c WHERE copy > 1
  UNION ALL SELECT doc_id, pos FROM b WHERE copy > 1)),
gone AS (SELECT w.doc_id, w.line FROM w JOIN g ON w.doc_id = g.doc_id AND w.pos = g.pos),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) AS text FROM l
  LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line WHERE gone.line IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed_lines,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
