r"""Source divergence audit: how far the words of each (lang, source) group lie from those of its language's other sources.

Terms are runs of letters in ASCII or of anything beyond ASCII, with A-Z lower-cased. A language keeps the V terms that
stand in at least ``MIN_DOCS`` of its documents. A group (and a language) gives a kept term that occurs ``count`` times in
it the share p = 1 + floor(``SCALE`` (count + 1) / (N + V)), N the sum of its counts; f = floor((p - q)**2 / q).

Counting. Every task sums counts and documents of (lang, source, term) in a table of bounded size before the shuffle, so a
hot source or a very common word arrives as a row a task. A kept term then is one row with the counts of the sources that
have it, at most as many as there are sources.

Pairs. f of two sources over all V terms is V times f of two absent terms (the baseline) plus corrections on the terms that
one or both of them have: sparse. Kept terms are dealt to blocks by hash; a block meets the sums of its language's sources,
and adds its corrections up by numpy, so that pairs of sources, never pairs of rows, leave it.

Ranking by radix select. The term with rank ``TOP`` of every group is sought by histograms of ``BITS`` value bits at a
time, from the highest down, counted for all groups at once; terms above the last bin are in, terms in it go to the
next bits. What is still tied beyond ``TIES`` rows at equal value is narrowed the same way by the next UTF-8 bytes. So no group
is ever sorted: only the at most ``TOP`` rows that stay, or a bounded number of ties.

All arithmetic is exact in 64 bits: shares are divided in three steps of 1000, so counts may reach 9e15.

Cases: null text, lang and source count as ''. A text without terms still makes its group occur. Empty table: no rows. A
language with one source has no pairs. V = 0: pairs have value 0, and there are no terms. Repeated rows count as
documents. Ties rank by the item's UTF-8 bytes. Texts are handled whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Tables, arrow_rows, join_small, partitions

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Radix select: 60 value bits in steps of 15, then bytes of the term in steps of 2; ties that one window may sort.
BITS, VALUE_BITS, BYTES, TIES = 15, 60, 2, 5_000
#: (source, term) entries of a block, entries of a task's table while counting, pairs expanded at a time, and pairs of a block's table.
BLOCK, ENTRIES, CHUNK, TABLE = 1_000_000, 600_000, 1_000_000, 2_000_000

_KEEP = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _tally(batches):
    """Counts and documents of each (lang, source, term) of a task, given out whenever the table is full. A group's
    mark is the empty term, which no text has."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    entries = 0

    def out():
        for (lang, source), count in docs.items():
            terms = list(count)
            same = pa.array(np.zeros(len(terms), np.int64))
            columns = [pa.array([lang]).take(same), pa.array([source]).take(same), pa.array(terms, pa.binary()).cast(pa.string()), [n[lang, source][t] for t in terms], list(count.values())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)
        n.clear()
        docs.clear()

    for lang, source, text in W.rows(batches, "lang", "source", "text"):
        group = lang or "", source or ""
        if group not in docs:
            n[group], docs[group] = Counter(), Counter()
        terms, count = (text or "").encode().translate(_KEEP).split(), docs[group]
        before = len(count)
        n[group].update(terms)
        count.update({b"", *terms})
        entries += len(count) - before
        if entries >= ENTRIES:
            yield from out()
            entries = 0
    yield from out()


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE (count + 1) / total), in steps of 1000 so that nothing overflows."""
    return F.expr(f"""aggregate(array(1, 2, 3), named_struct('q', 1L * (({count} + 1) div {total}), 'r', 1L * (({count} + 1) % {total})),
        (s, i) -> named_struct('q', s.q * 1000 + (s.r * 1000) div {total}, 'r', (s.r * 1000) % {total}), s -> 1 + s.q)""")


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    q, r = np.divmod(count + 1, total)
    for _ in range(3):
        step, r = np.divmod(r * 1000, total)
        q = q * 1000 + step
    return 1 + q


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _sums(a: np.ndarray, b: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes and the exact sums of their values."""
    code = a * width + b
    order = np.argsort(code, kind="stable")
    code, v = code[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[: len(code)]
    return code[first], np.add.reduceat(v, first) if len(first) else v


def _corrections(lang: str, low: int, high: int, base: bool, n_terms: int, total: np.ndarray, term: np.ndarray, sid: np.ndarray, count: np.ndarray):
    """Pair codes (a * sources + b) and partial sums for the pairs whose first source is in [low, high)."""
    width = len(total)
    if n_terms == 0:
        ids = np.arange(low, high if base else low)
        yield (ids[:, None] * width + np.arange(width)).ravel(), np.zeros(len(ids) * width, np.int64)
        return
    zero = _shares(np.zeros(width, np.int64), total)  # the share of an absent term
    both = _f(zero[low:high, None], zero[None, :])
    out = both * n_terms if base else np.zeros_like(both)
    # A term that one of the two has: how often each count occurs in a source decides, for all other sources at once.
    order = np.lexsort((count, sid))
    s, c = sid[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))[: len(s)]
    times = np.diff(np.concatenate([first, [len(s)]]))
    s, c = s[first], c[first]
    p = _shares(c, total[s])
    for at in range(0, len(s), step := max(1, CHUNK // width)):
        i, t, share = s[at : at + step], times[at : at + step, None], p[at : at + step, None]
        inside = (i >= low) & (i < high)
        np.add.at(out, i[inside] - low, (t * (_f(share, zero[None, :]) - _f(zero[i, None], zero[None, :])))[inside])
        mine = zero[None, low:high]
        np.add.at(out.T, i, t * (_f(mine, share) - _f(mine, zero[i, None])))
    yield (np.arange(low, high)[:, None] * width + np.arange(width)).ravel(), out.ravel()
    # Terms that both have: each entry of the rows' side with all entries of its term, a bounded number at a time.
    order = np.lexsort((sid, term))
    term, sid, count = term[order], sid[order], count[order]
    share = _shares(count, total[sid])
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))[: len(term)]
    size = np.diff(np.concatenate([start, [len(term)]]))
    group = np.repeat(np.arange(len(start)), size)
    left = np.flatnonzero((sid >= low) & (sid < high) & (size[group] > 1))
    ends = np.cumsum(size[group[left]])
    at = 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        g = group[left[at:upto]]
        i = np.repeat(left[at:upto], size[g])
        j = np.arange(len(i)) - np.repeat(np.cumsum(size[g]) - size[g], size[g]) + np.repeat(start[g], size[g])
        a, b = sid[i], sid[j]
        v = _f(share[i], share[j]) - _f(share[i], zero[b]) - _f(zero[a], share[j]) + _f(zero[a], zero[b])
        yield _sums(a, b, v, width)
        at = upto


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of one block of one language's terms; ``groups``: all sources of the language by number."""
    parts = []
    lang, n_terms, block, low, high = (groups.column(c)[0].as_py() for c in ("lang", "v", "block", "low", "high"))
    order = np.argsort(groups.column("sid").to_numpy())
    total = groups.column("total").to_numpy()[order]
    term = terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    sid, count = (terms.column(c).to_numpy() for c in ("sid", "n"))
    for code, value in _corrections(lang, low, high, block == 0, n_terms, total, term, sid, count):
        a, b = np.divmod(code, len(total))
        keep = (a != b) & ((value != 0) | (block == 0))
        parts.append(pa.table([pa.array([lang]).take(pa.array(np.zeros(int(keep.sum()), np.int64))), a[keep], b[keep], value[keep]], schema=_PAIRS))
    return pa.concat_tables(parts)


def _nth(tables: Tables, state: DataFrame, hist: DataFrame, downwards: bool, tag: str) -> DataFrame:
    """``state``: lang, source, need; ``hist``: lang, source, digit, rows. Per group the digit in which the row with rank
    ``need`` lies, what is needed out of it, and how many rows it has. A group's window has a row for each digit."""
    w = Window.partitionBy("lang", "source").orderBy(F.desc("digit") if downwards else F.asc("digit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = hist.withColumn("upto", F.sum("rows").over(w)).join(state, ["lang", "source"]).where("upto >= need AND upto - rows < need")
    return tables.save(cut.select("lang", "source", "digit", (F.col("need") - F.col("upto") + F.col("rows")).alias("need"), "rows"), tag)


def top_rows(tables: Tables, rows: DataFrame, k: int = TOP) -> DataFrame:
    """The k rows of every group with the largest value, ties by the least UTF-8 bytes of item; ``rows``: lang, source,
    item, value (below 2**60, one row an item). Adds rank."""
    groups = tables.save(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    taken = [join_small(rows, groups.where(F.col("rows") <= k).select("lang", "source"), ["lang", "source"], "item", "left_semi")]
    # left: rows that may still be among the first; state: how many of them each group needs
    state = groups.where(F.col("rows") > k).select("lang", "source", F.lit(k).cast("long").alias("need"))
    left = join_small(rows, state.select("lang", "source"), ["lang", "source"], "item", "left_semi")
    levels = [(F.shiftright("value", VALUE_BITS - BITS * (i + 1)).bitwiseAND((1 << BITS) - 1), True) for i in range(VALUE_BITS // BITS)]
    level = 0
    while True:
        if level < len(levels):
            digit, downwards = levels[level]
        else:
            at = (level - len(levels)) * BYTES
            digit, downwards = F.conv(F.rpad(F.hex(F.substring(F.encode("item", "UTF-8"), at + 1, BYTES)), 2 * BYTES, "0"), 16, 10).cast("long"), False
        dealt = left.withColumn("digit", digit)
        state = _nth(tables, state, dealt.groupBy("lang", "source", "digit").agg(F.count(F.lit(1)).alias("rows")), downwards, "cut")
        cut = state.select("lang", "source", F.col("digit").alias("cut"), "need", F.col("rows").alias("inside"))
        dealt = join_small(dealt, cut, ["lang", "source"], "item")
        better = F.col("digit") > F.col("cut") if downwards else F.col("digit") < F.col("cut")
        columns = ["lang", "source", "item", "value"]
        taken.append(tables.save(dealt.where(better | ((F.col("digit") == F.col("cut")) & (F.col("need") == F.col("inside")))).select(*columns), "taken"))
        few = F.col("inside") <= TIES
        same = (F.col("digit") == F.col("cut")) & (F.col("need") < F.col("inside"))
        w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        sorted_ = dealt.where(same & few).withColumn("place", F.row_number().over(w)).where("place <= need")
        taken.append(tables.save(sorted_.select(*columns), "taken"))
        left = tables.save(dealt.where(same & ~few).select(*columns), "left")
        state = state.where((F.col("need") < F.col("rows")) & (F.col("rows") > TIES)).select("lang", "source", "need")
        level += 1
        if state.isEmpty():
            break
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    arrow_rows(spark)
    tables = Tables(spark, "divergence")
    raw = docs.select("lang", "source", "text").mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    counts = tables.save(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    occurring = counts.where("term = ''").select("lang", "source")
    kept = tables.save(
        counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by_source")).where(F.col("docs") >= min_docs).select("lang", "term", "n", "by_source"),
        "kept",
    )
    entries = kept.select("lang", "term", F.col("n").alias("in_lang"), F.explode("by_source").alias("e")).select("lang", "term", "in_lang", "e.source", "e.n")
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"), F.sum(F.size("by_source")).alias("entries"))
    per_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = occurring.join(per_lang, "lang", "left").join(per_group, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n_group", "entries"])
    # the numbers of a language's sources: a window with a row for each source
    stats = tables.save(groups.select("*", numbered.cast("long").alias("sid"), (F.col("n_group") + F.col("v")).alias("total"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("sources")), "groups")

    # part term
    known = join_small(entries, stats.select("lang", "source", "sid", "total", "v", "n_lang"), ["lang", "source"], "term")
    p, q = _share("n", "total"), _share("in_lang", "(n_lang + v)")
    over = known.where("n > 0").withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = top_rows(tables, tables.save(over, "over"), top)

    # part pair: blocks of terms by hash, and for very many sources ranges of the first source
    per = F.greatest(F.lit(1), F.floor(F.lit(TABLE) / F.col("sources")))
    shape = stats.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("entries") / F.lit(BLOCK)), F.least(F.lit(partitions(spark)), F.ceil(F.col("entries") / F.lit(BLOCK // 20)))).cast("long"), "per": per.cast("long")})
    layout = shape.select("lang", "blocks", "per", "sources").distinct()
    cells = layout.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("low", F.explode(F.expr("sequence(0L, sources - 1, per)")))
    cells = cells.select("lang", "block", "low", F.least(F.col("low") + F.col("per"), F.col("sources")).alias("high"))
    right = shape.select("lang", *(F.col(c).alias(c) for c in ("sid", "total", "v"))).join(cells, "lang")
    left = join_small(known.select("lang", "term", "sid", "n"), layout, ["lang"], "term")
    left = left.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).withColumn("low", F.explode(F.expr("sequence(0L, sources - 1, per)"))).select("lang", "block", "low", "term", "sid", "n")
    keys = ["lang", "block", "low"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block, "lang string, a long, b long, value long")
    names = stats.select("lang", "sid", "source")
    pairs = tables.save(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    pairs = join_small(join_small(pairs, names.withColumnRenamed("sid", "a"), ["lang", "a"], "b"), names.withColumnsRenamed({"sid": "b", "source": "item"}), ["lang", "b"], "a")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by)).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
sums AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM sums s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
