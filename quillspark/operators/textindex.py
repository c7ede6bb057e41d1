"""A text index on disk: postings in blocks, block headers with maxima, a term dictionary and field statistics.

``add`` writes a batch of documents as one segment; earlier segments are not touched, and the scores always use the
statistics of all segments. Documents of like length share a block of some ``BLOCK`` documents. A posting row is (term,
field, block, ids, tfs, lengths); rows are dealt by range of (bucket, term, field, block), so a word that stands in every
document spreads over many tasks and files. A header has the block's largest term frequency, its shortest length and its
best weight by the segment's own mean length, which later segments can raise by the means' ratio at most.

``pool`` finds the k best documents without scoring all that match: block headers give every block an upper bound, blocks
with the highest bounds are scored first, their k-th score is a threshold, and then only blocks whose bound reaches it
are scored. The result is that of scoring everything, ties by id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import B, K1
from ..storage import Files, KeyedTable

BLOCK = 256
#: Classes of the histogram of block bounds; blocks named in a filter that the scan can use.
BINS, NAMED = 200, 500
#: Posting rows of a query up to which bounds save nothing: then all are scored at once, with the same result.
DIRECT = 2_000


@dataclass
class Statistics:
    """Documents and mean length of each field, and the documents of each (field, term): a few numbers a query."""

    n: dict[str, int]
    mean: dict[str, float]
    df: dict[tuple[str, str], int]
    rows: int = 0  # posting rows of the terms, a row a block


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, boosts: dict[str, float], buckets: int = 16, block: int = BLOCK, direct: int = DIRECT):
        """``boosts``: the fields, each with the factor of its scores."""
        self.spark, self.root, self.boosts, self.block, self.direct = spark, root.rstrip("/"), boosts, block, direct
        self.postings = KeyedTable(spark, f"{self.root}/postings", "term", buckets)
        self.headers = KeyedTable(spark, f"{self.root}/headers", "term", buckets)
        self.terms = KeyedTable(spark, f"{self.root}/terms", "term", buckets)

    def segments(self) -> list[str]:
        return Files(self.spark).names(f"{self.root}/_commits")

    def add(self, docs: DataFrame, segment: str) -> None:
        """Adds documents: ``id`` (long, not in the index yet) and an array of tokens for each field."""
        if segment in self.segments():
            raise ValueError(f"segment {segment} is there already")
        files = Files(self.spark)
        for table in (self.postings, self.headers, self.terms):  # left by a write that died
            files.delete(f"{table.root}/_commits/{segment}")
        n = docs.select("id").count()
        sizes = {f: F.coalesce(F.size(f), F.lit(0)) for f in self.boosts}
        # quarter octaves of the length, some ten of which hold most documents
        length = F.floor(4 * F.log2(F.lit(1.0) + reduce(lambda a, b: a + b, sizes.values()))).cast("long")
        placed = docs.withColumn("block", F.shiftleft(length, 40) + F.pmod(F.xxhash64("id"), F.lit(-(-n // (8 * self.block)) or 1)))
        tf = placed.select("id", "block", F.explode(F.concat(*(_words(f, s) for f, s in sizes.items()))).alias("w")).groupBy("w.term", "w.field", "block", "id", "w.length").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        keys = ["bucket", "term", "field", "block"]
        ranged = tf.withColumn("bucket", self.postings.bucket(F.col("term"))).repartitionByRange(*keys)
        rows = ranged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("p"))
        self.postings.write(rows.select(*keys, *(F.col(f"p.{c}").alias(f"{c}s") for c in ("id", "tf", "length"))), segment, ["field", "block"], ranged=True)
        written = self.postings.read(segments=[segment])
        total = dict.fromkeys(self.boosts, 0)
        if written is not None:
            total |= {r.field: r.n for r in written.groupBy("field").agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, t: a + t)).alias("n")).collect()}
            mean = F.lit(1.0) * _of_field({f: t / n for f, t in total.items()})
            best = F.array_max(F.zip_with("tfs", "lengths", lambda t, k: _saturated(t, k, mean)))
            self.headers.write(written.select(*keys, F.size("ids").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("lengths").alias("min_length"), best.alias("best"), mean.alias("mean")), segment, ["field", "block"])
            self.terms.write(self.headers.read(segments=[segment]).groupBy("bucket", "term", "field").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")), segment, ["field"])
        self.spark.createDataFrame([(f, n, t) for f, t in total.items()], "field string, n long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/stats/segment={segment}")
        files.mark(f"{self.root}/_commits/{segment}")

    def count(self) -> int:
        return next(iter(self.statistics([]).n.values()), 0)

    def statistics(self, terms: list[str]) -> Statistics:
        """A row a field and a row a (term, field) come to the driver: as many as the query has."""
        paths = [f"{self.root}/stats/segment={s}" for s in self.segments()]
        n, mean, df = dict.fromkeys(self.boosts, 0), dict.fromkeys(self.boosts, 0.0), {}
        if paths:
            for r in self.spark.read.parquet(*paths).groupBy("field").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect():
                n[r.field], mean[r.field] = r.n, r.tokens / max(1, r.n)
        found = self.terms.read(terms, self.segments()) if terms else None
        if found is not None:
            got = found.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("blocks").alias("blocks")).collect()
            return Statistics(n, mean, {(r.field, r.term): r.df for r in got}, sum(r.blocks for r in got))
        return Statistics(n, mean, df)

    def _factor(self, s: Statistics) -> Column:
        """A term's idf times its field's factor; statistics are literals."""
        pairs = [(f"{f} {t}", self.boosts[f] * _idf(s.n[f], df) * (K1 + 1)) for (f, t), df in s.df.items() if f in self.boosts]
        return F.create_map(*(F.lit(x) for p in pairs for x in p))[F.concat_ws(" ", "field", "term")]

    def _scored(self, postings: DataFrame, s: Statistics, of: int | None) -> DataFrame:
        """id, score, matched of documents in the given postings; ``of``: only those with so many different terms."""
        p = postings.select("term", "field", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
        p = p.select("term", F.col("p.ids").alias("id"), (self._factor(s) * _saturated(F.col("p.tfs"), F.col("p.lengths"), _of_field(s.mean))).alias("w"))
        by_term = p.groupBy("id", "term").agg(F.sum("w").alias("w")) if len(self.boosts) > 1 else p
        out = by_term.groupBy("id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).cast("int").alias("matched"))
        return out if of is None else out.where(F.col("matched") == of)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "id long, score double, matched int")

    def score(self, terms: list[str], strict: bool = False) -> DataFrame:
        """id, score, matched (how many of the terms) of every document with any term (``strict``: with all)."""
        terms = list(dict.fromkeys(terms))
        s = self.statistics(terms)
        if not s.df:
            return self._none()
        return self._scored(self.postings.read(terms, self.segments()), s, len(terms) if strict else None)

    def bounds(self, terms: list[str], s: Statistics, strict: bool) -> DataFrame:
        """segment, block, bound (no document of the block scores more), n (documents at least) from block headers alone."""
        now = _of_field(s.mean)
        most = F.least(F.col("best") * F.greatest(F.lit(1.0), now / F.col("mean")), _saturated(F.col("max_tf"), F.col("min_length"), now))
        head = self.headers.read(terms, self.segments()).select("segment", "block", "term", "n", (self._factor(s) * most).alias("w"))
        out = head.groupBy("segment", "block").agg(F.sum("w").alias("bound"), F.max("n").alias("n"), F.count_distinct("term").alias("terms"))
        return out.where(F.col("terms") == len(terms)) if strict else out

    def pool(self, terms: list[str], k: int, strict: bool = False, report: dict | None = None) -> DataFrame:
        """The k best of ``score``, ties by id. ``report`` gets the blocks that have the terms, and those scored."""
        terms = list(dict.fromkeys(terms))
        s = self.statistics(terms)
        if not s.df:
            return self._none()
        of = len(terms) if strict else None
        best = [F.round("score", 9).desc(), F.asc("id")]  # sums of one set of weights may differ in their last bits
        if s.rows <= self.direct:
            return self._scored(self.postings.read(terms, self.segments()), s, of).orderBy(*best).limit(k)
        bounds = self.bounds(terms, s, strict)
        top = sum(self.boosts[f] * (K1 + 1) * max(0.0, _idf(s.n[f], df)) for (f, _), df in s.df.items()) or 1.0
        # how many documents stand in blocks of each class of bounds: at most BINS rows
        bins = bounds.groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("bound") / top * BINS)).alias("bin")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).orderBy(F.desc("bin")).collect()
        if report is not None:
            report["blocks"] = sum(r.blocks for r in bins)
        if not bins:
            return self._none()
        need, cut = k, bins[-1].bin
        for r in bins:
            need -= r.n
            if need <= 0:
                cut = r.bin
                break
        if cut > bins[-1].bin:
            first = self._of_blocks(terms, bounds.where(F.col("bound") >= cut * top / BINS))
            row = self._scored(first, s, of).orderBy(*best).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            if row.n == k:
                bounds = bounds.where(F.col("bound") >= row.least - 1e-6)
        if report is not None:
            report["scored"] = bounds.count()
        return self._scored(self._of_blocks(terms, bounds), s, of).orderBy(*best).limit(k)

    def _of_blocks(self, terms: list[str], blocks: DataFrame) -> DataFrame:
        """Postings of some blocks; few blocks are named to the scan, which then skips the row groups of others."""
        rows = self.postings.read(terms, self.segments())
        some = blocks.select("segment", "block").limit(NAMED + 1).collect()
        if len(some) <= NAMED:
            rows = rows.where(F.col("block").isin(*{r.block for r in some}))
        return rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")

    def search(self, terms: list[str], k: int) -> DataFrame:
        """The pool of a query: the k best with all terms and the k best with any; one row a document."""
        terms = list(dict.fromkeys(terms))
        s = self.statistics(terms)
        if s.df and s.rows <= self.direct:  # both from one table of scores
            scored = self._scored(self.postings.read(terms, self.segments()), s, None)
            best = [F.round("score", 9).desc(), F.asc("id")]
            both = scored.where(F.col("matched") == len(terms)).orderBy(*best).limit(k).unionByName(scored.orderBy(*best).limit(k))
        elif not s.df:
            both = self._none()
        else:
            both = self.pool(terms, k, strict=True).unionByName(self.pool(terms, k))
        return both.dropDuplicates(["id"])


def _of_field(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for f, m in values.items() for x in (f, float(m) or 1.0)))[F.col("field")]


def _saturated(tf: Column, length: Column, mean: Column) -> Column:
    """BM25's share of a term frequency: more with tf and with the mean length, less with the document's own."""
    return tf / (tf + K1 * (1 - B + B * length / mean))


def _words(field: str, size: Column) -> Column:
    return F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(field).alias("field"), size.alias("length")))


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))
