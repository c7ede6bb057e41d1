"""A built corpus: records with the symbol, word and text indexes that searches probe.

``add`` writes a batch of records as one segment of each index; a search opens only the folders of the keys and terms it
asks for, and reads of the records only what its pools hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import DEFINITIONS, FIELD_BOOST, POOL, SYMBOL_CAP, TOKEN_CAP
from ..storage import KeyedTable
from . import index as I
from . import search as S
from .textindex import TextIndex


def field_tokens(column: str) -> Column:
    return X.prose_tokens(column) if column == "docs" else X.identifier_tokens(column)


class Corpus:
    def __init__(self, spark: SparkSession, root: str, records: DataFrame, boosts: dict[str, float] = FIELD_BOOST, buckets: int = 16):
        """``records`` holds all records added; the indexes live below ``root``."""
        self.spark, self.records = spark, records
        self.symbols = KeyedTable(spark, f"{root}/symbols", "key", buckets)
        self.names = KeyedTable(spark, f"{root}/names", "term", buckets)
        self.text = TextIndex(spark, f"{root}/text", boosts, buckets)

    def add(self, records: DataFrame, segment: str) -> None:
        """Indexes records whose dense_id isn't in yet; fields (members of types) have no text."""
        if "name" in self.text.boosts:  # a step that a broken-off call has finished is kept
            for table, rows in ((self.symbols, I.symbol_index(records, None)), (self.names, I.token_index(records, None))):
                if segment not in table.segments():
                    table.write(rows, segment, ["dense_id"])
        texts = records.where("kind <> 'field' OR kind IS NULL").select(F.col("dense_id").alias("id"), *(field_tokens(f).alias(f) for f in self.text.boosts))
        self.text.add(texts, segment)

    def postings(self, table: KeyedTable, keys: list[str], cap: int | None = None) -> DataFrame:
        """dense_id of the records of some keys over all segments; ``cap``: the first so many of each key."""
        found = table.read(keys) if keys else None
        if found is None:
            return self.spark.createDataFrame([], "dense_id long")
        return I.capped(found.select(table.key, "dense_id"), table.key, cap).select("dense_id").distinct()

    def lookup(self, query: str, cap: int | None = SYMBOL_CAP) -> DataFrame:
        """Records of a symbol key, with score and rank; None: all of them."""
        key = X.py_norm_key(query)
        found = self.postings(self.symbols, [key], cap)
        found = found if cap is None else F.broadcast(found)
        whole = X.norm_key("full_path") == key if "::" in key else F.lit(False)
        return self.records.join(found, "dense_id").withColumn("score", F.when(whole, 1100.0).otherwise(1000.0)).withColumn("rank", S.symbol_rank())

    def search(self, query: str, filters: Column | None = None, limit: int = 8, pool: int = POOL, key: list[str | Column] | None = None) -> DataFrame:
        """dense_id, score, best first: exact names in a band of their own, then text and name evidence merged.

        Text: the pool of the k best with all terms and the k best with any, cut before the filters. Names: records of the
        words' postings, only where no exact record passed. Both are merged by id: the text's share of the best text
        score, times 850, counts in full alone and at 0.3 beside a name. ``key``: one row of equals, the best. Postings
        are read whole, so exact and name records can be any number: they are joined, not sent out or gathered.
        """
        terms, surfaces, subjects = X.py_query_terms(query), X.py_query_words(query), X.py_subjects(query)
        ok = F.lit(True) if filters is None else filters
        pool = max(pool, limit * 100) if filters is not None else pool
        exact = self.lookup(query, None).where(ok).select("dense_id", (10000 + F.col("score") * S.record_weight()).alias("score"))
        found = not exact.isEmpty()
        weight, boost = S.record_weight(), S.relevance(subjects, surfaces)
        keep = [c for c in ("dense_id", "kind", "source", "name", "owner", "full_path", "module", "docs", "signature") if c in self.records.columns]

        hits = self.text.search(terms, pool).select(F.col("id").alias("dense_id"), F.col("score").alias("bm25"))
        if found:
            hits = hits.join(exact, "dense_id", "left_anti")
        text = self.records.where(ok).select(*keep).join(F.broadcast(hits), "dense_id")  # at most two pools
        text = S.prepare(text).select("dense_id", (F.col("bm25") * weight * boost * S.docs_coverage(subjects)).alias("text_raw"))

        covered = S.name_coverage(subjects)
        concept = F.col("kind").isin(*DEFINITIONS) | (covered == len(subjects))
        candidates = self.postings(self.names, [] if found else terms)
        names = S.prepare(self.records.where(ok).select(*keep).join(candidates, "dense_id")).where(covered > 0)
        names = names.select("dense_id", (F.when(concept, 240.0).otherwise(90.0) * weight * boost).alias("name_raw"))

        merged = merge(text, names)
        out = exact.unionByName(merged)
        if key:
            rows = self.records.drop("docs", "signature") if any(not isinstance(c, str) for c in key) else self.records.select("dense_id", *key)
            out = S.first_of(rows.join(out, "dense_id"), key, [F.round("score", 6).desc(), "dense_id"]).select("dense_id", "score")
        return out.orderBy(F.round("score", 6).desc(), "dense_id").limit(limit)


def merge(text: DataFrame, names: DataFrame) -> DataFrame:
    """Text evidence (dense_id, text_raw) and name evidence (dense_id, name_raw) as one score for each record that has either."""
    top = text.agg(F.max("text_raw").alias("top"))  # one row
    both = text.join(names, "dense_id", "full_outer").crossJoin(F.broadcast(top))
    band = F.coalesce(F.col("text_raw") / F.when(F.col("top") > 0, F.col("top")) * 850, F.lit(0.0))
    name = F.coalesce("name_raw", F.lit(0.0))
    return both.select("dense_id", F.when(name > 0, name + 0.3 * band).otherwise(band).alias("score"))


def suggestions(corpus: Corpus, query: str, limit: int = 5) -> DataFrame:
    """As ``search.suggestions``, with candidates from the words' postings instead of a scan; only where no word is shared, all
    names are compared."""
    tokens = X.py_name_tokens(query.split("<")[0].strip())
    candidates = corpus.postings(corpus.names, tokens, TOKEN_CAP)
    shared = corpus.records.join(F.broadcast(candidates), "dense_id") if tokens else None
    if shared is None or shared.isEmpty():
        return S.suggestions(corpus.records, query, limit)
    return S.suggestions(shared, query, limit)
