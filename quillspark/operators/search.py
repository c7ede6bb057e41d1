"""Lookup, hybrid ranked search, filters, suggestions and related records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import DEFINITIONS, INTENTS, KIND_WEIGHT, MEMBERS, OTHER_WEIGHT, SOURCE_WEIGHT


def record_weight() -> Column:
    kind = F.col("kind")
    out = F.when(F.lit(False), F.lit(0.0))
    for k, w in KIND_WEIGHT.items():
        out = out.when(kind == k, F.lit(w))
    for s, w in SOURCE_WEIGHT.items():
        out = out.when(F.col("source") == s, F.lit(w))
    return out.otherwise(F.lit(OTHER_WEIGHT))


def passes(kind: str | None = None, source: str | None = None, module: str | None = None, crate: str | None = None, categories: str | None = None, draft: bool | None = None) -> Column:
    """Kind: equal or contained; source and crate: equal; module: contained, any case; categories: any of a comma
    list; draft False: no drafts (True filters nothing)."""
    conditions = [F.lit(True)]
    if kind:
        conditions.append((F.col("kind") == kind) | F.col("kind").contains(kind))
    if source:
        conditions.append(F.col("source") == source)
    if module:
        conditions.append(F.lower("module").contains(module.lower()))
    if crate:
        conditions.append(F.col("crate_name") == crate)
    if categories and (wanted := [c.strip() for c in categories.split(",") if c.strip()]):
        conditions.append(F.arrays_overlap("categories", F.array(*map(F.lit, wanted))))
    if draft is False:
        conditions.append(~F.col("draft"))
    return reduce(lambda a, b: a & b, conditions)


def prepare(records: DataFrame) -> DataFrame:
    """Adds what relevance and coverage look at, so that each name is split once a row and not once a subject."""
    raw = X.base_name("name")
    words = {"_words": X.name_tokens(raw), "_owner": X.name_tokens(X.base_name("owner")), "_path": X.name_tokens("full_path"), "_module": X.name_tokens("module")}
    out = records.withColumns({"_raw": F.lower(raw), "_leaf": X.norm_key(raw), **words})
    single = lambda c: F.concat(c, F.transform(c, X.singular))
    return out.withColumns({"_one": X.singular("_leaf"), "_words": single(F.col("_words")), "_module": single(F.col("_module"))})


def relevance(subjects: list[str], surfaces: list[str]) -> Column:
    """Evidence that a prepared record is what the subjects name: name over owner over path, plus module and kind. The
    subjects are the caller's few literals, so the fold over them is written out as one expression."""
    if not subjects:
        return F.lit(1.0)
    raw, leaf, one, words, owner, path, module = (F.col(f"_{c}") for c in ("raw", "leaf", "one", "words", "owner", "path", "module"))
    exact = raw.isin(*surfaces) if surfaces else F.lit(False)
    typed = exact & ~raw.isin(*INTENTS)
    score = F.lit(1.0) + F.when(typed, F.when(one == subjects[0], 10.5).otherwise(8.0)).otherwise(0.0)
    hits = F.when(typed, 1).otherwise(0)
    for k, s in enumerate(subjects):
        first = k == 0
        named = F.array_contains(words, s)
        within = leaf.contains(s) if len(s.encode()) > 3 else F.lit(False)
        skip = exact & (one == s)
        gain = F.when(skip, 0.0).when(one == s, 6.5 if first else 4.0).when(named, 3.7 if first else 2.2).when(within, 2.9 if first else 1.4)
        score += gain.when(F.array_contains(owner, s), 0.9).when(F.array_contains(path, s), 0.8).otherwise(0.0)
        hits += F.when(~skip & ((one == s) | named | within), 1).otherwise(0)
    score += F.when(hits > 1, (hits - 1) * 1.2).otherwise(0.0)
    if len(subjects) > 1:
        score += F.when(hits == len(subjects), 3.0).otherwise(0.0)
    cover = [F.when(F.array_contains(module, s), 1).otherwise(0) for s in subjects]
    score += F.least(reduce(lambda a, b: a + b, cover), F.lit(2)) * 1.5
    return score + F.when(F.col("kind").isin(*DEFINITIONS), 0.5).otherwise(0.0)


def name_coverage(subjects: list[str]) -> Column:
    return F.size(F.array_intersect("_words", F.array(*map(F.lit, subjects)))) if subjects else F.lit(0)


def docs_coverage(subjects: list[str]) -> Column:
    both = F.lower(F.concat_ws("\n", "docs", "signature"))
    return F.lit(1.0) + 0.12 * reduce(lambda a, b: a + b, (F.when(both.contains(s), 1).otherwise(0) for s in subjects), F.lit(0))


def symbol_rank() -> Column:
    kind = F.col("kind")
    return F.when(kind.isin(*DEFINITIONS), 0).when(kind == "module", 1).when(kind.isin(*MEMBERS), 2).otherwise(3)


def definition_key() -> Column:
    named = F.concat_ws("|", F.lit("rustdoc"), "source_ref", "kind", X.base_name("owner"), "name")
    return F.when((F.col("source") == "rustdoc") & (F.coalesce("source_ref", F.lit("")) != ""), named).otherwise(F.col("hash"))


def first_of(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def suggestions(records: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """dense_id, score of near misses: shared words (the last one most), common prefix, less the edit distance; without any
    shared word, names within edit distance 3."""
    leaf = X.py_norm_key(query.split("<")[0].strip())
    tokens, prefix = X.py_name_tokens(query.split("<")[0].strip()), X.py_norm_key(query).rpartition("::")[0]
    r = records.withColumn("_n", X.norm_key(X.base_name("name"))).withColumn("_w", X.name_tokens(X.base_name("name")))
    if len(leaf.encode()) < 3:
        return r.where("false").select("dense_id", F.lit(0).alias("score"))
    shares = F.arrays_overlap("_w", F.array(*map(F.lit, tokens))) & (F.col("source") == "rustdoc") & (F.col("kind") != "field") if tokens else F.lit(False)
    any_ = r.agg(F.coalesce(F.bool_or(shares), F.lit(False)).alias("_any"))  # one row
    near = (F.abs(F.octet_length("_n") - len(leaf.encode())) <= 3) & F.levenshtein("_n", F.lit(leaf), 3).between(0, 3)
    c = r.crossJoin(F.broadcast(any_)).where(F.when(F.col("_any"), shares).otherwise(near))
    score = F.when(F.array_contains("_w", tokens[-1]), 50).otherwise(0) if tokens else F.lit(0)
    for t in tokens:
        if t != tokens[-1]:
            score += F.when(F.array_contains("_w", t), 12).otherwise(0)
    score += 2 * X.common_prefix("_n", F.lit(leaf)) - F.least(F.levenshtein("_n", F.lit(leaf)), F.lit(12))
    if "::" in X.py_norm_key(query):
        m = X.norm_key("module")
        score += F.when(m.endswith(prefix) | F.lit(prefix).endswith(m), 10).otherwise(0)
    s = c.withColumn("score", score).where("score > 0")
    best = s.agg(F.max("score").alias("_best"))
    return s.crossJoin(F.broadcast(best)).where("score >= _best - 60").orderBy(F.desc("score"), "dense_id").limit(limit).select("dense_id", "score")


def related(records: DataFrame, owner: str, but: int, limit: int = 12) -> DataFrame:
    """The first members of an owner in record order, then by name."""
    members = records.where((X.base_name("owner") == owner) & F.col("kind").isin(*MEMBERS) & (F.col("dense_id") != but))
    return members.orderBy("dense_id").limit(limit).orderBy("name", "dense_id")


def signature_lookup(records: DataFrame, signature: str) -> DataFrame:
    """2: the same signature, 1: one begins with the other (both longer than 12 bytes), best first."""
    import re

    wanted = re.sub(r",(?=[)>\]}])", "", re.sub(r"\s+", "", signature))
    own = X.normalized_signature("signature")
    both = (F.octet_length(own) > 12) & F.lit(len(wanted.encode()) > 12)
    score = F.when(own == wanted, 2).when(both & (own.startswith(wanted) | F.lit(wanted).startswith(own)), 1)
    return records.withColumn("score", score).where(F.col("score").isNotNull() & F.col("signature").contains("fn ")).orderBy(F.desc("score"), "full_path", "dense_id")


def examples_rerank(hits: DataFrame, terms: list[str]) -> DataFrame:
    """Orders what is left after the limit by how many terms the example's text has."""
    n = reduce(lambda a, b: a + b, (F.when(F.lower("docs").contains(t), 1).otherwise(0) for t in terms))
    return hits.withColumn("relevance", n).orderBy(F.desc("relevance"), F.desc("score"), "dense_id")


def fanout(records: DataFrame, corpus: str, tokens: Column, terms: list[str], per_corpus: int = 8) -> DataFrame:
    """BM25 within each corpus by its own statistics, best ``per_corpus`` of each. Statistics are summed map-side into a row a corpus."""
    r = records.select(corpus, "dense_id", tokens.alias("_t"))
    stats = r.groupBy(corpus).agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"), *(F.count_if(F.array_contains("_t", x)).alias(f"df{i}") for i, x in enumerate(terms)))
    tf = lambda term: F.size(F.filter("_t", lambda x: x == term)).cast("double")
    slim = r.where(F.arrays_overlap("_t", F.array(*map(F.lit, terms)))).select(corpus, "dense_id", F.size("_t").alias("dl"), *(tf(x).alias(f"tf{i}") for i, x in enumerate(terms)))
    j = slim.join(stats, corpus)
    idf = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    norm = 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl"))
    s = reduce(lambda a, b: a + b, (idf(i) * F.col(f"tf{i}") * 2.2 / (F.col(f"tf{i}") + norm) for i in range(len(terms))))
    s = j.select(corpus, "dense_id", F.round(s, 6).alias("score"))
    w = Window.partitionBy(corpus).orderBy(F.desc("score"), "dense_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_corpus)
