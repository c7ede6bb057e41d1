"""Building a corpus: dedup-merge, facets, inverted indexes and text statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocab import B, K1, SYMBOL_CAP, TOKEN_CAP


def drop_tuple_fields(records: DataFrame) -> DataFrame:
    """Fields whose name is a number say nothing."""
    return records.where(~((F.col("source") == "rustdoc") & (F.col("kind") == "field") & F.col("name").rlike("^[0-9]+$")))


def dedup_merge(rows: DataFrame, key: str, ord_: str, identity: list[str], longest: str, first_set: dict[str, str]) -> DataFrame:
    """One row a key: the longest ``longest`` in bytes (the first of equals), the first value of ``first_set`` columns that is set
    ('' : not empty, 'null': not null), the first row's identity, which must be that of all rows; ``copies``, ``ord``."""
    o = F.col(ord_)
    ident = F.struct(*identity)
    same = F.min(ident) == F.max(ident)
    out = [F.max_by(F.col(longest), F.struct(F.octet_length(longest), -o)).alias(longest)]
    out += [F.min_by(F.when(F.col(c) != "", F.col(c)) if how == "" else F.col(c), F.when((F.col(c) != "") if how == "" else F.col(c).isNotNull(), o)).alias(c) for c, how in first_set.items()]
    out += [F.min_by(F.col(c), o).alias(c) for c in identity] + [F.count("*").alias("copies"), F.min(o).alias(ord_), same.alias("_same")]
    merged = rows.groupBy(key).agg(*out)
    clash = F.when(F.col("_same"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("records of different identity share the id "), F.col(key))).cast("boolean"))
    return merged.where(clash).drop("_same")


def merge_examples(rows: DataFrame, key: str, ord_: str) -> DataFrame:
    """Examples of a key's rows in order; those of later rows that are there already are left out, the first row's own
    list is kept as it is."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), "examples"))).alias("l"))
    first = F.col("l")[0]["examples"]
    later = F.flatten(F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), lambda x: x["examples"]))
    return lists.select(key, F.concat(first, F.array_except(later, first)).alias("examples"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def capped(pairs: DataFrame, key: str, cap: int | None) -> DataFrame:
    """The first ``cap`` records of each key, with their places as ``ord``; None: all, without places."""
    if cap is None:
        return pairs
    w = Window.partitionBy(key).orderBy("dense_id")
    return pairs.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= cap)


def symbol_index(records: DataFrame, cap: int | None = SYMBOL_CAP) -> DataFrame:
    """key, dense_id, ord: keys of name, path, owner and module, paths also without the record's crate, first ``cap`` records of each."""
    name, owner = X.base_name("name"), F.coalesce(X.base_name("owner"), F.lit(""))
    leaf, crate = X.norm_key(name), F.coalesce(X.norm_key("crate_name"), F.lit("")) if "crate_name" in records.columns else F.lit("")
    module = F.when(F.coalesce("module", F.lit("")) != "", X.norm_key(F.concat_ws("::", "module", F.nullif(owner, F.lit("")), name)))
    paths = F.array_compact(F.array(X.norm_key("full_path"), module))
    short = F.transform(F.filter(paths, lambda p: (crate != "") & p.startswith(F.concat(crate, F.lit("::")))), lambda p: F.substr(p, F.length(crate) + 3))
    keys = F.concat(F.array(leaf, F.when(owner != "", X.norm_key(F.concat_ws("::", owner, leaf))).otherwise("")), paths, short)
    pairs = records.where("source = 'rustdoc'").select(F.explode(F.array_distinct(keys)).alias("key"), "dense_id").where("key <> ''")
    return capped(pairs, "key", cap)


def token_index(records: DataFrame, cap: int | None = TOKEN_CAP) -> DataFrame:
    """term, dense_id, ord: words of names and owners; fields have none."""
    tokens = F.array_distinct(F.concat(X.name_tokens(X.base_name("name")), X.name_tokens(X.base_name(F.coalesce("owner", F.lit(""))))))
    pairs = records.where("source = 'rustdoc' AND kind <> 'field'").select(F.explode(tokens).alias("term"), "dense_id")
    return capped(pairs, "term", cap)


def field_stats(records: DataFrame, tokens: Column, terms: list[str]) -> DataFrame:
    """One row: n, avgdl and df of each term. No shuffle but that of one row a task."""
    t = records.select(tokens.alias("t"))
    return t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"), *(F.count_if(F.array_contains("t", x)).alias(f"df{i}") for i, x in enumerate(terms)))


def bm25(records: DataFrame, tokens: Column, terms: list[str], keep: list[str], boost: float = 1.0, score: str = "score") -> DataFrame:
    """``keep`` and the BM25 score of each record that has a term; ``matched``: how many of the terms it has.

    Two scans, of which the second carries the one row of statistics of the first; postings never move.
    """
    stats = field_stats(records, tokens, terms)
    scored = records.select(*keep, tokens.alias("_t")).where(F.arrays_overlap("_t", F.array(*map(F.lit, terms)))).crossJoin(F.broadcast(stats))
    size = F.size("_t")

    def one(i: int, term: str) -> Column:
        tf = F.size(F.filter("_t", lambda x: x == term)).cast("double")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("avgdl")))

    total = reduce(lambda a, b: a + b, (one(i, t) for i, t in enumerate(terms)))
    matched = F.size(F.array_intersect("_t", F.array(*map(F.lit, terms))))
    return scored.select(*keep, (total * boost).alias(score), matched.alias("matched"))
