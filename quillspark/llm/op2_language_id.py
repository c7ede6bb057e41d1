"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle's out-of-place distance).

A profile is the list of a language's ``RANKS`` most frequent n-grams of one to three letters, word boundaries
marked. A document's own list is made the same way from its whole text; for each language the distance adds up how far
each of the document's n-grams is out of place, ``RANKS`` for one that the profile lacks, and the nearest language
wins (ties: the first in alphabetical order). The score is 1 - nearest / second distance, mapped to 0.5 to 1 when there
are two languages or more.

N-grams are exact: code points in base 2**21 fit one 64-bit number. Texts are handled in Arrow batches of many documents.

Learning: profiles are counted from at most ``TRAIN`` documents (in expectation) per language, picked by a hash of
the id; all of them when there are fewer. Cases: null text, or text without a letter: ``und``, score 0. Null lang teaches
nothing. Repeated rows are rows. With no learned language at all every prediction is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Tables, arrow_rows

RANKS, TRAIN = 400, 20_000
_SHIFT = np.int64(21)


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1


_letter = np.zeros(0x110000, np.int8)  # 0: not asked yet, 1: letter, 2: not


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of what is no letter become one 0, at both ends too."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    new = np.unique(c[_letter[c] == 0])
    for x in new.tolist():
        _letter[x] = 1 if chr(x).isalpha() else 2
    c = np.concatenate([[0], np.where(_letter[c] == 1, c, 0), [0]])
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text, and how often each occurs."""
    c = _codes(text) if text else np.empty(0, np.int64)
    if not c.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (c[:-1] << _SHIFT) | c[1:]
    three = (two[:-1] << _SHIFT) | c[2:]
    inner = c[1:-1] != 0  # a boundary may begin or end an n-gram, not stand within
    return np.unique(np.concatenate([c[c != 0], two, three[inner]]), return_counts=True)


def ranked(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram's number."""
    if len(g) > 4 * RANKS:
        g, n = (x[n >= np.partition(n, len(n) - RANKS)[len(n) - RANKS]] for x in (g, n))
    return g[np.lexsort((g, -n))[:RANKS]]


def _count() -> Callable:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list] = {}

        def merged(lang):
            parts = waiting.pop(lang) + ([total[lang]] if lang in total else [])
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total[lang] = g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for lang, text in W.rows(batches, "lang", "text"):
            g, n = grams(text)
            if len(g):
                waiting.setdefault(lang, []).append((g, n))
                if len(waiting[lang]) >= 200:
                    merged(lang)
        for lang in [*waiting]:
            merged(lang)
        for lang, (g, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], schema=schema)

    return run


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles by language: ``RANKS`` numbers each, from rows with lang that are not held out."""
    spark = docs.sparkSession
    arrow_rows(spark)
    known = docs.where(F.col("lang").isNotNull() & F.coalesce(~held_out(), F.lit(True)))
    share = {r["lang"]: min(1.0, TRAIN / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not share:
        return {}
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in share.items() for x in kv)), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit * 1_000_000)
    counts = chosen.select("lang", "text").mapInArrow(_count(), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= RANKS)
    found: dict[str, list[int]] = {}
    for lang, gram, _, _ in sorted(top.collect(), key=lambda x: (x[0], x[3])):  # RANKS rows a language
        found.setdefault(lang, []).append(gram)
    return found


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        g, n = grams(text)
        if not len(g) or not self.langs:
            return "und", 0.0
        own = ranked(g, n)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        rank = self.rank[at]
        distance = np.where(rank < 0, RANKS, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        if len(self.langs) == 1:
            return self.langs[0], 1 - float(distance[0]) / (RANKS * len(own))
        best = int(distance.argmin())
        second = float(np.partition(distance, 1)[1])
        return self.langs[best], 1 - 0.5 * (float(distance[best]) / second if second else 1.0)


def _predict(profiles) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        p = Profiles(profiles.value)
        for b in batches:
            got = [(doc, *p.predict(text)) for doc, text in W.rows([b], "doc_id", "text")]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score; only doc_id and text of ``docs`` are read."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(profiles)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learn(docs.select("doc_id", "lang", "text")))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
