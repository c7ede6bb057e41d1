"""Corpora of the test tables, built once in the shared folder and found again by the state of their tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from ..functions.vocab import FIELD_BOOST
from ..operators.corpus import Corpus
from ..session import shared_dir
from ..sources import records as R
from ..storage import Files

#: Raised when what is written changes.
LAYOUT = 2


def _root(spark: SparkSession, sf: str, table: str) -> str:
    state = Files(spark).state(f"{sf}/{table}.parquet")
    return f"{shared_dir(spark)}/corpus-{table}-{hashlib.sha256(f'{LAYOUT} {sf} {state}'.encode()).hexdigest()[:16]}"


def documents(spark: SparkSession, sf: str) -> Corpus:
    """The documents table, text only, in two segments: even ids, then odd ones."""
    records = R.documents(spark, sf)
    corpus = Corpus(spark, _root(spark, sf, "documents"), records, {"docs": FIELD_BOOST["docs"]})
    for segment, rows in (("even", "dense_id % 2 = 0"), ("odd", "dense_id % 2 <> 0")):
        if segment not in corpus.text.segments():
            corpus.add(records.where(rows), segment)
    return corpus


def parts(spark: SparkSession, sf: str) -> Corpus:
    """The part table as records of types."""
    records = R.parts(spark, sf)
    corpus = Corpus(spark, _root(spark, sf, "part"), records)
    if "all" not in corpus.text.segments():
        corpus.add(records, "all")
    return corpus
