"""Periodic runs of words by a harmonic grid of prefix hashes.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, ``TIMES`` * q) words that no
neighbouring word extends keeping that period. Every stretch of period p with 4p words or more holds four neighbouring
multiples of p, so the grid of all (p, kp), n log n points in a text of n words, meets each run. A point counts as a
candidate only if the words at its four multiples are equal; for all candidates at once a binary search over prefix
hashes finds how far the words at distance p agree to both sides (the longest common extension). Then the words
themselves are compared over the whole stretch (where a hash lied, its period is scanned over the whole text), equal stretches
are one run under their smallest period, and the rest go.

Grids are worked off in slices of ``POINTS`` points, so memory is a few arrays of the text's length and of that size.
Of the candidates in a row of one period only the first is searched; those that its stretch covers are settled by it.

Cases: null or empty text has no words and no runs. A text is handled whole, however long, in one task of its own row;
no row depends on another, so hot groups, repeated rows and ties between documents don't matter. Ties between runs: the
longest run is the one with the smallest start, then period. Null doc_id: the text stays as it is. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import arrow_rows

LEAST, TIMES = 6, 4
POINTS = 1 << 18
_rng = np.random.default_rng(12)
_BASE = np.uint64(int(_rng.integers(1 << 62)) * 4 + 1)
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


class Prefixes:
    """Prefix hashes of word numbers: sums of value * base**place modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        self.power = np.ones(len(ids) + 1, np.uint64)
        np.cumprod(np.full(len(ids), _BASE), out=self.power[1:])
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(W.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def equal(self, at: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the n words at ``at`` and those p further have one hash."""
        return (self.sums[at + n] - self.sums[at]) * self.power[p] == self.sums[at + p + n] - self.sums[at + p]

    def extents(self, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of the widest stretch around ``at`` whose words agree with those p further."""
        n = len(self.sums) - 1
        ahead = _search(lambda m: self.equal(at, m, p), n - p - at)
        back = _search(lambda m: self.equal(at - m, m, p), at)
        return at - back, at + ahead + p


def _search(holds, most: np.ndarray) -> np.ndarray:
    """The largest m up to ``most`` for which ``holds``, which is true up to some m and false beyond."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        yes = holds(mid)
        low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
    return low


def _scan(ids: np.ndarray, p: int) -> list[tuple[int, int]]:
    """All stretches of one period by comparing words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids[:-p] == ids[p:]).astype(np.int8), [0]])))
    return [(start, end + p) for start, end in edge.reshape(-1, 2).tolist()]


def _slices(n: int):
    """Periods and grid points with their three next multiples inside the text, a bounded number at a time."""
    periods = np.arange(1, n // TIMES + 1)
    counts = (n - 1) // periods - (TIMES - 2)  # k with (k + 3) p < n
    ends = np.cumsum(counts)
    low = 0
    while low < len(periods):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + POINTS, "right")))
        c, p = counts[low:high], np.repeat(periods[low:high], counts[low:high])
        k = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        yield p, k * p
        low = high


def find_runs(ids: np.ndarray) -> np.ndarray:
    """Rows of start, length, period, by start and period, of a text given as word numbers."""
    n = len(ids)
    if n < LEAST:
        return np.empty((0, 3), np.int64)
    hashes, found = None, []
    for p, at in _slices(n):
        here = ids[at]
        keep = (here == ids[at + p]) & (here == ids[at + 2 * p]) & (here == ids[at + 3 * p])
        p, at = p[keep], at[keep]
        while len(p):
            hashes = hashes or Prefixes(ids)
            first = np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + p[1:])])
            start, end = hashes.extents(at[first], p[first])
            found.append(np.stack([start, end, p[first]], axis=1))
            group = np.cumsum(first) - 1  # candidates in a row, with the stretch of their first
            left = ~first & (at + p >= end[group])
            p, at = p[left], at[left]
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.concatenate(found)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, TIMES * rows[:, 2])]
    rows = _verified(ids, rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))])
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _verified(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Start, length and smallest period of each stretch, compared word by word with the words next to it; one that fails
    brings in all stretches of its period. ``rows`` stand by start, end, period, so the first of equal stretches has the smallest period."""
    out: dict[tuple[int, int], int] = {}
    for start, end, p in rows[:, :3].tolist():
        if (start, end) in out:
            continue
        right = np.array_equal(ids[start : end - p], ids[start + p : end]) and (start == 0 or ids[start - 1] != ids[start - 1 + p]) and (end == len(ids) or ids[end] != ids[end - p])
        for stretch in [(start, end)] if right else _scan(ids, p):
            if stretch[1] - stretch[0] >= max(LEAST, TIMES * p):
                out[stretch] = min(p, out.get(stretch, p))
    return np.array([(start, end - start, p) for (start, end), p in out.items()], np.int64).reshape(-1, 3)


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each different word, so that equal numbers are equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's text: for a tenth of the ids the words from some place on repeat with a period, both by the id's crc32."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[: n - a]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _task(planted: bool):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, out = b.slice(at, 64), []
                for doc, text in W.rows([part], "doc_id", "text"):
                    words = (text or "").encode().split()
                    if planted:
                        words = repeat_tail(words, doc)
                    runs = find_runs(numbers(words))
                    stay = words if not len(runs) else [w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k]
                    out.append((doc, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], b" ".join(stay).decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed: the text's words without
    those that repeat a period. ``planted``: work on the texts of ``repeat_tail``."""
    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_task(planted), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), planted=True)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = F.expr("array_sort(runs, (a, b) -> CASE WHEN a.length <> b.length THEN IF(a.length > b.length, -1, 1) WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) ELSE IF(a.period < b.period, -1, IF(a.period > b.period, 1, 0)) END)")
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
