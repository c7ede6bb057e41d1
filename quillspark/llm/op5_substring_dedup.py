"""Substring dedup with prefix-partitioned suffix trees.

The suffixes in question start a window of ``window`` words. A window's pivot is the least hash of ``K`` words among its
first ``SPAN`` places; equal windows have equal pivots at equal offsets, and neighbouring windows share one, so a
segment of text (at most window + SPAN - 1 words) stands for up to SPAN suffixes. Segments are split by the words from
their pivot on: prefixes of K words that occur in one document only are dropped before any text moves; those with
more than ``GROUP`` segments are split by longer prefixes, twice, so that a group fits in a task's memory. Each
task builds the trees of its groups: the tree's nodes at depths 1, 2, 4 ... get names from their halves, suffixes
that agree on the first ``window`` words are leaves below one deep inner node (a maximal repeat or a part of one), and
a leaf whose node also has a leaf in a document with a smaller doc_id is a repeat. Groups that stay too large with the
longest prefix that all windows of a segment hold are nearly one node each: their windows are counted by
hash and the node's smallest doc_id comes from an aggregation, not from one task.

A repeat's words are removed. Windows are judged on the input. Cases: null text has no words; rows with null doc_id are
left alone and make nothing else a repeat; rows with one doc_id don't make each other repeats; texts shorter than a
window are left alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import Tables, arrow_rows, join_small, partitions

GROUP = 20_000
CHUNK = 4_000
_LONG, _INT = pa.int64(), pa.int32()


def _shape(window: int) -> tuple[int, int, tuple[int, int]]:
    """K, SPAN and the two longer prefix lengths; all lie within every window that has the pivot."""
    k = min(8, max(1, window // 2))
    span = max(1, min(32, window - k))
    longest = window - span + 1
    return k, span, (min(2 * k, longest), longest)


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pivots(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one pivot: first window, last window, place of the pivot; and all hashes of K words."""
    k, span, _ = _shape(window)
    g = W.windows(h, k)
    n = len(h) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, g
    # minima by doubling give the least hash and its first place in every SPAN places
    least, at, have = g, np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        later = least[step:] < least[: len(least) - step]
        least, at = np.where(later, least[step:], least[: len(least) - step]), np.where(later, at[step:], at[: len(at) - step])
        have += step
    at = at[:n]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.concatenate([first[1:] - 1, [n - 1]]), at[first], g


def _pivot_rows(window: int) -> Callable:
    schema = pa.schema([("p", _LONG), ("doc_id", _LONG), ("th", _LONG)])

    def run(batches):
        out = W.Out(schema, 100_000)
        for doc, th, text in W.rows(batches, "doc_id", "th", "text"):
            _, _, at, g = pivots(W.hashes(split(text)), window)
            keys = np.unique(g[at]).view(np.int64)
            yield from out.add(keys, np.full(len(keys), doc), np.full(len(keys), th))
        yield from out.flush()

    return run


_SEGMENT = "p0 long, p1 long, p2 long, doc_id long, th long, start int, windows int, words binary"


def _segments(window: int) -> Callable:
    schema = pa.schema([("p0", _LONG), ("p1", _LONG), ("p2", _LONG), ("doc_id", _LONG), ("th", _LONG), ("start", _INT), ("windows", _INT), ("words", pa.binary())])

    def run(batches):
        columns: list[list] = [[] for _ in schema]
        size = 0
        for doc, th, want, text in W.rows(batches, "doc_id", "th", "want", "text"):
            w = split(text)
            h = W.hashes(w)
            first, last, at, g = pivots(h, window)
            use = np.flatnonzero(np.isin(g[at], np.array(want, np.int64).view(np.uint64)))
            longer = [W.windows(h, n)[at[use]].view(np.int64) for n in _shape(window)[2]]
            for i, p1, p2 in zip(use.tolist(), *(x.tolist() for x in longer), strict=True):
                s, e = int(first[i]), int(last[i])
                text_ = b" ".join(w[s : e + window])
                for c, v in zip(columns, (int(g[at[i]].view(np.int64)), p1, p2, doc, th, s, e - s + 1, text_), strict=True):
                    c.append(v)
                size += len(text_)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                columns, size = [[] for _ in schema], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def deep_nodes(segments: list[list[bytes]], windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the trees over ``segments``: index of the segment, and the node of depth ``window`` above the leaf.

    A node's name is made from those of its two halves, level by level, so that equal names are equal strings.
    """
    text = pd.factorize(np.array([w for s in segments for w in s], object))[0]
    name, have = text, 1
    while have < window:
        step = min(have, window - have)
        ahead = np.full(len(name), -1, np.int64)
        ahead[: len(name) - step] = name[step:]
        name = pd.factorize(name * (len(text) + 2) + ahead + 1)[0]
        have += step
    begin = np.concatenate([[0], np.cumsum([len(s) for s in segments])[:-1]])
    segment = np.repeat(np.arange(len(segments)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    return segment, name[begin[segment] + offset]


_FOUND = "doc_id long, th long, start int, mask long"


def _trees(window: int) -> Callable:
    schema = pa.schema([("doc_id", _LONG), ("th", _LONG), ("start", _INT), ("mask", _LONG)])

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, doc, th, start, windows, text = zip(*rows, strict=True)
        doc, n = np.array(doc), np.array(windows)
        segment, node = deep_nodes([t.split() for t in text], n, window)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[segment])
        again = least[node] < doc[segment]
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        mask = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(mask, segment[again], np.int64(1) << offset[again])
        use = mask != 0
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[use], _LONG), pa.array(np.array(th)[use], _LONG), pa.array(np.array(start)[use], _INT), pa.array(mask[use], _LONG)], schema=schema)

    def run(batches):
        rows: list[tuple] = []
        for row in W.rows(batches, "key", "doc_id", "th", "start", "windows", "words"):
            if len(rows) >= CHUNK and rows[-1][0] != row[0]:  # rows come in the order of their groups
                yield from found(rows)
                rows = []
            rows.append(row)
        if rows:
            yield from found(rows)

    return run


def _hot_windows(window: int) -> Callable:
    schema = pa.schema([("w", _LONG), ("doc_id", _LONG), ("th", _LONG), ("start", _INT)])

    def run(batches):
        out = W.Out(schema)
        for doc, th, start, n, text in W.rows(batches, "doc_id", "th", "start", "windows", "words"):
            h = W.windows(W.hashes(text.split()), window)[:n].view(np.int64)
            yield from out.add(h, np.full(n, doc), np.full(n, th), np.arange(start, start + n, dtype=np.int32))
        yield from out.flush()

    return run


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, th (hash of the text), start, mask: windows start + i, for bit i of mask, start in a smaller doc_id too.

    Start -1: all windows of the text.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    tables = Tables(spark, "substring")
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    p = tables.save(d.mapInArrow(_pivot_rows(window), "p long, doc_id long, th long"), "pivots")
    # A text that a smaller doc_id has too is a repeat as a whole, and adds nothing to the trees.
    texts = tables.save(p.groupBy("doc_id", "th").agg(F.count("*").alias("n")), "texts")
    least = texts.groupBy("th").agg(F.min("doc_id").alias("least"))
    copies = tables.save(texts.join(least, "th").where("doc_id > least").select("doc_id", "th"), "copies")
    both = (F.min("doc_id") < F.max("doc_id")) & (F.min("th") < F.max("th"))
    shared = p.groupBy("p").agg(both.alias("both")).where("both").select("p")
    want = p.join(shared, "p").groupBy("doc_id", "th").agg(F.collect_set("p").alias("want"))  # at most one text's pivots
    want = tables.save(want.join(copies, ["doc_id", "th"], "left_anti"), "wanted")
    tables.drop(p)
    tables.free_shuffles()
    seg = d.join(want, ["doc_id", "th"]).select("doc_id", "th", "want", "text")
    seg = tables.save(seg.mapInArrow(_segments(window), _SEGMENT), "segments")
    tables.drop(want)
    tables.free_shuffles()
    # The shortest prefix whose group fits. Prefixes with too large a group are at most rows / GROUP, level by level.
    large, rest = [], seg.select("p0", "p1", "p2", "start")
    for prefix in ("p0", "p1", "p2"):
        found = tables.save(rest.groupBy(prefix).agg(F.count("*").alias(f"size_{prefix}")).where(F.col(f"size_{prefix}") > GROUP), f"large-{prefix}")
        large.append(found)
        if not found.limit(1).count():
            break
        rest = tables.save(join_small(rest, found, [prefix], "start", "left_semi"), f"rest-{prefix}")
    key, groups = F.col("p0"), seg
    if len(large) == 3:  # groups too large with the longest prefix
        groups = join_small(groups, large[2], ["p2"], "start", "left_anti")
    if len(large) > 1:
        groups = join_small(join_small(groups, large[0], ["p0"], "start", "left"), large[1], ["p1"], "start", "left")
        key = F.when(F.col("size_p0").isNull(), F.col("p0")).when(F.col("size_p1").isNull(), F.col("p1")).otherwise(F.col("p2"))
    groups = groups.select(key.alias("key"), "doc_id", "th", "start", "windows", "words")
    n = max(partitions(spark), seg.count() // 50_000)
    found = groups.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_trees(window), _FOUND)
    if len(large) == 3:
        rest = join_small(seg, large[2], ["p2"], "start", "left_semi")
        hot = tables.save(rest.mapInArrow(_hot_windows(window), "w long, doc_id long, th long, start int"), "hot")
        least = hot.groupBy("w").agg(F.min("doc_id").alias("least"))
        found = found.unionByName(hot.join(least, "w").where("doc_id > least").select("doc_id", "th", "start", F.lit(1).cast("long").alias("mask")))
    whole = copies.select("doc_id", "th", F.lit(-1).alias("start"), F.lit(0).cast("long").alias("mask"))
    out = tables.save(found.unionByName(whole), "repeats")
    tables.drop(seg)
    del found, groups, rest, seg
    tables.free_shuffles()
    return out


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(window: int, digest: bool) -> Callable:
    schema = pa.schema([("doc_id", _LONG), ("n_words", _LONG), ("n_removed", _LONG), ("kept", pa.string())])

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for doc, text, found in W.rows(batches, "doc_id", "text", "found"):
            w = split(text)
            edge = np.zeros(len(w) + 1, np.int64)
            for x in found or ():
                if x["start"] < 0:
                    edge[0] += 1
                for i in range(x["mask"].bit_length()):
                    if x["mask"] >> i & 1:
                        edge[x["start"] + i] += 1
                        edge[x["start"] + i + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w) if not found else b" ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)
            kept = hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")
            rows.append((doc, len(w), int(gone.sum()), kept))
            size += len(kept)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def dedup(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by one space (with ``digest`` their SHA-256)."""
    gone = repeats(docs, window).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "found")
    d = docs.select("doc_id", "text")
    j = d.join(gone, (d["doc_id"] == F.col("_d")) & (F.xxhash64(d["text"]) == F.col("_h")), "left").select("doc_id", "text", "found")
    return j.mapInArrow(_remove(window, digest), _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50, True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50),
g AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') AS x FROM s),
m AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT g.doc_id, g.p FROM g JOIN m ON g.x = m.x WHERE g.doc_id > m.least),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM r),
l AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN l.gone IS NULL THEN w.w ELSE
    list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(l.gone, i)), lambda i: w.w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""
