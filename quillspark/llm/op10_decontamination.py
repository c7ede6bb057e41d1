"""Benchmark decontamination by spaced seeds.

Words are lower-cased and stripped of ASCII punctuation. Each mask looks at fixed positions of a span of words and ignores
the others, so a substituted word breaks only the seeds that look at it. Seeds of the benchmark are joined with those of
every place of every text; each hit gives an alignment (document, item, shift), which is verified once: over the
whole aligned overlap, the stretch with the best score (+1 for an equal word, -MISMATCH for a different one) must have
``min_words`` equal words. An item of at most ``min_words`` words must be there whole, with at most one word substituted.

The benchmark's seeds are broadcast in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark takes more passes over
the texts, it is never cut. Items with one word sequence are one item while searching, and all of them are reported.

Cases: null or empty texts and items match nothing. Items of at most ``min_words`` words, or shorter than a mask's span, are sought by three masks of their own
length, each of which ignores every third word, so that any one substitution is ignored by one of them; items under
``SHORTEST`` words say nothing inside a longer text and match only texts of just their words. Repeated rows give repeated results in
``matches`` and count once in ``contaminated``. Rows with null doc_id are searched and reported with the null. Texts are searched
whole, of any length; other columns are not read, so their names may be any. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import arrow_rows

#: 1: the word at this position is looked at.
MASKS = ("11101100111", "11011011011", "10111101101")
MISMATCH, SHORTEST, BLOCK_WORDS = 3, 6, 300_000
_FILTER_BITS = 22


def masks_of(n: int, min_words: int) -> tuple[str, ...]:
    """Masks for items of ``n`` words."""
    return MASKS if n >= max(len(MASKS[0]), min_words + 1) else tuple("".join("01"[i % 3 != k] for i in range(n)) for k in range(3))


_TABLE = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for at, look in enumerate(mask):
        if look == "1" and n > 0:
            out = W.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at : at + n])
    return out


class Seeds:
    """Seeds of one block of items, sorted, with a bit filter in front."""

    def __init__(self, items: dict[bytes, list], min_words: int):
        self.ids = list(items.values())
        self.words = [W.hashes(k.split()) for k in items]
        self.whole = {w.tobytes(): i for i, w in enumerate(self.words) if len(w) < SHORTEST}
        by_masks: dict[tuple[str, ...], list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) >= SHORTEST:
                by_masks.setdefault(masks_of(len(w), min_words), []).append(i)
        self.masks = [mask for masks in by_masks for mask in masks]
        found = [(self.masks.index(mask), i, seeds(self.words[i], mask)) for masks, items in by_masks.items() for mask in masks for i in items]
        h = np.concatenate([s for _, _, s in found]) if found else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.mask = np.concatenate([np.full(len(s), m, np.int16) for m, _, s in found])[order] if found else np.empty(0, np.int16)
        self.item = np.concatenate([np.full(len(s), i, np.int32) for _, i, s in found])[order] if found else np.empty(0, np.int32)
        self.at = np.concatenate([np.arange(len(s), dtype=np.int32) for _, _, s in found])[order] if found else np.empty(0, np.int32)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.h >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, shift) of every seed of the word hashes ``h`` that the block has: place in h less place in the item."""
        for m, mask in enumerate(self.masks):
            s = seeds(h, mask)
            may = np.flatnonzero(self.filter[s >> np.uint64(64 - _FILTER_BITS)])
            lo, hi = np.searchsorted(self.h, s[may], "left"), np.searchsorted(self.h, s[may], "right")
            for p, a, b in zip(may[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                for k in range(a, b):
                    if self.mask[k] == m:
                        yield int(self.item[k]), p - int(self.at[k])

    def verify(self, h: np.ndarray, item: int, shift: int, min_words: int) -> tuple[int, int, int] | None:
        """Equal words, compared words and start of the best stretch, if it is long enough."""
        w = self.words[item]
        lo, hi = max(0, shift), min(len(h), shift + len(w))
        same = h[lo:hi] == w[lo - shift : hi - shift]
        if len(w) <= min_words:
            equal = int(same.sum())
            return (equal, len(w), lo) if equal >= len(w) - 1 else None
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
        gain = total - np.minimum.accumulate(total)
        end = int(gain.argmax())
        start = end - 1 - int(np.argmin(total[:end][::-1])) if end else 0
        equal = int(same[start:end].sum())
        return (equal, end - start, lo + start) if equal >= min_words else None


def _search(block, min_words: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("equal_words", pa.int64()), ("compared_words", pa.int64()), ("start_word", pa.int64())])

    def run(batches):
        b: Seeds = block.value
        docs: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x for _, x in docs])
            ends = np.cumsum([len(x) for _, x in docs])
            best: dict[tuple[int, int], tuple] = {}
            # texts are searched together; an alignment belongs to the text that its first common word lies in
            seen = set()
            for item, shift in b.hits(h):
                if (item, shift) in seen:
                    continue
                seen.add((item, shift))
                n = len(b.words[item])
                for d in range(int(np.searchsorted(ends, max(shift, 0), "right")), len(docs)):
                    first = int(ends[d]) - len(docs[d][1])
                    if first >= shift + n:
                        break
                    if got := b.verify(docs[d][1], item, shift - first, min_words):
                        best[d, item] = max(best.get((d, item), got), got)
            for d, (_, words) in enumerate(docs):
                if len(words) < SHORTEST and (item := b.whole.get(words.tobytes())) is not None:
                    best[d, item] = (len(words), len(words), 0)
            rows = [(docs[d][0], i, *got) for (d, item), got in sorted(best.items()) for i in b.ids[item]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        size = 0
        for doc, text in W.rows(batches, "doc_id", "text"):
            h = W.hashes(tokens(text))
            if len(h):
                docs.append((doc, h))
                size += len(h)
            if size > 50_000:
                yield from found()
                docs, size = [], 0
        if docs:
            yield from found()

    return run


def _blocks(benchmark: DataFrame) -> Iterator[dict[bytes, list]]:
    items: dict[bytes, list] = {}
    size = 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        t = tokens(text)
        if not t:
            continue
        items.setdefault(b" ".join(t), []).append(item)
        size += len(t)
        if size > BLOCK_WORDS:
            yield items
            items, size = {}, 0
    if items:
        yield items


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 13) -> DataFrame:
    """doc_id, item_id, equal_words, compared_words, start_word: the best verified stretch of each pair."""
    spark = docs.sparkSession
    arrow_rows(spark)
    schema = "doc_id long, item_id long, equal_words long, compared_words long, start_word long"
    out = None
    for items in _blocks(benchmark):
        block = spark.sparkContext.broadcast(Seeds(items, min_words))
        part = docs.select("doc_id", "text").mapInArrow(_search(block, min_words), schema.replace("item_id", "item")).withColumnRenamed("item", "item_id")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13) -> DataFrame:
    """doc_id of every document with a verified match, once."""
    return matches(docs, benchmark, min_words).select("doc_id").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified match (rows with null doc_id go together)."""
    bad = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("doc_id", "_q10_doc")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_q10_doc"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
