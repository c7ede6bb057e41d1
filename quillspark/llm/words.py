"""Words and windows as 64-bit numbers, for operators that work on whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_LIMIT = 400_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Vocabulary(dict):
    """Hashes of words seen lately; emptied at a fixed size, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_vocabulary = _Vocabulary()


def hashes(words: list[bytes]) -> np.ndarray:
    """Bytes' own split() cuts at exactly the six blanks that the contracts name."""
    return np.fromiter(map(_vocabulary.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _M2
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A number for each n consecutive words, by doubling; empty when there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, have = mix(h), 1
    while have < n:
        step = min(have, n - have)
        m = len(out) - step
        out = mix(out[:m] * _M1 + mix(out[step:] ^ np.uint64(step)))
        have += step
    return out


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the named columns, a few at a time as Python values, so that long texts don't pile up."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


class Out:
    """Collects column chunks and yields a record batch whenever enough rows have come together."""

    def __init__(self, schema: pa.Schema, rows: int = 50_000):
        self.schema, self.limit, self.n = schema, rows, 0
        self.parts: list[list] = [[] for _ in schema]

    def add(self, *columns) -> Iterator[pa.RecordBatch]:
        """Columns as arrays of one length; a scalar first column is repeated."""
        n = len(columns[-1])
        if not n:
            return
        for part, c in zip(self.parts, columns, strict=True):
            part.append(c if isinstance(c, np.ndarray) else np.full(n, c) if np.isscalar(c) else np.asarray(c))
        self.n += n
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), f.type) for p, f in zip(self.parts, self.schema, strict=True)], schema=self.schema)
        self.parts, self.n = [[] for _ in self.schema], 0
