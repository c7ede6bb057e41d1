"""Lexical retrieval packing: windows of 4096 tokens filled with a seed document and what BM25 finds nearest to it.

1. Every text is tokenised once, whole, and written as token ids (``TokenIds``: words are encoded by the tokenizer, each
   word once a worker, since its ids never depend on the words around it; a test holds this against whole texts).
2. Document frequencies of the token ids, the number of documents and their mean length are counted over the whole table.
   The table of frequencies has one row an id at most, so the tokenizer's vocabulary bounds what goes to the tasks.
3. Documents are dealt by range of two minimum hashes of their token sets, then id: copies and documents with like words
   come to lie side by side, and a group of copies of any size is cut into ranges like all else. Each task works along its
   range in shards of at most ``SHARD`` tokens (one longer text is cut into several parts), so memory is bounded.
4. A shard has a BM25 inverted index over its documents' token ids. A window starts with the next unused document, the
   seed; its ``TERMS`` terms of most weight are looked up, and the unused documents with the highest scores fill the
   window one after the other. The last one is cut where the window ends; its rest seeds the next window. When nothing
   is found any more, the next unused document is taken and asked in its turn.

What is left of a shard under one window goes into the task's next shard. So every sequence has exactly 4096 tokens but for
the last of each task, whose tokens are dealt to sequences whose lengths are powers of two: no padding at all.

Cases: null or empty text has the end token alone. Equal rows are rows, each packed once. Null doc_id stays null. Ties
of scores go to the earlier document of the shard. Empty table: no rows. Long texts run on over several sequences. Extra
columns are ignored. A lost task is done again with the same result: order and numbers follow from its own input alone.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import Tables, arrow_rows, partitions

WINDOW, END = 4096, 2
#: Tokens of a shard, query terms of a seed, words of a generation that a worker keeps.
SHARD, TERMS, KNOWN = 1 << 20, 12, 400_000
#: Bytes of token ids that a task of the range partitioning should get.
TASK_BYTES = 64 << 20
K1, B = 1.2, 0.75
_END_MARKS = b",.;:!?"
# The characters that stand for bytes in byte-level vocabularies; printable ones for themselves, others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STANDS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_TOKENS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _small(word: str) -> bool:
    """Letters only, none of which lower-casing or normal form would change."""
    return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)) and word == word.lower()


def _bytes(word: str) -> str:
    """A word's bytes as the characters that stand for them."""
    return word.encode().decode("latin-1").translate(_STANDS)


def _pieces(strings: pa.StringArray) -> list[bytes]:
    """The values of an array without nulls, cut from its buffer at once."""
    if not len(strings):
        return []
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = strings.buffers()[2].to_pybytes() if strings.buffers()[2] is not None else b""
    return [data[low:high] for low, high in zip(offsets[:-1], offsets[1:], strict=True)]


class TokenIds:
    """Token ids of texts by the words between blanks, for a tokenizer that never joins words over blanks. Words met lately
    are kept in two generations of at most ``KNOWN`` words each, so that common ones stay; this changes no result."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]  # arrays of the machine's order, little-endian wherever Spark runs
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # whether words of small letters come through normalizer and splitter as one run of their bytes, so that the model
        # alone makes their ids; asked of all small letters up to U+017F that are themselves in normal form
        probe = "".join(c for c in map(chr, range(0x180)) if _small(c))
        n, s = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = n is not None and s is not None and n.normalize_str(probe) == probe and s.pre_tokenize_str(probe) == [(_bytes(probe), (0, len(probe)))]

    def _learn(self, words: set[bytes]) -> None:
        """Encodes words that are not known yet."""
        new, tokenize, code, rest = self.new, self.tokenizer.model.tokenize, self.code, []
        for w in words:
            text = w.decode()
            if self.plain and _small(text):
                new[w] = array(code, [t.id for t in tokenize(text if text.isascii() else _bytes(text))]).tobytes()
            else:
                rest.append(text)
        for text, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            new[text.encode()] = array(code, e.ids).tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if len(self.new) > KNOWN:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        found = list(map(new.get, words))
        ask, cut, whole = set(), [], []
        for k, v in enumerate(found):
            if v is None:
                w = words[k]
                if w[-1:] in _END_MARKS and w:  # marks at the end of a word in letters or digits are tokens of their own
                    stem = w.rstrip(_END_MARKS)
                    if stem and stem[-1] in _ALNUM:
                        mark = w[len(stem) :]
                        cut.append((k, stem, mark))
                        for part in (stem, mark):
                            if part not in new:
                                if part in old:
                                    new[part] = old[part]
                                else:
                                    ask.add(part)
                        continue
                if w in old:
                    found[k] = new[w] = old[w]
                else:
                    whole.append(k)
                    ask.add(w)
        self._learn(ask)
        for k in whole:
            found[k] = new[words[k]]
        for k, stem, mark in cut:
            found[k] = new[stem] + new[mark]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an array of strings without nulls, one after the other, and where each text begins and ends."""
        # small letters are what the tokenizer makes of A-Z; a text with a special token's opening is left as it is
        small = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(small)
        words = split.flatten().dictionary_encode()
        values = self._ids(_pieces(words.dictionary))
        pool = np.frombuffer(b"".join(values), self.dtype)
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        at = words.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(ends[-1]) + np.repeat(start[at] - ends[:-1], n)]
        offsets = split.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


_encoders: dict[str, TokenIds] = {}


def _tokenise(path: str):
    def run(batches):
        if path not in _encoders:
            _encoders[path] = TokenIds(path)
        enc = _encoders[path]
        width, end = enc.tokenizer.get_vocab_size(), np.array(END, enc.dtype).tobytes()
        hashes = [W.mix((np.arange(width, dtype=np.uint64) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1) for k in (1, 1 << 32)]
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids, bounds = enc.encode(pc.fill_null(part.column(1), ""))
                rows = [ids[low:high] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [part.column(0), np.diff(bounds) + 1, [x.tobytes() + end for x in rows], *([int(min(h[x].min(initial=h[END]), h[END])) for x in rows] for h in hashes)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _TOKENS, strict=True)], schema=_TOKENS)

    return run


def _frequencies(dtype: np.dtype):
    schema = pa.schema([("id", pa.int64()), ("df", pa.int64())])

    def run(batches):
        df = np.zeros(1 << 16, np.int64)
        place = np.zeros(len(df), np.int64)
        for (raw,) in W.rows(batches, "ids"):
            ids = np.frombuffer(raw, dtype)
            if (top := int(ids.max()) + 1) > len(df):
                df, place = (np.concatenate([x, np.zeros(top - len(x), np.int64)]) for x in (df, place))
            order = np.arange(len(ids))
            place[ids] = order  # the last place of each id
            df[ids[place[ids] == order]] += 1
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], schema=schema)

    return run


class Shard:
    """A BM25 inverted index over some documents (arrays of token ids), with the frequencies of the whole table."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        code = np.concatenate(docs).astype(np.int64) * self.n + np.repeat(np.arange(self.n), sizes)
        code.sort()
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        tf = np.diff(np.concatenate([first, [len(code)]])).astype(np.float32)
        term, self.doc = np.divmod(code[first], self.n)
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))).astype(np.float32)
        # the heaviest terms of every document: its postings sorted by weight
        by = np.lexsort((term, -self.weight, self.doc))
        owner = self.doc[by]
        begin = np.searchsorted(owner, np.arange(self.n + 1))
        place = np.arange(len(by)) - begin[owner]
        keep = by[place < TERMS]
        self.terms, self.of = term[keep], np.searchsorted(owner[place < TERMS], np.arange(self.n + 1))

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first."""
        spans = [slice(self.start[t], self.start[t + 1]) for t in self.terms[self.of[seed] : self.of[seed + 1]]]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill(docs: list[np.ndarray], shard: Shard, window: int = WINDOW, last: bool = True):
    """Pieces (document, start, length, sequence, offset) of the documents, sequences from 0, all of them full. The last
    tokens, under one window, go to sequences with powers of two as lengths; unless ``last`` they are left over."""
    unused = np.ones(len(docs), bool)
    left = sum(map(len, docs))
    sequence, at, size, nxt = 0, 0, 0, 0
    rest: tuple[int, int] | None = None  # a document begun in the window before, and where
    found: list[int] = []

    def room() -> int:
        """The length of the next sequence: a window, or the largest power of two that the rest fills."""
        return window if left >= window else 1 << (left.bit_length() - 1)

    while left:
        if at == 0:
            if left < window and not last:
                return
            size, found = room(), []
        if rest is not None:
            doc, start = rest
        else:
            while found and not unused[found[-1]]:
                found.pop()
            if found:
                doc, start = found.pop(), 0
            else:
                while not unused[nxt]:
                    nxt += 1
                doc, start = nxt, 0
            unused[doc] = False
        if not found and at + len(docs[doc]) - start < size:
            found = shard.ranked(doc, unused)[: size - at][::-1].tolist()
        take = min(len(docs[doc]) - start, size - at)
        yield doc, start, take, sequence, at
        rest = (doc, start + take) if start + take < len(docs[doc]) else None
        at, left = at + take, left - take
        if at == size:
            sequence, at = sequence + 1, 0


def _pack(dtype: np.dtype, idf: np.ndarray, mean: float, window: int, size: int):
    def run(batches):
        _encoders.clear()  # a worker that has tokenised before needs its words no more
        sequence = TaskContext.get().partitionId() << 40
        held, tokens = [], 0  # rows (doc_id, doc_tokens, ids, ids before them)

        def flush(last: bool):
            """Packs what is held; what is left over stays held."""
            nonlocal sequence, held, tokens
            docs, first = [np.frombuffer(ids, dtype) for _, _, ids, _ in held], sequence
            done = [0] * len(docs)
            parts: list[list] = [[] for _ in _PIECES]
            for doc, start, take, seq, offset in fill(docs, Shard(docs, idf, mean), window, last):
                doc_id, total, _, before = held[doc]
                for column, v in zip(parts, (doc_id, before + start, docs[doc][start : start + take].astype("<u4").tobytes(), total, first + seq, offset), strict=True):
                    column.append(v)
                done[doc], sequence = start + take, first + seq + 1
                if len(parts[0]) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, _PIECES, strict=True)], schema=_PIECES)
                    parts = [[] for _ in _PIECES]
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, _PIECES, strict=True)], schema=_PIECES)
            held = [(doc_id, n, d[k:].tobytes(), before + k) for (doc_id, n, _, before), d, k in zip(held, docs, done, strict=True) if k < len(d)]
            tokens = sum(len(h[2]) for h in held) // dtype.itemsize

        for doc_id, n, ids in W.rows(batches, "doc_id", "n", "ids"):
            for before in range(0, n, size):  # a text beyond a shard goes on in the next
                part = ids[before * dtype.itemsize : (before + size) * dtype.itemsize]
                if tokens + len(part) // dtype.itemsize > size:
                    yield from flush(False)
                held.append((doc_id, n, part, before))
                tokens += len(part) // dtype.itemsize
        if held:
            yield from flush(True)

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of documents: doc_id, start (the document's ids before it), ids (little-endian 32-bit numbers), doc_tokens,
    sequence_id, offset. ``window`` must be a power of two."""
    spark = docs.sparkSession
    arrow_rows(spark)
    path = path or vocabulary_path()
    from tokenizers import Tokenizer

    dtype = np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")
    tables = Tables(spark, "packing")
    tokens = tables.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(path), "doc_id long, n long, ids binary, h1 long, h2 long"), "tokens")
    total = tokens.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    found = tokens.select("ids").mapInArrow(_frequencies(dtype), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()  # a row an id of the vocabulary
    df = np.zeros(max([1 << 16, *(found.column("id").to_numpy() + 1)]), np.float64)
    df[found.column("id").to_numpy()] = found.column("df").to_numpy()
    idf = np.log1p((total.docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    n = max(partitions(spark), -(-total.n * dtype.itemsize // TASK_BYTES))
    keys = ["h1", "h2", F.col("doc_id").asc_nulls_first(), F.crc32("ids")]
    dealt = tokens.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "n", "ids")
    return dealt.mapInArrow(_pack(dtype, idf, total.n / max(1, total.docs), window, shard), "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed.select("doc_id", "start", F.expr("CAST(octet_length(ids) DIV 4 AS bigint)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
