"""Source divergence, periodic runs and packing against plain programs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import op11_source_divergence as q11
from quillspark.llm import op12_periodic_runs as q12
from quillspark.llm import op13_packing as q13

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None, "en", "a"), (2, "", None, "b"), (3, "Aa bb Aa. bb cc", "en", "b"), (3, "Aa bb Aa. bb cc", "en", "b"), (4, "ééÉ aa " * 300, "en", None), (None, "bb cc dd 'x' aa", "en", "c"), (5, "z " * 9000 + "aa", "de", "a"), (6, " x ﬁne ＡＢ <|endoftext|> <|ENDOFTEXT|> It's 12.5", "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


def clashing(df):
    """Extra columns named like the operators' own."""
    return df.selectExpr("*", "1 AS n", "'x' AS term", "2 AS value", "3 AS rank", "4 AS start", "'y' AS ids", "5 AS runs", "6 AS h1", "7 AS part", "8 AS item")


# ---- op 11


def divergence(rows, min_docs=3, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, ts in terms:
        n[lang, source].update(ts)
        df[lang].update(set(ts))
    out = []
    for lang in {x[0] for x in terms}:
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        sources = sorted(s for x, s in n if x == lang)
        whole = sum((n[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            found = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, k in (("pair", pairs, None), ("term", found, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:k], 1)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_awkward(spark):
    docs = clashing(spark.createDataFrame(AWKWARD, SCHEMA))
    assert as_rows(q11.audit(docs, min_docs=2)) == divergence(AWKWARD, 2)
    assert as_rows(q11.audit(docs)) == divergence(AWKWARD)
    assert q11.audit(docs.where("false")).count() == 0


def test_divergence_by_blocks_and_bits(spark, monkeypatch):
    """Small blocks, ranges of sources, and ties far beyond what a window may sort."""
    for name, value in (("BLOCK", 500), ("CHUNK", 64), ("TABLE", 24), ("ENTRIES", 50), ("TIES", 3)):
        monkeypatch.setattr(q11, name, value)
    rnd = random.Random(3)
    rows = [(i, " ".join(f"same{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}{'' if rnd.random() < 0.5 else 'é'}" for _ in range(40)), "en", f"s{min(rnd.randrange(12), 7)}") for i in range(160)]
    rows += [(1000 + i, "alone é", "de", "s1") for i in range(3)]
    assert as_rows(q11.audit(spark.createDataFrame(rows, SCHEMA), top=5)) == divergence(rows, top=5)


def test_ties_by_bytes(spark, monkeypatch):
    """All values equal: the first items by UTF-8 bytes, found without sorting the group."""
    monkeypatch.setattr(q11, "TIES", 2)
    items = [f"pre{c}{d}" for c in "abcé中\U0001f600" for d in ("", "x", "yÿ", "yz", "￮")]
    rows = spark.createDataFrame([("en", "s", i, 7) for i in items], "lang string, source string, item string, value long")
    from quillspark.llm.store import Tables

    got = q11.top_rows(Tables(spark, "ties"), rows, 11).orderBy("rank").collect()
    assert [r.item for r in got] == sorted(items, key=str.encode)[:11] and [r.rank for r in got] == list(range(1, 12))


# ---- op 12


def plain_runs(words):
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, original = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("lie", [False, True])
def test_runs_against_all_periods(monkeypatch, lie):
    rnd = random.Random(5)
    if lie:  # hashes without any use: the words decide
        monkeypatch.setattr(q12.Prefixes, "equal", lambda self, at, n, p: np.ones(len(at), bool))
    for _ in range(600):
        n, k = rnd.randrange(70), rnd.choice([1, 2, 3, 6])
        words = [str(rnd.randrange(k)) for _ in range(n)]
        if n > 12 and rnd.random() < 0.6:
            a, p = rnd.randrange(n - 6), rnd.randrange(1, 9)
            for i in range(a + p, min(n, a + rnd.randrange(6, 60))):
                words[i] = words[i - p]
        assert [tuple(r) for r in q12.find_runs(q12.numbers([w.encode() for w in words])).tolist()] == plain_runs(words)


def test_grid_in_slices(monkeypatch):
    ids = np.array([i % 7 if 100 < i < 300 else (i * i) % 31 for i in range(900)], np.int64)
    whole = q12.find_runs(ids).tolist()
    monkeypatch.setattr(q12, "POINTS", 50)
    assert q12.find_runs(ids).tolist() == whole and whole
    assert q12.find_runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def test_periodic_query_against_plain(spark):
    rows = {r.doc_id: tuple(r) for r in q12.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len((d.text or "").split()) < 1500]
    assert len(rows) == len(docs) and len(short) > 100
    assert all(rows[d.doc_id] == plain_row(d.doc_id, d.text) for d in short)


def test_periodic_awkward(spark):
    got = q12.periodic_runs(clashing(spark.createDataFrame(AWKWARD, SCHEMA))).collect()
    assert len(got) == len(AWKWARD) and q12.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = {r.doc_id: r for r in got}
    assert [tuple(r) for r in rows[5].runs] == [(0, 9000, 1)] and rows[5].collapsed == "z aa"
    assert rows[1].n_words == 0 and rows[1].runs == [] and rows[1].collapsed == ""
    assert [tuple(r) for r in rows[4].runs] == [(0, 600, 2)] and rows[4].collapsed == "ééÉ aa"


# ---- op 13


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q13.vocabulary_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, q13.END]


def check_pieces(rows, texts, window=4096):
    """Every id of every row in one piece; sequences gapless and full, or of a power of two."""
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, len(r.ids) // 4))
        parts[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == window or at & (at - 1) == 0 and at < window
    for doc, ids in texts.items():
        raw = {s: (b, n) for s, b, n in parts.pop(doc)}
        assert b"".join(raw[s][0] for s in sorted(raw)) == np.array(ids, "<u4").tobytes()
        assert {n for _, n in raw.values()} == {len(ids)}
    assert not parts
    return sequences


@pytest.mark.parametrize("known", [20, 100_000])
def test_words_have_the_ids_of_whole_texts(whole, monkeypatch, known):
    monkeypatch.setattr(q13, "KNOWN", known)
    rnd = random.Random(9)
    pieces = ["straße", "naïve", "ŉ", "ǆ", "ǅ", "ﬁ", "İ", "ß", "ſ", "中文", "йод", "й", "ªº", "the", "The", "It's", "THEY'RE", "x,", "end.", ").", "12.5", "é", "É", "́x", "ÀÉ!", "İs", "ΑΣ", "ΑΣ.", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", " ", " x", "中文。", "😀,", "'s", "'", "x's.", "#*$", "ﬁn", "K̊", "a‍b", "\x1c", "\x85", "1st,", "9.", "…"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice([" ", "\n", "", "  ", "\t", "\x0b"]) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    enc = q13.TokenIds(q13.vocabulary_path())
    for at in range(0, len(texts), 50):
        ids, bounds = enc.encode(pa.array(texts[at : at + 50]))
        for text, low, high in zip(texts[at : at + 50], bounds[:-1], bounds[1:], strict=True):
            assert ids[low:high].tolist() == whole(text)[:-1], repr(text)
    assert enc.plain


def test_packing_whole_table(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {d.doc_id: whole(d.text) for d in docs.collect()}
    sequences = check_pieces(q13.pack(docs).collect(), texts)
    padding = sum(4096 - s for s in (sum(n for _, n in x) for x in sequences.values()) if s & (s - 1))
    assert padding == 0
    got = q13.query(spark, SF).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in got} == {(r.doc_id, r.start): zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in got}


def test_packing_small_shards_and_long_texts(spark, whole):
    rows = [(i, f"topic{i % 5} word{i % 5} about " * (i % 40 + 1)) for i in range(200)] + [(999, "very long text here " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces(q13.pack(docs, window=256, shard=5000).collect(), {i: whole(t) for i, t in rows}, 256)


def test_packing_awkward(spark, whole):
    rows = clashing(spark.createDataFrame(AWKWARD, SCHEMA))
    got = q13.pack(rows).collect()
    assert sum(len(r.ids) // 4 for r in got) == sum(len(whole(t)) for _, t, _, _ in AWKWARD)
    assert sorted(r.doc_tokens for r in got if r.doc_id in (1, 2)) == [1, 1]
    assert q13.pack(rows.where("false")).count() == 0


def test_neighbours_share_a_window():
    """Documents of one topic are put together although they lie apart."""
    rnd = np.random.default_rng(4)
    docs = [np.concatenate([rnd.integers(100 + 50 * (i % 8), 150 + 50 * (i % 8), 60), rnd.integers(0, 100, 40)]) for i in range(160)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=600)
    shard = q13.Shard(docs, np.log1p((160 - df + 0.5) / (df + 0.5)).astype(np.float32), 100.0)
    windows = defaultdict(set)
    for doc, _, _, seq, _ in q13.fill(docs, shard, 1024):
        windows[seq].add(doc % 8)
    assert sum(map(len, windows.values())) / len(windows) < 3.2  # by order alone each has all 8
    assert shard.ranked(0, np.ones(160, bool))[0] == 0
