"""The operators on texts against brute force, and on awkward tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op1_quality_rules as q1
from quillspark.llm import op2_language_id as q2
from quillspark.llm import op3_line_dedup as q3
from quillspark.llm import op5_substring_dedup as q5
from quillspark.llm import op6_ngram_jaccard as q6
from quillspark.llm import op10_decontamination as q10

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _w string, copies int, gone string"


def table(spark, rows):
    return spark.createDataFrame([(*r[:2], *(r[2:4] if len(r) > 2 else ("en", "s")), 0, "clash", 7, "clash") for r in rows], SCHEMA)


def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return table(spark, [(1, None), (2, ""), (3, " \t\n "), (4, long), (4, long), (None, "no id at all"), (5, "a b c", None, None), (5, "other text, same id"), (6, "x"), (7, "x")])


def test_stats_of_quality_rules(spark):
    rng = random.Random(0)
    texts = ["\n".join(" ".join(rng.choice("ab#c$d") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    for r in q1.text_stats(table(spark, enumerate(texts)), ["doc_id"]).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(60, 300))), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(200)), "en", "s0") for i in range(20)]
    got = {r.doc_id: r.kept for r in q1.judge(table(spark, clean + junk)).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_pipe_separated_texts_go(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = [(i, " ".join(word() for _ in range(rng.randint(60, 300))), "en", "s0") for i in range(300)]
    pipes = [(1000 + i, " ".join("|" if k % 5 in (1, 3) else word() for k in range(rng.randint(100, 300))), "en", "s0") for i in range(20)]
    got = {r.doc_id: r.kept for r in q1.judge(table(spark, prose + pipes)).collect()}
    assert [i for i, *_ in prose if not got[i]] == [] and [i for i, *_ in pipes if got[i]] == []


def test_covariances_decide(spark):
    """Long words come with capitals here: a text with long words and few is odd, though each of its statistics is usual."""
    rng = random.Random(9)

    def text(length, capitals):
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(max(1, round(rng.gauss(length, 1)))))
        return " ".join(w.capitalize() if rng.random() < capitals else w for w in (word() for _ in range(400)))

    level = [rng.random() for _ in range(160)]
    rows = [(i, text(4 + 3 * x, 0.2 + 0.6 * x), "en", f"s{i % 2}") for i, x in enumerate(level)] + [(500, text(6.7, 0.4), "en", "s0"), (501, text(6.7, 0.74), "en", "s1")]
    d = table(spark, rows)
    got = {r.doc_id: r.kept for r in q1.judge(d).collect()}
    plain = {r.doc_id: r.kept for r in q1.judge(d, correlated=False).collect()}
    assert not got[500] and got[501] and plain[500] and plain[501]
    assert sum(got[i] for i in range(160)) >= 155


def test_few_leftovers_are_judged_by_whole_language_or_table(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda end="": " ".join(word() + end for _ in range(rng.randint(100, 300)))
    large = [(i, text(), "en", f"s{i % 2}") for i in range(200)]
    few = [(1000 + i, text(), *k) for i, k in enumerate([("en", "s7")] * 12 + [("de", "s0")] * 3 + [(None, None)])]
    junk = [(2000 + i, text("###"), *k) for i, k in enumerate([("en", "s7"), ("de", "s0"), ("de", "s1"), (None, None)])]
    short = [(3000, "too short", "en", "s7"), (3001, "too short", "it", None)]
    got = q1.judge(table(spark, large + few + junk + short)).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, *_ in large + few + junk + short)
    assert {r.doc_id for r in got if not r.kept} == {d for d, *_ in junk + short}
    alone = {r.doc_id: r.distance2 for r in q1.judge(table(spark, large)).collect()}
    assert all(r.distance2 == pytest.approx(alone[r.doc_id]) for r in got if r.doc_id in alone)


def brute_lines(rows, n):
    seen, gone = {}, collections.defaultdict(set)
    for d, t in rows:
        lines = t.split("\n")
        w = [i for i, x in enumerate(lines) if WORD.search(x)]
        for p in range(len(w) - n + 1):
            key = tuple(lines[i] for i in w[p : p + n])
            if key in seen:
                gone[d] |= set(w[p : p + n])
            seen.setdefault(key, d)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_line_runs(spark, n):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice("ABC") if rng.random() < 0.9 else " " for _ in range(rng.randint(0, 25)))) for i in range(30)]
    got = {r.doc_id: r.text for r in q3.dedup(table(spark, rows), n).collect()}
    assert got == brute_lines(rows, n)


def test_long_lines_are_runs_by_themselves(spark):
    nine, ten = " ".join("abcdefghi"), "\t" + "  ".join("abcdefghij") + " "
    rows = [(1, f"{nine}\nx\n{ten}"), (2, nine), (3, ten), (4, f"y\n{ten}\nz\n{nine}"), (5, f"{ten}\n{ten}"), (6, ten + "k")]
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in q3.dedup(table(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: (nine, 0), 3: ("", 1), 4: (f"y\nz\n{nine}", 1), 5: ("", 2), 6: (ten + "k", 0)}


@pytest.mark.parametrize("window,group", [(4, 20_000), (4, 10), (9, 20_000)])
def test_substrings(spark, monkeypatch, window, group):
    monkeypatch.setattr(q5, "GROUP", group)
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmn") for _ in range(20)] for _ in range(5)]
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 3)) for x in rng.choice(base)[rng.randint(0, 5) : rng.randint(5, 20)])) for i in range(80)]
    least = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - window + 1):
            least.setdefault(tuple(w[i : i + window]), d)
    for r in q5.dedup(table(spark, rows), window).collect():
        w = rows[r.doc_id][1].split()
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < r.doc_id for j in range(i, i + window)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_pivots_of_a_text_beyond_16_million_words():
    h = np.random.default_rng(9).integers(0, 1 << 63, (1 << 24) + 2_000, np.uint64)
    tail = 1_500
    first, last, at, g = q5.pivots(h, 50)
    assert (first <= at).all() and (at < last + 50).all() and last[-1] == len(h) - 50
    # the pivots of the end don't depend on what comes before it
    end = q5.pivots(h[-tail:], 50)[2] + len(h) - tail
    assert np.array_equal(at[at >= end[1]], end[1:])


@pytest.mark.parametrize("small", [32, 0])
def test_jaccard_components(spark, monkeypatch, small):
    monkeypatch.setattr(q6, "SMALL", small)
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))] for _ in range(4)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("xyz"))
        rows.append((i, " ".join(w).upper() if i % 3 else " ".join(w)))
    rows += [(100, ""), (101, "one"), (102, "ONE")]
    sets = {d: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if (w := t.lower().split()) else set() for d, t in rows}
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == {d: label[c] for d, c in label.items()}:
            break
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q6.join(table(spark, rows)).collect()}
    assert got == {d: (len(s), label[d]) for d, s in sets.items()}


@pytest.mark.parametrize(("small", "seed"), [(0, 1), (1, 2), (4, 3)])
def test_jaccard_of_many_near_copies(spark, monkeypatch, small, seed):
    """Large groups go by leads and differences, round after round; blocks and parts are many."""
    monkeypatch.setattr(q6, "SMALL", small)
    monkeypatch.setattr(q6, "BLOCK", 900)
    rng = random.Random(seed)
    bases = [[f"b{i}w{j}" for j in range(60)] for i in range(3)]
    rows = []
    for i in range(150):
        w = list(bases[i % 3])
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            w[rng.randrange(60)] = rng.choice("pqrst")
        rows.append((i, " ".join(w)))
    sets = [set(q6.shingle_set(t, 4).tolist()) for _, t in rows]
    label = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    got = {r.doc_id: r.component_id for r in q6.join(table(spark, rows).repartition(3)).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("gb", [0.5, 6, 60])
def test_jaccard_counting_sends_rows_in_proportion(gb):
    """A row of a block's part keeps its size, so there are no more rows a GB on larger inputs (6 GB had 16 times as many as 0.5 GB)."""
    bits = q6._bits(round(1.7e9 * gb), round(100 * gb))
    assert q6._block(bits) >> bits >= 200
    assert 1.7e9 * gb / (1 << bits) <= q6.PART_BYTES


def test_jaccard_counts_every_shared_shingle_of_many_blocks(spark, monkeypatch):
    """Keys of the nodes over small blocks and parts: one shingle in every other document, and blocks without a shared one."""
    monkeypatch.setattr(q6, "BLOCK", 40)
    rows = [(i, " ".join([f"d{i}w{j}" for j in range(9)] + (["in", "all", "of", "them"] if i % 2 and i < 40 else []))) for i in range(80)]
    shared = table(spark, rows).repartition(2, "doc_id").mapInArrow(q6._requests(4, 4), q6._REQUESTS).groupBy("part").applyInArrow(q6._shared, q6._SHARED)
    got = {r.doc_id: (r.n, r["keys"] and len(r["keys"])) for r in shared.groupBy("block").applyInArrow(q6._prefixes(1), q6._NODES).collect()}
    assert got == {i: (len(set(q6.shingle_set(t, 4).tolist())), 1 if i % 2 and i < 40 else None) for i, t in rows}


def test_spaced_seeds_bear_substitutions(spark):
    item = [f"token{i}" for i in range(30)]
    changed = [w if i not in (9, 20) else "other" for i, w in enumerate(item)]
    rows = [(1, "before, " + " ".join(changed) + ". after"), (2, " ".join(f"clean{i}" for i in range(300))), (3, " ".join(item[:9])), (4, None), (5, "TOKEN0 " + ", ".join(item[1:16]))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short"), (10, " ".join(item).upper())], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.equal_words, r.compared_words, r.start_word) for r in q10.matches(table(spark, rows), bench).collect()}
    assert got == {(1, 7): (28, 30, 1), (1, 10): (28, 30, 1), (5, 7): (16, 16, 0), (5, 10): (16, 16, 0)}
    assert {r.doc_id for r in q10.contaminated(table(spark, rows), bench).collect()} == {1, 5}


def test_short_items_bear_one_substitution(spark):
    for n in (6, 8, 10, 11, 13):
        item = [f"s{n}x{i}" for i in range(n)]
        docs = [(i, "lead " + " ".join("other" if j == i else w for j, w in enumerate(item)) + " tail") for i in range(n)]
        docs += [(n, "lead " + " ".join(item)), (n + 1, " ".join("other" if j in (1, 4) else w for j, w in enumerate(item))), (n + 2, " ".join(item[:-2]))]
        bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        assert {r.doc_id: r.equal_words for r in q10.matches(table(spark, docs), bench).collect()} == {**dict.fromkeys(range(n), n - 1), n: n}


def test_shortest_items_match_whole_texts(spark):
    bench = spark.createDataFrame([(1, "two words"), (2, "Two, words!"), (3, ""), (4, "..."), (5, None)], "item_id long, text string")
    docs = table(spark, [(1, "two WORDS."), (2, "two words more"), (3, ""), (4, None), (None, "two words"), (1, "two words")])
    assert sorted((r.doc_id or 0, r.item_id) for r in q10.matches(docs, bench).collect()) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {r.doc_id for r in q10.contaminated(docs.withColumn("item_id", F.lit(3)), bench).collect()} == {1, None}
    assert q10.matches(docs, bench.where("false")).count() == q10.matches(docs.where("false"), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(q10, "BLOCK_WORDS", 10)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(4)], "item_id long, text string")
    docs = table(spark, [(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(4)])
    assert sorted((r.doc_id, r.item_id) for r in q10.matches(docs, bench).collect()) == [(i, i) for i in range(4)]


def test_language_profiles(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 3, "en", "s") for i in range(30)] + [(100 + i, "der schnelle braune fuchs und der faule hund " * 3, "de", "s") for i in range(30)]
    profiles = q2.learn(table(spark, rows))
    assert set(profiles) == {"en", "de"}
    got = [(r.lang_pred, r.score) for r in q2.identify(table(spark, [(1, "the dog"), (2, "der hund und der fuchs"), (3, None), (4, "12 34 !"), (5, "")]), profiles).orderBy("doc_id").collect()]
    assert [x for x, _ in got] == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got)
    assert q2.learn(table(spark, [(1, "x", None, None)])) == {}


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, empty):
    d = awkward(spark).where("false") if empty else awkward(spark)
    n = 0 if empty else 10
    assert q1.judge(d).count() == n
    assert q3.dedup(d).count() == n and q3.dedup(d).columns == [*d.columns, "n_removed_lines"]
    assert q5.dedup(d).count() == n
    assert q6.join(d).count() == n
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    assert {r.doc_id for r in q10.contaminated(d, bench).collect()} == (set() if empty else {4})
    assert q2.identify(d, q2.learn(d)).count() == n
    if not empty:
        removed = {r.doc_id: r.n_removed for r in q5.dedup(d).where("doc_id <> 4").collect()}
        assert not any(removed.values())
        assert {(r.doc_id, r.component_id) for r in q6.join(d).collect()} >= {(1, 1), (2, 2), (6, 6), (7, 6), (None, None)}
        assert q3.dedup(d).where(F.col("doc_id") == 1).first().text is None


def test_digest(spark):
    r = q5.dedup(table(spark, [(1, " a  b\nc ")]), 50, True).first()
    assert r.kept == hashlib.sha256(b"a b c").hexdigest()


def test_converged_starts_take_no_more_steps(spark, monkeypatch):
    rows, save = {}, q1.Tables.save

    def counted(self, df, tag):
        out = save(self, df, tag)
        if tag.startswith(("q", "est")):
            rows[tag] = out.count()
        return out

    monkeypatch.setattr(q1.Tables, "save", counted)
    q1.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), min_group=10)
    steps = [rows[f"q{i}"] for i in range(len([t for t in rows if t.startswith("q")]))]
    assert len(steps) > 2 and steps == sorted(steps, reverse=True) and steps[-1] < steps[0]
    assert all(rows[t] == steps[0] for t in rows if t.startswith("est"))
