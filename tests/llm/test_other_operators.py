"""Mixing, chat repair, the line CRF, licence scans, components and the pipeline."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op4_mixing as q4
from quillspark.llm import op7_chat_format as q7
from quillspark.llm import op8_quality_crf as q8
from quillspark.llm import op9_license_scan as q9
from quillspark.llm import components as Components
from quillspark.llm.components import components
from quillspark.llm.store import Tables

SF = "/root/testdata/sf0.001"


def water(children, budget):
    if sum(c for c, w in children if w > 0) <= budget:
        return [float(c) if w > 0 else 0.0 for c, w in children]
    lo, hi = 0.0, 1e15
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(min(c, mid * w) for c, w in children if w > 0) > budget else (mid, hi)
    return [min(c, lo * w) if w > 0 else 0.0 for c, w in children]


@pytest.mark.parametrize("budget", [10, 100, 137, 500, 10_000])
def test_budgets_go_to_siblings_first(spark, budget):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 40), ("a", "y", "3", 5), ("b", "x", "4", 100), ("b", "z", "5", 1)]
    weights = [("domain", "a", None, None, 3.0), ("source", "a", "x", "2", 0.5), ("source", "b", "z", "5", 0.0)]
    w = {(d, *(x for x in (lang, s) if x)): v for _, d, lang, s, v in weights}

    def go(path, b):
        if len(path) == 3:
            return {path: int(b + 1e-6)}
        children = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})
        cap = [sum(2 * leaf[3] for leaf in leaves if leaf[: len(c)] == c) for c in children]
        out = {}
        for c, share in zip(children, water([(x, w.get(c, 1.0)) for x, c in zip(cap, children, strict=True)], b), strict=True):
            out |= go(c, share)
        return out

    plan = q4.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), spark.createDataFrame(weights, "level string, domain string, lang string, source string, weight double"), budget, 2)
    assert {(r.domain, r.lang, r.source): r.budget for r in plan.collect()} == go((), budget)


def test_mixing_awkward(spark):
    d = spark.createDataFrame([(1, None, "en", "s0", 5), (2, "", None, None, 5), (3, "a b c", "en", "s0", 5), (3, "a b c", "en", "s0", 5), (None, "d e", "de", "nine", 5)], "doc_id long, text string, lang string, source string, copies int")
    got = q4.mixture(d).collect()
    assert all(r.copies >= 1 for r in got) and {r.doc_id for r in got} <= {3, None}
    assert q4.mixture(d.where("false")).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0])
def test_mixing_against_plain_epochs(spark, share):
    """Equal ids and texts under several leaves, null ids and repeated rows, against a sort of each leaf."""
    rng = random.Random(int(share * 10))
    rows = [(i if i % 7 else None, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 9))), f"d{i % 2}", "en", f"s{i % 3}") for i in range(120)]
    rows += [(500, "a b c", "d0", "en", "s0"), (500, "a b c", "d1", "en", "s0"), (500, "a b c", "d1", "en", "s0"), (500, "a b", "d1", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    weights = spark.createDataFrame([("domain", "d0", None, None, 4.0)], "level string, domain string, lang string, source string, weight double")
    th = {(r.doc_id, r.text): r.th for r in docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    leaves = {}
    for doc, text, *leaf in rows:
        if text:
            unit = leaves.setdefault(tuple(leaf), {})
            unit[doc, text] = unit.get((doc, text), 0) + len(text.split())
    plan = q4.leaf_budgets(spark.createDataFrame([(*k, sum(v.values())) for k, v in leaves.items()], "domain string, lang string, source string, tokens long"), weights, share * sum(sum(v.values()) for v in leaves.values()), 4)
    want = {}
    for r in plan.collect():
        unit = leaves[r.domain, r.lang, r.source]
        whole, left = divmod(r.budget, r.tokens)
        order = sorted(unit, key=lambda u: (hashlib.sha256(f"17:{whole}:{u[0] if u[0] is not None else f'text{th[u]}'}".encode()).hexdigest()[:8], u[0] is not None, u[0] or 0, th[u]))
        for u in order:
            left -= unit[u]
            if n := whole + (left >= 0):
                want[r.domain, r.lang, r.source, *u] = n
            if left < 0:
                left = -1 << 60
    got = [((r.domain, r.lang, r.source, r.doc_id, r.text), r.copies) for r in q4.mix(docs, share, 4, weights).collect()]
    assert dict(got) == want
    assert sorted(map(repr, (k for k, _ in got))) == sorted(repr((*leaf, doc, text)) for doc, text, *leaf in rows if (*leaf, doc, text) in want)


def cheapest(roles):
    """Least cost over all ways, by search over (turn, state)."""
    best = {0: 0.0}
    close = lambda s: q7.INSERT * len(q7.END[s])

    def relax(costs):
        changed = True
        while changed:
            changed = False
            for s, c in list(costs.items()):
                for t in q7.NEXT[s]:
                    if c + q7.INSERT < costs.get(t, 1e9):
                        costs[t], changed = c + q7.INSERT, True
        return costs

    for r in roles:
        new = {}
        for s, c in relax(dict(best)).items():
            for t in (1, 2, 3):
                label = 0 if t == r else q7.RELABEL
                if t in q7.NEXT[s]:
                    new[t] = min(new.get(t, 1e9), c + label)
                if t == s:
                    new[t] = min(new.get(t, 1e9), c + label + q7.MERGE)
        best = new
    return min(c + close(s) for s, c in best.items())


def test_role_repair_is_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            states = q7.path([q7._COST[r] for r in roles], 0, None)
            text, cost, *_ = q7.render([(r, "t") for r in roles], 0, states[-1], True)
            assert cost == cheapest(roles)
            said = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
            state = 0
            for role in said:
                k = q7.ROLES.index(role) + 1
                assert k in q7.NEXT[state]
                state = k
            assert state == 3 and text.count("<|im_start|>") == text.count("<|im_end|>")


def test_long_conversations_go_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    roles = [rng.choice(["user", "assistant", "system", "USER ", "bot", None]) for _ in range(200)]
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(roles)] + [(None, 0, "user", None), (2, None, "user", "<|im_end|>")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: (r.rendered, r.cost) for r in q7.repair(c).collect()}
    monkeypatch.setattr(q7, "BLOCK", 16)
    parts = q7.repair(c).orderBy("conv_id", "part").collect()
    assert len(parts) > 10
    for conv in (1, 2, None):
        mine = [p for p in parts if p.conv_id == conv]
        assert sum(p.cost for p in mine) == whole[conv][1]
    assert whole[1][1] == cheapest([q7.code(r) for r in roles])
    again = q7.repair(c.withColumn("turn", F.lit(0).cast("long"))).where("conv_id = 1")
    assert again.count() > 10
    assert q7.repair(c.where("false")).count() == 0


def test_chat_order_repeats_and_clashing_columns(spark):
    rows = [(1, -600, "user", "low"), (1, None, "user", "null"), (1, 5, "assistant", "a"), (1, 5, "assistant", "a")]
    c = spark.createDataFrame([(*r, 0, 1) for r in rows], "conv_id long, turn long, role string, text string, part long, block long")
    got = q7.repair(c).collect()
    assert len(got) == 1 and got[0].n_turns == 4 and got[0].n_merged == 2
    assert [got[0].rendered.index(x) for x in ("null", "low", "assistant")] == sorted(got[0].rendered.index(x) for x in ("null", "low", "assistant"))


def test_crf_scores_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n, bad: "\n".join(" ".join(rng.choice("| # | && x".split() if bad else "alpha beta gamma delta.".split()) for _ in range(8)) for _ in range(n))
    rows = [(i, text(1 + i % 7, i % 2), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 1 - bad, 9.0) for i, t, bad in rows], "doc_id long, text string, label int, score double")
    labels = docs.select("doc_id", "label")
    model = q8.learn(docs, labels)
    texts = [text(n, n % 2) for n in (1, 50, 333, 20)]
    whole = model.score(texts)
    monkeypatch.setattr(q8, "PIECE", 16)
    monkeypatch.setattr(q8, "PADDED", 60)
    assert np.allclose(model.score(texts), whole) and whole[1] > 0.5 > whole[0]
    twice = docs.unionByName(docs)
    got = q8.classify(twice, model).collect()
    assert len(got) == 240 and len({(r.doc_id, r.score) for r in got}) == 120
    assert q8.classify(docs.where("false"), q8.learn(docs.where("false"), labels)).count() == 0
    assert set(q8.learn(docs.where("false"), labels).score(["a b", None])) == {0.5}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    good, pairs = q8._forward_backward(e, np.ones((1, 5), bool), t)
    total, marginal, expected = 0.0, np.zeros(5), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(e[0, i] for i in range(5) if y[i]) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total += w
        marginal += w * np.array(y)
        for a, b in zip(y, y[1:]):
            expected[a, b] += w
    assert np.allclose(good[0], marginal / total) and np.allclose(pairs, expected / total)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = "/root/testdata/sf0.01"
    got = q8.query(spark, more).join(spark.read.parquet(f"{more}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n \n"), (4, "x " * 50_000), (None, "a")], "doc_id long, text string")
    none = q8.learn(docs, labels.where("false").select("doc_id", F.col("quality").alias("label")))
    assert {r.score for r in q8.classify(odd, none).collect()} == {0.5}
    model = q8.learn(docs, labels.select("doc_id", F.col("quality").alias("label")))
    assert all(0 <= r.score <= 1 for r in q8.classify(odd, model).collect())


def test_licences_and_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License.\n"), (2, "a/b/x.py", "print(1)"), (3, "a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (4, "a/b/c/d/y.py", "y"), (5, "z/x.py", "# Licensed under the Apache License, Version 2.0.\n" + "code and more code\n" * 20), (6, "z/y.py", "none"), (7, None, None), (8, "q", ""), (2, "a/b/x.py", "print(1)")]
    d = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, path string, text string, unit string")
    got = {(r.file_id, r.licence, r.how, r.origin) for r in q9.scan(d).collect()}
    assert got == {(1, "MIT", "own", None), (2, "MIT", "inherited", "a/"), (3, "GPL-3.0", "own", None), (4, "GPL-3.0", "inherited", "a/b/c/"), (5, "Apache-2.0", "own", None), (6, None, None, None), (7, None, None, None), (8, None, None, None)}
    assert q9.scan(d).count() == 9 and q9.scan(d.where("false")).count() == 0


@pytest.mark.parametrize("local", [8, 200_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(Components, "LOCAL", local)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.c for r in components(Tables(spark, "t"), spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {x: c for x, c in label.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*docs.columns, "copies"]
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)
