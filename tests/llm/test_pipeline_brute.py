"""run() of the pipeline against a plain program, stage by stage, on the smallest tables."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest

from quillspark.llm import op1_quality_rules as q1

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quantile(values, p):
    """The element that percentile_approx gives for few rows."""
    s = sorted(values)
    return s[max(0, math.ceil(p * len(s)) - 1)]


def stats(t):
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines), len(lines) - len(set(lines)), len(repeated), sum(x.isupper() for x in t)


def robust(rows, h=0.75, steps=20, smallest=50):
    """Ids that the quality rules keep. rows: doc_id, text, lang, source."""
    info = {d: (stats(t), lang, source) for d, t, lang, source in rows}
    failed = {d for d, (s, *_) in info.items() if s[0] < 10 or 100 * s[5] > 20 * s[0]}
    size = collections.Counter((lang, source) for d, (_, lang, source) in info.items() if d not in failed)
    by_lang = collections.Counter()
    for (lang, _), n in size.items():
        by_lang[lang] += n if n < smallest else 0
    pool = lambda lang, source: (lang, source) if size[lang, source] >= smallest else (lang,) if by_lang[lang] >= smallest else ()
    groups = collections.defaultdict(list)
    for d, (_, lang, source) in info.items():
        if d not in failed:
            groups[pool(lang, source)].append(d)
    floor, prior = np.array([q1.FLOOR[x] for x in q1.X]), [q1.PRIOR[x] for x in q1.X]
    kept = set()
    for ids in groups.values():
        pairs = {d: [(s[1], s[0]), (s[2], s[0]), (s[6], s[1]), (s[4], s[3]), (s[5], s[0])] for d in ids for s in [info[d][0]]}
        centre = [quantile([a / max(b, 1) for a, b in (pairs[d][k] for d in ids)], 0.5) for k in range(5)]
        x = np.array([[(math.log if k == 0 else math.sqrt)((a + prior[k] * centre[k]) / (b + prior[k]) + (0.01 if k == 0 else 0)) for k, (a, b) in enumerate(pairs[d])] for d in ids])
        med = np.array([quantile(c, 0.5) for c in x.T])
        mad = np.array([1.4826 * quantile(np.abs(c), 0.5) for c in (x - med).T])
        z = np.abs(x - med) / np.maximum(mad, floor)
        found = []
        for d in ((z**2).sum(axis=1), z.max(axis=1), z.sum(axis=1)):
            was = math.inf
            for _ in range(steps + 1):
                near = x[d <= quantile(d, h)]
                mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)
                cov += np.diag(np.maximum(floor**2 - np.diag(cov), 0))
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                now = np.linalg.slogdet(cov)[1]
                if now >= was - 1e-3:
                    break
                was = now
            found.append((np.linalg.slogdet(cov)[1], len(found), d, mean, np.cov(near.T, bias=True)))
        _, _, d, mean, cov = min(found, key=lambda f: (round(f[0], 9), f[1]))
        free = max(1, int((np.diag(cov) > floor**2).sum()))
        cov = cov * max(1.0, quantile(d, 0.5) / q1.CHI2_MEDIAN[free - 1])
        cov += np.diag(np.maximum(floor**2 - np.diag(cov), 0))
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        kept |= {i for i, v in zip(ids, d, strict=True) if len(ids) < smallest or v <= q1.CHI2_CUT}
    return kept


def lines(rows):
    seen, gone = set(), collections.defaultdict(set)
    for d, t in sorted(rows.items()):
        at = t.split("\n")
        w = [i for i, x in enumerate(at) if WORD.search(x)]
        for a, b in zip(w, w[1:]):
            if (at[a], at[b]) in seen:
                gone[d] |= {a, b}
            seen.add((at[a], at[b]))
        for a in w:
            if len(WORD.findall(at[a])) >= 10:
                if at[a] in seen:
                    gone[d].add(a)
                seen.add(at[a])
    out = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows.items()}
    return {d: t for d, t in out.items() if not gone[d] or WORD.search(t)}


def near(rows):
    sets = {}
    for d, t in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(len(links) + 1):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {d: t for d, t in rows.items() if label[d] == d}


def clean(rows, items):
    def words(t):
        return re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()

    def hit(w, item):
        for shift in range(1 - len(item), len(w)):
            lo, hi = max(0, shift), min(len(w), shift + len(item))
            best = run = equal = top = 0
            for i in range(lo, hi):
                same = w[i] == item[i - shift]
                run, equal = (run + 1, equal + 1) if same else (run - 3, equal)
                if run <= 0:
                    run = equal = 0
                if run > best:
                    best, top = run, equal
            if top >= min(13, len(item)):
                return True
        return False

    items = [words(t) for t in items]
    every = [{tuple(i[k : k + 4]) for k in range(len(i) - 3)} for i in items]
    out = {}
    for d, t in rows.items():
        w = words(t)
        grams = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        if not any(g & grams and hit(w, i) for i, g in zip(items, every, strict=True)):
            out[d] = t
    return out


def mixed(rows, where):
    def water(children, budget):
        if sum(c for c, _ in children) <= budget:
            return [float(c) for c, _ in children]
        lo, hi = 0.0, 1e15
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(min(c, mid * w) for c, w in children) > budget else (mid, hi)
        return [min(c, lo * w) for c, w in children]

    own = {d: (["web", "books", "forum"][int(re.search(r"\d+$", where[d][1])[0]) % 3], *where[d]) for d in rows}
    size = {d: len(WORD.findall(t)) for d, t in rows.items()}
    leaf = collections.Counter()
    for d in rows:
        leaf[own[d]] += size[d]
    leaf = +leaf

    def go(path, b):
        if len(path) == 3:
            return {path: int(b + 1e-6)}
        kids = sorted({k[: len(path) + 1] for k in leaf if k[: len(path)] == path})
        weight = [{"web": 5.0, "books": 3.0, "forum": 2.0}[k[0]] if len(k) == 1 else 2.0 if len(k) == 2 and k[1] == "en" else 1.0 for k in kids]
        cap = [4 * sum(v for j, v in leaf.items() if j[: len(k)] == k) for k in kids]
        out = {}
        for k, share in zip(kids, water(list(zip(cap, weight, strict=True)), b), strict=True):
            out |= go(k, share)
        return out

    copies = {}
    for k, budget in go((), sum(leaf.values())).items():
        whole, left = divmod(budget, leaf[k])
        run = 0
        for _, d in sorted((int(hashlib.sha256(f"17:{whole}:{d}".encode()).hexdigest()[:8], 16), d) for d in rows if own[d] == k and size[d]):
            run += size[d]
            if n := whole + (run <= left):
                copies[d] = n
    return copies


def test_pipeline_against_a_plain_program(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = robust(docs)
    rows = clean(near(lines({d: t for d, t, *_ in docs if d in kept})), items)
    copies = mixed(rows, {d: (lang, source) for d, _, lang, source in docs})
    got = pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, r.copies) for r in got} == {d: (rows[d], n) for d, n in copies.items()}
