"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are counts of the line (lengths, symbols, capitals, digits, repetition) and
those of the lines before and after it. The chain's weights are learned by maximum likelihood, with the document's
label on each of its lines as the (weak) label of the line. Forward-backward gives each line's marginal probability of being
good; a text's quality is their mean weighted by length, and a one-variable logistic fit on the training
documents turns it into the probability of label 1.

Learning takes at most ``TRAIN`` labelled documents in expectation, picked by a hash of the id. Cases: null and empty
texts have no lines and get the training share of label 1; so does everything when the training labels are all equal or
absent (0.5 then). Null labels teach nothing; of repeated labels of an id each counts, and so does each repeated row of documents. Extra columns
are ignored. An empty table gives no rows, and learning from one gives 0.5 everywhere. Texts are scored whole: those of like length
are padded together to at most ``PADDED`` lines in all, and a longer one goes by itself, its features in pieces of ``PIECE`` lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import arrow_rows

TRAIN, THRESHOLD = 4_000, 0.3
#: Passes over the training documents, documents a step, step size and weight decay of the fit.
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.05, 1e-4
#: Lines, padding included, that are scored together; lines whose features are widened at a time.
PADDED, PIECE = 64 * 512, 4096
_SYMBOLS, _DIGITS, _UPPER, _ENDS = b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), (b".", b"!", b"?", b":")
_N = 11


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0


def lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with a word, and its length."""
    own, done, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, chars = len(w), sum(map(len, w))
        less = lambda drop: (chars - len(b"".join(w).translate(None, drop))) / chars  # noqa: B023, E731
        own.append((
            np.log(n), chars / n, less(_SYMBOLS), less(_UPPER), less(_DIGITS), less(b"!"), less(b".,;:"), len(set(w)) / n,
            w.count(b"|") / n, float(line in seen), float(w[-1].endswith(_ENDS)), chars,
        ))
        seen.add(line)
        if len(own) == PIECE:
            done.append(np.array(own))
            own = []
    x = np.vstack([*done, np.array(own).reshape(-1, _N + 1)])
    return x[:, :_N], x[:, _N]


def around(f: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and those of the line after (zeros where there is none)."""
    none = np.zeros((1, _N))
    return np.hstack([f, np.vstack([none, f[:-1]]), np.vstack([f[1:], none])])


def _forward_backward(e: np.ndarray, real: np.ndarray, t: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good for padded emission scores ``e`` (documents x lines), and expected transitions (2 x 2; zeros if not asked for).

    ``t``: transition scores. Lines beyond a text's end (``real`` false) pass states on unchanged.
    """
    n, m = e.shape
    a, b = np.zeros((m, n, 2)), np.zeros((m, n, 2))
    a[0, :, 1] = e[:, 0]
    for i in range(1, m):
        step = np.logaddexp(a[i - 1, :, :1] + t[0], a[i - 1, :, 1:] + t[1])
        step[:, 1] += e[:, i]
        a[i] = np.where(real[:, i, None], step, a[i - 1])
    for i in range(m - 2, -1, -1):
        ahead = b[i + 1].copy()
        ahead[:, 1] += e[:, i + 1]
        step = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
        b[i] = np.where(real[:, i + 1, None], step, b[i + 1])
    z = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
    good = np.exp(np.clip(a[:, :, 1] + b[:, :, 1] - z, -50, 0)).T
    pairs = np.zeros((2, 2))
    for i in range(1, m if transitions else 0):
        for x in range(2):
            for y in range(2):
                s = a[i - 1, :, x] + t[x, y] + (e[:, i] if y else 0) + b[i, :, y] - z
                pairs[x, y] += np.exp(np.clip(s, -50, 0))[real[:, i]].sum()
    return good, pairs


def _padded(docs: list[np.ndarray], columns: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    m = max(map(len, docs))
    out, real = np.zeros((len(docs), m) if columns is None else (len(docs), m, columns)), np.zeros((len(docs), m), bool)
    for i, d in enumerate(docs):
        out[i, : len(d)], real[i, : len(d)] = d, True
    return out, real


class Model:
    """Scaling, emission weights, transitions and the final logistic."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        use = [i for i, (x, _) in enumerate(docs) if len(x)]
        self.fitted = len({int(labels[i]) for i in use}) == 2
        if not self.fitted:
            return
        xs, y = [around(docs[i][0]) for i in use], labels[use].astype(float)
        every = np.vstack(xs)
        self.mean, self.std = every.mean(axis=0), every.std(axis=0) + 1e-6
        xs = [np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))]) for x in xs]
        order = np.argsort([len(x) for x in xs], kind="stable")
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]  # texts of like length share a step
        w, t = np.zeros(every.shape[1] + 1), np.zeros((2, 2))
        g1, g2, rng, k = np.zeros(len(w) + 4), np.zeros(len(w) + 4), np.random.default_rng(0), 0
        padded = [(*_padded([xs[i] for i in g], every.shape[1] + 1), y[g]) for g in groups]
        for epoch in range(EPOCHS):
            for at in rng.permutation(len(padded)):
                x, real, label = padded[at]
                good, pairs = _forward_backward(x @ w, real, t)
                off = np.where(real, label[:, None] - good, 0)
                same = np.array([[((real.sum(axis=1) - 1) * (1 - label)).sum(), 0], [0, ((real.sum(axis=1) - 1) * label).sum()]])
                count = real.sum()
                g = np.concatenate([np.einsum("nm,nmk->k", off, x) / count - DECAY * w, ((same - pairs) / count - 1e-3 * t).ravel()])
                k += 1
                g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
                step = RATE / (1 + epoch / 10) * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.99**k)) + 1e-8)
                w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
        self.w, self.t, self.a, self.b = w, t, 1.0, 0.0
        q = self._logit(self.raw([docs[i] for i in use]))
        for _ in range(50):  # Newton steps of the logistic, lightly damped towards a = 1
            p = 1 / (1 + np.exp(-(self.a * q + self.b)))
            r = p * (1 - p) + 1e-6
            h = np.array([[(r * q * q).sum() + 1, (r * q).sum()], [(r * q).sum(), r.sum() + 1e-3]])
            d = np.linalg.solve(h, np.array([((y - p) * q).sum() - (self.a - 1), (y - p).sum()]))
            self.a, self.b = self.a + float(np.clip(d[0], -1, 1)), self.b + float(np.clip(d[1], -1, 1))

    @staticmethod
    def _logit(q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def emissions(self, f: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(f), PIECE):
            before = min(at, 1)
            x = around(f[at - before : at + PIECE + 1])[before : before + PIECE]
            parts.append(((x - self.mean) / self.std) @ self.w[:-1] + self.w[-1])
        return np.concatenate(parts)

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted means of the marginals; texts of like length are padded together."""
        out = np.zeros(len(docs))
        order = np.argsort([len(x) for x, _ in docs], kind="stable")
        at = 0
        while at < len(order):
            to = at + 1
            while to < min(at + 64, len(order)) and (to + 1 - at) * len(docs[order[to]][0]) <= PADDED:
                to += 1
            some = [docs[i] for i in order[at:to]]
            e, real = _padded([self.emissions(x) for x, _ in some])
            n, _ = _padded([n for _, n in some])
            good, _ = _forward_backward(e, real, self.t, False)
            out[order[at:to]] = (good * n).sum(axis=1) / n.sum(axis=1)
            at = to
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.fitted:
            docs = [lines(t) for t in texts]
            use = [i for i, (x, _) in enumerate(docs) if len(x)]
            if use:
                out[use] = 1 / (1 + np.exp(-(self.a * self._logit(self.raw([docs[i] for i in use])) + self.b)))
        return out


def _features() -> Callable:
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64())), ("n", pa.list_(pa.float64()))])

    def run(batches):
        for label, text in W.rows(batches, "label", "text"):
            x, n = lines(text)
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64())), pa.array([n], pa.list_(pa.float64()))], schema=schema)

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id, label (0 or 1). Only rows that are not held out are used."""
    arrow_rows(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).select("doc_id", F.col("label").cast("int").alias("label"))
    share = min(1.0, TRAIN / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < share * 1_000_000)
    # the sample's size is bounded by TRAIN, so it may be broadcast, and its features collected
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_features(), "label int, x array<double>, n array<double>").collect()
    rows.sort(key=lambda r: (len(r["x"]), r["label"], r["x"]))  # one order, whatever the tasks' was
    return Model([(np.array(r["x"]).reshape(-1, _N), np.array(r["n"])) for r in rows], np.array([r["label"] for r in rows]))


def _predict(model) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(np.round(model.value.score(texts), 6))], schema=schema)

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score; only doc_id and text are read."""
    spark = docs.sparkSession
    arrow_rows(spark)
    return docs.select("doc_id", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = classify(docs, learn(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
