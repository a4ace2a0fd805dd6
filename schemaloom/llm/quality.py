"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted positives are labelled rows of quality 1 in the learning fold; the
unlabelled side is web text of unknown quality.  The class prior is estimated
from a first classifier of positives against unlabelled text, as the least
ratio of their shares above a score.  The model minimises the non-negative
unbiased risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))  over features
of the whole text (character classes, word shapes, repetition).

The gradient steps see a bounded sample: at most ``SAMPLE`` trusted positives
and as many unlabelled documents, each chosen by hash of doc_id.  Everything
else covers all documents: means and scales of features, the class prior, and
the margin at which a text counts as good, which follows from the prior and the
documents' own margins.  Labels of bad text aren't used at all.  Labels,
language, source and doc_id are never inputs of a score.

Nulls: a null or empty text is scored as an empty text; a document with a null
doc_id is scored and counted but never in the sample.  Rows of ``labels`` with a
null doc_id or null quality are ignored; a document whose labels disagree isn't
a trusted positive.  Without any positive the score is 0.5 for all.  Repeated
rows are scored one by one.  Extra columns are kept by `score_documents`, but
for its results' names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import lean, slices, words
from .spark_util import written

SAMPLE = 8_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERS = np.zeros(256, bool)
_LOWERS[97:123] = True
_ALNUM = _UPPER | _LOWERS
_ALNUM[48:58] = True
_ALNUM[128:] = True
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[44, 46, 58, 59]] = True  # comma, full stop, colon, semicolon
_N_FEATURES = 32 + 10 + 13


def features(s) -> np.ndarray:
    """One row of features for each text of a slice."""
    n = len(s.offsets) - 1
    size = np.diff(s.offsets)
    doc = np.repeat(np.arange(n), size)
    bucket = np.full(256, 32, np.int64)  # the 32 ASCII symbols, then classes
    symbols = [c for c in range(33, 127) if not _ALNUM[c]]
    bucket[symbols] = np.arange(32)
    bucket[65:91], bucket[97:123], bucket[48:58], bucket[128:], bucket[32], bucket[10] = 33, 34, 35, 36, 37, 38
    counts = np.bincount(doc * 42 + bucket[s.data], minlength=n * 42).reshape(n, 42)
    share = np.sqrt(counts / np.maximum(size, 1)[:, None])
    starts, ends, h, first = words(s)
    nw = np.diff(first)
    per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first]) / np.maximum(nw, 1)
    within = lambda mask: (c := np.concatenate(([0], np.cumsum(mask[s.data]))))[ends] - c[starts]
    up, low, alnum, z = within(_UPPER), within(_LOWERS), within(_ALNUM), ends - starts
    tail = s.data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    wdoc = np.repeat(np.arange(n), nw)
    seen = np.unique(wdoc.astype(np.uint64) << np.uint64(42) | h >> np.uint64(22))  # 42 bits of a word's hash tell a text's words apart
    distinct = np.bincount((seen >> np.uint64(42)).astype(np.int64), minlength=n)
    mean = per(z)
    more = [
        np.log1p(size) / 10, np.log1p(nw) / 8, mean / 10, np.sqrt(np.maximum(0, per(z * z) - mean * mean)) / 10,
        np.sqrt(per((up >= 2) & (low == 0))), np.sqrt(per(alnum == 0)), np.sqrt(per((alnum > 0) & ~_ALNUM[tail] & ~_PLAIN_END[tail])),
        np.sqrt(per(_PLAIN_END[tail])), np.sqrt(per(again)), distinct / np.maximum(nw, 1), np.log1p(nw) / 8 * (1 - distinct / np.maximum(nw, 1)),
        np.sqrt(per(z > 25)), nw == 0,
    ]
    return np.concatenate((share, np.stack(more, 1)), 1)


@dataclass
class Model:
    """Standardisation, one hidden layer, and the margin at which a text counts as good."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5
    cut: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def bound(self) -> float:
        """No margin is larger."""
        return float(np.abs(self.w2).sum() + abs(self.b2))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) - self.cut, -35, 35)))


def _fit(p: np.ndarray, u: np.ndarray, mean: np.ndarray, scale: np.ndarray, prior: float | None, steps: int, seed: int, hidden: int = 24) -> Model:
    """Minimise the risk by Adam; without a prior, plain logistic risk of positives against unlabelled text."""
    rng = np.random.default_rng(seed)
    p, u = np.clip((p - mean) / scale, -6, 6), np.clip((u - mean) / scale, -6, 6)
    d = p.shape[1]
    par = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par]
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -35, 35)))
    for t in range(1, steps + 1):
        a, b = p[rng.integers(len(p), size=512)], u[rng.integers(len(u), size=512)]
        x = np.concatenate((a, b))
        hid = np.tanh(x @ par[0] + par[1])
        out = hid @ par[2] + par[3]
        gp, gu = out[: len(a)], out[len(a) :]
        g = np.empty_like(out)
        if prior is None:
            g[: len(a)], g[len(a) :] = (sig(gp) - 1) / len(a), sig(gu) / len(b)
        else:
            # sigmoid loss: l(z) = sig(-z); R_P(+) = mean l(g), R(-) = mean l(-g)
            slope_p, slope_u = sig(gp) * sig(-gp), sig(gu) * sig(-gu)
            rest = sig(gu).mean() - prior * sig(gp).mean()
            if rest >= 0:
                g[: len(a)] = (-prior * slope_p - prior * slope_p) / len(a)
                g[len(a) :] = slope_u / len(b)
            else:  # the risk of negatives can't be below zero: step back from it
                g[: len(a)] = prior * slope_p / len(a)
                g[len(a) :] = -slope_u / len(b)
        back = np.outer(g, par[2]) * (1 - hid * hid)
        grad = [x.T @ back + 1e-4 * par[0], back.sum(0), hid.T @ g + 1e-4 * par[2], np.array([g.sum()])]
        rate = 0.01 * (1 - t / (steps + 1)) + 1e-4
        for k in range(4):
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            par[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, par[0], par[1], par[2], float(par[3][0]), prior or 0.5)


# ---- what is counted over all documents -----------------------------------------


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x (the features, packed) of every row, as a written table."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            yield pa.RecordBatch.from_arrays([s.rows.column(0), pa.array([r.tobytes() for r in features(s).astype("<f4")], pa.binary())], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, x binary"))


def _unpacked(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(-1, _N_FEATURES).astype(np.float64)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every feature over all rows; rounded, so that the order of sums doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(_N_FEATURES), np.zeros(_N_FEATURES)
        for b in batches:
            x = _unpacked(b.column(0))
            n, one, two = n + len(x), one + x.sum(0), two + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_N_FEATURES)), pa.array(np.full(_N_FEATURES, n)), pa.array(one), pa.array(two)], ["k", "n", "one", "two"])

    sums = rows.select("x").mapInArrow(lean(run), "k long, n long, one double, two double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).orderBy("k").collect()
    n, one, two = (np.array([r[c] for r in sums], float) for c in ("n", "one", "two"))
    mean = one / np.maximum(n, 1)
    return np.round(mean, 6), np.round(np.sqrt(np.maximum(0, two / np.maximum(n, 1) - mean * mean)), 6) + 1e-3


def _counts(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of what ``of`` (features, doc_ids to ``size`` counts) gives for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                total += of(_unpacked(b.column(1)), b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "n"])

    found = rows.select("doc_id", "x").mapInArrow(lean(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in found:
        out[r["k"]] = r["n"]
    return out


def estimate_prior(p: np.ndarray, u: np.ndarray, rows: DataFrame, mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> float:
    """Share of positives among all documents: the least ratio of the two sides' shares above a score.

    The positives are scored crosswise, each half by the model of the other; so
    are the documents, by a hash of their features.  Scores are bounded to cuts
    that keep a tenth of the positives, for a steady ratio.
    """
    half = np.arange(len(p)) % 2
    models = [_fit(p[half == k], u[np.arange(len(u)) % 2 == k], mean, scale, None, 400, seed + k) for k in (0, 1)]
    sp = np.empty(len(p))
    for k in (0, 1):
        sp[half != k] = models[k].margin(p[half != k])
    cuts = np.quantile(sp, np.linspace(0.02, 0.9, 45))

    def above(x: np.ndarray, ids: pa.Array) -> np.ndarray:
        s = np.where((x.sum(1) * 1000).astype(np.int64) % 2 == 0, models[0].margin(x), models[1].margin(x))
        return np.append((s[:, None] >= cuts).sum(0), len(s))

    n = _counts(rows, above, len(cuts) + 1)
    share = (sp[:, None] >= cuts).mean(0)
    return float(np.clip((n[:-1] / max(1, n[-1]) / np.maximum(share, 1e-9)).min(), 0.05, 0.98))


BINS = 512


def place_cut(model: Model, positives: np.ndarray, rows: DataFrame) -> float:
    """The margin that parts good from bad, by the prior, the trusted positives and all documents' margins.

    The unbiased estimate of the share of wrong verdicts above a cut is twice the prior's share of positives lost, plus the
    share of documents kept, less the prior.  Of the cuts within half a hundredth of the least estimate the one in the
    emptiest stretch of margins is taken.  Labels of bad text take no part.
    """
    top = model.bound() + 1e-9
    place = lambda x: np.clip(((model.margin(x) + top) / (2 * top) * BINS).astype(np.int64), 0, BINS - 1)
    n = _counts(rows, lambda x, ids: np.bincount(place(x), minlength=BINS), BINS)
    kept = n[::-1].cumsum()[::-1] / max(1, n.sum())  # at or above a bin's lower end
    own = np.bincount(place(positives), minlength=BINS)
    lost = (own.cumsum() - own) / len(positives)
    wrong = 2 * model.prior * lost + kept
    able = np.flatnonzero(wrong <= wrong.min() + 0.005)
    near = np.convolve(n, np.ones(9), "same")[able]
    best = able[near == near.min()]
    return float(best[len(best) // 2] / BINS * 2 * top - top)


def fold(doc_id: Column) -> Column:
    """The fold of a document: the checksum of its id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 1) -> Model | None:
    """Learn from documents (as `featured` gives them) outside the held-out fold; None if there are no trusted positives."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != held_out))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = 1 and high = 1")
    # at most ``sample`` ids on each side: a proven bound for the broadcast below
    trusted = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample).select("doc_id", F.lit(1).alias("kind"))
    other = rows.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out)).distinct()
    other = other.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(sample).select("doc_id", F.lit(0).alias("kind"))
    # rows that repeat a doc_id are one, so the sample stays within its bound
    chosen = rows.join(F.broadcast(trusted.unionByName(other)), "doc_id").groupBy("kind", "doc_id").agg(F.min("x").alias("x")).select("kind", "x").collect()
    # sorted: the same model whatever order rows come in
    by = [sorted(bytes(r["x"]) for r in chosen if r["kind"] == k) for k in (0, 1)]
    if not by[0] or not by[1]:
        return None
    unl, pos = (np.frombuffer(b"".join(x), "<f4").reshape(-1, _N_FEATURES).astype(np.float64) for x in by)
    unl, pos = (x[np.random.default_rng(5).permutation(len(x))] for x in (unl, pos))
    mean, scale = _moments(rows)
    prior = estimate_prior(pos, unl, rows, mean, scale) if len(pos) > 1 and len(unl) > 1 else 0.5
    model = _fit(pos, unl, mean, scale, prior, int(np.clip(len(pos) // 5, 200, 1500)), 1)  # few positives: fewer steps
    model.cut = place_cut(model, pos, rows)
    return model


def score_features(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row that `featured` gave."""
    return _scored(rows, model, "x", lambda x: model.score(np.frombuffer(b"".join(x), "<f4").reshape(-1, _N_FEATURES).astype(np.float64))).drop("x")


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 if score >= 0.5); columns of docs with these names are replaced."""

    def run(texts: pd.Series) -> np.ndarray:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
        out = [model.score(features(s).astype("<f4").astype(np.float64)) for s in slices([batch])]
        return np.concatenate(out) if out else np.empty(0)

    return _scored(docs, model, F.col("text").cast("binary"), run)


def _scored(rows: DataFrame, model: Model | None, of, run) -> DataFrame:
    if model is None:
        return rows.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(1))
    out = rows.withColumn("score", F.pandas_udf(lambda x: pd.Series(run(x), dtype="float64"), "double")(of))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
