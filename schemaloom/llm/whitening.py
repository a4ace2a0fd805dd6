"""Whitening of embeddings by upper-triangle column aggregates.

Entries become integers (``floor(1024 c) + 100000``), so that sums over any
number of rows are exact.  One pass sums every dimension; a second sums the
centred product of every pair of dimensions in one aggregation of generated
SQL expressions, d(d+1)/2 of them.  The driver assembles the covariance, a
d x d matrix, and decomposes it with LAPACK; Arrow batches then project every row
where it lies.  A last pass runs the same aggregation over the whitened columns
and so measures how far their covariance is from the identity.

Only sums travel: one row of partial sums a task, which meet in ``FAN`` rows, and
these on the driver.  No key is involved, so no row or label can be hot.  Vectors
of more than ``PAIRS`` pairs take several passes, each over a run of pairs.

Which rows take part: those whose vector is not null, holds no null and no
non-finite entry, and has the largest length found among such vectors (others
are dropped, like the null ones).  Zero vectors take part; empty ones only if
all are, and then there is no component and no row.  Entries beyond 2**62 / 1024
count as that bound.  Null and repeated vec_ids are kept, repeated rows count
each time.  A component without variance (fewer distinct vectors than
dimensions, constant dimensions) has whitened 0 and stays out of
``identity_error``; where nothing varies ``explained`` is null.  Equal
eigenvalues are numbered as LAPACK gives them.  An empty table gives an empty
one.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
PAIRS = 5_000  # expressions of one aggregation
FAN = 64
_BOUND = float(1 << 62)


def finite(v: Column) -> Column:
    """Vectors without null or non-finite entries."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def entries(df: DataFrame, d: int, keys: Sequence[str] = ()) -> DataFrame:
    """The keys and x0 ... x(d-1), long, of the rows that take part."""
    x = [f"floor(least(greatest(double(_v[{i}]) * {SCALE}, {-_BOUND!r}D), {_BOUND!r}D)) + {SHIFT}L AS x{i}" for i in range(d)]
    rows = df.select(*keys, F.col("embedding").alias("_v")).filter(finite(F.col("_v")) & (F.size("_v") == d))
    return rows.selectExpr(*keys, *x)


def summed(df: DataFrame, exprs: Sequence[str]) -> list[float]:
    """One sum for each aggregate expression: tasks' sums meet in FAN rows, and these on the driver."""
    out: list[float] = []
    for k in range(0, len(exprs), PAIRS):
        part = [F.expr(e).alias(f"s{i}") for i, e in enumerate(exprs[k : k + PAIRS])]
        rows = df.groupBy(_fan()).agg(*part).drop("_fan").collect()  # FAN rows at most
        out += [math.fsum(column) for column in zip(*rows, strict=True)]
    return out


def _fan() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("_fan")


@dataclass(frozen=True)
class Moments:
    """Of the fit list: rows, exact sums and bounds of every dimension, covariance (divisor n)."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    covariance: np.ndarray

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]  # of integers: rounded once


def upper_triangle(names: Sequence[str], means: Sequence[float]) -> list[str]:
    """Sums of centred columns, then of the centred products of every pair i <= j."""
    c = [f"(double({x}) - {m!r}D)" for x, m in zip(names, means, strict=True)]
    return [f"sum({x})" for x in c] + [f"sum({c[i]} * {c[j]})" for i in range(len(c)) for j in range(i, len(c))]


def assemble(values: Sequence[float], d: int, n: int) -> np.ndarray:
    """The covariance from upper_triangle's sums: what the rounded means left uncentred is taken off."""
    left, out, upper = np.array(values[:d], float), np.zeros((d, d)), np.triu_indices(d)
    out[upper] = values[d:]
    out -= np.outer(left, left) / n
    return np.triu(out / n) + np.triu(out / n, 1).T


def fit(df: DataFrame) -> Moments | None:
    """Moments of all vectors of ``embedding``; None where no row takes part or the vectors are empty."""
    longest = df.filter(finite(F.col("embedding"))).agg(F.max(F.size("embedding"))).head()[0]
    if not longest:
        return None
    d = longest
    x, names = entries(df, d), [f"x{i}" for i in range(d)]
    bounds = [F.expr(f"{f}({c})").alias(f"{f}{c}") for c in names for f in ("min", "max")]
    parts = x.groupBy(_fan()).agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(CAST({c} AS DECIMAL(20,0)))").alias(f"sum{c}") for c in names], *bounds).collect()  # FAN rows at most
    n, sums = sum(p["n"] for p in parts), [int(sum(p[f"sum{c}"] for p in parts)) for c in names]
    low, high = ([f(p[f"{f.__name__}{c}"] for p in parts) for c in names] for f in (min, max))
    means = [s / n for s in sums]
    values = summed(x, upper_triangle(names, means))
    return Moments(n, sums, low, high, assemble(values, d, n))


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; eigenvalues within rounding of nothing are 0."""
    e, w = np.linalg.eigh(covariance)
    e, w = e[::-1].copy(), w[:, ::-1].T
    e[e <= len(e) * np.finfo(float).eps * max(float(e[0]), 0.0)] = 0.0
    return e, w


def _project(m: Moments, weights: np.ndarray):
    """Batches of keys and entries to keys, exact deviations and whitened components."""
    worst = [max(abs(m.n * lo - s), abs(m.n * hi - s)) for lo, hi, s in zip(m.low, m.high, m.sums, strict=True)]
    fits = sum(w * w for w in worst) < 1 << 63 and m.n * max(map(abs, (*m.low, *m.high))) < 1 << 63
    kind = np.int64 if fits else object  # Python's integers where longs could overflow
    sums, means = np.array(m.sums, kind), np.array(m.means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy() for i in range(len(m.sums))], axis=1)
            away = ((m.n * x.astype(kind) - sums) ** 2).sum(1).tolist()
            w = (x - means) @ weights.T
            told = [v if v < 1 << 63 else None for v in away]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.int64()), *map(pa.array, w.T)], ["vec_id", "deviation", *[f"w{k}" for k in range(len(weights))]])

    return run


def whiten(df: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component up to ``components``.

    deviation is null where the exact number is beyond a long.
    """
    kind = df.schema["vec_id"].dataType.simpleString()
    m = fit(df)
    if m is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    d = len(m.sums)
    e, vectors = decompose(m.covariance)
    top, total = min(components, d), float(np.trace(m.covariance))
    scale = [1 / math.sqrt(x) if x > 0 else 0.0 for x in e[:top]]
    weights = vectors[:top] * np.array(scale)[:, None]
    columns = [f"w{k}" for k in range(top)]
    rows = entries(df, d, ["vec_id"]).mapInArrow(_project(m, weights), ", ".join([f"vec_id {kind}", "deviation long", *[f"{c} double" for c in columns]]))
    live = [c for c, x in zip(columns, scale, strict=True) if x > 0]
    error = None
    if live:
        means = [s / m.n for s in summed(rows, [f"sum({c})" for c in live])]
        error = float(np.abs(assemble(summed(rows, upper_triangle(live, means)), len(live), m.n) - np.eye(len(live))).max())
    told = [F.struct(F.lit(k + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(e[k]) / total if total > 0 else None).cast("double").alias("explained")) for k, c in enumerate(columns)]
    out = rows.select("vec_id", "deviation", F.explode(F.array(*told)).alias("c"))
    return out.select("vec_id", "c.component", F.lit(m.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
