"""Approximate nearest neighbours by shifted space-filling curves.

Vectors (unit length) are projected to a few dimensions by several random
orthonormal maps, shifted, and ordered along a Hilbert curve for each map.
Spark range-partitions every ordering and numbers its rows.  A query is compared
with the ``radius`` rows before and after it on every curve; the windows' best
are merged and reranked by the exact cosine of the original vectors.  Windows
are worked off in blocks of a curve, so memory doesn't depend on the radius.

The radius isn't guessed: a bounded set of audit queries is answered by brute
force, and the least radius whose windows hold ``target`` of their true
neighbours is taken.  On vectors without structure that radius is a good part of
the table; on clustered ones it is a few rows.

Vectors that are null, zero or hold null or non-finite components take no
part, neither do those whose length differs from the most frequent one.  Rows
with a null id take no part.  Ties go to the smaller id.  Rows with the same
id are one candidate.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import lean
from .spark_util import parallelism, written
from .vectors import cosine, element, matrix, stacked, unit, valid

AUDIT = 128


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points x (n rows, d columns, ``bits`` bits each); d * bits <= 63.

    Skilling's transform (2004), over all points at once.
    """
    x = x.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _maps(dim: int, curves: int, out_dim: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(np.linalg.qr(rng.normal(size=(dim, min(out_dim, dim))))[0], rng.uniform(0, 1, min(out_dim, dim))) for _ in range(curves)]


def curve_keys(u: np.ndarray, maps, bits: int) -> np.ndarray:
    """Hilbert keys of unit vectors on every curve: one row for each curve."""
    out = []
    for m, shift in maps:
        y = (u @ m) * (0.5 * np.sqrt(u.shape[1] / 3))  # spreads the usual range of a projection over (0, 1)
        cell = np.clip((y / 2 + 0.5 + shift) / 2, 0, 1 - 1e-9)
        out.append(hilbert((cell * (1 << bits)).astype(np.int64), bits))
    return np.stack(out)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - 2 * k)[len(scores) - 2 * k] - 1e-9)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def search(
    table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    curves: int = 16, out_dim: int = 6, bits: int = 10, block: int = 4096, target: float = 0.95, seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every row where ``is_query`` holds."""
    spark = table.sparkSession
    kind = element(table, vector)
    rows = table.filter(F.col(vec_id).isNotNull() & valid(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), is_query.alias("q"), F.col(vector).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim = sizes[0]["d"]
    maps = _maps(dim, curves, out_dim, seed)
    rows = rows.filter(F.size("v") == dim)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2), kind)
            keys = curve_keys(unit(x.astype(np.float64)), maps, bits)
            blobs = pa.array([r.tobytes() for r in x], pa.binary())
            for c in range(len(maps)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(keys[c]), b.column(0), b.column(1), blobs], ["curve", "key", "id", "q", "v"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers of the rows within this range partition, in the order of each curve."""
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            c = b.column(0).to_numpy()
            local = np.empty(len(c), np.int64)
            for x in np.unique(c):
                at = np.flatnonzero(c == x)
                local[at] = seen.get(x, 0) + np.arange(len(at))
                seen[x] = seen.get(x, 0) + len(at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(local), *b.columns[2:]], ["curve", "part", "local", "id", "q", "v"])

    ordered = rows.mapInArrow(lean(keyed), "curve int, key long, id long, q boolean, v binary").repartitionByRange(parallelism(spark), "curve", "key").sortWithinPartitions("curve", "key", "id")
    placed = written(ordered.mapInArrow(lean(numbered), "curve int, part int, local long, id long, q boolean, v binary"))
    # one row for each curve and range partition: bounded by the partitions
    first: dict[tuple[int, int], int] = {}
    total: dict[int, int] = {}
    for r in placed.groupBy("curve", "part").agg(F.max("local").alias("n")).orderBy("curve", "part").collect():
        first[r["curve"], r["part"]] = total.get(r["curve"], 0)
        total[r["curve"]] = total.get(r["curve"], 0) + r["n"] + 1
    if not total:
        return empty
    base = F.create_map(*[F.lit(x) for (c, p), n in first.items() for x in (c << 32 | p, n)])
    ranked = placed.select("curve", (F.col("local") + base[F.shiftleft(F.col("curve").cast("long"), 32).bitwiseOR(F.col("part").cast("long"))]).alias("rank"), "id", "q", "v")
    radius = _radius(ranked, kind, k, target, max(total.values()))

    def windows(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """The queries whose window reaches into one block, against the rows of their windows in it."""
        own = pdf[~pdf["visitor"]].sort_values("rank")
        asks = pdf[pdf["visitor"]]
        out = []
        if len(own) and len(asks):
            base, ids, rank = stacked(own["v"].tolist(), kind), own["id"].to_numpy(), own["rank"].to_numpy()
            n = unit(base)
            for q, r, v in zip(asks["id"], asks["rank"], asks["v"], strict=True):
                a, z = np.searchsorted(rank, [r - radius, r + radius + 1])
                one = np.frombuffer(v, kind).astype(np.float64)
                s = n[a:z] @ unit(one[None])[0]
                s[ids[a:z] == q] = -np.inf
                at = a + _distinct_best(s, ids[a:z], k)
                exact = cosine(base[at], np.broadcast_to(one, (len(at), len(one))))
                out += [(q, int(i), float(x)) for i, x in zip(ids[at], exact, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    limits = F.create_map(*[F.lit(x) for c in total for x in (c, (total[c] - 1) // block)])
    low, high = F.greatest(F.floor((F.col("rank") - radius) / block), F.lit(0)), F.least(F.floor((F.col("rank") + radius) / block), limits[F.col("curve")])
    visits = ranked.filter("q").select("curve", F.explode(F.sequence(low, high)).alias("block"), "rank", "id", F.lit(True).alias("visitor"), "v")
    meet = ranked.select("curve", F.floor(F.col("rank") / block).alias("block"), "rank", "id", F.lit(False).alias("visitor"), "v").unionByName(visits)
    found = meet.groupBy("curve", "block").applyInPandas(windows, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distinct_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best ids and some to spare (rounding may turn them about), the best row of each id."""
    m = 2 * k
    while True:
        at = _best(scores, ids, m)
        at = at[np.isfinite(scores[at])]
        at = at[np.sort(np.unique(ids[at], return_index=True)[1])]
        if len(at) > k or m >= len(scores):
            return at[: 2 * k]
        m *= 4


def _radius(ranked: DataFrame, kind: str, k: int, target: float, rows: int) -> int:
    """The least number of rows on either side whose windows hold ``target`` of the audit's true neighbours."""
    spark = ranked.sparkSession
    one = ranked.filter("curve = 0")
    audit = one.filter("q").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(AUDIT).select("id", "v").collect()
    if not audit:
        return 0
    ask_ids = np.array([r["id"] for r in audit])
    asks = unit(stacked([bytes(r["v"]) for r in audit], kind))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            s = asks @ unit(stacked(b.column(1).to_pylist(), kind)).T
            s[ask_ids[:, None] == ids[None, :]] = -np.inf
            out = [(int(ask_ids[i]), int(ids[j]), float(s[i, j])) for i in range(len(asks)) for j in _distinct_best(s[i], ids, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["ask", "id", "s"])

    near = one.select("id", "v").mapInArrow(lean(brute), "ask long, id long, s double").groupBy("ask", "id").agg(F.max("s").alias("s"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("s"), "id"))).filter(F.col("r") <= k)
    pairs = [(r["ask"], r["id"]) for r in near.collect()]  # at most AUDIT * k
    if not pairs:
        return 0
    wanted = sorted({x for p in pairs for x in p})
    # at most AUDIT * (k + 1) ids: a proven bound
    ids = F.broadcast(spark.createDataFrame([(x,) for x in wanted], "id long"))
    at = {(r["curve"], r["id"]): r["rank"] for r in ranked.join(ids, "id").groupBy("curve", "id").agg(F.min("rank").alias("rank")).collect()}
    curves = sorted({c for c, _ in at})
    gaps = sorted(min(abs(at[c, a] - at[c, b]) for c in curves) for a, b in pairs)
    return min(rows, max(2 * k, gaps[min(len(gaps) - 1, int(np.ceil(target * len(gaps))) - 1)]))
