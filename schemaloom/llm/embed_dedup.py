"""Near-dedup of embeddings by NN-descent.

Vectors are compared only within their label.  Equal vectors are one node with
a multiplicity.  The first graph comes from several orders by random sign
codes of the vectors less their mean: each node meets the next rows of its label
in every order.  NN-descent then refines it: neighbours of neighbours are
compared until few edges improve.  Lists hold the ``k`` best neighbours whatever
their cosine, and all over the threshold; a node whose whole list lies above the threshold is saturated, and its list is enlarged to
its whole component of threshold edges: members are compared block by block,
which also gives every member's exact number of links without emitting pairs.
A random sample of nodes is audited by brute force, each linked node with equal
weight; a recall under ``audit`` adds further orders and descends again.  If it
stays below after three tries, all vectors of a label are compared, block by
block, so the result is then exact.

Vectors that are null, zero or hold null or non-finite components, rows with a
null label, and vectors whose length no other of their label shares link with
nothing.  A row with a null vec_id links with nothing and has a null component.
Rows that repeat a vec_id are nodes' multiplicities or separate nodes by their
vectors; each gets its own result row.  Extra columns are ignored.

Skew: a label with a third of all rows is spread by range partitions and by
blocks; nothing gathers a label in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import lean
from .graph import components
from .minhash import _labels
from .spark_util import heavy_join, parallelism, written
from .vectors import cosine, element, matrix, stacked, unit, valid

BLOCK = 2048
AUDIT = 1024
CODE_BITS = 32


def _orders(n: int, reach: int, threshold: float) -> int:
    """How many sign-code orders leave a pair at the threshold unmet with a chance under 1 in 10,000."""
    same = 1 - np.arccos(min(1.0, threshold)) / np.pi
    depth = max(1.0, np.log2(max(2, n) / reach))
    return int(np.clip(np.ceil(np.log(1e-4) / np.log(1 - same**depth + 1e-12)), 4, 64))


def _means(nodes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The mean unit vector of every length: a direction common to all would make their sign codes alike."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in batches:
            v = b.column(0).to_pylist()
            size = np.array([len(x) for x in v])
            for z in np.unique(size):
                x = unit(stacked([v[i] for i in np.flatnonzero(size == z)], kind))
                total[x.shape[1]] = total.get(x.shape[1], 0) + x.sum(0)
                n[x.shape[1]] = n.get(x.shape[1], 0) + len(x)
        for d, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(x), pa.array(np.full(d, n[d]))], ["d", "i", "x", "n"])

    out: dict[int, np.ndarray] = {}
    for r in nodes.select("v").mapInArrow(lean(sums), "d int, i int, x double, n long").groupBy("d", "i").agg((F.sum("x") / F.sum("n")).alias("m")).collect():
        out.setdefault(r["d"], np.zeros(r["d"]))[r["i"]] = r["m"]
    return out


def _first_graph(nodes: DataFrame, kind: str, orders: range, reach: int, means: dict[int, np.ndarray]) -> DataFrame:
    """Edges a < b between rows that stand near each other in some order."""
    spark = nodes.sparkSession

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(v):
                by_dim.setdefault(len(x), []).append(i)
            for at in by_dim.values():
                x = unit(stacked([v[i] for i in at], kind))
                x -= means[x.shape[1]]
                for t in orders:
                    planes = np.random.default_rng(1000 + t).normal(size=(x.shape[1], CODE_BITS))
                    code = ((x @ planes > 0) @ (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                    some = pa.array(at, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), b.column(1).take(some), pa.array(np.full(len(at), x.shape[1], np.int32)),
                            pa.array(code), b.column(0).take(some), b.column(2).take(some)], ["t", "label", "d", "code", "id", "v"])

    rows = nodes.select("id", "label", "v").mapInArrow(lean(coded), "t int, label long, d int, code long, id long, v binary")
    # ranges of whole codes overlap nowhere; a pair cut apart by a boundary meets in other orders
    dealt = rows.repartitionByRange(parallelism(spark), "t", "label", "d", "code", "id").sortWithinPartitions("t", "label", "d", "code", "id")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            rows = pa.Table.from_batches([b] if tail is None else [tail, b]).combine_chunks().to_batches()
            if not rows:
                continue
            rows = rows[0]
            fresh = rows.num_rows - b.num_rows
            t, label, d, ids = (rows.column(i).to_numpy() for i in (0, 1, 2, 4))
            v = rows.column(5).to_pylist()
            for dim in np.unique(d):
                at = np.flatnonzero(d == dim)
                u = unit(stacked([v[i] for i in at], kind))
                for g in range(1, reach + 1):
                    i, j = at[:-g], at[g:]
                    ok = (t[i] == t[j]) & (label[i] == label[j]) & (ids[i] != ids[j]) & (j >= fresh)
                    if ok.any():
                        s = (u[:-g] * u[g:]).sum(1)
                        a, c = np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s[ok])], ["a", "b", "s"])
            tail = rows.slice(max(0, rows.num_rows - reach))

    return dealt.mapInArrow(lean(near), "a long, b long, s double").groupBy("a", "b").agg(F.max("s").alias("s"))


def _ranked(edges: DataFrame) -> DataFrame:
    """id, nb, s, r: every node's neighbours, the best first, from edges in either direction."""
    lists = edges.select(F.col("a").alias("id"), F.col("b").alias("nb"), "s").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("nb"), "s"))
    return lists.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "nb")))


def _kept(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Edges that one end has among its k best, and all over the threshold."""
    some = _ranked(edges.groupBy("a", "b").agg(F.max("s").alias("s"))).filter((F.col("r") <= k) | (F.col("s") >= threshold))
    return some.select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b"), "s").groupBy("a", "b").agg(F.max("s").alias("s"))


def _join_neighbours(edges: DataFrame, nodes: DataFrame, kind: str, k: int, threshold: float) -> DataFrame:
    """Neighbours of neighbours: within every node's list all are compared; edges that better a list or reach the threshold."""
    ranked = _ranked(edges).filter(F.col("r") <= k).select("id", "nb", "s")
    worst = ranked.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.min("s")).otherwise(-2.0).alias("worst"))
    # the vector and the worst of its own list travel with the neighbour's id to the list's owner
    known = nodes.select("id", "v").join(worst.hint("merge"), "id").select(F.col("id").alias("nb"), "v", "worst")
    with_v = ranked.join(known.hint("merge"), "nb").select("id", "nb", "v", "worst")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of every list; lists are padded to k rows, so many are compared at once."""
        held = None
        for b in _ending(batches):
            rows = pa.Table.from_batches([x for x in (held, b) if x is not None]).combine_chunks() if b is not None else held
            if rows is None or not rows.num_rows:
                continue
            owner = rows.column("id").to_numpy()
            cut = rows.num_rows if b is None else int(np.searchsorted(owner, owner[-1], "left"))
            held = None if b is None else rows.slice(cut).combine_chunks().to_batches()[0]
            yield from _list_pairs(rows.slice(0, cut), kind, k, threshold)

    lists = with_v.repartition(parallelism(nodes.sparkSession), "id").sortWithinPartitions("id", "nb")
    return lists.mapInArrow(lean(pairs), "a long, b long, s double")


def _ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that hold rows, then None."""
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def _list_pairs(rows: pa.Table, kind: str, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    owner, nb, worst = (rows.column(c).to_numpy() for c in ("id", "nb", "worst"))
    v = rows.column("v").to_pylist()
    size = np.array([len(x) for x in v])
    for z in np.unique(size):
        at = np.flatnonzero(size == z)
        group = np.unique(owner[at], return_inverse=True)[1]
        place = np.arange(len(at)) - np.searchsorted(group, group)
        u = unit(stacked([v[i] for i in at], kind))
        for lo in range(0, int(group[-1]) + 1, 2000):  # so many lists at a time
            a, e = np.searchsorted(group, [lo, lo + 2000])
            g, p = group[a:e] - lo, place[a:e]
            m = np.zeros((int(g[-1]) + 1, k, u.shape[1]))
            m[g, p] = u[a:e]
            row = np.full((len(m), k), -1)
            row[g, p] = at[a:e]
            s = m @ m.transpose(0, 2, 1)
            least = np.where(row >= 0, worst[row], np.inf)
            hit = (s > np.minimum(least[:, :, None], least[:, None, :])) | (s >= threshold)
            hit &= (row >= 0)[:, :, None] & (row >= 0)[:, None, :] & np.triu(np.ones((k, k), bool), 1)
            x, i, j = np.nonzero(hit)
            n, o = nb[row[x, i]], nb[row[x, j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(n, o)), pa.array(np.maximum(n, o)), pa.array(s[x, i, j])], ["a", "b", "s"])


def _block_pairs(members: DataFrame, group: list[str]) -> DataFrame:
    """Rows of every group dealt to pairs of blocks lo <= hi."""
    members = written(members)
    sizes = written(members.groupBy(*group).agg(F.count(F.lit(1)).alias("size")))
    dealt = heavy_join(members, sizes, group, "size").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sides.select(*group, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *(c for c in members.columns if c not in group))


def _hits(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    s = unit(x) @ unit(y).T
    hit = s >= threshold
    for i, j in np.argwhere(np.abs(s - threshold) < 1e-12):  # rounding decides: take the exact measure
        hit[i, j] = cosine(x[i : i + 1], y[j : j + 1])[0] >= threshold
    return hit


def _all_edges(nodes: DataFrame, kind: str, threshold: float) -> DataFrame:
    """a, b: edges that join what links join, from all pairs of every label and length."""

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, block = stacked(pdf["v"].tolist(), kind), pdf["id"].to_numpy(), pdf["block"].to_numpy()
        i, j = np.nonzero(np.triu(_hits(x, x, threshold), 1))
        root = _labels(len(ids), i, j)
        some = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[root[some]], "b": ids[some]})

    sides = _block_pairs(nodes.select("id", "label", F.length("v").alias("d"), "v"), ["label", "d"])
    return sides.groupBy("label", "d", "lo", "hi").applyInPandas(join, "a long, b long")


def _exact_links(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    """id, links, of every member of a component: all members compared, block by block."""
    sides = _block_pairs(members, ["component"])

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        a = pdf[pdf["block"] == lo]
        b = pdf[pdf["block"] == hi] if hi != lo else a
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": []}).astype("int64")
        x, y = stacked(a["v"].tolist(), kind), stacked(b["v"].tolist(), kind)
        hit = _hits(x, y, threshold)
        if hi == lo:
            np.fill_diagonal(hit, False)
        out = [pd.DataFrame({"id": a["id"].to_numpy(), "links": hit @ b["m"].to_numpy()})]
        if hi != lo:
            out.append(pd.DataFrame({"id": b["id"].to_numpy(), "links": a["m"].to_numpy() @ hit}))
        return pd.concat(out).astype("int64")

    return sides.groupBy("component", "lo", "hi").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, found: DataFrame, kind: str, threshold: float) -> float:
    """Mean over audited nodes with links of the share of links whose two ends the found components join."""
    some = nodes.orderBy(F.xxhash64("id", F.lit(9))).limit(AUDIT).select("id", "label", "v").collect()
    if not some:
        return 1.0
    by: dict[tuple, list] = {}
    for r in some:
        by.setdefault((r["label"], len(r["v"])), []).append((r["id"], bytes(r["v"])))
    asks = {key: (np.array([i for i, _ in x]), unit(stacked([v for _, v in x], kind))) for key, x in by.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            size = np.array([len(x) for x in v])
            for (lab, z), (ask, u) in asks.items():
                at = np.flatnonzero((label == lab) & (size == z))
                if len(at):
                    i, j = np.nonzero(u @ unit(stacked([v[x] for x in at], kind)).T >= threshold)
                    ok = ask[i] != ids[at[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(ask[i][ok]), pa.array(ids[at[j]][ok])], ["a", "b"])

    true = nodes.select("id", "label", "v").mapInArrow(lean(brute), "a long, b long").distinct()
    joined = true.join(found.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    each = joined.groupBy("a").agg(F.avg(F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(0.0)).alias("share"))
    share = each.agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def dedup(table: DataFrame, threshold: float = 0.98, k: int = 12, reach: int = 6, audit: float = 0.995, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of the table.

    n_links counts the other rows of equal label with cosine >= threshold;
    component_id is the smallest vec_id reachable by links; kept marks it.
    """
    spark = table.sparkSession
    kind = element(table, vector)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("e"), F.monotonically_increasing_id().alias("__row"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("e")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2)
            blobs = [None] * b.num_rows
            sizes = np.diff(flat.offsets.to_numpy())
            for z in np.unique(sizes):
                at = np.flatnonzero(sizes == z)
                for i, r in zip(at, matrix(flat.take(pa.array(at)), kind), strict=True):
                    blobs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], ["vec_id", "label", "v"])

    each = written(good.select("vec_id", "label", "e").mapInArrow(lean(packed), "vec_id long, label long, v binary"))
    # equal vectors of a label are one node: its smallest vec_id, m rows
    nodes = written(each.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")))
    # two nodes may share a vec_id (repeated ids with other vectors): nodes are told apart by a number of their own
    nodes = written(nodes.withColumn("first", F.col("id")).withColumn("id", F.monotonically_increasing_id()))
    top = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    n_orders, means = _orders(top, reach, threshold), _means(nodes, kind)
    edges = written(_kept(_first_graph(nodes, kind, range(n_orders), reach, means), k, threshold))
    found, tries, used = None, 0, n_orders
    while True:
        for _ in range(6):
            more = _join_neighbours(edges, nodes, kind, k, threshold)
            grown = written(_kept(edges.unionByName(more), k, threshold))
            new = grown.join(edges.hint("merge"), ["a", "b"], "left_anti")
            fresh, new_links = new.agg(F.count(F.lit(1)), F.count(F.when(F.col("s") >= threshold, 1))).first()
            total, links = grown.agg(F.count(F.lit(1)), F.count(F.when(F.col("s") >= threshold, 1))).first()
            edges = grown
            if fresh <= total // 50 and new_links <= links // 50:
                break
        found = written(components(edges.filter(F.col("s") >= threshold)))
        if top < 2 or _audit(nodes, found, kind, threshold) >= audit:
            break
        if tries == 3:
            found = written(components(_all_edges(nodes, kind, threshold)))
            break
        tries += 1
        edges = written(_kept(edges.unionByName(_first_graph(nodes, kind, range(used, used + n_orders), reach, means)), k, threshold))
        used += n_orders
    members = written(nodes.join(found.hint("merge"), "id"))
    lowest = written(members.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size")))
    links = _exact_links(members.select("id", "component", "m", "v"), kind, threshold)
    linked = heavy_join(members, lowest, ["component"], "size").join(links.hint("merge"), "id", "left")
    linked = linked.select("label", "v", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    single = nodes.join(found.hint("merge"), "id", "left_anti").select("label", "v", "m", (F.col("m") - 1).alias("n_links"), F.col("first").alias("component_id"))
    out = heavy_join(each, written(linked.unionByName(single)), ["label", "v"], "m").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("vec_id").isNull() | F.col("label").isNull() | ~F.coalesce(valid(F.col("e")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
