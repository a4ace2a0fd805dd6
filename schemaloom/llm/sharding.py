"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A ring of ``cells`` equal arcs; each shard owns the cells where its virtual
nodes stand, and a key enters the ring at its hash and walks clockwise to the
next virtual node.  Loads are bounded: no shard takes more rows than its
capacity, and keys that find a shard full continue clockwise.  With capacities
of n/shards rounded up or down (epsilon 0) counts differ by one at most; with
epsilon > 0 fewer rows move when a shard is added.

The walk needs only the number of rows per cell, so at most ``cells`` times
``SPREAD`` counts reach the driver (a fixed bound); rows get their place from
their rank within the cell.  Cells are ranked in ``SPREAD`` parts, so one key
with a third of all rows isn't sorted in one task.

A key is the doc_id; rows with a null doc_id enter the ring at the hash of their
size and checksum.  A null text has no bytes.  Rows repeated in full are placed
one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import written

CELLS = 1 << 14
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; two on one cell stand in the order of their full hash."""
    nodes = []
    for s in range(shards):
        for v in range(virtual_nodes):
            h = int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big")
            nodes.append((h, s))
    nodes.sort()
    return [(h * cells >> 64, s) for h, s in nodes]


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot): where the rows of each cell end up.

    First every shard takes from its own arcs, in ring order; then what is left
    over goes on clockwise past the full shards.
    """
    left = list(capacity)
    at = [c for c, _ in nodes]
    used = [0] * len(capacity)
    out = []

    def take(cell: int, a: int, n: int, shard: int) -> None:
        out.append((cell, a, a + n, shard, used[shard]))
        used[shard] += n
        left[shard] -= n

    over = []
    for cell in sorted(counts):
        k = bisect_left(at, cell) % len(nodes)
        n = min(counts[cell], left[nodes[k][1]])
        if n:
            take(cell, 0, n, nodes[k][1])
        if n < counts[cell]:
            over.append((cell, n, k))
    for cell, a, k in over:
        while a < counts[cell]:
            k = (k + 1) % len(nodes)
            n = min(counts[cell] - a, left[nodes[k][1]])
            if n:
                take(cell, a, n, nodes[k][1])
                a += n
    return out


def capacities(n: int, shards: int, epsilon: float) -> list[int]:
    """Rows that each shard takes at most: even shares, or (1 + epsilon) times the mean rounded up."""
    if epsilon > 0:
        return [-(-int(n * (1 + epsilon) * 1_000_000) // (shards * 1_000_000)) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


SPREAD = 16


def shard(docs: DataFrame, shards: int = 40, epsilon: float = 0.0, cells: int = CELLS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("cell", F.pmod(F.shiftrightunsigned(key, 20), F.lit(cells)).cast("int"))
    # written, so that numbers of rows are the same in both passes below; rows of one cell are ranked in SPREAD parts
    rows = written(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")))
    # at most cells * SPREAD counts: a fixed bound
    counts: dict[int, int] = {}
    starts = []
    for r in sorted(rows.groupBy("cell", "part").count().collect()):
        starts.append((r["cell"], r["part"], counts.get(r["cell"], 0)))
        counts[r["cell"]] = counts.get(r["cell"], 0) + r["count"]
    placed = walk(counts, ring(shards, virtual_nodes, cells), capacities(sum(counts.values()), shards, epsilon))
    quota: dict[int, list] = {}
    for cell, a, z, to, slot in placed:
        quota.setdefault(cell, []).append({"a": a, "z": z, "shard": to, "slot": slot})
    # broadcast: at most cells * SPREAD rows, and cells + shards stretches in them
    table = spark.createDataFrame([(c, p, n, quota[c]) for c, p, n in starts], "cell int, part int, before long, stretches array<struct<a:long,z:long,shard:int,slot:long>>")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    found = ranked.join(F.broadcast(table), ["cell", "part"]).withColumn("rank", F.col("k") + F.col("before"))
    own = F.filter("stretches", lambda x: (F.col("rank") >= x["a"]) & (F.col("rank") < x["z"]))[0]
    return found.select("doc_id", "size", "text_crc32", own["shard"].alias("shard"), (own["slot"] + F.col("rank") - own["a"]).alias("slot"))
