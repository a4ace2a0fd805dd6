"""Connected components by alternating stars.

Every round links each vertex's larger neighbours to its smallest one (large
star), then its smaller ones (small star), until nothing changes: a number of
rounds that grows with the logarithm of the largest component.  Only pairs of
ids move; the smallest neighbour is found by partial aggregation, so a vertex
with very many neighbours is pre-aggregated, and it goes back to them by a
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import heavy_join, parallelism, written


ROWS_PER_TASK = 100_000


def _tasks(df: DataFrame, n: int) -> DataFrame:
    """As many tasks and files as about n rows need: tables of edges shrink from round to round."""
    return df.coalesce(max(1, min(parallelism(df.sparkSession), -(-n // ROWS_PER_TASK))))


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = written(_tasks(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("k")), 2 * n))
    linked = heavy_join(both.filter("b > a" if large else "b < a"), low, ["a"], "k", n)
    out = linked.select(F.col("b").alias("x"), "m")
    if not large:
        out = out.unionByName(low.select(F.col("a").alias("x"), "m"))
    return out.filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) of every vertex with an edge to another.

    Null ends and loops are ignored; edges may repeat and have either direction.
    """
    e = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")).filter("a <> b").distinct()
    e = written(e)
    while True:
        # done: every vertex has one edge, and it leads to a vertex that has none
        n, ends = e.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n == ends and e.join(e.select(F.col("b").alias("a")).distinct().hint("merge"), "a", "left_semi").isEmpty():
            break
        # the star of stars reads its input three times: written in between
        e = written(_tasks(_star(written(_tasks(_star(e, True, n), 2 * n)), False, n), 2 * n))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
