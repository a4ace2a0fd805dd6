"""Order and cycles of directed graphs as rounds of joins over any number of graphs at once.

nodes: graph, node.  edges: graph, node, needs (node refers to needs); edges to nodes that aren't there, and to itself, don't
count.  A round is one join and one aggregation over the edges that are still alive; what is settled leaves.  Each round's
frames are written tables, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept

_KEY = ["graph", "node"]


def _clean(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = kept(nodes.select(*_KEY).distinct())
    known = nodes.withColumnRenamed("node", "needs")
    edges = edges.select(*_KEY, "needs").filter("node <> needs").distinct().join(nodes, _KEY, "left_semi").join(known, ["graph", "needs"], "left_semi")
    return nodes, kept(edges.select(*_KEY, "needs"))


def rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, round: the round in which everything a node needs is there, from 1; null for nodes in cycles and what needs them.

    As many rounds of joins as the longest chain of needs.
    """
    left, edges = _clean(nodes, edges)
    done, n = None, 0
    while True:
        n += 1
        ready = kept(left.join(edges, _KEY, "left_anti").select(*_KEY, F.lit(n).alias("round")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = kept(left.join(ready, _KEY, "left_anti"))
        edges = kept(edges.join(ready.select("graph", F.col("node").alias("needs")), ["graph", "needs"], "left_anti").select(*_KEY, "needs"))
    rest = left.select(*_KEY, F.lit(None).cast("int").alias("round"))
    return rest if done is None else done.unionByName(rest)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, component, size: strongly connected components, named by their smallest node.

    By colours: every node takes the smallest node that reaches it; the nodes of a colour that also reach that node are its component.  They
    leave, and the rest begins anew.  Nodes without a way in or out are components of their own and leave first.
    """
    nodes, edges = _clean(nodes, edges)
    found = None

    def settle(some: DataFrame) -> None:
        nonlocal found, nodes, edges
        found = some if found is None else found.unionByName(some)
        nodes = kept(nodes.join(some, _KEY, "left_anti"))
        gone = some.select(*_KEY)
        edges = kept(edges.join(gone, _KEY, "left_anti").join(gone.withColumnRenamed("node", "needs"), ["graph", "needs"], "left_anti").select(*_KEY, "needs"))

    while not nodes.isEmpty():
        both = edges.select(*_KEY).distinct().join(edges.select("graph", F.col("needs").alias("node")).distinct(), _KEY)
        alone = kept(nodes.join(both, _KEY, "left_anti").select(*_KEY, F.col("node").alias("component")))
        if not alone.isEmpty():
            settle(alone)
            continue
        colour = nodes.withColumn("colour", F.col("node"))
        while True:  # the smallest node that reaches each
            sent = edges.join(colour, _KEY).groupBy("graph", F.col("needs").alias("node")).agg(F.min("colour").alias("other"))
            colour = kept(colour.drop("grew").join(sent, _KEY, "left").withColumn("grew", F.coalesce(F.col("other") < F.col("colour"), F.lit(False))).select(*_KEY, F.when(F.col("grew"), F.col("other")).otherwise(F.col("colour")).alias("colour"), "grew"))
            if colour.filter("grew").isEmpty():
                break
        colour = colour.drop("grew")
        inside = kept(edges.join(colour, _KEY).join(colour.select("graph", F.col("node").alias("needs"), F.col("colour").alias("c")), ["graph", "needs"]).filter("colour = c").select(*_KEY, "needs"))
        back = kept(colour.filter("node = colour"))
        new = back
        while not new.isEmpty():  # those of its colour that reach it
            new = kept(inside.join(new.select("graph", F.col("node").alias("needs"), "colour"), ["graph", "needs"]).select(*_KEY, "colour").distinct().join(back, _KEY, "left_anti"))
            back = back.unionByName(new)
        settle(kept(back.select(*_KEY, F.col("colour").alias("component"))))
    if found is None:
        return nodes.select(*_KEY, F.col("node").alias("component"), F.lit(1).cast("long").alias("size"))
    size = found.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, ["graph", "component"]).select(*_KEY, "component", "size")


def layered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, component, size, round: components, and the round of each where every component counts as one node (so every node has one)."""
    own = kept(components(nodes, edges))
    name = own.select(*_KEY, "component")
    between = edges.join(name, _KEY).join(name.select("graph", F.col("node").alias("needs"), F.col("component").alias("c")), ["graph", "needs"])
    order = rounds(own.select("graph", F.col("component").alias("node")), between.select("graph", F.col("component").alias("node"), F.col("c").alias("needs")))
    return own.join(order.withColumnRenamed("node", "component"), ["graph", "component"]).select(*_KEY, "component", "size", "round")
