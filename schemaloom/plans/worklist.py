"""Running statements or files whose order isn't known: what fails for want of something goes back to the queue."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Catalog

#: Database error codes that say "later" and "already there".
RETRY = ("42P01", "42883", "42704", "42703", "3F000")
SKIP = ("42P06", "42P07", "42710")


def error_class(sqlstate: Column) -> Column:
    return F.when(sqlstate.isin(*RETRY), "retry").when(sqlstate.isin(*SKIP), "skip").otherwise("fail")


class CircularDependency(RuntimeError):
    pass


def execute(items: Iterable[str], run: Callable[[str], str | None], limit: int = 100) -> list[tuple[str, str]]:
    """(item, outcome) in the order of success; run returns None or an error code.

    A full round of the queue without any success means that what is left waits
    for itself; ``limit`` bounds the rounds.
    """
    queue, out, idle, steps = deque(items), [], 0, 0
    most = limit * max(1, len(queue))
    while queue:
        steps += 1
        if steps > most:
            raise RuntimeError(f"no end after {most} steps")
        item = queue.popleft()
        code = run(item)
        if code in RETRY:
            queue.append(item)
            idle += 1
            if idle > len(queue):
                raise CircularDependency(", ".join(queue))
            continue
        if code is not None and code not in SKIP:
            raise RuntimeError(f"{item}: {code}")
        out.append((item, "executed" if code is None else "skipped"))
        idle = 0
    return out


def needs(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """Statements that make a snapshot's objects one by one, and what each needs: nodes and edges by snapshot, for ``graph.rounds``.

    A table needs the enums of its columns and the tables that it refers to, an index its table, a view the tables that its
    definition names as words.
    """
    node = lambda kind, *names: F.concat_ws(":", F.lit(kind), *names)
    graph = F.col("snapshot_id").alias("graph")
    c = catalog
    nodes = c.tables.select(graph, node("table", "table_name").alias("node"))
    for kind, frame, names in (("enum", c.enums, ["name"]), ("view", c.views, ["name"]), ("index", c.indexes.filter("NOT is_constraint_index"), ["table_name", "name"])):
        nodes = nodes.unionByName(frame.select(graph, node(kind, *names).alias("node")))
    table = node("table", "table_name").alias("node")
    edges = c.columns.filter("type.schema <> 'pg_catalog'").select(graph, table, node("enum", F.col("type.name")).alias("needs"))
    edges = edges.unionByName(c.constraints.filter("kind = 'FOREIGN KEY'").select(graph, table, node("table", "ref_table").alias("needs")))
    edges = edges.unionByName(c.indexes.filter("NOT is_constraint_index").select(graph, node("index", "table_name", "name").alias("node"), node("table", "table_name").alias("needs")))
    words = c.views.select(graph, node("view", "name").alias("node"), F.explode(F.array_distinct(F.split("definition", "[^A-Za-z0-9_]+"))).alias("word"))
    named = words.join(c.tables.select(graph, F.col("table_name").alias("word")), ["graph", "word"])
    return nodes, edges.unionByName(named.select("graph", "node", node("table", "word").alias("needs")))
