"""Digests of schemas as a tree: objects, tables, snapshots.

An object's digest is SHA-256 over its parts, each behind its length in bytes and nulls marked apart, lists behind their
length, so that no two objects look alike.  A table's is over its own parts and its members' digests (columns by position,
constraints and indexes by name); a snapshot's over those of its enums, sequences, tables and views by name.  Equal digests
mean equal subtrees, so drift is looked for only below nodes that differ: two snapshots that agree cost one comparison.

Comments, foreign key actions, deferrability, NO INHERIT, NULLS NOT DISTINCT, generated storage and exclusion predicates
don't count; the order of columns does, their numbers don't.

Everything is a projection or an aggregation by (snapshot, table); a table's members, and a snapshot's tables, meet as
digests of 64 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Catalog
from ..tables import kept


def part(c: str | Column) -> Column:
    """A value behind its length in bytes; a null is a mark that no length looks like."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("~"))


def parts(c: str | Column, each=part) -> Column:
    """A list behind its length."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("["), F.size(x).cast("string"), F.lit(":"), F.array_join(F.transform(x, each), "")), F.lit("~"))


def digest(*text: Column) -> Column:
    return F.sha2(F.concat(*text), 256)


def leaves(catalog: Catalog) -> DataFrame:
    """snapshot_id, kind, table_name, name, place, digest of every object but tables; place: where it stands among its like."""
    null = F.lit(None).cast("string").alias("table_name")

    def of(relation: str, kind: str, table: Column, place: Column, *text: Column) -> DataFrame:
        return getattr(catalog, relation).select("snapshot_id", F.lit(kind).alias("kind"), table, "name", place.alias("place"), digest(F.lit(f"{kind}:"), part("name"), *text).alias("digest"))

    table, by_name = F.col("table_name"), F.concat(F.lit("b"), F.col("name"))
    item = lambda x: F.concat(part(x["column"]), part(x["expression"]), part(x["sort"]), part(x["nulls"]))
    element = lambda x: F.concat(part(x["expression"]), part(x["operator"]))
    frames = [
        of("enums", "enum", null, F.lit(""), parts("labels")),
        of("sequences", "sequence", null, F.lit(""), *[part(c) for c in ("data_type", "start_value", "increment", "min_value", "max_value", "cache_size", "is_cyclic")]),
        of("views", "view", null, F.lit(""), part("definition"), part("is_materialized")),
        of("columns", "column", table, F.concat(F.lit("a"), F.lpad(F.col("position").cast("string"), 10, "0")), *[part(c) for c in ("type.formatted", "is_nullable", "default_expr", "identity", "generated.expression", "collation")]),
        of("constraints", "constraint", table, by_name, part("kind"), parts("columns"), part("ref_schema"), part("ref_table"), parts("ref_columns"), part("expression"), parts("elements", element)),
        of("indexes", "index", table, by_name, part("method"), part("is_unique"), part("is_constraint_index"), parts("columns", item), part("predicate")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tree(catalog: Catalog) -> DataFrame:
    """snapshot_id, level (0 snapshot, 1 what stands in it, 2 what stands in a table), kind, table_name, name, digest of every node."""
    low = kept(leaves(catalog))
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "digest"))), lambda x: x["digest"]), "")
    members = low.filter("table_name IS NOT NULL").groupBy("snapshot_id", "table_name").agg(joined("kind", "place").alias("below"), F.count(F.lit(1)).alias("n"))
    node = digest(F.lit("table:"), part("table_name"), part("kind"), part(F.coalesce("n", F.lit(0))), F.coalesce("below", F.lit("")))
    tables = catalog.tables.join(members, ["snapshot_id", "table_name"], "left").select("snapshot_id", F.lit("table").alias("kind"), F.lit(None).cast("string").alias("table_name"), F.col("table_name").alias("name"), node.alias("digest"))
    mid = low.filter("table_name IS NULL").drop("place").unionByName(tables)
    top = mid.groupBy("snapshot_id").agg(joined("kind", "name").alias("below"), F.count(F.lit(1)).alias("n"))
    ids = catalog.namespaces.select("snapshot_id").distinct().join(top, "snapshot_id", "left")
    null = F.lit(None).cast("string")
    roots = ids.select("snapshot_id", F.lit(0).alias("level"), F.lit("snapshot").alias("kind"), null.alias("table_name"), null.alias("name"), digest(F.lit("snapshot:"), part(F.coalesce("n", F.lit(0))), F.coalesce("below", F.lit(""))).alias("digest"))
    inner = mid.withColumn("level", F.lit(1)).unionByName(low.filter("table_name IS NOT NULL").drop("place").withColumn("level", F.lit(2)))
    return roots.unionByName(inner)


def checksum(catalog: Catalog) -> DataFrame:
    """snapshot_id, checksum: the root of each snapshot's tree."""
    return tree(catalog).filter("level = 0").select("snapshot_id", F.col("digest").alias("checksum"))


def drift(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, level, kind, table_name, name, change (added, removed, changed): the nodes that differ, found from the top.

    nodes: as ``tree`` gives them (a written table).  Objects are compared only in tables that differ, tables only in snapshots that do.
    """
    both = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(True).alias("old"), F.col("source_id").alias("snapshot_id")), F.struct(F.lit(False).alias("old"), F.col("target_id").alias("snapshot_id")))).alias("e")).select("pair_id", "e.old", "e.snapshot_id")
    key = ["pair_id", "kind", "table_name", "name"]

    def differing(level: int, among: DataFrame) -> DataFrame:
        rows = among.join(nodes.filter(F.col("level") == level), "snapshot_id" if level < 2 else ["snapshot_id", "table_name"])
        side = lambda old: F.max(F.when(F.col("old") == old, F.col("digest")))
        met = rows.groupBy(*key).agg(side(True).alias("a"), side(False).alias("b")).filter("NOT a <=> b")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
        return met.select("pair_id", F.lit(level).alias("level"), "kind", "table_name", "name", change.alias("change"))

    first = kept(differing(0, both))
    second = kept(differing(1, both.join(first.select("pair_id"), "pair_id", "left_semi")))
    inside = second.filter("kind = 'table'").select("pair_id", F.col("name").alias("table_name"))
    return first.unionByName(second).unionByName(differing(2, both.join(inside, "pair_id")))
