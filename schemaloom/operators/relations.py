"""Relations between tables, keys and junction tables, from constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Catalog


def foreign_keys(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_name, name, columns, ref_table, ref_columns, is_one_to_one, is_self, is_known (the target is in the snapshot).

    A key is one to one if its columns are exactly those of a unique constraint or the primary key, in their order.
    """
    fk = catalog.constraints.filter("kind = 'FOREIGN KEY'").select("snapshot_id", "table_name", "name", "columns", "ref_table", "ref_columns")
    uq = catalog.constraints.filter("kind IN ('PRIMARY KEY', 'UNIQUE')").select("snapshot_id", "table_name", "columns", F.lit(True).alias("one")).distinct()
    known = catalog.tables.select("snapshot_id", F.col("table_name").alias("ref_table"), F.lit(True).alias("known"))
    out = fk.join(uq, ["snapshot_id", "table_name", "columns"], "left").join(known, ["snapshot_id", "ref_table"], "left")
    return out.select("snapshot_id", "table_name", "name", "columns", "ref_table", "ref_columns", F.coalesce("one", F.lit(False)).alias("is_one_to_one"),
            (F.col("table_name") == F.col("ref_table")).alias("is_self"), F.coalesce("known", F.lit(False)).alias("is_known"))


def relations(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_name, relation (belongs_to, has_one, has_many), other, constraint_name."""
    fk = foreign_keys(catalog)
    to = fk.select("snapshot_id", "table_name", F.lit("belongs_to").alias("relation"), F.col("ref_table").alias("other"), F.col("name").alias("constraint_name"))
    back = fk.filter("is_known AND NOT is_self").select("snapshot_id", F.col("ref_table").alias("table_name"),
            F.when(F.col("is_one_to_one"), "has_one").otherwise("has_many").alias("relation"), F.col("table_name").alias("other"), F.col("name").alias("constraint_name"))
    return to.unionByName(back)


def junction_tables(catalog: Catalog) -> DataFrame:
    """Tables with exactly two foreign keys whose columns make up the primary key, and one other column at most."""
    fk = catalog.constraints.filter("kind = 'FOREIGN KEY'").groupBy("snapshot_id", "table_name").agg(F.array_sort(F.flatten(F.collect_list("columns"))).alias("fk"), F.array_sort(F.collect_list("ref_table")).alias("links"))
    pk = catalog.constraints.filter("kind = 'PRIMARY KEY'").select("snapshot_id", "table_name", F.array_sort("columns").alias("pk"))
    n = catalog.columns.groupBy("snapshot_id", "table_name").agg(F.count(F.lit(1)).alias("n"))
    out = fk.join(pk, ["snapshot_id", "table_name"]).join(n, ["snapshot_id", "table_name"])
    return out.filter((F.size("links") == 2) & (F.col("fk") == F.col("pk")) & (F.col("n") - F.size("pk") <= 1)).select("snapshot_id", "table_name", "links")


def primary_keys(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_name, columns, is_composite, is_auto (one column that counts up by itself)."""
    pk = catalog.constraints.filter("kind = 'PRIMARY KEY'").select("snapshot_id", "table_name", F.col("columns").alias("keys"))
    auto = catalog.columns.select("snapshot_id", "table_name", F.col("name").alias("first"), (F.col("identity").isNotNull() | F.coalesce(F.contains(F.lower("default_expr"), F.lit("nextval(")), F.lit(False))).alias("counts"))
    out = pk.withColumn("first", F.col("keys")[0]).join(auto, ["snapshot_id", "table_name", "first"], "left")
    return out.select("snapshot_id", "table_name", F.col("keys").alias("columns"), (F.size("keys") > 1).alias("is_composite"), (F.size("keys").eqNullSafe(1) & F.coalesce("counts", F.lit(False))).alias("is_auto"))


def column_roles(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_name, name, is_unique, is_indexed: single-column constraints and plain indexes."""
    one = lambda df, name: df.filter(F.size("columns") == 1)
    uq = one(catalog.constraints.filter("kind = 'UNIQUE'"), "u").select("snapshot_id", "table_name", F.col("columns")[0].alias("name"), F.lit(True).alias("u")).distinct()
    ix = one(catalog.indexes.filter("NOT is_constraint_index"), "i").select("snapshot_id", "table_name", F.col("columns")[0]["column"].alias("name"), F.lit(True).alias("i")).filter("name IS NOT NULL").distinct()
    key = ["snapshot_id", "table_name", "name"]
    return catalog.columns.select(*key).join(uq, key, "left").join(ix, key, "left").select(*key, F.coalesce("u", F.lit(False)).alias("is_unique"), F.coalesce("i", F.lit(False)).alias("is_indexed"))


def composite(catalog: Catalog) -> DataFrame:
    """Unique constraints and plain indexes over several columns, checks and exclusions: what a model's table arguments hold."""
    a = catalog.constraints.filter("(kind = 'UNIQUE' AND size(columns) > 1) OR kind IN ('CHECK', 'EXCLUDE')").select("snapshot_id", "table_name", "name", "kind", "columns", "expression")
    b = catalog.indexes.filter("NOT is_constraint_index AND size(columns) > 1").select("snapshot_id", "table_name", "name", F.lit("INDEX").alias("kind"),
            F.transform("columns", lambda c: c["column"]).alias("columns"), F.lit(None).cast("string").alias("expression"))
    return a.unionByName(b)
