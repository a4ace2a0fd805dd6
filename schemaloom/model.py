"""Schema snapshots as DataFrames.

A snapshot is the set of rows with one ``snapshot_id`` in eight relations.  One
set of relations holds any number of snapshots, so every operator works on one
pair of schemas or on a whole fleet.  Array order is significant in index
columns, key columns and enum values.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

TYPE = "struct<name:string,schema:string,formatted:string,is_array:boolean>"

SCHEMAS: dict[str, str] = {
    "namespaces": "snapshot_id string, schema string, comment string",
    "tables": "snapshot_id string, table_name string, kind string, comment string",
    "columns": f"snapshot_id string, table_name string, name string, position int, type {TYPE}, is_nullable boolean, default_expr string, generated struct<expression:string,storage:string>, identity string, collation string, comment string",
    "constraints": "snapshot_id string, table_name string, name string, kind string, columns array<string>, ref_schema string, ref_table string, ref_columns array<string>, on_delete string, on_update string, is_deferrable boolean, is_initially_deferred boolean, expression string, is_no_inherit boolean, nulls_not_distinct boolean, elements array<struct<expression:string,operator:string>>, index_method string, predicate string, comment string",
    "indexes": "snapshot_id string, table_name string, name string, method string, is_unique boolean, is_constraint_index boolean, columns array<struct<column:string,expression:string,sort:string,nulls:string>>, predicate string, comment string",
    "views": "snapshot_id string, name string, definition string, is_materialized boolean, comment string",
    "sequences": "snapshot_id string, name string, data_type string, start_value long, increment long, min_value long, max_value long, cache_size long, is_cyclic boolean, comment string",
    "enums": "snapshot_id string, name string, labels array<string>, comment string",
}

#: Catalog codes and what they stand for.
FK_ACTIONS = {"a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT"}
CONSTRAINT_CODES = {"p": "PRIMARY KEY", "u": "UNIQUE", "f": "FOREIGN KEY", "c": "CHECK", "x": "EXCLUDE"}
TABLE_KINDS = {"r": "regular", "p": "partitioned"}
GENERATED_CODES = {"s": "STORED", "v": "VIRTUAL"}


@dataclass
class Catalog:
    """The eight relations; `empty` gives one without rows."""

    namespaces: DataFrame
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    indexes: DataFrame
    views: DataFrame
    sequences: DataFrame
    enums: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Catalog:
        return Catalog(**{k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()})

    @staticmethod
    def of(spark: SparkSession, rows: dict[str, list]) -> Catalog:
        return Catalog(**{k: spark.createDataFrame(rows.get(k, []), v) for k, v in SCHEMAS.items()})

    def union(self, other: Catalog) -> Catalog:
        return Catalog(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})

    def only(self, snapshot_id: str) -> Catalog:
        return Catalog(**{f.name: getattr(self, f.name).filter(getattr(self, f.name)["snapshot_id"] == snapshot_id) for f in fields(self)})

    def renamed(self, snapshot_id: str) -> Catalog:
        """The same rows under another snapshot_id."""
        from pyspark.sql import functions as F

        return Catalog(**{f.name: getattr(self, f.name).withColumn("snapshot_id", F.lit(snapshot_id)) for f in fields(self)})
