"""Where snapshots come from: database catalogs, files' own schemas, and saved JSON."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typemap import from_spark
from ..model import CONSTRAINT_CODES, FK_ACTIONS, GENERATED_CODES, SCHEMAS, TABLE_KINDS, Catalog

#: The system tables that introspection reads, with the columns it needs (fixed values).
SYSTEM = {
    "pg_namespace": "oid long, nspname string", "pg_class": "oid long, relname string, relnamespace long, relkind string, relam long",
    "pg_attribute": "attrelid long, attname string, atttypid long, attnum int, attnotnull boolean, attisdropped boolean, attidentity string, attgenerated string, attcollation long, formatted string",
    "pg_type": "oid long, typname string, typnamespace long, typtype string, typelem long", "pg_attrdef": "adrelid long, adnum int, expr string", "pg_collation": "oid long, collname string, collnamespace long",
    "pg_constraint": "oid long, conname string, contype string, conrelid long, conindid long, conkey array<int>, confrelid long, confkey array<int>, confdeltype string, confupdtype string, condeferrable boolean, condeferred boolean, connoinherit boolean, expr string, nulls_not_distinct boolean, elements array<struct<expression:string,operator:string>>, index_method string, predicate string",
    "pg_index": "indexrelid long, indrelid long, indisunique boolean, indisprimary boolean, indkey array<int>, indoption array<int>, expressions array<string>, predicate string", "pg_am": "oid long, amname string",
    "pg_views": "relid long, definition string", "pg_sequence": "seqrelid long, typname string, seqstart long, seqincrement long, seqmin long, seqmax long, seqcache long, seqcycle boolean",
    "pg_enum": "enumtypid long, enumlabel string, enumsortorder double", "pg_description": "objoid long, objsubid int, description string",
}


class CatalogSource:
    """System tables as DataFrames; subclasses say how one is read."""

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError


class FakeCatalog(CatalogSource):
    """System tables from rows in code."""

    def __init__(self, spark: SparkSession, rows: dict[str, list]) -> None:
        self.spark, self.rows = spark, rows

    def table(self, name: str) -> DataFrame:
        return self.spark.createDataFrame(self.rows.get(name, []), SYSTEM[name])


class JdbcCatalog(CatalogSource):
    """System tables of a live database through JDBC; each is read once, in bulk."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, queries: dict[str, str] | None = None) -> None:
        self.spark, self.url, self.properties, self.queries = spark, url, properties or {}, queries or {}

    def table(self, name: str) -> DataFrame:
        source = f"({self.queries[name]}) q" if name in self.queries else name
        return self.spark.read.jdbc(self.url, source, properties=self.properties)


class NamespaceNotFound(LookupError):
    pass


def introspect(source: CatalogSource, schema: str, snapshot_id: str) -> tuple[Catalog, DataFrame]:
    """The catalog of one schema, and the constraints that couldn't be read (name, reason).

    Bulk joins over the system tables, whatever the number of tables.
    """
    t = source.table
    ns = t("pg_namespace").filter(F.col("nspname") == schema)
    if not ns.limit(1).count():
        raise NamespaceNotFound(schema)
    sid = F.lit(snapshot_id).alias("snapshot_id")
    here = t("pg_class").join(F.broadcast(ns.select(F.col("oid").alias("relnamespace"))), "relnamespace")
    code = lambda m, c: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[c]
    note = t("pg_description")
    whole = note.filter("objsubid = 0").select(F.col("objoid").alias("d_oid"), F.col("description").alias("comment"))
    with_note = lambda df, oid: df.join(whole, F.col(oid) == F.col("d_oid"), "left")
    rel = here.filter(F.col("relkind").isin("r", "p"))
    tables = with_note(rel, "oid").select(sid, F.col("relname").alias("table_name"), code(TABLE_KINDS, F.col("relkind")).alias("kind"), "comment")

    names = rel.select(F.col("oid").alias("relid"), F.col("relname").alias("table_name"))
    att = t("pg_attribute").filter("attnum > 0 AND NOT attisdropped").join(names, F.col("attrelid") == F.col("relid"))
    schemas = t("pg_namespace").select(F.col("oid").alias("ns_oid"), "nspname")
    typ = t("pg_type").join(schemas, F.col("typnamespace") == F.col("ns_oid"), "left").select(F.col("oid").alias("t_oid"), "typname", F.col("nspname").alias("typschema"), ((F.col("typtype") == "b") & (F.col("typelem") != 0)).alias("is_array"))
    dflt = t("pg_attrdef").withColumnRenamed("expr", "default_text")
    coll = t("pg_collation").select(F.col("oid").alias("c_oid"), "collname")
    col_note = note.select("objoid", "objsubid", F.col("description").alias("comment"))
    a = att.join(typ, F.col("atttypid") == F.col("t_oid")).join(dflt, (F.col("attrelid") == F.col("adrelid")) & (F.col("attnum") == F.col("adnum")), "left").join(coll,
            F.col("attcollation") == F.col("c_oid"), "left").join(col_note, (F.col("attrelid") == F.col("objoid")) & (F.col("attnum") == F.col("objsubid")), "left")
    made = F.coalesce("attgenerated", F.lit("")) != ""
    columns = a.select(
        sid, "table_name", F.col("attname").alias("name"), F.col("attnum").alias("position"),
                F.struct(F.col("typname").alias("name"), F.col("typschema").alias("schema"), "formatted", "is_array").alias("type"),
                (~F.col("attnotnull")).alias("is_nullable"),
        F.when(~made, F.col("default_text")).alias("default_expr"), F.when(made, F.struct(F.col("default_text").alias("expression"), code(GENERATED_CODES, F.col("attgenerated")).alias("storage"))).alias("generated"),
        F.when(F.col("attidentity") == "a", "ALWAYS").when(F.col("attidentity") == "d", "BY DEFAULT").alias("identity"), F.coalesce("collname", F.lit("default")).alias("collation"), "comment",
    )

    # key numbers to names, in key order
    numbered = t("pg_attribute").select(F.col("attrelid").alias("n_rel"), F.col("attnum").alias("n_num"), "attname")

    def key_names(df: DataFrame, rel_col: str, key: str, out: str) -> DataFrame:
        p = df.select("oid", rel_col, F.posexplode(key).alias("k", "num")).join(numbered, (F.col(rel_col) == F.col("n_rel")) & (F.col("num") == F.col("n_num")))
        return p.groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "attname"))), lambda x: x["attname"]).alias(out))

    con = t("pg_constraint").join(names, F.col("conrelid") == F.col("relid"))
    ref = t("pg_class").join(schemas, F.col("relnamespace") == F.col("ns_oid")).select(F.col("oid").alias("r_oid"), F.col("nspname").alias("ref_schema"), F.col("relname").alias("ref_table"))
    con = con.join(key_names(con, "conrelid", "conkey", "columns"), "oid", "left").join(key_names(con, "confrelid", "confkey", "ref_columns"), "oid", "left").join(ref, F.col("confrelid") == F.col("r_oid"), "left")
    con = with_note(con, "oid").withColumn("kind", code(CONSTRAINT_CODES, F.col("contype")))
    missing = F.when(F.col("kind").isNull(), F.concat(F.lit("unknown constraint type "), "contype")).when(F.col("contype").isin("p", "u",
            "f") & F.col("columns").isNull(), "missing columns").when((F.col("contype") == "f") & (F.col("ref_table").isNull() | F.col("ref_columns").isNull()),
            "missing reference").when((F.col("contype") == "c") & F.col("expr").isNull(),
            "missing expression").when((F.col("contype") == "x") & F.col("elements").isNull(), "missing elements")
    con = con.withColumn("reason", missing)
    fk = F.col("contype") == "f"
    constraints = con.filter("reason IS NULL").select(
        sid, "table_name", F.col("conname").alias("name"), "kind", F.when(F.col("contype").isin("p", "u", "f"), F.col("columns")).alias("columns"),
                F.when(fk, F.col("ref_schema")).alias("ref_schema"), F.when(fk, F.col("ref_table")).alias("ref_table"),
                F.when(fk, F.col("ref_columns")).alias("ref_columns"),
        F.when(fk, code(FK_ACTIONS, F.col("confdeltype"))).alias("on_delete"), F.when(fk, code(FK_ACTIONS, F.col("confupdtype"))).alias("on_update"),
                F.coalesce("condeferrable", F.lit(False)).alias("is_deferrable"), F.coalesce("condeferred", F.lit(False)).alias("is_initially_deferred"),
        F.when(F.col("contype") == "c", F.col("expr")).alias("expression"), F.coalesce("connoinherit", F.lit(False)).alias("is_no_inherit"),
                F.coalesce("nulls_not_distinct", F.lit(False)).alias("nulls_not_distinct"), "elements", "index_method", "predicate", "comment",
    )

    backing = t("pg_constraint").filter("conindid <> 0").select(F.col("conindid").alias("b_oid"), F.lit(True).alias("backed")).distinct()
    idx = t("pg_index").filter("NOT indisprimary").join(names,
            F.col("indrelid") == F.col("relid")).join(t("pg_class").select(F.col("oid").alias("i_oid"), F.col("relname").alias("name"), "relam"),
            F.col("indexrelid") == F.col("i_oid")).join(t("pg_am").select(F.col("oid").alias("am_oid"), "amname"), F.col("relam") == F.col("am_oid"),
            "left").join(backing, F.col("indexrelid") == F.col("b_oid"), "left")
    parts = idx.select("indexrelid", "indrelid", "indoption", "expressions", F.posexplode("indkey").alias("k", "num")).join(numbered, (F.col("indrelid") == F.col("n_rel")) & (F.col("num") == F.col("n_num")), "left")
    option = F.element_at("indoption", F.col("k") + 1)
    item = F.struct(F.col("attname").alias("column"), F.when(F.col("num") == 0, F.element_at("expressions", F.col("k") + 1)).alias("expression"),
            F.when(option.bitwiseAND(1) != 0, "desc").otherwise("asc").alias("sort"), F.when(option.bitwiseAND(2) != 0, "first").otherwise("last").alias("nulls"))
    listed = parts.groupBy("indexrelid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"]).alias("columns"))
    indexes = with_note(idx.join(listed, "indexrelid", "left"), "indexrelid").select(sid, "table_name", "name", F.coalesce("amname", F.lit("btree")).alias("method"),
            F.col("indisunique").alias("is_unique"), F.coalesce("backed", F.lit(False)).alias("is_constraint_index"), "columns", "predicate", "comment")

    views = with_note(here.filter(F.col("relkind").isin("v", "m")).join(t("pg_views"), F.col("oid") == F.col("relid")), "oid").select(sid, F.col("relname").alias("name"), "definition", (F.col("relkind") == "m").alias("is_materialized"), "comment")
    sequences = with_note(here.filter("relkind = 'S'").join(t("pg_sequence"), F.col("oid") == F.col("seqrelid")), "oid").select(sid, F.col("relname").alias("name"),
            F.col("typname").alias("data_type"), F.col("seqstart").alias("start_value"), F.col("seqincrement").alias("increment"), F.col("seqmin").alias("min_value"),
            F.col("seqmax").alias("max_value"), F.col("seqcache").alias("cache_size"), F.col("seqcycle").alias("is_cyclic"), "comment")
    kinds = t("pg_type").join(F.broadcast(ns.select(F.col("oid").alias("typnamespace"))), "typnamespace").filter("typtype = 'e'")
    labels = t("pg_enum").groupBy(F.col("enumtypid").alias("e_oid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("enumsortorder", "enumlabel"))), lambda x: x["enumlabel"]).alias("labels"))
    enums = with_note(kinds.join(labels, F.col("oid") == F.col("e_oid")), "oid").select(sid, F.col("typname").alias("name"), "labels", "comment")
    space = with_note(ns, "oid").select(sid, F.lit(schema).alias("schema"), "comment")
    return Catalog(space, tables, columns, constraints, indexes, views, sequences, enums), con.filter("reason IS NOT NULL").select("table_name", F.col("conname").alias("name"), "reason")


def from_dataframes(spark: SparkSession, frames: dict[str, DataFrame], snapshot_id: str, schema: str = "public") -> Catalog:
    """A snapshot of DataFrames' own schemas; nothing is read but the schemas."""
    rows = {"namespaces": [(snapshot_id, schema, None)], "tables": [(snapshot_id, n, "regular", None) for n in frames]}
    rows["columns"] = [(snapshot_id, n, f.name, k, from_spark(f.dataType), f.nullable, None, None, None, "default", None) for n, df in frames.items() for k, f in enumerate(df.schema.fields, 1)]
    return Catalog.of(spark, rows)


def from_parquet_dir(spark: SparkSession, path: str, names: Iterable[str], snapshot_id: str) -> Catalog:
    """A snapshot of the Parquet tables NAME.parquet in a folder."""
    return from_dataframes(spark, {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}, snapshot_id)


def write_json(catalog: Catalog, path: str) -> None:
    """One folder of JSON lines for each relation."""
    for f in fields(catalog):
        getattr(catalog, f.name).write.mode("overwrite").json(f"{path}/{f.name}")


def read_json(spark: SparkSession, path: str) -> Catalog:
    return Catalog(**{k: spark.read.schema(v).json(f"{path}/{k}") for k, v in SCHEMAS.items()})


def write_history(h: DataFrame, path: str) -> None:
    """Migrations as JSON, one folder per history."""
    h.write.mode("overwrite").partitionBy("history_id").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_sql(catalog: Catalog) -> DataFrame:
    """snapshot_id, sql: a script that makes each snapshot from nothing."""
    from ..operators.diff import diff_from_empty
    from ..plans.operations import plan, script

    return script(plan(diff_from_empty(catalog))).select(F.col("pair_id").alias("snapshot_id"), "sql")
