"""Code for schemas: Python model classes and Rust structs, as frames of lines and files."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming, typemap
from ..functions.sqltext import text
from ..model import Catalog
from ..operators import relations as rel

_KEY = ["snapshot_id", "table_name"]
HEAD = (
    "from datetime import date, datetime, time, timedelta\n"
    "from decimal import Decimal\n"
    "from typing import Any\n"
    "from uuid import UUID\n\n"
    "from sqlalchemy import ARRAY, JSON, BigInteger, Boolean, CheckConstraint, Date, DateTime, Float, Index, Integer, Numeric, SmallInteger, String, Text, Time, UniqueConstraint\n"
    "from sqlmodel import Field, SQLModel\n\n\n"
)


def python_fields(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_name, column_name, attribute, annotation, declaration (what stands behind =, or null), line, ordinal."""
    pk = rel.primary_keys(catalog).select(*_KEY, F.explode("columns").alias("name"), F.lit(True).alias("is_pk"))
    schema = catalog.namespaces.select("snapshot_id", "schema")
    fk = catalog.constraints.filter("kind = 'FOREIGN KEY' AND size(columns) = 1").join(schema, "snapshot_id").groupBy(*_KEY,
            F.col("columns")[0].alias("name")).agg(F.min(text(F.coalesce("ref_schema", "schema"), ".", F.col("ref_table"), ".", F.col("ref_columns")[0])).alias("fk"))
    c = catalog.columns.join(pk, [*_KEY, "name"], "left").join(fk, [*_KEY, "name"], "left").join(rel.column_roles(catalog), [*_KEY, "name"], "left")
    is_pk = F.coalesce("is_pk", F.lit(False))
    auto = is_pk & (F.col("identity").isNotNull() | F.col("type.name").isin("serial", "serial2", "serial4", "serial8", "smallserial", "bigserial"))
    kind, attr = typemap.python_type(F.col("type")), naming.attribute(F.col("name"))
    optional = auto | F.col("is_nullable")
    size = typemap.string_length(F.col("type.formatted")).cast("string")
    when = lambda cond, value: F.when(cond, F.lit(value) if isinstance(value, str) else value)
    args = F.array_compact(F.array(
        when(auto, "default=None"), when(is_pk, "primary_key=True"), when(F.col("fk").isNotNull(), text('foreign_key="', F.col("fk"), '"')),
        when(F.col("is_unique") & ~is_pk, "unique=True"), when(F.col("is_indexed") & ~is_pk & ~F.col("is_unique"), "index=True"),
        when(F.col("type.name").isin("char", "character", "bpchar"), text("min_length=", size)), text("max_length=", size),
        text("sa_type=", typemap.sqlalchemy_type(F.col("type"))), when(attr != F.lower("name"), text('alias="', F.col("name"), '"')),
    ))
    declared = F.when(F.size(args) > 0, text("Field(", F.array_join(args, ", "), ")")).when(F.col("is_nullable") & F.col("default_expr").isNull(), "None")
    annotation = F.when(optional, text(kind, " | None")).otherwise(kind)
    line = F.concat(text("    ", attr, ": ", annotation), F.coalesce(text(" = ", declared), F.lit("")))
    rank = F.when(is_pk, 0).when(~optional, 1).otherwise(2)
    return c.select(*_KEY, F.col("name").alias("column_name"), attr.alias("attribute"), annotation.alias("annotation"), declared.alias("declaration"), line.alias("line"), (rank * 100000 + F.col("position")).alias("ordinal"))


def python_models(catalog: Catalog) -> DataFrame:
    """snapshot_id, table_name, class_name, module, code: one model class for each table."""
    lines = python_fields(catalog).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("f"))
    quoted = F.array_join(F.transform("columns", lambda c: text('"', c, '"')), ", ")
    arg = (
        F.when(F.col("kind") == "UNIQUE", text("UniqueConstraint(", quoted, ', name="', F.col("name"), '")'))
        .when(F.col("kind") == "CHECK", text('CheckConstraint("', F.replace(F.replace(F.col("expression"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), '", name="', F.col("name"), '")'))
        .when(F.col("kind") == "INDEX", text('Index("', F.col("name"), '", ', quoted, ")"))
    )
    warn = F.when(F.col("kind") == "EXCLUDE", text("# WARNING: exclusion constraint '", F.col("name"), "' has no equivalent"))
    extra = rel.composite(catalog).groupBy(*_KEY).agg(F.array_sort(F.collect_list(arg)).alias("args"), F.array_sort(F.collect_list(warn)).alias("warnings"))
    t = catalog.tables.join(lines, _KEY, "left").join(extra, _KEY, "left")
    none = F.array().cast("array<string>")
    args, warnings = F.coalesce("args", none), F.coalesce("warnings", none)
    body = F.coalesce(F.array_join(F.transform("f", lambda x: x["line"]), "\n"), F.lit("    pass"))
    table_args = F.when(F.size(args) > 0, text("    __table_args__ = (\n", F.array_join(F.transform(args, lambda a: text("        ", a, ",\n")), ""), "    )\n")).otherwise("")
    name = naming.class_name(F.col("table_name"))
    code = F.concat(F.array_join(F.transform(warnings, lambda w: text(w, "\n")), ""), text("class ", name, "(SQLModel, table=True):\n"),
            F.coalesce(text('    """', F.col("comment"), '"""\n\n'), F.lit("")), text('    __tablename__ = "', F.col("table_name"), '"\n'), table_args, F.lit("\n"), body)
    return t.select(*_KEY, name.alias("class_name"), naming.module_name(F.col("table_name")).alias("module"), code.alias("code"))


def python_files(catalog: Catalog, one_file: bool = True) -> DataFrame:
    """snapshot_id, file, content: models.py, or one module per table and __init__.py."""
    m = python_models(catalog)
    if one_file:
        all_code = m.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_name", "code"))), lambda x: x["code"]), "\n\n\n").alias("c"))
        return all_code.select("snapshot_id", F.lit("models.py").alias("file"), F.concat(F.lit(HEAD), "c", F.lit("\n")).alias("content"))
    each = m.select("snapshot_id", text(F.col("module"), ".py").alias("file"), F.concat(F.lit(HEAD), "code", F.lit("\n")).alias("content"))
    names = m.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_list(text("from .", F.col("module"), " import ", F.col("class_name")))), "\n").alias("c"))
    return each.unionByName(names.select("snapshot_id", F.lit("__init__.py").alias("file"), text(F.col("c"), "\n").alias("content")))


def rust_entities(catalog: Catalog) -> DataFrame:
    """snapshot_id, file, content: one compact struct per table, and a mod.rs that lists them."""
    pk = rel.primary_keys(catalog).select(*_KEY, F.explode("columns").alias("name"), F.lit(True).alias("is_pk"), "is_auto")
    kind = typemap.rust_type(F.col("type"))
    line = F.concat(F.when(F.col("is_pk"), F.when(F.col("is_auto"),
            "    #[sea_orm(primary_key)]\n").otherwise("    #[sea_orm(primary_key, auto_increment = false)]\n")).otherwise(""),
            text("    pub ", naming.snake(F.col("name")), ": ", F.when(F.col("is_nullable"), text("Option<", kind, ">")).otherwise(kind), ","))
    f = catalog.columns.join(pk, [*_KEY, "name"], "left").groupBy(*_KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))), lambda x: x["l"]), "\n").alias("f"))
    each = catalog.tables.join(f, _KEY, "left")
    code = text('use sea_orm::entity::prelude::*;\n\n#[derive(Clone, Debug, PartialEq, DeriveEntityModel)]\n#[sea_orm(table_name = "', F.col("table_name"),
            '")]\npub struct Model {\n', F.coalesce("f", F.lit("")), "\n}\n\n#[derive(Copy, Clone, Debug, EnumIter, DeriveRelation)]\npub enum Relation {}\n\nimpl ActiveModelBehavior for ActiveModel {}\n")
    out = each.select("snapshot_id", text(naming.snake(F.col("table_name")), ".rs").alias("file"), code.alias("content"))
    mods = catalog.tables.groupBy("snapshot_id").agg(F.sort_array(F.collect_list("table_name")).alias("t"))
    mods = mods.select("snapshot_id", F.array_join(F.transform("t", lambda t: text("pub mod ", naming.snake(t), ";")), "\n").alias("c"))
    return out.unionByName(mods.select("snapshot_id", F.lit("mod.rs").alias("file"), text(F.col("c"), "\n").alias("content")))


class Generator(Protocol):
    """What turns snapshots into files: snapshot_id, file, content."""

    def generate(self, catalog: Catalog) -> DataFrame: ...


class PythonGenerator:
    def __init__(self, one_file: bool = True) -> None:
        self.one_file = one_file

    def generate(self, catalog: Catalog) -> DataFrame:
        return python_files(catalog, self.one_file)


class RustGenerator:
    def generate(self, catalog: Catalog) -> DataFrame:
        return rust_entities(catalog)


#: Generators by the name of their language.
GENERATORS: dict[str, Generator] = {"python": PythonGenerator(), "rust": RustGenerator()}
