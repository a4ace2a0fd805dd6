"""Registered queries over system tables, DDL text and compiled migrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import oracle_plan, profile_sql, queries
from .operators.diff import diff_from_empty
from .plans import compile as compiling
from .plans import operations
from .registry import query
from .sources import ddl
from .sources.catalogs import export_sql, introspect
from .sources.system import SnapshotSystem

#: The snapshot of an events' day, which has every kind of object, and of the whole tables, which refer to one another.
_ALL = "snapshot_id IN (SELECT max(snapshot_id) FROM namespaces WHERE starts_with(snapshot_id, 'events/') UNION ALL SELECT 'tables')"


def _systems(spark, sf_dir):
    """Those two snapshots written as system tables, and read again by introspection."""
    c = queries.catalog(spark, sf_dir)
    for s in (c.namespaces.filter("startswith(snapshot_id, 'events/')").agg(F.max("snapshot_id")).head()[0], "tables"):
        yield introspect(SnapshotSystem(c.only(s)), "public", s)


def _both(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _sql(relation: str, columns: str, where: str = "true") -> Callable[[], str]:
    return lambda: profile_sql.ctes(*dict.fromkeys(("namespaces", relation))) + f" SELECT {columns} FROM {relation} WHERE {_ALL} AND {where}"


@query(_sql("namespaces", "*"))
def introspect_namespace(spark, sf_dir):
    return _both(c.namespaces for c, _ in _systems(spark, sf_dir))


@query(_sql("tables", "*"))
def introspect_pg_tables(spark, sf_dir):
    return _both(c.tables for c, _ in _systems(spark, sf_dir))


@query(_sql("columns", 'snapshot_id, table_name, name, position, type.name AS type_name, type.schema AS type_schema, type.formatted AS formatted, type.is_array AS is_array, is_nullable, default_expr, generated IS NULL AS is_plain, identity, "collation", comment'))
def introspect_pg_columns(spark, sf_dir):
    c = _both(c.columns for c, _ in _systems(spark, sf_dir))
    t = [F.col(f"type.{k}").alias(v) for k, v in (("name", "type_name"), ("schema", "type_schema"), ("formatted", "formatted"), ("is_array", "is_array"))]
    return c.select("snapshot_id", "table_name", "name", "position", *t, "is_nullable", "default_expr", F.col("generated").isNull().alias("is_plain"), "identity", "collation", "comment")


_CONSTRAINT = "snapshot_id, table_name, name, kind, columns, ref_schema, ref_table, ref_columns, on_delete, on_update, is_deferrable, is_initially_deferred, expression, is_no_inherit, nulls_not_distinct, elements[{first}].operator AS operator, index_method, predicate, comment"


@query(_sql("constraints", _CONSTRAINT.format(first=1)))
def introspect_pg_constraints(spark, sf_dir):
    return _both(c.constraints for c, _ in _systems(spark, sf_dir)).selectExpr(*_CONSTRAINT.format(first=0).split(", "))


#: Faults in a copy: what a key, a reference or a check can lack, by constraint; and what introspection says of it.
_FAULTS = {
    "PRIMARY KEY": ("columns", "missing columns"),
    "FOREIGN KEY": ("ref_table", "missing reference"),
    "CHECK": ("expression", "missing expression"),
    "EXCLUDE": ("elements", "missing elements"),
}


@query(_sql("constraints", "snapshot_id, table_name, name, CASE kind WHEN 'PRIMARY KEY' THEN 'missing columns' WHEN 'FOREIGN KEY' THEN 'missing reference' WHEN 'CHECK' THEN 'missing expression' ELSE 'missing elements' END AS reason", "kind <> 'UNIQUE' AND length(name) % 2 = 0"))
def introspect_unreadable(spark, sf_dir):
    """Constraints of even names have lost what they need."""
    c, out = queries.catalog(spark, sf_dir), []
    for s in (c.namespaces.filter("startswith(snapshot_id, 'events/')").agg(F.max("snapshot_id")).head()[0], "tables"):
        own = c.only(s)
        for kind, (column, _) in _FAULTS.items():
            lost = (F.col("kind") == kind) & (F.length("name") % 2 == 0)
            own.constraints = own.constraints.withColumn(column, F.when(~lost, F.col(column)))
        out.append(introspect(SnapshotSystem(own), "public", s)[1].select(F.lit(s).alias("snapshot_id"), "table_name", "name", "reason"))
    return _both(out)


@query(lambda: profile_sql.ctes("namespaces", "indexes") + f""" SELECT snapshot_id, table_name, name, method, is_unique, is_constraint_index, generate_subscripts(columns, 1)::INT AS place, unnest(columns)."column" AS column_name, predicate, comment FROM indexes WHERE {_ALL}""")
def introspect_pg_indexes(spark, sf_dir):
    i = _both(c.indexes for c, _ in _systems(spark, sf_dir)).select("snapshot_id", "table_name", "name", "method", "is_unique", "is_constraint_index", F.posexplode("columns").alias("k", "x"), "predicate", "comment")
    return i.select("snapshot_id", "table_name", "name", "method", "is_unique", "is_constraint_index", (F.col("k") + 1).alias("place"), F.col("x.column").alias("column_name"), "predicate", "comment")


@query(_sql("views", "*"))
def introspect_pg_views(spark, sf_dir):
    return _both(c.views for c, _ in _systems(spark, sf_dir))


@query(_sql("sequences", "*"))
def introspect_pg_sequences(spark, sf_dir):
    return _both(c.sequences for c, _ in _systems(spark, sf_dir))


@query(_sql("enums", "*"))
def introspect_pg_enums(spark, sf_dir):
    return _both(c.enums for c, _ in _systems(spark, sf_dir))


# ---- from nothing, to text and back -------------------------------------------------


@query(lambda: profile_sql.ctes("tables", "views", "enums", "sequences") + " SELECT snapshot_id AS pair_id, kind, count(*) AS added FROM (SELECT snapshot_id, 'table' AS kind FROM tables UNION ALL SELECT snapshot_id, 'view' FROM views UNION ALL SELECT snapshot_id, 'enum' FROM enums UNION ALL SELECT snapshot_id, 'sequence' FROM sequences) GROUP BY ALL")
def diff_from_nothing(spark, sf_dir):
    return diff_from_empty(queries.catalog(spark, sf_dir)).summary().select("pair_id", "kind", "added")


@query(lambda: oracle_plan.plan_sql("SELECT pair_id AS snapshot_id, sql FROM (" + oracle_plan.SCRIPT + ")", alone=True))
def export_scripts(spark, sf_dir):
    return export_sql(queries.catalog(spark, sf_dir))


@query(lambda: profile_sql.ctes("tables", "columns", "constraints", "indexes", "views", "enums", "sequences") + """ SELECT snapshot_id, 'table' AS kind, NULL::VARCHAR AS table_name, table_name AS name, 'regular' AS detail FROM tables
 UNION ALL SELECT snapshot_id, 'column', table_name, name, concat_ws('|', type.name, type.formatted, is_nullable, default_expr, identity, "collation") FROM columns UNION ALL SELECT snapshot_id, 'constraint', table_name, name, concat_ws('|', kind, array_to_string(columns, ','), ref_table, array_to_string(ref_columns, ','), on_delete, expression, index_method) FROM constraints
 UNION ALL SELECT snapshot_id, 'index', table_name, name, concat_ws('|', method, is_unique, is_constraint_index, columns[1]."column", columns[1].sort, columns[1].nulls, predicate) FROM indexes UNION ALL SELECT snapshot_id, 'view', NULL, name, definition FROM views
 UNION ALL SELECT snapshot_id, 'enum', NULL, name, array_to_string(labels, ',') FROM enums UNION ALL SELECT snapshot_id, 'sequence', NULL, name, concat_ws('|', data_type, start_value, increment, max_value, is_cyclic) FROM sequences""")
def load_ddl(spark, sf_dir):
    """Every snapshot written as a script and read back from its text (which doesn't tell that a table is partitioned)."""
    c, errors = ddl.load_sql(export_sql(queries.catalog(spark, sf_dir)))
    null, text = F.lit(None).cast("string"), lambda *x: F.concat_ws("|", *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in x])
    first = F.col("columns")[0]
    parts = [
        c.tables.select("snapshot_id", F.lit("table").alias("kind"), null.alias("table_name"), F.col("table_name").alias("name"), F.col("kind").alias("detail")),
        c.columns.select("snapshot_id", F.lit("column"), "table_name", "name", text("type.name", "type.formatted", "is_nullable", "default_expr", "identity", "collation")),
        c.constraints.select("snapshot_id", F.lit("constraint"), "table_name", "name", text("kind", F.array_join("columns", ","), "ref_table", F.array_join("ref_columns", ","), "on_delete", "expression", "index_method")),
        c.indexes.select("snapshot_id", F.lit("index"), "table_name", "name", text("method", "is_unique", "is_constraint_index", first["column"], first["sort"], first["nulls"], "predicate")),
        c.views.select("snapshot_id", F.lit("view"), null, "name", "definition"),
        c.enums.select("snapshot_id", F.lit("enum"), null, "name", F.array_join("labels", ",")),
        c.sequences.select("snapshot_id", F.lit("sequence"), null, "name", text("data_type", "start_value", "increment", "max_value", "is_cyclic")),
        errors.select("snapshot_id", F.lit("error"), null, null, "error"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# ---- compiled migrations --------------------------------------------------------------


@query(oracle_plan.compiled_sql)
def compile_migrations(spark, sf_dir):
    return compiling.compiled(queries.diff(spark, sf_dir)).select("pair_id", "n_operations", "n_statements", "is_reversible", "n_breaking", "error")


@query(lambda: oracle_plan.plan_sql(oracle_plan.STATEMENTS))
def compile_statements(spark, sf_dir):
    return compiling.statements(queries.plan(spark, sf_dir))


@query(lambda: oracle_plan.plan_sql(oracle_plan.EXECUTED))
def runner_execute(spark, sf_dir):
    return compiling.execute(queries.plan(spark, sf_dir), "a change")


@query(lambda: oracle_plan.plan_sql(oracle_plan.DESCRIBED))
def runner_describe(spark, sf_dir):
    return compiling.describe(queries.plan(spark, sf_dir), as_json=True)
