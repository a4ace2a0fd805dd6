"""The other way round: system tables of a database, made from a snapshot, so that introspection can read what was written.

Objects are numbered by a hash of their kind and name.  What a live database holds besides is there too: an index behind
every primary key, system and dropped columns, another schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONSTRAINT_CODES, FK_ACTIONS, TABLE_KINDS, Catalog
from .catalogs import SYSTEM, CatalogSource

_SCHEMAS = {"pg_catalog": 11, "public": 2200, "elsewhere": 2300}


def _oid(kind: str, *names: str | Column) -> Column:
    return F.abs(F.xxhash64(F.lit(kind), *[F.col(n) if isinstance(n, str) else n for n in names]) % F.lit(1 << 62))


def _code(codes: dict[str, str], c: str | Column) -> Column:
    """The code of what a code stands for."""
    pairs = [F.lit(x) for k, v in codes.items() for x in (v, k)]
    return F.create_map(*pairs)[F.col(c) if isinstance(c, str) else c]


class SnapshotSystem(CatalogSource):
    """System tables of one snapshot."""

    def __init__(self, catalog: Catalog) -> None:
        self.c, self.spark = catalog, catalog.tables.sparkSession

    def table(self, name: str) -> DataFrame:
        want = self.spark.createDataFrame([], SYSTEM[name]).schema
        rows = getattr(self, name)()
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in want])

    def pg_namespace(self) -> DataFrame:
        return self.spark.createDataFrame([(v, k) for k, v in _SCHEMAS.items()], "oid long, nspname string")

    def _backing(self) -> DataFrame:
        """Indexes, those behind primary keys among them."""
        own = self.c.indexes.select("table_name", "name", "method", "is_unique", F.lit(False).alias("is_primary"), "columns", "predicate")
        at = F.transform("columns", lambda x: F.struct(x.alias("column"), F.lit(None).cast("string").alias("expression"), F.lit("asc").alias("sort"), F.lit("last").alias("nulls")))
        keys = self.c.constraints.filter("kind = 'PRIMARY KEY'").select("table_name", "name", F.lit("btree").alias("method"), F.lit(True).alias("is_unique"), F.lit(True).alias("is_primary"), at.alias("columns"), F.lit(None).cast("string").alias("predicate"))
        return own.unionByName(keys)

    def pg_class(self) -> DataFrame:
        ns = F.lit(_SCHEMAS["public"]).alias("relnamespace")
        tables = self.c.tables.select(_oid("table", "table_name").alias("oid"), F.col("table_name").alias("relname"), ns, _code(TABLE_KINDS, "kind").alias("relkind"), F.lit(0).alias("relam"))
        indexes = self._backing().select(_oid("index", "table_name", "name"), "name", ns, F.lit("i"), _oid("am", "method"))
        views = self.c.views.select(_oid("view", "name"), "name", ns, F.when(F.col("is_materialized"), "m").otherwise("v"), F.lit(0))
        sequences = self.c.sequences.select(_oid("sequence", "name"), "name", ns, F.lit("S"), F.lit(0))
        far = tables.select(_oid("far", "relname"), "relname", F.lit(_SCHEMAS["elsewhere"]), F.lit("r"), F.lit(0))
        return tables.union(indexes).union(views).union(sequences).union(far)

    def pg_attribute(self) -> DataFrame:
        type_ = _oid("type", F.col("type.schema"), F.col("type.name"))
        identity = F.when(F.col("identity") == "ALWAYS", "a").when(F.col("identity") == "BY DEFAULT", "d").otherwise("")
        made = F.when(F.col("generated").isNull(), "").otherwise("s")
        own = self.c.columns.select(
            _oid("table", "table_name").alias("attrelid"), F.col("name").alias("attname"), type_.alias("atttypid"), F.col("position").alias("attnum"), (~F.col("is_nullable")).alias("attnotnull"), F.lit(False).alias("attisdropped"),
            identity.alias("attidentity"), made.alias("attgenerated"), _oid("collation", "collation").alias("attcollation"), F.col("type.formatted").alias("formatted"),
        )
        first = own.filter("attnum = 1")
        system = first.withColumns({"attname": F.lit("ctid"), "attnum": F.lit(-1)})
        dropped = first.withColumns({"attname": F.lit("gone"), "attnum": F.lit(1000), "attisdropped": F.lit(True)})
        return own.unionByName(system).unionByName(dropped)

    def pg_type(self) -> DataFrame:
        t = self.c.columns.select("type.*").select("name", "schema", "is_array").union(self.c.enums.select("name", F.lit("public"), F.lit(False))).distinct()
        t = t.join(self.c.enums.select("name", F.lit("public").alias("schema"), F.lit(True).alias("is_enum")), ["name", "schema"], "left")
        space = F.when(F.col("schema") == "public", _SCHEMAS["public"]).otherwise(_SCHEMAS["pg_catalog"])
        element = F.when(F.col("is_array"), _oid("type", "schema", F.substr("name", F.lit(2)))).otherwise(0)
        return t.select(_oid("type", "schema", "name").alias("oid"), F.col("name").alias("typname"), space.alias("typnamespace"), F.when(F.col("is_enum"), "e").otherwise("b").alias("typtype"), element.alias("typelem"))

    def pg_attrdef(self) -> DataFrame:
        expr = F.coalesce("generated.expression", "default_expr")
        return self.c.columns.filter(expr.isNotNull()).select(_oid("table", "table_name").alias("adrelid"), F.col("position").alias("adnum"), expr.alias("expr"))

    def pg_collation(self) -> DataFrame:
        return self.c.columns.select("collation").distinct().select(_oid("collation", "collation").alias("oid"), F.col("collation").alias("collname"), F.lit(_SCHEMAS["pg_catalog"]).alias("collnamespace"))

    def _numbers(self, rows: DataFrame, keys: list[str], table: str, names: str, out: str) -> DataFrame:
        """Column names of a table as their numbers, in their order; 0 where there is no name."""
        at = self.c.columns.select(F.col("table_name").alias(table), F.col("name").alias("_name"), F.col("position").alias("_num"))
        each = rows.select(*keys, table, F.posexplode(names).alias("_k", "_name")).join(at, [table, "_name"], "left")
        packed = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_num", F.lit(0)).alias("n")))), lambda x: x["n"]).alias(out))
        return rows.join(packed, keys, "left")

    def pg_constraint(self) -> DataFrame:
        key = ["table_name", "name"]
        c = self._numbers(self.c.constraints, key, "table_name", "columns", "conkey")
        c = self._numbers(c, key, "ref_table", "ref_columns", "confkey")
        action = lambda a: _code(FK_ACTIONS, a)
        return c.select(
            _oid("constraint", *key).alias("oid"), F.col("name").alias("conname"), _code(CONSTRAINT_CODES, "kind").alias("contype"), _oid("table", "table_name").alias("conrelid"),
            F.when(F.col("kind").isin("PRIMARY KEY", "UNIQUE"), _oid("index", *key)).otherwise(0).alias("conindid"), "conkey", F.when(F.col("ref_table").isNull(), 0).otherwise(_oid("table", "ref_table")).alias("confrelid"), "confkey",
            action("on_delete").alias("confdeltype"), action("on_update").alias("confupdtype"), F.col("is_deferrable").alias("condeferrable"), F.col("is_initially_deferred").alias("condeferred"), F.col("is_no_inherit").alias("connoinherit"),
            F.col("expression").alias("expr"), "nulls_not_distinct", "elements", "index_method", "predicate",
        )

    def pg_index(self) -> DataFrame:
        i = self._backing().withColumn("names", F.transform("columns", lambda x: x["column"]))
        i = self._numbers(i, ["table_name", "name"], "table_name", "names", "indkey")
        option = F.transform("columns", lambda x: (x["sort"] == "desc").cast("int") + 2 * (x["nulls"] == "first").cast("int"))
        expressions = F.transform("columns", lambda x: x["expression"])
        return i.select(_oid("index", "table_name", "name").alias("indexrelid"), _oid("table", "table_name").alias("indrelid"), F.col("is_unique").alias("indisunique"), F.col("is_primary").alias("indisprimary"), "indkey", option.alias("indoption"), expressions.alias("expressions"), "predicate")

    def pg_am(self) -> DataFrame:
        return self._backing().select("method").distinct().select(_oid("am", "method").alias("oid"), F.col("method").alias("amname"))

    def pg_views(self) -> DataFrame:
        return self.c.views.select(_oid("view", "name").alias("relid"), "definition")

    def pg_sequence(self) -> DataFrame:
        s = self.c.sequences
        return s.select(
            _oid("sequence", "name").alias("seqrelid"), F.col("data_type").alias("typname"), F.col("start_value").alias("seqstart"), F.col("increment").alias("seqincrement"), F.col("min_value").alias("seqmin"), F.col("max_value").alias("seqmax"),
            F.col("cache_size").alias("seqcache"), F.col("is_cyclic").alias("seqcycle"),
        )

    def pg_enum(self) -> DataFrame:
        return self.c.enums.select(_oid("type", F.lit("public"), "name").alias("enumtypid"), F.posexplode("labels").alias("enumsortorder", "enumlabel")).select("enumtypid", "enumlabel", "enumsortorder")

    def pg_description(self) -> DataFrame:
        told = lambda df, oid, sub=F.lit(0): df.filter("comment IS NOT NULL").select(oid.alias("objoid"), sub.alias("objsubid"), F.col("comment").alias("description"))
        c = self.c
        parts = [
            told(c.namespaces, F.lit(_SCHEMAS["public"])), told(c.tables, _oid("table", "table_name")), told(c.columns, _oid("table", "table_name"), F.col("position")), told(c.constraints, _oid("constraint", "table_name", "name")),
            told(c.indexes, _oid("index", "table_name", "name")), told(c.views, _oid("view", "name")), told(c.sequences, _oid("sequence", "name")), told(c.enums, _oid("type", F.lit("public"), "name")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
