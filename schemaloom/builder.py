"""Schemas in code: a fluent builder that yields rows for `model.Catalog.of`."""

from __future__ import annotations

from collections import defaultdict

#: Short type names and what the database prints for them.
TYPE_NAMES = {
    "smallint": ("int2", "smallint"), "int2": ("int2", "smallint"), "smallserial": ("int2", "smallint"),
    "integer": ("int4", "integer"), "int": ("int4", "integer"), "int4": ("int4", "integer"), "serial": ("int4", "integer"),
    "bigint": ("int8", "bigint"), "int8": ("int8", "bigint"), "bigserial": ("int8", "bigint"),
    "real": ("float4", "real"), "float4": ("float4", "real"), "double precision": ("float8", "double precision"), "float8": ("float8", "double precision"),
    "numeric": ("numeric", "numeric"), "decimal": ("numeric", "numeric"), "text": ("text", "text"),
    "varchar": ("varchar", "character varying"), "character varying": ("varchar", "character varying"), "char": ("bpchar", "character"), "bpchar": ("bpchar", "character"),
    "boolean": ("bool", "boolean"), "bool": ("bool", "boolean"), "date": ("date", "date"), "interval": ("interval", "interval"),
    "time": ("time", "time without time zone"), "timetz": ("timetz", "time with time zone"),
    "timestamp": ("timestamp", "timestamp without time zone"), "timestamptz": ("timestamptz", "timestamp with time zone"),
    "uuid": ("uuid", "uuid"), "json": ("json", "json"), "jsonb": ("jsonb", "jsonb"), "bytea": ("bytea", "bytea"), "inet": ("inet", "inet"), "cidr": ("cidr", "cidr"),
            "macaddr": ("macaddr", "macaddr"), "money": ("money", "money"), "xml": ("xml", "xml"),
}


def type_info(text: str) -> dict:
    """The type struct of a type as one writes it: alias, length or precision, [] for arrays."""
    if text.endswith("[]"):
        inner = type_info(text[:-2])
        return inner | {"name": "_" + inner["name"], "formatted": inner["formatted"] + "[]", "is_array": True}
    base, _, args = text.partition("(")
    name, formatted = TYPE_NAMES.get(base.strip().lower(), (base.strip(), base.strip()))
    return {"name": name, "schema": "pg_catalog", "formatted": formatted + (f"({args}" if args else ""), "is_array": False}


class SchemaBuilder:
    """``SchemaBuilder("s1").table("users").column("id", "integer", pk=True)...``; `rows` holds all relations' rows."""

    def __init__(self, snapshot_id: str, schema: str = "public", comment: str | None = None) -> None:
        self.id, self.schema = snapshot_id, schema
        self.rows: dict[str, list] = defaultdict(list)
        self.rows["namespaces"].append((snapshot_id, schema, comment))

    def table(self, name: str, kind: str = "regular", comment: str | None = None) -> TableBuilder:
        self.rows["tables"].append((self.id, name, kind, comment))
        return TableBuilder(self, name)

    def view(self, name: str, definition: str, materialized: bool = False, comment: str | None = None) -> SchemaBuilder:
        self.rows["views"].append((self.id, name, definition, materialized, comment))
        return self

    def enum(self, name: str, *labels: str, comment: str | None = None) -> SchemaBuilder:
        self.rows["enums"].append((self.id, name, list(labels), comment))
        return self

    def sequence(self, name: str, data_type: str = "bigint", start: int = 1, increment: int = 1, minimum: int = 1, maximum: int = 9223372036854775807, cache: int = 1, cyclic: bool = False, comment: str | None = None) -> SchemaBuilder:
        self.rows["sequences"].append((self.id, name, data_type, start, increment, minimum, maximum, cache, cyclic, comment))
        return self


class TableBuilder:
    def __init__(self, owner: SchemaBuilder, name: str) -> None:
        self.owner, self.name, self.n = owner, name, 0

    def __getattr__(self, name: str):
        return getattr(self.owner, name)  # the next table, view, enum or sequence

    def column(self, name: str, type_: str, null: bool = True, default: str | None = None, identity: str | None = None, generated: str | None = None,
            collation: str = "default", comment: str | None = None, position: int | None = None) -> TableBuilder:
        self.n = position or self.n + 1
        gen = {"expression": generated, "storage": "STORED"} if generated else None
        self.owner.rows["columns"].append((self.owner.id, self.name, name, self.n, type_info(type_), null, None if gen else default, gen, identity, collation, comment))
        return self

    def _constraint(self, name: str, kind: str, **k) -> TableBuilder:
        get = k.get
        self.owner.rows["constraints"].append((self.owner.id, self.name, name, kind, get("columns"), get("ref_schema"), get("ref_table"), get("ref_columns"),
                get("on_delete"), get("on_update"), get("deferrable", False), get("deferred", False), get("expression"), get("no_inherit", False),
                get("nulls_not_distinct", False), get("elements"), get("method"), get("predicate"), get("comment")))
        return self

    def _backing(self, name: str, columns: list[str]) -> None:
        self.owner.rows["indexes"].append((self.owner.id, self.name, name, "btree", True, True, [(c, None, "asc", "last") for c in columns], None, None))

    def primary_key(self, *columns: str, name: str | None = None) -> TableBuilder:
        # the index behind a primary key isn't part of a snapshot, built or introspected
        return self._constraint(name or f"{self.name}_pkey", "PRIMARY KEY", columns=list(columns))

    def unique(self, *columns: str, name: str | None = None, nulls_not_distinct: bool = False) -> TableBuilder:
        name = name or f"{self.name}_{'_'.join(columns)}_key"
        self._backing(name, list(columns))
        return self._constraint(name, "UNIQUE", columns=list(columns), nulls_not_distinct=nulls_not_distinct)

    def foreign_key(self, columns: list[str] | str, table: str, ref: list[str] | str, name: str | None = None, on_delete: str = "NO ACTION", on_update: str = "NO ACTION", **k) -> TableBuilder:
        columns, ref = ([columns] if isinstance(columns, str) else columns), ([ref] if isinstance(ref, str) else ref)
        return self._constraint(name or f"{self.name}_{'_'.join(columns)}_fkey", "FOREIGN KEY", columns=columns, ref_schema=self.owner.schema, ref_table=table, ref_columns=ref, on_delete=on_delete, on_update=on_update, **k)

    def check(self, expression: str, name: str | None = None, no_inherit: bool = False) -> TableBuilder:
        return self._constraint(name or f"{self.name}_check", "CHECK", expression=expression, no_inherit=no_inherit)

    def exclude(self, *elements: tuple[str, str], name: str | None = None, method: str = "gist", predicate: str | None = None) -> TableBuilder:
        return self._constraint(name or f"{self.name}_excl", "EXCLUDE", elements=list(elements), method=method, predicate=predicate)

    def index(self, *columns: str | tuple, name: str | None = None, unique: bool = False, method: str = "btree", predicate: str | None = None) -> TableBuilder:
        cols = [(c, None, "asc", "last") if isinstance(c, str) else c for c in columns]
        name = name or f"{self.name}_{'_'.join(c[0] or 'expr' for c in cols)}_idx"
        self.owner.rows["indexes"].append((self.owner.id, self.name, name, method, unique, False, cols, predicate, None))
        return self
