"""PostgreSQL text of identifiers, literals, columns, constraints and indexes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved words that an identifier can't be without quotes.
RESERVED = (
    "all", "analyse", "analyze", "and", "any", "array", "as", "asc", "asymmetric", "authorization", "between",
    "bigint", "binary", "bit", "boolean", "both", "case", "cast", "char", "character", "check", "coalesce", "collate",
    "collation", "column", "concurrently", "constraint", "create", "cross", "current_catalog", "current_date",
    "current_role", "current_schema", "current_time", "current_timestamp", "current_user", "dec", "decimal",
    "default", "deferrable", "desc", "distinct", "do", "else", "end", "except", "exists", "extract", "false", "fetch",
    "float", "for", "foreign", "freeze", "from", "full", "grant", "greatest", "group", "grouping", "having", "ilike",
    "in", "initially", "inner", "inout", "int", "integer", "intersect", "interval", "into", "is", "isnull", "join",
    "lateral", "leading", "least", "left", "like", "limit", "localtime", "localtimestamp", "national", "natural",
    "nchar", "none", "not", "notnull", "null", "nullif", "numeric", "offset", "on", "only", "or", "order", "out",
    "outer", "overlaps", "overlay", "placing", "position", "precision", "primary", "real", "references", "returning",
    "right", "row", "select", "session_user", "setof", "similar", "smallint", "some", "substring", "symmetric",
    "table", "tablesample", "then", "time", "timestamp", "to", "trailing", "treat", "trim", "true", "union", "unique",
    "user", "using", "values", "varchar", "variadic", "verbose", "when", "where", "window", "with",
)


#: A name that needs no quotes; one pattern, so an expression holds one literal and not one for each word.
_PLAIN = rf"^(?!(?:{'|'.join(RESERVED)})\z)[a-z_][a-z0-9_$]*\z"


@dataclass(frozen=True)
class RenderConfig:
    quoting: str = "when_needed"  # always, never, when_needed
    if_exists: bool = True
    if_not_exists: bool = False
    cascade: bool = False
    rollback: bool = True
    concurrently: bool = False
    include_comments: bool = True


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def literal(c: Column) -> Column:
    return text("'", F.replace(c, F.lit("'"), F.lit("''")), "'")


def quote(name: Column, quoting: str = "when_needed") -> Column:
    quoted = text('"', F.replace(name, F.lit('"'), F.lit('""')), '"')
    if quoting == "always":
        return quoted
    if quoting == "never":
        return name
    return F.when(name.rlike(_PLAIN), name).otherwise(quoted)


def quoted_list(names: Column, quoting: str) -> Column:
    return F.array_join(F.transform(names, lambda n: quote(n, quoting)), ", ")


def column_definition(c: Column, q: str) -> Column:
    """Name, type, collation, NOT NULL, default, generated and identity clauses, in this order."""
    null = F.lit("")
    return F.concat(
        quote(c["name"], q), F.lit(" "), c["type"]["formatted"],
        F.when(c["collation"] != "default", text(' COLLATE ', quote(F.lit("pg_catalog"), q), ".", quote(c["collation"], q))).otherwise(null),
        F.when(~c["is_nullable"], " NOT NULL").otherwise(null),
        F.coalesce(text(" DEFAULT ", c["default_expr"]), null),
        F.coalesce(text(" GENERATED ALWAYS AS (", c["generated"]["expression"], ") ", c["generated"]["storage"]), null),
        F.when(c["identity"] == "ALWAYS", " GENERATED ALWAYS AS IDENTITY").when(c["identity"] == "BY DEFAULT", " GENERATED BY DEFAULT AS IDENTITY").otherwise(null),
    )


def constraint_body(c: Column, q: str) -> Column:
    """What follows ADD CONSTRAINT name."""
    cols, none = quoted_list(c["columns"], q), F.lit("")
    action = lambda word, v: F.when(v.isNull() | (v == "NO ACTION"), none).otherwise(text(f" ON {word} ", v))
    late = F.concat(F.when(c["is_deferrable"], " DEFERRABLE").otherwise(none), F.when(c["is_deferrable"] & c["is_initially_deferred"], " INITIALLY DEFERRED").otherwise(none))
    parts = F.array_join(F.transform(c["elements"], lambda e: F.concat(e["expression"], F.lit(" WITH "), e["operator"])), ", ")
    return (
        F.when(c["kind"] == "PRIMARY KEY", text("PRIMARY KEY (", cols, ")"))
        .when(c["kind"] == "UNIQUE", F.concat(F.lit("UNIQUE"), F.when(c["nulls_not_distinct"], " NULLS NOT DISTINCT").otherwise(none), text(" (", cols, ")")))
        .when(c["kind"] == "CHECK", F.concat(text("CHECK (", c["expression"], ")"), F.when(c["is_no_inherit"], " NO INHERIT").otherwise(none)))
        .when(c["kind"] == "FOREIGN KEY", F.concat(text("FOREIGN KEY (", cols, ") REFERENCES ", quote(c["ref_schema"], q), ".", quote(c["ref_table"], q), " (",
                quoted_list(c["ref_columns"], q), ")"), action("DELETE", c["on_delete"]), action("UPDATE", c["on_update"]), late))
        .otherwise(F.concat(text("EXCLUDE USING ", c["index_method"], " (", parts, ")"), F.coalesce(text(" WHERE (", c["predicate"], ")"), none)))
    )


def index_column(c: Column, q: str) -> Column:
    usual = ((c["sort"] == "asc") & (c["nulls"] == "last")) | ((c["sort"] == "desc") & (c["nulls"] == "first"))
    return F.concat(
        F.coalesce(quote(c["column"], q), text("(", c["expression"], ")")),
        F.when(c["sort"] == "desc", " DESC").otherwise(""),
        F.when(usual, "").when(c["nulls"] == "first", " NULLS FIRST").otherwise(" NULLS LAST"),
    )
