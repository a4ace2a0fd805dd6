"""The schema queries in DuckDB SQL, over snapshots of the given tables."""

from __future__ import annotations

from .profile_sql import ctes

_FIELDS = {
    "column": ["position", "type", "is_nullable", "default_expr", "generated", "identity", "collation", "comment"],
    "constraint": ["kind", "columns", "ref_schema", "ref_table", "ref_columns", "on_delete", "on_update", "is_deferrable", "is_initially_deferred", "expression",
            "is_no_inherit", "nulls_not_distinct", "elements", "index_method", "predicate", "comment"],
    "index": ["method", "is_unique", "is_constraint_index", "columns", "predicate", "comment"],
    "view": ["definition", "is_materialized", "comment"],
    "sequence": ["data_type", "start_value", "increment", "min_value", "max_value", "cache_size", "is_cyclic", "comment"],
    "enum": ["labels", "comment"],
}
_RELATION = {"column": "columns", "constraint": "constraints", "index": "indexes", "view": "views", "sequence": "sequences", "enum": "enums"}
ALL = ("namespaces", "tables", "columns", "constraints", "indexes", "views", "sequences", "enums")

_JAC = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


#: What the types and names of the given tables' snapshots become, written down apart from the package's own tables.
PYTHON = {"int2": "int", "int4": "int", "int8": "int", "numeric": "Decimal", "varchar": "str", "text": "str", "timestamp": "datetime", "float4": "float"}
RUST = {"int2": "i16", "int4": "i32", "int8": "i64", "numeric": "Decimal", "varchar": "String", "text": "String", "timestamp": "NaiveDateTime", "float4": "f32"}
SQLALCHEMY = {"int2": "SmallInteger", "int4": "Integer", "int8": "BigInteger", "numeric": "Numeric", "varchar": "String", "text": "Text", "timestamp": "DateTime", "float4": "Float"}
RESERVED = ("all", "and", "any", "as", "asc", "both", "case", "desc", "do", "else", "end", "for", "from", "in", "into", "is", "left", "like", "not", "null", "on", "only", "or", "order", "select", "some", "table", "then", "to", "true", "union", "unique", "user", "using", "when", "where", "with")


def jac(a: str, b: str) -> str:
    return "(" + _JAC.format(a=a, b=b) + ")"


def _plain(c: str) -> str:
    return f"list_filter(list_transform({c}, lambda z: z.\"column\"), lambda z: z IS NOT NULL)"


_SIM = {
    "column": "CASE WHEN s.type IS NOT DISTINCT FROM t.type THEN 0.6::DOUBLE + (CASE WHEN s.is_nullable = t.is_nullable THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN s.default_expr IS NOT DISTINCT FROM t.default_expr THEN 0.1::DOUBLE ELSE 0 END) + 0.15::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + abs(s.position - t.position) * 0.2::DOUBLE)) ELSE 0.35::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + abs(s.position - t.position) * 0.5::DOUBLE)) END",
    "constraint": f"CASE WHEN s.kind <> t.kind THEN 0.0 WHEN s.kind IN ('PRIMARY KEY', 'UNIQUE') THEN {jac('s.columns', 't.columns')} WHEN s.kind = 'FOREIGN KEY' THEN {jac('s.columns', 't.columns')} * 0.5 + (CASE WHEN s.ref_table = t.ref_table AND s.ref_schema = t.ref_schema THEN 0.5 ELSE 0 END) WHEN s.kind = 'CHECK' THEN (CASE WHEN s.expression = t.expression THEN 1.0 ELSE 0.3 END) ELSE (CASE WHEN s.elements = t.elements THEN 1.0 ELSE 0.3 END) END",
    "index": f"(CASE WHEN s.method = t.method THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN s.is_unique = t.is_unique THEN 0.15::DOUBLE ELSE 0 END) + 0.5::DOUBLE * {jac(_plain('s.columns'), _plain('t.columns'))} + (CASE WHEN s.predicate IS NOT DISTINCT FROM t.predicate THEN 0.15::DOUBLE ELSE 0 END)",
    "view": "(CASE WHEN s.is_materialized = t.is_materialized THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN s.definition = t.definition THEN 0.7::DOUBLE ELSE 0.3::DOUBLE * (least(strlen(s.definition), strlen(t.definition))::DOUBLE / greatest(strlen(s.definition), strlen(t.definition))) END)",
    "sequence": "(CASE WHEN s.data_type = t.data_type THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN s.increment = t.increment THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN s.min_value = t.min_value AND s.max_value = t.max_value THEN 0.25::DOUBLE ELSE 0 END)",
    "enum": jac("s.labels", "t.labels"),
}


def diff_ctes(alone: bool = False) -> str:
    """CTEs up to `objects` (every change) and `sims` (every removed and added pair's similarity)."""
    q = [ctes(*ALL, alone=alone)]
    q.append("both_tables AS (SELECT s.pair_id, s.table_name FROM src_tables s JOIN tgt_tables t USING (pair_id, table_name))")
    q.append("gone_table AS (SELECT pair_id, table_name AS name FROM src_tables ANTI JOIN both_tables USING (pair_id, table_name)), new_table AS (SELECT pair_id, table_name AS name FROM tgt_tables ANTI JOIN both_tables USING (pair_id, table_name))")
    for side in ("src", "tgt"):
        q.append(f"cols_{side} AS (SELECT pair_id, table_name, list(name ORDER BY name) AS n, list({{'n': name, 't': type}} ORDER BY name) AS nt FROM {side}_columns GROUP BY ALL)")
    for kind, relation in _RELATION.items():
        inside = kind in ("column", "constraint", "index")
        key = "pair_id, table_name, name" if inside else "pair_id, name"
        semi = " SEMI JOIN both_tables USING (pair_id, table_name)" if inside else ""
        table = "table_name" if inside else "NULL::VARCHAR"
        for side in ("src", "tgt"):
            q.append(f"{side}_{kind} AS (SELECT * FROM {side}_{relation}{semi})")
        changed = " OR ".join(f"s.{f} IS DISTINCT FROM t.{f}" for f in _FIELDS[kind])
        q.append(f"mod_{kind} AS (SELECT s.pair_id, s.{'table_name' if inside else 'name'} AS owner, s.name FROM src_{kind} s JOIN tgt_{kind} t USING ({key}) WHERE {changed})")
        q.append(f"gone_{kind} AS (SELECT * FROM src_{kind} ANTI JOIN tgt_{kind} USING ({key})), new_{kind} AS (SELECT * FROM tgt_{kind} ANTI JOIN src_{kind} USING ({key}))")
        on = "pair_id, table_name" if inside else "pair_id"
        tn = "s.table_name" if inside else "NULL::VARCHAR"
        q.append(f"sim_{kind} AS (SELECT s.pair_id, '{kind}' AS kind, {tn} AS table_name, s.name AS from_name, t.name AS to_name, ({_SIM[kind]})::DOUBLE AS similarity FROM gone_{kind} s JOIN new_{kind} t USING ({on}))")
        del table
    kinds = list(_RELATION)
    a, b = "coalesce(cs.n, []::VARCHAR[])", "coalesce(ct.n, []::VARCHAR[])"
    q.append(f"""sim_table AS (SELECT g.pair_id, 'table' AS kind, NULL::VARCHAR AS table_name, g.name AS from_name, n.name AS to_name,
 (CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN (CASE WHEN st.kind = tt.kind THEN 0.5 ELSE 0 END) WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0
 ELSE (len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))) * 0.7::DOUBLE + (CASE WHEN len(list_intersect({a}, {b})) > 0 THEN len(list_intersect(cs.nt, ct.nt))::DOUBLE / len(list_intersect({a}, {b})) ELSE 0 END) * 0.3::DOUBLE END)::DOUBLE AS similarity
 FROM gone_table g JOIN new_table n USING (pair_id) JOIN src_tables st ON st.pair_id = g.pair_id AND st.table_name = g.name JOIN tgt_tables tt ON tt.pair_id = n.pair_id AND tt.table_name = n.name
 LEFT JOIN cols_src cs ON cs.pair_id = g.pair_id AND cs.table_name = g.name LEFT JOIN cols_tgt ct ON ct.pair_id = n.pair_id AND ct.table_name = n.name)""")
    q.append("sims AS (" + " UNION ALL ".join(f"SELECT * FROM sim_{k}" for k in ["table", *kinds]) + ")")
    q.append("cand AS (SELECT * FROM sims WHERE similarity >= 0.5)")
    q.append("""lists AS (SELECT pair_id, kind, table_name, list({'f': from_name, 't': to_name, 's': similarity} ORDER BY similarity DESC, from_name, to_name) AS c FROM cand GROUP BY ALL),
greedy AS (SELECT pair_id, kind, table_name, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.f = x[1].f OR y.t = x[1].t)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS r FROM lists),
renames AS (SELECT pair_id, kind, table_name, r.f AS from_name, r.t AS to_name, r.s AS similarity FROM greedy)""")
    touched = " UNION ".join(f"SELECT pair_id, owner AS name FROM mod_{k} UNION SELECT pair_id, table_name FROM gone_{k} UNION SELECT pair_id, table_name FROM new_{k}" for k in ("column", "constraint", "index"))
    q.append(f"mod_table AS (SELECT s.pair_id, s.table_name AS owner, s.table_name AS name FROM src_tables s JOIN tgt_tables t USING (pair_id, table_name) WHERE s.kind IS DISTINCT FROM t.kind OR s.comment IS DISTINCT FROM t.comment OR (s.pair_id, s.table_name) IN (SELECT (pair_id, name) FROM ({touched})))")
    parts = []
    for k in ["table", *kinds]:
        inside = k in ("column", "constraint", "index")
        tn = "table_name" if inside else "NULL::VARCHAR"
        null = "NULL::VARCHAR AS to_name, NULL::DOUBLE AS similarity"
        for change, frame, col in (("removed", "gone", "from_name"), ("added", "new", "to_name")):
            parts.append(f"SELECT x.pair_id, '{k}' AS kind, {'x.' + tn if inside else tn} AS table_name, x.name, '{change}' AS change, {null} FROM {frame}_{k} x WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.kind = '{k}' AND r.pair_id = x.pair_id AND r.{col} = x.name" + (" AND r.table_name = x.table_name" if inside else "") + ")")
        parts.append(f"SELECT pair_id, '{k}', {'owner' if inside else 'NULL'}, name, 'modified', NULL, NULL FROM mod_{k}")
    parts.append("SELECT pair_id, kind, table_name, from_name, 'renamed', to_name, similarity FROM renames")
    q.append("objects AS (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(q)


def field_sql(kind: str) -> str:
    """Changed fields of one kind; nested values aren't shown, only told."""
    inside = kind in ("column", "constraint", "index")
    key = "pair_id, table_name, name" if inside else "pair_id, name"
    rows = " UNION ALL ".join(f"SELECT s.pair_id, '{kind}' AS kind, {'s.table_name' if inside else 'NULL::VARCHAR'} AS table_name, s.name, '{f}' AS field FROM src_{kind} s JOIN tgt_{kind} t USING ({key}) WHERE s.{f} IS DISTINCT FROM t.{f}" for f in _FIELDS[kind])
    return f"{diff_ctes()} {rows}"


def objects_sql(where: str = "true", columns: str = "pair_id, kind, table_name, name, change, to_name, round(similarity, 9) AS similarity") -> str:
    return f"{diff_ctes()} SELECT {columns} FROM objects WHERE {where}"


SAFE = """(s.type.formatted = t.type.formatted OR (s.type.name IN ('int2', 'smallint') AND t.type.name IN ('int4', 'integer', 'int8', 'bigint')) OR (s.type.name IN ('int4', 'integer') AND t.type.name IN ('int8', 'bigint'))
 OR (s.type.name IN ('float4', 'real') AND t.type.name IN ('float8', 'double precision')) OR (s.type.name = 'varchar' AND t.type.name = 'text')
 OR (s.type.name = 'varchar' AND t.type.name = 'varchar' AND regexp_extract(s.type.formatted, '\\((\\d+)\\)', 1) <> '' AND (regexp_extract(t.type.formatted, '\\((\\d+)\\)', 1) = '' OR TRY_CAST(regexp_extract(t.type.formatted, '\\((\\d+)\\)', 1) AS INT) >= TRY_CAST(regexp_extract(s.type.formatted, '\\((\\d+)\\)', 1) AS INT))))"""


def breaking_rows() -> str:
    """Every breaking change, over the CTEs of `diff_ctes`."""
    pct = "round_even(similarity * 100, 0)::INT || '%)'"
    rows = []
    for kind, word in (("table", "Table"), ("column", "Column"), ("view", "View"), ("sequence", "Sequence")):
        label = "table_name || '.' || name" if kind == "column" else "name"
        owner = {"column": "table_name", "table": "name"}.get(kind, "NULL::VARCHAR")
        rows.append(f"SELECT pair_id, '{word}Dropped' AS change, 'Destructive' AS mitigation, {owner} AS table_name, name AS object_name, '{word} ''' || {label} || ''' was dropped' AS description FROM objects WHERE kind = '{kind}' AND change = 'removed'")
        rows.append(f"SELECT pair_id, '{word}Renamed', 'DualWrite', {owner}, name, '{word} ''' || {label} || ''' was renamed to ''' || to_name || ''' (similarity: ' || {pct} FROM objects WHERE kind = '{kind}' AND change = 'renamed'")
    rows.append(f"SELECT s.pair_id, 'ColumnTypeChanged', 'DualWrite', s.table_name, s.name, 'Column ''' || s.table_name || '.' || s.name || ''' type changed from ''' || s.type.formatted || ''' to ''' || t.type.formatted || '''' FROM src_column s JOIN tgt_column t USING (pair_id, table_name, name) WHERE s.type IS DISTINCT FROM t.type AND NOT {SAFE}")
    rows.append("SELECT s.pair_id, 'ColumnMadeNonNullable', 'Backfill', s.table_name, s.name, 'Column ''' || s.table_name || '.' || s.name || ''' changed from nullable to NOT NULL' FROM src_column s JOIN tgt_column t USING (pair_id, table_name, name) WHERE s.is_nullable AND NOT t.is_nullable")
    added = "FROM new_constraint n JOIN objects o ON o.kind = 'constraint' AND o.change = 'added' AND o.pair_id = n.pair_id AND o.table_name = n.table_name AND o.name = n.name WHERE n.kind ="
    keys = "array_to_string(n.columns, ', ')"
    for kind, change, text in (
        ("PRIMARY KEY", "PrimaryKeyAdded", f"'Primary key ''' || n.name || ''' added to table ''' || n.table_name || ''' on columns (' || {keys} || ')'"),
        ("UNIQUE", "UniqueConstraintAdded", f"'Unique constraint ''' || n.name || ''' added to table ''' || n.table_name || ''' on columns (' || {keys} || ')'"),
        ("CHECK", "CheckConstraintAdded", "'Check constraint ''' || n.name || ''' added to table ''' || n.table_name || ''': ' || n.expression"),
        ("FOREIGN KEY", "ForeignKeyAdded", f"'Foreign key ''' || n.name || ''' added to table ''' || n.table_name || ''' (' || {keys} || ') referencing ''' || n.ref_schema || '.' || n.ref_table || ''''"),
        ("EXCLUDE", "ExclusionConstraintAdded", "'Exclusion constraint ''' || n.name || ''' added to table ''' || n.table_name || ''''"),
    ):
        rows.append(f"SELECT n.pair_id, '{change}', 'Ratchet', n.table_name, n.name, {text} {added} '{kind}'")
    rows.append("SELECT s.pair_id, 'MaterializationChanged', 'DualWrite', NULL, s.name, 'View ''' || s.name || ''' changed ' || CASE WHEN t.is_materialized THEN 'from regular to materialized' ELSE 'from materialized to regular' END FROM src_view s JOIN tgt_view t USING (pair_id, name) WHERE s.is_materialized <> t.is_materialized")
    rows.append("SELECT s.pair_id, 'EnumValueRemoved', 'Destructive', NULL, s.name, 'Values removed from enum ''' || s.name || ''': ' || array_to_string(list_filter(s.labels, lambda v: NOT list_contains(t.labels, v)), ', ') FROM src_enum s JOIN tgt_enum t USING (pair_id, name) WHERE len(list_filter(s.labels, lambda v: NOT list_contains(t.labels, v))) > 0")
    rows.append("SELECT s.pair_id, 'EnumValuesReordered', 'Destructive', NULL, s.name, 'Enum ''' || s.name || ''' values were reordered' FROM src_enum s JOIN tgt_enum t USING (pair_id, name) WHERE list_filter(s.labels, lambda v: list_contains(t.labels, v)) <> list_filter(t.labels, lambda v: list_contains(s.labels, v))")
    return " UNION ALL ".join(rows)


def breaking_sql(tail: str) -> str:
    return f"{diff_ctes()}, breaking AS ({breaking_rows()}) {tail}"
