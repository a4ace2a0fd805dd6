"""Plans, scripts, inverses, advanced similarities and generated code in DuckDB SQL, over the same fixture rows.

Written down from the rules of what is emitted, apart from the column expressions: every operation is one SELECT over the
changes (`objects`) and the target's rows, with the default rendering options.
"""

from __future__ import annotations

import keyword

from .oracle import PYTHON, RESERVED, RUST, SQLALCHEMY, breaking_rows, diff_ctes, jac

#: Dependency ranks of object kinds, and phases of a plan.
_KIND = {"enum": 0, "sequence": 1, "table": 2, "view": 3, "index": 4, "constraint": 5, "comment": 6}
_PHASE = {"drop": 1, "rename": 2, "create": 3, "alter": 4, "comment": 5}
_WORDS = "[" + ", ".join(f"'{w}'" for w in RESERVED) + "]"


def _q(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({x}, '[a-z_][a-z0-9_$]*') AND NOT list_contains({_WORDS}, {x}) THEN {x} ELSE '\"' || replace({x}, '\"', '\"\"') || '\"' END)"


def _list(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda n: {_q('n')}), ', ')"


def _lit(x: str) -> str:
    return f"('''' || replace({x}, '''', '''''') || '''')"


def _in(x: str) -> str:
    return f"(p.schema || '.' || {_q(x)})"


_COLUMN = (
    _q("x.name") + " || ' ' || x.type.formatted || CASE WHEN x.\"collation\" <> 'default' THEN ' COLLATE pg_catalog.' || " + _q('x."collation"') + " ELSE '' END"
    " || CASE WHEN NOT x.is_nullable THEN ' NOT NULL' ELSE '' END || coalesce(' DEFAULT ' || x.default_expr, '')"
    " || coalesce(' GENERATED ALWAYS AS (' || x.generated.expression || ') ' || x.generated.storage, '')"
    " || CASE x.identity WHEN 'ALWAYS' THEN ' GENERATED ALWAYS AS IDENTITY' WHEN 'BY DEFAULT' THEN ' GENERATED BY DEFAULT AS IDENTITY' ELSE '' END"
)
_CONSTRAINT = (
    f"CASE x.kind WHEN 'PRIMARY KEY' THEN 'PRIMARY KEY (' || {_list('x.columns')} || ')'"
    f" WHEN 'UNIQUE' THEN 'UNIQUE' || CASE WHEN x.nulls_not_distinct THEN ' NULLS NOT DISTINCT' ELSE '' END || ' (' || {_list('x.columns')} || ')'"
    " WHEN 'CHECK' THEN 'CHECK (' || x.expression || ')' || CASE WHEN x.is_no_inherit THEN ' NO INHERIT' ELSE '' END"
    f" WHEN 'FOREIGN KEY' THEN 'FOREIGN KEY (' || {_list('x.columns')} || ') REFERENCES ' || {_q('x.ref_schema')} || '.' || {_q('x.ref_table')} || ' (' || {_list('x.ref_columns')} || ')'"
    " || CASE WHEN x.on_delete IS NULL OR x.on_delete = 'NO ACTION' THEN '' ELSE ' ON DELETE ' || x.on_delete END || CASE WHEN x.on_update IS NULL OR x.on_update = 'NO ACTION' THEN '' ELSE ' ON UPDATE ' || x.on_update END"
    " || CASE WHEN x.is_deferrable THEN ' DEFERRABLE' || CASE WHEN x.is_initially_deferred THEN ' INITIALLY DEFERRED' ELSE '' END ELSE '' END"
    " ELSE 'EXCLUDE USING ' || x.index_method || ' (' || array_to_string(list_transform(x.elements, lambda e: e.expression || ' WITH ' || e.operator), ', ') || ')' || coalesce(' WHERE (' || x.predicate || ')', '') END"
)
_USUAL = "((i.sort = 'asc' AND i.nulls = 'last') OR (i.sort = 'desc' AND i.nulls = 'first'))"
_INDEX_COLUMN = f"(CASE WHEN i.\"column\" IS NOT NULL THEN {_q('i.\"column\"')} ELSE '(' || i.expression || ')' END || CASE WHEN i.sort = 'desc' THEN ' DESC' ELSE '' END || CASE WHEN {_USUAL} THEN '' ELSE ' NULLS ' || upper(i.nulls) END)"


def _ops() -> list[str]:
    out: list[str] = []

    def op(name: str, phase: str, kind: str, r1: str | int, frame: str, forward: str, back: str | None, said: str, table: str = "NULL", obj: str = "x.name", to: str = "NULL", r2: str | int = 0, many: bool = False) -> None:
        rollback = "NULL::VARCHAR[]" if back is None else f"[{back}]"
        out.append(
            f"SELECT p.pair_id, '{name}' AS op_kind, {_PHASE[phase]} AS phase, {_KIND[kind]} AS object_kind, {table}::VARCHAR AS table_name, {obj} AS name, {to}::VARCHAR AS to_name,"
            f" {forward if many else f'[{forward}]'} AS forward, {rollback} AS rollback, {said} AS description, {r1} AS r1, ({r2})::INT AS r2 FROM {frame}"
        )

    def changed(kind: str, change: str, more: str = "") -> str:
        return f"objects x JOIN psch p USING (pair_id) WHERE x.kind = '{kind}' AND x.change = '{change}'{more}"

    def detail(kind: str, relation: str, change: str, side: str = "tgt") -> str:
        owner = " AND o.table_name = x.table_name" if kind in ("column", "constraint", "index") else ""
        name = "x.table_name" if kind == "table" else "x.name"
        return f"objects o JOIN psch p USING (pair_id) JOIN {side}_{relation} x ON x.pair_id = o.pair_id AND {name} = o.name{owner} AND o.kind = '{kind}' AND o.change IN ({change})"

    path, inner = "p.schema || '.' || x.name", "p.schema || '.' || x.table_name || '.' || x.name"
    alter = f"'ALTER TABLE ' || {_in('x.table_name')}"
    for rank, (kind, name, word, label) in enumerate((("view", "DropView", "VIEW", "view"), ("table", "DropTable", "TABLE", "table"), ("sequence", "DropSequence", "SEQUENCE", "sequence"), ("enum", "DropEnum", "TYPE", "enum type"))):
        op(name, "drop", kind, rank, changed(kind, "removed"), f"'DROP {word} IF EXISTS ' || {_in('x.name')}", None, f"'Drop {label} ' || {path}")
    for r2, change, side in ((0, "'removed'", "src"), (3, "'modified'", "tgt")):
        op("DropIndex", "drop", "index", 4, detail("index", "indexes", change, side) + " WHERE NOT x.is_constraint_index", f"'DROP INDEX IF EXISTS ' || {_in('x.name')}", None, f"'Drop index ' || {path}", "x.table_name", r2=r2)
    for r2, change in ((1, "removed"), (2, "modified")):
        op("DropConstraint", "drop", "constraint", 4, changed("constraint", change), f"{alter} || ' DROP CONSTRAINT IF EXISTS ' || {_q('x.name')}", None, f"'Drop constraint ' || {inner}", "x.table_name", r2=r2)
    op("DropColumn", "drop", "table", 4, changed("column", "removed"), f"{alter} || ' DROP COLUMN IF EXISTS ' || {_q('x.name')}", None, f"'Drop column ' || {inner}", "x.table_name", r2=4)
    for rank, (kind, name, word, label) in enumerate((("table", "RenameTable", "TABLE", "table"), ("enum", "RenameEnum", "TYPE", "enum type"),
            ("sequence", "RenameSequence", "SEQUENCE", "sequence"), ("view", "RenameView", "VIEW", "view"), ("index", "RenameIndex", "INDEX", "index"))):
        say = lambda a, b, w=word: f"'ALTER {w} ' || {_in(a)} || ' RENAME TO ' || {_q(b)}"
        op(name, "rename", kind, 10 + rank, changed(kind, "renamed"), say("x.name", "x.to_name"), say("x.to_name", "x.name"), f"'Rename {label} ' || {path} || ' to ' || x.to_name", "x.table_name", to="x.to_name")
    for r1, (kind, name, word, rank) in enumerate((("column", "RenameColumn", "COLUMN", "table"), ("constraint", "RenameConstraint", "CONSTRAINT", "constraint")), 15):
        say = lambda a, b, w=word: f"{alter} || ' RENAME {w} ' || {_q(a)} || ' TO ' || {_q(b)}"
        op(name, "rename", rank, r1, changed(kind, "renamed"), say("x.name", "x.to_name"), say("x.to_name", "x.name"), f"'Rename {kind} ' || {inner} || ' to ' || x.to_name", "x.table_name", to="x.to_name")
    labels = f"array_to_string(list_transform(x.labels, lambda v: {_lit('v')}), ', ')"
    op("CreateEnum", "create", "enum", 20, detail("enum", "enums", "'added'"), f"'CREATE TYPE ' || {_in('x.name')} || ' AS ENUM (' || {labels} || ')'", f"'DROP TYPE ' || {_in('x.name')}", f"'Create enum type ' || {path}")
    fresh = "(SELECT s.pair_id, s.name, unnest(v) AS label, generate_subscripts(v, 1) - 1 AS k FROM (SELECT s.pair_id, s.name, list_filter(t.labels, lambda w: NOT list_contains(s.labels, w)) AS v FROM src_enums s JOIN tgt_enums t USING (pair_id, name)) s) x JOIN psch p USING (pair_id)"
    op("AddEnumValue", "create", "enum", 21, fresh, f"'ALTER TYPE ' || {_in('x.name')} || ' ADD VALUE ' || {_lit('x.label')}", None, f"'Add value ''' || x.label || ''' to enum ' || {path}", r2="x.k")
    sequence = f"'CREATE SEQUENCE ' || {_in('x.name')} || ' AS ' || x.data_type || ' START WITH ' || x.start_value || ' INCREMENT BY ' || x.increment || ' MINVALUE ' || x.min_value || ' MAXVALUE ' || x.max_value || ' CACHE ' || x.cache_size || CASE WHEN x.is_cyclic THEN ' CYCLE' ELSE ' NO CYCLE' END"
    op("CreateSequence", "create", "sequence", 22, detail("sequence", "sequences", "'added'"), sequence, f"'DROP SEQUENCE ' || {_in('x.name')}", f"'Create sequence ' || {path}")
    table = f"'CREATE TABLE ' || {_in('x.table_name')} || ' (' || chr(10) || coalesce(l.lines, '') || chr(10) || ')'"
    op("CreateTable", "create", "table", 23, detail("table", "tables",
            "'added'") + " LEFT JOIN body l ON l.pair_id = x.pair_id AND l.table_name = x.table_name LEFT JOIN depth d ON d.pair_id = x.pair_id AND d.name = x.table_name",
            table, f"'DROP TABLE IF EXISTS ' || {_in('x.table_name')}", "'Create table ' || p.schema || '.' || x.table_name", obj="x.table_name",
            r2="coalesce(d.depth, 0)")
    inside = lambda relation: f"objects o JOIN psch p USING (pair_id) JOIN tgt_{relation} x ON x.pair_id = o.pair_id AND x.table_name = o.name AND o.kind = 'table' AND o.change = 'added'"
    op("AddColumn", "create", "table", 26, detail("column", "columns", "'added'"), f"{alter} || ' ADD COLUMN ' || {_COLUMN}", f"{alter} || ' DROP COLUMN ' || {_q('x.name')}", f"'Add column ' || {inner}", "x.table_name", r2="x.position")
    for r1, frame in ((24, inside("constraints") + " WHERE x.kind IN ('FOREIGN KEY', 'EXCLUDE')"), (28, detail("constraint", "constraints", "'added', 'modified'"))):
        op("AddConstraint", "create", "constraint", r1, frame, f"{alter} || ' ADD CONSTRAINT ' || {_q('x.name')} || ' ' || {_CONSTRAINT}", f"{alter} || ' DROP CONSTRAINT ' || {_q('x.name')}", f"'Add constraint ' || {inner}", "x.table_name")
    index = f"'CREATE ' || CASE WHEN x.is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX ' || {_q('x.name')} || ' ON ' || {_in('x.table_name')} || CASE WHEN x.method = 'btree' THEN '' ELSE ' USING ' || x.method END || ' (' || array_to_string(list_transform(x.columns, lambda i: {_INDEX_COLUMN}), ', ') || ')' || coalesce(' WHERE ' || x.predicate, '')"
    for r1, frame in ((25, inside("indexes")), (29, detail("index", "indexes", "'added', 'modified'"))):
        op("CreateIndex", "create", "index", r1, frame + " WHERE NOT x.is_constraint_index", index, f"'DROP INDEX IF EXISTS ' || {_in('x.name')}", f"'Create index ' || {path} || ' on ' || x.table_name", "x.table_name")
    word = "CASE WHEN x.is_materialized THEN 'MATERIALIZED VIEW' ELSE 'VIEW' END"
    op("CreateView", "create", "view", 30, detail("view", "views", "'added'"), f"'CREATE ' || {word} || ' ' || {_in('x.name')} || ' AS ' || x.definition", f"'DROP ' || {word} || ' ' || {_in('x.name')}", f"'Create ' || lower({word}) || ' ' || {path}")
    head = f"{alter} || ' ALTER COLUMN ' || {_q('x.name')}"
    column = "src_column s JOIN tgt_column x USING (pair_id, table_name, name) JOIN psch p USING (pair_id)"
    differ = lambda f: f"s.{f} IS DISTINCT FROM x.{f}"
    parts = [
        f"CASE WHEN {differ('type')} THEN {head} || ' TYPE ' || x.type.formatted END",
        f"CASE WHEN {differ('is_nullable')} THEN {head} || CASE WHEN x.is_nullable THEN ' DROP NOT NULL' ELSE ' SET NOT NULL' END END",
        f"CASE WHEN {differ('default_expr')} THEN {head} || coalesce(' SET DEFAULT ' || x.default_expr, ' DROP DEFAULT') END",
        f"CASE WHEN {differ('identity')} THEN {head} || coalesce(' ADD GENERATED ' || x.identity || ' AS IDENTITY', ' DROP IDENTITY IF EXISTS') END",
    ]
    where = " OR ".join(differ(f) for f in ("type", "is_nullable", "default_expr", "identity"))
    op("AlterColumn", "alter", "table", 27, f"{column} WHERE {where}", f"list_filter([{', '.join(parts)}], lambda z: z IS NOT NULL)", None, f"'Alter column ' || {inner}", "x.table_name", many=True)
    clauses = [f"CASE WHEN {differ(f)} THEN '{w} ' || x.{f} END" for w, f in (("AS", "data_type"), ("INCREMENT BY", "increment"), ("MINVALUE", "min_value"), ("MAXVALUE", "max_value"), ("START WITH", "start_value"), ("CACHE", "cache_size"))]
    clauses.append(f"CASE WHEN {differ('is_cyclic')} THEN CASE WHEN x.is_cyclic THEN 'CYCLE' ELSE 'NO CYCLE' END END")
    given = f"array_to_string(list_filter([{', '.join(clauses)}], lambda z: z IS NOT NULL), ' ')"
    op("AlterSequence", "alter", "sequence", 22, f"src_sequence s JOIN tgt_sequence x USING (pair_id, name) JOIN psch p USING (pair_id) WHERE {given} <> ''",
            f"'ALTER SEQUENCE ' || {_in('x.name')} || ' ' || {given}", None, f"'Alter sequence ' || {path}")
    for kind, relation, owned in (("table", "tables", False), ("column", "column", True), ("constraint", "constraint", True), ("index", "index", True), ("view", "view", False), ("sequence", "sequence", False), ("enum", "enum", False)):
        key = "pair_id, table_name" if kind == "table" else "pair_id, table_name, name" if owned else "pair_id, name"
        name = "x.table_name" if kind == "table" else "x.name"
        on = {"column": f"'COLUMN ' || {_in('x.table_name')} || '.' || {_q('x.name')}",
                "constraint": f"'CONSTRAINT ' || {_q('x.name')} || ' ON ' || {_in('x.table_name')}", "enum": f"'TYPE ' || {_in('x.name')}"}.get(kind,
                f"'{kind.upper()} ' || {_in(name)}")
        text = f"'COMMENT ON ' || {on} || ' IS ' || coalesce({_lit('x.comment')}, 'NULL')"
        label = ("x.table_name || '.' || " if owned else "") + name
        op("SetComment", "comment", "comment", 40, f"src_{relation} s JOIN tgt_{relation} x USING ({key}) JOIN psch p USING (pair_id) WHERE s.comment IS DISTINCT FROM x.comment",
                text, None, f"CASE WHEN x.comment IS NULL THEN 'Remove' ELSE 'Set' END || ' comment on {kind} ' || {label}", "x.table_name" if owned else "NULL", name)
    note = f"'COMMENT ON SCHEMA ' || {_q('x.schema')} || ' IS ' || coalesce({_lit('x.comment')}, 'NULL')"
    op("SetComment", "comment", "comment", 40, "src_namespaces s JOIN tgt_namespaces x USING (pair_id) JOIN psch p USING (pair_id) WHERE s.comment IS DISTINCT FROM x.comment",
            note, None, "CASE WHEN x.comment IS NULL THEN 'Remove' ELSE 'Set' END || ' comment on namespace ' || s.schema", obj="s.schema")
    return out


def plan_ctes(alone: bool = False) -> str:
    """CTEs up to `plan`: the ordered operations of every pair."""
    lines = (
        f"lines AS (SELECT pair_id, table_name, 0 AS a, position AS b, '' AS c, '    ' || {_COLUMN} AS line FROM tgt_columns x"
        f" UNION ALL SELECT pair_id, table_name, 1, 0, name, '    CONSTRAINT ' || {_q('x.name')} || ' ' || {_CONSTRAINT} FROM tgt_constraints x WHERE kind IN ('PRIMARY KEY', 'UNIQUE', 'CHECK')),"
        " body AS (SELECT pair_id, table_name, string_agg(line, ',' || chr(10) ORDER BY a, b, c) AS lines FROM lines GROUP BY ALL)"
    )
    depth = """added AS (SELECT pair_id, name FROM objects WHERE kind = 'table' AND change = 'added'),
edges AS (SELECT DISTINCT c.pair_id, c.table_name AS a, c.ref_table AS b FROM tgt_constraints c JOIN added x ON x.pair_id = c.pair_id AND x.name = c.table_name JOIN added y ON y.pair_id = c.pair_id AND y.name = c.ref_table WHERE c.kind = 'FOREIGN KEY' AND c.table_name <> c.ref_table),
walk AS (SELECT pair_id, name, 0 AS depth FROM added UNION ALL SELECT w.pair_id, e.a, w.depth + 1 FROM walk w JOIN edges e ON e.pair_id = w.pair_id AND e.b = w.name WHERE w.depth < 50),
depth AS (SELECT pair_id, name, max(depth) AS depth FROM walk GROUP BY ALL)"""
    create = "CASE WHEN object_kind <= 1 THEN object_kind WHEN op_kind = 'CreateTable' THEN 2 WHEN object_kind = 2 THEN 3 WHEN object_kind = 3 THEN 9 ELSE object_kind + 1 END"
    major = f"CASE phase WHEN 1 THEN -object_kind WHEN 3 THEN {create} ELSE object_kind END"
    deep = "CASE WHEN op_kind = 'CreateTable' THEN r2 ELSE 0 END"
    return ",\n".join(
        [
            diff_ctes(alone),
            "psch AS (SELECT p.pair_id, coalesce(t.schema, s.schema, 'public') AS schema FROM pairs p LEFT JOIN namespaces t ON t.snapshot_id = p.target_id LEFT JOIN namespaces s ON s.snapshot_id = p.source_id)",
            lines,
            depth,
            "ops AS (" + " UNION ALL ".join(_ops()) + ")",
            f"plan AS (SELECT *, (row_number() OVER (PARTITION BY pair_id ORDER BY phase, {major}, {deep}, r1, table_name NULLS FIRST, r2, name))::INT AS seq FROM ops)",
        ]
    )


def plan_sql(tail: str, alone: bool = False) -> str:
    return f"{plan_ctes(alone)} {tail}"


ORDERED = "SELECT pair_id, seq, op_kind, phase, object_kind, table_name, name, to_name, description FROM plan"
RENDERED = "SELECT pair_id, seq, op_kind, array_to_string(forward, ';' || chr(10)) AS sql, array_to_string(rollback, ';' || chr(10)) AS rollback_sql FROM plan"
_SAID = "'-- ' || description || chr(10) || array_to_string(list_transform(forward, lambda f: f || ';' || chr(10)), '')"
_UNDO = "array_to_string(list_transform(rollback, lambda f: f || ';' || chr(10)), '')"
SCRIPT = f"SELECT pair_id, 'BEGIN;' || chr(10) || chr(10) || string_agg({_SAID}, chr(10) ORDER BY seq) || chr(10) || 'COMMIT;' || chr(10) AS sql, 'BEGIN;' || chr(10) || chr(10) || coalesce(string_agg({_UNDO}, '' ORDER BY seq DESC), '') || chr(10) || 'COMMIT;' || chr(10) AS rollback_sql, sum(len(forward))::INT AS n_statements FROM plan GROUP BY pair_id"
#: Operations whose inverse can be told from themselves.
_INVERSE = "CASE WHEN op_kind LIKE 'Rename%' THEN op_kind WHEN op_kind LIKE 'Create%' THEN 'Drop' || substr(op_kind, 7) ELSE 'Drop' || substr(op_kind, 4) END"
_BACK = "(op_kind LIKE 'Rename%' OR op_kind LIKE 'Create%' OR op_kind IN ('AddColumn', 'AddConstraint'))"
INVERSE = f"""SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY seq DESC))::INT AS seq, {_INVERSE} AS op_kind, table_name, CASE WHEN op_kind LIKE 'Rename%' THEN to_name ELSE name END AS name,
 CASE WHEN op_kind LIKE 'Rename%' THEN name END AS to_name, NULL::VARCHAR AS error FROM plan p WHERE NOT EXISTS (SELECT 1 FROM plan x WHERE x.pair_id = p.pair_id AND NOT {_BACK.replace('op_kind', 'x.op_kind')})
 UNION ALL SELECT pair_id, seq, op_kind, table_name, name, to_name, 'cannot revert ' || op_kind FROM plan WHERE NOT {_BACK}"""


def affected_sql() -> str:
    hit = "contains(lower(s.sql), lower(b.object_name)) OR (b.table_name IS NOT NULL AND contains(lower(s.sql), lower(b.table_name)))"
    return f"{plan_ctes()}, breaking AS ({breaking_rows()}), s AS (SELECT pair_id, seq, array_to_string(forward, ';' || chr(10)) AS sql FROM plan) SELECT DISTINCT b.pair_id, b.change, b.object_name, s.seq, s.sql FROM breaking b JOIN s USING (pair_id) WHERE {hit}"


def replayed_sql(source_seq: bool = False) -> str:
    """What a plan makes of its source: the target's objects, but that a renamed object keeps what it was, and enums keep their values."""
    moved = "SELECT pair_id, from_name, to_name FROM renames WHERE kind = 'table'"
    inner = lambda rel, cols: f"SELECT x.pair_id, x.table_name, x.name, {cols} FROM tgt_{rel} x WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.pair_id = x.pair_id AND m.to_name = x.table_name) UNION ALL SELECT x.pair_id, m.to_name, x.name, {cols} FROM src_{rel} x JOIN moved m ON m.pair_id = x.pair_id AND m.from_name = x.table_name"
    was = lambda kind, rel, col: f"coalesce((SELECT s.{col} FROM renames r JOIN src_{rel} s ON s.pair_id = r.pair_id AND s.name = r.from_name AND s.table_name = r.table_name WHERE r.kind = '{kind}' AND r.pair_id = x.pair_id AND r.table_name = x.table_name AND r.to_name = x.name), x.{col})"
    top = lambda kind, rel, col: f"coalesce((SELECT s.{col} FROM renames r JOIN src_{rel} s ON s.pair_id = r.pair_id AND s.name = r.from_name WHERE r.kind = '{kind}' AND r.pair_id = x.pair_id AND r.to_name = x.name), x.{col})"
    labels = "CASE WHEN s.labels IS NULL THEN coalesce(o.labels, x.labels) ELSE list_concat(s.labels, list_filter(x.labels, lambda v: NOT list_contains(s.labels, v))) END"
    enums = f"SELECT x.pair_id, x.name, {labels} AS labels FROM tgt_enums x LEFT JOIN src_enums s USING (pair_id, name) LEFT JOIN renames r ON r.kind = 'enum' AND r.pair_id = x.pair_id AND r.to_name = x.name LEFT JOIN src_enums o ON o.pair_id = r.pair_id AND o.name = r.from_name"
    after = f"""SELECT pair_id, 'table' AS kind, NULL::VARCHAR AS table_name, table_name AS name, NULL::VARCHAR AS type, NULL::BOOLEAN AS is_nullable FROM tgt_tables
 UNION ALL SELECT pair_id, 'column', table_name, name, formatted, is_nullable FROM ({inner('columns', 'x.type.formatted AS formatted, ' + was('column', 'columns', 'is_nullable') + ' AS is_nullable')})
 UNION ALL SELECT pair_id, 'constraint', table_name, name, kind, NULL FROM ({inner('constraints', 'x.kind')})
 UNION ALL SELECT pair_id, 'index', table_name, name, method, NULL FROM ({inner('indexes', was('index', 'indexes', 'method') + ' AS method, ' + was('index', 'indexes', 'is_constraint_index') + ' AS is_constraint_index')}) WHERE NOT is_constraint_index
 UNION ALL SELECT pair_id, 'enum', NULL, name, array_to_string(list_sort(labels), ','), NULL FROM ({enums})
 UNION ALL SELECT pair_id, 'sequence', NULL, name, {top('sequence', 'sequences', 'data_type')}, NULL FROM tgt_sequences x UNION ALL SELECT pair_id, 'view', NULL, name, NULL, NULL FROM tgt_views"""
    head = f"{diff_ctes()}, moved AS ({moved})"
    if not source_seq:
        return f"{head} {after}"
    before = """SELECT pair_id, 'table' AS kind, NULL::VARCHAR AS table_name, table_name AS name, NULL::VARCHAR AS type, NULL::BOOLEAN AS is_nullable FROM src_tables
 UNION ALL SELECT pair_id, 'column', table_name, name, type.formatted, is_nullable FROM src_columns UNION ALL SELECT pair_id, 'constraint', table_name, name, kind, NULL FROM src_constraints
 UNION ALL SELECT pair_id, 'index', table_name, name, method, NULL FROM src_indexes WHERE NOT is_constraint_index UNION ALL SELECT pair_id, 'enum', NULL, name, array_to_string(list_sort(labels), ','), NULL FROM src_enums
 UNION ALL SELECT pair_id, 'sequence', NULL, name, data_type, NULL FROM src_sequences UNION ALL SELECT pair_id, 'view', NULL, name, NULL, NULL FROM src_views"""
    return f"{head} SELECT 2 AS seq, * FROM ({after}) UNION ALL SELECT 1, * FROM ({before})"


STATEMENTS = "SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY seq, k))::INT AS position, description, sql FROM (SELECT pair_id, seq, description, unnest(forward) AS sql, generate_subscripts(forward, 1) AS k FROM plan)"
EXECUTED = f"""SELECT pair_id, '-- Migration: ' || pair_id || chr(10) || '-- a change' || chr(10) || chr(10) || string_agg('-- [' || position || '/' || n || '] ' || description || chr(10) || sql || ';' || chr(10) || chr(10), '' ORDER BY position) || '-- Migration complete' || chr(10) AS output
 FROM (SELECT *, count(*) OVER (PARTITION BY pair_id) AS n FROM ({STATEMENTS})) GROUP BY pair_id"""
DESCRIBED = f"SELECT pair_id, to_json({{'name': pair_id, 'operations': count(*), 'statements': sum(len(forward))::BIGINT, 'reversible': bool_and({_BACK})}})::VARCHAR AS output FROM plan GROUP BY pair_id"


def compiled_sql() -> str:
    return f"""{plan_ctes()}, breaking AS ({breaking_rows()}), g AS (SELECT pair_id, count(*) AS n, sum(len(forward)) AS m, bool_and({_BACK}) AS back FROM plan GROUP BY pair_id), b AS (SELECT pair_id, count(*) AS n FROM breaking GROUP BY pair_id)
 SELECT p.pair_id, coalesce(g.n, 0)::INT AS n_operations, coalesce(g.m, 0)::INT AS n_statements, g.back AS is_reversible, coalesce(b.n, 0)::BIGINT AS n_breaking, CASE WHEN g.n IS NULL THEN 'NoChanges' END AS error FROM pairs p LEFT JOIN g USING (pair_id) LEFT JOIN b USING (pair_id)"""


# ---- advanced similarity ------------------------------------------------------------


def name_sim(a: str, b: str) -> str:
    """Name similarity of two expressions: edit distance, and a bonus for common beginnings, ends, containment and words."""
    x, y = f"lower({a})", f"lower({b})"
    pre = lambda u, v: f"len(list_filter(range(1, least(length({u}), length({v})) + 1), lambda i: left({u}, i::INT) = left({v}, i::INT)))"
    lo, hi = f"least(strlen({x}), strlen({y}))", f"greatest(strlen({x}), strlen({y}))"
    wx, wy = f"list_distinct(regexp_split_to_array({x}, '[_-]'))", f"list_distinct(regexp_split_to_array({y}, '[_-]'))"
    p, s = pre(x, y), pre(f"reverse({x})", f"reverse({y})")
    bonus = f"least(1.0::DOUBLE, (CASE WHEN {p} >= 3 THEN 0.3::DOUBLE * ({p}::DOUBLE / {lo}) ELSE 0 END) + (CASE WHEN {s} >= 3 THEN 0.3::DOUBLE * ({s}::DOUBLE / {lo}) ELSE 0 END) + (CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.4::DOUBLE * ({lo}::DOUBLE / {hi}) ELSE 0 END) + 0.3::DOUBLE * (len(list_intersect({wx}, {wy}))::DOUBLE / len(list_distinct(list_concat({wx}, {wy})))))"
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, (1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / {hi}) * 0.7::DOUBLE + {bonus} * 0.3::DOUBLE) END)"


def column_advanced_sql() -> str:
    near = lambda slope: f"(1.0::DOUBLE / (1.0::DOUBLE + abs(s.position - t.position) * {slope}::DOUBLE))"
    names = name_sim("s.name", "t.name")
    same = f"0.5::DOUBLE + (CASE WHEN s.is_nullable = t.is_nullable THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN s.default_expr IS NOT DISTINCT FROM t.default_expr THEN 0.1::DOUBLE ELSE 0 END) + 0.15::DOUBLE * {near(0.2)} + 0.15::DOUBLE * {names}"
    score = f"CASE WHEN s.type IS NOT DISTINCT FROM t.type THEN {same} ELSE 0.35::DOUBLE * ({near(0.5)} * 0.3::DOUBLE + {names} * 0.7::DOUBLE) END"
    return f"{diff_ctes()} SELECT s.pair_id, s.table_name, s.name AS from_name, t.name AS to_name, round({score}, 9)::DOUBLE AS similarity FROM gone_column s JOIN new_column t USING (pair_id, table_name)"


def table_advanced_sql() -> str:
    """Five parts: columns by weighted Jaccard, types, constraints, indexes and the name."""
    q = [diff_ctes()]
    for side in ("src", "tgt"):
        q.append(f"""full_{side} AS (SELECT t.pair_id, t.table_name AS name,
 coalesce((SELECT list({{'n': c.name, 't': c.type}} ORDER BY c.name) FROM {side}_columns c WHERE c.pair_id = t.pair_id AND c.table_name = t.table_name), []) AS cols,
 coalesce((SELECT list({{'k': c.kind, 'c': c.columns, 'r': c.ref_table}} ORDER BY c.name) FROM {side}_constraints c WHERE c.pair_id = t.pair_id AND c.table_name = t.table_name), []) AS cons,
 coalesce((SELECT list({{'m': i.method, 'u': i.is_unique, 'c': list_filter(list_transform(i.columns, lambda z: z."column"), lambda z: z IS NOT NULL), 'p': i.predicate}} ORDER BY i.name) FROM {side}_indexes i WHERE NOT i.is_constraint_index AND i.pair_id = t.pair_id AND i.table_name = t.table_name), []) AS idx
 FROM {side}_tables t)""")
    of = lambda s, k: f"list_filter({s}.cons, lambda c: c.k = '{k}')"
    keyed = lambda s, k: f"flatten(list_transform({of(s, k)}, lambda c: c.c))"
    weight = lambda s: f"((CASE WHEN list_contains({s}.pk, n) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN list_contains({s}.fk, n) THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END))"
    q.append("m AS (SELECT a.pair_id, {'name': a.name, 'n': list_transform(a.cols, lambda c: c.n), 'cols': a.cols, 'cons': a.cons, 'idx': a.idx, 'pk': " + keyed("a", "PRIMARY KEY") + ", 'fk': " + keyed("a", "FOREIGN KEY") + "} AS a,"
             " {'name': b.name, 'n': list_transform(b.cols, lambda c: c.n), 'cols': b.cols, 'cons': b.cons, 'idx': b.idx, 'pk': " + keyed("b", "PRIMARY KEY") + ", 'fk': " + keyed("b", "FOREIGN KEY") + "} AS b"
             " FROM full_src a JOIN gone_table g ON g.pair_id = a.pair_id AND g.name = a.name JOIN new_table w ON w.pair_id = a.pair_id JOIN full_tgt b ON b.pair_id = w.pair_id AND b.name = w.name)")  # fmt: skip
    total = lambda names, s: f"coalesce(list_sum(list_transform({names}, lambda n: {weight(s)})), 0)"
    best = lambda own, other, score: f"(CASE WHEN len({own}) = 0 AND len({other}) = 0 THEN 1.0::DOUBLE WHEN len({own}) = 0 OR len({other}) = 0 THEN 0.0::DOUBLE ELSE list_avg(list_transform({own}, lambda x: list_max(list_transform({other}, lambda y: {score})))) END)"
    both = "list_filter(a.n, lambda n: list_contains(b.n, n))"
    q.append(f"w AS (SELECT *, {total(both, 'a')} AS inner_w, {total('a.n', 'a')} AS wa, {total('b.n', 'b')} AS wb, {of('a', 'PRIMARY KEY')} AS pa, {of('b', 'PRIMARY KEY')} AS pb, {of('a', 'UNIQUE')} AS ua, {of('b', 'UNIQUE')} AS ub, {of('a', 'FOREIGN KEY')} AS fa, {of('b', 'FOREIGN KEY')} AS fb FROM m)")
    types = f"(CASE WHEN len({both}) > 0 THEN len(list_intersect(a.cols, b.cols))::DOUBLE / len({both}) ELSE 0 END)"
    pk = f"(CASE WHEN len(pa) > 0 AND len(pb) > 0 THEN 0.5::DOUBLE * {jac('pa[1].c', 'pb[1].c')} WHEN len(pa) = 0 AND len(pb) = 0 THEN 0.5::DOUBLE ELSE 0 END)"
    u = f"(CASE WHEN len(ua) > 0 OR len(ub) > 0 THEN 0.3::DOUBLE * {best('ua', 'ub', jac('x.c', 'y.c'))} ELSE 0 END)"
    fk_score = jac("x.c", "y.c") + " * 0.5::DOUBLE + (CASE WHEN x.r = y.r THEN 0.5::DOUBLE ELSE 0 END)"
    f = f"(CASE WHEN len(fa) > 0 OR len(fb) > 0 THEN 0.2::DOUBLE * {best('fa', 'fb', fk_score)} ELSE 0 END)"
    weights = "(0.5::DOUBLE + (CASE WHEN len(ua) > 0 OR len(ub) > 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN len(fa) > 0 OR len(fb) > 0 THEN 0.2::DOUBLE ELSE 0 END))"
    cons = f"(CASE WHEN len(a.cons) = 0 AND len(b.cons) = 0 THEN 1.0::DOUBLE WHEN len(a.cons) = 0 OR len(b.cons) = 0 THEN 0.0::DOUBLE ELSE ({pk} + {u} + {f}) / {weights} END)"
    idx_score = f"(CASE WHEN x.m = y.m THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN x.u = y.u THEN 0.15::DOUBLE ELSE 0 END) + 0.5::DOUBLE * {jac('x.c', 'y.c')} + (CASE WHEN x.p IS NOT DISTINCT FROM y.p THEN 0.15::DOUBLE ELSE 0 END)"
    names = name_sim("a.name", "b.name")
    score = f"CASE WHEN len(a.n) = 0 AND len(b.n) = 0 THEN {names} WHEN len(a.n) = 0 OR len(b.n) = 0 THEN {names} * 0.1::DOUBLE ELSE inner_w / (wa + wb - inner_w) * 0.35::DOUBLE + {types} * 0.25::DOUBLE + {cons} * 0.15::DOUBLE + {best('a.idx', 'b.idx', idx_score)} * 0.1::DOUBLE + {names} * 0.15::DOUBLE END"
    return ",\n".join(q) + f" SELECT pair_id, a.name AS from_name, b.name AS to_name, round({score}, 9)::DOUBLE AS similarity FROM w"


# ---- generated code -------------------------------------------------------------------

_KEYWORDS = ", ".join(f"'{w}'" for w in sorted({*keyword.kwlist, *keyword.softkwlist} - {"_"}))


def _mapped(table: dict[str, str], default: str) -> str:
    return "CASE regexp_replace(c.type.name, '^_', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def codegen_ctes() -> str:
    """CTEs up to `fields`: one line of a Python model for each column.  Names are plain lower-case ones."""
    kind = f"CASE WHEN c.type.is_array THEN 'list[' || {_mapped(PYTHON, 'Any')} || ']' ELSE {_mapped(PYTHON, 'Any')} END"
    sa = f"CASE WHEN c.type.is_array THEN 'ARRAY(' || {_mapped(SQLALCHEMY, 'String')} || ')' WHEN c.type.name IN ('json', 'jsonb') THEN 'JSON' END"
    size = "nullif(regexp_extract(lower(c.type.formatted), '^(?:character varying|varchar|character|char)\\((\\d+)\\)', 1), '')"
    args = f"""list_filter([CASE WHEN auto THEN 'default=None' END, CASE WHEN is_pk THEN 'primary_key=True' END, 'foreign_key="' || fk || '"', CASE WHEN is_unique AND NOT is_pk THEN 'unique=True' END,
 CASE WHEN is_indexed AND NOT is_pk AND NOT is_unique THEN 'index=True' END, CASE WHEN type_name IN ('char', 'character', 'bpchar') THEN 'min_length=' || size END, 'max_length=' || size, 'sa_type=' || sa, CASE WHEN attr <> lower(name) THEN 'alias="' || name || '"' END], lambda z: z IS NOT NULL)"""
    return ",\n".join([
        diff_ctes(),
        "pks AS (SELECT snapshot_id, table_name, unnest(columns) AS name FROM constraints WHERE kind = 'PRIMARY KEY')",
        "fks AS (SELECT k.snapshot_id, k.table_name, k.columns[1] AS name, min(coalesce(k.ref_schema, n.schema) || '.' || k.ref_table || '.' || k.ref_columns[1]) AS fk FROM constraints k JOIN namespaces n USING (snapshot_id) WHERE k.kind = 'FOREIGN KEY' AND len(k.columns) = 1 GROUP BY ALL)",
        f"""facts AS (SELECT c.snapshot_id, c.table_name, c.name, c.position, c.is_nullable, c.default_expr, c.type.name AS type_name, p.name IS NOT NULL AS is_pk, p.name IS NOT NULL AND (c.identity IS NOT NULL OR c.type.name LIKE '%serial%') AS auto, f.fk,
 EXISTS (SELECT 1 FROM constraints u WHERE u.kind = 'UNIQUE' AND u.snapshot_id = c.snapshot_id AND u.table_name = c.table_name AND u.columns = [c.name]) AS is_unique,
 EXISTS (SELECT 1 FROM indexes i WHERE NOT i.is_constraint_index AND i.snapshot_id = c.snapshot_id AND i.table_name = c.table_name AND len(i.columns) = 1 AND i.columns[1]."column" = c.name) AS is_indexed,
 {kind} AS kind, {sa} AS sa, {size} AS size, CASE WHEN c.name IN ({_KEYWORDS}) THEN c.name || '_' ELSE c.name END AS attr
 FROM columns c LEFT JOIN pks p ON p.snapshot_id = c.snapshot_id AND p.table_name = c.table_name AND p.name = c.name LEFT JOIN fks f ON f.snapshot_id = c.snapshot_id AND f.table_name = c.table_name AND f.name = c.name)""",
        f"given AS (SELECT *, {args} AS args FROM facts)",
        """fields AS (SELECT snapshot_id, table_name, name AS column_name, CASE WHEN is_pk THEN 0 WHEN NOT (auto OR is_nullable) THEN 1 ELSE 2 END * 100000 + position AS ordinal,
 '    ' || attr || ': ' || kind || CASE WHEN auto OR is_nullable THEN ' | None' ELSE '' END || CASE WHEN len(args) > 0 THEN ' = Field(' || array_to_string(args, ', ') || ')' WHEN is_nullable AND default_expr IS NULL THEN ' = None' ELSE '' END AS line FROM given)""",
        # class names: words with a capital, the last one without its plural s
        """named AS (SELECT snapshot_id, table_name, comment, array_to_string(list_transform(string_split(CASE WHEN table_name LIKE '%ies' THEN regexp_replace(table_name, 'ies$', 'y') WHEN regexp_matches(table_name, '(ss|us|is)$') THEN table_name ELSE regexp_replace(table_name, 's$', '') END, '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '') AS class_name FROM tables)""",
    ])


def python_files_sql(head: str) -> str:
    quoted = "array_to_string(list_transform({}, lambda c: '\"' || c || '\"'), ', ')"
    extra = f"""extra AS (SELECT snapshot_id, table_name, 'UniqueConstraint(' || {quoted.format('columns')} || ', name="' || name || '")' AS arg, NULL::VARCHAR AS warning FROM constraints WHERE kind = 'UNIQUE' AND len(columns) > 1
 UNION ALL SELECT snapshot_id, table_name, 'CheckConstraint("' || replace(replace(expression, '\\', '\\\\'), '"', '\\"') || '", name="' || name || '")', NULL FROM constraints WHERE kind = 'CHECK'
 UNION ALL SELECT snapshot_id, table_name, 'Index("' || name || '", ' || {quoted.format('list_transform(columns, lambda z: z."column")')} || ')', NULL FROM indexes WHERE NOT is_constraint_index AND len(columns) > 1
 UNION ALL SELECT snapshot_id, table_name, NULL::VARCHAR, '# WARNING: exclusion constraint ''' || name || ''' has no equivalent' FROM constraints WHERE kind = 'EXCLUDE'),
 args AS (SELECT snapshot_id, table_name, coalesce(string_agg('        ' || arg || ',' || chr(10), '' ORDER BY arg), '') AS args, coalesce(string_agg(warning || chr(10), '' ORDER BY warning), '') AS warnings FROM extra GROUP BY ALL),
 bodies AS (SELECT snapshot_id, table_name, string_agg(line, chr(10) ORDER BY ordinal, line) AS body FROM fields GROUP BY ALL),
 models AS (SELECT n.snapshot_id, n.table_name, coalesce(a.warnings, '') || 'class ' || n.class_name || '(SQLModel, table=True):' || chr(10) || coalesce('    \"\"\"' || n.comment || '\"\"\"' || chr(10) || chr(10), '') || '    __tablename__ = "' || n.table_name || '"' || chr(10)
 || CASE WHEN coalesce(a.args, '') <> '' THEN '    __table_args__ = (' || chr(10) || a.args || '    )' || chr(10) ELSE '' END || chr(10) || coalesce(b.body, '    pass') AS code FROM named n LEFT JOIN args a USING (snapshot_id, table_name) LEFT JOIN bodies b USING (snapshot_id, table_name))"""
    lit = "'" + head.replace("'", "''") + "'"
    return f"{codegen_ctes()}, {extra} SELECT snapshot_id, 'models.py' AS file, {lit} || string_agg(code, chr(10) || chr(10) || chr(10) ORDER BY table_name) || chr(10) AS content FROM models GROUP BY snapshot_id"


def rust_files_sql() -> str:
    kind = f"CASE WHEN c.type.is_array THEN 'Vec<' || {_mapped(RUST, 'String')} || '>' ELSE {_mapped(RUST, 'String')} END"
    rows = f"""pk1 AS (SELECT k.snapshot_id, k.table_name, unnest(k.columns) AS name, len(k.columns) = 1 AND (c.identity IS NOT NULL OR coalesce(contains(lower(c.default_expr), 'nextval('), false)) AS is_auto FROM constraints k LEFT JOIN columns c ON c.snapshot_id = k.snapshot_id AND c.table_name = k.table_name AND c.name = k.columns[1] WHERE k.kind = 'PRIMARY KEY'),
 rl AS (SELECT c.snapshot_id, c.table_name, c.position, CASE WHEN p.is_auto THEN '    #[sea_orm(primary_key)]' || chr(10) WHEN NOT p.is_auto THEN '    #[sea_orm(primary_key, auto_increment = false)]' || chr(10) ELSE '' END || '    pub ' || c.name || ': ' || CASE WHEN c.is_nullable THEN 'Option<' || {kind} || '>' ELSE {kind} END || ',' AS line FROM columns c LEFT JOIN pk1 p ON p.snapshot_id = c.snapshot_id AND p.table_name = c.table_name AND p.name = c.name),
 rb AS (SELECT snapshot_id, table_name, string_agg(line, chr(10) ORDER BY position) AS body FROM rl GROUP BY ALL)"""
    nl = "chr(10)"
    code = f"'use sea_orm::entity::prelude::*;' || {nl} || {nl} || '#[derive(Clone, Debug, PartialEq, DeriveEntityModel)]' || {nl} || '#[sea_orm(table_name = \"' || t.table_name || '\")]' || {nl} || 'pub struct Model {{' || {nl} || coalesce(b.body, '') || {nl} || '}}' || {nl} || {nl} || '#[derive(Copy, Clone, Debug, EnumIter, DeriveRelation)]' || {nl} || 'pub enum Relation {{}}' || {nl} || {nl} || 'impl ActiveModelBehavior for ActiveModel {{}}' || {nl}".replace("{{",
            "{").replace("}}", "}")
    return f"{diff_ctes()}, {rows} SELECT t.snapshot_id, t.table_name || '.rs' AS file, {code} AS content FROM tables t LEFT JOIN rb b USING (snapshot_id, table_name) UNION ALL SELECT snapshot_id, 'mod.rs', string_agg('pub mod ' || table_name || ';', chr(10) ORDER BY table_name) || chr(10) FROM tables GROUP BY snapshot_id"
