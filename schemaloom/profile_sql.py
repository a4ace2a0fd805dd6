"""Snapshots of the given tables in DuckDB SQL: the rules of sources/profile.py, written down a second time."""

from __future__ import annotations

from functools import lru_cache

_K = "TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

#: feed, table, snapshots (a list), table's name, columns (name, kind, expression), marked column.
_CUTS: list[tuple[str, str, str, str, list[tuple[str, str, str]], str | None]] = [
    (
        "events",
        "events",
        "['events/' || strftime(ts, '%Y-%m-%d')]",
        "event_type",
        [("event_id", "int", "event_id"), ("user_id", "int", "user_id"), ("value", "num", "value"), ("hour", "slot", "date_part('hour', ts)"), ("decade", "label", f"'k' || {_K} // 10")]
        + [(f"k{d}", "int", f"CASE WHEN {_K} // 10 = {d} THEN {_K} END") for d in range(10)],
        "user_id",
    ),
    (
        "documents",
        "documents",
        "['documents/' || lang]",
        "source",
        [("doc_id", "int", "doc_id"), ("text", "text", "text"), ("n_chars", "int", "n_chars"), ("size", "label", "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END")],
        "n_chars",
    ),
    (
        "conversations",
        "conversations",
        "['conversations/' || turn]",
        "role",
        [("conv_id", "int", "conv_id"), ("text", "text", "text"), ("n_chars", "int", "length(text)"), ("size", "label", "CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END")],
        "n_chars",
    ),
    (
        "orders",
        "orders",
        "['orders/' || year(o_orderdate)]",
        "'status_' || lower(o_orderstatus)",
        [("o_orderkey", "int", "o_orderkey"), ("o_custkey", "int", "o_custkey"), ("o_totalprice", "num", "o_totalprice"), ("o_orderpriority", "label", "o_orderpriority"), ("month", "int", "month(o_orderdate)")],
        "o_custkey",
    ),
]

#: Whole tables: columns by kind, in the tables' own order.
_WHOLE = {
    "region": "r_regionkey int, r_name text",
    "nation": "n_nationkey int, n_name text, n_regionkey int",
    "customer": "c_custkey int, c_name text, c_nationkey int, c_acctbal num, c_mktsegment label",
    "supplier": "s_suppkey int, s_name text, s_nationkey int, s_acctbal num",
    "part": "p_partkey int, p_name text, p_brand text, p_type label, p_size int, p_retailprice num",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus label, o_totalprice num, o_orderdate time, o_orderpriority label",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity num, l_extendedprice num, l_discount num, l_tax num, l_returnflag label, l_linestatus label, l_shipdate time",
    "events": "event_id int, ts time, user_id int, event_type label, value num, props text",
    "documents": "doc_id int, text text, lang label, source text, n_chars int",
    "embeddings": "vec_id int, embedding raw, label int",
    "pages": "page_id int, url text, html text",
    "benchmark": "item_id int, text text",
    "labels": "doc_id int, quality int, toxic int",
    "conversations": "conv_id int, turn int, role label, text text",
}


def _cells(feed: str, table: str, snapshots: str, name: str, columns: list[tuple[str, str, str]], marked: str | None) -> str:
    row = []
    for k, (c, kind, e) in enumerate(columns):
        v = f"md5({e})" if kind == "text" else f"CASE WHEN {e} IS NOT NULL THEN '*' END" if kind == "raw" else f"({e})::VARCHAR"
        i = f"({e})::BIGINT" if kind in ("int", "slot") else "NULL::BIGINT"
        x = f"({e})::DOUBLE" if kind == "num" else "NULL::DOUBLE"
        size, plain = (f"length({e})::INT", f"strlen({e}) = length({e})") if kind == "text" else ("NULL::INT", "NULL::BOOLEAN")
        row.append(f"{{'name': '{c}', 'position': {k + 1}, 'kind': '{kind}', 'marked': {str(c == marked).lower()}, 'v': {v}, 'i': {i}, 'x': {x}, 'size': {size}, 'ascii': {plain}}}")
    return (
        f"SELECT '{feed}' AS feed, coalesce(snapshot, '{feed}/none') AS snapshot_id, coalesce(tab, 'none') AS table_name, unnest(cs) AS c "
        f"FROM (SELECT unnest({snapshots}) AS snapshot, {name} AS tab, [{', '.join(row)}] AS cs FROM {table})"
    )


_RULES = """
counted AS MATERIALIZED (SELECT feed, snapshot_id, table_name, c.name AS name, c.position AS position, c.kind AS kind, c.marked AS marked, c.v AS v, count(*) AS n, max(c.i) AS i, max(c.x) AS x, max(c.size) AS size, bool_and(c.ascii) AS ascii FROM cells GROUP BY ALL),
every AS MATERIALIZED (SELECT *, d = n_rows AND kind IN ('int', 'slot', 'text') AS uniq FROM (
 SELECT feed, snapshot_id, table_name, name, position, kind, marked, sum(n) AS n_rows, coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS held, count(v) AS d, min(i) AS low, max(i) AS high,
 min(x) AS least, max(x) AS most, max(size) AS size, bool_and(ascii) AS ascii, first(v ORDER BY n DESC, i) FILTER (WHERE v IS NOT NULL) AS mode, max(n) FILTER (WHERE v IS NOT NULL) AS mode_n
 FROM counted GROUP BY feed, snapshot_id, table_name, name, position, kind, marked)),
labelled AS MATERIALIZED (SELECT e.snapshot_id, e.table_name, e.name, list(c.v ORDER BY c.n DESC, c.v) AS labels FROM counted c JOIN every e USING (snapshot_id, table_name, name) WHERE c.kind = 'label' AND c.v IS NOT NULL AND 10 * e.held >= e.n_rows AND 12 * c.n >= e.held GROUP BY ALL),
fits AS MATERIALIZED (SELECT *, table_name || '_' || name AS key, CASE WHEN kind IN ('int', 'slot') THEN CASE WHEN low >= -32768 AND high <= 32767 THEN 'smallint' WHEN low >= -2147483648 AND high <= 2147483647 THEN 'integer' ELSE 'bigint' END
 WHEN kind = 'num' THEN 'numeric(' || (length(floor(most)::BIGINT::VARCHAR) + 2) || ',2)' WHEN kind = 'label' THEN table_name || '_' || name WHEN kind = 'time' THEN 'timestamp without time zone' WHEN kind = 'raw' THEN 'real[]'
 WHEN size <= 10 THEN 'character varying(10)' WHEN size <= 100 THEN 'character varying(100)' WHEN size <= 1000 THEN 'character varying(1000)' ELSE 'text' END AS formatted FROM every WHERE 10 * held >= n_rows),
slices AS (SELECT *, sum(n_rows) OVER w AS total, count(*) OVER w AS tables_n, first(table_name) OVER (PARTITION BY snapshot_id ORDER BY n_rows DESC, table_name) AS largest FROM every WHERE position = 1 WINDOW w AS (PARTITION BY snapshot_id)),
keyed AS (SELECT *, coalesce(position = min(CASE WHEN held = n_rows THEN position END) OVER (PARTITION BY snapshot_id, table_name), false) AS prim FROM fits WHERE uniq AND kind <> 'slot'),
holders AS MATERIALIZED (SELECT DISTINCT snapshot_id, kind, v, table_name, name FROM counted WHERE feed = 'tables' AND v IS NOT NULL AND kind IN ('int', 'text')),
sets AS MATERIALIZED (SELECT snapshot_id, kind, cols, count(*) AS n FROM (SELECT snapshot_id, kind, v, list({'t': table_name, 'c': name} ORDER BY table_name, name) AS cols FROM holders GROUP BY ALL) GROUP BY ALL),
met AS (SELECT snapshot_id, n, cols, unnest(cols) AS a FROM sets), met2 AS (SELECT snapshot_id, n, a, unnest(cols) AS b FROM met),
common AS (SELECT snapshot_id, a.t AS table_name, a.c AS name, b.t AS ref_table, b.c AS ref_name, sum(n) AS common FROM met2 WHERE a.t <> b.t GROUP BY ALL),
refs AS MATERIALIZED (SELECT x.snapshot_id, x.table_name, x.name, first({'t': x.ref_table, 'c': x.ref_name} ORDER BY p.d, x.ref_table, x.ref_name) AS r FROM common x JOIN fits c ON c.snapshot_id = x.snapshot_id AND c.table_name = x.table_name AND c.name = x.name AND c.feed = 'tables' AND NOT c.uniq AND c.d = x.common
 JOIN fits p ON p.snapshot_id = x.snapshot_id AND p.table_name = x.ref_table AND p.name = x.ref_name AND p.feed = 'tables' AND p.uniq AND p.held = p.n_rows GROUP BY ALL),
fleet AS (SELECT DISTINCT feed, snapshot_id FROM every),
pairs AS MATERIALIZED (SELECT source_id || '..' || target_id AS pair_id, source_id, target_id FROM (SELECT coalesce(lag(snapshot_id) OVER (PARTITION BY feed ORDER BY snapshot_id), '') AS source_id, snapshot_id AS target_id FROM fleet
 UNION ALL SELECT max(snapshot_id), '' FROM fleet GROUP BY feed))"""

_NO = "NULL::VARCHAR"
_FLAT = "NULL::VARCHAR[]"
_ELEMENTS = "NULL::STRUCT(expression VARCHAR, operator VARCHAR)[]"


def _constraint(name: str, kind: str, rows: str, columns: str = "[name]", **given: str) -> str:
    g = given.get
    return (
        f"SELECT snapshot_id, table_name, {name} AS name, '{kind}' AS kind, {columns} AS columns, {g('ref_schema', _NO)} AS ref_schema, {g('ref_table', _NO)} AS ref_table, {g('ref_columns', _FLAT)} AS ref_columns, "
        f"{g('on_delete', _NO)} AS on_delete, {g('on_update', _NO)} AS on_update, false AS is_deferrable, false AS is_initially_deferred, {g('expression', _NO)} AS expression, false AS is_no_inherit, false AS nulls_not_distinct, "
        f"{g('elements', _ELEMENTS)} AS elements, {g('index_method', _NO)} AS index_method, {_NO} AS predicate, {_NO} AS comment FROM {rows}"
    )


def _index(name: str, method: str, unique: str, predicate: str, rows: str) -> str:
    return (
        f"SELECT snapshot_id, table_name, {name} AS name, {method} AS method, {unique} AS is_unique, {unique} AS is_constraint_index, "
        f"[{{'column': name, 'expression': {_NO}, 'sort': 'asc', 'nulls': 'last'}}] AS columns, {predicate} AS predicate, {_NO} AS comment FROM {rows}"
    )


RELATIONS = {
    "namespaces": "SELECT snapshot_id, 'public' AS schema, CASE WHEN max(tables_n) > 3 THEN 'wide' END AS comment FROM slices GROUP BY snapshot_id",
    "tables": "SELECT snapshot_id, table_name, CASE WHEN n_rows * tables_n > total THEN 'partitioned' ELSE 'regular' END AS kind, CASE WHEN table_name = largest THEN 'largest' END AS comment FROM slices",
    "columns": """SELECT snapshot_id, table_name, name, position::INT AS position, {'name': CASE formatted WHEN 'smallint' THEN 'int2' WHEN 'integer' THEN 'int4' WHEN 'bigint' THEN 'int8' WHEN 'text' THEN 'text'
 ELSE CASE kind WHEN 'num' THEN 'numeric' WHEN 'label' THEN key WHEN 'time' THEN 'timestamp' WHEN 'raw' THEN '_float4' ELSE 'varchar' END END, 'schema': CASE WHEN kind = 'label' THEN 'public' ELSE 'pg_catalog' END,
 'formatted': formatted, 'is_array': kind = 'raw'} AS type, held < n_rows AS is_nullable, CASE WHEN kind = 'num' AND least < 1 THEN '0' WHEN kind = 'label' THEN '''' || labels[1] || '''' END AS default_expr,
 NULL::STRUCT(expression VARCHAR, storage VARCHAR) AS generated, CASE WHEN uniq AND kind = 'int' AND held = n_rows AND high - low + 1 = n_rows THEN 'ALWAYS' END AS identity, CASE WHEN ascii THEN 'C' ELSE 'default' END AS collation,
 CASE WHEN d = 1 AND kind IN ('int', 'slot', 'num', 'label') THEN 'constant' END AS comment FROM fits LEFT JOIN labelled USING (snapshot_id, table_name, name)""",
    "constraints": " UNION ALL ".join(
        [
            _constraint("table_name || '_pkey'", "PRIMARY KEY", "keyed WHERE prim"),
            _constraint("key || '_key'", "UNIQUE", "keyed WHERE NOT prim"),
            _constraint("key || '_check'", "CHECK", "fits WHERE kind = 'num' OR (kind = 'int' AND NOT uniq)", _FLAT, expression="CASE WHEN kind = 'num' THEN name || ' >= ' || floor(least)::BIGINT ELSE name || ' <= ' || high END"),
            _constraint("key || '_excl'", "EXCLUDE", "fits WHERE uniq AND kind = 'slot'", _FLAT, elements="[{'expression': name, 'operator': '='}]", index_method="'btree'"),
            _constraint(
                "key || '_fkey'", "FOREIGN KEY", "refs JOIN fits USING (snapshot_id, table_name, name)", ref_schema="'public'", ref_table="r.t", ref_columns="[r.c]",
                on_delete="CASE WHEN held < n_rows THEN 'SET NULL' ELSE 'NO ACTION' END", on_update="'NO ACTION'",
            ),
        ]
    ),
    "indexes": " UNION ALL ".join(
        [
            _index("key || '_key'", "'btree'", "true", _NO, "keyed WHERE NOT prim"),
            _index("key || '_idx'", "CASE WHEN 4 * d >= 3 * held THEN 'hash' ELSE 'btree' END", "false", "CASE WHEN held < n_rows THEN name || ' IS NOT NULL' END", "fits WHERE kind IN ('int', 'slot') AND NOT uniq AND 2 * d > held"),
        ]
    ),
    "views": f"SELECT snapshot_id, key || '_' || mode AS name, 'SELECT * FROM ' || table_name || ' WHERE ' || name || ' = ' || mode AS definition, 20 * mode_n > n_rows AS is_materialized, {_NO} AS comment FROM fits WHERE marked AND mode IS NOT NULL",
    "sequences": f"SELECT snapshot_id, key || '_seq' AS name, formatted AS data_type, low AS start_value, 1::BIGINT AS increment, low AS min_value, high AS max_value, 1::BIGINT AS cache_size, false AS is_cyclic, {_NO} AS comment FROM fits WHERE marked AND mode IS NOT NULL",
    "enums": f"SELECT snapshot_id, table_name || '_' || name AS name, labels, {_NO} AS comment FROM labelled",
}


@lru_cache(maxsize=1)
def base() -> str:
    """CTEs up to ``pairs``, without WITH."""
    cuts = list(_CUTS)
    for table, listed in _WHOLE.items():
        columns = [tuple(c.rsplit(" ", 1)) for c in listed.split(", ")]
        even = f"{columns[0][0]} % 2 = 0"
        cuts.append(("tables", table, f"CASE WHEN {even} THEN ['tables', 'tables/even'] ELSE ['tables'] END", f"'{table}'", [(c, k, c) for c, k in columns], None))
    return "cells AS MATERIALIZED (" + " UNION ALL ".join(_cells(*c) for c in cuts) + ")," + _RULES


def ctes(*names: str, alone: bool = False) -> str:
    """WITH clause of relations, each also joined to its pairs as src_NAME and tgt_NAME; alone: every snapshot against nothing instead."""
    parts = [base()]
    if alone:
        parts[0] = parts[0].replace("pairs AS MATERIALIZED (", "neighbours AS (") + ",\npairs AS (SELECT snapshot_id AS pair_id, '' AS source_id, snapshot_id AS target_id FROM (SELECT DISTINCT snapshot_id FROM every))"
    for n in names:
        parts.append(f"{n} AS MATERIALIZED ({RELATIONS[n]})")
        parts.append(f"src_{n} AS MATERIALIZED (SELECT p.pair_id, x.* FROM {n} x JOIN pairs p ON x.snapshot_id = p.source_id)")
        parts.append(f"tgt_{n} AS MATERIALIZED (SELECT p.pair_id, x.* FROM {n} x JOIN pairs p ON x.snapshot_id = p.target_id)")
    return "WITH RECURSIVE " + ",\n".join(parts)
