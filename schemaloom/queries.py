"""Registered queries and their DuckDB SQL, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle, oracle_plan, profile_sql
from .functions import naming, similarity, sqltext, typemap
from .model import Catalog
from .operators import breaking, discover, graph, history, merkle, probes, relations
from .operators.diff import Diff, DiffConfig
from .plans import codegen, operations, replay, worklist
from .registry import ORACLE_SQL, QUERIES, query
from .sources import footers
from .sources.catalogs import from_parquet_dir
from .sources.profile import Profile
from .tables import kept

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


#: Profiles and diffs of this session, by application, folder and what was asked for: queries share them.
_MADE: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: object, make):
    """Made once an application; what it keeps are written tables, and they last as long."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def forget() -> None:
    """Drop all that is shared but the profiles themselves: what is asked for next is made anew (for measurements)."""
    for key in [k for k in _MADE if k[2] not in ("profile", "catalog", "pairs")]:
        del _MADE[key]


def profile(spark: SparkSession, sf_dir: str) -> Profile:
    """The given tables, cut into snapshots."""
    return _once(spark, sf_dir, "profile", lambda: Profile(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return _once(spark, sf_dir, "catalog", lambda: profile(spark, sf_dir).catalog())


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "pairs", lambda: profile(spark, sf_dir).pairs())


def diff(spark: SparkSession, sf_dir: str, config: DiffConfig = DiffConfig()) -> Diff:  # noqa: B008
    """Every snapshot against the next of its feed."""
    return _once(spark, sf_dir, config, lambda: Diff(catalog(spark, sf_dir), pairs(spark, sf_dir), config))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered operations of every pair."""
    return _once(spark, sf_dir, "plan", lambda: kept(operations.plan(diff(spark, sf_dir))))


def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "breaks", lambda: kept(breaking.analyse(diff(spark, sf_dir))))


_R = "round(similarity, 9) AS similarity"


def _rounded():
    return F.round("similarity", 9).alias("similarity")


# ---- sources ----------------------------------------------------------------------

_IN = ", ".join(f"'{t}'" for t in TABLES)
_CASE = "CASE data_type WHEN 'INTEGER' THEN 'integer' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double precision' WHEN 'VARCHAR' THEN 'text' WHEN 'FLOAT[]' THEN 'real[]' WHEN 'TIMESTAMP' THEN 'timestamp without time zone' WHEN 'TIMESTAMP_NS' THEN 'timestamp without time zone' ELSE data_type END"


@query(f"SELECT table_name, count(*)::BIGINT AS n_columns FROM information_schema.columns WHERE table_name IN ({_IN}) GROUP BY table_name")
def introspect_tables(spark, sf_dir):
    c = from_parquet_dir(spark, sf_dir, TABLES, "s")
    return c.tables.join(c.columns, "table_name").groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))


@query(f"SELECT table_name, column_name AS name, ordinal_position::INT AS position, {_CASE} AS formatted FROM information_schema.columns WHERE table_name IN ({_IN})")
def introspect_columns(spark, sf_dir):
    return from_parquet_dir(spark, sf_dir, TABLES, "s").columns.select("table_name", "name", "position", F.col("type.formatted").alias("formatted"))


#: Columns of the given tables that may be part of a key, and those that are numbers.
_FLAT = {
    "region": "r_regionkey# r_name", "nation": "n_nationkey# n_name n_regionkey#", "customer": "c_custkey# c_name c_nationkey# c_acctbal# c_mktsegment", "supplier": "s_suppkey# s_name s_nationkey# s_acctbal#",
    "part": "p_partkey# p_name p_brand p_type p_size# p_retailprice#", "orders": "o_orderkey# o_custkey# o_orderstatus o_totalprice# o_orderdate o_orderpriority",
    "lineitem": "l_orderkey# l_partkey# l_suppkey# l_linenumber# l_quantity# l_extendedprice# l_discount# l_tax# l_returnflag l_linestatus l_shipdate",
    "events": "event_id# ts user_id# event_type value# props", "documents": "doc_id# text lang source n_chars#", "embeddings": "vec_id# label#", "pages": "page_id# url html",
    "benchmark": "item_id# text", "labels": "doc_id# quality# toxic#", "conversations": "conv_id# turn# role text",
}


def _keys_sql() -> str:
    """Singles and pairs of columns without nulls and repeats; pairs only where neither is a key alone."""
    from itertools import combinations

    out = []
    for table, listed in _FLAT.items():
        names = listed.replace("#", "").split()
        yes = lambda *c: f"(count(*) > 0 AND {' AND '.join(f'count({x}) = count(*)' for x in c)} AND count(DISTINCT ({', '.join(c)})) = count(*))"
        checks = [f"{yes(a)} AS k{i}" for i, a in enumerate(names)] + [f"{yes(names[i], names[j])} AS p{i}_{j}" for i, j in combinations(range(len(names)), 2)]
        found = [f"CASE WHEN k{i} THEN ['{a}'] END" for i, a in enumerate(names)] + [f"CASE WHEN p{i}_{j} AND NOT k{i} AND NOT k{j} THEN ['{names[i]}', '{names[j]}'] END" for i, j in combinations(range(len(names)), 2)]
        out.append(f"SELECT '{table}' AS table_name, unnest([{', '.join(found)}]) AS columns, n AS n_rows FROM (SELECT count(*) AS n, {', '.join(checks)} FROM {table})")
    return "SELECT * FROM (" + " UNION ALL ".join(out) + ") WHERE columns IS NOT NULL"


@query(_keys_sql)
def discover_keys(spark, sf_dir):
    """The minimal keys of one or two columns that the given tables have."""
    rows = []
    for t in TABLES:
        n, found = discover.keys(spark.read.parquet(f"{sf_dir}/{t}.parquet"), most=2)
        rows += [(t, list(k), n) for k in found]
    return spark.createDataFrame(rows, "table_name string, columns array<string>, n_rows long")


@query(lambda: "WITH " + profile_sql.base() + " SELECT x.snapshot_id, x.table_name, x.name, c.d, c.uniq AS is_unique, x.ref_table, x.ref_name, p.d AS ref_d FROM common x JOIN fits c ON c.snapshot_id = x.snapshot_id AND c.table_name = x.table_name AND c.name = x.name AND c.feed = 'tables' AND c.d = x.common JOIN fits p ON p.snapshot_id = x.snapshot_id AND p.table_name = x.ref_table AND p.name = x.ref_name AND p.feed = 'tables' AND p.uniq AND p.held = p.n_rows")
def discover_foreign_keys(spark, sf_dir):
    """Every column of the given tables (and of their even rows) whose values all are in a unique column of another table."""
    return profile(spark, sf_dir).inclusions()


def _footers_sql() -> str:
    out = []
    for table, listed in _FLAT.items():
        for c in [*listed.split(), *(["embedding"] if table == "embeddings" else [])]:
            name, number = c.rstrip("#"), c.endswith("#")
            low, high = (f"min({name})::DOUBLE", f"max({name})::DOUBLE") if number else ("NULL::DOUBLE", "NULL::DOUBLE")
            out.append(f"SELECT '{table}' AS table_name, '{name}' AS name, count(*) AS n_rows, count(*) - count({name}) AS n_nulls, count(*) > count({name}) AS is_nullable, {low} AS low, {high} AS high FROM {table}")
    return " UNION ALL ".join(out)


@query(_footers_sql)
def catalog_from_footers(spark, sf_dir):
    """Nulls and ranges of every column of the given tables, without a scan where the files' footers tell."""
    out = None
    for t in TABLES:
        one = footers.columns_of(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "name", "n_rows", "n_nulls", (F.col("n_nulls") > 0).alias("is_nullable"), "low", "high")
        out = one if out is None else out.unionByName(one)
    return out


@query(lambda: profile_sql.ctes("namespaces", "tables", "views", "enums",
        "sequences") + " SELECT n.snapshot_id, (SELECT count(*) FROM tables t WHERE t.snapshot_id = n.snapshot_id) AS n_tables, (SELECT count(*) FROM views t WHERE t.snapshot_id = n.snapshot_id) AS n_views, (SELECT count(*) FROM enums t WHERE t.snapshot_id = n.snapshot_id) AS n_enums, (SELECT count(*) FROM sequences t WHERE t.snapshot_id = n.snapshot_id) AS n_sequences FROM namespaces n")
def schema_summary(spark, sf_dir):
    c = catalog(spark, sf_dir)
    out = c.namespaces.select("snapshot_id")
    for r in ("tables", "views", "enums", "sequences"):
        n = getattr(c, r).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias(f"n_{r}"))
        out = out.join(n, "snapshot_id", "left").withColumn(f"n_{r}", F.coalesce(f"n_{r}", F.lit(0)))
    return out


def _case_of(table: dict[str, str], column: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def _type_sql(table: dict[str, str], default: str, left: str, right: str) -> str:
    one = _case_of(table, "regexp_replace(type.name, '^_', '')", default)
    return profile_sql.ctes("columns") + f" SELECT DISTINCT type.formatted AS formatted, CASE WHEN type.is_array THEN '{left}' || {one} || '{right}' ELSE {one} END AS mapped FROM columns"


@query(lambda: _type_sql(oracle.PYTHON, "Any", "list[", "]"))
def type_map_python(spark, sf_dir):
    return catalog(spark, sf_dir).columns.select(F.col("type.formatted").alias("formatted"), typemap.python_type(F.col("type")).alias("mapped")).distinct()


@query(lambda: _type_sql(oracle.RUST, "String", "Vec<", ">"))
def type_map_rust(spark, sf_dir):
    return catalog(spark, sf_dir).columns.select(F.col("type.formatted").alias("formatted"), typemap.rust_type(F.col("type")).alias("mapped")).distinct()


@query(
    lambda: profile_sql.ctes("columns")
    + r""" SELECT DISTINCT formatted, CASE WHEN starts_with(formatted, 'char') THEN TRY_CAST(regexp_extract(formatted, '\((\d+)\)$', 1) AS INT) END AS length,
 CASE WHEN starts_with(formatted, 'numeric(') THEN string_split(args, ',')[1]::INT END AS precision, CASE WHEN starts_with(formatted, 'numeric(') THEN coalesce(string_split(args, ',')[2]::INT, 0) END AS scale
 FROM (SELECT type.formatted AS formatted, regexp_extract(type.formatted, '\((.*)\)', 1) AS args FROM columns)"""
)
def type_arguments(spark, sf_dir):
    df = catalog(spark, sf_dir).columns.select(F.col("type.formatted").alias("formatted")).distinct()
    p = typemap.numeric_precision(F.col("formatted"))
    return df.select("formatted", typemap.string_length(F.col("formatted")).alias("length"), p["precision"].alias("precision"), p["scale"].alias("scale"))


# ---- diff -------------------------------------------------------------------------


def _objects(kind: str):
    @query(lambda: oracle.objects_sql(f"kind = '{kind}'"))
    def f(spark, sf_dir):
        return diff(spark, sf_dir).objects(kind).withColumn("similarity", F.round("similarity", 9))

    name = {"index": "diff_indexes"}.get(kind, f"diff_{kind}s")
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")
    f.__name__ = name


for _kind in ("table", "column", "constraint", "index", "view", "sequence", "enum"):
    _objects(_kind)


@query(lambda: oracle.field_sql("column"))
def diff_column_fields(spark, sf_dir):
    return diff(spark, sf_dir).fields("column").select("pair_id", "kind", "table_name", "name", "field")


@query(lambda: oracle.field_sql("sequence"))
def diff_sequence_fields(spark, sf_dir):
    return diff(spark, sf_dir).fields("sequence").select("pair_id", "kind", "table_name", "name", "field")


@query(lambda: oracle.diff_ctes() + " SELECT s.pair_id, s.name, list_filter(t.labels, lambda v: NOT list_contains(s.labels, v)) AS values_added, list_filter(s.labels, lambda v: NOT list_contains(t.labels, v)) AS values_removed, list_filter(s.labels, lambda v: list_contains(t.labels, v)) <> list_filter(t.labels, lambda v: list_contains(s.labels, v)) AS reordered FROM src_enum s JOIN tgt_enum t USING (pair_id, name) WHERE s.labels <> t.labels")
def diff_enum_values(spark, sf_dir):
    return diff(spark, sf_dir).enum_changes()


_SUM = ", ".join(f"count(*) FILTER (WHERE change = '{c}') AS {c}" for c in ("added", "removed", "modified", "renamed"))


@query(lambda: oracle.diff_ctes() + f" SELECT pair_id, kind, {_SUM} FROM objects GROUP BY pair_id, kind")
def diff_summary(spark, sf_dir):
    return diff(spark, sf_dir).summary()


@query(lambda: oracle.diff_ctes() + ", n AS (SELECT pair_id, count(*) AS n FROM objects WHERE kind NOT IN ('column', 'constraint', 'index') GROUP BY pair_id) SELECT p.pair_id, coalesce(n.n, 0) AS n_changes, n.n IS NULL AS is_empty FROM pairs p LEFT JOIN n USING (pair_id)")
def diff_change_count(spark, sf_dir):
    return diff(spark, sf_dir).change_count()


@query(lambda: oracle.diff_ctes() + " SELECT pair_id, kind, change, list(x ORDER BY x) AS names FROM (SELECT pair_id, kind, change, coalesce(table_name || '.', '') || name || CASE WHEN change = 'renamed' THEN ' -> ' || to_name ELSE '' END AS x FROM objects) GROUP BY ALL")
def drift_details(spark, sf_dir):
    return diff(spark, sf_dir).drift()


# ---- similarity and renames -----------------------------------------------------------


def _sims(kind: str):
    @query(lambda: oracle.diff_ctes() + f" SELECT pair_id, table_name, from_name, to_name, {_R} FROM sims WHERE kind = '{kind}'")
    def f(spark, sf_dir):
        return diff(spark, sf_dir).similarities().filter(F.col("kind") == kind).select("pair_id", "table_name", "from_name", "to_name", _rounded())

    name = f"sim_{kind}" + ("_basic" if kind in ("table", "column") else "")
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


for _kind in ("table", "column", "constraint", "index", "view", "sequence", "enum"):
    _sims(_kind)

#: The host of every page beside that of the next one.
_HOSTS = "(SELECT x.h AS a, y.h AS b FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) x JOIN (SELECT page_id - 1 AS page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages) y USING (page_id))"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return pages.select("page_id", host.alias("a")).join(pages.select((F.col("page_id") - 1).alias("page_id"), host.alias("b")), "page_id").select("a", "b")


@query(f"SELECT a, b, levenshtein(a, b)::INT AS distance FROM {_HOSTS}")
def sim_levenshtein(spark, sf_dir):
    return _hosts(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").alias("distance"))


_PRE = "len(list_filter(range(1, least(length({x}), length({y})) + 1), lambda i: left({x}, i::INT) = left({y}, i::INT)))"
_NAME_SQL = f"""WITH p AS (SELECT a, b, lower(a) AS x, lower(b) AS y FROM {_HOSTS}),
q AS (SELECT *, {_PRE.format(x="x", y="y")} AS pre, {_PRE.format(x="reverse(x)", y="reverse(y)")} AS suf, least(strlen(x), strlen(y)) AS lo, greatest(strlen(x), strlen(y)) AS hi, list_distinct(regexp_split_to_array(x, '[_-]')) AS wx, list_distinct(regexp_split_to_array(y, '[_-]')) AS wy FROM p),
r AS (SELECT *, least(1.0, (CASE WHEN pre >= 3 THEN 0.3 * (pre::DOUBLE / lo) ELSE 0 END) + (CASE WHEN suf >= 3 THEN 0.3 * (suf::DOUBLE / lo) ELSE 0 END) + (CASE WHEN contains(x, y) OR contains(y, x) THEN 0.4 * (lo::DOUBLE / hi) ELSE 0 END) + 0.3 * (len(list_intersect(wx, wy))::DOUBLE / len(list_distinct(list_concat(wx, wy))))) AS bonus FROM q)
SELECT a, b, round(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE least(1.0, (1.0 - levenshtein(x, y)::DOUBLE / hi) * 0.7 + bonus * 0.3) END, 9)::DOUBLE AS similarity FROM r"""


@query(_NAME_SQL)
def sim_name(spark, sf_dir):
    return _hosts(spark, sf_dir).select("a", "b", F.round(similarity.name_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(oracle_plan.table_advanced_sql)
def sim_table_advanced(spark, sf_dir):
    return diff(spark, sf_dir, DiffConfig.with_advanced_similarity()).similarities().filter("kind = 'table'").select("pair_id", "from_name", "to_name", _rounded())


@query(oracle_plan.column_advanced_sql)
def sim_column_advanced(spark, sf_dir):
    return diff(spark, sf_dir, DiffConfig.with_advanced_similarity()).similarities().filter("kind = 'column'").select("pair_id", "table_name", "from_name", "to_name", _rounded())


@query(lambda: oracle.diff_ctes() + f" SELECT pair_id, kind, table_name, from_name, to_name, {_R} FROM cand")
def rename_candidates(spark, sf_dir):
    return diff(spark, sf_dir).candidates().withColumn("similarity", F.round("similarity", 9))


@query(lambda: oracle.diff_ctes() + f" SELECT pair_id, kind, table_name, from_name, to_name, {_R} FROM renames")
def rename_greedy(spark, sf_dir):
    return diff(spark, sf_dir).renames().withColumn("similarity", F.round("similarity", 9))


# ---- breaking changes ---------------------------------------------------------------


@query(lambda: oracle.breaking_sql("SELECT * FROM breaking"))
def breaking_changes(spark, sf_dir):
    return breaks(spark, sf_dir)


@query(lambda: oracle.breaking_sql("SELECT pair_id, mitigation, count(*) AS n FROM breaking GROUP BY ALL"))
def breaking_by_mitigation(spark, sf_dir):
    return breaking.by_mitigation(breaks(spark, sf_dir))


@query(lambda: oracle.breaking_sql("SELECT p.pair_id, count(b.pair_id) AS n_breaking, count(b.pair_id) = 0 AS is_safe FROM pairs p LEFT JOIN breaking b USING (pair_id) GROUP BY p.pair_id"))
def breaking_safe_pairs(spark, sf_dir):
    d = diff(spark, sf_dir)
    return breaking.is_safe(d.pairs, breaks(spark, sf_dir))


@query(lambda: oracle.objects_sql("change = 'removed' AND kind IN ('table', 'column', 'enum')", "pair_id, kind, table_name, name"))
def breaking_session(spark, sf_dir):
    return breaking.session_breaking(diff(spark, sf_dir))


@query(lambda: oracle.diff_ctes() + f" SELECT DISTINCT s.type.formatted AS from_type, t.type.formatted AS to_type, coalesce({oracle.SAFE}, false) AS safe FROM src_columns s JOIN tgt_columns t USING (pair_id, table_name, name)")
def type_widening_matrix(spark, sf_dir):
    """Every type that a column has and the one it has next: is the change safe?"""
    at, c = ["snapshot_id", "table_name", "name"], catalog(spark, sf_dir).columns
    old = c.select(*at, F.col("type").alias("a")).join(pairs(spark, sf_dir).withColumnRenamed("source_id", "snapshot_id"), "snapshot_id")
    new = c.select(F.col("snapshot_id").alias("target_id"), "table_name", "name", F.col("type").alias("b"))
    a, b = F.col("a"), F.col("b")
    return old.join(new, ["target_id", "table_name", "name"]).select(a["formatted"].alias("from_type"), b["formatted"].alias("to_type"), F.coalesce(breaking.is_safe_widening(a, b), F.lit(False)).alias("safe")).distinct()


# ---- plans ----------------------------------------------------------------------------


@query(lambda: oracle_plan.plan_sql(oracle_plan.ORDERED))
def plan_ordered(spark, sf_dir):
    return plan(spark, sf_dir).select("pair_id", "seq", "op_kind", "phase", "object_kind", "table_name", "name", "to_name", "description")


@query(lambda: oracle_plan.plan_sql(oracle_plan.RENDERED))
def render_sql(spark, sf_dir):
    p = plan(spark, sf_dir)
    return p.select("pair_id", "seq", "op_kind", F.array_join("forward", ";\n").alias("sql"), F.array_join("rollback", ";\n").alias("rollback_sql"))


@query(lambda: oracle_plan.plan_sql(oracle_plan.SCRIPT))
def script_text(spark, sf_dir):
    return operations.script(plan(spark, sf_dir))


@query(lambda: oracle_plan.plan_sql(oracle_plan.INVERSE))
def inverse_plan(spark, sf_dir):
    return operations.inverse(plan(spark, sf_dir))


@query(oracle_plan.affected_sql)
def affected_statements(spark, sf_dir):
    d = diff(spark, sf_dir)
    statements = plan(spark, sf_dir).select("pair_id", "seq", F.array_join("forward", ";\n").alias("sql"))
    return breaking.affected_statements(breaks(spark, sf_dir), statements)


@query(lambda: oracle.diff_ctes() + """, added AS (SELECT pair_id, name FROM objects WHERE kind = 'table' AND change = 'added'),
edges AS (SELECT DISTINCT c.pair_id, c.table_name AS a, c.ref_table AS b FROM tgt_constraints c JOIN added x ON x.pair_id = c.pair_id AND x.name = c.table_name JOIN added y ON y.pair_id = c.pair_id AND y.name = c.ref_table WHERE c.kind = 'FOREIGN KEY' AND c.table_name <> c.ref_table),
walk AS (SELECT pair_id, name, 0 AS depth FROM added UNION ALL SELECT w.pair_id, e.a, w.depth + 1 FROM walk w JOIN edges e ON e.pair_id = w.pair_id AND e.b = w.name WHERE w.depth < 50)
SELECT pair_id, name, max(depth)::INT AS depth FROM walk GROUP BY ALL""")
def fk_depth(spark, sf_dir):
    return operations.table_depth(diff(spark, sf_dir)).select("pair_id", "name", F.col("depth").cast("int").alias("depth"))


@query(
    "SELECT DISTINCT name, CASE WHEN regexp_full_match(name, '[a-z_][a-z0-9_$]*') AND name NOT IN (" + ", ".join(f"'{w}'" for w in oracle.RESERVED) + ") THEN name ELSE '\"' || replace(name, '\"', '\"\"') || '\"' END AS quoted FROM ("
    "SELECT role AS name FROM conversations UNION ALL SELECT p_name FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT source FROM documents UNION ALL SELECT url FROM pages UNION ALL SELECT props FROM events)"
)
def quote_identifiers(spark, sf_dir):
    """Names as they come: roles, products, segments, sources, urls and JSON."""
    names, out = [("conversations", "role"), ("part", "p_name"), ("customer", "c_mktsegment"), ("documents", "source"), ("pages", "url"), ("events", "props")], None
    for table, column in names:
        one = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(column).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out.distinct().select("name", sqltext.quote(F.col("name")).alias("quoted"))


@query(oracle_plan.replayed_sql)
def replay_states(spark, sf_dir):
    """Plans applied to their source: the objects that result (a plan that fails gives one row, its error as the name)."""
    d = diff(spark, sf_dir)
    start = replay.state_of(d.catalog, d.pairs.select(F.col("source_id").alias("snapshot_id"))).join(d.pairs, F.col("snapshot_id") == F.col("source_id")).select("pair_id", "state")
    states = kept(replay.replay(plan(spark, sf_dir), start))
    failed = states.filter("error is not null").select("pair_id", F.lit("error").alias("kind"), F.lit(None).cast("string").alias("table_name"),
            F.col("error").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("is_nullable"))
    return replay.objects(states.filter("error is null"), "pair_id").unionByName(failed)


# ---- histories: every user's events are one ------------------------------------------------

_CHAIN = """WITH e AS (SELECT user_id AS history_id, row_number() OVER w AS seq, sha256('m' || event_id) AS id, sha256('s' || event_id) AS resulting_hash, event_id, event_type, value,
 lag(sha256('s' || event_id)) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT history_id, seq, id, resulting_hash, CASE WHEN event_id % 97 = 0 THEN sha256('x') ELSE coalesce(prev, repeat('0', 64)) END AS parent_hash, event_id % 10 = 3 AS is_checkpoint, sha256('o' || event_id) AS ops_hash, event_id FROM e)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories from events: a hash for each event's state, parents that lag behind it, some of them wrong."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sha = lambda p: F.sha2(F.concat(F.lit(p), F.col("event_id").cast("string")), 256)
    out = e.select(F.col("user_id").alias("history_id"), F.row_number().over(w).alias("seq"), sha("m").alias("id"), sha("s").alias("resulting_hash"),
            F.coalesce(F.lag(sha("s")).over(w), F.lit(history.ZERO)).alias("prev"), sha("o").alias("ops_hash"), "event_id")
    return out.select("history_id", "seq", "id", "resulting_hash",
            F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("prev")).alias("parent_hash"),
            (F.col("event_id") % 10 == 3).alias("is_checkpoint"), "ops_hash", "event_id")


@query(_CHAIN + ", v AS (SELECT *, coalesce(lag(resulting_hash) OVER (PARTITION BY history_id ORDER BY seq), repeat('0', 64)) AS want FROM h), b AS (SELECT history_id, min(seq) AS s FROM v WHERE want <> parent_hash GROUP BY 1) SELECT x.history_id, b.s IS NULL AS ok, b.s::INT AS broken_seq, v.want AS expected_parent, v.parent_hash AS found_parent FROM (SELECT DISTINCT history_id FROM h) x LEFT JOIN b USING (history_id) LEFT JOIN v ON v.history_id = b.history_id AND v.seq = b.s")
def chain_verify(spark, sf_dir):
    return history.verify_chain(chain(spark, sf_dir))


@query(_CHAIN + ", c AS (SELECT history_id, seq, max(CASE WHEN is_checkpoint THEN seq END) OVER (PARTITION BY history_id ORDER BY seq) AS checkpoint_seq FROM h) SELECT history_id, seq::INT AS seq, checkpoint_seq::INT AS checkpoint_seq, (seq - coalesce(checkpoint_seq, 0))::BIGINT AS n_replayed FROM c")
def nearest_checkpoint(spark, sf_dir):
    return history.nearest_checkpoint(chain(spark, sf_dir))


@query(_CHAIN + " SELECT history_id, arg_max(resulting_hash, seq) AS current_hash, count(*) AS n_migrations, (max(seq) + 1)::INT AS next_seq FROM h GROUP BY history_id")
def history_current(spark, sf_dir):
    return history.current(chain(spark, sf_dir))


@query(_CHAIN + ", k AS (SELECT history_id, resulting_hash AS mark FROM h WHERE seq = 2), s AS (SELECT h.history_id, min(h.seq) AS start FROM h JOIN k USING (history_id) WHERE h.parent_hash = k.mark GROUP BY 1) SELECT h.history_id, h.seq::INT AS seq, h.id FROM h JOIN s USING (history_id) WHERE h.seq >= s.start")
def migrations_since(spark, sf_dir):
    h = chain(spark, sf_dir)
    mark = h.filter("seq = 2").select("history_id", F.col("resulting_hash").alias("mark"))
    return history.since(h.join(mark, "history_id"), F.col("mark")).select("history_id", "seq", "id")


@query(_CHAIN + " SELECT history_id, seq::BIGINT AS seq, id, NULL::VARCHAR AS error FROM h WHERE seq > 3 OR history_id % 5 = 0 OR NOT EXISTS (SELECT 1 FROM h x WHERE x.history_id = h.history_id AND x.seq = 3)")
def pending(spark, sf_dir):
    h = chain(spark, sf_dir)
    return history.pending(h, h.filter("seq = 3 AND history_id % 5 <> 0").select("history_id", "id"))


@query(_CHAIN + " SELECT history_id, id, CASE WHEN event_id % 13 = 0 THEN sha256('t') ELSE ops_hash END AS recorded_hash, ops_hash AS local_hash FROM h WHERE event_id % 13 = 0")
def history_diverged(spark, sf_dir):
    h = chain(spark, sf_dir)
    recorded = h.withColumn("ops_hash", F.when(F.col("event_id") % 13 == 0, F.sha2(F.lit("t"), 256)).otherwise(F.col("ops_hash")))
    return history.diverged(recorded, h)


@query(_CHAIN + ", a AS (SELECT history_id, count(*) AS n_recorded, count(*) FILTER (WHERE event_id % 3 <> 0) AS n_local FROM h GROUP BY 1) SELECT * FROM a WHERE n_recorded > n_local")
def history_behind(spark, sf_dir):
    h = chain(spark, sf_dir)
    return history.behind(h, h.filter("event_id % 3 <> 0"))


@query(_CHAIN + ", n AS (SELECT history_id, seq, id, row_number() OVER (PARTITION BY history_id ORDER BY seq DESC) AS back FROM h) SELECT history_id, seq::INT AS seq, id, seq::INT AS number FROM n WHERE back <= 3")
def history_tail(spark, sf_dir):
    return history.tail(chain(spark, sf_dir), 3).select("history_id", "seq", "id", "number")


@query(_CHAIN + ", g AS (SELECT history_id, count(*) FILTER (WHERE starts_with(id, '3')) AS n, min(CASE WHEN starts_with(id, '3') THEN id END) AS id FROM h GROUP BY 1) SELECT history_id, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS id FROM g")
def history_show(spark, sf_dir):
    return history.show(chain(spark, sf_dir), "3")


def _tree_sql(tail: str) -> str:
    n = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '~')"
    lst = lambda c, e=n("x"): f"coalesce('[' || len({c}) || ':' || array_to_string(list_transform({c}, lambda x: {e}), ''), '~')"
    item = " || ".join(n(f'x."{f}"') for f in ("column", "expression", "sort", "nulls"))
    element = " || ".join(n(f"x.{f}") for f in ("expression", "operator"))
    listed = {
        "enum": ("enums", "NULL::VARCHAR", "''", [lst("labels")]),
        "sequence": ("sequences", "NULL::VARCHAR", "''", [n(c) for c in ("data_type", "start_value", "increment", "min_value", "max_value", "cache_size", "is_cyclic")]),
        "view": ("views", "NULL::VARCHAR", "''", [n("definition"), n("is_materialized")]),
        "column": ("columns", "table_name", "'a' || lpad(position::VARCHAR, 10, '0')", [n(c) for c in ("type.formatted", "is_nullable", "default_expr", "identity", "generated.expression", '"collation"')]),
        "constraint": ("constraints", "table_name", "'b' || name", [n("kind"), lst("columns"), n("ref_schema"), n("ref_table"), lst("ref_columns"), n("expression"), lst("elements", element)]),
        "index": ("indexes", "table_name", "'b' || name", [n("method"), n("is_unique"), n("is_constraint_index"), lst("columns", item), n("predicate")]),
    }
    rows = " UNION ALL ".join(f"SELECT snapshot_id, '{k}' AS kind, {t} AS table_name, name, {place} AS place, sha256('{k}:' || {' || '.join([n('name'), *p])}) AS digest FROM {rel}" for k, (rel, t, place, p) in listed.items())
    return profile_sql.ctes(*oracle.ALL) + f""", leaves AS ({rows}),
members AS (SELECT snapshot_id, table_name, string_agg(digest, '' ORDER BY kind, place, digest) AS below, count(*) AS n FROM leaves WHERE table_name IS NOT NULL GROUP BY ALL),
mid AS (SELECT snapshot_id, kind, NULL::VARCHAR AS table_name, name, digest FROM leaves WHERE table_name IS NULL
 UNION ALL SELECT t.snapshot_id, 'table', NULL, t.table_name, sha256('table:' || {n('t.table_name')} || {n('t.kind')} || {n('coalesce(m.n, 0)')} || coalesce(m.below, '')) FROM tables t LEFT JOIN members m USING (snapshot_id, table_name)),
tops AS (SELECT snapshot_id, string_agg(digest, '' ORDER BY kind, name, digest) AS below, count(*) AS n FROM mid GROUP BY 1),
nodes AS (SELECT x.snapshot_id, 0 AS level, 'snapshot' AS kind, NULL::VARCHAR AS table_name, NULL::VARCHAR AS name, sha256('snapshot:' || {n('coalesce(p.n, 0)')} || coalesce(p.below, '')) AS digest FROM namespaces x LEFT JOIN tops p USING (snapshot_id)
 UNION ALL SELECT snapshot_id, 1, kind, table_name, name, digest FROM mid UNION ALL SELECT snapshot_id, 2, kind, table_name, name, digest FROM leaves WHERE table_name IS NOT NULL) {tail}"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all snapshots."""
    return _once(spark, sf_dir, "tree", lambda: kept(merkle.tree(catalog(spark, sf_dir))))


@query(lambda: _tree_sql("SELECT snapshot_id, digest AS checksum FROM nodes WHERE level = 0"))
def checksum_sha256(spark, sf_dir):
    return history.checksum(catalog(spark, sf_dir))


@query(lambda: _tree_sql("SELECT * FROM nodes"))
def checksum_tree(spark, sf_dir):
    return tree(spark, sf_dir)


_SIDE = "(SELECT p.pair_id, n.* FROM pairs p JOIN nodes n ON n.snapshot_id = p.{}_id)"


@query(
    lambda: _tree_sql(
        f", m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.level, b.level) AS level, coalesce(a.kind, b.kind) AS kind, coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.name, b.name) AS name, "
        "CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' ELSE 'changed' END AS change "
        f"FROM {_SIDE.format('source')} a FULL JOIN {_SIDE.format('target')} b ON a.pair_id = b.pair_id AND a.level = b.level AND a.kind = b.kind AND a.table_name IS NOT DISTINCT FROM b.table_name AND a.name IS NOT DISTINCT FROM b.name "
        "WHERE a.digest IS DISTINCT FROM b.digest) SELECT * FROM m"
    )
)
def drift_subtrees(spark, sf_dir):
    """What differs between the snapshots of each pair, looked for only below what differs."""
    return merkle.drift(tree(spark, sf_dir), pairs(spark, sf_dir))


# ---- relations and code ---------------------------------------------------------------

_FK = """, fk AS (SELECT *, EXISTS (SELECT 1 FROM constraints u WHERE u.snapshot_id = c.snapshot_id AND u.table_name = c.table_name AND u.kind IN ('PRIMARY KEY', 'UNIQUE') AND u.columns = c.columns) AS one, EXISTS (SELECT 1 FROM tables t WHERE t.snapshot_id = c.snapshot_id AND t.table_name = c.ref_table) AS known FROM constraints c WHERE kind = 'FOREIGN KEY')"""


@query(lambda: profile_sql.ctes("constraints", "tables") + _FK + " SELECT snapshot_id, table_name, 'belongs_to' AS relation, ref_table AS other, name AS constraint_name FROM fk UNION ALL SELECT snapshot_id, ref_table, CASE WHEN one THEN 'has_one' ELSE 'has_many' END, table_name, name FROM fk WHERE known AND table_name <> ref_table")
def table_relations(spark, sf_dir):
    return relations.relations(catalog(spark, sf_dir))


@query(lambda: profile_sql.ctes("constraints", "tables") + _FK + " SELECT snapshot_id, table_name, name, one AS is_one_to_one, table_name = ref_table AS is_self, known AS is_known FROM fk")
def one_to_one_fk(spark, sf_dir):
    return relations.foreign_keys(catalog(spark, sf_dir)).select("snapshot_id", "table_name", "name", "is_one_to_one", "is_self", "is_known")


@query(lambda: profile_sql.ctes("constraints", "columns") + ", f AS (SELECT snapshot_id, table_name, list_sort(flatten(list(columns))) AS fk, list_sort(list(ref_table)) AS links FROM constraints WHERE kind = 'FOREIGN KEY' GROUP BY ALL), p AS (SELECT snapshot_id, table_name, list_sort(columns) AS pk FROM constraints WHERE kind = 'PRIMARY KEY'), n AS (SELECT snapshot_id, table_name, count(*) AS n FROM columns GROUP BY ALL) SELECT snapshot_id, table_name, links FROM f JOIN p USING (snapshot_id, table_name) JOIN n USING (snapshot_id, table_name) WHERE len(links) = 2 AND fk = pk AND n - len(pk) <= 1")
def junction_tables(spark, sf_dir):
    return relations.junction_tables(catalog(spark, sf_dir))


@query(lambda: profile_sql.ctes("constraints", "columns") + " SELECT k.snapshot_id, k.table_name, k.columns, len(k.columns) > 1 AS is_composite, len(k.columns) = 1 AND (c.identity IS NOT NULL OR coalesce(contains(lower(c.default_expr), 'nextval('), false)) AS is_auto FROM constraints k LEFT JOIN columns c ON c.snapshot_id = k.snapshot_id AND c.table_name = k.table_name AND c.name = k.columns[1] WHERE k.kind = 'PRIMARY KEY'")
def primary_keys(spark, sf_dir):
    return relations.primary_keys(catalog(spark, sf_dir))


@query(lambda: profile_sql.ctes("constraints", "indexes", "columns") + " SELECT c.snapshot_id, c.table_name, c.name, EXISTS (SELECT 1 FROM constraints u WHERE u.kind = 'UNIQUE' AND u.snapshot_id = c.snapshot_id AND u.table_name = c.table_name AND u.columns = [c.name]) AS is_unique, EXISTS (SELECT 1 FROM indexes i WHERE NOT i.is_constraint_index AND i.snapshot_id = c.snapshot_id AND i.table_name = c.table_name AND len(i.columns) = 1 AND i.columns[1].\"column\" = c.name) AS is_indexed FROM columns c")
def column_roles(spark, sf_dir):
    return relations.column_roles(catalog(spark, sf_dir))


_ONE = "CASE WHEN ends_with({x}, 's') AND NOT regexp_matches({x}, '(ss|us|is)$') AND length({x}) > 1 THEN left({x}, length({x}) - 1) ELSE {x} END"
_SINGULAR = "CASE WHEN ends_with(name, 'ies') AND length(name) > 3 THEN left(name, length(name) - 3) || 'y' ELSE " + _ONE.format(x="name") + " END"


@query(
    f"WITH n AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT source FROM documents UNION ALL SELECT event_type || 's' FROM events UNION ALL SELECT role FROM conversations)), "
    f"s AS (SELECT name, {_SINGULAR} AS one, replace(replace(lower(regexp_replace(name, '([^A-Z])([A-Z])', '\\1_\\2', 'g')), '-', '_'), ' ', '_') AS m FROM n), "
    "w AS (SELECT name, m, array_to_string(list_transform(list_filter(regexp_split_to_array(one, '[_ -]'), lambda x: x <> ''), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '') AS c FROM s) "
    f"SELECT name, CASE WHEN c = '' THEN 'Model' ELSE c END AS class_name, {_ONE.format(x='m')} AS module FROM w"
)
def naming_classes(spark, sf_dir):
    """Classes and modules of what could be tables: products, segments, sources, types of events, roles."""
    out = None
    for table, e in (("part", "p_name"), ("customer", "c_mktsegment"), ("documents", "source"), ("events", "concat(event_type, 's')"), ("conversations", "role")):
        one = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{e} AS name")
        out = one if out is None else out.unionByName(one)
    return out.distinct().select("name", naming.class_name(F.col("name")).alias("class_name"), naming.module_name(F.col("name")).alias("module"))


@query(lambda: oracle_plan.codegen_ctes() + " SELECT snapshot_id, table_name, column_name, line FROM fields")
def codegen_python_fields(spark, sf_dir):
    return codegen.python_fields(catalog(spark, sf_dir)).select("snapshot_id", "table_name", "column_name", "line")


@query(lambda: oracle_plan.python_files_sql(codegen.HEAD))
def codegen_python_files(spark, sf_dir):
    return codegen.python_files(catalog(spark, sf_dir))


@query(oracle_plan.rust_files_sql)
def codegen_rust_files(spark, sf_dir):
    return codegen.rust_entities(catalog(spark, sf_dir))


# ---- order and cycles ------------------------------------------------------------------

_NEEDS = """, nodes AS (SELECT snapshot_id AS g, 'table:' || table_name AS node FROM tables UNION ALL SELECT snapshot_id, 'enum:' || name FROM enums UNION ALL SELECT snapshot_id, 'view:' || name FROM views
 UNION ALL SELECT snapshot_id, 'index:' || table_name || ':' || name FROM indexes WHERE NOT is_constraint_index),
edges AS (SELECT DISTINCT g, node, needs FROM (SELECT snapshot_id AS g, 'table:' || table_name AS node, 'enum:' || type.name AS needs FROM columns WHERE type.schema <> 'pg_catalog'
 UNION ALL SELECT snapshot_id, 'table:' || table_name, 'table:' || ref_table FROM constraints WHERE kind = 'FOREIGN KEY' AND table_name <> ref_table
 UNION ALL SELECT snapshot_id, 'index:' || table_name || ':' || name, 'table:' || table_name FROM indexes WHERE NOT is_constraint_index
 UNION ALL SELECT v.snapshot_id, 'view:' || v.name, 'table:' || t.table_name FROM views v JOIN tables t ON t.snapshot_id = v.snapshot_id AND list_contains(regexp_split_to_array(v.definition, '[^A-Za-z0-9_]+'), t.table_name))
 WHERE (g, needs) IN (SELECT (g, node) FROM nodes)),
walk AS (SELECT g, node, 1 AS k FROM nodes UNION SELECT w.g, e.node, w.k + 1 FROM walk w JOIN edges e ON e.g = w.g AND e.needs = w.node)"""


@query(lambda: profile_sql.ctes("tables", "columns", "constraints", "indexes", "views", "enums") + _NEEDS + " SELECT g AS graph, node, max(k)::INT AS round FROM walk GROUP BY ALL")
def statement_rounds(spark, sf_dir):
    """In which round each object of every snapshot can be made, all that it needs being there."""
    return graph.rounds(*worklist.needs(catalog(spark, sf_dir)))


_CYCLES = """, base AS (SELECT x.snapshot_id AS g, x.table_name AS a, x.ref_table AS b FROM common x JOIN fits c ON c.snapshot_id = x.snapshot_id AND c.table_name = x.table_name AND c.name = x.name AND c.feed = 'tables' AND c.d = x.common
 JOIN fits p ON p.snapshot_id = x.snapshot_id AND p.table_name = x.ref_table AND p.name = x.ref_name AND p.feed = 'tables' AND p.uniq AND p.held = p.n_rows),
ns AS (SELECT DISTINCT snapshot_id AS g, table_name AS node FROM every WHERE feed = 'tables'),
reach AS (SELECT g, node AS a, node AS b FROM ns UNION SELECT r.g, r.a, e.b FROM reach r JOIN base e ON e.g = r.g AND e.a = r.b),
comp AS (SELECT x.g, x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON y.g = x.g AND y.a = x.b AND y.b = x.a GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY g, component) AS size FROM comp),
ce AS (SELECT DISTINCT e.g, p.component AS a, q.component AS b FROM base e JOIN comp p ON p.g = e.g AND p.node = e.a JOIN comp q ON q.g = e.g AND q.node = e.b WHERE p.component <> q.component),
deep AS (SELECT DISTINCT g, component AS c, 1 AS k FROM comp UNION SELECT d.g, e.a, d.k + 1 FROM deep d JOIN ce e ON e.g = d.g AND e.b = d.c)"""


@query(lambda: profile_sql.ctes() + _CYCLES + " SELECT s.g AS graph, s.node, s.component, s.size, (SELECT max(k) FROM deep d WHERE d.g = s.g AND d.c = s.component)::INT AS round FROM sized s")
def reference_cycles(spark, sf_dir):
    """Tables whose columns' values are in one another, around: components of all inclusions, and their order."""
    p = profile(spark, sf_dir)
    edges = p.inclusions().select(F.col("snapshot_id").alias("graph"), F.col("table_name").alias("node"), F.col("ref_table").alias("needs")).distinct()
    nodes = p.stats.filter("feed = 'tables'").select(F.col("snapshot_id").alias("graph"), F.col("table_name").alias("node")).distinct()
    return graph.layered(nodes, kept(edges))


# ---- data probes over the tables themselves ----------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NN = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_violations FROM lineitem" for c in _NN))
def probe_not_null(spark, sf_dir):
    return probes.not_null(_read(spark, sf_dir, "lineitem"), *_NN)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def probe_unique(spark, sf_dir):
    return probes.unique(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_MOVED = "CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 ELSE l_orderkey END"


@query(f"SELECT {_MOVED} AS l_orderkey, count(*) AS n FROM lineitem WHERE {_MOVED} NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL) GROUP BY 1")
def probe_foreign_key(spark, sf_dir):
    """All rows, in a copy in which every seventh line of an order has lost it."""
    child = _read(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.expr(_MOVED))
    return probes.foreign_key(child, ["l_orderkey"], _read(spark, sf_dir, "orders"), ["o_orderkey"])


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (l_quantity > 0 AND l_discount <= 0.05)) AS n_violations FROM lineitem")
def probe_check(spark, sf_dir):
    return probes.check(_read(spark, sf_dir, "lineitem"), (F.col("l_quantity") > 0) & (F.col("l_discount") <= 0.05))


@query("SELECT 'o_orderkey' AS column_name, 'smallint' AS to_type, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) FILTER (WHERE o_orderkey < -32768 OR o_orderkey > 32767) AS n_violations FROM orders")
def probe_narrowing(spark, sf_dir):
    return probes.narrowing(_read(spark, sf_dir, "orders"), "o_orderkey", "smallint")


from . import queries_catalog, queries_history  # noqa: E402, F401  (they register their queries)
