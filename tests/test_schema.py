"""Known cases of diffs, plans, replay, introspection, code and histories."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import schemas
from schemaloom.builder import SchemaBuilder, type_info
from schemaloom.functions import naming, similarity
from schemaloom.model import Catalog
from schemaloom import tables
from schemaloom.operators import breaking, discover, history, merkle, relations
from schemaloom.operators.diff import Diff, DiffConfig, pairs_frame
from schemaloom.plans import codegen, operations, replay, worklist
from schemaloom.sources import catalogs, footers, system


@pytest.fixture(scope="module")
def plan(spark):
    rows = operations.plan(schemas.diff(spark)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["pair_id"], r["seq"])):
        out.setdefault(r["pair_id"], []).append(r)
    return out


def sql(plan, pair):
    return [s for r in plan[pair] for s in r["forward"]]


def test_plans_read_as_expected(plan):
    assert sql(plan, "more_columns") == ["ALTER TABLE public.readers ADD COLUMN phone text", "ALTER TABLE public.readers ADD COLUMN level text NOT NULL DEFAULT 'new'"]
    assert "ALTER TABLE public.books ADD CONSTRAINT books_held_by_fkey FOREIGN KEY (held_by) REFERENCES public.readers (no) ON DELETE SET NULL" in sql(plan, "library")
    assert sql(plan, "defaults") == ["ALTER TABLE public.t ALTER COLUMN a SET DEFAULT 'n'", "ALTER TABLE public.t ALTER COLUMN b SET DEFAULT 'z'", "ALTER TABLE public.t ALTER COLUMN c DROP DEFAULT"]
    assert sql(plan, "enums") == ["DROP TYPE IF EXISTS public.unused", "CREATE TYPE public.grade AS ENUM ('one', 'two', 'three')", "ALTER TYPE public.mood ADD VALUE 'it''s bad'"]
    assert sql(plan, "lenders") == ["ALTER TABLE public.lenders RENAME TO borrowers"]
    readers = next(x for x in sql(plan, "library") if x.startswith("CREATE TABLE public.readers"))
    assert readers.splitlines()[-3:] == ["    CONSTRAINT readers_mail_key UNIQUE (mail),", "    CONSTRAINT readers_pkey PRIMARY KEY (no)", ")"]
    assert sql(plan, "indexed") == ["CREATE UNIQUE INDEX by_name ON public.readers (full_name DESC NULLS LAST) WHERE no > 0"]
    assert [r["name"] for r in plan["chain"] if r["op_kind"] == "CreateTable"] == ["c_shelf", "b_book", "a_page"]
    phases = [r["phase"] for rows in plan.values() for r in rows]
    assert all(a["phase"] <= b["phase"] for rows in plan.values() for a, b in zip(rows, rows[1:], strict=False)) and set(phases) == {1, 2, 3, 4, 5}


def test_inverse_runs_backwards_or_not_at_all(spark, plan):
    inv = {}
    for r in operations.inverse(operations.plan(schemas.diff(spark))).collect():
        inv.setdefault(r["pair_id"], []).append(r)
    assert [r["op_kind"] for r in sorted(inv["library"], key=lambda r: r["seq"])] == ["DropConstraint", "DropIndex", "DropTable", "DropTable", "DropEnum"]
    assert all(r["error"] is None for r in inv["mail_renamed"]) and inv["mail_renamed"][0]["name"] == "mail_address"
    assert {r["op_kind"] for r in inv["enums"]} == {"DropEnum", "AddEnumValue"} and all(r["error"] for r in inv["enums"])


def test_replaying_a_plan_gives_the_target(spark):
    d = schemas.diff(spark)
    ids = d.pairs.select(F.col("source_id").alias("snapshot_id")).union(d.pairs.select("target_id"))
    states = {r["snapshot_id"]: json.loads(r["state"]) for r in replay.state_of(d.catalog, ids).collect()}
    start = replay.state_of(d.catalog, ids).join(d.pairs, F.col("snapshot_id") == F.col("source_id")).select("pair_id", "state")
    got = {r["pair_id"]: r for r in replay.replay(operations.plan(d), start).collect()}
    for pair in ("library", "clubs", "staff", "more_columns", "fewer_columns", "other_types", "defaults", "counters", "notes", "rooms", "chain", "indexed", "closing"):
        assert got[pair]["error"] is None
        a, b = json.loads(got[pair]["state"]), states[f"{pair}/new"]
        a["schema"] = b["schema"]
        # positions of added columns, and indexes that stand behind constraints, aren't operations
        for s in (a, b):
            for t in s["tables"].values():
                t["indexes"] = {k: v for k, v in t["indexes"].items() if not v.get("is_constraint_index")}
        norm = lambda x: {k: norm(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [norm(v) for v in x] if isinstance(x, list) else x
        assert norm(a) == norm(b), pair


def test_replay_errors():
    table = {"op_kind": "CreateTable", "schema": "public", "name": "t", "payload": {"columns": ['{"name": "a"}']}}
    state = replay.apply(replay.EMPTY, [table])
    assert replay.EMPTY["tables"] == {}
    for op, kind in (
        (table, "AlreadyExists"),
        ({"op_kind": "DropTable", "schema": "public", "name": "x"}, "NotFound"),
        ({"op_kind": "DropColumn", "schema": "public", "table_name": "t", "name": "x"}, "NotFound"),
        ({"op_kind": "DropIndex", "schema": "public", "name": "x"}, "NotFound"),
        ({"op_kind": "DropTable", "schema": "other", "name": "t"}, "SchemaMismatch"),
    ):
        with pytest.raises(replay.ReplayError) as e:
            replay.apply(state, [op])
        assert e.value.kind == kind
    assert replay.apply(state, [operations.refresh_materialized_view("other", "v")]) == state
    enum = replay.apply(replay.EMPTY, [{"op_kind": "CreateEnum", "name": "e", "payload": {"name": "e", "labels": ["a", "c"]}}, {"op_kind": "AddEnumValue", "name": "e", "payload": {"label": "b", "after": "a"}}])
    assert enum["enums"]["e"]["labels"] == ["a", "b", "c"]
    view = replay.apply(replay.EMPTY, [{"op_kind": "CreateView", "name": "v", "payload": {"name": "v", "definition": "1"}}, operations.replace_view("public", "v", "2")])
    assert view["views"]["v"]["definition"] == "2"


def test_thresholds_and_advanced_similarity(spark):
    assert DiffConfig.with_threshold(7).rename_threshold == 1.0 and DiffConfig.with_threshold(-1).rename_threshold == 0.0
    none = schemas.diff(spark, DiffConfig.no_rename_detection())
    assert none.renames().count() == 0
    adv = {(r["pair_id"], r["kind"]): r["similarity"] for r in schemas.diff(spark, DiffConfig.with_advanced_similarity()).renames().collect()}
    assert adv["mail_renamed", "column"] >= 0.7 and adv["lenders", "table"] >= 0.7
    w = similarity.TableWeights(0, 0, 0, 0, 0)
    assert w.normalised() == (0.2,) * 5 and abs(sum(similarity.TableWeights.name_focused().normalised()) - 1) < 1e-12


def test_diff_of_equal_snapshots_is_empty(spark):
    c = schemas.catalog(spark)
    d = Diff(c, pairs_frame(spark, [("same", "library/new", "library/new")]))
    assert d.all_objects().count() == 0 and d.all_fields().count() == 0
    assert d.change_count().first()["is_empty"] and breaking.is_safe(d.pairs, breaking.analyse(d)).first()["is_safe"]


@settings(max_examples=60, deadline=None)
@given(st.text("abc_", max_size=8), st.text("abc_", max_size=8))
def test_edit_distance_properties(a, b):
    from schemaloom.plans.worklist import execute

    order = [x for x, _ in execute(sorted({a, b}), lambda x: None)]
    assert order == sorted({a, b})


def test_worklist():
    needs = {"a": [], "b": ["a"], "c": ["b"], "d": ["b", "c"]}
    done = set()

    def run(x):
        if x == "dup":
            return "42P07"
        if set(needs[x]) - done:
            return "42P01"
        done.add(x)
        return None

    assert worklist.execute(["d", "c", "b", "a", "dup"], run)[-1][0] == "d"
    with pytest.raises(worklist.CircularDependency):
        worklist.execute(["x", "y"], lambda x: "42P01")
    with pytest.raises(RuntimeError):
        worklist.execute(["x"], lambda x: "XX000")


def test_worklist_error_classes(spark):
    df = spark.createDataFrame([("42P01",), ("42710",), ("23505",)], "s string")
    assert [r[0] for r in df.select(worklist.error_class(F.col("s"))).collect()] == ["retry", "skip", "fail"]


def test_introspection(spark):
    ints = [(23, "int4", 11, "b", 0), (25, "text", 11, "b", 0), (900, "mood", 2200, "e", 0)]
    rows = {
        "pg_namespace": [(11, "pg_catalog"), (2200, "public")],
        "pg_class": [(1, "users", 2200, "r", 2), (2, "posts", 2200, "p", 2), (3, "users_email_key", 2200, "i", 403), (4, "posts_idx", 2200, "i", 403), (5, "v", 2200, "m", 0), (6, "s", 2200, "S", 0), (7, "users_pkey", 2200, "i", 403)],
        "pg_type": ints,
        "pg_attribute": [(1, "id", 23, 1, True, False, "a", "", None, "integer"), (1, "email", 25, 2, False, False, "", "", 100, "text"),
                (1, "up", 25, 3, False, False, "", "s", 100, "text"), (1, "gone", 25, 4, False, True, "", "", 100, "text"),
                (2, "id", 23, 1, True, False, "", "", None, "integer"), (2, "user_id", 23, 2, False, False, "", "", None, "integer")],
        "pg_attrdef": [(1, 2, "'x'"), (1, 3, "upper(email)")],
        "pg_collation": [(100, "default", 11)],
        "pg_constraint": [(50, "users_pkey", "p", 1, 7, [1], 0, None, None, None, False, False, False, None, None, None, None, None),
                (51, "fk", "f", 2, 0, [2], 1, [1], "c", "a", True, False, False, None, None, None, None, None),
                (52, "bad", "c", 2, 0, None, 0, None, None, None, False, False, False, None, None, None, None, None),
                (53, "uq", "u", 1, 3, [2], 0, None, None, None, False, False, False, None, True, None, None, None)],
        "pg_index": [(3, 1, True, False, [2], [0], None, None), (4, 2, False, False, [2, 0], [3, 0], [None, "lower(x)"], "id > 0"), (7, 1, True, True, [1], [0], None, None)],
        "pg_am": [(403, "btree")],
        "pg_views": [(5, "SELECT 1")],
        "pg_sequence": [(6, "bigint", 1, 1, 1, 9, 1, False)],
        "pg_enum": [(900, "ok", 2.0), (900, "sad", 1.0)],
        "pg_description": [(1, 0, "people"), (1, 2, "mail")],
    }
    c, bad = catalogs.introspect(catalogs.FakeCatalog(spark, rows), "public", "live")
    assert {(r["table_name"], r["kind"], r["comment"]) for r in c.tables.collect()} == {("users", "regular", "people"), ("posts", "partitioned", None)}
    cols = {(r["table_name"], r["name"]): r for r in c.columns.collect()}
    assert ("users", "gone") not in cols and cols["users", "up"]["default_expr"] is None and cols["users", "up"]["generated"]["expression"] == "upper(email)"
    assert cols["users", "id"]["identity"] == "ALWAYS" and cols["users", "email"]["comment"] == "mail" and not cols["users", "id"]["is_nullable"]
    cons = {r["name"]: r for r in c.constraints.collect()}
    assert cons["fk"]["columns"] == ["user_id"] and cons["fk"]["ref_table"] == "users" and cons["fk"]["on_delete"] == "CASCADE" and cons["uq"]["nulls_not_distinct"]
    assert [(r["name"], r["reason"]) for r in bad.collect()] == [("bad", "missing expression")]
    idx = {r["name"]: r for r in c.indexes.collect()}
    assert set(idx) == {"users_email_key", "posts_idx"} and idx["users_email_key"]["is_constraint_index"]
    assert [tuple(x) for x in idx["posts_idx"]["columns"]] == [("user_id", None, "desc", "first"), (None, "lower(x)", "asc", "last")]
    assert c.views.first()["is_materialized"] and c.enums.first()["labels"] == ["sad", "ok"] and c.sequences.first()["max_value"] == 9
    with pytest.raises(catalogs.NamespaceNotFound):
        catalogs.introspect(catalogs.FakeCatalog(spark, rows), "nope", "live")


def test_snapshots_survive_json(spark, tmp_path):
    c = schemas.catalog(spark)
    catalogs.write_json(c, str(tmp_path / "snap"))
    again = catalogs.read_json(spark, str(tmp_path / "snap"))
    assert history.checksum(c).exceptAll(history.checksum(again)).count() == 0
    assert Catalog.empty(spark).tables.count() == 0


def test_export_is_a_script(spark):
    text = {r["snapshot_id"]: r["sql"] for r in catalogs.export_sql(schemas.catalog(spark).only("library/new")).collect()}["library/new"]
    assert text.startswith("BEGIN;") and text.rstrip().endswith("COMMIT;")
    assert text.index("CREATE TYPE") < text.index("CREATE TABLE public.readers") < text.index("ADD CONSTRAINT books_held_by_fkey")


def test_checksum_ignores_comments(spark):
    a = SchemaBuilder("a").table("t", comment="x").column("id", "integer", comment="y")
    b = SchemaBuilder("b").table("t").column("id", "integer")
    d = SchemaBuilder("d").table("t").column("id", "bigint")
    rows = {k: a.rows[k] + b.rows[k] + d.rows[k] for k in ("namespaces", "tables", "columns")}
    got = {r["snapshot_id"]: r["checksum"] for r in history.checksum(Catalog.of(spark, rows)).collect()}
    assert got["a"] == got["b"] != got["d"]


def test_checksums_of_what_looked_alike_differ(spark):
    """Labels, keys and defaults that read the same when joined by commas or marked by a sign."""
    def both(make_a, make_b):
        rows = {k: [] for k in Catalog.__dataclass_fields__}
        for name, make in (("a", make_a), ("b", make_b)):
            s = SchemaBuilder(name)
            make(s)
            for k, v in s.rows.items():
                rows[k] += v
        got = {r["snapshot_id"]: r["checksum"] for r in history.checksum(Catalog.of(spark, rows)).collect()}
        return got["a"], got["b"]

    for a, b in (
        (lambda s: s.enum("e", "x,y"), lambda s: s.enum("e", "x", "y")),
        (lambda s: s.table("t").column("a", "text").primary_key("a,b", name="k"), lambda s: s.table("t").column("a", "text").primary_key("a", "b", name="k")),
        (lambda s: s.table("t").column("a", "text", default="~"), lambda s: s.table("t").column("a", "text")),
        (lambda s: s.table("t").column("ab", "text").table("u"), lambda s: s.table("t").table("u").column("ab", "text")),
        (lambda s: s.view("v|1", "2"), lambda s: s.view("v", "1|2")),
    ):
        x, y = both(a, b)
        assert x != y
    x, y = both(lambda s: s.table("t").column("a", "text", position=1).column("b", "text", position=2), lambda s: s.table("t").column("a", "text", position=4).column("b", "text", position=9))
    assert x == y


def test_drift_is_looked_for_below_what_differs(spark):
    d = schemas.diff(spark)
    rows = merkle.drift(tables.kept(merkle.tree(d.catalog)), d.pairs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["pair_id"], set()).add((r["level"], r["kind"], r["table_name"], r["name"], r["change"]))
    assert "same" not in by and "notes" not in by
    assert by["more_columns"] == {(0, "snapshot", None, None, "changed"), (1, "table", None, "readers", "changed"), (2, "column", "readers", "phone", "added"), (2, "column", "readers", "level", "added")}
    assert by["enums"] == {(0, "snapshot", None, None, "changed"), (1, "enum", None, "mood", "changed"), (1, "enum", None, "unused", "removed"), (1, "enum", None, "grade", "added")}


def test_keys_are_minimal_and_exact(spark):
    rows = [(i, i // 2, i % 2, None if i == 3 else i, "x", float(i // 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, half int, bit int, holes int, same string, third double")
    assert discover.keys(df) == (60, [("id",), ("half", "bit")])
    assert discover.keys(df.drop("id", "half"))[1] == [] and discover.keys(df.filter("false")) == (0, []) and discover.keys(df.union(df))[1] == []
    deep = spark.createDataFrame([(i % 4, i // 4 % 4, i // 16) for i in range(64)], "a int, b int, c int")
    assert discover.keys(deep)[1] == [("a", "b", "c")] and discover.keys(deep, most=2)[1] == []


def test_footers_tell_what_a_scan_would(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN id - 500.5D END AS x", "cast(id AS string) AS s", "CASE WHEN id < 0 THEN 1 END AS none", "array(id) AS list")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    got = {r["name"]: tuple(r)[1:] for r in footers.columns_of(spark, str(tmp_path / "t")).collect()}
    assert got["id"] == (1000, 0, 0.0, 999.0, True) and got["x"] == (1000, 100, -499.5, 498.5, True)
    assert got["s"][:2] == (1000, 0) and got["none"] == (1000, 1000, None, None, True) and got["list"] == (1000, 0, None, None, False)
    df.limit(0).write.parquet(str(tmp_path / "e"))
    assert {tuple(r)[1:3] for r in footers.columns_of(spark, str(tmp_path / "e")).collect()} == {(0, 0)}


def test_system_tables_are_read_back(spark):
    for name in ("library/new", "rooms/new"):
        c = schemas.catalog(spark).only(name)
        back, bad = catalogs.introspect(system.SnapshotSystem(c), "public", name)
        assert bad.count() == 0
        assert Diff(c.union(back.renamed("back")), pairs_frame(spark, [("p", name, "back")])).all_objects().collect() == [], name


def test_histories(spark):
    z = history.ZERO
    rows = [("h", 1, "aa1", z, "s1", True), ("h", 2, "aa2", "s1", "s2", False), ("h", 3, "b3", "s2", "s3", False), ("bad", 1, "x1", z, "t1", False), ("bad", 2, "x2", "oops", "t2", False)]
    h = spark.createDataFrame(rows, "history_id string, seq long, id string, parent_hash string, resulting_hash string, is_checkpoint boolean")
    ok = {r["history_id"]: (r["ok"], r["broken_seq"]) for r in history.verify_chain(h).collect()}
    assert ok == {"h": (True, None), "bad": (False, 2)}
    assert [r["n_replayed"] for r in history.nearest_checkpoint(h.filter("history_id = 'h'")).orderBy("seq").collect()] == [0, 1, 2]
    assert history.since(h, F.lit(z)).count() == 5 and history.since(h, F.lit("s1")).count() == 2
    assert {r["history_id"]: r["outcome"] for r in history.show(h, "aa").collect()} == {"h": "ambiguous", "bad": "not_found"}
    todo = history.pending(h, spark.createDataFrame([("h", "aa2"), ("bad", "zz")], "history_id string, id string")).collect()
    assert {(r["history_id"], r["seq"], r["error"]) for r in todo} == {("h", 3, None), ("bad", None, "unknown migration")}
    new = spark.createDataFrame([("h", "n", "s3"), ("bad", "n", "s3"), ("new", "n", z)], "history_id string, id string, parent_hash string")
    assert {r["history_id"]: (r["seq"], r["ok"]) for r in history.recordable(h, new).collect()} == {"h": (4, True), "bad": (3, False), "new": (1, True)}
    assert history.unrecord(h).filter("is_current").count() == 2 and history.duplicates(h, h).count() == 5
    a, b = spark.range(1).select(history.migration_id(F.lit("p"), F.lit("[]"), F.lit("d")), history.migration_id(F.lit("p"), F.lit("[]d"), F.lit(""))).first()
    assert a != b and len(a) == 64


def test_stream_of_records(spark, tmp_path):
    from schemaloom.streaming.watch import watch_chain

    schema = "history_id string, seq long, id string, parent_hash string, resulting_hash string"
    spark.createDataFrame([("h", 1, "a", history.ZERO, "s1"), ("h", 2, "b", "s1", "s2"), ("h", 3, "c", "zz", "s3")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = watch_chain(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["ok"] for r in spark.table("watched").orderBy("seq").collect()] == [True, True, False]


def test_python_models(spark):
    c = schemas.catalog(spark)
    lines = {(r["snapshot_id"], r["column_name"]): r["line"] for r in codegen.python_fields(c).collect()}
    assert lines["library/new", "held_by"] == '    held_by: int | None = Field(foreign_key="public.readers.no", index=True)'
    assert lines["clubs/new", "class"] == '    class_: str | None = Field(max_length=9, alias="class")'
    assert lines["more_columns/new", "phone"] == "    phone: str | None = None"
    models = {(r["snapshot_id"], r["table_name"]): r["code"] for r in codegen.python_models(c).collect()}
    assert models["same/new", "readers"].startswith("class Reader(SQLModel, table=True):\n    __tablename__ = \"readers\"\n")
    assert "# WARNING: exclusion constraint 'rooms_free'" in models["rooms/new", "rooms"]
    files = {r["file"] for r in codegen.python_files(c.only("clubs/new"), one_file=False).collect()}
    assert "__init__.py" in files and "joining.py" in files
    rust = {r["file"]: r["content"] for r in codegen.rust_entities(c.only("clubs/new")).collect()}
    assert "pub mod clubs;" in rust["mod.rs"] and "pub id: i32," in rust["clubs.rs"]


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("1st", "a-b", "class", "", "__", "createdAt", "a__b")], "n string")
    assert [r[0] for r in df.select(naming.identifier(F.col("n"))).collect()] == ["_1st", "a_b", "class_", "_empty", "_field", "createdAt", "a_b"]


def test_relations(spark):
    c = schemas.catalog(spark)
    got = {(r["table_name"], r["relation"], r["other"]) for r in relations.relations(c).filter("snapshot_id = 'clubs/new'").collect()}
    assert ("cards", "belongs_to", "members") in got and ("members", "has_one", "cards") in got and ("clubs", "has_many", "joinings") in got
    assert [r["table_name"] for r in relations.junction_tables(c).collect()] == ["joinings"]
    assert relations.relations(c).filter("snapshot_id = 'staff/new'").count() == 1
    auto = {r["table_name"]: r["is_auto"] for r in relations.primary_keys(c).filter("snapshot_id = 'clubs/new'").collect()}
    assert auto == {"members": False, "clubs": True, "joinings": False, "cards": False}


def test_types():
    assert type_info("varchar(10)")["formatted"] == "character varying(10)" and type_info("int4[]") == {"name": "_int4", "schema": "pg_catalog", "formatted": "integer[]", "is_array": True}
    from pyspark.sql import types as T

    from schemaloom.functions.typemap import from_spark

    assert from_spark(T.DecimalType(9, 2))["formatted"] == "numeric(9,2)" and from_spark(T.ArrayType(T.FloatType()))["formatted"] == "real[]" and from_spark(T.MapType(T.StringType(), T.StringType()))["name"] == "jsonb"
