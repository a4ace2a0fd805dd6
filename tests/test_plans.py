"""DDL text, compiled migrations, matching, depths, beginnings and records, on small cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

import schemas
from schemaloom.builder import SchemaBuilder as S
from schemaloom.model import Catalog
from schemaloom.operators import graph, history
from schemaloom.operators import diff as diffing
from schemaloom.operators.diff import Diff, DiffConfig, greedy, pairs_frame
from schemaloom.plans import codegen, compile as compiling, operations, replay
from schemaloom.functions.sqltext import RenderConfig
from schemaloom.sources import ddl
from schemaloom.sources.catalogs import export_sql

SCRIPT = """
-- a comment; with a semicolon
BEGIN;
CREATE TYPE public.mood AS ENUM ('sad', 'it''s fine', 'a;b');
CREATE SEQUENCE IF NOT EXISTS public.ids AS integer INCREMENT BY 5 MAXVALUE 100 CYCLE;
CREATE TABLE public.users (
    id integer NOT NULL GENERATED BY DEFAULT AS IDENTITY PRIMARY KEY,
    "Odd Name" character varying(40) COLLATE pg_catalog."C" DEFAULT 'x, (y)'::text,
    price numeric(5,2) DEFAULT round(1.5, 1) NOT NULL,
    up text GENERATED ALWAYS AS (upper("Odd Name")) STORED,
    tags text[] UNIQUE,
    at timestamp with time zone,
    CONSTRAINT price_ok CHECK (price > 0 AND price < 10) NO INHERIT,
    UNIQUE NULLS NOT DISTINCT (price, up)
);
CREATE TABLE posts (author integer CONSTRAINT by_user REFERENCES users (id) ON DELETE SET NULL, EXCLUDE USING gist (during WITH &&, room WITH =) WHERE (room > 0), during tsrange, room integer) PARTITION BY RANGE (room);
ALTER TABLE public.posts ADD COLUMN title text;
ALTER TABLE ONLY public.posts ADD CONSTRAINT posts_fk FOREIGN KEY (author, room) REFERENCES other.users (a, b) ON UPDATE CASCADE DEFERRABLE INITIALLY DEFERRED;
CREATE UNIQUE INDEX posts_recent ON public.posts USING gin (title DESC, lower_title DESC NULLS LAST, (lower(title)) NULLS FIRST) WHERE room > 1;
CREATE MATERIALIZED VIEW public.stats AS SELECT count(*) FROM posts;
COMMENT ON TABLE public.users IS 'it''s people';
COMMENT ON COLUMN public.users.price IS 'euros';
COMMENT ON CONSTRAINT price_ok ON public.users IS 'sane';
COMMENT ON SCHEMA public IS NULL;
COMMIT;
"""


def test_ddl_is_read_as_it_is_written():
    r = ddl.parse("s", SCRIPT)
    assert r["enums"] == [("s", "mood", ["sad", "it's fine", "a;b"], None)]
    assert r["sequences"] == [("s", "ids", "integer", 1, 5, 1, 100, 1, True, None)]
    assert [(t[1], t[2], t[3]) for t in r["tables"]] == [("users", "regular", "it's people"), ("posts", "partitioned", None)]
    columns = {(c[1], c[2]): c[3:] for c in r["columns"]}
    assert columns["users", "id"][2:6] == (False, None, None, "BY DEFAULT")
    odd = columns["users", "Odd Name"]
    assert odd[1]["formatted"] == "character varying(40)" and odd[1]["name"] == "varchar" and odd[2:4] == (True, "'x, (y)'::text") and odd[6] == "C"
    assert columns["users", "price"][2:4] == (False, "round(1.5, 1)") and columns["users", "price"][-1] == "euros"
    assert columns["users", "up"][4] == {"expression": 'upper("Odd Name")', "storage": "STORED"}
    assert columns["users", "tags"][1] == {"name": "_text", "schema": "pg_catalog", "formatted": "text[]", "is_array": True}
    assert columns["users", "at"][1]["name"] == "timestamptz" and columns["posts", "title"][0] == 4
    constraints = {c[2]: c for c in r["constraints"]}
    assert constraints["users_pkey"][3:5] == ("PRIMARY KEY", ["id"]) and constraints["users_price_up_key"][14] is True
    assert constraints["price_ok"][12:14] == ("price > 0 AND price < 10", True) and constraints["price_ok"][18] == "sane"
    assert constraints["by_user"][6:10] == ("users", ["id"], "SET NULL", "NO ACTION")
    assert constraints["posts_fk"][4:12] == (["author", "room"], "other", "users", ["a", "b"], "NO ACTION", "CASCADE", True, True)
    assert constraints["posts_excl"][15:18] == ([("during", "&&"), ("room", "=")], "gist", "room > 0")
    index = next(i for i in r["indexes"] if i[2] == "posts_recent")
    assert index[3:8] == ("gin", True, False, [("title", None, "desc", "first"), ("lower_title", None, "desc", "last"), (None, "lower(title)", "asc", "first")], "room > 1")
    assert r["views"] == [("s", "stats", "SELECT count(*) FROM posts", True, None)]


def test_ddl_that_is_not_understood_is_told(spark, tmp_path):
    for bad in ("DROP TABLE x", "CREATE INDEX i ON nowhere (a)", "CREATE TABLE t (a integer", "COMMENT ON ROLE r IS 'x'"):
        with pytest.raises(ddl.DdlError):
            ddl.parse("s", bad)
    (tmp_path / "a.sql").write_text("CREATE TABLE a (id integer)")
    (tmp_path / "b.sql").write_text("GRANT ALL ON a TO b")
    c, errors = ddl.load_files(spark, str(tmp_path))
    assert [(r["snapshot_id"], r["table_name"]) for r in c.tables.collect()] == [("a", "a")]
    assert [r["snapshot_id"] for r in errors.collect()] == ["b"]
    (tmp_path / "b.sql").write_text("ALTER TABLE a ADD COLUMN b text")
    whole, errors = ddl.load_files(spark, str(tmp_path), "all")
    assert errors.count() == 0 and whole.columns.count() == 2
    assert ddl.load_sql(spark.createDataFrame([("e", None)], "snapshot_id string, sql string"))[0].namespaces.count() == 1


def test_scripts_read_back_make_the_same_snapshots(spark):
    c = schemas.catalog(spark)
    back, errors = ddl.load_sql(export_sql(c))
    assert errors.count() == 0
    both = c.union(Catalog(**{k: getattr(back, k).withColumn("snapshot_id", F.concat("snapshot_id", F.lit("#"))) for k in vars(back)}))
    ids = [s.id for _, a, b in schemas.pairs() for s in (a, b) if s.rows.keys() - {"namespaces"}]
    left = Diff(both, pairs_frame(spark, [(i, i, i + "#") for i in ids])).all_fields().filter("field not in ('comment')")
    assert left.collect() == []


def test_nothing_to_compile_is_an_error(spark):
    d = schemas.diff(spark)
    with pytest.raises(compiling.NoChanges):
        compiling.compile_one(d, "same")
    one = compiling.compile_one(d, "more_columns", "more")
    assert one["statements"] == ["ALTER TABLE public.readers ADD COLUMN phone text", "ALTER TABLE public.readers ADD COLUMN level text NOT NULL DEFAULT 'new'"]
    assert one["is_reversible"] and one["n_operations"] == 2 and len(one["id"]) == 64 and len(json.loads(one["operations"])) == 2
    assert compiling.compile_one(d, "more_columns", "less")["id"] != one["id"]
    text = {r["pair_id"]: r["output"] for r in compiling.describe(operations.plan(d)).collect()}["more_columns"]
    assert text == "Migration: more_columns\nOperations: 2\nStatements: 2\nReversible: yes\n"
    shown = {r["pair_id"]: json.loads(r["output"]) for r in compiling.show_sql(operations.plan(d), as_json=True).collect()}["more_columns"]
    assert [x["position"] for x in shown] == [1, 2]


def test_options_of_rendering(spark):
    d = schemas.diff(spark)
    sql = lambda c: {(r["pair_id"], r["op_kind"]): r["forward"][0] for r in operations.plan(d, c).collect()}
    plain = sql(RenderConfig(if_exists=False, cascade=True, concurrently=True, if_not_exists=True, quoting="always", include_comments=False))
    assert plain["closing", "DropTable"] in ('DROP TABLE "public"."books" CASCADE', 'DROP TABLE "public"."readers" CASCADE')
    assert plain["indexed", "CreateIndex"].startswith('CREATE UNIQUE INDEX CONCURRENTLY IF NOT EXISTS "')
    assert plain["chain", "CreateTable"].startswith('CREATE TABLE IF NOT EXISTS "public"."')
    assert not any(k == "SetComment" for _, k in plain)
    bare = operations.plan(d, RenderConfig(rollback=False, quoting="never"))
    assert bare.filter("rollback is not null").count() == 0


def _many(rng, side, size):
    """A schema of objects that resemble those of the other side, now and then."""
    s = S(side)
    words = [f"w{k}" for k in range(60)]
    for k in range(size):
        s.enum(f"{side}_e{k}", *rng.sample(words, rng.randrange(0, 6)))
        s.sequence(f"{side}_s{k}", data_type=rng.choice(["integer", "bigint"]), increment=rng.choice([1, 2]), maximum=rng.choice([9, 99]))
        s.view(f"{side}_v{k}", "x" * rng.randrange(1, 60), materialized=rng.random() < 0.5)
        t = s.table(f"{side}_t{k}")
        for w in rng.sample(words, rng.randrange(0, 5)):
            t.column(w, rng.choice(["text", "integer"]))
    t = s.table("shared")
    for k in range(size):
        t.column(f"{side}_c{k}", rng.choice(["text", "integer", "varchar(9)", "date"]), null=rng.random() < 0.5, default=rng.choice([None, "1"]))
        cols = rng.sample(words, rng.randrange(1, 4))
        kind = rng.randrange(5)
        if kind == 0:
            t.unique(*cols, name=f"{side}_u{k}")
        elif kind == 1:
            t.foreign_key(cols, rng.choice(["a", "b"]), cols, name=f"{side}_f{k}")
        elif kind == 2:
            t.check(rng.choice(["x > 1", "x > 2"]), name=f"{side}_k{k}")
        elif kind == 3:
            t.exclude((cols[0], "="), name=f"{side}_x{k}")
        t.index(*cols, name=f"{side}_i{k}", unique=rng.random() < 0.5, method=rng.choice(["btree", "hash"]), predicate=rng.choice([None, "x > 1"]))
    return s


@pytest.mark.parametrize("threshold", [0.5, 0.62, 0.3])
def test_candidates_by_tokens_are_all_candidates(spark, threshold):
    rng = random.Random(12)
    a, b = _many(rng, "a", 40), _many(rng, "b", 40)
    rows = {k: a.rows[k] + b.rows[k] for k in {*a.rows, *b.rows}}
    d = Diff(Catalog.of(spark, rows), pairs_frame(spark, [("p", "a", "b")]), DiffConfig(threshold))
    key = ["kind", "table_name", "from_name", "to_name"]
    everything = d.similarities().filter(F.col("similarity") >= threshold).select(*key)
    want, got = ({tuple(r) for r in x.collect()} for x in (everything, d.candidates().select(*key)))
    assert got == want and {k for k, *_ in want} == {"column", "constraint", "index", "view", "sequence", "enum", "table"}


def test_few_pairs_are_looked_at(spark):
    """Enums with labels of their own: of four million pairs under a tenth meet."""
    rng, n = random.Random(13), 2000
    rows = {"namespaces": [("a", "public", None), ("b", "public", None)], "enums": []}
    for side in "ab":
        rows["enums"] += [(side, f"{side}{k}", [f"w{rng.randrange(3000)}" for _ in range(5)], None) for k in range(n)]
    d = Diff(Catalog.of(spark, rows), pairs_frame(spark, [("p", "a", "b")]))
    assert 0 < d.looked_at().count() < n * n // 100


def test_greedy_matching_is_best_first(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"p{p}", "column", f"t{t}", f"a{i}", f"b{j}", rng.choice([0.5, 0.6, 0.7, 0.8, 0.9])) for p in range(6) for t in range(2) for i in range(rng.randrange(1, 7)) for j in range(rng.randrange(1, 7)) if rng.random() < 0.8]
    rows += [("top", "table", None, f"a{i}", f"b{j}", 0.5 + 0.01 * (i == j) + 0.001 * i) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(rows, "pair_id string, kind string, table_name string, from_name string, to_name string, similarity double")
    want, used = set(), set()
    for p, k, t, a, b, s in sorted(rows, key=lambda r: (-r[5], r[3], r[4])):
        if (p, k, t, 0, a) not in used and (p, k, t, 1, b) not in used:
            used |= {(p, k, t, 0, a), (p, k, t, 1, b)}
            want.add((p, k, t, a, b, s))
    for most in (500, 0):  # folded, and in rounds
        monkeypatch.setattr(diffing, "FOLD", most)
        got = [tuple(r) for r in greedy(df).collect()]
        assert len(got) == len(want) and set(got) == want
    assert greedy(df.limit(0)).count() == 0


def test_depths_end_in_cycles(spark):
    tables = spark.createDataFrame([("p", x) for x in "abcde"] + [("q", x) for x in "xy"], "pair_id string, name string")
    edges = spark.createDataFrame([("p", "b", "a"), ("p", "c", "b"), ("p", "c", "a"), ("p", "e", "c"), ("q", "x", "y"), ("q", "y", "x")], "pair_id string, a string, b string")
    got = {(r["pair_id"], r["name"]): r["depth"] for r in operations.depths(tables, edges).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "p"} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 3}
    assert set(got) >= {("q", "x"), ("q", "y")}


def test_rounds_and_components_of_graphs(spark):
    rng = random.Random(21)
    nodes, edges = [], []
    for g, n, m in (("a", 12, 16), ("b", 10, 9), ("c", 8, 0), ("d", 14, 40)):
        nodes += [(g, f"n{k:02}") for k in range(n)]
        edges += [(g, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)] + [(g, "n01", "elsewhere")]
    ns, es = spark.createDataFrame(nodes, "graph string, node string"), spark.createDataFrame(edges, "graph string, node string, needs string")
    out = {}
    for g, n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for h, a, b in edges:
                if h == g and a == x and b not in seen and (g, b) in nodes:
                    seen.add(b)
                    todo.append(b)
        out[g, n] = seen
    comp = {(g, n): min(x for x in out[g, n] if n in out[g, x]) for g, n in nodes}
    got = {(r["graph"], r["node"]): r for r in graph.layered(ns, es).collect()}
    assert {k: r["component"] for k, r in got.items()} == comp
    assert all(r["size"] == sum(c == r["component"] and g == k[0] for (g, _), c in comp.items()) for k, r in got.items())
    for g, a, b in edges:
        if (g, b) in got and comp[g, a] != comp[g, b]:
            assert got[g, a]["round"] > got[g, b]["round"]
    order = {(r["graph"], r["node"]): r["round"] for r in graph.rounds(ns, es).collect()}
    stuck = {k for k in order if any(sum(c == comp[k[0], x] for (g, _), c in comp.items() if g == k[0]) > 1 for x in out[k])}
    assert {k for k, r in order.items() if r is None} == stuck
    assert graph.layered(ns.limit(0), es).count() == 0


def test_replay_never_replaces_silently():
    table = {"op_kind": "CreateTable", "name": "t", "payload": {"columns": [{"name": "a"}, {"name": "b"}], "constraints": [{"name": "c"}]}}
    state = replay.apply(replay.EMPTY, [table, {"op_kind": "CreateIndex", "table_name": "t", "name": "i", "payload": {}}])
    for op in (
        {"op_kind": "AddColumn", "table_name": "t", "name": "a", "payload": {"name": "a"}},
        {"op_kind": "RenameColumn", "table_name": "t", "name": "a", "to_name": "b"},
        {"op_kind": "AddConstraint", "table_name": "t", "name": "c", "payload": {}},
        {"op_kind": "CreateIndex", "table_name": "t", "name": "i", "payload": {}},
    ):
        with pytest.raises(replay.ReplayError) as e:
            replay.apply(state, [op])
        assert e.value.kind == "AlreadyExists"


def test_beginnings_and_records_from_files(spark, tmp_path):
    c = Catalog.of(spark, S("x").table("t").column("id", "integer").rows)
    none = spark.createDataFrame([], "history_id string")
    row = history.initialise(c, none).first()
    assert row["seq"] == 1 and row["is_checkpoint"] and row["parent_hash"] == history.ZERO and row["error"] is None
    empty = history.initialise(c, none, from_database=False).first()
    assert empty["seq"] == 0 and empty["resulting_hash"] == history.ZERO and empty["id"] is None
    assert history.initialise(c, spark.createDataFrame([("x",)], "history_id string")).first()["error"] == "AlreadyInitialised"
    stored = spark.createDataFrame([("x", row["resulting_hash"])], "history_id string, checksum string")
    live = history.checksum(c).withColumnRenamed("snapshot_id", "history_id")
    assert history.verify(stored, live).first()["outcome"] == "ok"
    h = spark.createDataFrame([("x", 1, row["id"], history.ZERO, row["resulting_hash"])], "history_id string, seq int, id string, parent_hash string, resulting_hash string")
    for name, parent in (("good", row["resulting_hash"]), ("late", history.ZERO)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"history_id": "x", "id": name, "parent_hash": parent, "description": "d", "operations": "[]"}, indent=1))
    got = {r["id"]: (r["seq"], r["ok"]) for r in history.recordable(h, history.read_migrations(spark, str(tmp_path))).collect()}
    assert got == {"good": (2, True), "late": (2, False)}


def test_generators_share_one_interface(spark):
    c = Catalog.of(spark, S("x").table("users").column("id", "integer").rows)
    files = {k: {r["file"] for r in g.generate(c).collect()} for k, g in codegen.GENERATORS.items()}
    assert files == {"python": {"models.py"}, "rust": {"users.rs", "mod.rs"}}
    assert {r["file"] for r in codegen.PythonGenerator(one_file=False).generate(c).collect()} == {"user.py", "__init__.py"}


def test_weights_without_renames(spark):
    d = schemas.diff(spark, DiffConfig.no_rename_detection())
    assert d.renames().count() == 0 and d.objects("table").filter("change = 'renamed'").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from schemaloom import cli

    old, new = tmp_path / "old.sql", tmp_path / "new.sql"
    old.write_text("CREATE TABLE users (id integer NOT NULL, email text)")
    new.write_text("CREATE TABLE users (id integer NOT NULL, email_address text, age smallint)")
    assert cli.main(["script", str(old), str(new)], spark) == 0
    assert "RENAME COLUMN email TO email_address" in capsys.readouterr().out
    assert cli.main(["describe", str(old), str(new), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["operations"] == 2
    for verb in ("diff", "plan", "inverse", "breaking", "show-sql", "execute"):
        assert cli.main([verb, str(old), str(new)], spark) == 0 and capsys.readouterr().out
    assert cli.main(["codegen", str(new), "--language", "rust"], spark) == 0 and "users.rs" in capsys.readouterr().out
    assert cli.main(["checksum", str(new)], spark) == 0 and cli.main(["list"], spark) == 0
    new.write_text("DROP DATABASE x")
    assert cli.main(["checksum", str(new)], spark) == 1


def test_a_history_of_files(spark, tmp_path):
    from schemaloom.sources import store

    s = store.Store(str(tmp_path / "one"))
    with pytest.raises(store.StoreError) as e:
        s.index()
    assert e.value.kind == "NotInitialised"
    s.initialise()
    s.initialise()
    assert s.current_hash() == history.ZERO and s.migrations() == [] and s.current_state() == replay.EMPTY
    table = lambda n: {"op_kind": "CreateTable", "schema": "public", "name": n, "payload": {"columns": [{"name": "id"}]}}
    hashes = [history.ZERO, *(c * 64 for c in "abc")]
    states = []
    for k in range(3):
        m = {"id": f"m{k}", "parent_hash": hashes[k], "resulting_hash": hashes[k + 1], "description": "d", "operations": [table(f"t{k}")]}
        if k == 1:
            m |= {"is_checkpoint": True, "state": replay.apply(s.current_state(), m["operations"])}
        states.append(s.record(m, "-- all"))
    assert [set(x["tables"]) for x in states] == [{"t0"}, {"t0", "t1"}, {"t0", "t1", "t2"}]
    assert [s.state_at(f"m{k}") for k in range(3)] == states and s.current_hash() == "c" * 64
    assert [m["id"] for m in s.since("a" * 64)] == ["m1", "m2"] and len(s.since(history.ZERO)) == 3 and s.since("c" * 64) == []
    s.verify_chain()
    for bad, kind in (({"id": "m0", "parent_hash": "c" * 64, "operations": []}, "Duplicate"), ({"id": "x", "parent_hash": "a" * 64, "operations": []}, "WrongParent")):
        with pytest.raises(store.StoreError) as e:
            s.record(bad)
        assert e.value.kind == kind
    s.save({"id": "y", "parent_hash": "a" * 64, "resulting_hash": "d" * 64, "operations": []})
    with pytest.raises(store.StoreError):
        s.verify_chain()
    h = store.read_stores(spark, str(tmp_path / "*"))
    assert [(r["history_id"], r["seq"], r["id"], r["is_checkpoint"]) for r in h.orderBy("seq").collect()] == [("one", 1, "m0", False), ("one", 2, "m1", True), ("one", 3, "m2", False), ("one", 4, "y", False)]
    assert history.verify_chain(h).first()["broken_seq"] == 4
    assert json.loads(h.filter("seq = 1").first()["operations"])[0]["name"] == "t0"
