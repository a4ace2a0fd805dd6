"""Operations of a migration plan: collected from a diff, rendered, inverted and ordered, one row each.

Row: pair_id, op_kind, object_kind (dependency rank), schema, table_name, name,
to_name, payload (JSON of what replay needs), forward and rollback (SQL),
description, is_reversible, and the collecting order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import RenderConfig, column_definition, constraint_body, index_column, literal, quote, text
from ..operators.diff import Diff
from ..tables import kept

#: Dependency ranks of object kinds, and phases of a plan.
KIND_RANK = {"enum": 0, "sequence": 1, "table": 2, "view": 3, "index": 4, "constraint": 5, "comment": 6}
PHASES = {"drop": 1, "rename": 2, "create": 3, "alter": 4, "comment": 5}
#: Operations whose inverse can be told from themselves.
REVERSIBLE = {
    "CreateEnum": "DropEnum", "CreateSequence": "DropSequence", "CreateTable": "DropTable", "AddColumn": "DropColumn", "AddConstraint": "DropConstraint", "CreateIndex": "DropIndex", "CreateView": "DropView",
    "RenameEnum": "RenameEnum", "RenameSequence": "RenameSequence", "RenameTable": "RenameTable", "RenameColumn": "RenameColumn", "RenameConstraint": "RenameConstraint", "RenameIndex": "RenameIndex", "RenameView": "RenameView",
}
IRREVERSIBLE = ("DropEnum", "AddEnumValue", "DropSequence", "AlterSequence", "DropTable", "DropColumn", "AlterColumn", "DropConstraint", "DropIndex", "DropView", "ReplaceView", "RefreshMaterializedView", "SetComment")
IN_TABLE_KINDS = ("column", "constraint", "index")
_OP = "struct<op_kind:string,phase:int,object_kind:int,table_name:string,name:string,to_name:string,payload:string,forward:array<string>,rollback:array<string>,description:string,r1:int,r2:int>"


class Collector:
    """Collects a diff's operations in one pass: every change becomes an array of the operations that it takes.

    A rule is a condition on a change (its kind and what became of it) and the operation that follows; `plan` orders them.
    """

    def __init__(self, diff: Diff, config: RenderConfig = RenderConfig()) -> None:  # noqa: B008
        self.diff, self.config = diff, config
        self.rules: list[Column] = []

    def _q(self, c: Column) -> Column:
        return quote(c, self.config.quoting)

    def _in(self, name: Column) -> Column:
        return text(self._q(F.col("schema")), ".", self._q(name))

    def _path(self, *names: str) -> Column:
        return F.concat_ws(".", "schema", *names)

    def _rule(self, when: Column, op: str, phase: str, kind: str, rank: int | Column, forward: Column, rollback: Column | None, description: Column, payload: Column | None = None, sub: Column | int = 0, many: bool = False) -> Column:
        none = F.lit(None).cast("string")
        back = F.lit(None).cast("array<string>") if rollback is None or not self.config.rollback else F.array(rollback)
        fields = {
            "op_kind": F.lit(op), "phase": F.lit(PHASES[phase]), "object_kind": F.lit(KIND_RANK[kind]), "table_name": F.col("table_name"), "name": F.col("name"), "to_name": F.col("to_name"),
            "payload": none if payload is None else payload, "forward": forward if many else F.array(forward), "rollback": back, "description": description,
            "r1": rank if isinstance(rank, Column) else F.lit(rank), "r2": (sub if isinstance(sub, Column) else F.lit(sub)).cast("int"),
        }
        return F.when(when, F.struct(*[v.alias(k) for k, v in fields.items()]))

    def add(self, *args, **more) -> None:
        self.rules.append(F.array(self._rule(*args, **more)))

    @staticmethod
    def _is(kind: str, *changes: str) -> Column:
        return (F.col("kind") == kind) & F.col("change").isin(*changes)

    def changes(self) -> DataFrame:
        """The diff's changes with their schema; beside them the objects inside added tables (change "inside"), what an
        added table's own text needs (lines, parts, depth), and comments of schemas."""
        d, q = self.diff, self.config.quoting
        ns = d.catalog.namespaces
        # the schema of a pair: that of its target, or of its source where the target has none
        named = d.pairs.join(ns.select(F.col("snapshot_id").alias("target_id"), F.col("schema").alias("ts")), "target_id", "left").join(ns.select(F.col("snapshot_id").alias("source_id"), F.col("schema").alias("ss")), "source_id", "left")
        schemas = named.select("pair_id", F.coalesce("ts", "ss", F.lit("public")).alias("schema"))
        rows = d.changes()
        added = rows.filter(self._is("table", "added")).select("pair_id", F.col("name").alias("table_name"))
        inside = kept(d.everything().filter(F.col("kind").isin(*IN_TABLE_KINDS) & F.col("t").isNotNull()).join(added, ["pair_id", "table_name"], "left_semi"))
        column, con = F.col("t.column"), F.col("t.constraint")
        lines = F.when(F.col("kind") == "column", F.struct(F.lit(0).alias("a"), column["position"].alias("b"), F.lit("").alias("c"), column_definition(column, q).alias("line"), F.to_json(column).alias("json"))).when(
            con["kind"].isin("PRIMARY KEY", "UNIQUE", "CHECK"),
                    F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("name").alias("c"),
                    text("CONSTRAINT ", self._q(F.col("name")), " ", constraint_body(con, q)).alias("line"), F.to_json(con.dropFields("definition")).alias("json"))
        )
        parts = inside.withColumn("line", lines).filter("line is not null").groupBy("pair_id", F.col("table_name").alias("name")).agg(F.array_sort(F.collect_list("line")).alias("parts"))
        more = parts.join(table_depth(d, inside), ["pair_id", "name"], "full").select("pair_id", "name", F.lit("table").alias("kind"), F.lit("added").alias("change"), "parts", "depth")
        out = rows.unionByName(inside.withColumn("change", F.lit("inside")), allowMissingColumns=True)
        schema_comments = d.namespace_comments().select("pair_id", "kind", "name", F.lit("modified").alias("change"), F.col("target").alias("schema_comment"))
        out = out.join(more, ["pair_id", "kind", "name", "change"], "left").unionByName(schema_comments, allowMissingColumns=True)
        return out.join(schemas, "pair_id")

    def collect(self) -> DataFrame:
        self._drops()
        self._renames()
        self._creates()
        self._alters()
        if self.config.include_comments:
            self._comments()
        ops = F.flatten(F.array(*[F.coalesce(F.array_compact(r), F.array().cast(f"array<{_OP}>")).cast(f"array<{_OP}>") for r in self.rules]))
        return self.changes().select("pair_id", "schema", F.explode(ops).alias("op")).select("pair_id", "schema", "op.*")

    def _drops(self) -> None:
        c, name = self.config, F.col("name")
        exists, cascade = ("IF EXISTS " if c.if_exists else ""), (" CASCADE" if c.cascade else "")
        for rank, (kind, op, word, label) in enumerate((("view", "DropView", "VIEW", "view"), ("table", "DropTable", "TABLE", "table"), ("sequence", "DropSequence", "SEQUENCE", "sequence"), ("enum", "DropEnum", "TYPE", "enum type"))):
            self.add(self._is(kind, "removed"), op, "drop", kind, rank, text(f"DROP {word} {exists}", self._in(name), cascade), None, text(f"Drop {label} ", self._path("name")))
        con = "CONCURRENTLY " if c.concurrently else ""
        alter = text("ALTER TABLE ", self._in(F.col("table_name")))
        for sub, change, which in ((0, "removed", "s"), (3, "modified", "t")):
            own = self._is("index", change) & ~F.col(f"{which}.index.is_constraint_index")
            self.add(own, "DropIndex", "drop", "index", 4, text(f"DROP INDEX {con}{exists}", self._in(name), cascade), None, text("Drop index ", self._path("name")), sub=sub)
        for sub, change in ((1, "removed"), (2, "modified")):
            self.add(self._is("constraint", change), "DropConstraint", "drop", "constraint", 4, text(alter, f" DROP CONSTRAINT {exists}", self._q(name), cascade), None, text("Drop constraint ", self._path("table_name", "name")), sub=sub)
        self.add(self._is("column", "removed"), "DropColumn", "drop", "table", 4, text(alter, f" DROP COLUMN {exists}", self._q(name), cascade), None, text("Drop column ", self._path("table_name", "name")), sub=4)

    def _renames(self) -> None:
        name, to = F.col("name"), F.col("to_name")
        for rank, (kind, op, word, label) in enumerate((("table", "RenameTable", "TABLE", "table"), ("enum", "RenameEnum", "TYPE", "enum type"),
                ("sequence", "RenameSequence", "SEQUENCE", "sequence"), ("view", "RenameView", "VIEW", "view"), ("index", "RenameIndex", "INDEX", "index"))):
            say = lambda a, b, w=word: text(f"ALTER {w} ", self._in(a), " RENAME TO ", self._q(b))
            self.add(self._is(kind, "renamed"), op, "rename", kind, 10 + rank, say(name, to), say(to, name), text(f"Rename {label} ", self._path("name"), " to ", to))
        for sub, (kind, op, word, rank) in enumerate((("column", "RenameColumn", "COLUMN", "table"), ("constraint", "RenameConstraint", "CONSTRAINT", "constraint"))):
            say = lambda a, b, w=word: text("ALTER TABLE ", self._in(F.col("table_name")), f" RENAME {w} ", self._q(a), " TO ", self._q(b))
            self.add(self._is(kind, "renamed"), op, "rename", rank, 15 + sub, say(name, to), say(to, name), text(f"Rename {word.lower()} ", self._path("table_name", "name"), " to ", to))

    def _creates(self) -> None:
        c, q, name, owner = self.config, self.config.quoting, F.col("name"), self._in(F.col("table_name"))
        fresh, exists = ("IF NOT EXISTS " if c.if_not_exists else ""), ("IF EXISTS " if c.if_exists else "")
        x = F.col("t.enum")
        labels = F.array_join(F.transform(x["labels"], literal), ", ")
        self.add(self._is("enum", "added"), "CreateEnum", "create", "enum", 20, text("CREATE TYPE ", self._in(name), " AS ENUM (", labels, ")"), text("DROP TYPE ", self._in(name)), text("Create enum type ", self._path("name")), F.to_json(x))
        one = lambda v, k: self._rule(F.lit(True), "AddEnumValue", "create", "enum", 21, text("ALTER TYPE ", self._in(name), " ADD VALUE ", literal(v)), None,
                text("Add value '", v, "' to enum ", self._path("name")), F.to_json(F.struct(v.alias("label"))), sub=k)
        more = F.filter(x["labels"], lambda v: ~F.array_contains(F.col("s.enum.labels"), v))
        self.rules.append(F.when(self._is("enum", "modified"), F.transform(more, one)))
        x = F.col("t.sequence")
        clauses = [text(f" {w} ", x[f].cast("string")) for w, f in (("START WITH", "start_value"), ("INCREMENT BY", "increment"), ("MINVALUE", "min_value"), ("MAXVALUE", "max_value"), ("CACHE", "cache_size"))]
        make = F.concat(text(f"CREATE SEQUENCE {fresh}", self._in(name), " AS ", x["data_type"]), *clauses, F.when(x["is_cyclic"], " CYCLE").otherwise(" NO CYCLE"))
        self.add(self._is("sequence", "added"), "CreateSequence", "create", "sequence", 22, make, text("DROP SEQUENCE ", self._in(name)), text("Create sequence ", self._path("name")), F.to_json(x))
        self._create_tables(fresh, exists)
        x = F.col("t.column")
        make = text("ALTER TABLE ", owner, " ADD COLUMN ", column_definition(x, q))
        self.add(self._is("column", "added"), "AddColumn", "create", "table", 26, make, text("ALTER TABLE ", owner, " DROP COLUMN ", self._q(name)), text("Add column ", self._path("table_name", "name")), F.to_json(x), sub=x["position"])
        x = F.col("t.constraint")
        apart = self._is("constraint", "inside") & x["kind"].isin("FOREIGN KEY", "EXCLUDE")
        make = text("ALTER TABLE ", owner, " ADD CONSTRAINT ", self._q(name), " ", constraint_body(x, q))
        rank = F.when(F.col("change") == "inside", 24).otherwise(28)
        self.add(apart | self._is("constraint", "added", "modified"), "AddConstraint", "create", "constraint", rank, make,
                text("ALTER TABLE ", owner, " DROP CONSTRAINT ", self._q(name)), text("Add constraint ", self._path("table_name", "name")),
                F.to_json(x.dropFields("definition")))
        x = F.col("t.index")
        con, method = ("CONCURRENTLY " if c.concurrently else ""), F.when(x["method"] == "btree", "").otherwise(text(" USING ", x["method"]))
        columns = F.array_join(F.transform(x["columns"], lambda i: index_column(i, q)), ", ")
        make = F.concat(F.lit("CREATE "), F.when(x["is_unique"], "UNIQUE ").otherwise(""), text(f"INDEX {con}{fresh}", self._q(name), " ON ", owner), method, text(" (", columns, ")"), F.coalesce(text(" WHERE ", x["predicate"]), F.lit("")))
        rank = F.when(F.col("change") == "inside", 25).otherwise(29)
        own = self._is("index", "inside", "added", "modified") & ~x["is_constraint_index"]
        self.add(own, "CreateIndex", "create", "index", rank, make, text(f"DROP INDEX {con}{exists}", self._in(name)), text("Create index ", self._path("name"), " on ", F.col("table_name")), F.to_json(x))
        x = F.col("t.view")
        word = F.when(x["is_materialized"], "MATERIALIZED VIEW").otherwise("VIEW")
        self.add(self._is("view", "added"), "CreateView", "create", "view", 30, text("CREATE ", word, " ", self._in(name), " AS ", x["definition"]),
                text("DROP ", word, " ", self._in(name)), text("Create ", F.lower(word), " ", self._path("name")), F.to_json(x))

    def _create_tables(self, fresh: str, exists: str) -> None:
        x, name, parts = F.col("t.table"), F.col("name"), F.coalesce("parts", F.array().cast("array<struct<a:int,b:int,c:string,line:string,json:string>>"))
        lines = F.array_join(F.transform(parts, lambda v: text("    ", v["line"])), ",\n")
        of = lambda k: F.transform(F.filter(parts, lambda v: v["a"] == k), lambda v: v["json"])
        payload = F.to_json(F.struct(x["kind"].alias("kind"), x["comment"].alias("comment"), of(0).alias("columns"), of(1).alias("constraints")))
        cascade = " CASCADE" if self.config.cascade else ""
        self.add(self._is("table", "added"), "CreateTable", "create", "table", 23, text(f"CREATE TABLE {fresh}", self._in(name), " (\n", lines, "\n)"),
                text(f"DROP TABLE {exists}", self._in(name), cascade), text("Create table ", self._path("name")), payload, sub=F.coalesce("depth", F.lit(0)))

    def _alters(self) -> None:
        s, x = F.col("s.column"), F.col("t.column")
        owner, name = self._in(F.col("table_name")), self._q(F.col("name"))
        head = text("ALTER TABLE ", owner, " ALTER COLUMN ", name)
        diff = lambda f: ~s[f].eqNullSafe(x[f])
        note = text("-- Cannot add GENERATED to existing column; need DROP + ADD\n-- ALTER TABLE ", owner, " DROP COLUMN ", name, ";\n-- ALTER TABLE ", owner,
                " ADD COLUMN ", name, " ... GENERATED ALWAYS AS (", x["generated"]["expression"], ") STORED")
        forward = F.array_compact(F.array(
            F.when(diff("type"), text(head, " TYPE ", x["type"]["formatted"])),
            F.when(diff("is_nullable"), F.when(x["is_nullable"], text(head, " DROP NOT NULL")).otherwise(text(head, " SET NOT NULL"))),
            F.when(diff("default_expr"), F.when(x["default_expr"].isNull(), text(head, " DROP DEFAULT")).otherwise(text(head, " SET DEFAULT ", x["default_expr"]))),
            F.when(diff("identity"), F.when(x["identity"].isNull(), text(head, " DROP IDENTITY IF EXISTS")).otherwise(text(head, " ADD GENERATED ", x["identity"], " AS IDENTITY"))),
            F.when(diff("generated"), F.when(x["generated"].isNull(), text(head, " DROP EXPRESSION")).otherwise(note)),
        ))
        changed = self._is("column", "modified") & (diff("type") | diff("is_nullable") | diff("default_expr") | diff("identity") | diff("generated"))
        keep = F.to_json(F.struct(*[F.when(diff(f), F.struct(x[f].alias("to"))).alias(f) for f in ("type", "is_nullable", "default_expr", "identity", "generated")]))
        self.add(changed, "AlterColumn", "alter", "table", 27, forward, None, text("Alter column ", self._path("table_name", "name")), keep, many=True)
        s, x = F.col("s.sequence"), F.col("t.sequence")
        diff = lambda f: ~s[f].eqNullSafe(x[f])
        clause = lambda word, f: F.when(diff(f), text(f"{word} ", x[f].cast("string")))
        clauses = F.array_compact(F.array(clause("AS", "data_type"), clause("INCREMENT BY", "increment"), clause("MINVALUE", "min_value"),
                clause("MAXVALUE", "max_value"), clause("START WITH", "start_value"), clause("CACHE", "cache_size"),
                F.when(diff("is_cyclic"), F.when(x["is_cyclic"], "CYCLE").otherwise("NO CYCLE"))))
        self.add(self._is("sequence", "modified") & (F.size(clauses) > 0), "AlterSequence", "alter", "sequence", 22,
                text("ALTER SEQUENCE ", self._in(F.col("name")), " ", F.array_join(clauses, " ")), None, text("Alter sequence ", self._path("name")), F.to_json(x))

    def _comments(self) -> None:
        now, changed = F.col("schema_comment"), F.col("kind") == "namespace"
        for kind in ("table", "column", "constraint", "index", "view", "sequence", "enum"):
            old, new = F.col(f"s.{kind}.comment"), F.col(f"t.{kind}.comment")
            here = self._is(kind, "modified")
            changed = changed | (here & ~old.eqNullSafe(new))
            now = F.when(here, new).otherwise(now)
        on = (
            F.when(F.col("kind") == "namespace", text("SCHEMA ", self._q(F.col("name"))))
            .when(F.col("kind") == "column", text("COLUMN ", self._in(F.col("table_name")), ".", self._q(F.col("name"))))
            .when(F.col("kind") == "constraint", text("CONSTRAINT ", self._q(F.col("name")), " ON ", self._in(F.col("table_name"))))
            .otherwise(text(F.when(F.col("kind") == "enum", "TYPE").otherwise(F.upper("kind")), " ", self._in(F.col("name"))))
        )
        sql = text("COMMENT ON ", on, " IS ", F.coalesce(literal(now), F.lit("NULL")))
        verb = F.when(now.isNull(), "Remove").otherwise("Set")
        self.add(changed, "SetComment", "comment", "comment", 40, sql, None, text(verb, " comment on ", F.col("kind"), " ", F.concat_ws(".", F.col("table_name"), F.col("name"))), F.to_json(F.struct("kind", now.alias("comment"))))


def table_depth(diff: Diff, inside: DataFrame | None = None) -> DataFrame:
    """pair_id, name, depth of every added table: 1 more than the deepest added table that it refers to.

    References to itself don't count.  ``inside``: the objects of added tables, where they are at hand.
    """
    added = diff.objects("table").filter("change = 'added'").select("pair_id", "name")
    if inside is None:
        inside = diff.everything().filter("kind = 'constraint' AND t IS NOT NULL").join(added.withColumnRenamed("name", "table_name"), ["pair_id", "table_name"], "left_semi")
    refs = inside.select("pair_id", F.col("table_name").alias("a"), "t.constraint.kind", F.col("t.constraint.ref_table").alias("b")).filter("kind = 'FOREIGN KEY' AND a <> b")
    return depths(added, refs.select("pair_id", "a", "b").distinct().join(added.withColumnRenamed("name", "b"), ["pair_id", "b"], "left_semi"))


def depths(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """pair_id, name, depth, from tables (pair_id, name) and edges (pair_id, a refers to b).

    Rounds of joins raise depths until none grows; a pair's cycles end after a round more than it has tables.
    """
    tables, edges = kept(tables.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pair_id")))), kept(edges)
    now = tables.select("pair_id", "name", "n", F.lit(0).alias("depth"))
    if edges.isEmpty():
        return now.drop("n")
    rounds = 0
    while True:
        rounds += 1
        below = edges.join(now.select("pair_id", F.col("name").alias("b"), "depth"), ["pair_id", "b"]).groupBy("pair_id", F.col("a").alias("name")).agg((F.max("depth") + 1).alias("next"))
        new = F.when(F.lit(rounds) <= F.col("n") + 1, F.coalesce("next", F.lit(0))).otherwise(F.col("depth"))
        now = kept(now.join(below, ["pair_id", "name"], "left").withColumn("grew", new != F.col("depth")).withColumn("depth", new).drop("next"))
        if now.filter("grew").isEmpty():
            return now.select("pair_id", "name", "depth")
        now = now.drop("grew")


def ordered(ops: DataFrame) -> DataFrame:
    """Plan order: drops (dependents first), renames, creates (enums, sequences, tables by depth, columns,
    indexes and constraints, views), alters, comments; the collecting order within."""
    kind = F.col("object_kind")
    create = F.when(kind <= 1, kind).when(F.col("op_kind") == "CreateTable", 2).when(kind == 2, 3).when(kind == 3, 9).otherwise(kind + 1)
    major = F.when(F.col("phase") == 1, -kind).when(F.col("phase") == 3, create).otherwise(kind)
    depth = F.when(F.col("op_kind") == "CreateTable", F.col("r2")).otherwise(0)
    w = Window.partitionBy("pair_id").orderBy("phase", major, depth, "r1", "table_name", "r2", "name")
    return ops.withColumn("seq", F.row_number().over(w)).drop("r1", "r2")


def plan(diff: Diff, config: RenderConfig = RenderConfig()) -> DataFrame:  # noqa: B008
    return ordered(Collector(diff, config).collect())


def inverse(plan_: DataFrame) -> DataFrame:
    """Down operations in reverse order; a plan with one irreversible operation has none and lists it instead."""
    kind, back = F.lit(None).cast("string"), F.col("op_kind").isin(*IRREVERSIBLE)
    for k, v in REVERSIBLE.items():
        kind = F.when(F.col("op_kind") == k, v).otherwise(kind)
    swap = F.col("op_kind").startswith("Rename")
    w = Window.partitionBy("pair_id")
    rows = plan_.withColumn("stuck", F.max(back.cast("int")).over(w) == 1).withColumn("irreversible", back)
    kept = rows.filter(~F.col("stuck")).select(
        "pair_id", F.row_number().over(w.orderBy(F.desc("seq"))).alias("seq"), kind.alias("op_kind"), "table_name",
                F.when(swap, F.col("to_name")).otherwise(F.col("name")).alias("name"), F.when(swap, F.col("name")).alias("to_name"),
                F.lit(None).cast("string").alias("error")
    )
    failed = rows.filter("stuck AND irreversible").select("pair_id", "seq", "op_kind", "table_name", "name", "to_name", F.concat(F.lit("cannot revert "), "op_kind").alias("error"))
    return kept.unionByName(failed)


def script(plan_: DataFrame) -> DataFrame:
    """pair_id, sql, rollback_sql, n_statements: one transaction each; the rollback runs backwards."""
    s = F.struct("seq", "description", "forward", "rollback")
    g = plan_.groupBy("pair_id").agg(F.array_sort(F.collect_list(s), lambda a, b: a["seq"] - b["seq"]).alias("ops"))
    body = F.array_join(F.transform("ops", lambda o: F.concat(F.lit("-- "), o["description"], F.lit("\n"), F.array_join(F.transform(o["forward"], lambda x: F.concat(x, F.lit(";\n"))), ""))), "\n")
    back = F.array_join(F.flatten(F.transform(F.reverse("ops"), lambda o: F.transform(F.coalesce(o["rollback"], F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(";\n"))))), "")
    return g.select("pair_id", F.concat(F.lit("BEGIN;\n\n"), body, F.lit("\nCOMMIT;\n")).alias("sql"), F.concat(F.lit("BEGIN;\n\n"), back, F.lit("\nCOMMIT;\n")).alias("rollback_sql"), F.size(F.flatten("ops.forward")).alias("n_statements"))


def replace_view(schema: str, name: str, definition: str) -> dict:
    """An operation that no diff emits; for callers of replay."""
    return {"op_kind": "ReplaceView", "schema": schema, "name": name, "payload": {"definition": definition}, "forward": [f"CREATE OR REPLACE VIEW {schema}.{name} AS {definition}"]}


def refresh_materialized_view(schema: str, name: str, concurrently: bool = False) -> dict:
    return {"op_kind": "RefreshMaterializedView", "schema": schema, "name": name, "payload": {}, "forward": [f"REFRESH MATERIALIZED VIEW {'CONCURRENTLY ' if concurrently else ''}{schema}.{name}"]}
