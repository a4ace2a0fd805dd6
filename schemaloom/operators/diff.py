"""Differences between pairs of snapshots, as joins over any number of pairs.

Objects are matched by name within their pair (and table) in one full outer
join per relation; fields are compared null-safely.  Renames come from a
similarity join of what was removed with what was added, then a greedy fold.

Everything is partitioned by pair_id (and table), so a fleet of pairs spreads
over the cluster; the fold sees one pair's (table's) candidates at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signatures
from ..functions import similarity as sim
from ..model import Catalog
from ..tables import kept


@dataclass(frozen=True)
class DiffConfig:
    """rename_threshold 1.0 turns rename detection off; it is held within 0 and 1."""

    rename_threshold: float = 0.5
    advanced: bool = False
    table_weights: sim.TableWeights = field(default_factory=sim.TableWeights)
    column_weights: sim.ColumnWeights = field(default_factory=sim.ColumnWeights)

    @staticmethod
    def with_threshold(x: float) -> DiffConfig:
        return DiffConfig(min(1.0, max(0.0, x)))

    @staticmethod
    def no_rename_detection() -> DiffConfig:
        return DiffConfig(1.0)

    @staticmethod
    def with_advanced_similarity() -> DiffConfig:
        return DiffConfig(advanced=True)


#: Compared fields of each kind; a nested value is compared and shown whole.
FIELDS = {
    "table": ["kind", "comment"],
    "column": ["position", "type", "is_nullable", "default_expr", "generated", "identity", "collation", "comment"],
    "constraint": ["definition", "comment"],
    "index": ["method", "is_unique", "is_constraint_index", "columns", "predicate", "comment"],
    "view": ["definition", "is_materialized", "comment"],
    "sequence": ["data_type", "start_value", "increment", "min_value", "max_value", "cache_size", "is_cyclic", "comment"],
    "enum": ["labels", "comment"],
}
_PAYLOAD = ["kind", "columns", "ref_schema", "ref_table", "ref_columns", "on_delete", "on_update", "is_deferrable", "is_initially_deferred", "expression", "is_no_inherit", "nulls_not_distinct", "elements", "index_method", "predicate"]
RELATIONS = {"table": "tables", "column": "columns", "constraint": "constraints", "index": "indexes", "view": "views", "sequence": "sequences", "enum": "enums"}
IN_TABLE = ("column", "constraint", "index")


def shown(c: Column, kind) -> Column:
    """A field as text: nested ones as JSON."""
    name = kind.simpleString()
    return F.to_json(c) if name.startswith(("struct", "array")) else c.cast("string")


_SELF = {
    "table": ["name", "kind", "comment", "columns", "constraints", "indexes"],
    "column": ["name", "position", "type", "is_nullable", "default_expr", "generated", "identity", "collation", "comment"],
    "constraint": ["name", *_PAYLOAD, "definition", "comment"],
    "index": ["name", "method", "is_unique", "is_constraint_index", "columns", "predicate", "comment"],
    "view": ["name", "definition", "is_materialized", "comment"],
    "sequence": ["name", "data_type", "start_value", "increment", "min_value", "max_value", "cache_size", "is_cyclic", "comment"],
    "enum": ["name", "labels", "comment"],
}


def _whole_tables(catalog: Catalog) -> DataFrame:
    """Tables with their columns, constraints and indexes as arrays in name order."""
    out = catalog.tables.withColumn("name", F.col("table_name"))
    parts = (("columns", ["name", "type"]), ("constraints", ["name", "kind", "columns", "ref_table"]), ("indexes", ["name", "method", "is_unique", "is_constraint_index", "columns", "predicate"]))
    for relation, cols in parts:
        by_name = lambda x, y: F.when(x["name"] < y["name"], -1).when(x["name"] > y["name"], 1).otherwise(0)
        items = getattr(catalog, relation).groupBy("snapshot_id", "table_name").agg(F.array_sort(F.collect_list(F.struct(*cols)), by_name).alias(relation))
        out = out.join(items, ["snapshot_id", "table_name"], "left")
        out = out.withColumn(relation, F.coalesce(relation, F.array().cast(out.schema[relation].dataType)))
    return out


def objects_of(catalog: Catalog) -> DataFrame:
    """All objects of all snapshots in one frame: snapshot_id, kind, table_name, name, o.

    o has one field for each kind, a struct of the object's own fields, null but for its kind.
    """
    frames = {}
    for kind, relation in RELATIONS.items():
        df = _whole_tables(catalog) if kind == "table" else getattr(catalog, relation)
        if kind == "constraint":
            df = df.withColumn("definition", F.struct(*_PAYLOAD))
        table = F.col("table_name") if kind in IN_TABLE else F.lit(None).cast("string")
        frames[kind] = df.select("snapshot_id", F.lit(kind).alias("kind"), table.alias("table_name"), F.col("name"), F.struct(*_SELF[kind]).alias(kind))
    types = {k: f.schema[k].dataType for k, f in frames.items()}
    out = None
    for kind, f in frames.items():
        o = F.struct(*[(F.col(k) if k == kind else F.lit(None).cast(types[k])).alias(k) for k in RELATIONS])
        f = f.select("snapshot_id", "kind", "table_name", "name", o.alias("o"))
        out = f if out is None else out.unionByName(f)
    return out


class ObjectStore:
    """All objects by content: each one once, under its digest, and snapshots as sets of digests.

    contents: digest, o.  members: snapshot_id, kind, table_name, name, digest.  What a fleet of snapshots shares is held, and
    travels, once; comparing two snapshots needs digests alone.
    """

    def __init__(self, catalog: Catalog) -> None:
        own = F.concat(F.col("kind"), F.lit(":"), F.to_json("o"))
        rows = kept(objects_of(catalog).withColumn("digest", F.sha2(own, 256)))
        self.members = rows.drop("o")
        self.contents = kept(rows.groupBy("digest").agg(F.first("o").alias("o")))


KEY = ["pair_id", "kind", "table_name", "name"]


class Diff:
    """All differences of the given pairs.  What everything else is built on (all objects side by side, and
    what became of each) is computed once and kept as a table."""

    def __init__(self, catalog: Catalog, pairs: DataFrame, config: DiffConfig = DiffConfig()) -> None:  # noqa: B008
        self.catalog, self.pairs, self.config = catalog, pairs, config
        self._stored: ObjectStore | None = None
        self._made: dict[str, DataFrame] = {}

    def _once(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._made:
            self._made[key] = kept(make())
        return self._made[key]

    @property
    def store(self) -> ObjectStore:
        if self._stored is None:
            self._stored = ObjectStore(self.catalog)
        return self._stored

    def everything(self) -> DataFrame:
        """pair_id, kind, table_name, name, s, t, in_both: every object that isn't the same on both sides, matched by name, and every table with one.

        Sides are compared by digest, in one shuffle by key for all kinds; only objects that differ are fetched, each by its digest.
        in_both: both snapshots hold its table.
        """

        def make() -> DataFrame:
            which = F.explode(F.array(F.struct(F.lit(True).alias("src"), F.col("source_id").alias("snapshot_id")), F.struct(F.lit(False).alias("src"), F.col("target_id").alias("snapshot_id"))))
            ends = self.pairs.select("pair_id", which.alias("w")).select("pair_id", "w.src", "w.snapshot_id")
            side = lambda src: F.max(F.when(F.col("src") == src, F.col("digest")))
            sides = kept(self.store.members.join(ends, "snapshot_id").groupBy(*KEY).agg(side(True).alias("sd"), side(False).alias("td")))
            # what differs, and the tables in which something does
            other = sides.filter("NOT sd <=> td")
            tables = sides.filter("kind = 'table'")
            touched = other.filter(F.col("kind").isin(*IN_TABLE)).select("pair_id", F.col("table_name").alias("name")).distinct()
            rows = other.unionByName(tables.filter("sd = td").join(touched, ["pair_id", "name"], "left_semi").select(*other.columns))
            both = tables.filter("sd IS NOT NULL AND td IS NOT NULL").select("pair_id", F.col("name").alias("table_name"), F.lit(True).alias("in_both"))
            rows = rows.join(both, ["pair_id", "table_name"], "left")
            for d, o in (("sd", "s"), ("td", "t")):
                rows = rows.join(self.store.contents.select(F.col("digest").alias(d), F.col("o").alias(o)), d, "left")
            return rows.select(*KEY, "s", "t", F.coalesce("in_both", F.lit(False)).alias("in_both"))

        return self._once("everything", make)

    def sides(self) -> DataFrame:
        """The objects that are compared: those in tables only where both snapshots hold the table."""
        return self.everything().filter(F.col("in_both") | ~F.col("kind").isin(*IN_TABLE)).drop("in_both")

    def matched(self, kind: str) -> DataFrame:
        """pair_id, table_name, name, s, t of one kind, s and t being structs of its own fields."""
        return self.sides().filter(F.col("kind") == kind).select("pair_id", "table_name", "name", F.col(f"s.{kind}").alias("s"), F.col(f"t.{kind}").alias("t"))

    def fields(self, kind: str) -> DataFrame:
        """Changed fields of one kind."""
        return self.all_fields().filter(F.col("kind") == kind)

    def gone(self, kind: str, which: str) -> DataFrame:
        """Removed (which = s) or added (t) objects, renames not yet taken out."""
        other = "t" if which == "s" else "s"
        return self.matched(kind).filter(F.col(other).isNull()).select("pair_id", "table_name", "name", F.col(which).alias("x"))

    def _score(self) -> Column:
        c, table = self.config, (F.col("s.table"), F.col("t.table"))
        scores = {
            "table": sim.table_advanced(*table, c.table_weights) if c.advanced else sim.table_basic(*table),
            "column": sim.column_advanced("s.column", "t.column", c.column_weights) if c.advanced else sim.column_basic("s.column", "t.column"),
            "constraint": sim.constraint("s.constraint", "t.constraint"),
            "index": sim.index(F.col("s.index"), F.col("t.index")),
            "view": sim.view("s.view", "t.view"),
            "sequence": sim.sequence("s.sequence", "t.sequence"),
            "enum": sim.enum("s.enum", "t.enum"),
        }
        out = F.lit(None).cast("double")
        for kind, score in scores.items():
            out = F.when(F.col("kind") == kind, score).otherwise(out)
        return out

    def similarities(self) -> DataFrame:
        """Similarity of every removed object with every added one of its pair, kind and table."""
        k, owner = self.sides(), F.coalesce("table_name", F.lit(""))
        a = k.filter("t IS NULL").select("pair_id", "kind", owner.alias("owner"), F.col("name").alias("from_name"), "s")
        b = k.filter("s IS NULL").select("pair_id", "kind", owner.alias("owner"), F.col("name").alias("to_name"), "t")
        return a.join(b, ["pair_id", "kind", "owner"]).select("pair_id", "kind", F.nullif("owner", F.lit("")).alias("table_name"), "from_name", "to_name", self._score().alias("similarity"))

    def _ends(self, which: str) -> DataFrame:
        """Removed (s) or added (t) objects with the tokens that a similar one must share."""
        rows = self.sides().filter(F.col("t" if which == "s" else "s").isNull())
        found = F.lit(None).cast("array<string>")
        for kind in RELATIONS:
            own = signatures.tokens(kind, F.col(f"{which}.{kind}"), self.config.rename_threshold, self.config.advanced, which == "t")
            found = F.when(F.col("kind") == kind, own).otherwise(found)
        return rows.select("pair_id", "kind", F.coalesce("table_name", F.lit("")).alias("owner"), F.col("name").alias(f"{which}_name"), F.col(which), found.alias(f"{which}_tokens"))

    def looked_at(self) -> DataFrame:
        """pair_id, kind, owner, s_name, t_name: removed and added objects that share a token, each two once, at the first one shared."""
        key = ["pair_id", "kind", "owner", "token"]
        sides = [self._ends(w).drop(w).withColumn("token", F.explode(f"{w}_tokens")) for w in ("s", "t")]
        return sides[0].join(sides[1], key).filter(F.array_min(F.array_intersect("s_tokens", "t_tokens")) == F.col("token")).select("pair_id", "kind", "owner", "s_name", "t_name")

    def candidates(self) -> DataFrame:
        """Pairs similar enough for a rename; none at a threshold of 1.

        Only names and tokens meet in the join; objects are fetched for the pairs that share a token, and scored.
        """
        if self.config.rename_threshold >= 1.0:
            return self.similarities().filter(F.lit(False))
        at = ["pair_id", "kind", "owner"]
        rows = self.looked_at().join(self._ends("s").drop("s_tokens"), [*at, "s_name"]).join(self._ends("t").drop("t_tokens"), [*at, "t_name"])
        scored = rows.select("pair_id", "kind", F.nullif("owner", F.lit("")).alias("table_name"), F.col("s_name").alias("from_name"), F.col("t_name").alias("to_name"), self._score().alias("similarity"))
        return scored.filter(F.col("similarity") >= self.config.rename_threshold)

    def renames(self) -> DataFrame:
        """Greedy matching: best similarity first (ties by name), each object in one rename at most."""
        return self._once("renames", lambda: greedy(self.candidates()))

    def changes(self) -> DataFrame:
        """pair_id, kind, table_name, name, change (added, removed, modified, renamed), to_name, similarity, s, t."""

        def make() -> DataFrame:
            ren = self.renames()
            owner = F.coalesce("table_name", F.lit(""))
            ends = ren.select("pair_id", "kind", owner.alias("owner"),
                    F.explode(F.array(F.struct(F.col("from_name").alias("name"), F.lit(True).alias("src"), "to_name", "similarity"),
                    F.struct(F.col("to_name").alias("name"), F.lit(False).alias("src"), "to_name", "similarity"))).alias("e")).select("pair_id", "kind", "owner",
                    F.col("e.name").alias("name"), F.col("e.src").alias("src"), F.col("e.to_name").alias("to_name"), F.col("e.similarity").alias("similarity"))
            rows = self.sides().withColumn("owner", owner).withColumn("src", F.when(F.col("t").isNull(), True).when(F.col("s").isNull(), False))
            rows = rows.join(ends, ["pair_id", "kind", "owner", "name", "src"], "left")
            # a table is modified if anything in it is
            inside = self.sides().filter(F.col("kind").isin(*IN_TABLE) & ~self._same()).select("pair_id", F.col("table_name").alias("name"), F.lit("table").alias("kind"), F.lit(True).alias("touched")).distinct()
            rows = rows.join(inside, ["pair_id", "kind", "name"], "left")
            both = F.col("s").isNotNull() & F.col("t").isNotNull()
            change = F.when(both, F.when(~self._same() | F.col("touched"), "modified")).when(F.col("to_name").isNotNull(), F.when(F.col("src"), "renamed")).when(F.col("src"), "removed").otherwise("added")
            return rows.withColumn("change", change).filter("change IS NOT NULL").select(*KEY, "change", "to_name", "similarity", "s", "t")

        return self._once("changes", make)

    def _same(self) -> Column:
        """Whether both sides are there and no compared field differs."""
        out = F.lit(True)
        for kind, names in FIELDS.items():
            for f in names:
                out = out & F.col(f"s.{kind}.{f}").eqNullSafe(F.col(f"t.{kind}.{f}"))
        return F.col("s").isNotNull() & F.col("t").isNotNull() & out

    def objects(self, kind: str) -> DataFrame:
        """pair_id, kind, table_name, name, change, to_name, similarity of one kind."""
        return self.all_objects().filter(F.col("kind") == kind)

    def all_objects(self) -> DataFrame:
        return self.changes().drop("s", "t")

    def all_fields(self) -> DataFrame:
        """pair_id, kind, table_name, name, field, source, target of every changed field of every kind."""
        m = self.sides().filter("s IS NOT NULL AND t IS NOT NULL")
        changed = []
        for kind, names in FIELDS.items():
            types = {f.name: f.dataType for f in m.schema["s"].dataType[kind].dataType.fields}
            changed += [F.when((F.col("kind") == kind) & ~F.col(f"s.{kind}.{f}").eqNullSafe(F.col(f"t.{kind}.{f}")),
                    F.struct(F.lit(f).alias("field"), shown(F.col(f"s.{kind}.{f}"), types[f]).alias("source"),
                    shown(F.col(f"t.{kind}.{f}"), types[f]).alias("target"))) for f in names]
        out = m.select(*KEY, F.explode(F.array_compact(F.array(*changed))).alias("c")).select(*KEY, "c.field", "c.source", "c.target")
        return out.unionByName(self.namespace_comments())

    def namespace_comments(self) -> DataFrame:
        ns = self.catalog.namespaces
        a = ns.join(self.pairs, ns["snapshot_id"] == F.col("source_id")).select("pair_id", F.col("schema").alias("name"), F.col("comment").alias("source"))
        b = ns.join(self.pairs, ns["snapshot_id"] == F.col("target_id")).select("pair_id", F.col("comment").alias("target"))
        null = F.lit(None).cast("string")
        return a.join(b, "pair_id").filter(~F.col("source").eqNullSafe(F.col("target"))).select("pair_id", F.lit("namespace").alias("kind"), null.alias("table_name"), "name", F.lit("comment").alias("field"), "source", "target")

    def enum_changes(self) -> DataFrame:
        """values_added (target order), values_removed (source order), reordered (order of the common ones)."""
        s, t = F.col("s.labels"), F.col("t.labels")
        common = lambda a, b: F.filter(a, lambda v: F.array_contains(b, v))
        without = lambda a, b: F.filter(a, lambda v: ~F.array_contains(b, v))
        out = self.matched("enum").filter("s IS NOT NULL AND t IS NOT NULL").select("pair_id", "name", without(t, s).alias("values_added"), without(s, t).alias("values_removed"), (common(s, t) != common(t, s)).alias("reordered"))
        return out.filter((F.size("values_added") > 0) | (F.size("values_removed") > 0) | F.col("reordered"))

    def summary(self) -> DataFrame:
        """Counts by pair, kind and change, as columns."""
        count = lambda c: F.sum(F.when(F.col("change") == c, 1).otherwise(0)).alias(c)
        return self.all_objects().groupBy("pair_id", "kind").agg(*[count(c) for c in ("added", "removed", "modified", "renamed")])

    def change_count(self) -> DataFrame:
        """Top-level changes of each pair (objects in tables count as part of their table); pairs without any are empty."""
        n = self.all_objects().filter(~F.col("kind").isin(*IN_TABLE)).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
        return self.pairs.select("pair_id").join(n, "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("n_changes"), F.col("n").isNull().alias("is_empty"))

    def drift(self) -> DataFrame:
        """Sorted names of each pair, kind and change."""
        name = F.concat_ws(".", "table_name", "name")
        label = F.when(F.col("change") == "renamed", F.concat(name, F.lit(" -> "), "to_name")).otherwise(name)
        return self.all_objects().groupBy("pair_id", "kind", "change").agg(F.array_sort(F.collect_list(label)).alias("names"))


FOLD = 500  # candidates of one group that are matched in one array


def greedy(candidates: DataFrame) -> DataFrame:
    """Candidates kept by the greedy matching within pair, kind and table: best similarity first, ties by name.

    Groups of up to FOLD candidates are sorted and folded, each in an array of its own.  In larger ones a candidate that is the best
    of both its ends is what the greedy order reaches before anything else of them, so every round takes all of these at once and
    drops what else touches their ends; no such group's candidates are gathered in one row.
    """
    order = F.struct((-F.col("similarity")).alias("o"), F.col("from_name").alias("f"), F.col("to_name").alias("g"))
    group = ["pair_id", "kind", "owner"]
    rows = kept(candidates.select("*", F.coalesce("table_name", F.lit("")).alias("owner"), order.alias("order")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group))))
    large = rows.filter(F.col("n") > FOLD).drop("n")
    small = rows.filter(F.col("n") <= FOLD).groupBy(*group).agg(F.array_sort(F.collect_list("order")).alias("c"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("f"), none.alias("g"), F.array().cast("array<struct<o:double,f:string,g:string>>").alias("out"))
    met = lambda acc, x: F.array_contains(acc["f"], x["f"]) | F.array_contains(acc["g"], x["g"])
    taken = lambda acc, x: F.struct(F.array_append(acc["f"], x["f"]).alias("f"), F.array_append(acc["g"], x["g"]).alias("g"), F.array_append(acc["out"], x).alias("out"))
    folded = small.select(*group, F.explode(F.aggregate("c", start, lambda acc, x: F.when(met(acc, x), acc).otherwise(taken(acc, x)))["out"]).alias("x"))
    table = F.nullif("owner", F.lit("")).alias("table_name")
    out = folded.select("pair_id", "kind", table, F.col("x.f").alias("from_name"), F.col("x.g").alias("to_name"), (-F.col("x.o")).alias("similarity"))
    if large.isEmpty():
        return out
    return out.unionByName(_rounds(large))


def _rounds(rows: DataFrame) -> DataFrame:
    left, out = kept(rows), None
    while not left.isEmpty():
        best = lambda end: F.min("order").over(Window.partitionBy("pair_id", "kind", "owner", end))
        taken = kept(left.withColumn("a", best("from_name")).withColumn("b", best("to_name")).filter("order = a AND order = b").drop("a", "b"))
        out = taken if out is None else out.unionByName(taken)
        for end in ("from_name", "to_name"):
            left = left.join(taken.select("pair_id", "kind", "owner", end), ["pair_id", "kind", "owner", end], "left_anti")
        left = kept(left)
    return (left if out is None else out).select("pair_id", "kind", "table_name", "from_name", "to_name", "similarity")


def pairs_frame(spark: SparkSession, pairs: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(pairs, "pair_id string, source_id string, target_id string")


def diff_from_empty(catalog: Catalog, config: DiffConfig = DiffConfig()) -> Diff:  # noqa: B008
    """Every snapshot against nothing: all its objects are added."""
    ids = catalog.namespaces.select(F.col("snapshot_id").alias("pair_id"), F.lit("").alias("source_id"), F.col("snapshot_id").alias("target_id"))
    return Diff(catalog, ids, config)
