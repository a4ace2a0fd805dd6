"""From a diff to a migration that can be recorded: operations, inverse, statements, hash; and its text for a runner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import RenderConfig
from ..operators import breaking, history
from ..operators.diff import Diff
from ..tables import kept
from .operations import IRREVERSIBLE, plan

#: Fixed value: what compiling says where source and target are alike.
NO_CHANGES = "NoChanges"


class NoChanges(ValueError):
    """Source and target are alike: there is nothing to compile."""


def statements(plan_: DataFrame) -> DataFrame:
    """pair_id, position (from 1), description, sql: what a migration runs, in its order."""
    each = plan_.select("pair_id", "seq", "description", F.posexplode("forward").alias("k", "sql"))
    return each.withColumn("position", F.row_number().over(Window.partitionBy("pair_id").orderBy("seq", "k"))).select("pair_id", "position", "description", "sql")


def compiled(diff: Diff, description: str = "", config: RenderConfig = RenderConfig()) -> DataFrame:  # noqa: B008
    """pair_id, id, parent_hash, ops_hash, operations (JSON), n_operations, n_statements, is_reversible, n_breaking, error.

    The parent is the checksum of the source.  A pair without changes has no operations and the error NoChanges.
    """
    ops = kept(plan(diff, config))
    op = F.struct("seq", F.to_json(F.struct("op_kind", "schema", "table_name", "name", "to_name", "payload")).alias("json"), F.size("forward").alias("n"), F.col("op_kind").isin(*IRREVERSIBLE).alias("stuck"))
    by_pair = ops.groupBy("pair_id").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    sums = history.checksum(diff.catalog).select(F.col("snapshot_id").alias("source_id"), "checksum")
    risks = breaking.analyse(diff).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_breaking"))
    rows = diff.pairs.select("pair_id", "source_id").join(by_pair, "pair_id", "left").join(sums, "source_id", "left").join(risks, "pair_id", "left")
    parent = F.coalesce("checksum", F.lit(history.ZERO))
    text = F.concat(F.lit("["), F.array_join(F.transform("ops", lambda o: o["json"]), ","), F.lit("]"))
    some = F.col("ops").isNotNull()
    return rows.select(
        "pair_id", F.when(some, history.migration_id(parent, text, F.lit(description))).alias("id"), parent.alias("parent_hash"), F.when(some, history.ops_hash(text)).alias("ops_hash"), text.alias("operations"),
        F.coalesce(F.size("ops"), F.lit(0)).alias("n_operations"), F.coalesce(F.aggregate("ops", F.lit(0), lambda n, o: n + o["n"]), F.lit(0)).alias("n_statements"),
        F.when(some, ~F.exists("ops", lambda o: o["stuck"])).alias("is_reversible"), F.coalesce("n_breaking", F.lit(0)).cast("long").alias("n_breaking"), F.when(~some, NO_CHANGES).alias("error"),
    )


def compile_one(diff: Diff, pair_id: str, description: str = "") -> dict:
    """One pair's migration with its statements; raises NoChanges."""
    row = compiled(diff, description).filter(F.col("pair_id") == pair_id).first()
    if row is None or row["error"] == NO_CHANGES:
        raise NoChanges(pair_id)
    sql = statements(plan(diff)).filter(F.col("pair_id") == pair_id).orderBy("position").collect()
    return row.asDict() | {"statements": [r["sql"] for r in sql]}


def describe(plan_: DataFrame, as_json: bool = False) -> DataFrame:
    """pair_id, output: what a migration is, as text or JSON."""
    g = plan_.groupBy("pair_id").agg(F.count(F.lit(1)).alias("operations"), F.sum(F.size("forward")).alias("statements"), (F.max(F.col("op_kind").isin(*IRREVERSIBLE).cast("int")) == 0).alias("reversible"))
    if as_json:
        return g.select("pair_id", F.to_json(F.struct(F.col("pair_id").alias("name"), "operations", "statements", "reversible")).alias("output"))
    yes = F.when(F.col("reversible"), "yes").otherwise("no")
    return g.select("pair_id", F.concat(F.lit("Migration: "), "pair_id", F.lit("\nOperations: "), F.col("operations").cast("string"), F.lit("\nStatements: "),
            F.col("statements").cast("string"), F.lit("\nReversible: "), yes, F.lit("\n")).alias("output"))


def show_sql(plan_: DataFrame, as_json: bool = False) -> DataFrame:
    """pair_id, output: the statements, each after its number and description, or as a JSON array."""
    s = F.struct("position", "description", "sql")
    g = statements(plan_).groupBy("pair_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    if as_json:
        return g.select("pair_id", F.to_json("s").alias("output"))
    line = lambda x: F.concat(F.lit("-- ["), x["position"].cast("string"), F.lit("/"), F.size("s").cast("string"), F.lit("] "), x["description"], F.lit("\n"), x["sql"], F.lit(";\n\n"))
    return g.select("pair_id", F.array_join(F.transform("s", line), "").alias("output"))


def execute(plan_: DataFrame, description: str = "") -> DataFrame:
    """pair_id, output: the statements for a host to run, between a head and an end line.  Nothing is run here."""
    head = F.concat(F.lit("-- Migration: "), "pair_id", F.lit(f"\n-- {description}\n\n"))
    return show_sql(plan_).select("pair_id", F.concat(head, "output", F.lit("-- Migration complete\n")).alias("output"))
