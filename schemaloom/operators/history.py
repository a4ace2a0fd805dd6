"""Recorded migration histories: chains, checkpoints, pending work, integrity.

A history frame has history_id, seq, id, parent_hash, resulting_hash and, where
an operator needs them, ops_hash, is_checkpoint, description and created_at.
All are windows or joins partitioned by history_id, so any number of histories
is one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .merkle import checksum

#: Fixed value: the hash before the first migration.
ZERO = "0" * 64


def _by_seq() -> WindowSpec:
    return Window.partitionBy("history_id").orderBy("seq")


def framed(*parts: Column) -> Column:
    """Bytes of a hash input: a domain and parts, each after its length, so that no two lists look alike."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def migration_id(parent: Column, ops_json: Column, description: Column) -> Column:
    return F.sha2(F.concat(F.lit("migration:"), framed(parent, ops_json, description)), 256)


def ops_hash(ops_json: Column) -> Column:
    """Of the operations alone; the description doesn't count."""
    return F.sha2(F.concat(F.lit("operations:"), ops_json), 256)


def state_hash(state_json: Column) -> Column:
    return F.sha2(F.concat(F.lit("state:"), state_json), 256)


def short(hash_: Column, n: int = 16) -> Column:
    return F.substring(hash_, 1, n)


def from_prefix(prefix: Column) -> Column:
    """A whole hash from its beginning, filled up with zeros."""
    return F.rpad(prefix, 64, "0")


def verify_chain(h: DataFrame) -> DataFrame:
    """history_id, ok, broken_seq, expected_parent, found_parent: the first migration whose parent isn't the hash before it."""
    want = F.coalesce(F.lag("resulting_hash").over(_by_seq()), F.lit(ZERO))
    rows = h.withColumn("want", want).withColumn("bad", F.col("want") != F.col("parent_hash"))
    first = F.min(F.when(F.col("bad"), F.struct("seq", "want", "parent_hash")))
    return rows.groupBy("history_id").agg(first.alias("b")).select("history_id", F.col("b").isNull().alias("ok"), F.col("b.seq").alias("broken_seq"), F.col("b.want").alias("expected_parent"), F.col("b.parent_hash").alias("found_parent"))


def nearest_checkpoint(h: DataFrame) -> DataFrame:
    """history_id, seq, checkpoint_seq (null if none), n_replayed: what it takes to rebuild the state at each migration."""
    at = F.last(F.when(F.col("is_checkpoint"), F.col("seq")), ignorenulls=True).over(_by_seq().rowsBetween(Window.unboundedPreceding, 0))
    return h.select("history_id", "seq", at.alias("checkpoint_seq")).withColumn("n_replayed", (F.col("seq") - F.coalesce("checkpoint_seq", F.lit(0))).cast("long"))


def ops_to_replay(ops: DataFrame, targets: DataFrame, h: DataFrame) -> DataFrame:
    """Operations after the nearest checkpoint up to each target (history_id, seq): a range join within the history."""
    t = targets.join(nearest_checkpoint(h), ["history_id", "seq"]).select("history_id", F.col("seq").alias("target"), F.coalesce("checkpoint_seq", F.lit(0)).alias("start"))
    return ops.join(t, "history_id").filter((F.col("seq") > F.col("start")) & (F.col("seq") <= F.col("target")))


def since(h: DataFrame, hash_: Column) -> DataFrame:
    """Migrations after the state with this hash: all for the zero hash, else from the first whose parent it is."""
    start = F.min(F.when(F.col("parent_hash") == hash_, F.col("seq"))).over(Window.partitionBy("history_id"))
    return h.withColumn("start", start).filter((hash_ == ZERO) | (F.col("seq") >= F.col("start"))).drop("start")


def current(h: DataFrame) -> DataFrame:
    """history_id, current_hash, n_migrations, next_seq."""
    return h.groupBy("history_id").agg(F.max_by("resulting_hash", "seq").alias("current_hash"), F.count(F.lit(1)).alias("n_migrations"), (F.max("seq") + 1).alias("next_seq"))


def pending(h: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations after the last applied one of their history; all where nothing is applied.

    applied: history_id, id of the current migration.  An id that the history
    doesn't hold gives one row with a null seq and an error.
    """
    at = h.select("history_id", "id", F.col("seq").alias("at"))
    now = applied.join(at, ["history_id", "id"], "left")
    unknown = now.filter("at IS NULL").select("history_id", F.lit(None).cast("long").alias("seq"), F.col("id"), F.lit("unknown migration").alias("error"))
    todo = h.join(now.select("history_id", "at", F.lit(True).alias("any")), "history_id", "left").filter(F.col("any").isNull() | (F.col("seq") > F.col("at")))
    return todo.select("history_id", F.col("seq").cast("long").alias("seq"), "id", F.lit(None).cast("string").alias("error")).unionByName(unknown)


def diverged(recorded: DataFrame, local: DataFrame) -> DataFrame:
    """Migrations that are in both but with other operations: history_id, id, recorded_hash, local_hash."""
    a = recorded.select("history_id", "id", F.col("ops_hash").alias("recorded_hash"))
    b = local.select("history_id", "id", F.col("ops_hash").alias("local_hash"))
    return a.join(b, ["history_id", "id"]).filter("recorded_hash <> local_hash")


def behind(recorded: DataFrame, local: DataFrame) -> DataFrame:
    """history_id, n_recorded, n_local where the database knows more migrations than the local history."""
    a = recorded.groupBy("history_id").agg(F.count(F.lit(1)).alias("n_recorded"))
    b = local.groupBy("history_id").agg(F.count(F.lit(1)).alias("n_local"))
    return a.join(b, "history_id", "left").select("history_id", "n_recorded", F.coalesce("n_local", F.lit(0)).alias("n_local")).filter("n_recorded > n_local")


def integrity(recorded: DataFrame, local: DataFrame, checksums: DataFrame) -> DataFrame:
    """history_id, schema_ok, first_diverged: schema drift (expected and live checksum) and the first divergence."""
    seq = local.select("history_id", "id", "seq")
    first = diverged(recorded, local).join(seq, ["history_id", "id"]).groupBy("history_id").agg(F.min("seq").alias("first_diverged"))
    return checksums.select("history_id", (F.col("expected") == F.col("live")).alias("schema_ok")).join(first, "history_id", "left")


def tail(h: DataFrame, n: int) -> DataFrame:
    """The last n migrations of each history in their order, with 1-based numbers."""
    number = F.row_number().over(_by_seq())
    back = F.row_number().over(Window.partitionBy("history_id").orderBy(F.desc("seq")))
    return h.withColumn("number", number).withColumn("back", back).filter(F.col("back") <= n).drop("back")


def show(h: DataFrame, prefix: str) -> DataFrame:
    """history_id, outcome (found, ambiguous, not_found), id of the migrations whose id begins with prefix."""
    hit = h.withColumn("hit", F.col("id").startswith(prefix)).groupBy("history_id").agg(F.sum(F.col("hit").cast("int")).alias("n"), F.min(F.when(F.col("hit"), F.col("id"))).alias("id"))
    return hit.select("history_id", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def duplicates(h: DataFrame, new: DataFrame) -> DataFrame:
    """Migrations to save whose id the history already holds."""
    return new.join(h.select("history_id", "id"), ["history_id", "id"], "left_semi")


def recordable(h: DataFrame, new: DataFrame) -> DataFrame:
    """New migrations with seq and ok: the parent must be the current hash of the history (the zero hash if it is empty)."""
    out = new.join(current(h), "history_id", "left")
    return out.select("history_id", "id", F.coalesce("next_seq", F.lit(1)).alias("seq"), (F.col("parent_hash") == F.coalesce("current_hash", F.lit(ZERO))).alias("ok"))


def unrecord(applied: DataFrame) -> DataFrame:
    """Applied migrations without the last one of each history, and which is then current."""
    last = F.max("seq").over(Window.partitionBy("history_id"))
    rest = applied.withColumn("last", last).filter("seq < last").drop("last")
    return rest.withColumn("is_current", F.col("seq") == F.max("seq").over(Window.partitionBy("history_id")))


def flags(h: DataFrame) -> DataFrame:
    """is_baseline (no operations), is_checkpoint, is_reversible and the number of operations; needs n_up, n_down."""
    return h.select("history_id", "seq", "id", (F.col("n_up") == 0).alias("is_baseline"), "is_checkpoint", ((F.col("n_up") == 0) | (F.col("n_down") > 0)).alias("is_reversible"), F.col("n_up").alias("operation_count"))


def is_applied(applied: DataFrame, asked: DataFrame) -> DataFrame:
    """history_id, id, is_applied of migrations asked for."""
    known = applied.select("history_id", "id").distinct().withColumn("is_applied", F.lit(True))
    return asked.join(known, ["history_id", "id"], "left").select("history_id", "id", F.coalesce("is_applied", F.lit(False)).alias("is_applied"))


def verify(stored: DataFrame, live: DataFrame) -> DataFrame:
    """history_id, outcome (ok, drifted, unknown) from history_id, checksum on both sides."""
    both = live.select("history_id", F.col("checksum").alias("live")).join(stored.select("history_id", F.col("checksum").alias("expected")), "history_id", "left")
    return both.select("history_id", "expected", "live", F.when(F.col("expected").isNull(), "unknown").when(F.col("expected") == F.col("live"), "ok").otherwise("drifted").alias("outcome"))


def initialise(catalog, existing: DataFrame, from_database: bool = True) -> DataFrame:
    """The first migration of every snapshot's history: history_id, seq, id, parent_hash, resulting_hash, is_checkpoint, error.

    From a database it is a baseline without operations whose state, a checkpoint, is what is there; an empty history has
    no migration (seq 0, the zero hash).  A history in ``existing`` (history_id) is an error, not begun anew.
    """
    sums = checksum(catalog).select(F.col("snapshot_id").alias("history_id"), "checksum")
    known = existing.select("history_id").distinct().withColumn("known", F.lit(True))
    rows = sums.join(known, "history_id", "left").withColumn("fresh", F.col("known").isNull())
    zero, fresh = F.lit(ZERO), F.col("fresh")
    seq, hash_ = (F.lit(1), F.col("checksum")) if from_database else (F.lit(0), zero)
    id_ = migration_id(zero, F.lit("[]"), F.lit("baseline")) if from_database else F.lit(None).cast("string")
    return rows.select(
        "history_id", F.when(fresh, seq).alias("seq"), F.when(fresh, id_).alias("id"), F.when(fresh, zero).alias("parent_hash"), F.when(fresh, hash_).alias("resulting_hash"),
        F.when(fresh, F.lit(from_database)).alias("is_checkpoint"), F.when(~fresh, "AlreadyInitialised").alias("error"),
    )


def read_migrations(spark, path: str) -> DataFrame:
    """Migrations to record, from JSON files: history_id, id, parent_hash, description, operations (JSON text)."""
    return spark.read.schema("history_id string, id string, parent_hash string, description string, operations string").json(path, multiLine=True)


def resources(catalog, h: DataFrame) -> DataFrame:
    """uri, mime_type, content: read-only JSON documents of every snapshot, every history and every migration."""
    mime = F.lit("application/json").alias("mime_type")
    cols = catalog.columns.groupBy("snapshot_id", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda c: c["name"]).alias("columns"))
    tables = catalog.tables.join(cols, ["snapshot_id", "table_name"],
            "left").groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct(F.col("table_name").alias("name"),
            F.coalesce("columns", F.array().cast("array<string>")).alias("columns")))).alias("t"))
    schemas = catalog.namespaces.join(tables, "snapshot_id", "left")
    out = schemas.select(F.concat(F.lit("schema/"), "snapshot_id").alias("uri"), mime, F.coalesce(F.to_json("t"), F.lit("[]")).alias("content"))
    listed = h.groupBy("history_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("m"))
    out = out.unionByName(listed.select(F.concat(F.lit("migrations/"), F.col("history_id").cast("string")).alias("uri"), mime, F.to_json("m").alias("content")))
    one = F.to_json(F.struct(F.col("history_id").cast("string").alias("history"), "seq", "id", "parent_hash", "resulting_hash"))
    return out.unionByName(h.select(F.concat(F.lit("migration/"), "id").alias("uri"), mime, one.alias("content")))
