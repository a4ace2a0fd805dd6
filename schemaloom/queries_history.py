"""Registered queries over recorded histories: states at a point, tracker verbs, checks, beginnings, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle_plan, profile_sql, queries
from .operators import history
from .operators.diff import Diff
from .plans import operations, replay
from .registry import ORACLE_SQL, query
from .tables import kept

_CHAIN = """WITH e AS (SELECT user_id AS history_id, row_number() OVER w AS seq, sha256('m' || event_id) AS id, sha256('s' || event_id) AS resulting_hash, event_id,
 coalesce(lag(sha256('s' || event_id)) OVER w, repeat('0', 64)) AS parent_hash FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole history for every user: each event a migration."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sha = lambda p: F.sha2(F.concat(F.lit(p), F.col("event_id").cast("string")), 256)
    return e.select(F.col("user_id").alias("history_id"), F.row_number().over(w).alias("seq"), sha("m").alias("id"), sha("s").alias("resulting_hash"), F.coalesce(F.lag(sha("s")).over(w), F.lit(history.ZERO)).alias("parent_hash"), "event_id")


@query(lambda: oracle_plan.replayed_sql(source_seq=True))
def state_at_points(spark, sf_dir):
    """Two migrations for every pair: the source from nothing, then the plan.  The states after each, from the nearest checkpoint."""
    catalog = queries.catalog(spark, sf_dir)
    pairs = queries.pairs(spark, sf_dir)
    first = operations.plan(Diff(catalog, pairs.select("pair_id", F.lit("").alias("source_id"), F.col("source_id").alias("target_id"))))
    second = queries.plan(spark, sf_dir)
    ops = kept(first.withColumn("k", F.col("seq")).withColumn("seq", F.lit(1)).unionByName(second.withColumn("k", F.col("seq")).withColumn("seq", F.lit(2))).withColumnRenamed("pair_id", "history_id"))
    # some histories hold a checkpoint after their first migration
    stops = F.length("history_id") % 2 == 0
    h = pairs.select(F.col("pair_id").alias("history_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    h = kept(h.withColumn("is_checkpoint", (F.col("seq") == 1) & stops))
    stored = replay.state_of(catalog, pairs.select(F.col("source_id").alias("snapshot_id"))).join(pairs, F.col("snapshot_id") == F.col("source_id"))
    checkpoints = stored.select(F.col("pair_id").alias("history_id"), F.lit(1).alias("seq"), "state").filter(stops)
    states = replay.state_at(ops, h, checkpoints, h.select("history_id", "seq"))
    return replay.objects(kept(states), "history_id", "seq").withColumnRenamed("history_id", "pair_id")


@query(_CHAIN + " SELECT history_id, id, event_id % 4 <> 0 AS is_applied FROM e")
def tracker_applied(spark, sf_dir):
    h = _chain(spark, sf_dir)
    return history.is_applied(h.filter("event_id % 4 <> 0"), h.select("history_id", "id"))


@query(_CHAIN + ", l AS (SELECT history_id, max(seq) AS last FROM e GROUP BY 1) SELECT history_id, seq::INT AS seq, id, seq = last - 1 AS is_current FROM e JOIN l USING (history_id) WHERE seq < last")
def tracker_unrecord(spark, sf_dir):
    return history.unrecord(_chain(spark, sf_dir)).select("history_id", "seq", "id", "is_current")


@query(_CHAIN + ", l AS (SELECT history_id, max(seq) AS last FROM e GROUP BY 1) SELECT history_id, 'new' || history_id AS id, (last + 1)::INT AS seq, history_id % 3 <> 0 AS ok FROM l")
def record_migrations(spark, sf_dir):
    h = _chain(spark, sf_dir)
    new = history.current(h).select("history_id", F.concat(F.lit("new"), F.col("history_id").cast("string")).alias("id"), F.when(F.col("history_id") % 3 == 0, history.ZERO).otherwise(F.col("current_hash")).alias("parent_hash"))
    return history.recordable(h, new).select("history_id", "id", F.col("seq").cast("int").alias("seq"), "ok")


@query(_CHAIN + " SELECT history_id, id FROM e WHERE event_id % 5 = 0")
def record_duplicates(spark, sf_dir):
    h = _chain(spark, sf_dir)
    new = h.filter("event_id % 5 = 0").select("history_id", "id").unionByName(h.filter("event_id % 7 = 0").select("history_id", F.lit("unheard of").alias("id")))
    return history.duplicates(h, new)


@query(_CHAIN + " SELECT history_id, seq::INT AS seq, id, event_id % 4 = 0 AS is_baseline, event_id % 10 = 3 AS is_checkpoint, event_id % 4 = 0 OR event_id % 3 > 0 AS is_reversible, (event_id % 4)::BIGINT AS operation_count FROM e")
def migration_flags(spark, sf_dir):
    h = _chain(spark, sf_dir).withColumn("n_up", (F.col("event_id") % 4).cast("long")).withColumn("n_down", F.col("event_id") % 3).withColumn("is_checkpoint", F.col("event_id") % 10 == 3)
    return history.flags(h)


@query(_CHAIN + " SELECT id, left(id, 16) AS short, rpad(left(id, 8), 64, '0') AS filled, sha256('state:' || resulting_hash) AS of_state, sha256('operations:' || id) AS ops FROM e")
def hash_forms(spark, sf_dir):
    h = _chain(spark, sf_dir)
    return h.select("id", history.short(F.col("id")).alias("short"), history.from_prefix(F.substring("id", 1, 8)).alias("filled"), history.state_hash(F.col("resulting_hash")).alias("of_state"), history.ops_hash(F.col("id")).alias("ops"))


_LAST = ", l AS (SELECT history_id, arg_max(resulting_hash, seq) AS live FROM e GROUP BY 1)"


@query(_CHAIN + _LAST + " SELECT history_id, CASE WHEN history_id % 7 = 0 THEN sha256('drift') ELSE live END = live AS schema_ok, (SELECT min(seq) FROM e x WHERE x.history_id = l.history_id AND event_id % 13 = 0)::INT AS first_diverged FROM l")
def check_integrity(spark, sf_dir):
    h = _chain(spark, sf_dir).withColumn("ops_hash", F.col("id"))
    recorded = h.withColumn("ops_hash", F.when(F.col("event_id") % 13 == 0, "other").otherwise(F.col("ops_hash")))
    sums = history.current(h).select("history_id", F.col("current_hash").alias("live"), F.when(F.col("history_id") % 7 == 0, F.sha2(F.lit("drift"), 256)).otherwise(F.col("current_hash")).alias("expected"))
    return history.integrity(recorded, h, sums)


@query(_CHAIN + _LAST + ", s AS (SELECT history_id, live, CASE WHEN history_id % 5 = 0 THEN NULL WHEN history_id % 7 = 0 THEN sha256('drift') ELSE live END AS expected FROM l) SELECT history_id, expected, live, CASE WHEN expected IS NULL THEN 'unknown' WHEN expected = live THEN 'ok' ELSE 'drifted' END AS outcome FROM s")
def verify_checksums(spark, sf_dir):
    live = history.current(_chain(spark, sf_dir)).select("history_id", F.col("current_hash").alias("checksum"))
    stored = live.filter("history_id % 5 <> 0").withColumn("checksum", F.when(F.col("history_id") % 7 == 0, F.sha2(F.lit("drift"), 256)).otherwise(F.col("checksum")))
    return history.verify(stored, live)


def _init_sql() -> str:
    baseline = f"sha256('migration:64:{history.ZERO}2:[]8:baseline')"
    fresh = "NOT starts_with(snapshot_id, 'documents/')"
    when = lambda v, t: f"CASE WHEN {fresh} THEN {v} END::{t}"
    return f"SELECT snapshot_id AS history_id, {when(1, 'INT')} AS seq, {when(baseline, 'VARCHAR')} AS id, {when(repr(history.ZERO), 'VARCHAR')} AS parent_hash, {when('checksum', 'VARCHAR')} AS resulting_hash, {when('true', 'BOOLEAN')} AS is_checkpoint, CASE WHEN NOT ({fresh}) THEN 'AlreadyInitialised' END AS error FROM ({ORACLE_SQL['checksum_sha256']})"


@query(_init_sql)
def init_from_database(spark, sf_dir):
    catalog = queries.catalog(spark, sf_dir)
    return history.initialise(catalog, catalog.namespaces.filter(F.col("snapshot_id").startswith("documents/")).select(F.col("snapshot_id").alias("history_id")))


@query(
    lambda: profile_sql.ctes("namespaces", "tables", "columns")
    + ", "
    + _CHAIN.removeprefix("WITH ")
    + """, c AS (SELECT snapshot_id, table_name, list(name ORDER BY position) AS columns FROM columns GROUP BY ALL), t AS (SELECT t.snapshot_id, to_json(list({'name': t.table_name, 'columns': coalesce(c.columns, [])} ORDER BY t.table_name))::VARCHAR AS content FROM tables t LEFT JOIN c USING (snapshot_id, table_name) GROUP BY 1)
 SELECT 'schema/' || n.snapshot_id AS uri, 'application/json' AS mime_type, coalesce(t.content, '[]') AS content FROM namespaces n LEFT JOIN t USING (snapshot_id)
 UNION ALL SELECT 'migrations/' || history_id, 'application/json', to_json(list({'seq': seq, 'id': id} ORDER BY seq))::VARCHAR FROM e GROUP BY history_id
 UNION ALL SELECT 'migration/' || id, 'application/json', to_json({'history': history_id::VARCHAR, 'seq': seq, 'id': id, 'parent_hash': parent_hash, 'resulting_hash': resulting_hash})::VARCHAR FROM e"""
)
def resource_documents(spark, sf_dir):
    return history.resources(queries.catalog(spark, sf_dir), _chain(spark, sf_dir))
