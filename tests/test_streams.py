"""Streams of records: events as migrations, in micro-batches that come in any order."""

from __future__ import annotations

import collections
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from schemaloom.operators import history
from schemaloom.streaming.track import track

SF = "/root/testdata/sf0.001"
SCHEMA = "history_id long, seq long, id string, parent_hash string, resulting_hash string, ts timestamp"


def chain(spark):
    """Every user's events as a history; every 97th event's parent is wrong."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    rows = e.select(F.col("user_id").alias("history_id"), F.row_number().over(w).cast("long").alias("seq"), F.col("event_id").cast("string").alias("id"), F.coalesce(F.lag(sha).over(w), F.lit(history.ZERO)).alias("parent_hash"), sha.alias("resulting_hash"), F.col("ts").cast("timestamp").alias("ts"))
    return [tuple(r) for r in rows.withColumn("parent_hash", F.when(F.col("id").cast("int") % 97 == 0, F.lit("x")).otherwise(F.col("parent_hash"))).collect()]


def run(spark, tmp_path, batches, name, **options):
    """Outcomes after every micro-batch of a file each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in")).withWatermark("ts", "0 seconds")
        q = track(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        del k
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / name / "out")).collect()]


def test_shuffled_records_are_judged_as_ordered_ones(spark, tmp_path):
    rows = chain(spark)
    # every record's time is that of the stream's start, so that none is too late for the watermark
    start = min(r[5] for r in rows)
    mixed = [(*r[:5], start) for r in rows]
    random.Random(1).shuffle(mixed)
    repeated = mixed[:20]
    size = len(mixed) // 3 + 1
    got = run(spark, tmp_path, [mixed[k : k + size] for k in range(0, len(mixed), size)] + [repeated], "mixed")
    count = collections.Counter((h, s, i, o) for h, s, i, o in got)
    assert count == collections.Counter([(r[0], r[1], r[2], "broken" if r[3] == "x" else "ok") for r in rows] + [(r[0], r[1], r[2], "repeated") for r in repeated])


def test_gaps_are_told_when_patience_ends(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rec = lambda h, s, parent, hash_, hours: (h, s, f"m{s}", parent, hash_, t + timedelta(hours=hours))
    batches = [
        [rec(1, 1, history.ZERO, "a", 0), rec(1, 3, "b", "c", 0), rec(1, 4, "c", "d", 0), rec(1, 6, "zz", "f", 0), rec(2, 1, history.ZERO, "a", 0)],
        [rec(9, 1, history.ZERO, "q", 5)],  # time goes on
        [rec(9, 2, "q", "r", 6)],
        [rec(1, 7, "f", "g", 7), rec(1, 2, "a", "b", 7)],
    ]
    got = {(h, s): o for h, s, _, o in run(spark, tmp_path, batches, "gaps", patience_s=3600)}
    assert got == {(1, 1): "ok", (1, 3): "gap", (1, 4): "ok", (1, 6): "gap", (2, 1): "ok", (9, 1): "ok", (9, 2): "ok", (1, 7): "ok", (1, 2): "repeated"}


# ---- histories as a source and a sink ----------------------------------------------


def test_histories_are_written_whole_or_not_at_all(spark, tmp_path):
    import pytest

    from schemaloom.sources import histories, store

    path = str(tmp_path / "all")
    e = spark.createDataFrame(chain(spark), SCHEMA).filter("parent_hash <> 'x'")
    broken = {r[0] for r in e.join(spark.createDataFrame(chain(spark), SCHEMA).filter("parent_hash = 'x'").select("history_id"), "history_id", "left_semi").select("history_id").distinct().collect()}
    text = F.concat(F.lit('[{"op_kind": "CreateTable", "name": "t'), F.col("id"), F.lit('"}]'))
    rows = e.select(F.concat(F.lit("h"), "history_id").alias("history_id"), F.col("seq").cast("int").alias("seq"), "id", "parent_hash", "resulting_hash", F.lit("d").alias("description"), text.alias("operations"), (F.col("seq") % 5 == 0).alias("is_checkpoint"))
    whole = rows.filter(~F.col("history_id").isin(*[f"h{b}" for b in broken]))
    first, rest = whole.filter("seq <= 20"), whole.filter("seq > 20")
    histories.write_histories(first, path)
    histories.write_histories(rest, path)
    back = histories.read_histories(spark, path)
    assert back.count() == whole.count() > 0 and back.exceptAll(whole).count() == 0
    assert history.verify_chain(back).filter("NOT ok").count() == 0
    one = whole.first()["history_id"]
    assert store.Store(f"{path}/{one}").verify_chain() is None

    def refused(df):
        before = sorted(str(p) for p in (tmp_path / "all").rglob("*"))
        with pytest.raises(Exception, match="Duplicate|WrongParent|not a name"):
            histories.write_histories(df, path)
        assert sorted(str(p) for p in (tmp_path / "all").rglob("*") if "_aside" not in str(p)) == [p for p in before if "_aside" not in p]
        assert not list((tmp_path / "all" / "_aside").glob("*")) if (tmp_path / "all" / "_aside").exists() else True

    fresh = spark.createDataFrame([("new1", 1, "a", history.ZERO, "s", "d", "[]", False)], whole.schema)
    refused(first.filter(F.col("history_id") == one).limit(1).unionByName(fresh))
    refused(fresh.withColumn("parent_hash", F.lit("wrong")).unionByName(fresh.withColumn("history_id", F.lit("new2"))))
    refused(fresh.withColumn("history_id", F.lit("a/b")))
    with pytest.raises(Exception, match="only append"):
        fresh.write.format("histories").mode("overwrite").option("path", path).save()
    assert histories.read_histories(spark, str(tmp_path / "none")).count() == 0
