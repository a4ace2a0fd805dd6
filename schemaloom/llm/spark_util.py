"""Shared helpers: written tables in the cluster's shared folder, bitmaps, joins with frequent keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import kept as written

__all__ = ["bitmap", "heavy_join", "in_bitmap", "parallelism", "small_batches", "written"]


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For tables of long texts: fewer rows in an Arrow batch than Spark's default, so that a batch stays within memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


BITMAP_BITS = 1 << 26  # 8 MiB, whatever the corpus


def bitmap(df: DataFrame, key: str):
    """A broadcast bitmap of the low bits of a column of hashes.

    It only spares a join rows that can't match; what it lets through wrongly is dropped by the join behind it.
    """
    p = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    rows = df.select(p.alias("p")).selectExpr("cast(shiftright(p, 5) as int) AS w", "shiftleft(1L, cast(p & 31 as int)) AS m").groupBy("w").agg(F.bit_or("m").alias("m"))
    found = rows.toArrow()  # at most BITMAP_BITS / 32 words
    bits = np.zeros(BITMAP_BITS // 32, "<u4")
    bits[found.column("w").to_numpy()] = found.column("m").to_numpy().astype(np.uint64).astype("<u4")
    return df.sparkSession.sparkContext.broadcast(bits.tobytes())


def in_bitmap(wanted, key: Column | str) -> Column:
    """Whether a hash may be in the bitmap."""

    @F.pandas_udf("boolean")
    def test(k: pd.Series) -> pd.Series:
        m = np.frombuffer(wanted.value, np.uint8)
        at = k.to_numpy() & (len(m) * 8 - 1)
        return pd.Series((m[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return test(F.col(key) if isinstance(key, str) else key)


HEAVY = 1000


def heavy_join(rows: DataFrame, table: DataFrame, on: list[str], count: str, n: int | None = None) -> DataFrame:
    """rows joined with a table that holds every key once and says in ``count`` how many rows have it.

    Keys of over a HEAVY-th of all rows (so HEAVY of them at most) are broadcast and their rows stay where they are; all
    others shuffle.  Both sides should be written tables, as they are read twice.  n: about how many rows there are, where that is
    known.
    """
    limit = (rows.count() if n is None else n) // HEAVY
    heavy = F.broadcast(table.filter(F.col(count) > limit))
    light = table.filter(F.col(count) <= limit).hint("merge")
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(*on), on, "left_anti").join(light, on), allowMissingColumns=True)
