"""Would a planned constraint hold?  Checks over the rows themselves (an addition to schema comparison).

Each is one scan with the columns it needs; uniqueness and foreign keys shuffle
keys only, pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """column_name, n_rows, n_violations of each column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.coalesce(F.col(f"v{i}"), F.lit(0)).alias("n_violations")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("r")).select("r.*")


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Key values that occur more than once (nulls are distinct), with their count."""
    rows = df.select(*columns).na.drop("any") if columns else df
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, ref: list[str]) -> DataFrame:
    """Key values of child rows without a parent (rows with a null key aside), with their count."""
    keys = child.select(*columns).na.drop("any").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    p = parent.select(*[F.col(r).alias(c) for c, r in zip(columns, ref, strict=True)]).distinct()
    return keys.join(p, columns, "left_anti")


def check(df: DataFrame, condition: Column) -> DataFrame:
    """n_rows, n_violations: rows for which the condition is false (unknown passes)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((~condition).cast("long")), F.lit(0)).alias("n_violations"))


#: Ranges of the integer types.
INTEGER_RANGE = {"smallint": (-32768, 32767), "integer": (-2147483648, 2147483647), "bigint": (-9223372036854775808, 9223372036854775807)}


def narrowing(df: DataFrame, column: str, to: str) -> DataFrame:
    """column_name, to_type, low, high, n_violations of a column that would become a smaller integer type."""
    lo, hi = INTEGER_RANGE[to]
    c = F.col(column)
    return df.agg(F.min(c).alias("low"), F.max(c).alias("high"),
            F.coalesce(F.sum(((c < lo) | (c > hi)).cast("long")), F.lit(0)).alias("n_violations")).select(F.lit(column).alias("column_name"), F.lit(to).alias("to_type"),
            "low", "high", "n_violations")
