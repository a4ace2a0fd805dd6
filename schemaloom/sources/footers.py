"""What Parquet files say of themselves: row counts, null counts and ranges of columns from footers, read in tasks.

No data page is read for a column whose every row group has statistics; columns without them in any group are counted
by a scan of those columns alone.  Footers are read where Python can open the file (file:, or what pyarrow's filesystems
reach); a folder that only Spark can open is told as having no statistics, so its columns are scanned.

Doubles: a NaN isn't part of footers' ranges, nor of the scan's.  Empty files and tables have 0 rows and no range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "file string, name string, n_rows long, n_nulls long, low double, high double, known boolean"


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import unquote, urlparse

    import pyarrow.parquet as pq
    from pyarrow import fs

    for b in batches:
        rows: list[tuple] = []
        for file in b["file"]:
            try:
                at = urlparse(file)
                where, path = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(file)
                with where.open_input_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
            except (OSError, ValueError):
                rows.append((file, None, None, None, None, None, False))
                continue
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    one = group.column(c)
                    s = one.statistics if one.is_stats_set else None
                    nested = "." in one.path_in_schema
                    known = s is not None and s.has_null_count and (s.has_min_max or s.null_count == group.num_rows) and not nested
                    low, high = (_number(s.min), _number(s.max)) if known and s.has_min_max else (None, None)
                    rows.append((file, one.path_in_schema.split(".")[0], group.num_rows, s.null_count if known else None, low, high, known))
            if not meta.num_row_groups:
                rows += [(file, n, 0, 0, None, None, True) for n in meta.schema.to_arrow_schema().names]
        yield pd.DataFrame(rows, columns=["file", "name", "n_rows", "n_nulls", "low", "high", "known"])


def columns_of(spark: SparkSession, path: str) -> DataFrame:
    """name, n_rows, n_nulls, low, high, from_footers of every column of a Parquet table; ranges of numbers alone."""
    df = spark.read.parquet(path)
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float")}
    files = df.inputFiles()  # names of files: bounded by the listing that Spark itself holds
    parts = min(len(files), 1000) or 1
    foot = spark.createDataFrame([(f,) for f in files], "file string").repartition(parts).mapInPandas(_read, _SCHEMA)
    told = foot.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("known").alias("known"), F.count("file").alias("groups")).collect()  # a row for each column
    unread = any(r["name"] is None for r in told)
    sure = {r["name"]: r for r in told if r["name"] is not None and r["known"] and not unread}
    rows = [(c, r["n_rows"], r["n_nulls"], r["low"] if c in numbers else None, r["high"] if c in numbers else None, True) for c in df.columns if (r := sure.get(c))]
    left = [c for c in df.columns if c not in sure]
    if left:
        real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(left):
            aggs += [F.count(c).alias(f"c{i}"), *([F.min(real(c)).alias(f"l{i}"), F.max(real(c)).alias(f"h{i}")] if c in numbers else [])]
        r = df.agg(*aggs).first()
        rows += [(c, r["n"], r["n"] - r[f"c{i}"], r[f"l{i}"] if c in numbers else None, r[f"h{i}"] if c in numbers else None, False) for i, c in enumerate(left)]
    return spark.createDataFrame(rows, "name string, n_rows long, n_nulls long, low double, high double, from_footers boolean")
