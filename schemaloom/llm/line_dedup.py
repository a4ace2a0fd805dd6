"""Line dedup with two Bloom filters and an exact confirmation of suspects.

Two passes over the documents.  The first builds the once-seen and twice-seen
filters of line keys (filters.py).  In the second only keys whose bit was seen
twice are suspected; they travel as 128-bit digests with their doc_id, are
counted with map-side partial aggregation, and confirmed keys go back to the
documents that must lose them.

A line's key is the line stripped of ASCII white space, A-Z lower-cased.
Documents are told apart by doc_id; rows that share one are one document and
keep each other's lines.  Rows with a null doc_id are one document after all
others.  A null or empty text is one empty line.  Extra columns are kept,
whatever their names; n_lines and n_dropped of the input are replaced.

Skew: a key held by a third of all documents is pre-aggregated per task, and its
way back is a broadcast (`heavy_join`), so its rows aren't gathered.  What goes
back to a row are keys that it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lean
from .filters import Twice, twice_seen
from .spark_util import bitmap, heavy_join, in_bitmap, written

BITS = 28  # 32 MiB
_WS = b" \t\n\v\f\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has under ``least`` code points."""
    k = line.strip(_WS).lower()  # bytes.lower() touches A-Z alone
    if len(k) >= 4 * least or (len(k) >= least and len(k) - sum(0x80 <= c < 0xC0 for c in k) >= least):
        return k
    return None


def _keys(text: bytes | None, least: int) -> set[bytes]:
    out = {line_key(x, least) for x in (text or b"").split(b"\n")}
    out.discard(None)
    return out


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield np.array([xxhash.xxh3_64_intdigest(k) for t in b.column(2).to_pylist() for k in _keys(t, least)], np.uint64)

    return run


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(least: int, twice):
    schema = pa.schema([("doc", pa.int64()), ("c", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Twice = twice.value
        for b in batches:
            rows, keys = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                k = list(_keys(t, least))
                rows += [i] * len(k)
                keys += k
            if keys:
                hit = np.flatnonzero(seen.test(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))).tolist()
                of = pa.array([rows[i] for i in hit], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array([_digest(keys[i]) for i in hit], pa.binary())], schema=schema)

    return run


def _check():
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def repeated_keys(docs: DataFrame, least: int = 10, bits: int = BITS) -> DataFrame:
    """doc, c (check of the row's text), digest of every key that a row must lose: a document of smaller id holds it."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), _check().alias("c"), F.col("text").cast("binary").alias("text"))
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(texts, _hashes(least), bits))
    suspects = written(texts.mapInArrow(lean(_suspects(least, twice)), "doc long, c long, digest binary"))
    first = suspects.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.when(F.col("doc").isNull(), 1)).alias("nulls"), F.count(F.lit(1)).alias("k"))
    first = written(first.filter("first < last or (first is not null and nulls > 0)").select("digest", "first", "k"))
    return heavy_join(suspects, first, ["digest"], "k").filter("doc is null or doc > first").select("doc", "c", "digest")


def dedup_lines(docs: DataFrame, least: int = 10, bits: int = BITS) -> DataFrame:
    """The documents with text replaced by the lines kept, and n_lines, n_dropped, beside all other columns."""
    gone = written(repeated_keys(docs, least, bits).groupBy("doc", "c").agg(F.collect_set("digest").alias("gone")))
    touched = in_bitmap(bitmap(gone, "c"), _check())
    # the columns of docs travel in a struct, so their names can't clash; documents that lose nothing stay where they are
    row = F.struct(*docs.columns).alias("row")
    left = docs.filter(touched).select(row, F.col("doc_id").cast("long").alias("d"), _check().alias("c"))
    kept = left.join(gone.hint("merge"), left["d"].eqNullSafe(gone["doc"]) & (left["c"] == gone["c"]), "left").withColumn("kept", _keep(least)(F.col("row.text").cast("binary"), F.col("gone")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.struct(text.cast("binary").alias("text"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    both = kept.select("row", "kept").unionByName(docs.filter(~touched).select(row, whole.alias("kept")))
    out = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return both.select(*out, F.col("kept.text").cast("string").alias("text"), F.col("kept.n_lines").alias("n_lines"), F.col("kept.n_dropped").alias("n_dropped"))


def _keep(least: int) -> Callable:
    def keep(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(texts, gone, strict=True):
            lines = (t or b"").split(b"\n")
            n = len(lines)
            if g is not None and len(g):
                lost = {bytes(x) for x in g}
                lines = [x for x in lines if (k := line_key(x, least)) is None or _digest(k) not in lost]
            rows.append((b"\n".join(lines), n, n - len(lines)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return F.pandas_udf(keep, "text binary, n_lines long, n_dropped long")
