"""Dedup of repeated passages by a sparse suffix array.

Texts are sequences of words (white space apart).  Only suffixes that begin at
a minimiser are retained: of every ``LEAST - K + 1`` consecutive K-word prefixes
the one of least hash, so two equal runs of LEAST words have the same minimiser
whatever stands around them.

1. Suffixes are sorted by their K-word prefix over the cluster (range
   partitions).  Neighbours are compared; suffixes whose prefix no neighbour
   shares are done with.
2. The documents that are left come back with their texts.  A retained suffix is
   extended to the left and right over all runs of LEAST words whose minimiser
   it is: its *stretch*, told by a digest and by the hashes of its runs.  In the
   order of (prefix, digest, document) neighbours with equal digest match as a
   whole; all but the first are repeats.
3. What is left of a prefix are different stretches, which may match in part.
   They stand together in the sort, and each run of LEAST words among them is
   held against all others (a match of a run is a match that goes far enough to
   the left and to the right), not only against the adjacent suffix, so slotted
   texts and partial copies lose nothing.
4. A prefix that touches the bounds of a range partition is not settled there:
   its stretches (two prefixes at most for each partition) meet by prefix and are
   compared likewise.  Only a prefix of more than ``OPEN`` different stretches has
   its runs counted by hash in the cluster, with partial aggregation.

A run is repeated if a document of smaller doc_id holds it, or the same document
further left.  So the first occurrence stays and only later ones go, and a
document without a repeated run is never touched.  Longer repeats are chains of
runs.  No filter, cap or sample takes part; equal runs are told by 64 bits of
their prefix and 64 bits of their own words.

Skew: repeats within a document are settled before anything is shuffled; a
passage in a third of all documents is spread by ranges of (prefix, digest,
document) and counted by partial aggregation.

A null text is empty; texts of under LEAST words have no repeats.  A null
doc_id counts as one after all others.  Rows that share a doc_id are told apart
by their texts; rows with equal doc_id and text are one document.  Extra
columns are kept by `remove_repeats`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lean, mix, powers, slices, words
from .spark_util import bitmap, heavy_join, in_bitmap, parallelism, written

LEAST, K = 50, 16
WINDOW = LEAST - K + 1
OPEN = 20_000
LAST = (1 << 63) - 1
_POS = np.uint64((1 << 28) - 1)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def minimisers(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs within documents of a slice, the position of each one's minimiser, and hashes of all K-word prefixes."""
    g = run_hashes(h, K)
    if len(h) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.int64), g
    low = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    size, m = 1, low
    while size * 2 <= WINDOW:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(low) - WINDOW + 1], m[WINDOW - size :][: len(low) - WINDOW + 1])
    doc_end = np.repeat(first[1:], np.diff(first))[: len(m)]
    start = np.flatnonzero(np.arange(len(m)) + LEAST <= doc_end)
    return start, (m[start] & _POS).astype(np.int64), mix(g)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


# ---- 1: prefixes ---------------------------------------------------------------

_PREFIX = pa.schema([("g", pa.int64()), ("doc", pa.int64()), ("c", pa.int64()), ("own", pa.bool_())])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document and prefix at a minimiser; own: the document itself holds it twice."""
    for s in slices(batches):
        _, _, h, first = words(s)
        _, at, g = minimisers(h, first)
        if not len(at):
            continue
        at = np.unique(at)
        g, d = g[at], np.searchsorted(first, at, "right") - 1
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        cut = np.flatnonzero(_changes(g, d))
        n = np.diff(np.append(cut, len(g)))
        doc, c = (s.rows.column(k).to_numpy()[d[cut]] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(g[cut].view(np.int64)), pa.array(doc), pa.array(c), pa.array(n > 1)], schema=_PREFIX)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those that share their prefix with a neighbour; and both ends of the partition (edge)."""

    def told(g, doc, c, keep, edge):
        k = np.flatnonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(g[k]), pa.array(doc[k]), pa.array(c[k]), pa.array(np.full(len(k), edge))], ["g", "doc", "c", "edge"])

    held, begun = None, False
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            rows = [np.concatenate((x, y)) for x, y in zip(held, rows, strict=True)]
        g, doc, c, own = rows
        same = np.zeros(len(g) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        keep = own | same[:-1] | same[1:]
        if not begun:
            yield told(g[:1], doc[:1], c[:1], np.ones(1, bool), True)
            begun = True
        yield told(g[:-1], doc[:-1], c[:-1], keep[:-1], False)
        held = [x[-1:] for x in rows]
        held[3] = keep[-1:]
    if held is not None:
        g, doc, c, own = held
        yield told(g, doc, c, own, False)
        yield told(g, doc, c, np.ones(1, bool), True)


# ---- 2 and 3: stretches ----------------------------------------------------------

_STRETCH = pa.schema([("copy", pa.bool_()), ("g", pa.int64()), ("d", pa.int64()), ("doc", pa.int64()), ("c", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("w", pa.binary())])
_STRETCH_DDL = "copy boolean, g long, d long, doc long, c long, pos int, n int, w binary"


def _packed(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary values of 8 * n[i] bytes from values[start[i]:]."""
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start - (ends - n), n)
    offsets = np.concatenate(([0], ends * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[at].tobytes())])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with shared prefixes (doc, c, text, gs): the stretch of each; copy: the document has it further left."""
    for s in slices(batches):
        _, _, h, first = words(s)
        start, at, g = minimisers(h, first)
        lists = s.rows.column(3)
        size = np.diff(lists.offsets.to_numpy())
        of = mix(np.repeat(np.arange(len(size), dtype=np.uint64), size))
        wanted = lists.flatten().to_numpy().view(np.uint64) ^ of
        d = np.searchsorted(first, start, "right") - 1
        begins = np.flatnonzero(_changes(at, d)) if len(start) else np.empty(0, np.int64)
        key = g[at[begins]] ^ mix(d[begins].astype(np.uint64))
        hit = np.isin(key, wanted)
        n = np.diff(np.append(begins, len(start)))[hit]
        begins = begins[hit]
        if not len(begins):
            continue
        w, up = run_hashes(h, LEAST)[start], powers(WINDOW + 1)[0]
        ends = np.cumsum(n)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        flat = w[inner + np.repeat(begins, n)] * up[inner]
        digest = mix(np.add.reduceat(flat, ends - n) + n.astype(np.uint64))
        pre, doc = g[at[begins]], d[begins]
        order = np.lexsort((start[begins], digest, pre, doc))
        copy = np.zeros(len(order), bool)
        copy[order] = ~_changes(doc[order], pre[order], digest[order])
        pos = (start[begins] - first[doc]).astype(np.int32)
        names, checks = (s.rows.column(k).to_numpy()[doc] for k in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(copy), pa.array(pre.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(names), pa.array(checks), pa.array(pos), pa.array(n.astype(np.int32)), _packed(w, begins, np.where(copy, 0, n))], schema=_STRETCH
        )


_FOUND = pa.schema([("open", pa.bool_()), ("doc", pa.int64()), ("c", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("g", pa.int64()), ("w", pa.binary())])
_FOUND_DDL = "open boolean, doc long, c long, pos int, n int, first long, g long, w binary"


def _lost(doc, c, pos, n, first) -> pa.RecordBatch:
    """Runs pos to pos + n - 1 of a document, which the document ``first`` holds before."""
    z = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(z, bool)), pa.array(doc), pa.array(c), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(first), pa.array(np.zeros(z, np.int64)), pa.array([b""] * z, pa.binary())], schema=_FOUND
    )


def _as_open(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if rows.num_rows:
        rows = rows.append_column("open", pa.array(np.ones(rows.num_rows, bool))).append_column("first", pa.array(np.zeros(rows.num_rows, np.int64)))
        yield from rows.select(_FOUND.names).cast(_FOUND).to_batches()


def _partial(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs that different stretches of one prefix have in common; rows hold whole groups in the order of g."""
    g = rows.column("g").to_numpy()
    group = np.cumsum(_changes(g)) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1) if len(g) else np.empty(0, np.int64)
    if not len(many):
        return
    rows, group = rows.take(pa.array(many)), group[many].astype(np.uint64)
    doc, c, pos, n = (rows.column(x).to_numpy() for x in ("doc", "c", "pos", "n"))
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((pos, c, doc))] = np.arange(len(doc))
    w = np.frombuffer(b"".join(rows.column("w").to_pylist()), np.uint64)
    row = np.repeat(np.arange(len(doc)), n)
    inner = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    key = w ^ mix(group[row])
    order = np.lexsort((rank[row] * WINDOW + inner, key))
    new = _changes(key[order])
    holder = row[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.full(len(w), -1, np.int64)
    first[order[~new]] = holder[~new]
    at = np.flatnonzero(first >= 0)
    if not len(at):
        return
    r, i, f = row[at], inner[at], doc[first[at]]
    cut = np.flatnonzero(_changes(r, f, i - np.arange(len(i))))
    yield _lost(doc[r[cut]], c[r[cut]], pos[r[cut]] + i[cut], np.diff(np.append(cut, len(r))), f[cut])


def _compare(limit: int):
    """Sorted stretches: copies of the one before, then the groups of one prefix; those at the ends, and those of over ``limit``
    different stretches, stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, edge, spilled = None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            g, d, doc, c, pos, n = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("g", "d", "doc", "c", "pos", "n"))
            edge = g[0] if edge is None else edge
            new = _changes(g, d)
            new[0] = last is None or (g[0], d[0]) != last[:2]
            # of every row the first one of its digest in this partition
            at = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            before = lambda x, k: np.where(at >= 0, x[at], k)
            rep = [before(x, 0 if last is None else k) for x, k in zip((doc, c, pos), (None,) * 3 if last is None else last[2:], strict=True)]
            copy = np.flatnonzero(~new & ((rep[0] != doc) | (rep[1] != c) | (rep[2] != pos)))
            if len(copy):
                yield _lost(doc[copy], c[copy], pos[copy], n[copy], rep[0][copy])
            last = (g[-1], d[-1], *(x[-1] for x in rep))
            fresh = pa.Table.from_batches([b]).select(["doc", "c", "pos", "n", "g", "w"]).filter(pa.array(new))
            rows = fresh if held is None else pa.concat_tables([held, fresh])
            rows = rows.combine_chunks()
            keys = rows.column("g").to_numpy()
            out = (keys == edge) | (keys == spilled if spilled is not None else False)
            yield from _as_open(rows.filter(pa.array(out)))
            rows, keys = rows.filter(pa.array(~out)), keys[~out]
            cut = int(np.searchsorted(keys, g[-1], "left"))
            yield from _partial(rows.slice(0, cut))
            held = rows.slice(cut)
            if held.num_rows > limit:
                spilled = g[-1]
                yield from _as_open(held)
                held = None
        if held is not None:
            yield from _as_open(held)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open stretches of whole prefixes, sorted by g, compared as those within a partition are."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        rows = rows.combine_chunks()
        keys = rows.column("g").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        yield from _partial(rows.slice(0, cut))
        held = rows.slice(cut)
    if held is not None:
        yield from _partial(held)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of an open stretch."""
    for b in batches:
        if not b.num_rows:
            continue
        g, doc, c, pos, n = (b.column(k).to_numpy() for k in range(5))
        w = np.frombuffer(b"".join(b.column(5).to_pylist()), np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = pos[row] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays([pa.array(g[row]), pa.array(w), pa.array(doc[row]), pa.array(c[row]), pa.array(at.astype(np.int32))], ["g", "w", "doc", "c", "pos"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, c (a check that tells rows of one doc_id apart) and text."""
    return docs.select(_doc().alias("doc"), _check().alias("c"), F.col("text").cast("binary").alias("text"))


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _check():
    x = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.when(F.col("doc_id").isNull(), x.bitwiseAND(LAST)).otherwise(x.bitwiseOR(~LAST))  # null ids come last


def repeats(docs: DataFrame, limit: int = OPEN) -> DataFrame:
    """doc, c, pos, n, first: runs pos to pos + n - 1 of a document that the document ``first`` holds before."""
    parts = parallelism(docs.sparkSession)
    texts = _keyed(docs)
    prefixes = written(texts.mapInArrow(lean(_prefixes), "g long, doc long, c long, own boolean"))
    ordered = prefixes.repartitionByRange(parts, "g", "doc", "c").sortWithinPartitions("g", "doc", "c")
    found = written(ordered.mapInArrow(lean(_shared), "g long, doc long, c long, edge boolean"))
    # two rows at most for each range partition
    edges = found.filter("edge")
    across = edges.join(edges.groupBy("g").count().filter("count > 1").select("g"), "g").select("g", "doc", "c")
    shared = found.filter("not edge").select("g", "doc", "c").unionByName(across)
    lists = written(shared.groupBy("doc", "c").agg(F.collect_set("g").alias("gs")))
    some = texts.filter(in_bitmap(bitmap(lists, "c"), "c")).dropDuplicates(["doc", "c"]) if _has_copies(docs) else texts.filter(in_bitmap(bitmap(lists, "c"), "c"))
    held = some.hint("merge").join(lists, ["doc", "c"]).select("doc", "c", "text", "gs")
    stretches = written(held.mapInArrow(lean(_stretches), _STRETCH_DDL))
    order = ["g", "d", "doc", "c", "pos"]
    compared = written(stretches.filter("not copy").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lean(_compare(limit)), _FOUND_DDL))
    still = compared.filter("open").select("g", "doc", "c", "pos", "n", "w")
    # two prefixes at most for each range partition, and those over the limit
    many = still.groupBy("g").agg((F.count(F.lit(1)) > limit).alias("many"))
    still = still.join(F.broadcast(many), "g")
    few = still.filter("not many").drop("many").repartition(parts, "g").sortWithinPartitions("g")
    settled = written(few.mapInArrow(lean(_settle), _FOUND_DDL))
    runs = written(still.filter("many").drop("many").mapInArrow(lean(_runs_of), "g long, w long, doc long, c long, pos int"))
    place = F.struct("doc", "c", "pos")
    firsts = written(runs.groupBy("g", "w").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1"))
    rest = heavy_join(runs, firsts, ["g", "w"], "k").filter(place > F.col("f"))
    out = ["doc", "c", "pos", "n", "first"]
    own = stretches.filter("copy").select("doc", "c", "pos", "n", F.col("doc").alias("first"))
    whole = compared.filter("not open").select(*out).unionByName(settled.select(*out))
    return own.unionByName(whole).unionByName(rest.select("doc", "c", "pos", F.lit(1).alias("n"), F.col("f.doc").alias("first")))


def _has_copies(docs: DataFrame) -> bool:
    """Whether rows repeat a doc_id at all; only then may a document come twice."""
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of repeated runs with one first document, as spans of words."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(1)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        pos, n, first = (flat.field(x).to_numpy() for x in ("pos", "n", "first"))
        d = np.repeat(np.arange(len(size)), size)
        new = _changes(d, first)
        new[1:] |= pos[1:] > pos[:-1] + n[:-1]
        cut = np.flatnonzero(new)
        end = np.maximum.reduceat(pos + n, cut) if len(cut) else pos
        length = end - pos[cut] + LEAST - 1
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d[cut])), pa.array(pos[cut].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(first[cut])], ["doc", "start", "n_words", "first"])


def repeated_spans(docs: DataFrame, limit: int = OPEN) -> DataFrame:
    """doc_id, start (in words), n_words, first_doc_id: one row for each run of words that an earlier place holds."""
    each = repeats(docs, limit).groupBy("doc", "c").agg(F.array_sort(F.collect_set(F.struct("first", "pos", "n"))).alias("lost"))
    out = each.select("doc", "lost").mapInArrow(lean(_spans), "doc long, start int, n_words int, first long")
    name = lambda c: F.nullif(F.col(c), F.lit(LAST))
    return out.select(name("doc").alias("doc_id"), "start", "n_words", name("first").alias("first_doc_id"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the words of repeated runs; all other columns as they were."""
    gone = written(repeats(docs).groupBy("doc", "c").agg(F.collect_set(F.struct("pos", "n")).alias("lost")))
    touched = in_bitmap(bitmap(gone, "c"), _check())
    # the columns of docs travel in a struct, so their names can't clash
    rows = docs.filter(touched).select(F.struct(*docs.columns).alias("row"), _doc().alias("doc"), _check().alias("c")).join(gone.hint("merge"), ["doc", "c"], "left")

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, lost: pd.Series) -> pd.Series:
        return pd.Series([t if x is None or not len(x) else without(t, np.array([r["pos"] for r in x]), np.array([r["n"] for r in x])) for t, x in zip(texts, lost, strict=True)])

    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(cut(F.col("row.text").cast("binary"), F.col("lost")).cast("string"))
    changed = rows.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    return docs.filter(~touched).unionByName(changed)


def without(text: bytes, pos: np.ndarray, n: np.ndarray) -> bytes:
    """A text without the words of runs pos to pos + n - 1; what stands between kept words stays."""
    s = next(slices([pa.RecordBatch.from_arrays([pa.array([text], pa.binary())], ["text"])]))
    starts, _, _, _ = words(s)
    take = np.zeros(len(starts) + 1, np.int64)
    np.add.at(take, pos, 1)
    np.add.at(take, np.minimum(pos + n - 1 + LEAST, len(starts)), -1)
    lost = np.cumsum(take)[:-1] > 0
    bounds = np.append(starts, len(text))
    bounds[0] = 0 if len(starts) else len(text)
    return b"".join(text[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~lost))
