"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text's features are its shingles of five words (A-Z lower-cased; a shorter
text is one shingle).  A shingle weighs its count times the mean inverse
document frequency of its words, rounded to steps of a tenth.  Document
frequencies are counted over all documents into 2**20 word buckets, so the
table that is broadcast has a fixed size.

Improved consistent weighted sampling (Ioffe 2010) draws ``bands * rows``
samples; the chance that a sample of two texts agrees is their weighted Jaccard
similarity.  Its gamma and uniform variates come from a hash of the shingle and
the sample's number, so samples are independent however long a text is.  Texts
that agree in a whole band share a bucket, and every pair of a bucket is
verified by the exact weighted Jaccard similarity, in two steps.  First each
text is compared with the smallest one of its bucket; that settles groups of
copies at one pair a text.  Where a bucket still has several classes, all its
texts are compared within tasks, block by block, and only links that join two
classes leave a task.  Bands with the same texts make one bucket.  So no pair
of a bucket goes unseen, and what travels grows with the texts and not with
their pairs.

Equal texts are one node from the start.  Classes are the components of
verified links.

Nulls: a null text is an empty text; empty texts are equal to each other.  A
null doc_id is a row of its class, whose id is its smallest doc_id (null if it
has no other).  Rows that share a doc_id are members of the classes of their
own texts.  Extra columns are ignored by `near_duplicates` and kept by
`keep_first`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lean, mix, slices, words
from .filters import FAN_IN
from .graph import components
from .spark_util import bitmap, heavy_join, in_bitmap, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
LEVELS, STEP = 128, np.log(1.1)
DF_BITS = 20


# ---- document frequencies ----------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total, n = np.zeros(1 << DF_BITS, np.int64), 0
    for s in slices(batches):
        _, _, h, first = words(s, lower=True)
        doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
        seen = np.unique(doc << np.uint64(DF_BITS) | h >> np.uint64(64 - DF_BITS))
        total += np.bincount((seen & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
        n += len(first) - 1
    z = zstandard.ZstdCompressor(level=1)
    for k, part in enumerate(total.reshape(64, -1)):
        yield pa.RecordBatch.from_pydict({"range": [k], "part": [TaskContext.get().partitionId()], "n": [n if k == 0 else 0], "counts": [z.compress(part.tobytes())]},
                schema=pa.schema([("range", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())]))


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    d = zstandard.ZstdDecompressor()
    total = sum(np.frombuffer(d.decompress(x), np.int64) for x in pdf["counts"])
    return pd.DataFrame({"range": pdf["range"].iloc[:1].to_numpy(), "part": [pdf["part"].min() // FAN_IN], "n": [pdf["n"].sum()], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]}).astype({"range": "int32", "part": "int32"})


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and how many hold a word of each bucket (8 MiB, whatever the corpus)."""
    ddl = "range int, part int, n long, counts binary"
    parts, n = texts.mapInArrow(lean(_counts), ddl), texts.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("range", F.floor(F.col("part") / FAN_IN).cast("int").alias("g")).applyInPandas(_sum, ddl)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    rows = {r["range"]: r for r in parts.collect()}
    if not rows:
        return 0, np.zeros(1 << DF_BITS, np.int64)
    d = zstandard.ZstdDecompressor()
    return sum(r["n"] for r in rows.values()), np.concatenate([np.frombuffer(d.decompress(bytes(rows[k]["counts"])), np.int64) for k in range(64)])


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return (1 + np.log((n + 1) / (df + 1))).astype(np.float32)


# ---- shingles and samples -------------------------------------------------------


def shingles(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of one text's words, and the level of each one's weight."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(WORDS, n)
    x = np.zeros(n - k + 1, np.uint64)
    w = np.zeros(n - k + 1, np.float32)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
        w += weight[i : n - k + 1 + i]
    x = mix(x + np.uint64(k))
    u, at, tf = np.unique(x, return_index=True, return_counts=True)
    return u, np.clip(np.rint(np.log(tf * w[at] / k) / STEP), 0, LEVELS - 1).astype(np.int64)


@lru_cache(maxsize=1)
def _picks(k: int) -> np.ndarray:
    return (np.random.default_rng(4).integers(1 << 63, size=(k, 1)).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def _gamma(x: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) variates from the two halves of 64-bit hashes."""
    v = np.log((x.view(np.uint32).astype(np.float32) + np.float32(1)) * np.float32(2.0**-32))
    return np.maximum(-(v[..., ::2] + v[..., 1::2]), np.float32(1e-9))


def samples(u: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples (shingle and t) of a text, each as a 64-bit number."""
    out = np.empty(k, np.uint64)
    log_w = (level * STEP).astype(np.float32)
    step = max(1, 20_000 // max(1, len(u)))  # what stays in the cache
    for a in range(0, k, step):
        x = mix(u[None, :] * _picks(k)[a : a + step])
        y = mix(x + np.uint64(0x9E3779B97F4A7C15))
        r, c = _gamma(x), _gamma(y)
        beta = ((x ^ y) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        best = (np.log(c) - r * (t - beta) - r).argmin(1)  # the first of equals is the smallest shingle
        out[a : a + step] = mix(u[best] + t[np.arange(len(t)), best].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def _each_text(s, weights: np.ndarray):
    """Word hashes and weights of each text of a slice."""
    _, _, h, first = words(s, lower=True)
    w = weights[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    for i in range(len(first) - 1):
        yield h[first[i] : first[i + 1]], w[first[i] : first[i + 1]]


def text_key(h: np.ndarray) -> tuple[int, int]:
    """The node of a text (equal for texts that are equal up to case of A-Z and white space), and a check of 64 further bits."""
    k = xxhash.xxh3_128_intdigest(h.tobytes())
    return k >> 65, (k & (1 << 64) - 1) - (1 << 63)


def _signed(weights, bands: int, rows: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("u", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for s in slices(batches):
            out = []
            for r, d, (h, w) in zip(s.column("row"), s.column("doc_id"), _each_text(s, table), strict=True):
                key = text_key(h)
                if not len(h):
                    out.append((r, d, *key, []))
                    continue
                x = samples(*shingles(h, w), bands * rows)
                b = np.zeros(bands, np.uint64)
                for j in range(rows):
                    b = mix(b * np.uint64(0x9E3779B97F4A7C15) + x[j::rows])
                out.append((r, d, *key, b.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


# ---- candidates within buckets ------------------------------------------------


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that pairs (i, j) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucketed(texts: DataFrame) -> DataFrame:
    """bucket, low, t of every bucket with two texts at least; low is its smallest t.  Bands with the same texts are one."""
    rows = written(texts.select("t", F.posexplode("bands").alias("band", "key")))
    many = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y")).filter("n > 1")
    many = written(many.select("band", "key", "low", "n", F.xxhash64("n", "low", "x", "y").alias("bucket")))
    return written(heavy_join(rows, many, ["band", "key"], "n").select("bucket", "low", "t").distinct())


# ---- verification ---------------------------------------------------------------


def weighted_jaccard(u: np.ndarray, lu: np.ndarray, v: np.ndarray, lv: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' shingles (sorted hashes) and weight levels."""
    wu, wv = np.exp(lu * STEP), np.exp(lv * STEP)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = np.minimum(wu[i], wv[j]).sum()
    return float(both / (wu.sum() + wv.sum() - both))


def _shingle_sets(weights, wanted):
    """t and packed shingles of the texts that a bitmap of wanted nodes lets through."""
    schema = pa.schema([("t", pa.int64()), ("u", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = weights.value, np.frombuffer(wanted.value, np.uint8)
        for s in slices(batches):
            out = []
            for h, w in _each_text(s, table):
                key = text_key(h)
                at = key[0] & (len(bits) * 8 - 1)
                if bits[at >> 3] >> (at & 7) & 1:
                    out.append((*key, _pack_set(*shingles(h, w))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _pack_set(u: np.ndarray, level: np.ndarray) -> bytes:
    """40 bits of every hash (in sorted order) and its level."""
    return (u >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + level.astype(np.uint8).tobytes()


def _unpack_set(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b, np.uint8, 5 * n).reshape(n, 5)
    u, at = np.unique(wide.view("<u8").ravel(), return_index=True)
    return u, np.frombuffer(b, np.uint8, n, 5 * n)[at].astype(np.int64)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [weighted_jaccard(*_unpack_set(x), *_unpack_set(y)) >= threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    left = pairs.join(sets.select(F.col("t").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    both = left.join(sets.select(F.col("t").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    return both.select("a", "b", "x", "y").mapInArrow(lean(_verify(threshold)), "a long, b long, ok boolean")


GROUP_BLOCK = 512


def _links_within(threshold: float):
    """All texts of two blocks of a group (or of one) against each other: links that join two classes."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        block, t = pdf["block"].to_numpy(), pdf["t"].to_numpy()
        sets = [_unpack_set(x) for x in pdf["set"]]
        total = np.array([np.exp(v * STEP).sum() for _, v in sets])
        # a feature for every weight that a shingle has anywhere: the least weight of two texts is then a sum over
        # the features that both hold.  Features of one text only can't be shared
        row = np.repeat(np.arange(len(sets)), [len(u) for u, _ in sets])
        u, level = np.concatenate([u for u, _ in sets]), np.concatenate([v for _, v in sets])
        shingle = np.unique(u, return_inverse=True)[1]
        both = np.unique(shingle * LEVELS + level)
        at = both // LEVELS
        first = np.r_[True, at[1:] != at[:-1]]
        w = np.exp((both % LEVELS) * STEP)
        gain = (w - np.where(first, 0.0, np.r_[0.0, w[:-1]])).astype(np.float32)
        top = np.searchsorted(both, shingle * LEVELS + level)
        start = np.searchsorted(both, shingle * LEVELS)
        n = top - start + 1
        rows = np.repeat(row, n)
        feature = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        shared = np.bincount(feature, minlength=len(both)) > 1
        keep = shared[feature]
        rows, feature = rows[keep], (np.cumsum(shared) - 1)[feature[keep]]
        gain = gain[shared]
        order = np.argsort(feature, kind="stable")
        rows, feature = rows[order], feature[order]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        for k in range(0, len(gain), 2048):
            a, z = np.searchsorted(feature, [k, k + 2048])
            x = np.zeros((len(sets), min(2048, len(gain) - k)), np.float32)
            x[rows[a:z], feature[a:z] - k] = 1
            inter += (x * gain[k : k + 2048]) @ x.T
        sim = inter / (total[:, None] + total[None, :] - inter)
        link = sim >= threshold
        for i, j in np.argwhere(np.triu(np.abs(sim - threshold) < 1e-4, 1)):
            link[i, j] = link[j, i] = weighted_jaccard(*sets[i], *sets[j]) >= threshold
        if lo != hi:
            link &= block[:, None] != block[None, :]
        cls = np.unique(pdf["class"].to_numpy(), return_inverse=True)[1]
        out = []
        while True:  # each class takes one link to another, as long as there are any
            open_ = link & (cls[:, None] != cls[None, :])
            i = np.flatnonzero(open_.any(1))
            if not len(i):
                break
            i = i[np.unique(cls[i], return_index=True)[1]]
            j = open_[i].argmax(1)
            out += zip(np.minimum(t[i], t[j]).tolist(), np.maximum(t[i], t[j]).tolist(), strict=True)
            cls = _labels(int(cls.max()) + 1, cls[i], cls[j])[cls]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return run


def _links_in_buckets(buckets: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the classes of every bucket that has several; buckets of two have been tested."""
    label = classes.select(F.col("id").alias("t"), F.col("component").alias("class"))
    member = written(buckets.select("t", F.col("bucket").alias("group")).join(label.hint("merge"), "t", "left").withColumn("class", F.coalesce("class", "t")))
    mixed = member.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi AND n > 2").select("group", "n", F.ceil(F.col("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    rows = heavy_join(member, written(mixed), ["group"], "n").join(sets.hint("merge"), "t").withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    sides = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "t", "class", "set")
    return sides.groupBy("group", "lo", "hi").applyInPandas(_links_within(threshold), "a long, b long")


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (id, component) after further links between their members or texts that had none: links join classes."""
    of = lambda end: classes.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")).hint("merge")
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = written(components(between)).select(F.col("id").alias("component"), F.col("component").alias("to"))
    known = classes.join(merged.hint("merge"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = merged.join(classes.select(F.col("id").alias("component")).hint("merge"), "component", "left_anti").select(F.col("component").alias("id"), F.col("to").alias("component"))
    return known.unionByName(fresh)


def _classed(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """row (a number of the input row), doc_id and c (the class) of every row."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    weights = sc.broadcast(idf(*document_frequencies(texts)))
    signed = written(texts.mapInArrow(lean(_signed(weights, bands, rows)), "row long, doc_id long, t long, u long, bands array<long>"))
    # texts that share a node's 63 bits but not the further 64 get a node of their own (about n * n / 2**64 of n texts)
    clash = written(signed.groupBy("t").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).filter("lo <> hi").select("t", "lo"))

    def told_apart(df: DataFrame) -> DataFrame:
        other = F.when(F.col("u") != F.col("lo"), F.shiftrightunsigned(F.xxhash64("t", "u"), 1)).otherwise(F.col("t"))
        return df.join(clash, "t", "left").withColumn("t", other).drop("u", "lo")

    if not clash.isEmpty():
        signed = written(told_apart(signed))
    nodes = signed.groupBy("t").agg(F.first("bands").alias("bands")).filter(F.size("bands") > 0)
    buckets = _bucketed(nodes)
    wanted = bitmap(buckets.select("t").unionByName(clash.select("t")), "t")
    sets = texts.mapInArrow(lean(_shingle_sets(weights, wanted)), "t long, u long, set binary").dropDuplicates(["t", "u"])
    sets = written(sets.drop("u") if clash.isEmpty() else told_apart(sets))
    pairs = buckets.filter("low < t").select(F.col("low").alias("a"), F.col("t").alias("b")).distinct()
    links = written(_similar(pairs, sets, threshold).filter("ok").select("a", "b"))
    classes = written(components(links))
    more = written(_links_in_buckets(buckets, classes, sets, threshold))
    if not more.isEmpty():
        classes = written(_joined(classes, more))
    return written(signed.select("row", "doc_id", "t").join(classes.select(F.col("id").alias("t"), "component").hint("merge"), "t", "left").select("row", "doc_id", F.coalesce("component", "t").alias("c")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), kept, of every document."""
    member = _classed(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text"), threshold, bands, rows).drop("row")
    low = written(member.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("k")))
    out = heavy_join(member, low, ["c"], "k")
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that of its smallest doc_id (null ids count last); rows that share a doc_id with a row that
    goes are judged by their own texts, and rows equal in doc_id and text are one."""
    check = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").isNull())
    member = _classed(docs.select(check.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), threshold, BANDS, ROWS)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = written(member.groupBy("c").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("k")))
    gone = written(heavy_join(member, first, ["c"], "k").filter(~order.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("d"), "row").distinct())
    touched = in_bitmap(bitmap(gone, "row"), check)
    kept = docs.filter(touched).select(F.struct(*docs.columns).alias("x"), F.col("doc_id").cast("long").alias("d"), check.alias("row"))
    kept = kept.join(gone.hint("merge"), kept["d"].eqNullSafe(gone["d"]) & (kept["row"] == gone["row"]), "left_anti")
    whole = docs.filter(~touched).unionByName(kept.select("x.*"))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return whole
    each = whole.select(F.struct(*docs.columns).alias("x"), F.col("doc_id").alias("d"), check.alias("row"))
    return each.dropDuplicates(["d", "row"]).select("x.*")
