"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

An edit at position p leaves the p code points before it and all behind it as
they are.  In forward order the words that share the part before it are one
interval, in reverse order those that share the part behind it are one; a
wavelet matrix over the forward order, holding each word's place in reverse
order, reports the words in both.  Two words of one length are asked at every
replaced position; a word one shorter is asked at every gap (an insertion; the
longer word's deletion is the same link).

Work is dealt by *blocks*: words of one length and those one shorter that share
what lies outside a range of edit positions.  A link lies in exactly one block
of each cover of the positions.  Positions are halved first, and a block of more
than ``BLOCK_ROWS`` words or ``WIDE`` positions is halved again, its words now told
apart by more of their letters, until it is small or a single position is left;
such a block holds one word for each letter that can stand there and one
without it.  So a prefix or suffix that a third of all words share is split by
its words' other letters, never cut, and no pairs are made but links.  A task
takes whole blocks, ``TASK_ROWS`` words at a time.

Words are counted in tasks before they shuffle; links leave their task once in
either direction and are summed per word.  Roots follow forms by rounds of joins;
a form has at least ``ratio`` times its word's count, so ``log(count) / log(ratio)``
steps end every chain, and doubling takes the logarithm of that many rounds.

Nulls: a null text has no words.  A null doc_id writes no ``doc_id:word``, so none
of its words loses a letter.  Empty texts have no words; texts and words of any
length are taken whole.  Repeated rows count each time.  Ties: the smaller word in
code-point order.  An empty table gives an empty one.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import LONG, Slice, gather, lean, slices, span_hashes
from .spark_util import heavy_join, parallelism, written

BLOCK_ROWS = 4096
WIDE = 32  # edit positions of one block at most
TASK_ROWS = 50_000
FLUSH = 100_000  # distinct words that a task counts before it passes them on
MASK = 97

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


_CRC = _crc_table()


def runs(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the maximal runs of A-Z, a-z and U+00C0 to U+00FF in them: starts, ends, documents.

    Those code points beyond ASCII are just the ones of lead byte 0xC3.
    """
    lead = s.data == 0xC3
    letter = _LETTER[s.data] | lead
    letter[1:] |= lead[:-1]
    before = np.zeros(len(letter), bool)
    before[1:] = letter[:-1]
    before[s.offsets[:-1][s.offsets[:-1] < len(letter)]] = False
    behind = np.zeros(len(letter), bool)
    behind[:-1] = letter[1:]
    last = s.offsets[1:] - 1
    behind[last[last >= 0]] = False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~behind) + 1
    return _LOWER[s.data], starts, ends, np.searchsorted(s.offsets, starts, "right") - 1


def crc32_of(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each span behind a prefix whose own crc32 is given."""
    out, size = prefix.astype(np.uint32), ends - starts
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    live = np.flatnonzero(size <= LONG)
    live, k, state = live[np.argsort(-size[live], kind="stable")], 0, None
    state = ~out[live]
    while True:
        n = int(np.searchsorted(-size[live], -k, "left"))  # spans longer than k bytes come first
        if not n:
            break
        byte = data[starts[live[:n]] + k]
        state[:n] = _CRC[(state[:n] ^ byte) & 255] ^ (state[:n] >> np.uint32(8))
        k += 1
    out[live] = ~state
    return out


def _counted(least: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def slice_words(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of a slice after the deletions: their bytes, starts, ends and counts."""
        data, starts, ends, doc = runs(s)
        chars = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
        size = chars[ends] - chars[starts]
        keep = size >= least
        starts, ends, doc, size = starts[keep], ends[keep], doc[keep], size[keep]
        h = span_hashes(data, starts, ends)
        # one row for each document and word: the deletion depends on nothing else
        order = np.lexsort((h, doc))
        d, g = doc[order], h[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        at = order[new]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        mine = gather(data, starts, ends - starts, np.arange(len(starts)))[0]
        if not np.array_equal(mine, gather(data, starts, ends - starts, at[group])[0]):  # two words share a hash
            at, n = np.arange(len(starts)), np.ones(len(starts), np.int64)
        ids = s.column("doc_id")
        first = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in ids], np.uint32)
        crc = crc32_of(first[doc[at]], data, starts[at], ends[at])
        named = np.array([i is not None for i in ids], bool)
        hit = (crc % MASK == 0) & named[doc[at]]
        extra, counts = [], []
        for k in np.flatnonzero(hit).tolist():
            word = data[starts[at[k]] : ends[at[k]]].tobytes().decode()
            p = int(crc[k]) % len(word)
            if len(word) > least:
                extra.append((word[:p] + word[p + 1 :]).encode())
                counts.append(int(n[k]))
        at, n = at[~hit], n[~hit]
        flat = np.concatenate((data, np.frombuffer(b"".join(extra), np.uint8)))
        tail = len(data) + np.concatenate(([0], np.cumsum([len(x) for x in extra], dtype=np.int64)))
        return flat, np.concatenate((starts[at], tail[:-1])), np.concatenate((ends[at], tail[1:])), np.concatenate((n, np.array(counts, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def told() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], schema=schema)

        for s in slices(batches):
            flat, starts, ends, n = slice_words(s)
            h, at, back = np.unique(span_hashes(flat, starts, ends), return_index=True, return_inverse=True)
            size = ends - starts
            if not np.array_equal(gather(flat, starts, size, np.arange(len(starts)))[0], gather(flat, starts, size, at[back])[0]):
                at = back = np.arange(len(starts))
            total = np.bincount(back, n, len(at)).astype(np.int64).tolist()
            raw = flat.tobytes()
            for a, z, k in zip(starts[at].tolist(), ends[at].tolist(), total, strict=True):
                w = raw[a:z]
                held[w] = held.get(w, 0) + k
            if len(held) >= FLUSH:
                yield told()
                held = {}
        yield told()

    return run


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the distinct words of all whole texts, after the deletions, that are long and frequent enough."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = texts.mapInArrow(lean(_counted(least_length)), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---- range reporting -------------------------------------------------------------


class WaveletMatrix:
    """A permutation of 0 ... n-1, bit by bit from the highest; each level's zeros stand before its ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length()) if self.n else 0
        self.ones, self.zeros, v = [], [], values
        for level in range(self.bits):
            bit = v >> (self.bits - 1 - level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            v = v[np.argsort(bit, kind="stable")]

    def report(self, a: np.ndarray, z: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every query the values within [low, high) at places within [a, z): pairs of query and value.

        All queries go down together; a node is left where its places or its values miss the ranges.
        """
        q = np.flatnonzero((a < z) & (low < high))
        a, z, value = a[q], z[q], np.zeros(len(q), np.int64)
        for level in range(self.bits):
            ones, zeros, half = self.ones[level], self.zeros[level], 1 << (self.bits - 1 - level)
            oa, oz = ones[a], ones[z]
            sides = []
            for b, x, y in ((0, a - oa, z - oz), (1, zeros + oa, zeros + oz)):
                v = value + b * half
                live = np.flatnonzero((x < y) & (v < high[q]) & (v + half > low[q]))
                sides.append((q[live], x[live], y[live], v[live]))
            q, a, z, value = (np.concatenate(c) for c in zip(*sides, strict=True))
        return q, value


def _order(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of words, and the common prefix of each with the one before it in that order."""
    rank = sorted(range(len(words)), key=words.__getitem__)
    table = np.array([words[i] for i in rank])
    code = table.view(np.uint32).reshape(len(words), -1) if len(words) else np.zeros((0, 1), np.uint32)
    common = np.zeros(len(words), np.int64)
    if len(words) > 1:
        differ = code[1:] != code[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), code.shape[1])
    return np.array(rank, np.int64), common


class Ranges:
    """Words of one length (members) and one shorter, in one order: the interval of members that share a word's first k code points."""

    def __init__(self, words: list[str], member: np.ndarray) -> None:
        order, self.common = _order(words)
        self.place = np.empty(len(words), np.int64)
        self.place[order] = np.arange(len(words))
        self.before = np.concatenate(([0], np.cumsum(member[order])))
        self.members = order[member[order]]

    def of(self, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        start = self.common < k
        start[:1] = True
        edges = np.append(np.flatnonzero(start), len(start))
        group = (np.cumsum(start) - 1)[self.place[which]]
        return self.before[edges[group]], self.before[edges[group + 1]]


def links(words: list[str], length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words one edit apart at a position within [low, high), each once.

    Words have ``length`` or one code point less; positions are those of the longer word.  Where a letter stands several times
    in a row, an insertion belongs to the first of its places.
    """
    member = np.array([len(w) == length for w in words], bool)
    if not member.any():
        return (np.empty(0, np.int64),) * 2
    forward, backward = Ranges(words, member), Ranges([w[::-1] for w in words], member)
    rank = np.empty(len(words), np.int64)
    rank[backward.members] = np.arange(len(backward.members))
    matrix = WaveletMatrix(rank[forward.members])
    same, shorter = np.flatnonzero(member), np.flatnonzero(~member)
    found = []
    for p in range(low, high):
        a, z = forward.of(same, p)
        q, v = matrix.report(a, z, *backward.of(same, length - 1 - p))
        i, j = same[q], backward.members[v]
        once = i < j
        found.append((i[once], j[once]))
        if len(shorter):
            a, z = forward.of(shorter, p)
            q, v = matrix.report(a, z, *backward.of(shorter, length - 1 - p))
            i, j = shorter[q], backward.members[v]
            if p:
                first = np.array([words[y][p] != words[y][p - 1] for y in j.tolist()], bool)
                i, j = i[first], j[first]
            found.append((i, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


_BLOCK = ["length", "low", "high", "key"]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their blocks to links in both directions: word, other, other_n."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][:3] == rows[at][:3]:
                end += 1
            words, n = [r[4] for r in rows[at:end]], [r[5] for r in rows[at:end]]
            i, j = (x.tolist() for x in links(words, *rows[at][:3]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in i + j], pa.string()), pa.array([words[k] for k in j + i], pa.string()), pa.array([n[k] for k in j + i], pa.int64())], schema=schema
            )
            at = end

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(held) >= TASK_ROWS and row[:4] != held[-1][:4]:
                yield from solve(held)
                held = []
            held.append(row)
    yield from solve(held)


def _keyed(rows: DataFrame) -> DataFrame:
    """The block of each row: a hash of what lies outside its positions (of the longer word).  Blocks that share one are only looked at together."""
    behind = F.expr("substring(word, high + 1 - (length - size), size)")
    return rows.withColumn("key", F.xxhash64("length", "low", "high", F.expr("substring(word, 1, low)"), behind))


def _halves(rows: DataFrame) -> DataFrame:
    middle = "low + cast((high - low + 1) / 2 AS int)"
    cut = f"explode(array(struct(low AS low, {middle} AS high), struct({middle} AS low, high AS high))) AS r"
    return _keyed(rows.selectExpr("word", "n", "size", "length", cut).select("word", "n", "size", "length", "r.low", "r.high"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, other, other_n: every two of the words (word, n; a written table) one edit apart, in both directions."""
    spark = words.sparkSession
    sized = words.selectExpr("word", "n", "char_length(word) AS size").selectExpr("*", "explode(array(size, size + 1)) AS length")
    rows, out = _halves(sized.selectExpr("word", "n", "size", "length", "0 AS low", "length AS high")), None
    while True:
        rows = written(rows)
        # a block without a word of its length, or with one word alone, has no link
        blocks = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr("size = length")).alias("own"), F.max(F.expr(f"high - low > 1 AND high - low > {WIDE}")).alias("wide"), F.max(F.expr("high - low > 1")).alias("more")).filter("rows > 1 AND own"))
        big = blocks.filter(F.col("wide") | (F.col("more") & (F.col("rows") > BLOCK_ROWS)))
        if big.isEmpty():
            some = rows.join(blocks.select("key"), "key", "left_semi")
        else:
            met = written(heavy_join(rows, blocks, ["key"], "rows"))
            split = F.col("wide") | (F.col("more") & (F.col("rows") > BLOCK_ROWS))
            some, rows = met.filter(~split).select(rows.columns), _halves(met.filter(split))
            out = some if out is None else out.unionByName(some)
            continue
        out = some if out is None else out.unionByName(some)
        break
    dealt = out.select(*_BLOCK, "word", "n").repartition(parallelism(spark), "key").sortWithinPartitions(*_BLOCK)
    return dealt.mapInArrow(lean(_linked), "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's forms.  forms: word, form of the words that have one."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        asked = written(at.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).join(ahead, "root", "left"))
        if asked.filter("next IS NOT NULL").isEmpty():
            return at
        at = written(heavy_join(at, asked, ["root"], "rows").select("word", F.coalesce("next", "root").alias("root")))


def group_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    form: of the words one edit away the one of largest n (ties: the smaller), if that is at least ``ratio`` times the word's.
    """
    if ratio < 2:
        raise ValueError("forms need a ratio of 2 at least, else they could lead in a circle")
    words = written(count_words(docs, least_length, least_count))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("best"))
    told = words.join(near, "word", "left")
    form_n = -F.col("best.m")
    has = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    told = written(told.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, form_n).alias("form_n")))
    roots = _roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
