"""Best-fit packing of token sequences by hierarchical residual packing.

Every document becomes its ids and a closing id; only longer ones are cut, into
full pieces behind a shorter first one.  Full pieces are bins of their own.
The rest is packed best-fit, largest first, in each partition; bins that are
nearly full are emitted, underfull ones become items of the next round, in
which fewer tasks merge them again (a tree), until one task's worth is left.

Memory: a task holds the sizes of its items and a list of item ids per bin, and
the fan-in keeps a round's task near ``ITEMS_PER_TASK`` items.  Bins that no
round can improve (a round frees less than 1 of 500) are emitted as they are,
so no unbounded remainder meets in one task.

Nulls: a null text is an empty one, of the closing id alone.  A null doc_id is
kept.  Repeated rows are packed one by one.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import WIDE_SLICE, gather, lean, pretokens, slices
from .batches import span_hashes as _hashes
from .spark_util import written

ITEMS_PER_TASK = 200_000
NEARLY_FULL = 4  # tokens that an emitted bin may lack, but in the last round
#: Fixed value: how byte-level BPE splits text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _piece_encoder(path: str):
    """Ids of one pre-token by the file's own vocabulary, and the strings of its special tokens."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: printable ones stand for themselves
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    own = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own._core_bpe.encode_single_piece, sorted(x.encode() for x in special)


class IdCache:
    """Ids of pre-tokens met before, by 64-bit hash and their bytes; forgotten beyond ``limit`` words."""

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        self.path, self.limit = path, limit
        self.encode, self.special = _piece_encoder(path)
        self.reset()

    def reset(self) -> None:
        self.hash, self.ids, self.words = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint8)
        self.start, self.size, self.at, self.length = (np.empty(0, np.int64) for _ in range(4))

    def add(self, h: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        """h: sorted hashes not yet known, of words that lie one after the other in flat."""
        if len(self.hash) + len(h) > self.limit:
            self.reset()
        raw, ids, size, z = flat.tobytes(), [], np.empty(len(h), np.int64), 0
        for k, n in enumerate(length.tolist()):
            got = self.encode(raw[z : z + n])
            ids += got
            size[k] = len(got)
            z += n
        at = np.searchsorted(self.hash, h)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(size) - size)
        self.at = np.insert(self.at, at, len(self.words) + np.cumsum(length) - length)
        self.size, self.length, self.hash = np.insert(self.size, at, size), np.insert(self.length, at, length), np.insert(self.hash, at, h)
        self.ids, self.words = np.concatenate((self.ids, np.array(ids, np.uint32))), np.concatenate((self.words, flat))

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens of a buffer, and where those of each end."""
        h, at, inv = np.unique(_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = np.isin(h, self.hash, assume_unique=True)
        if len(self.hash) + int((~known).sum()) > self.limit:
            self.reset()
            known[:] = False
        if not known.all():
            a, z = starts[at[~known]], ends[at[~known]]
            self.add(h[~known], gather(data, a, z - a, np.arange(len(a)))[0], z - a)
        pick = np.searchsorted(self.hash, h)[inv]
        # the words looked up, put together, must be the text: hashes alone don't decide
        if np.array_equal(gather(self.words, self.at, self.length, pick)[0], data):
            return gather(self.ids, self.start, self.size, pick)
        raw = data.tobytes()
        each = [self.encode(raw[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each], dtype=np.int64)


@lru_cache(maxsize=1)
def id_cache(path: str) -> IdCache:
    return IdCache(path)


def slice_ids(s, cache: IdCache) -> list[np.ndarray]:
    """Ids of each text of a slice, as the tokenizers library gives them.

    A pre-token met before isn't encoded again; texts that hold a special
    token's string go through the library itself.
    """
    starts, ends, first = pretokens(s, BYTE_PATTERN)
    flat, stop = cache.ids_of(s.data, starts, ends)
    stop = np.concatenate(([0], stop))
    out = [flat[stop[first[i]] : stop[first[i + 1]]] for i in range(len(first) - 1)]
    raw = s.data.tobytes()
    for t in cache.special:
        if t in raw:
            for i in range(len(out)):
                if t in s.text(i):
                    out[i] = np.array(_tokenizer(cache.path).encode(s.text(i).decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, closing_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = id_cache(tokenizer_path)
        for s in slices(batches, cap=WIDE_SLICE):
            rows = []
            for d, ids in zip(s.column("doc_id"), slice_ids(s, cache), strict=True):
                ids = np.append(ids, np.uint32(closing_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for k in range(len(cuts) - 1):
                    part = ids[cuts[k] : cuts[k + 1]]
                    rows.append((d, k, cuts[k], len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: largest first, each into the fullest bin that holds it.

    A bit mask of the residuals in use finds that bin in constant time.
    """
    bins: list[list[int]] = []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        z = sizes[i]
        fit = mask >> z << z
        if fit:
            left = (fit & -fit).bit_length() - 1
            b = open_by[left].pop()
            if not open_by[left]:
                mask &= ~(1 << left)
            bins[b].append(i)
            left -= z
        else:
            b = len(bins)
            bins.append([i])
            left = capacity - z
        open_by[left].append(b)
        if left:
            mask |= 1 << left
    return bins


_BIN = "size long, full boolean, content array<struct<item:long,offset:int>>"


def _round(capacity: int, slack: int):
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Items and underfull bins of one task into bins."""
        size: list[int] = []
        content: list = []
        for f in frames:
            size += f["size"].tolist()
            content += f["content"].tolist()
        out = []
        for b in best_fit(size, capacity):
            total = sum(size[i] for i in b)
            held, base = [], 0
            for i in b:
                held += [{"item": int(x["item"]), "offset": base + int(x["offset"])} for x in content[i]]
                base += size[i]
            out.append((total, total >= capacity - slack, held))
            if len(out) >= 5_000:
                yield pd.DataFrame(out, columns=["size", "full", "content"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["size", "full", "content"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, closing_id: int = 2, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Pack all documents into as few sequences as the rounds find.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; the
    offsets of a sequence are gapless from 0.
    """
    spark = docs.sparkSession
    all_pieces = written(pieces(docs, tokenizer_path, capacity, closing_id).withColumn("item", F.monotonically_increasing_id()))
    whole = all_pieces.filter(F.col("length") == capacity)
    small = all_pieces.filter(F.col("length") < capacity)
    one = F.array(F.struct(F.col("item"), F.lit(0).alias("offset")))
    items = small.select(F.col("length").alias("size"), F.lit(False).alias("full"), one.alias("content"))
    left = small.count()
    done: list[DataFrame] = []
    tasks = max(1, -(-left // items_per_task))
    tasks = max(tasks, min(8, -(-left // 20_000)))
    before = None
    while left:
        dealt = items.repartition(tasks, F.xxhash64(F.col("content")[0]["item"]))
        bins = written(dealt.mapInPandas(lean(_round(capacity, NEARLY_FULL)), _BIN))
        done.append(bins.filter("full"))
        items = bins.filter(~F.col("full"))
        now = items.count()
        if tasks == 1 or now == 0 or (before is not None and now > before - before // 500):
            done.append(items)
            break
        before = left = now
        tasks = max(1, min(tasks // 4, -(-now // items_per_task)))
    seq = None
    for k, d in enumerate(done):
        d = d.select("content", (F.monotonically_increasing_id() * 64 + k + 1).alias("sequence_id"))
        seq = d if seq is None else seq.unionByName(d)
    whole = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("item") * 64).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if seq is None:
        return whole
    placed = seq.select("sequence_id", F.explode("content").alias("x")).select("sequence_id", F.col("x.item").alias("item"), F.col("x.offset").cast("long").alias("offset"))
    # no broadcast: the placements grow with the corpus
    packed = small.hint("merge").join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return packed.unionByName(whole)
