"""Once-seen and twice-seen Bloom filters over 64-bit hashes, built in the cluster.

Each task turns its hashes into the set bits of two filters with one hash
function: bits seen once or more, and bits seen twice or more.  Only set bits
travel, as compressed gaps of sorted positions (one to three bytes a hash), cut
into ranges of the filter; merging keeps "twice" right: a bit set once on both
sides is set twice.  The size in bits is a parameter and so a proven bound of
what is broadcast; beyond it the filter fills up and lets more through, and the
exact step behind it sees more rows but gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import lean

RANGE_BITS = 20  # bits of the filter in one range, as a power of two
FAN_IN = 256
_SCHEMA = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_DDL = "range int, part int, once binary, twice binary"


def _squeeze(pos: np.ndarray) -> bytes:
    gaps = np.diff(pos, prepend=0).astype("<u4")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _spread(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def bit_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The position of a hash in a filter of 2**bits bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Twice:
    """The filter of bits seen twice or more; sorted positions, spread to a bitmap where it is used."""

    def __init__(self, bits: int, ranges: dict[int, bytes]) -> None:
        self.bits, self.ranges, self._map = bits, ranges, None

    def __getstate__(self):
        return self.bits, self.ranges

    def __setstate__(self, state):
        self.bits, self.ranges = state
        self._map = None

    def test(self, h: np.ndarray) -> np.ndarray:
        if self._map is None:
            self._map = np.zeros((1 << self.bits) // 8, np.uint8)
            for k, b in self.ranges.items():
                pos = _spread(b)
                at = (k << RANGE_BITS) + pos
                np.bitwise_or.at(self._map, at >> 3, (1 << (at & 7)).astype(np.uint8))
            self.ranges = {}
        at = bit_of(h, self.bits)
        return (self._map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _partials(hashes: Callable, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, n = [], 0
        for h in hashes(batches):
            held.append(bit_of(h, bits).astype(np.uint32))
            n += len(h)
            if n >= 1_000_000:
                yield _flush(held, part)
                held, n = [], 0
        if n:
            yield _flush(held, part)

    return run


def _flush(held: list[np.ndarray], part: int) -> pa.RecordBatch:
    pos, count = np.unique(np.concatenate(held), return_counts=True)
    rows = []
    which = pos >> RANGE_BITS
    for k in np.unique(which):
        a, b = np.searchsorted(which, [k, k + 1])
        local, more = pos[a:b] & ((1 << RANGE_BITS) - 1), count[a:b] > 1
        rows.append((int(k), part, _squeeze(local.astype(np.int64)), _squeeze(local[more].astype(np.int64))))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(1 << RANGE_BITS, np.uint8)
    for once, twice in zip(pdf["once"], pdf["twice"], strict=True):
        at = _spread(once)
        seen[at] = np.minimum(seen[at] + 1, 2)
        seen[_spread(twice)] = 2
    return pd.DataFrame({"range": [pdf["range"].iloc[0]], "part": [pdf["part"].min() // FAN_IN], "once": [_squeeze(np.flatnonzero(seen))], "twice": [_squeeze(np.flatnonzero(seen > 1))]}).astype({"range": "int32", "part": "int32"})


def twice_seen(df: DataFrame, hashes: Callable, bits: int) -> Twice:
    """The twice-seen filter of what ``hashes`` (Arrow batches to arrays of 64-bit hashes) gives over df.

    At most 2**bits / 8 bytes reach the driver and are broadcast.
    """
    parts = df.mapInArrow(lean(_partials(hashes, bits)), _DDL)
    n = df.rdd.getNumPartitions()
    while True:  # a tree: no task merges more than FAN_IN partial filters of a range
        group = F.floor(F.col("part") / FAN_IN).cast("int")
        parts = parts.groupBy("range", group.alias("g")).applyInPandas(_merge, _DDL)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    return Twice(bits, {r["range"]: bytes(r["twice"]) for r in parts.select("range", "twice").collect()})
