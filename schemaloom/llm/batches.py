"""Vectorised work on Arrow batches of whole texts.

A *slice* is a run of consecutive documents of one Arrow batch, at most
``cap`` bytes unless a single document is longer.  Its texts lie one after the
other in one byte buffer, so splitting, hashing and windowing are numpy passes
over the buffer instead of Python loops over words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash

SLICE_BYTES = 512 << 10  # what passes over words allocate is some 60 times this
WIDE_SLICE = 2 << 20  # for passes that gain from seeing a word once in more text

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass
class Slice:
    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def column(self, name: str) -> list:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_pylist()


def tidy() -> None:
    """Give freed memory back to the system: workers stay for later tasks, and what they hold adds up on an executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: nothing to ask for
    _libc = None


def lean(f: Callable) -> Callable:
    """A function over batches that tidies up behind itself."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", cap: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut Arrow batches with a binary column ``text`` into slices; null texts count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        if col.null_count:
            col = col.fill_null(b"")
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        i, n = 0, len(col)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + cap, "right")) - 1)
            j = min(j, n)
            yield Slice(batch.slice(i, j - i), flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(0)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (64 << 10))
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(size, np.uint64(base), np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


LONG = 64  # polynomials modulo 2**64 can be made to collide from some 1,000 bytes on; longer spans are hashed as bytes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]: from prefix sums of a polynomial, and of the bytes themselves where they are over LONG."""
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    size = ends - starts
    out = mix((total[ends] - total[starts]) * down[starts] + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(s: Slice, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space): starts, ends, hashes, and for each document its first word."""
    data = _LOWER[s.data] if lower else s.data
    gap = _SPACE[data]
    begin = ~gap
    begin[1:] &= gap[:-1]
    edge = s.offsets[:-1][s.offsets[:-1] < s.offsets[1:]]
    begin[edge] = ~gap[edge]
    stop = np.empty(len(data) + 1, bool)
    stop[0] = False
    stop[1:] = ~gap
    stop[1:-1] &= gap[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    first = np.searchsorted(starts, s.offsets)
    return starts, ends, span_hashes(data, starts, ends), first


# ---- pre-tokens of byte-level BPE -----------------------------------------

#: White space as the pattern's \s means it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def exact_pattern(pattern: str) -> regex.Pattern:
    """The pattern with its white-space class spelled out, as the token libraries understand it."""
    p = pattern.replace(r"[^\s", "[^" + _WS).replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]")
    return regex.compile(p)


_KIND = np.full(256, 3, np.uint8)  # 1 letter, 2 digit, 3 other, 4 space
_KIND[_SPACE] = 4
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def _irregular(data: np.ndarray) -> np.ndarray:
    """Positions that only the pattern itself may judge: apostrophes and what is not ASCII or a Latin letter."""
    odd = data == 39
    high = data >= 0x80
    if high.any():
        lead = data >= 0xC0
        odd |= lead & ((data < 0xC3) | (data > 0xC5))
        tail = high & ~lead
        before = np.empty_like(lead)
        before[:1] = False
        before[1:] = lead[:-1]
        odd |= tail & ~before
        odd[:-1] |= lead[:-1] & ~tail[1:]
        odd[-1:] |= lead[-1:]
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    return np.flatnonzero(odd)


def pretokens(s: Slice, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pattern's matches over each whole text, and for each document its first match.

    ``pattern`` is the common byte-level one (contractions; optional space and
    letters, digits or others; white space).  Ordinary text is split by byte
    classes; documents with anything irregular go through the pattern itself.
    """
    data, n = s.data, len(s.data)
    kind = _KIND[data]
    gap = kind == 4
    begin = np.zeros(n, bool)
    if n:
        begin[1:] = kind[1:] != kind[:-1]
        begin[1:] &= ~((data[:-1] == 32) & ~gap[1:])  # a space joins what follows
        edges = s.offsets[:-1][s.offsets[:-1] < s.offsets[1:]]
        last = np.zeros(n, bool)
        last[:-1] = gap[:-1] & ~gap[1:]
        inner = s.offsets[1:-1]
        last[inner[(inner > 0) & (inner < n)] - 1] = False
        last[-1] = False
        last[1:] &= gap[:-1]
        begin |= last  # the last of several spaces stands alone or joins what follows
        begin[edges] = True
        odd = _irregular(data)
        if len(odd):
            match = exact_pattern(pattern)
            for i in np.unique(np.searchsorted(s.offsets, odd, "right") - 1):
                a, b = s.offsets[i], s.offsets[i + 1]
                begin[a:b] = False
                found = match.findall(s.text(i).decode("utf-8", "surrogateescape"))
                sizes = [len(x.encode("utf-8", "surrogateescape")) for x in found]
                begin[a + np.concatenate(([0], np.cumsum(sizes[:-1], dtype=np.int64)))] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, s.offsets)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[start[p]:start[p]+size[p]] for p in pick; also the end of each."""
    n = size[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(start[pick] - (ends - n), n)
    return flat[at], ends
