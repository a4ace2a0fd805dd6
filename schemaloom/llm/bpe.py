"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Whole texts are pre-tokenised in blocks.  A block (one run of documents in one
task) keeps, for each pre-token position, the index of its word in the block's
dictionary; the dictionary's words are dealt by hash to word buckets.  There
every distinct word of the corpus is encoded once; its ids go back to the
blocks that asked, which reassemble their documents by position.  Decoding
joins ids with the fixed token-byte table.

Words are told apart by their bytes: a block whose dictionary doesn't give its
texts back (two words with one 64-bit hash) is read again with another hash.

Skew: a frequent word crosses the shuffle once per block, never once per
occurrence.  Memory: a block is bounded in bytes (or one document); a bucket's
askers come in a stream, and only its distinct words are held, a share of the
vocabulary that falls with the number of buckets.

Nulls: a null text is an empty text (no tokens).  A null doc_id is kept.
Repeated rows give repeated result rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import WIDE_SLICE, gather, lean, mix, pretokens, slices, span_hashes
from .spark_util import parallelism

BLOCK_BYTES = 32 << 20


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def piece_encoder(path: str, pattern: str):
    """A function from one pre-token's bytes to its ids."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return own._core_bpe.encode_single_piece


@lru_cache(maxsize=4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and each id's start and length."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        by_id[v] = k
    size = np.array([len(x) for x in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(size) - size, size


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, start, size = token_table(path)
    return gather(flat, start, size, ids)[0].tobytes()


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


class Collision(Exception):
    """Two different words of a block share a hash."""


class Block:
    """Distinct words of a run of slices, and each document's positions as indexes into them (the most frequent word first)."""

    def __init__(self, seed: int) -> None:
        self.seed, self.bytes, self.docs, self.seen = seed, 0, [], []
        self.known = np.empty(0, np.uint64)
        self.flat, self.start, self.size, self.count = np.empty(0, np.uint8), *(np.empty(0, np.int64) for _ in range(3))

    def add(self, s, pattern: str) -> None:
        starts, ends, first = pretokens(s, pattern)
        if self.seed:
            data = s.data.tobytes()
            h = np.array([xxhash.xxh3_64_intdigest(data[a:z], self.seed) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        else:
            h = span_hashes(s.data, starts, ends)
        u, at, inv, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        new = np.flatnonzero(~np.isin(u, self.known, assume_unique=True))
        a, z = starts[at[new]], ends[at[new]]
        place = np.searchsorted(self.known, u[new])
        self.start = np.insert(self.start, place, len(self.flat) + np.cumsum(z - a) - (z - a))
        self.size, self.known = np.insert(self.size, place, z - a), np.insert(self.known, place, u[new])
        self.count = np.insert(self.count, place, 0)
        self.flat = np.concatenate((self.flat, gather(s.data, a, z - a, np.arange(len(new)))[0]))
        where = np.searchsorted(self.known, u)
        self.count[where] += n
        # the dictionary's words, put together again, must be the text: hashes alone don't decide
        if not np.array_equal(gather(self.flat, self.start, self.size, where[inv])[0], s.data):
            raise Collision
        ids = s.rows.column(s.rows.schema.get_field_index("doc_id")).to_pylist()
        self.docs.append((ids, h, first, [hashlib.sha256(s.text(i)).digest() for i in range(len(ids))]))
        self.bytes += len(s.data)

    def rank(self) -> np.ndarray:
        """The place of every known word in the block's dictionary order."""
        out = np.empty(len(self.known), np.uint32)
        out[np.argsort(-self.count, kind="stable")] = np.arange(len(self.known))
        return out

    def mark(self) -> int:
        """The block's name, from its ids and texts: words and positions read apart then meet, or not at all."""
        parts = [x for ids, _, _, sha in self.docs for x in (str(ids).encode(), *sha)]
        return xxhash.xxh3_64_intdigest(b"".join(parts)) - (1 << 63)


def blocks(batches: Iterator[pa.RecordBatch], pattern: str, most: int = BLOCK_BYTES) -> Iterator[Block]:
    held, size = [], 0
    for s in slices(batches, cap=WIDE_SLICE):
        held.append(s)
        size += len(s.data)
        if size >= most:
            yield _block(held, pattern)
            held, size = [], 0
    if held:
        yield _block(held, pattern)


def _block(held: list, pattern: str) -> Block:
    for seed in range(64):
        b = Block(seed)
        try:
            for s in held:
                b.add(s, pattern)
            return b
        except Collision:
            continue
    raise RuntimeError("no hash tells the words of a block apart")


def _bucket(b: Block, buckets: int) -> np.ndarray:
    """The word bucket of every word, in dictionary order."""
    out = np.empty(len(b.known), np.int64)
    out[b.rank()] = (mix(b.known) % np.uint64(buckets)).astype(np.int64)
    return out


def _words_of(pattern: str, buckets: int, most: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and bucket its words, in dictionary order."""
        for b in blocks(batches, pattern, most):
            name, of = b.mark(), _bucket(b, buckets)
            place = np.empty(len(of), np.int64)
            place[b.rank()] = np.arange(len(of))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            out: dict[str, list] = {f: [] for f in schema.names}
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                pick = place[order[cuts[k] : cuts[k + 1]]]
                for c, v in zip(out, (k, name, pack(gather(b.flat, b.start, b.size, pick)[0]), pack(b.size[pick].astype(np.uint32))), strict=True):
                    out[c].append(v)
                if len(out["block"]) >= 500:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out = {f: [] for f in schema.names}
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


_PARTS = "block long, at int, data binary"


def _encoded(path: str, pattern: str):
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their buckets: each distinct word of a bucket is encoded once, however many blocks ask for it."""
        encode, bucket, known = piece_encoder(path, pattern), None, {}
        for b in batches:
            out = []
            for k, words, sizes in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if k != bucket:
                    bucket, known = k, {}
                flat, at, ids, n = unpack(words, np.uint8).tobytes(), 0, [], []
                for z in unpack(sizes, np.uint32).tolist():
                    w = flat[at : at + z]
                    at += z
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids += got
                    n.append(len(got))
                counts = pack(np.array(n, "<u4"))
                out.append(len(counts).to_bytes(8, "little") + counts + pack(np.array(ids, "<u4")))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(out, pa.binary())], schema=schema)

    return run


def _positions_of(pattern: str, buckets: int, most: int):
    """One row for each block, at -1: its documents' ids, positions, bounds and digests."""
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, pattern, most):
            rank = b.rank()
            ids, idx, bounds, digests, base = [], [], [0], [], 0
            for d, h, first, sha in b.docs:
                ids += d
                idx.append(rank[np.searchsorted(b.known, h)])
                bounds += (first[1:] + base).tolist()
                base += len(h)
                digests += sha
            parts = [pack(np.frombuffer(json.dumps(ids).encode(), np.uint8)), _pack_planes(np.concatenate(idx)), _pack_planes(_bucket(b, buckets)), pack(np.array(bounds, np.int64)), pack(np.frombuffer(b"".join(digests), np.uint8))]
            data = np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts)
            yield pa.RecordBatch.from_pydict({"block": [b.mark()], "at": [-1], "data": [data]}, schema=schema)

    return run


def _pack_planes(a: np.ndarray) -> bytes:
    """Byte planes of small integers, compressed: the low and the high bytes repeat apart."""
    planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _reassemble(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block: its words' ids in dictionary order, then joined by position."""
        heads, told = pdf[pdf["at"] < 0], pdf[pdf["at"] >= 0]
        told = told.drop_duplicates("at").sort_values("at")  # blocks that are equal throughout asked twice
        if not len(heads):
            raise RuntimeError("a block's positions are missing: its input rows changed between two reads")
        parts = [(x[8 : 8 + (n := int.from_bytes(x[:8], "little"))], x[8 + n :]) for x in told["data"]]
        size = np.concatenate([unpack(x, "<u4") for x, _ in parts] or [np.empty(0, "<u4")]).astype(np.int64)
        flat = np.concatenate([unpack(x, "<u4") for _, x in parts] or [np.empty(0, "<u4")])
        rows = []
        for head in heads["data"]:
            ends = np.cumsum(np.frombuffer(head, "<i8", 5)) + 40
            names, positions, of, bounds, sha = (head[a:z] for a, z in zip([40, *ends[:-1].tolist()], ends.tolist(), strict=True))
            doc_ids, order = json.loads(unpack(names, np.uint8).tobytes()), np.argsort(_unpack_planes(of), kind="stable")
            if len(order) != len(size):
                raise RuntimeError("a block's words are missing: its input rows changed between two reads")
            start_at, size_at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            start_at[order], size_at[order] = np.cumsum(size) - size, size
            pos, bounds, sha = _unpack_planes(positions), unpack(bounds, np.int64), unpack(sha, np.uint8).tobytes()
            for i, d in enumerate(doc_ids):
                ids, _ = gather(flat, start_at, size_at, pos[bounds[i] : bounds[i + 1]])
                decoded = hashlib.sha256(decode_ids(ids, path))
                if decoded.digest() != sha[32 * i : 32 * i + 32]:
                    raise RuntimeError(f"document {d}: decoding does not give its text back")
                rows.append((d, len(ids), ids.astype("<u4").tobytes(), decoded.hexdigest()))
        out = pd.DataFrame([r[1:] for r in rows], columns=["n_tokens", "ids", "decoded_sha256"])
        out.insert(0, "doc_id", pd.array([r[0] for r in rows], "Int64"))  # a null beside them must not turn ids into doubles
        return out

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, buckets: int | None = None, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every whole text, then decode the ids and check the round trip.

    Returns doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; with
    ``digest`` instead ids_sha256 of the decimal ids joined by commas) and
    decoded_sha256.  ``buckets``: word buckets, by default twice the shuffle
    partitions.  Input rows must read the same twice (files do); a block whose
    rows changed raises instead of giving wrong ids.
    """
    n = buckets or 2 * parallelism(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = texts.mapInArrow(lean(_words_of(pattern, n, block_bytes)), "bucket int, block long, words binary, sizes binary")
    dealt = asked.repartition(parallelism(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(lean(_encoded(ranks_path, pattern)), _PARTS).unionByName(texts.mapInArrow(lean(_positions_of(pattern, n, block_bytes)), _PARTS))
    whole = _reassemble(ranks_path)
    if not digest:
        return parts.groupBy("block").applyInPandas(whole, "doc_id long, n_tokens long, ids binary, decoded_sha256 string")

    def digested(pdf: pd.DataFrame) -> pd.DataFrame:
        out = whole(pdf)
        out["ids_sha256"] = [hashlib.sha256(",".join(map(str, np.frombuffer(x, "<u4").tolist())).encode()).hexdigest() for x in out["ids"]]
        return out[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return parts.groupBy("block").applyInPandas(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Texts back from ``ids`` (as encode returns them), by the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else decode_ids(np.frombuffer(x, "<u4"), ranks_path) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
