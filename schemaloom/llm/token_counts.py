"""Token counts of whole texts by the whole-token shortcut.

Before any text is read, the driver proves which strings of the vocabulary are
*whole*: the library, given such a string alone, answers with that one token.
Byte-level BPE merges every pre-token by itself, so a whole string counts one
token wherever it stands as a pre-token, and no merge need be tried.  The table
of whole strings (a part of the vocabulary file, so its size is that file's and
not the corpus's) is broadcast.  Texts are pre-tokenised in numpy passes;
pre-tokens in the table are counted by a lookup of their bytes, and only
distinct others are merged, once for each slice of texts and seldom twice in a
worker, which remembers ``REMEMBERED`` of them.

Nothing is shuffled: every document is counted where it is read, so a hot
source or a long document changes nothing but its own task's share.

The result equals the library's for ``Tokenizer.from_file(path)`` without added
tokens: strings of special tokens inside a text count as one token and part the
text around them.  Files that aren't plain byte-level BPE are refused.

Nulls: a null text is an empty one (0 bytes, 0 tokens).  A null doc_id is kept.
Empty texts have 0 tokens.  Texts of any length are taken whole.  Repeated rows
are counted one by one.  An empty table gives an empty one.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import WIDE_SLICE, Slice, gather, lean, pretokens, slices, span_hashes

REMEMBERED = 200_000  # merged pre-tokens that a worker keeps: it forgets all when more have come
#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Spec:
    """What counting needs of a tokenizer's file: bytes of the vocabulary by id, and strings of special tokens, longest first."""

    ranks: dict[bytes, int]
    special: tuple[bytes, ...]


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str) -> Spec:
    """Read a tokenizer's JSON file; one that isn't byte-level BPE with ids in the order of its merges is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or not level or spec.get("normalizer") or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} is not plain byte-level BPE")
    byte, special = _alphabet(), {t["content"] for t in added}
    ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    return Spec(ranks, tuple(sorted((s.encode() for s in special), key=len, reverse=True)))


def whole_tokens(path: str) -> list[bytes]:
    """The proof: strings of the vocabulary that the library itself encodes alone as one token, theirs.

    Strings that aren't whole UTF-8 never stand as pre-tokens and are left to merging.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    spec, texts = load(path), {}
    for raw, k in spec.ranks.items():
        try:
            texts[raw.decode()] = k
        except UnicodeDecodeError:
            continue
    found = Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)
    return [t.encode() for (t, k), e in zip(texts.items(), found, strict=True) if e.ids == [k]]


def _table(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Whole strings by hash: hashes in order, the bytes, and each one's start and length.  Of two with one hash the first stays."""
    flat, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    h, at = np.unique(span_hashes(flat, ends - size, ends), return_index=True)
    return h, flat, (ends - size)[at], size[at]


@lru_cache(maxsize=2)
def _merger(path: str):
    """A function from one pre-token's bytes to its ids."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load(path).ranks, special_tokens={})
    return own._core_bpe.encode_single_piece


class Counter:
    """Counts tokens of pre-tokens: by the table of whole strings, or by merging."""

    def __init__(self, path: str, table: tuple[np.ndarray, ...]) -> None:
        self.merge, self.known, self.merged = _merger(path), {}, 0
        self.hash, self.flat, self.start, self.size = table

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, h = np.ones(len(starts), np.int64), span_hashes(data, starts, ends)
        rest = np.flatnonzero(~self._whole(data, starts, ends, h))
        if len(rest):
            out[rest] = self._merged(data, starts[rest], ends[rest], h[rest])
        return out

    def _whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(self.hash) or not len(h):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = (self.hash[at] == h) & (self.size[at] == ends - starts)
        pick = np.flatnonzero(hit)
        # the hash finds the string, its bytes decide
        want, cut = gather(self.flat, self.start, self.size, at[pick])
        have, _ = gather(data, starts, ends - starts, pick)
        wrong = np.flatnonzero(want != have)
        hit[pick[np.unique(np.searchsorted(cut, wrong, "right"))]] = False
        return hit

    def _merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        size = ends - starts
        if not np.array_equal(gather(data, starts, size, first[back])[0], gather(data, starts, size, np.arange(len(h)))[0]):
            first = back = np.arange(len(h))  # two pre-tokens share a hash
        n = np.empty(len(first), np.int64)
        for k, (a, z) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
            word = data[a:z].tobytes()
            got = self.known.get(word)
            if got is None:
                if len(self.known) >= REMEMBERED:
                    self.known = {}
                got = self.known[word] = len(self.merge(word))
                self.merged += 1
            n[k] = got
        return n[back]


def _parted(s: Slice, special: tuple[bytes, ...]) -> tuple[Slice, np.ndarray, np.ndarray]:
    """A slice without the strings of special tokens, parted where they stood; the document of each part, and its special tokens."""
    n = len(s.offsets) - 1
    raw = s.data.tobytes()
    if not any(t in raw for t in special):
        return s, np.arange(n), np.zeros(n, np.int64)
    match = regex.compile(b"|".join(map(regex.escape, special)))
    parts, of, count = [], [], np.zeros(n, np.int64)
    for i in range(n):
        text = s.text(i)
        cut = match.split(text) if any(t in text for t in special) else [text]
        parts += cut
        of += [i] * len(cut)
        count[i] = len(cut) - 1
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return Slice(s.rows, np.frombuffer(b"".join(parts), np.uint8), offsets), np.array(of, np.int64), count


def slice_counts(s: Slice, counter: Counter, special: tuple[bytes, ...]) -> np.ndarray:
    """Tokens of each text of a slice."""
    parted, of, out = _parted(s, special)
    starts, ends, first = pretokens(parted, PATTERN)
    total = np.concatenate(([0], np.cumsum(counter.counts(parted.data, starts, ends))))
    np.add.at(out, of, total[first[1:]] - total[first[:-1]])
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row.

    ``tokenizer_path`` must be readable on the executors too, where the merges are loaded.
    """
    spec = load(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast(_table(whole_tokens(tokenizer_path)))
    special = spec.special

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, sent.value)
        for s in slices(batches, cap=WIDE_SLICE):
            n = slice_counts(s, counter, special)
            ids = s.rows.column(s.rows.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(s.offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
