"""URL filters by Bloom filter cascades: exact membership without joins.

A cascade answers, for every key of a known universe, whether it is listed.
Level 0 encodes the listed keys; level 1 the universe's keys that level 0
takes for listed wrongly; level 2 the listed keys that level 1 takes wrongly;
and so on until nothing is wrong.  The universe is complete: all keys that the
corpus can ask about, so the answer over the corpus is exact.

Building shuffles distinct keys once, map-side combined.  The first level is
sized so that about as many unlisted keys pass it as there are listed ones, so a
cascade's bytes follow the list and not the corpus.  A cascade is broadcast, and
never over ``MAX_BYTES``: the keys of a longer list are dealt to parts by hash, each
part has a cascade of its own over the part's keys, and rows pass them one after
the other, with a written table between.

Null URLs and URLs without ``://`` have an empty host and path and meet no
rule.  Repeated rows, and rows with a repeated or null page_id, are judged one
by one.  Extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import lean
from .spark_util import written

MAX_BYTES = 32 << 20
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


class Bloom:
    """A filter for n keys that lets a share ``rate`` of others through."""

    def __init__(self, n: int, seed: int, rate: float = 0.01) -> None:
        self.seed, self.probes = seed, max(1, round(-np.log2(rate)))
        self.m = max(1024, -(-int(n * -np.log(rate) / np.log(2) ** 2 + 1) // 8) * 8)
        self.bits = np.zeros(self.m // 8, np.uint8)

    def positions(self, keys: Iterable[str]) -> np.ndarray:
        h = np.array([divmod(xxhash.xxh3_128_intdigest(k.encode(), self.seed), 1 << 64) for k in keys], np.uint64).reshape(-1, 2)
        step = h[:, 1:] | np.uint64(1)
        return ((h[:, :1] + np.arange(self.probes, dtype=np.uint64) * step) % np.uint64(self.m)).astype(np.int64)

    def test(self, keys: list[str]) -> np.ndarray:
        at = self.positions(keys)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)

    def union(self, parts: Iterable[bytes]) -> Bloom:
        for p in parts:
            self.bits |= np.frombuffer(p, np.uint8)
        return self


class Cascade:
    """Levels of Bloom filters; exact for every key of the universe it was built over."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    @property
    def size(self) -> int:
        return sum(len(b.bits) for b in self.levels)

    def test(self, keys: list[str]) -> np.ndarray:
        keys = list(keys)
        verdict = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            hit = level.test([keys[i] for i in open_])
            verdict[open_[~hit]] = k % 2 == 1
            open_ = open_[hit]
        verdict[open_] = len(self.levels) % 2 == 1
        return verdict


def _level(keys: DataFrame, empty: Bloom) -> Bloom:
    """The filter over all keys: one partial filter per task, merged here one by one."""
    m, seed, probes = empty.m, empty.seed, empty.probes

    def partial(frames):
        b, some = Bloom(1, seed), False
        b.m, b.probes, b.bits = m, probes, np.zeros(m // 8, np.uint8)
        for f in frames:
            if len(f):
                at = b.positions(f["key"]).ravel()
                np.bitwise_or.at(b.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
                some = True
        if some:
            yield pd.DataFrame({"bits": [b.bits.tobytes()]})

    # so many tasks that their partial filters together stay within MAX_BYTES
    tasks = max(1, min(keys.rdd.getNumPartitions(), MAX_BYTES // len(empty.bits)))
    return empty.union(r["bits"] for r in keys.coalesce(tasks).mapInPandas(lean(partial), "bits binary").collect())


def _passes(cascade: Cascade):
    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        hit = np.ones(len(keys), bool)
        for level in cascade.levels:
            some = np.flatnonzero(hit)
            hit[some] = level.test(keys.iloc[some].tolist())
        return pd.Series(hit)

    return passes


def build(listed: DataFrame, universe: DataFrame, limit: int = MAX_BYTES) -> Cascade | None:
    """The cascade of listed.key over universe.key; None if it would exceed ``limit`` bytes."""
    tagged = listed.select("key", F.lit(True).alias("listed")).unionByName(universe.select("key", F.lit(False).alias("listed")))
    keys = written(tagged.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")))
    sizes = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    out = Cascade()
    if not sizes.get(True):
        return out
    # the first level lets through about as many others as there are listed keys, so the size follows the list and not the corpus
    rate = float(np.clip(sizes[True] / max(1, sizes.get(False, 0)), 1e-9, 0.5))
    for seed in range(64):
        side = keys.filter(F.col("listed") == F.lit(seed % 2 == 0))
        todo = side.filter(_passes(out)("key")) if out.levels else side
        n = todo.count()
        if n == 0:
            return out
        level = Bloom(n, seed, 0.01 if seed else rate)
        if out.size + len(level.bits) > limit:
            return None
        out.levels.append(_level(todo.select("key"), level))
    raise RuntimeError("the cascade didn't end")


LEAST_BYTES = 4096  # of a part: a filter has a size that no splitting lowers


class Part:
    """The cascade of the keys whose hash falls to one part of several; all others are not listed by it."""

    def __init__(self, cascade: Cascade, k: int, parts: int) -> None:
        self.cascade, self.k, self.parts = cascade, k, parts

    def test(self, keys: list[str]) -> np.ndarray:
        if self.parts == 1:
            return self.cascade.test(keys)
        out = np.zeros(len(keys), bool)
        own = [i for i, x in enumerate(keys) if zlib.crc32(x.encode()) % self.parts == self.k]
        out[own] = self.cascade.test([keys[i] for i in own])
        return out


def build_parts(listed: DataFrame, universe: DataFrame, limit: int = MAX_BYTES) -> list[Part]:
    """Cascades of at most ``limit`` bytes (LEAST_BYTES at least) that together answer for every key of the universe.

    They are kept on the driver one beside the other, so the list itself must fit there (about ten bits a key).
    """
    limit, parts = max(limit, LEAST_BYTES), 1
    while True:
        out: list[Part] = []
        for k in range(parts):
            own = lambda df, k=k: df.select("key") if parts == 1 else df.select("key").filter(F.crc32(F.col("key").cast("binary")) % parts == k)  # noqa: E731, B023
            cascade = build(own(listed), own(universe), limit)
            if cascade is None:
                break
            out.append(Part(cascade, k, parts))
        else:
            return out
        parts *= 2


def member(keys: DataFrame, listed: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Distinct keys of ``keys`` with a flag ``listed``."""
    parts = build_parts(listed, keys, limit)
    out = keys.select("key").distinct().withColumn("listed", F.lit(False))
    for part in parts:
        test = F.pandas_udf(lambda k, part=part: pd.Series(part.test(k.tolist())), "boolean")
        out = out.withColumn("listed", F.col("listed") | test("key"))
        out = written(out) if len(parts) > 1 else out
    return out


def suffixes(h: str) -> list[str]:
    """A host and the domains above it."""
    labels = h.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def judge(pages: DataFrame, rules: dict[str, list[tuple[str, str]]], listed_domains: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict.

    rules: {"block": [(host, path)], "allow": [...]}; a rule fits its host and
    all subdomains if the url's path starts with its path; the longest wins
    (the longer host among equals).  Without a rule, hosts that are a listed
    domain (``listed_domains.key``) or lie under one are blocked, all others
    allowed.
    """
    lengths = sorted({len(p) for r in rules.values() for _, p in r})
    most = max(lengths, default=0)
    spark = pages.sparkSession
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    asked = written(split.select("host", F.substring("path", 1, most).alias("head")).distinct())

    @F.pandas_udf("array<string>")
    def candidates(h: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_candidates(a, b, lengths) for a, b in zip(h, p, strict=True)])

    universe = asked.select(F.explode(candidates("host", "head")).alias("key"))
    cascades = {}
    for kind, listed in rules.items():
        # rules are given in code and the cascade's size follows their number, so it is always small
        cascades[kind] = build(spark.createDataFrame([(a + b,) for a, b in listed] or [(None,)], "key string"), universe, 1 << 62)
    domains = asked.select("host", F.explode(F.pandas_udf(lambda h: h.map(suffixes), "array<string>")("host")).alias("key"))
    parts = build_parts(listed_domains, domains.select("key"), limit)
    split = split.withColumn("on_list", F.lit(False))
    for part in parts:
        split = split.withColumn("on_list", F.col("on_list") | F.pandas_udf(lambda h, part=part: _under(h, part), "boolean")("host"))
        split = written(split) if len(parts) > 1 else split

    @F.pandas_udf("rule string, verdict string")
    def decide(h: pd.Series, p: pd.Series, on_list: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = []
        for a, b, c in zip(h, p, on_list, strict=True):
            k = (a, b[:most])
            if k not in known:
                keys = _candidates(a, b[:most], lengths)
                hits = {kind: [x for x, y in zip(keys, t.test(keys), strict=True) if y] for kind, t in cascades.items()}
                known[k] = max(((len(x), x.find("/"), x, kind) for kind, found in hits.items() for x in found), default=None)
            best = known[k]
            out.append((best[2], best[3]) if best else (None, "block" if c else "allow"))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    found = split.withColumn("x", decide("host", "path", "on_list"))
    return found.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.col("x.verdict").alias("verdict"))


def _under(hosts: pd.Series, cascade: Part) -> pd.Series:
    """Whether a host or a domain above it is listed."""
    names = hosts.unique()
    above = [suffixes(h) for h in names]
    flat = cascade.test([x for a in above for x in a])
    ends = np.cumsum([len(a) for a in above])
    hit = {h: bool(flat[e - len(a) : e].any()) for h, a, e in zip(names, above, ends, strict=True)}
    return hosts.map(hit)


def _candidates(h: str, p: str, lengths: list[int]) -> list[str]:
    """Every rule string that could fit: each domain above the host with each path prefix of a rule's length."""
    return [d + p[:n] for d in suffixes(h) if d for n in lengths if len(p) >= n]
