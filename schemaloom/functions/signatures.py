"""What two objects must share to be similar enough: tokens for a set-similarity join.

Every object of a kind gets an array of tokens, as a source and as a target, such that any two whose basic similarity reaches
the threshold have one in common.  They follow from the weights: what two objects share no token in can't add up to the
threshold.  Sets (columns, labels) use the prefix filter: ordered by hash, a set's first n - ceil(t n) + 1 elements meet those of
every set with a Jaccard index of t or more.  Lengths that must lie within a ratio fall into equal or neighbouring buckets of their
logarithm.

Sharing a token proves nothing; candidates are scored.  At thresholds up to LEAST objects with nothing in common can be similar,
and with names weighed in (advanced similarity) nothing need be shared: there all tokens are one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 0.35
_EPS = 1e-9


def token(tag: str, *parts: Column) -> Column:
    """A token of a tag and values, each behind its length; null where a value is null."""
    return F.concat(F.lit(tag), *[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def prefix(tag: str, elements: Column, t: float) -> Column:
    """Tokens of a set for a Jaccard index of at least t > 0; the empty set has one of its own."""
    x = F.array_distinct(F.coalesce(elements, F.array().cast("array<string>")))
    ordered = F.array_sort(F.transform(x, lambda v: F.struct(F.xxhash64(v).alias("h"), v.alias("v"))))
    n = F.size(x)
    keep = n - F.ceil(F.lit(t) * n - _EPS).cast("int") + 1
    first = F.slice(ordered, F.lit(1), F.greatest(F.least(keep, n), F.lit(0)))
    return F.when(n == 0, F.array(F.lit(f"{tag}[]"))).otherwise(F.transform(first, lambda v: token(tag, v["v"])))


def _some(*tokens: Column) -> Column:
    return F.array_compact(F.array(*tokens))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("~"))


def column(o: Column, t: float) -> Column:
    return F.array(token("c", F.coalesce(F.to_json(o["type"]), F.lit("~"))))


def constraint(o: Column, t: float) -> Column:
    ref = token("r", o["ref_table"], _text(o["ref_schema"]))
    fk = F.concat(_some(ref), prefix("f", o["columns"], min(1.0, 2 * t))) if t <= 0.5 else _some(ref)
    return (
        F.when(o["kind"].isin("PRIMARY KEY", "UNIQUE"), F.transform(prefix("k", o["columns"], t), lambda x: F.concat(o["kind"], x)))
        .when(o["kind"] == "FOREIGN KEY", fk).when(o["kind"] == "CHECK", _some(token("x", o["expression"]))).otherwise(F.array(token("e", F.coalesce(F.to_json(o["elements"]), F.lit("~")))))
    )


def index(o: Column, t: float) -> Column:
    sums = [a + b + c for a in (0.0, 0.2) for b in (0.0, 0.15) for c in (0.0, 0.15)]
    needed = [(t - w) / 0.5 for w in sums if t - w > _EPS]
    names = F.filter(F.transform(o["columns"], lambda c: c["column"]), lambda c: c.isNotNull())
    shared = prefix("i", names, min(1.0, min(needed)))
    alike = token("m", o["method"], o["is_unique"].cast("string"), F.coalesce(F.concat(F.lit("="), o["predicate"]), F.lit("~")))
    return F.concat(shared, _some(alike)) if t <= 0.5 + _EPS else shared


def view(o: Column, t: float, spread: int) -> Column:
    """spread: how many buckets to either side a target stands in."""
    same = token("d", o["definition"])
    ratio = (t - 0.3) / 0.3
    if ratio > 1 + _EPS:
        return _some(same)
    step = -math.log(min(ratio, 1.0)) or 1e-6
    bucket = F.floor(F.log(F.greatest(F.octet_length(o["definition"]), F.lit(1)).cast("double")) / step)
    near = [token("l", o["is_materialized"].cast("string"), (bucket + k).cast("string")) for k in range(-spread, spread + 1)]
    return _some(same, *near)


def sequence(o: Column, t: float) -> Column:
    kind = token("s", o["data_type"])
    steps = token("n", *[o[c].cast("string") for c in ("increment", "min_value", "max_value")])
    return _some(kind, steps) if t <= 0.5 + _EPS else _some(kind)


def enum(o: Column, t: float) -> Column:
    return prefix("v", o["labels"], t)


def table(o: Column, t: float) -> Column:
    return prefix("t", F.transform(o["columns"], lambda c: c["name"]), max((t - 0.3) / 0.7, _EPS))


def tokens(kind: str, o: Column, threshold: float, advanced: bool, target: bool) -> Column:
    """The tokens of an object (a struct of its kind)."""
    if threshold <= LEAST or (advanced and kind in ("table", "column")):
        return F.array(F.lit("*"))
    if kind == "view":
        return view(o, threshold, 1 if target else 0)
    return {"column": column, "constraint": constraint, "index": index, "sequence": sequence, "enum": enum, "table": table}[kind](o, threshold)
