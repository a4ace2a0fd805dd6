"""Similarity of schema objects as column expressions; weights and their addition order are fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit(same: Column, weight: float) -> Column:
    return F.when(same, F.lit(weight)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: two empty ones are alike, one empty is unlike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def _prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, 0).when(F.size(at) == 0, n).otherwise(F.array_min(at) - 1)


def pattern_bonus(a: Column, b: Column) -> Column:
    """For a common prefix or suffix of three or more, containment, and shared words of _ or - names."""
    short, long_ = F.least(F.octet_length(a), F.octet_length(b)), F.greatest(F.octet_length(a), F.octet_length(b))
    pre, suf = _prefix(a, b), _prefix(F.reverse(a), F.reverse(b))
    wa, wb = F.array_distinct(F.split(a, "[_-]", -1)), F.array_distinct(F.split(b, "[_-]", -1))
    words = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    total = F.when(pre >= 3, F.lit(0.3) * (pre / short)).otherwise(0.0) + F.when(suf >= 3, F.lit(0.3) * (suf / short)).otherwise(0.0)
    total = total + F.when(F.contains(a, b) | F.contains(b, a), F.lit(0.4) * (short / long_)).otherwise(0.0)
    return F.least(total + F.lit(0.3) * words, F.lit(1.0))


def name_similarity(a: Column, b: Column) -> Column:
    """Edit distance in characters over the longer length in bytes, and the bonus."""
    x, y = F.lower(a), F.lower(b)
    edit = F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.octet_length(x), F.octet_length(y))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.least(edit * 0.7 + pattern_bonus(x, y) * 0.3, F.lit(1.0)))


def position_score(a: Column, b: Column, slope: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(a - b) * slope)


@dataclass(frozen=True)
class TableWeights:
    column: float = 0.35
    type: float = 0.25
    constraint: float = 0.15
    index: float = 0.10
    name: float = 0.15
    pk_bonus: float = 1.5
    fk_bonus: float = 1.3

    @staticmethod
    def structural_only() -> TableWeights:
        return TableWeights(0.45, 0.30, 0.15, 0.10, 0.0)

    @staticmethod
    def name_focused() -> TableWeights:
        return TableWeights(0.25, 0.20, 0.10, 0.05, 0.40)

    def normalised(self) -> tuple[float, float, float, float, float]:
        parts = (self.column, self.type, self.constraint, self.index, self.name)
        total = self.column + self.type + self.constraint + self.index + self.name
        return tuple(x / total for x in parts) if total else (0.2,) * 5


@dataclass(frozen=True)
class ColumnWeights:
    type: float = 0.50
    position: float = 0.15
    nullability: float = 0.10
    default: float = 0.10
    name: float = 0.15
    mismatch_cap: float = 0.35


def column_basic(s: str, t: str) -> Column:
    a, b = (lambda x: F.col(f"{s}.{x}")), (lambda x: F.col(f"{t}.{x}"))
    same = F.lit(0.6) + hit(a("is_nullable") == b("is_nullable"), 0.15) + hit(a("default_expr").eqNullSafe(b("default_expr")), 0.1) + F.lit(0.15) * position_score(a("position"), b("position"), 0.2)
    return F.when(a("type").eqNullSafe(b("type")), same).otherwise(F.lit(0.35) * position_score(a("position"), b("position"), 0.5))


def column_advanced(s: str, t: str, w: ColumnWeights = ColumnWeights()) -> Column:  # noqa: B008
    a, b = (lambda x: F.col(f"{s}.{x}")), (lambda x: F.col(f"{t}.{x}"))
    names = name_similarity(a("name"), b("name"))
    same = F.lit(w.type) + hit(a("is_nullable") == b("is_nullable"), w.nullability) + hit(a("default_expr").eqNullSafe(b("default_expr")), w.default)
    same = same + F.lit(w.position) * position_score(a("position"), b("position"), 0.2) + F.lit(w.name) * names
    total = w.type + w.position + w.nullability + w.default + w.name
    return F.when(a("type").eqNullSafe(b("type")), same / total).otherwise(F.lit(w.mismatch_cap) * (position_score(a("position"), b("position"), 0.5) * 0.3 + names * 0.7))


def constraint(s: str, t: str) -> Column:
    a, b = (lambda x: F.col(f"{s}.{x}")), (lambda x: F.col(f"{t}.{x}"))
    ref = (a("ref_table") == b("ref_table")) & a("ref_schema").eqNullSafe(b("ref_schema"))
    return (
        F.when(a("kind") != b("kind"), 0.0)
        .when(a("kind").isin("PRIMARY KEY", "UNIQUE"), jaccard(a("columns"), b("columns")))
        .when(a("kind") == "FOREIGN KEY", jaccard(a("columns"), b("columns")) * 0.5 + hit(ref, 0.5))
        .when(a("kind") == "CHECK", F.when(a("expression") == b("expression"), 1.0).otherwise(0.3))
        .otherwise(F.when(a("elements").eqNullSafe(b("elements")), 1.0).otherwise(0.3))
    )


def plain_columns(index_columns: Column) -> Column:
    return F.filter(F.transform(index_columns, lambda c: c["column"]), lambda c: c.isNotNull())


def index(a: Column, b: Column) -> Column:
    """Of two index structs (method, is_unique, columns, predicate)."""
    ca, cb = plain_columns(a["columns"]), plain_columns(b["columns"])
    return hit(a["method"] == b["method"], 0.2) + hit(a["is_unique"] == b["is_unique"], 0.15) + F.lit(0.5) * jaccard(ca, cb) + hit(a["predicate"].eqNullSafe(b["predicate"]), 0.15)


def view(s: str, t: str) -> Column:
    a, b = (lambda x: F.col(f"{s}.{x}")), (lambda x: F.col(f"{t}.{x}"))
    la, lb = F.octet_length(a("definition")), F.octet_length(b("definition"))
    return hit(a("is_materialized") == b("is_materialized"), 0.3) + F.when(a("definition") == b("definition"), 0.7).otherwise(F.lit(0.3) * (F.least(la, lb) / F.greatest(la, lb)))


def sequence(s: str, t: str) -> Column:
    a, b = (lambda x: F.col(f"{s}.{x}")), (lambda x: F.col(f"{t}.{x}"))
    return hit(a("data_type") == b("data_type"), 0.5) + hit(a("increment") == b("increment"), 0.25) + hit((a("min_value") == b("min_value")) & (a("max_value") == b("max_value")), 0.25)


def enum(s: str, t: str) -> Column:
    return jaccard(F.col(f"{s}.labels"), F.col(f"{t}.labels"))


def _gather(arr: Column, kind: str) -> Column:
    return F.filter(arr, lambda c: c["kind"] == kind)


def table_basic(a: Column, b: Column) -> Column:
    """Of two table structs (kind, columns: array of struct name, type)."""
    na, nb = F.transform(a["columns"], lambda c: c["name"]), F.transform(b["columns"], lambda c: c["name"])
    both = F.size(F.array_intersect(na, nb))
    types = F.size(F.filter(a["columns"], lambda c: F.exists(b["columns"], lambda d: (d["name"] == c["name"]) & d["type"].eqNullSafe(c["type"]))))
    score = (both / F.size(F.array_union(na, nb))) * 0.7 + F.when(both > 0, types / both).otherwise(0.0) * 0.3
    return F.when((F.size(na) == 0) & (F.size(nb) == 0), hit(a["kind"] == b["kind"], 0.5)).when((F.size(na) == 0) | (F.size(nb) == 0), 0.0).otherwise(score)


def _best(own: Column, other: Column, score) -> Column:
    """Mean over the source's items of the best match among the target's; two empty lists are alike."""
    best = F.transform(own, lambda x: F.coalesce(F.array_max(F.transform(other, lambda y: score(x, y))), F.lit(0.0)))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(own)
    return F.when((F.size(own) == 0) & (F.size(other) == 0), 1.0).when((F.size(own) == 0) | (F.size(other) == 0), 0.0).otherwise(mean)


def table_advanced(a: Column, b: Column, w: TableWeights = TableWeights()) -> Column:  # noqa: B008
    """Of two table structs (name, columns, constraints, indexes), by five weighted parts."""
    na, nb = F.transform(a["columns"], lambda c: c["name"]), F.transform(b["columns"], lambda c: c["name"])

    def keyed(t: Column, kind: str) -> Column:
        return F.flatten(F.transform(_gather(t["constraints"], kind), lambda c: c["columns"]))

    def weight(t: Column):
        pk, fk = keyed(t, "PRIMARY KEY"), keyed(t, "FOREIGN KEY")
        return lambda n: F.when(F.array_contains(pk, n), F.lit(w.pk_bonus)).otherwise(1.0) * F.when(F.array_contains(fk, n), F.lit(w.fk_bonus)).otherwise(1.0)

    wa, wb = weight(a), weight(b)
    total = lambda names, f: F.aggregate(names, F.lit(0.0), lambda s, n: s + f(n))
    inner = total(F.filter(na, lambda n: F.array_contains(nb, n)), wa)
    columns = inner / (total(na, wa) + total(nb, wb) - inner)
    shared = F.size(F.array_intersect(na, nb))
    types = F.size(F.filter(b["columns"], lambda c: F.exists(a["columns"], lambda d: (d["name"] == c["name"]) & d["type"].eqNullSafe(c["type"]))))
    type_part = F.when(shared > 0, types / shared).otherwise(0.0)
    pa, pb = _gather(a["constraints"], "PRIMARY KEY"), _gather(b["constraints"], "PRIMARY KEY")
    pk = F.when((F.size(pa) > 0) & (F.size(pb) > 0), F.lit(0.5) * jaccard(pa[0]["columns"], pb[0]["columns"])).when((F.size(pa) == 0) & (F.size(pb) == 0), 0.5).otherwise(0.0)
    ua, ub = _gather(a["constraints"], "UNIQUE"), _gather(b["constraints"], "UNIQUE")
    fa, fb = _gather(a["constraints"], "FOREIGN KEY"), _gather(b["constraints"], "FOREIGN KEY")
    has_u, has_f = (F.size(ua) > 0) | (F.size(ub) > 0), (F.size(fa) > 0) | (F.size(fb) > 0)
    u = F.when(has_u, F.lit(0.3) * _best(ua, ub, lambda x, y: jaccard(x["columns"], y["columns"]))).otherwise(0.0)
    f = F.when(has_f, F.lit(0.2) * _best(fa, fb, lambda x, y: jaccard(x["columns"], y["columns"]) * 0.5 + hit(x["ref_table"] == y["ref_table"], 1.0) * 0.5)).otherwise(0.0)
    weights = F.lit(0.5) + F.when(has_u, 0.3).otherwise(0.0) + F.when(has_f, 0.2).otherwise(0.0)
    ca, cb = F.size(a["constraints"]), F.size(b["constraints"])
    constraints = F.when((ca == 0) & (cb == 0), 1.0).when((ca == 0) | (cb == 0), 0.0).otherwise((pk + u + f) / weights)
    own = lambda t: F.filter(t["indexes"], lambda i: ~i["is_constraint_index"])
    indexes = _best(own(a), own(b), index)
    names = name_similarity(a["name"], b["name"])
    c, ty, co, ix, nm = w.normalised()
    score = columns * c + type_part * ty + constraints * co + indexes * ix + names * nm
    return F.when((F.size(na) == 0) & (F.size(nb) == 0), names).when((F.size(na) == 0) | (F.size(nb) == 0), names * 0.1).otherwise(score)
