"""Small pairs of schemas about a lending library, for tests."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

from schemaloom.builder import SchemaBuilder
from schemaloom.model import Catalog
from schemaloom.operators.diff import Diff, DiffConfig, pairs_frame


def _readers(s):
    return s.table("readers").column("no", "integer", null=False).column("full_name", "text")


def _library(s):
    s.enum("state", "in", "out")
    _readers(s).column("mail", "varchar(80)", null=False).primary_key("no").unique("mail")
    books = s.table("books").column("isbn", "text", null=False).column("held_by", "integer").column("state", "state", default="'in'").primary_key("isbn")
    return books.foreign_key("held_by", "readers", "no", on_delete="SET NULL").index("held_by")


def _clubs(s):
    s.table("members").column("id", "integer", null=False).column("age", "smallint").primary_key("id")
    s.table("clubs").column("id", "integer", null=False, identity="BY DEFAULT").column("title", "varchar(40)").primary_key("id")
    both = s.table("joinings").column("member_id", "integer", null=False).column("club_id", "integer", null=False).column("class", "varchar(9)").primary_key("member_id", "club_id")
    both.foreign_key("member_id", "members", "id").foreign_key("club_id", "clubs", "id")
    cards = s.table("cards").column("id", "integer", null=False).column("owner", "integer", null=False).primary_key("id").unique("owner")
    return cards.foreign_key("owner", "members", "id")


def _staff(s):
    return s.table("staff").column("id", "integer", null=False).column("boss", "integer").primary_key("id").foreign_key("boss", "staff", "id")


def _rooms(s):
    return s.table("rooms").column("during", "tsrange").column("hour", "integer").exclude(("during", "&&"), name="rooms_free").check("hour < 24", name="hour_ok")


def _chain(s):
    s.table("a_page").column("id", "integer", null=False).column("of", "integer").primary_key("id").foreign_key("of", "b_book", "id")
    s.table("b_book").column("id", "integer", null=False).column("of", "integer").primary_key("id").foreign_key("of", "c_shelf", "id")
    return s.table("c_shelf").column("id", "integer", null=False).primary_key("id")


def _nothing(s):
    return s


#: What each pair is from and to.
CASES = {
    "same": (_readers, _readers),
    "library": (_nothing, _library),
    "closing": (_library, _nothing),
    "clubs": (_nothing, _clubs),
    "staff": (_nothing, _staff),
    "rooms": (_nothing, _rooms),
    "chain": (_nothing, _chain),
    "more_columns": (_readers, lambda s: _readers(s).column("phone", "text").column("level", "text", null=False, default="'new'")),
    "fewer_columns": (lambda s: _readers(s).column("phone", "text"), _readers),
    "mail_renamed": (lambda s: _readers(s).column("mail", "text"), lambda s: _readers(s).column("mail_address", "text")),
    "lenders": (lambda s: s.table("lenders").column("no", "integer", null=False).column("city", "text").index("city", name="town"), lambda s: s.table("borrowers").column("no", "integer", null=False).column("city", "text").index("city", name="town")),
    "other_types": (lambda s: s.table("t").column("a", "integer").column("b", "varchar(5)"), lambda s: s.table("t").column("a", "bigint", null=False).column("b", "varchar(3)")),
    "defaults": (lambda s: s.table("t").column("a", "text").column("b", "text", default="'y'").column("c", "text", default="'y'"), lambda s: s.table("t").column("a", "text", default="'n'").column("b", "text", default="'z'").column("c", "text")),
    "enums": (lambda s: s.enum("mood", "good").enum("unused", "x"), lambda s: s.enum("mood", "good", "it's bad").enum("grade", "one", "two", "three")),
    "counters": (lambda s: s.sequence("visits"), lambda s: s.sequence("visits", increment=5, cyclic=True)),
    "notes": (_readers, lambda s: s.table("readers", comment="people").column("no", "integer", null=False).column("full_name", "text", comment="as written")),
    "views": (lambda s: s.view("busy", "SELECT 1"), lambda s: s.view("busy", "SELECT 1", materialized=True).view("calm", "SELECT 2")),
    "indexed": (_readers, lambda s: _readers(s).index(("full_name", None, "desc", "last"), name="by_name", unique=True, predicate="no > 0")),
}


@lru_cache(maxsize=1)
def pairs() -> list[tuple[str, SchemaBuilder, SchemaBuilder]]:
    out = []
    for name, (source, target) in CASES.items():
        a, b = SchemaBuilder(f"{name}/old"), SchemaBuilder(f"{name}/new")
        source(a)
        target(b)
        out.append((name, a, b))
    return out


def catalog(spark) -> Catalog:
    rows = defaultdict(list)
    for _, a, b in pairs():
        for s in (a, b):
            for k, v in s.rows.items():
                rows[k] += v
    return Catalog.of(spark, rows)


def diff(spark, config: DiffConfig = DiffConfig()) -> Diff:  # noqa: B008
    return Diff(catalog(spark), pairs_frame(spark, [(p, a.id, b.id) for p, a, b in pairs()]), config)
