"""Breaking changes of schema pairs, their mitigation and description."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import Diff

if TYPE_CHECKING:
    import pandas as pd

#: The mitigation that each kind of change needs.
MITIGATION = {
    "TableDropped": "Destructive", "ColumnDropped": "Destructive", "ViewDropped": "Destructive", "SequenceDropped": "Destructive", "EnumValueRemoved": "Destructive", "EnumValuesReordered": "Destructive",
    "TableRenamed": "DualWrite", "ColumnRenamed": "DualWrite", "ColumnTypeChanged": "DualWrite", "ViewRenamed": "DualWrite", "SequenceRenamed": "DualWrite", "MaterializationChanged": "DualWrite",
    "ColumnMadeNonNullable": "Backfill",
    "PrimaryKeyAdded": "Ratchet", "UniqueConstraintAdded": "Ratchet", "CheckConstraintAdded": "Ratchet", "ForeignKeyAdded": "Ratchet", "ExclusionConstraintAdded": "Ratchet",
}
#: Type changes that lose nothing.
WIDENING = [(a, b) for a, more in ((("int2", "smallint"), ("int4", "integer", "int8", "bigint")), (("int4", "integer"), ("int8", "bigint")), (("float4", "real"), ("float8", "double precision"))) for a in a for b in more] + [("varchar", "text")]


def type_length(formatted: Column) -> Column:
    """The number in parentheses of a formatted type, or null."""
    return F.nullif(F.regexp_extract(formatted, r"\(\s*(\d+)\s*\)", 1), F.lit("")).cast("int")


def is_safe_widening(a: Column, b: Column) -> Column:
    """Whether changing type a to b (structs) keeps every value."""
    listed = F.lit(False)
    for x, y in WIDENING:
        listed = listed | ((a["name"] == x) & (b["name"] == y))
    la, lb = type_length(a["formatted"]), type_length(b["formatted"])
    chars = (a["name"] == "varchar") & (b["name"] == "varchar") & la.isNotNull() & (lb.isNull() | (lb >= la))
    return (a["formatted"] == b["formatted"]) | listed | chars


def percent(similarity: Column) -> Column:
    return F.format_string("%d%%", F.bround(similarity * 100, 0).cast("int"))


_RENAMED = "%s '%s' was renamed to '%s' (similarity: %s)"


def analyse(diff: Diff) -> DataFrame:
    """pair_id, change, mitigation, table_name, object_name, description."""
    parts: list[DataFrame] = []
    null = F.lit(None).cast("string")

    def add(df: DataFrame, change: str, table: Column, name: Column, text: Column) -> None:
        parts.append(df.select("pair_id", F.lit(change).alias("change"), F.lit(MITIGATION[change]).alias("mitigation"), table.alias("table_name"), name.alias("object_name"), text.alias("description")))

    name, table, to = F.col("name"), F.col("table_name"), F.col("to_name")
    column = F.concat_ws(".", table, name)
    for kind, word in (("table", "Table"), ("column", "Column"), ("view", "View"), ("sequence", "Sequence")):
        objects = diff.objects(kind)
        owner, label = (table, column) if kind == "column" else (name if kind == "table" else null, name)
        add(objects.filter("change = 'removed'"), f"{word}Dropped", owner, name, F.format_string(f"{word} '%s' was dropped", label))
        add(objects.filter("change = 'renamed'"), f"{word}Renamed", owner, name, F.format_string(_RENAMED, F.lit(word), label, to, percent(F.col("similarity"))))
    cols = diff.matched("column").filter("s IS NOT NULL AND t IS NOT NULL")
    changed = cols.filter(~F.col("s.type").eqNullSafe(F.col("t.type")) & ~is_safe_widening(F.col("s.type"), F.col("t.type")))
    add(changed, "ColumnTypeChanged", table, name, F.format_string("Column '%s' type changed from '%s' to '%s'", column, F.col("s.type.formatted"), F.col("t.type.formatted")))
    add(cols.filter("s.is_nullable AND NOT t.is_nullable"), "ColumnMadeNonNullable", table, name, F.format_string("Column '%s' changed from nullable to NOT NULL", column))
    got = diff.changes().filter("kind = 'constraint' AND change = 'added'").select("pair_id", "table_name", "name", F.col("t.constraint").alias("x"))
    x = F.col("x")
    keys = F.array_join(x["columns"], ", ")
    for kind, change, text in (
        ("PRIMARY KEY", "PrimaryKeyAdded", F.format_string("Primary key '%s' added to table '%s' on columns (%s)", name, table, keys)),
        ("UNIQUE", "UniqueConstraintAdded", F.format_string("Unique constraint '%s' added to table '%s' on columns (%s)", name, table, keys)),
        ("CHECK", "CheckConstraintAdded", F.format_string("Check constraint '%s' added to table '%s': %s", name, table, x["expression"])),
        ("FOREIGN KEY", "ForeignKeyAdded", F.format_string("Foreign key '%s' added to table '%s' (%s) referencing '%s'", name, table, keys, F.concat_ws(".", x["ref_schema"], x["ref_table"]))),
        ("EXCLUDE", "ExclusionConstraintAdded", F.format_string("Exclusion constraint '%s' added to table '%s'", name, table)),
    ):
        add(got.filter(x["kind"] == kind), change, table, name, text)
    views = diff.matched("view").filter("s IS NOT NULL AND t IS NOT NULL AND s.is_materialized <> t.is_materialized")
    forms = F.when(F.col("t.is_materialized"), "from regular to materialized").otherwise("from materialized to regular")
    add(views, "MaterializationChanged", null, name, F.format_string("View '%s' changed %s", name, forms))
    enums = diff.enum_changes()
    add(enums.filter(F.size("values_removed") > 0), "EnumValueRemoved", null, name, F.format_string("Values removed from enum '%s': %s", name, F.array_join("values_removed", ", ")))
    add(enums.filter("reordered"), "EnumValuesReordered", null, name, F.format_string("Enum '%s' values were reordered", name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_mitigation(breaking: DataFrame) -> DataFrame:
    return breaking.groupBy("pair_id", "mitigation").agg(F.count(F.lit(1)).alias("n"))


def is_safe(pairs: DataFrame, breaking: DataFrame) -> DataFrame:
    """pair_id, n_breaking, is_safe of every pair."""
    n = breaking.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("pair_id").join(n, "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("n_breaking"), F.col("n").isNull().alias("is_safe"))


def session_breaking(diff: Diff) -> DataFrame:
    """The short list of an authoring session: removed tables, columns and enums."""
    out = diff.objects("table").unionByName(diff.objects("column")).unionByName(diff.objects("enum"))
    return out.filter("change = 'removed'").select("pair_id", "kind", "table_name", "name")


BLOCK = 10_000  # identifiers, and statements, of one automaton and its texts


def _found(words: pd.DataFrame, statements: pd.DataFrame) -> pd.DataFrame:
    """pair_id, seq, word of every identifier that a statement holds: all of them at once, by one Aho-Corasick automaton."""
    import ahocorasick
    import pandas as pd

    rows: list[tuple] = []
    if len(words) and len(statements):
        automaton = ahocorasick.Automaton()
        for w in words["word"]:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for pair, seq, sql in zip(statements["pair_id"], statements["seq"], statements["text"], strict=True):
            rows += [(pair, seq, w) for w in {w for _, w in automaton.iter(sql)}]
    return pd.DataFrame(rows, columns=["pair_id", "seq", "word"])


def named_in(words: DataFrame, statements: DataFrame) -> DataFrame:
    """pair_id, seq, word: which of a pair's words (pair_id, word; distinct) each of its statements (pair_id, seq, text) holds.

    Words and statements of a pair meet in blocks of BLOCK each, so no pair gathers in one task.  Each statement is read once for a
    block of words, however many they are.
    """
    n = words.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("w"))
    m = statements.groupBy("pair_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("s"))
    of = n.join(m, "pair_id")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = words.join(of, "pair_id").withColumn("a", F.pmod(F.xxhash64("word"), F.col("w"))).withColumn("b", every("s"))
    b = statements.join(of, "pair_id").withColumn("b", F.pmod(F.xxhash64("seq"), F.col("s"))).withColumn("a", every("w"))
    key = [F.col("pair_id").alias("p"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")]
    kind = statements.schema["seq"].dataType.simpleString()
    left, right = a.select(*key, "word").groupBy("p", "a", "b"), b.select(*key, "pair_id", "seq", "text").groupBy("p", "a", "b")
    return left.cogroup(right).applyInPandas(_found, f"pair_id string, seq {kind}, word string")


def affected_statements(breaking: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements (pair_id, seq, sql) that name an identifier of a breaking change, case aside."""
    ids = F.array_compact(F.array(F.lower("table_name"), F.lower("object_name")))
    marked = breaking.select("pair_id", "change", "object_name", F.explode(ids).alias("word")).distinct()
    hits = named_in(marked.select("pair_id", "word").distinct(), statements.select("pair_id", "seq", F.lower("sql").alias("text")))
    rows = hits.join(marked, ["pair_id", "word"]).select("pair_id", "change", "object_name", "seq").distinct()
    return rows.join(statements.select("pair_id", "seq", "sql"), ["pair_id", "seq"]).select("pair_id", "change", "object_name", "seq", "sql")
