"""Snapshots of the data itself: tables cut by a column, each cut read as a schema.

A *cut* says, for every row of a table, which snapshots it belongs to and which
table of theirs it is a row of: events by day and type, documents by language
and source, turns of conversations by number and role, whole tables as they
are.  What such a slice holds decides its schema, by rules that need only
counts and ranges:

* a table of more than an even share of its snapshot's rows is partitioned; the largest is commented;
* a column that fewer than one row in ten holds is left out; a type is the narrowest that holds the values; NOT NULL if no
  null is there; a column of numbers under 1 defaults to 0, a label to the most frequent one; texts all in ASCII collate as C;
  a constant is commented; a dense unique integer is an identity;
* the first unique column is the primary key, others are unique, unique slots exclude each other, numbers and repeated
  integers get checks of their range; columns of repeated values that all stand in another table's unique column refer to it
  (the one of fewest values; whole tables only);
* unique columns are indexed by their constraint, selective ones by a plain index;
* labels are an enum of those that one row in twelve holds, most frequent first; a marked column is a sequence of its range, and its most frequent
  value a view.

Work: one scan of a cut gives counts and ranges of all its columns, one row for a
slice and task.  Only integers, texts and labels are counted by value, since only
their distinct values matter; numbers, times and arrays are never shuffled.  Each
column of a whole table is grouped by its value alone; in cuts, a value travels
with its slice and the number of its column, once a task; integers as they are,
texts as digests.  A column that repeats nothing in the whole table does so in no
slice: there it isn't counted by value again.  Both snapshots of a whole table
come from one count, which tells the even rows apart.  Modes and distinct values
follow from a count of the counts.  References between whole tables: the
columns that hold a value are bits of a mask, gathered once per value; equal masks
are counted together, and inclusion of one column in another is a comparison of
counts.

Nulls: a null snapshot or table name is 'none'.  Empty tables give no slices.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SCHEMAS, Catalog
from ..tables import kept


@dataclass(frozen=True)
class Cut:
    """snapshot: an expression, None for whole tables; name: an expression of a table's name; columns: (name, kind, expression);
    marked: an integer column; half: which rows of a whole table are also in the snapshot of even rows; given: (name, expression)
    of what several columns use, computed once a row.

    Kinds: int, slot (an integer that should not repeat), num, label, text, time, raw (counted only).
    """

    feed: str
    table: str
    snapshot: str | None
    name: str
    columns: tuple[tuple[str, str, str], ...]
    marked: str | None = None
    half: str = "false"
    given: tuple[tuple[str, str], ...] = ()


def whole(table: str, *columns: tuple[str, str]) -> Cut:
    """A table as it is, and the rows whose first column is even as another snapshot."""
    first, kind = columns[0]
    even = f"{first} % 2 = 0" if kind == "int" else "true"
    return Cut("tables", table, None, f"'{table}'", tuple((c, k, c) for c, k in columns), None, even)


_DIGITS = "try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint)"

CUTS = (
    Cut(
        "events",
        "events",
        "concat('events/', cast(cast(ts AS date) AS string))",
        "event_type",
        (("event_id", "int", "event_id"), ("user_id", "int", "user_id"), ("value", "num", "value"), ("hour", "slot", "hour(ts)"), ("decade", "label", "concat('k', digits div 10)"))
        + tuple((f"k{d}", "int", f"CASE WHEN digits div 10 = {d} THEN digits END") for d in range(10)),
        "user_id",
        given=(("digits", _DIGITS),),
    ),
    Cut(
        "documents",
        "documents",
        "concat('documents/', lang)",
        "source",
        (("doc_id", "int", "doc_id"), ("text", "text", "text"), ("n_chars", "int", "n_chars"), ("size", "label", "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END")),
        "n_chars",
    ),
    Cut(
        "conversations",
        "conversations",
        "concat('conversations/', turn)",
        "role",
        (("conv_id", "int", "conv_id"), ("text", "text", "text"), ("n_chars", "int", "length(text)"), ("size", "label", "CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 200 THEN 'medium' ELSE 'long' END")),
        "n_chars",
    ),
    Cut(
        "orders",
        "orders",
        "concat('orders/', year(o_orderdate))",
        "concat('status_', lower(o_orderstatus))",
        (("o_orderkey", "int", "o_orderkey"), ("o_custkey", "int", "o_custkey"), ("o_totalprice", "num", "o_totalprice"), ("o_orderpriority", "label", "o_orderpriority"), ("month", "int", "month(o_orderdate)")),
        "o_custkey",
    ),
    whole("region", ("r_regionkey", "int"), ("r_name", "text")),
    whole("nation", ("n_nationkey", "int"), ("n_name", "text"), ("n_regionkey", "int")),
    whole("customer", ("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "num"), ("c_mktsegment", "label")),
    whole("supplier", ("s_suppkey", "int"), ("s_name", "text"), ("s_nationkey", "int"), ("s_acctbal", "num")),
    whole("part", ("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "label"), ("p_size", "int"), ("p_retailprice", "num")),
    whole("orders", ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "label"), ("o_totalprice", "num"), ("o_orderdate", "time"), ("o_orderpriority", "label")),
    whole(
        "lineitem",
        ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"),
        ("l_tax", "num"), ("l_returnflag", "label"), ("l_linestatus", "label"), ("l_shipdate", "time"),
    ),
    whole("events", ("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "label"), ("value", "num"), ("props", "text")),
    whole("documents", ("doc_id", "int"), ("text", "text"), ("lang", "label"), ("source", "text"), ("n_chars", "int")),
    whole("embeddings", ("vec_id", "int"), ("embedding", "raw"), ("label", "int")),
    whole("pages", ("page_id", "int"), ("url", "text"), ("html", "text")),
    whole("benchmark", ("item_id", "int"), ("text", "text")),
    whole("labels", ("doc_id", "int"), ("quality", "int"), ("toxic", "int")),
    whole("conversations", ("conv_id", "int"), ("turn", "int"), ("role", "label"), ("text", "text")),
)

#: What tells texts and labels apart by value; all other columns that are counted are integers.
_EXACT = {"text": "md5(cast({} AS binary))", "label": "cast({} AS string)"}

SLICE = ["feed", "snapshot_id", "table_name"]
COLUMN = [*SLICE, "name", "position", "kind", "marked"]


def _at(cut: Cut, told: bool) -> list[str]:
    """Snapshot, table and half of a row; of whole tables only where told, as the column tells them as well."""
    if cut.snapshot is None and not told:
        return ["cast(NULL AS string) AS s", "cast(NULL AS string) AS t", f"coalesce({cut.half}, false) AS half"]
    return [f"coalesce({cut.snapshot or f"'{cut.feed}'"}, '{cut.feed}/none') AS s", f"coalesce({cut.name}, 'none') AS t", f"coalesce({cut.half}, false) AS half"]


def _halves(df: DataFrame) -> DataFrame:
    """Rows of both halves as the whole, and those of the even one."""
    return df.withColumn("half", F.explode(F.when(F.col("half"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


def _ranges(df: DataFrame, cut: Cut, numbers: list[int]) -> DataFrame:
    """A row for every column of every slice: what needs no distinct values."""
    aggs, cells = [], []
    for k, (_, kind, _e) in zip(numbers, cut.columns, strict=True):
        c = f"c{k}"
        found = {"held": f"count({c})", "low": "cast(NULL AS bigint)", "high": "cast(NULL AS bigint)", "least": "cast(NULL AS double)", "most": "cast(NULL AS double)", "plus": "cast(NULL AS boolean)", "minus": "cast(NULL AS boolean)", "size": "cast(NULL AS int)", "ascii": "cast(NULL AS boolean)"}
        if kind in ("int", "slot"):
            found |= {"low": f"cast(min({c}) AS bigint)", "high": f"cast(max({c}) AS bigint)"}
        elif kind == "num":
            signed = f"CASE WHEN {c} = 0 THEN startswith(cast({c} AS string), '-') END"  # 0.0 and -0.0 are two values
            found |= {"least": f"cast(min({c}) AS double)", "most": f"cast(max({c}) AS double)", "plus": f"min({signed})", "minus": f"max({signed})"}
        elif kind == "text":
            found |= {"size": f"max(char_length({c}))", "ascii": f"min(octet_length({c}) = char_length({c}))"}
        aggs += [F.expr(e).alias(f"{x}{k}") for x, e in found.items()]
        cells.append(f"struct({k} AS k, {', '.join(f'{x}{k} AS {x}' for x in found)})")
    rows = df.selectExpr(*_at(cut, True), *(f"{e} AS c{k}" for k, (_, _, e) in zip(numbers, cut.columns, strict=True)))
    return rows.groupBy("s", "t", "half").agg(F.count(F.lit(1)).alias("n_rows"), *aggs).selectExpr("s", "t", "half", "n_rows", f"inline(array({', '.join(cells)}))")


class Profile:
    """Counts by column and, where they matter, by value of all cuts, and the catalog that follows from them."""

    def __init__(self, spark: SparkSession, folder: str, cuts: tuple[Cut, ...] = CUTS) -> None:
        self.spark, self.folder, self.cuts = spark, folder, cuts
        listed = [(cut, p + 1, *c) for cut in cuts for p, c in enumerate(cut.columns)]
        self._columns = [(cut, k, kind, expr) for k, (cut, _, _, kind, expr) in enumerate(listed)]
        told = [(k, cut.feed, cut.feed if cut.snapshot is None else None, cut.table if cut.snapshot is None else None, name, p, kind, name == cut.marked) for k, (cut, p, name, kind, _) in enumerate(listed)]
        self._named = kept(spark.createDataFrame(told, "k int, feed string, all string, of string, name string, position int, kind string, marked boolean").coalesce(1))
        self._proven: set[int] = set()
        #: k, s, t, v, n, n_half: how often a column holds a value; of labels, and of what other columns may refer to.
        self.labels = kept(self._counts(("label",)))
        self.whole = {kind: kept(self._counts(kinds, whole=True)) for kind, kinds in (("int", ("int", "slot")), ("text", ("text",)))}
        self._proven = self._proved()
        self.stats = kept(self._stats())
        self.columns_held = self.stats.filter("10 * held >= n_rows")
        self._sets: DataFrame | None = None

    def _read(self, cut: Cut) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{cut.table}.parquet").withColumns({c: F.expr(e) for c, e in cut.given})

    def _counts(self, kinds: tuple[str, ...], whole: bool | None = None) -> DataFrame:
        """k, s, t, v, n, n_half: how many rows (and even rows) of a slice hold a value; s and t are null, or left out, in whole tables.

        Columns of whole tables are grouped one by one, by the value alone; those of a cut share what places a row in a slice.
        """
        counted = F.count(F.lit(1)).alias("n"), F.count_if("half").alias("n_half")
        out = None
        for cut in self.cuts:
            if whole not in (None, cut.snapshot is None):
                continue
            cells = [(k, _EXACT.get(kind, "cast({} AS bigint)").format(expr)) for c, k, kind, expr in self._columns if c is cut and kind in kinds and (cut.snapshot is None or k not in self._proven)]
            if cut.snapshot is None:
                several = [self._read(cut).selectExpr(*_at(cut, False), f"{v} AS v").filter("v IS NOT NULL").groupBy("v").agg(*counted).withColumn("k", F.lit(k)) for k, v in cells]
                several = [one.withColumns({x: F.lit(None).cast("string") for x in ("s", "t")}) for one in several]
            else:
                fours = [cells[at : at + 4] for at in range(0, len(cells), 4)]  # more in one loop, and the JVM no longer compiles it
                several = [self._read(cut).selectExpr(*_at(cut, False), f"inline(array({', '.join(f'struct({k} AS k, {v} AS v)' for k, v in four)}))").filter("v IS NOT NULL").groupBy("k", "s", "t", "v").agg(*counted) for four in fours]
            for one in several:
                out = one if out is None else out.unionByName(one)
        if out is None:
            out = self.spark.createDataFrame([], f"k int, s string, t string, v {'string' if kinds[0] in _EXACT else 'long'}, n long, n_half long")
        return out.select("k", *(() if whole else ("s", "t")), "v", "n", "n_half")

    def _proved(self) -> set[int]:
        """Columns of cuts that repeat no value in their whole table, so in no slice of it either."""
        repeated = {r["k"] for counts in self.whole.values() for r in counts.filter("n > 1").select("k").distinct().collect()}  # columns, not values
        unique = {(c.table, kind in _EXACT, expr) for c, k, kind, expr in self._columns if c.snapshot is None and kind in ("int", "slot", "text") and k not in repeated}
        return {k for c, k, kind, expr in self._columns if c.snapshot is not None and kind in ("int", "slot", "text") and (c.table, kind in _EXACT, expr) in unique}

    def _at_names(self, df: DataFrame) -> DataFrame:
        """Slices by name instead of s, t and half, columns by name instead of k."""
        snapshot = F.concat(F.coalesce("s", "all"), F.when(F.col("half"), "/even").otherwise(""))
        rest = [c for c in df.columns if c not in ("k", "s", "t", "half")]
        return df.join(F.broadcast(self._named), "k").select("feed", snapshot.alias("snapshot_id"), F.coalesce("t", "of").alias("table_name"), "name", "position", "kind", "marked", *rest)

    @staticmethod
    def _both(counts: DataFrame) -> DataFrame:
        """Counts of the whole and of the even rows below one another: half, n."""
        rest = [c for c in counts.columns if c not in ("n", "n_half")]
        even = counts.filter("n_half > 0").select(*rest, F.lit(True).alias("half"), F.col("n_half").alias("n"))
        return counts.select(*rest, F.lit(False).alias("half"), "n").unionByName(even)

    def _distinct(self) -> DataFrame:
        """k, s, t, half, d, mode, mode_n of all columns that are counted by value, by way of a count of the counts."""
        at, null, out = ["k", "s", "t", "half"], F.lit(None).cast("long"), None
        whole = [c.select("k", *(F.lit(None).cast("string").alias(x) for x in ("s", "t")), "v", "n", "n_half") for c in self.whole.values()]
        cut = [self._counts(kinds, whole=False).withColumn("half", F.lit(False)) for kinds in (("int", "slot"), ("text",))]
        for c in [*(self._both(x) for x in (self.labels, *whole)), *cut]:
            i = F.min("v") if dict(c.dtypes)["v"] == "bigint" else F.max(null)
            one = c.groupBy(*at, "n").agg(F.count(F.lit(1)).alias("d"), i.alias("i"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy(*at).agg(F.sum("d").alias("d"), F.min_by("i", -F.col("n")).cast("string").alias("mode"), F.max("n").alias("mode_n"))

    def _stats(self) -> DataFrame:
        """A row for every column of every slice; d, mode and mode_n are those of integers, texts and labels (modes of integers alone)."""
        rows = None
        for cut in self.cuts:
            one = _ranges(self._read(cut), cut, [k for c, k, _, _ in self._columns if c is cut])
            rows = one if rows is None else rows.unionByName(one)
        at = ["k", "s", "t", "half"]
        of = {"n_rows": F.sum, "held": F.sum, "low": F.min, "high": F.max, "least": F.min, "most": F.max, "plus": F.min, "minus": F.max, "size": F.max, "ascii": F.min}
        ranges = _halves(rows).groupBy(*at).agg(*(f(c).alias(c) for c, f in of.items()))
        proven = F.col("k").isin(*self._proven) if self._proven else F.lit(False)
        ranges = ranges.withColumn("alone", proven & (F.col("held") > 0))  # every value once, the least one first
        counted = self._at_names(self._distinct()).select(*COLUMN, "d", "mode", "mode_n")
        counts = F.col("kind").isin("int", "slot", "text", "label")
        alone = F.when(counts, F.col("d") == 1).otherwise((F.col("least") == F.col("most")) & ((F.col("least") != 0) | (F.col("plus") == F.col("minus"))))
        out = self._at_names(ranges).join(counted, COLUMN, "left")
        once = {"d": F.col("held"), "mode": F.col("low").cast("string"), "mode_n": F.lit(1).cast("long")}
        out = out.withColumns({c: F.when(F.col("alone"), e).otherwise(F.col(c)) for c, e in once.items()}).drop("alone")
        out = out.withColumn("d", F.when(counts, F.coalesce("d", F.lit(0)))).withColumn("constant", F.coalesce(alone, F.lit(False)))
        return out.drop("plus", "minus").withColumn("unique", F.col("kind").isin("int", "slot", "text") & (F.col("d") == F.col("n_rows")))

    # ---- relations ----

    def _slices(self) -> DataFrame:
        one = self.stats.filter("position = 1").select(*SLICE, "n_rows")
        of = one.groupBy("snapshot_id").agg(F.sum("n_rows").alias("all"), F.count(F.lit(1)).alias("tables"), F.min_by("table_name", F.struct(-F.col("n_rows"), "table_name")).alias("largest"))
        return one.join(of, "snapshot_id")

    def _labels(self) -> DataFrame:
        at = ["snapshot_id", "table_name", "name"]
        kept_ = self._at_names(self._both(self.labels)).join(self.columns_held.select(*at, "held"), at).filter("12 * n >= held")
        rows = kept_.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("v").alias("v")))).alias("l"))  # 12 at most
        return rows.select(*at, F.concat_ws("_", "table_name", "name").alias("enum"), F.transform("l", lambda x: x["v"]).alias("labels"))

    def _masks(self) -> DataFrame:
        """snapshot_id, table_name, name, ref_table, ref_name, n: n values are held by both columns of two tables (summed over rows)."""
        out = None
        for kind, counts in self.whole.items():
            # a column's place among those of its kind: bit place % 63 of mask place div 63
            place = {k: p for p, k in enumerate(k for c, k, x, _ in self._columns if x == kind and c.snapshot is None)}
            words = range((len(place) + 62) // 63)
            if not place:
                continue
            at = self.spark.createDataFrame([(k, p // 63, 1 << p % 63) for k, p in place.items()], "k int, word int, bit long").coalesce(1)
            bit = lambda w, n: F.bit_or(F.when((F.col("word") == w) & (F.col(n) > 0), F.col("bit")).otherwise(0))
            masks = [f"{n}{w}" for n in ("all", "even") for w in words]
            met = counts.join(F.broadcast(at), "k").groupBy("v").agg(*(bit(w, n).alias(f"{m}{w}") for m, n in (("all", "n"), ("even", "n_half")) for w in words))
            sets = met.groupBy(*masks).agg(F.count(F.lit(1)).alias("n"))
            one = sets.select("n", F.explode(F.array(*(F.struct(F.lit(m == "even").alias("half"), F.array(*(f"{m}{w}" for w in words)).alias("mask")) for m in ("all", "even")))).alias("x")).select("n", "x.*").groupBy("half", "mask").agg(F.sum("n").alias("n"))
            held = F.expr("mask[word] & bit <> 0")
            null = F.lit(None).cast("string")
            a = one.join(F.broadcast(at), held).select("half", "mask", "n", "k", null.alias("s"), null.alias("t"))
            a = self._at_names(a).select("snapshot_id", "mask", "n", "table_name", "name")
            b = at.join(F.broadcast(self._named), "k").select("word", "bit", F.col("of").alias("ref_table"), F.col("name").alias("ref_name"))
            one = a.join(F.broadcast(b), held & (F.col("table_name") != F.col("ref_table"))).drop("mask", "word", "bit")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "snapshot_id string, n long, table_name string, name string, ref_table string, ref_name string")

    def inclusions(self) -> DataFrame:
        """snapshot_id, table_name, name, d, is_unique, ref_table, ref_name, ref_d: columns of whole tables whose d values all are in a unique column of another table."""
        if self._sets is None:
            self._sets = kept(self._masks())
        both = self._sets.groupBy("snapshot_id", "table_name", "name", "ref_table", "ref_name").agg(F.sum("n").alias("common"))
        held = self.columns_held.filter("feed = 'tables'")
        child = held.select("snapshot_id", "table_name", "name", "d", F.col("unique").alias("is_unique"))
        parent = held.filter("unique AND held = n_rows").select("snapshot_id", F.col("table_name").alias("ref_table"), F.col("name").alias("ref_name"), F.col("d").alias("ref_d"))
        return both.join(child, ["snapshot_id", "table_name", "name"]).filter("common = d").join(parent, ["snapshot_id", "ref_table", "ref_name"]).drop("common")

    def references(self) -> DataFrame:
        """snapshot_id, table_name, name, ref_table, ref_name: columns of repeated values, each with the smallest of those that hold all of them."""
        found = self.inclusions().filter("NOT is_unique")
        best = F.min(F.struct("ref_d", "ref_table", "ref_name")).alias("r")
        return found.groupBy("snapshot_id", "table_name", "name").agg(best).select("snapshot_id", "table_name", "name", "r.ref_table", "r.ref_name")

    def catalog(self) -> Catalog:
        s, slices, labels = self.columns_held, self._slices(), kept(self._labels())
        null = lambda t="string": F.lit(None).cast(t)
        integer = F.when((F.col("low") >= -32768) & (F.col("high") <= 32767), "smallint").when((F.col("low") >= -2147483648) & (F.col("high") <= 2147483647), "integer").otherwise("bigint")
        key = F.concat_ws("_", "table_name", "name")
        limit = F.expr("CASE WHEN size <= 10 THEN 10 WHEN size <= 100 THEN 100 WHEN size <= 1000 THEN 1000 END")
        digits = F.length(F.floor("most").cast("string")) + 2
        shown = (
            F.when(F.col("kind").isin("int", "slot"), integer).when(F.col("kind") == "num", F.concat(F.lit("numeric("), digits.cast("string"), F.lit(",2)"))).when(F.col("kind") == "label", key)
            .when(F.col("kind") == "time", "timestamp without time zone").when(F.col("kind") == "raw", "real[]").otherwise(F.coalesce(F.concat(F.lit("character varying("), limit.cast("string"), F.lit(")")), F.lit("text")))
        )
        short = (
            F.when(F.col("formatted") == "smallint", "int2").when(F.col("formatted") == "integer", "int4").when(F.col("formatted") == "bigint", "int8").when(F.col("kind") == "num", "numeric")
            .when(F.col("kind") == "label", key).when(F.col("kind") == "time", "timestamp").when(F.col("kind") == "raw", "_float4").when(F.col("formatted") == "text", "text").otherwise("varchar")
        )
        own = F.when(F.col("kind") == "label", "public").otherwise("pg_catalog")
        s = s.withColumn("formatted", shown)
        type_ = F.struct(short.alias("name"), own.alias("schema"), F.col("formatted"), (F.col("kind") == "raw").alias("is_array"))
        default = F.when((F.col("kind") == "num") & (F.col("least") < 1), "0").when(F.col("kind") == "label", F.concat(F.lit("'"), F.expr("labels[0]"), F.lit("'")))
        dense = F.col("unique") & (F.col("kind") == "int") & (F.col("held") == F.col("n_rows")) & (F.col("high") - F.col("low") + 1 == F.col("n_rows"))
        constant = F.col("constant") & F.col("kind").isin("int", "slot", "num", "label")
        columns = s.join(labels.drop("enum"), ["snapshot_id", "table_name", "name"], "left").select(
            "snapshot_id", "table_name", "name", F.col("position").cast("int").alias("position"), type_.alias("type"), (F.col("held") < F.col("n_rows")).alias("is_nullable"), default.alias("default_expr"),
            null("struct<expression:string,storage:string>").alias("generated"), F.when(dense, "ALWAYS").alias("identity"), F.when(F.col("ascii"), "C").otherwise("default").alias("collation"), F.when(constant, "constant").alias("comment"),
        )
        of = slices.groupBy("snapshot_id").agg(F.max("tables").alias("tables"))
        tables = slices.select("snapshot_id", "table_name", F.when(F.col("n_rows") * F.col("tables") > F.col("all"), "partitioned").otherwise("regular").alias("kind"), F.when(F.col("table_name") == F.col("largest"), "largest").alias("comment"))
        return self._told(
            namespaces=of.select("snapshot_id", F.lit("public").alias("schema"), F.when(F.col("tables") > 3, "wide").alias("comment")),
            tables=tables,
            columns=columns,
            constraints=self._constraints(s),
            indexes=self._indexes(s),
            views=self._marked(s).select("snapshot_id", F.concat_ws("_", "table_name", "name", "mode").alias("name"), F.concat(F.lit("SELECT * FROM "), "table_name", F.lit(" WHERE "), "name", F.lit(" = "), "mode").alias("definition"), (20 * F.col("mode_n") > F.col("n_rows")).alias("is_materialized"), null().alias("comment")),
            sequences=self._marked(s).select("snapshot_id", F.concat(key, F.lit("_seq")).alias("name"), F.col("formatted").alias("data_type"), F.col("low").alias("start_value"), F.lit(1).cast("long").alias("increment"), F.col("low").alias("min_value"), F.col("high").alias("max_value"), F.lit(1).cast("long").alias("cache_size"), F.lit(False).alias("is_cyclic"), null().alias("comment")),
            enums=labels.select("snapshot_id", F.col("enum").alias("name"), "labels", null().alias("comment")),
        )

    def _told(self, **relations: DataFrame) -> Catalog:
        """Relations in their schemas' types, written once, in as many files as their size needs."""
        out = {}
        for f in fields(Catalog):
            want = self.spark.createDataFrame([], SCHEMAS[f.name]).schema
            out[f.name] = kept(relations[f.name].select(*[F.col(x.name).cast(x.dataType) for x in want]).hint("rebalance"))
        return Catalog(**out)

    def _marked(self, s: DataFrame) -> DataFrame:
        return s.filter("marked AND mode IS NOT NULL")

    def _keys(self, s: DataFrame) -> DataFrame:
        """Unique columns; first: the one that is the primary key."""
        u = s.filter("unique AND kind <> 'slot'")
        first = u.filter("held = n_rows").groupBy("snapshot_id", "table_name").agg(F.min("position").alias("first"))
        return u.join(first, ["snapshot_id", "table_name"], "left").withColumn("is_primary", F.coalesce(F.col("position") == F.col("first"), F.lit(False)))

    def _constraints(self, s: DataFrame) -> DataFrame:
        def of(df: DataFrame, name: Column, kind: str | Column, **given: Column) -> DataFrame:
            types = {x.name: x.dataType for x in self.spark.createDataFrame([], SCHEMAS["constraints"]).schema}
            flags = {k: F.lit(False) for k in ("is_deferrable", "is_initially_deferred", "is_no_inherit", "nulls_not_distinct")}
            cols = flags | {"name": name, "kind": kind if isinstance(kind, Column) else F.lit(kind), "snapshot_id": F.col("snapshot_id"), "table_name": F.col("table_name")} | given
            return df.select(*[cols.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])

        key, one = F.concat_ws("_", "table_name", "name"), F.array("name")
        keys = self._keys(s)
        bound = F.when(F.col("kind") == "num", F.concat("name", F.lit(" >= "), F.floor("least").cast("string"))).otherwise(F.concat("name", F.lit(" <= "), F.col("high").cast("string")))
        action = lambda f, c: F.when(f, c).otherwise("NO ACTION")
        refs = self.references().join(s.select("snapshot_id", "table_name", "name", "held", "n_rows"), ["snapshot_id", "table_name", "name"])
        parts = [
            of(keys.filter("is_primary"), F.concat("table_name", F.lit("_pkey")), "PRIMARY KEY", columns=one),
            of(keys.filter("NOT is_primary"), F.concat(key, F.lit("_key")), "UNIQUE", columns=one),
            of(s.filter("kind = 'num' OR (kind = 'int' AND NOT unique)"), F.concat(key, F.lit("_check")), "CHECK", expression=bound),
            of(s.filter("unique AND kind = 'slot'"), F.concat(key, F.lit("_excl")), "EXCLUDE", elements=F.array(F.struct(F.col("name").alias("expression"), F.lit("=").alias("operator"))), index_method=F.lit("btree")),
            of(refs, F.concat(key, F.lit("_fkey")), "FOREIGN KEY", columns=one, ref_schema=F.lit("public"), ref_table=F.col("ref_table"), ref_columns=F.array("ref_name"), on_delete=action(F.col("held") < F.col("n_rows"), "SET NULL"), on_update=F.lit("NO ACTION")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _indexes(self, s: DataFrame) -> DataFrame:
        key = F.concat_ws("_", "table_name", "name")
        at = F.array(F.struct(F.col("name").alias("column"), F.lit(None).cast("string").alias("expression"), F.lit("asc").alias("sort"), F.lit("last").alias("nulls")))
        tell = lambda df, name, method, unique, by, where: df.select(
            "snapshot_id", "table_name", name.alias("name"), method.alias("method"), F.lit(unique).alias("is_unique"), F.lit(by).alias("is_constraint_index"), at.alias("columns"), where.alias("predicate"), F.lit(None).cast("string").alias("comment")
        )
        null = F.lit(None).cast("string")
        backing = tell(self._keys(s).filter("NOT is_primary"), F.concat(key, F.lit("_key")), F.lit("btree"), True, True, null)
        chosen = s.filter("kind IN ('int', 'slot') AND NOT unique AND 2 * d > held")
        method = F.when(4 * F.col("d") >= 3 * F.col("held"), "hash").otherwise("btree")
        return backing.unionByName(tell(chosen, F.concat(key, F.lit("_idx")), method, False, False, F.when(F.col("held") < F.col("n_rows"), F.concat("name", F.lit(" IS NOT NULL")))))

    def pairs(self) -> DataFrame:
        """pair_id, source_id, target_id: every snapshot of a feed and the next; the first one from nothing, the last one to nothing."""
        from pyspark.sql import Window

        ids = self.stats.select("feed", "snapshot_id").distinct()
        w = Window.partitionBy("feed").orderBy("snapshot_id")
        near = ids.select(F.coalesce(F.lag("snapshot_id").over(w), F.lit("")).alias("source_id"), F.col("snapshot_id").alias("target_id"))
        last = ids.groupBy("feed").agg(F.max("snapshot_id").alias("source_id")).select("source_id", F.lit("").alias("target_id"))
        return kept(near.unionByName(last).select(F.concat("source_id", F.lit(".."), "target_id").alias("pair_id"), "source_id", "target_id").hint("rebalance"))
