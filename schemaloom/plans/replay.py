"""Replay of operations over a schema state: the one ordered fold.

Histories are independent, so they spread over the cluster; within one, the
operations apply one after the other (`state_at`: applyInPandas per history).
The first error stops a history and is its result.  Objects are held by name, so
adding or renaming onto a name that is taken is an error (AlreadyExists): none is
ever replaced silently.
"""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY = {"schema": "public", "tables": {}, "views": {}, "sequences": {}, "enums": {}}


class ReplayError(ValueError):
    """kind: SchemaMismatch, AlreadyExists or NotFound."""

    def __init__(self, kind: str, what: str) -> None:
        super().__init__(f"{kind}: {what}")
        self.kind = kind


def _get(box: dict, name: str, what: str):
    if name not in box:
        raise ReplayError("NotFound", f"{what} {name}")
    return box[name]


def _create(box: dict, name: str, what: str, value) -> None:
    if name in box:
        raise ReplayError("AlreadyExists", f"{what} {name}")
    box[name] = value


def _rename(box: dict, name: str, to: str, what: str) -> None:
    value = _get(box, name, what)
    if to != name and to in box:
        raise ReplayError("AlreadyExists", f"{what} {to}")
    del box[name]
    if isinstance(value, dict) and "name" in value:
        value["name"] = to
    box[to] = value


_BOXES = {"Table": "tables", "View": "views", "Sequence": "sequences", "Enum": "enums"}


def _index_home(state: dict, name: str) -> dict:
    for t in state["tables"].values():
        if name in t["indexes"]:
            return t["indexes"]
    raise ReplayError("NotFound", f"index {name}")


def apply(state: dict, ops: list[dict]) -> dict:
    """The state after ops; ops are dicts of op_kind, schema, table_name, name, to_name and payload (a dict)."""
    state = copy.deepcopy(state)
    for op in ops:
        if op["op_kind"] != "RefreshMaterializedView" and op.get("schema", state["schema"]) != state["schema"]:
            raise ReplayError("SchemaMismatch", f"{op['schema']} is not {state['schema']}")
        _one(state, op["op_kind"], op.get("table_name"), op.get("name"), op.get("to_name"), op.get("payload") or {})
    return state


def _one(state: dict, kind: str, table: str | None, name: str, to: str | None, p: dict) -> None:
    verb = next(v for v in ("Create", "Drop", "Rename", "Alter", "Add", "Set", "Replace", "Refresh") if kind.startswith(v))
    what = kind[len(verb) :]
    if what in _BOXES and verb in ("Create", "Drop", "Rename"):
        box = state[_BOXES[what]]
        if verb == "Create":
            if what == "Table":
                load = lambda items: {x["name"]: x for x in (json.loads(y) if isinstance(y, str) else y for y in items)}
                p = {"kind": p.get("kind"), "comment": p.get("comment"), "columns": load(p.get("columns", [])), "constraints": load(p.get("constraints", [])), "indexes": {}}
            _create(box, name, what.lower(), p)
        elif verb == "Drop":
            _get(box, name, what.lower())
            del box[name]
        else:
            _rename(box, name, to, what.lower())
    elif kind in ("AddColumn", "AddConstraint", "CreateIndex"):
        home = _get(state["tables"], table, "table")
        _create(home[{"AddColumn": "columns", "AddConstraint": "constraints", "CreateIndex": "indexes"}[kind]], name, what.lower(), p)
    elif kind in ("DropColumn", "DropConstraint", "RenameColumn", "RenameConstraint"):
        home = _get(state["tables"], table, "table")["columns" if what == "Column" else "constraints"]
        if verb == "Drop":
            _get(home, name, what.lower())
            del home[name]
        else:
            _rename(home, name, to, what.lower())
    elif kind == "DropIndex":
        del _index_home(state, name)[name]
    elif kind == "RenameIndex":
        _rename(_index_home(state, name), name, to, "index")
    elif kind == "AlterColumn":
        column = _get(_get(state["tables"], table, "table")["columns"], name, "column")
        for field, change in p.items():
            if change is not None:
                column[field] = change.get("to")
    elif kind == "AlterSequence":
        _get(state["sequences"], name, "sequence").update(p)
    elif kind == "AddEnumValue":
        labels = _get(state["enums"], name, "enum")["labels"]
        if "before" in p or "after" in p:
            mark = p.get("before") or p.get("after")
            if mark not in labels:
                raise ReplayError("NotFound", f"enum value {mark}")
            labels.insert(labels.index(mark) + ("after" in p), p["label"])
        else:
            labels.append(p["label"])
    elif kind == "ReplaceView":
        _get(state["views"], name, "view")["definition"] = p["definition"]
    elif kind == "SetComment":
        target = state
        on = p.get("kind")
        if on in ("column", "constraint"):
            target = _get(_get(state["tables"], table, "table")[f"{on}s"], name, on)
        elif on == "index":
            target = _index_home(state, name)[name]
        elif on in ("table", "view", "sequence", "enum"):
            target = _get(state[f"{on}s"], name, on)
        target["comment"] = p.get("comment")


def replay(ops: DataFrame, start: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """key, state (JSON), error: ops (key, seq, op_kind, schema, table_name, name, to_name, payload) applied in order
    to the start state (key, state) of their key, or to an empty one."""
    cols = ["seq", "op_kind", "schema", "table_name", "name", "to_name", "payload"]
    grouped = ops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols)), lambda a, b: a["seq"] - b["seq"]).alias("ops"))
    rows = grouped.withColumn("state", F.lit(None).cast("string")) if start is None else grouped.join(start, key, "full_outer")

    def fold(frames):
        for f in frames:
            out = []
            for k, steps, state in zip(f[key], f["ops"], f["state"], strict=True):
                now = json.loads(state) if state else EMPTY
                todo = [] if steps is None else [{c: x[c] for c in cols} | {"payload": json.loads(x["payload"]) if x["payload"] else {}} for x in steps]
                if todo:
                    now = now | {"schema": todo[0]["schema"] or now["schema"]}
                try:
                    out.append((k, json.dumps(apply(now, todo), sort_keys=True), None))
                except ReplayError as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "state", "error"])

    return rows.select(key, "ops", "state").mapInPandas(fold, f"{key} {ops.schema[key].dataType.simpleString()}, state string, error string")


def state_of(catalog, snapshot_ids: DataFrame) -> DataFrame:
    """snapshot_id, state (JSON) of snapshots: what replay starts from and compares with."""
    from ..operators.diff import _PAYLOAD

    ids = snapshot_ids.select("snapshot_id").distinct()

    def named(relation: str, cols: list[str], by: str = "table_name") -> DataFrame:
        df = getattr(catalog, relation)
        row = F.to_json(F.struct("name", *[c for c in cols if c != "name"]))
        return df.groupBy("snapshot_id", by).agg(F.array_sort(F.collect_list(row)).alias(relation)) if by else df.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(row)).alias(relation))

    t = catalog.tables
    for relation, cols in (("columns", ["position", "type", "is_nullable", "default_expr", "generated", "identity", "collation", "comment"]),
            ("constraints", [*_PAYLOAD, "comment"]), ("indexes", ["method", "is_unique", "is_constraint_index", "columns", "predicate", "comment"])):
        t = t.join(named(relation, cols), ["snapshot_id", "table_name"], "left")
    tables = t.groupBy("snapshot_id").agg(F.collect_list(F.struct("table_name", "kind", "comment", "columns", "constraints", "indexes")).alias("tables"))
    out = ids.join(catalog.namespaces.select("snapshot_id", "schema"), "snapshot_id", "left").join(tables, "snapshot_id", "left")
    for relation, cols in (("views", ["definition", "is_materialized", "comment"]), ("sequences", ["data_type", "start_value", "increment", "min_value", "max_value", "cache_size", "is_cyclic", "comment"]), ("enums", ["labels", "comment"])):
        out = out.join(named(relation, cols, ""), "snapshot_id", "left")

    def build(frames):
        box = lambda items: {x["name"]: x for x in map(json.loads, items if items is not None else [])}
        for f in frames:
            rows = []
            for r in f.itertuples():
                ts = {} if r.tables is None else {x["table_name"]: {"kind": x["kind"], "comment": x["comment"], "columns": box(x["columns"]), "constraints": box(x["constraints"]), "indexes": box(x["indexes"])} for x in r.tables}
                state = {"schema": r.schema or "public", "tables": ts, "views": box(r.views), "sequences": box(r.sequences), "enums": box(r.enums)}
                rows.append((r.snapshot_id, json.dumps(state, sort_keys=True)))
            yield pd.DataFrame(rows, columns=["snapshot_id", "state"])

    return out.mapInPandas(build, "snapshot_id string, state string")


def state_at(ops: DataFrame, h: DataFrame, checkpoints: DataFrame, targets: DataFrame) -> DataFrame:
    """history_id, seq, state, error at each target (history_id, seq).

    h: the histories' migrations with is_checkpoint; checkpoints: history_id, seq, state; ops: history_id, seq (of the
    migration), k (order within it) and the operation.  A state starts from the nearest checkpoint at or before its target,
    or from nothing, and the operations after it are applied in order.
    """
    from ..operators.history import nearest_checkpoint, ops_to_replay

    key = F.concat_ws("@", "history_id", F.col("target").cast("string"))
    todo = ops_to_replay(ops, targets, h).withColumn("key", key)
    order = F.row_number().over(Window.partitionBy("key").orderBy("seq", "k"))
    todo = todo.withColumn("seq", order)
    start = targets.join(nearest_checkpoint(h), ["history_id", "seq"]).withColumnRenamed("seq", "target").withColumn("key", key)
    start = start.join(checkpoints.withColumnRenamed("seq", "checkpoint_seq"), ["history_id", "checkpoint_seq"], "left")
    states = replay(todo, start.select("key", F.coalesce("state", F.lit(json.dumps(EMPTY))).alias("state")), "key")
    return start.select("key", "history_id", F.col("target").alias("seq")).join(states, "key").drop("key")


_STATE = (
    "tables map<string, struct<columns: map<string, struct<type: struct<formatted: string>, is_nullable: boolean>>, constraints: map<string, struct<kind: string>>, indexes: map<string, struct<method: string, is_constraint_index: boolean>>>>, "
    "enums map<string, struct<labels: array<string>>>, sequences map<string, struct<data_type: string>>, views map<string, struct<definition: string>>"
)


def objects(states: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, table_name, name, type, is_nullable: one row for each object of a state (JSON); type is a column's type, a
    constraint's kind, an index's method, a sequence's type, or an enum's sorted labels."""
    s = states.select(*keys, F.from_json("state", _STATE).alias("s"))
    null, unknown = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def rows(df: DataFrame, kind: str, table, type_, nullable=unknown) -> DataFrame:
        return df.select(*keys, F.lit(kind).alias("kind"), table.alias("table_name"), F.col("name"), type_.alias("type"), nullable.alias("is_nullable"))

    tables = s.select(*keys, F.explode("s.tables").alias("table", "t"))
    inner = lambda field: tables.select(*keys, "table", F.explode(F.col(f"t.{field}")).alias("name", "x"))
    top = lambda field: s.select(*keys, F.explode(F.col(f"s.{field}")).alias("name", "x"))
    out = rows(tables.withColumnRenamed("table", "name"), "table", null, null)
    out = out.unionByName(rows(inner("columns"), "column", F.col("table"), F.col("x.type.formatted"), F.col("x.is_nullable")))
    out = out.unionByName(rows(inner("constraints"), "constraint", F.col("table"), F.col("x.kind")))
    out = out.unionByName(rows(inner("indexes").filter("not x.is_constraint_index"), "index", F.col("table"), F.col("x.method")))
    out = out.unionByName(rows(top("enums"), "enum", null, F.array_join(F.array_sort("x.labels"), ",")))
    out = out.unionByName(rows(top("sequences"), "sequence", null, F.col("x.data_type")))
    return out.unionByName(rows(top("views"), "view", null, null))
