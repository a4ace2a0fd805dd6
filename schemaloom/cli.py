"""Command line over DDL files: ``python -m schemaloom.cli plan old.sql new.sql``.  Results are frames; rows go to stdout.

Verbs: list (registered queries), query, diff, plan, script, inverse, breaking, describe, show-sql, execute, checksum, codegen.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Catalog
from .operators import breaking, history
from .operators.diff import Diff, pairs_frame
from .plans import codegen, compile as compiling, operations
from .sources import ddl

PAIRED = ("diff", "plan", "script", "inverse", "breaking", "describe", "show-sql", "execute")


def _load(spark: SparkSession, path: str, snapshot_id: str) -> Catalog:
    catalog, errors = ddl.load_files(spark, path, snapshot_id)
    bad = errors.first()
    if bad:
        raise ddl.DdlError(f"{path}: {bad['error']}")
    return catalog


def _paired(verb: str, d: Diff, as_json: bool) -> DataFrame:
    if verb == "diff":
        return d.drift().orderBy("kind", "change")
    if verb == "breaking":
        return breaking.analyse(d).orderBy("change", "table_name", "object_name")
    plan = operations.plan(d)
    if verb == "plan":
        return plan.select("seq", "op_kind", "table_name", "name", "to_name", "description", "forward", "rollback").orderBy("seq")
    if verb == "execute":
        return compiling.execute(plan)
    return {"script": lambda: operations.script(plan), "inverse": lambda: operations.inverse(plan).orderBy("seq"), "describe": lambda: compiling.describe(plan, as_json), "show-sql": lambda: compiling.show_sql(plan, as_json)}[verb]()


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | list[str]:
    """What a verb gives: a frame, or names."""
    if args.verb == "list":
        from .queries import QUERIES

        return sorted(QUERIES)
    if args.verb == "query":
        from .queries import QUERIES

        return QUERIES[args.name](spark, args.tables)
    if args.verb in PAIRED:
        both = _load(spark, args.source, "source").union(_load(spark, args.target, "target"))
        return _paired(args.verb, Diff(both, pairs_frame(spark, [("change", "source", "target")])), args.json)
    catalog = _load(spark, args.target, "target")
    if args.verb == "checksum":
        return history.checksum(catalog)
    return codegen.GENERATORS[args.language].generate(catalog).select("file", "content").orderBy("file")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="schemaloom", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    q = verbs.add_parser("query")
    q.add_argument("name")
    q.add_argument("tables", help="folder of NAME.parquet")
    for verb in PAIRED:
        v = verbs.add_parser(verb)
        v.add_argument("source", help="DDL file or folder")
        v.add_argument("target", help="DDL file or folder")
        v.add_argument("--json", action="store_true")
    verbs.add_parser("checksum").add_argument("target")
    c = verbs.add_parser("codegen")
    c.add_argument("target")
    c.add_argument("--language", choices=sorted(codegen.GENERATORS), default="python")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if spark is None:
        os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
        spark = SparkSession.builder.appName("schemaloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = run(spark, args)
    except (ddl.DdlError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if isinstance(out, list):
        print("\n".join(out))
        return 0
    alone = [c for c in ("sql", "output") if c in out.columns]
    for r in out.select(*alone[:1] or [F.to_json(F.struct(*out.columns)).alias("row")]).toLocalIterator():
        print(r[0] if alone else json.dumps(json.loads(r[0]), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
