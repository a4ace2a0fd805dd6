"""Histories in a shared folder as a source and a sink of Spark: ``format("histories")``.

One folder for each history, laid out as ``store.Store`` has it: migrations/NNNNN.json, and migrations/index.json, which alone says
what belongs to the history.  Reading is dealt by history, so any number of them spreads over the cluster and no task lists files of
another's.

Writing appends, in two steps.  Tasks check their histories (an id that is there already, a parent that isn't the current hash)
and put files aside under a name of the attempt; the commit moves them and then replaces each index, at once for each history.  A
task that fails, or a second attempt of one, leaves nothing that an index names, and an abort clears what was put aside.  A history that has
moved on meanwhile is refused at the commit.

All rows of a history must be in one task, in their order: ``write_histories`` sees to it.  The folder must be one that the
driver and all executors share and that Python can open.
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.history import ZERO
from .store import StoreError

SCHEMA = "history_id string, seq int, id string, parent_hash string, resulting_hash string, description string, operations string, is_checkpoint boolean"
_SHOWN = ("id", "parent_hash", "resulting_hash", "description")
_ASIDE = "_aside"


def _root(options: dict) -> Path:
    if not options.get("path"):
        raise ValueError("histories: a path is needed")
    return Path(unquote(options["path"].removeprefix("file://")))


def _index(root: Path, history: str) -> list[dict]:
    at = root / history / "migrations" / "index.json"
    return json.loads(at.read_text()) if at.exists() else []


def _head(index: list[dict]) -> str:
    return index[-1]["resulting_hash"] if index else ZERO


@dataclass
class Some(InputPartition):
    histories: list[str]


class HistoryReader(DataSourceReader):
    def __init__(self, root: Path, parts: int) -> None:
        self.root, self.parts = root, parts

    def partitions(self) -> Sequence[InputPartition]:
        names = sorted(p.name for p in self.root.iterdir() if p.is_dir() and p.name != _ASIDE) if self.root.exists() else []
        return [Some(names[k :: self.parts]) for k in range(min(self.parts, len(names)))] or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        for h in partition.histories:
            for k, _ in enumerate(_index(self.root, h), 1):
                m = json.loads((self.root / h / "migrations" / f"{k:05}.json").read_text())
                yield h, k, m["id"], m["parent_hash"], m.get("resulting_hash"), m.get("description"), json.dumps(m.get("operations", [])), bool(m.get("is_checkpoint"))


@dataclass
class Put(WriterCommitMessage):
    attempt: str


class HistoryWriter(DataSourceWriter):
    def __init__(self, root: Path) -> None:
        self.root, self.job = root, uuid.uuid4().hex

    def _aside(self) -> Path:
        return self.root / _ASIDE / self.job

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        attempt, seen = uuid.uuid4().hex, set()
        for h, new in groupby(rows, key=lambda r: r["history_id"]):
            if h in seen or not h or "/" in h or h == _ASIDE:
                raise ValueError(f"history {h!r}: not a name, or not in one run of rows")
            seen.add(h)
            index = _index(self.root, h)
            ids, head, start = {m["id"] for m in index}, _head(index), len(index)
            folder = self._aside() / attempt / h
            folder.mkdir(parents=True)
            for k, r in enumerate(new, start + 1):
                m = r.asDict()
                if m["id"] in ids:
                    raise StoreError("Duplicate", f"{h}/{m['id']}")
                if m["parent_hash"] != head:
                    raise StoreError("WrongParent", f"{h}/{m['id']}")
                ids.add(m["id"])
                head = m["resulting_hash"]
                whole = {c: m[c] for c in _SHOWN} | {"operations": json.loads(m["operations"] or "[]"), "is_checkpoint": bool(m["is_checkpoint"])}
                (folder / f"{k:05}.json").write_text(json.dumps(whole, indent=2))
                index.append({c: m[c] for c in _SHOWN} | {"is_checkpoint": bool(m["is_checkpoint"])})
            (folder / "index.json").write_text(json.dumps(index, indent=2, sort_keys=True))
            (folder / "start").write_text(str(start))
        return Put(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folders = sorted(f for m in messages if m is not None for f in (self._aside() / m.attempt).glob("*"))
        # first all checks, then all moves
        for f in folders:
            if len(_index(self.root, f.name)) != int((f / "start").read_text()):
                self.abort(messages)
                raise StoreError("WrongParent", f"{f.name} has moved on")
        for f in folders:
            to = self.root / f.name / "migrations"
            to.mkdir(parents=True, exist_ok=True)
            for one in sorted(f.glob("[0-9]*.json")):
                one.replace(to / one.name)
            (f / "index.json").replace(to / "index.json")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self._aside(), ignore_errors=True)


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "histories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HistoryReader(_root(self.options), int(self.options.get("partitions", "64")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("histories: only append")
        return HistoryWriter(_root(self.options))


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format("histories").option("path", path).load()


def write_histories(h: DataFrame, path: str) -> None:
    """Append migrations (history_id, seq, id, parent_hash, resulting_hash, description, operations, is_checkpoint) in the order of seq."""
    h.sparkSession.dataSource.register(HistorySource)
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    rows = h.select(*names).repartition("history_id").sortWithinPartitions("history_id", "seq")
    rows.write.format("histories").mode("append").option("path", path).save()
