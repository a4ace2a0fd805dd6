"""A history as files: migrations/NNNNN.json in their order, migrations/index.json, state.json and schema.sql.

`Store` is the small driver-side half, for one history that someone edits; `read_stores` reads any number of such folders
as frames, which all operators over histories take.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import ZERO
from ..plans.replay import EMPTY, apply

MIGRATION = "id string, parent_hash string, resulting_hash string, description string, operations string, is_checkpoint boolean, state string"


class StoreError(RuntimeError):
    """kind: NotInitialised, AlreadyInitialised, Duplicate, NotFound, WrongParent or BrokenChain."""

    def __init__(self, kind: str, what: str = "") -> None:
        super().__init__(f"{kind} {what}".strip())
        self.kind = kind


def state_hash(state: dict) -> str:
    return hashlib.sha256(("state:" + json.dumps(state, sort_keys=True)).encode()).hexdigest()


class Store:
    """One folder.  A migration is a dict of id, parent_hash, resulting_hash, description, operations (a list), and for
    checkpoints is_checkpoint and state."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.folder = self.root / "migrations"

    def _read(self, path: Path):
        if not (self.folder / "index.json").exists():
            raise StoreError("NotInitialised", str(self.root))
        if not path.exists():
            raise StoreError("NotFound", path.name)
        return json.loads(path.read_text())

    @staticmethod
    def _write(path: Path, value) -> None:
        part = path.with_suffix(".part")
        part.write_text(json.dumps(value, indent=2, sort_keys=True))
        part.rename(path)  # whole or not at all

    def is_initialised(self) -> bool:
        return (self.folder / "index.json").exists()

    def initialise(self) -> None:
        if self.is_initialised():
            return
        self.folder.mkdir(parents=True, exist_ok=True)
        self._write(self.folder / "index.json", [])
        self._write(self.root / "state.json", {"hash": ZERO, "state": EMPTY})

    def index(self) -> list[dict]:
        """id, parent_hash, resulting_hash, description and is_checkpoint of every migration, in order."""
        return self._read(self.folder / "index.json")

    def _at(self, id_: str) -> int:
        for k, row in enumerate(self.index(), 1):
            if row["id"] == id_:
                return k
        raise StoreError("NotFound", id_)

    def migration(self, id_: str) -> dict:
        return self._read(self.folder / f"{self._at(id_):05}.json")

    def migrations(self) -> list[dict]:
        return [self._read(self.folder / f"{k:05}.json") for k in range(1, len(self.index()) + 1)]

    def save(self, migration: dict) -> None:
        index = self.index()
        if any(r["id"] == migration["id"] for r in index):
            raise StoreError("Duplicate", migration["id"])
        self._write(self.folder / f"{len(index) + 1:05}.json", migration)
        fields = ("id", "parent_hash", "resulting_hash", "description")
        self._write(self.folder / "index.json", [*index, {k: migration.get(k) for k in fields} | {"is_checkpoint": bool(migration.get("is_checkpoint"))}])

    def current_hash(self) -> str:
        index = self.index()
        return index[-1]["resulting_hash"] if index else ZERO

    def current_state(self) -> dict:
        return self._read(self.root / "state.json")["state"]

    def save_state(self, state: dict, sql: str | None = None) -> None:
        self._write(self.root / "state.json", {"hash": state_hash(state), "state": state})
        if sql is not None:
            (self.root / "schema.sql").write_text(sql)

    def record(self, migration: dict, sql: str | None = None) -> dict:
        """Save a migration whose parent is the current state, and the state after it."""
        if migration["parent_hash"] != self.current_hash():
            raise StoreError("WrongParent", migration["id"])
        state = migration["state"] if migration.get("is_checkpoint") else apply(self.current_state(), migration["operations"])
        self.save(migration)
        self.save_state(state, sql)
        return state

    def state_at(self, id_: str) -> dict:
        """From the nearest checkpoint at or before a migration, or from nothing, the operations after it."""
        all_, end = self.migrations(), self._at(id_)
        start = max((k for k in range(1, end + 1) if all_[k - 1].get("is_checkpoint")), default=0)
        state = all_[start - 1]["state"] if start else EMPTY
        for m in all_[start:end]:
            state = apply(state, m["operations"])
        return state

    def verify_chain(self) -> None:
        want = ZERO
        for row in self.index():
            if row["parent_hash"] != want:
                raise StoreError("BrokenChain", row["id"])
            want = row["resulting_hash"]

    def since(self, hash_: str) -> list[dict]:
        """Migrations after the state with this hash; all for the zero hash."""
        all_ = self.migrations()
        if hash_ == ZERO:
            return all_
        begin = next((k for k, m in enumerate(all_) if m["parent_hash"] == hash_), len(all_))
        return all_[begin:]


def read_stores(spark: SparkSession, roots: str) -> DataFrame:
    """history_id (the folder's name), seq and the migration's fields, of all folders that a path or glob names; operations
    and state are JSON text."""
    files = spark.read.text(f"{roots}/migrations/[0-9][0-9][0-9][0-9][0-9].json", wholetext=True).select("value", F.input_file_name().alias("path"))
    parts = F.split("path", "/")
    number = F.regexp_extract("path", r"(\d{5})\.json$", 1).cast("int")
    return files.select(F.element_at(parts, -3).alias("history_id"), number.alias("seq"), F.from_json("value", MIGRATION).alias("m")).select("history_id", "seq", "m.*").withColumn("is_checkpoint", F.coalesce("is_checkpoint", F.lit(False)))
