"""Immutable descriptions of all tables of a workspace at one moment."""

from __future__ import annotations

import copy
import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field


@dataclass
class ColumnInfo:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None
    autoincrement: bool = False
    declared: str = ""
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass
class TableInfo:
    """paths: folders of Parquet files, relative to the workspace; their union is the table. Constraints name columns."""

    columns: list[ColumnInfo]
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)
    next_rowid: int = 1
    id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def column(self, name: str) -> ColumnInfo:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"no column {name}")

    def keys(self) -> list[list[str]]:
        """Column groups whose values may not repeat; the primary key first."""
        unique = [list(i["columns"]) for i in self.indexes.values() if i["unique"]]
        return [*([self.primary_key] if self.primary_key else []), *self.unique, *unique]

    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.type}" for c in self.columns)

    def fingerprint(self) -> str:
        """A hash of what the table looks like, whatever its rows."""
        shape = [[c.name, c.type, c.nullable, c.default, c.autoincrement] for c in self.columns]
        text = json.dumps([shape, self.primary_key, sorted(self.unique), {k: self.indexes[k] for k in sorted(self.indexes)}], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Manifest:
    tables: dict[str, TableInfo] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)
    parents: list[str] = field(default_factory=list)
    migrations: list[list[str]] = field(default_factory=list)

    def copy(self) -> Manifest:
        return copy.deepcopy(self)

    def find(self, name: str) -> str:
        """The name of a table as it was declared."""
        for known in self.tables:
            if known.lower() == name.lower():
                return known
        raise KeyError(f"no table {name}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        tables = {k: TableInfo(**{**t, "columns": [ColumnInfo(**c) for c in t["columns"]]}) for k, t in raw["tables"].items()}
        return cls(tables, raw["functions"], raw["parents"], raw.get("migrations", []))

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:32]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps({k: t.fingerprint() for k, t in sorted(self.tables.items())}).encode()).hexdigest()
