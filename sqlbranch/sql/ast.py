"""What the parser makes of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    """An expression. kind: lit, param, column, star, unary, binary, is_null, in, between, like, case, cast, vector, call, exists, scalar."""

    kind: str
    value: Any = None
    args: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


@dataclass
class Item:
    expr: Node
    alias: str | None = None


@dataclass
class Source:
    """A table or a query in FROM."""

    name: str | None
    alias: str | None
    query: Any = None


@dataclass
class Join:
    kind: str
    source: Source
    on: Node | None = None
    using: list[str] = field(default_factory=list)
    natural: bool = False


@dataclass
class Order:
    expr: Node
    descending: bool = False
    nulls: str | None = None


@dataclass
class Select:
    items: list[Item]
    source: Source | None = None
    joins: list[Join] = field(default_factory=list)
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    order: list[Order] = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None
    distinct: bool = False


@dataclass
class SetOp:
    op: str
    all: bool
    left: Any
    right: Any
    order: list[Order] = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None


@dataclass
class With:
    tables: list[tuple[str, Any]]
    body: Any


@dataclass
class Column:
    name: str
    type: str = ""
    nullable: bool = True
    default: Node | None = None
    default_sql: str | None = None
    autoincrement: bool = False


@dataclass
class Statement:
    """Anything but a query: its name and parts."""

    kind: str
    parts: dict[str, Any] = field(default_factory=dict)
