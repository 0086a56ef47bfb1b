"""Around the engine: schema lint, doctor, seeds, SQL logic tests and typed named queries."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .catalog.manifest import Manifest
from .engine import Engine
from .sql.ast import Select, SetOp, Statement, With
from .sql.lexer import lex
from .sql.parser import parse
from .types import kind_of

_RESERVED = set("SELECT FROM WHERE GROUP ORDER BY TABLE INDEX INSERT UPDATE DELETE CREATE DROP ALTER JOIN UNION VALUES SET CASE WHEN".split())


def lint(sql: str) -> list[tuple[str, str]]:
    """(code, message) of what is doubtful in a text.

    L001 table without primary key, L002 SELECT *, L003 unnamed UNIQUE, L004 all columns nullable, L005 reserved word as a name, L006 mixed case in a name.
    """
    out = []

    def query(q):
        if isinstance(q, With):
            for _, body in q.tables:
                query(body)
            query(q.body)
        elif isinstance(q, SetOp):
            query(q.left)
            query(q.right)
        elif isinstance(q, Select):
            if any(i.expr.kind == "star" for i in q.items):
                out.append(("L002", "SELECT * names no columns"))
            for s in [q.source, *(j.source for j in q.joins)]:
                if s is not None and s.query is not None:
                    query(s.query)

    for statement in parse(sql):
        if not isinstance(statement, Statement):
            query(statement)
        elif statement.kind == "create_table" and "columns" in statement.parts:
            name, columns = statement.parts["name"], statement.parts["columns"]
            if not statement.parts["primary_key"]:
                out.append(("L001", f"{name} has no primary key"))
            if statement.parts["unique"]:
                out.append(("L003", f"{name} has a UNIQUE without a name"))
            if columns and all(c.nullable for c in columns) and not statement.parts["primary_key"]:
                out.append(("L004", f"all columns of {name} may be null"))
            for n in [name, *(c.name for c in columns)]:
                if n.upper() in _RESERVED:
                    out.append(("L005", f"{n} is a reserved word"))
                if n != n.lower() and n != n.upper():
                    out.append(("L006", f"{n} mixes cases"))
    return out


def doctor(engine: Engine, expected: Manifest | None = None) -> list[str]:
    """What is wrong with a workspace: missing folders, files whose columns don't fit, and tables that differ from an expected layout."""
    manifest, out = engine.workspace.manifest(), []
    for name, info in manifest.tables.items():
        for path in info.paths:
            if not engine.workspace.files.exists(path):
                out.append(f"{name}: {path} is missing")
    if expected is not None:
        out += [f"{name}: not in the workspace" for name in sorted(expected.tables.keys() - manifest.tables.keys())]
        out += [f"{name}: not expected" for name in sorted(manifest.tables.keys() - expected.tables.keys())]
        out += [f"{name}: another layout" for name in sorted(manifest.tables.keys() & expected.tables.keys()) if manifest.tables[name].fingerprint() != expected.tables[name].fingerprint()]
    return out


def seed(engine: Engine, folder: str, profile: str = "default") -> list[str]:
    """Runs the .sql files of folder, then those of folder/profile, each in the order of their names."""
    done = []
    for place in (folder, os.path.join(folder, profile)):
        for name in sorted(os.listdir(place)) if os.path.isdir(place) else []:
            if name.endswith(".sql"):
                with open(os.path.join(place, name), encoding="utf-8") as f:
                    engine.script(f.read())
                done.append(name)
    return done


def cell(value) -> str:
    """A value as logic tests write it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def run_logic_test(engine: Engine, text: str) -> list[str]:
    """Runs records `statement ok|error` and `query TYPES` with `----` and expected cells, row by row; gives what fails."""
    failed = []
    for record in re.split(r"\n\s*\n", re.sub(r"(?m)^#.*\n?", "", text)):
        head, _, body = record.strip().partition("\n")
        if not head:
            continue
        sql, _, wanted = body.partition("\n----")
        try:
            result, error = engine.sql(sql), None
            if isinstance(result, DataFrame):
                got = [cell(v) for r in result.collect() for v in r]
        except Exception as e:
            error = str(e)
        if head.startswith("statement"):
            if (error is None) != (head.split()[1] == "ok"):
                failed.append(f"{sql.strip()}: {error or 'no error'}")
        elif error is not None:
            failed.append(f"{sql.strip()}: {error}")
        elif got != wanted.split():
            failed.append(f"{sql.strip()}: {got}, not {wanted.split()}")
    return failed


def run_sql_tests(make, folder: str) -> dict[str, str]:
    """Each .sql file of a folder on an engine of its own (make()); a file with `-- EXPECT ERROR` has to fail. Name -> what is wrong, or nothing."""
    out = {}
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".sql")):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        try:
            for result in make().script(text):
                if isinstance(result, DataFrame):
                    result.collect()
            error = ""
        except Exception as e:
            error = str(e)[:300]
        wanted = "-- EXPECT ERROR" in text
        out[name] = ("" if error else "no error") if wanted else error
    return out


@dataclass
class NamedQuery:
    name: str
    sql: str
    params: list[str]
    columns: list[tuple[str, str]]


def named_queries(engine: Engine, text: str) -> list[NamedQuery]:
    """Queries under `-- name: NAME` lines, with their parameters and the types of their columns, which Spark finds without running them."""
    out = []
    for part in re.split(r"(?m)^--\s*name:\s*", text)[1:]:
        name, _, sql = part.partition("\n")
        params = list(dict.fromkeys(t.text[1:] for t in lex(sql) if t.kind == "param"))
        df = engine.sql(sql)
        columns = [(f.name, kind_of(f.dataType)) for f in df.schema] if isinstance(df, DataFrame) else []
        out.append(NamedQuery(name.strip(), sql.strip(), params, columns))
    return out
