"""Diffs and merges of branches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.diffmerge import diff, multiset_merge, three_way_merge
from .manifest import Manifest, TableInfo
from .workspace import Workspace


def branch_diff(workspace: Workspace, old: str, new: str) -> dict[str, DataFrame | str]:
    """For each table that differs: 'added', 'removed', or the diff of its rows. Tables with the same files need no look at them."""
    a, b = workspace.manifest(old), workspace.manifest(new)
    out: dict[str, DataFrame | str] = {}
    for name in sorted({*a.tables, *b.tables}):
        if name not in a.tables or name not in b.tables:
            out[name] = "removed" if name not in b.tables else "added"
            continue
        x, y = a.tables[name], b.tables[name]
        if x.paths != y.paths or x.fingerprint() != y.fingerprint():
            key = x.primary_key if x.primary_key == y.primary_key else []
            out[name] = diff(workspace.read(x), workspace.read(y), key or None)
    return out


@dataclass
class Preview:
    """changes: what the merge does to each table; conflicts: tables, with the rows (or a reason) that both sides changed."""

    changes: dict[str, str] = field(default_factory=dict)
    conflicts: dict[str, DataFrame | str] = field(default_factory=dict)


def merge_branches(workspace: Workspace, source: str, target: str, prefer: str | None = None, dry: bool = False) -> Preview:
    """Merges source into target, against their common ancestor. prefer: 'ours' (target) or 'theirs' (source) settles conflicts.

    With conflicts that nothing settles, or with dry, nothing is written.
    """
    (number, one), (_, other) = workspace.place(target), workspace.place(source)
    base, ours, theirs = workspace.ancestor(target, source), workspace.load(one), workspace.load(other)
    preview, result = Preview(), ours.copy()
    same = lambda x, y: (x is None) == (y is None) and (x is None or x.paths == y.paths and x.fingerprint() == y.fingerprint())
    for name in sorted({*base.tables, *ours.tables, *theirs.tables}):
        b, o, t = (m.tables.get(name) for m in (base, ours, theirs))
        if same(o, t) or same(b, t):
            continue
        if same(b, o):
            preview.changes[name] = "removed" if t is None else "taken"
            _place(result, name, t)
            continue
        if o is None or t is None or b is None or o.fingerprint() != t.fingerprint():
            if prefer:
                preview.changes[name] = f"taken from {prefer}"
                _place(result, name, o if prefer == "ours" else t)
            else:
                preview.conflicts[name] = "both sides changed the table itself"
            continue
        rows = [workspace.read(x) for x in (b, o, t)]
        if o.primary_key:
            merge = three_way_merge(*rows, o.primary_key, prefer)
            if not prefer and merge.conflicts.limit(1).count():
                preview.conflicts[name] = merge.conflicts
                continue
            merged = merge.merged
        else:
            merged = multiset_merge(*rows)
        preview.changes[name] = "rows merged"
        if not dry and not preview.conflicts:
            info = Manifest({"t": o}).copy().tables["t"]
            info.paths, info.next_rowid = [workspace.write(merged, info)], max(o.next_rowid, t.next_rowid)
            result.tables[name] = info
    if not dry and not preview.conflicts:
        result.parents = [one, other]
        workspace._publish(target, number + 1, result)  # fails if the target has moved since it was read
    return preview


def _place(manifest: Manifest, name: str, info: TableInfo | None) -> None:
    manifest.tables.pop(name, None)
    if info is not None:
        manifest.tables[name] = info


def schema_diff(old: Manifest, new: Manifest) -> list[tuple[str, str, str]]:
    """(change, table, column): what happened to tables and columns, which are known again by their ids after a renaming."""
    out = []
    before, after = {t.id: (n, t) for n, t in old.tables.items()}, {t.id: (n, t) for n, t in new.tables.items()}
    for i in before.keys() - after.keys():
        out.append(("drop table", before[i][0], ""))
    for i in after.keys() - before.keys():
        out.append(("create table", after[i][0], ""))
    for i in before.keys() & after.keys():
        (n, t), (m, u) = before[i], after[i]
        if n != m:
            out.append(("rename table", n, m))
        a, b = {c.id: c for c in t.columns}, {c.id: c for c in u.columns}
        out += [("drop column", m, a[k].name) for k in a.keys() - b.keys()]
        out += [("add column", m, b[k].name) for k in b.keys() - a.keys()]
        for k in a.keys() & b.keys():
            if a[k].name != b[k].name:
                out.append(("rename column", m, f"{a[k].name} {b[k].name}"))
            if (a[k].type, a[k].nullable, a[k].default) != (b[k].type, b[k].nullable, b[k].default):
                out.append(("change column", m, b[k].name))
    return sorted(out)


def migration(old: Manifest, new: Manifest) -> list[str]:
    """Statements that make tables of the old layout those of the new one; a changed type needs a rewriting that no statement gives, and is noted as a comment."""
    out = []
    for change, table, column in schema_diff(old, new):
        if change == "drop table":
            out.append(f"DROP TABLE {table}")
        elif change == "create table":
            t = new.tables[table]
            parts = [_column_sql(c) for c in t.columns]
            parts += [f"PRIMARY KEY ({', '.join(t.primary_key)})"] if t.primary_key else []
            parts += [f"UNIQUE ({', '.join(u)})" for u in t.unique]
            out.append(f"CREATE TABLE {table} ({', '.join(parts)})")
        elif change == "rename table":
            out.append(f"ALTER TABLE {table} RENAME TO {column}")
        elif change == "drop column":
            out.append(f"ALTER TABLE {table} DROP COLUMN {column}")
        elif change == "add column":
            out.append(f"ALTER TABLE {table} ADD COLUMN {_column_sql(new.tables[table].column(column))}")
        elif change == "rename column":
            out.append("ALTER TABLE {} RENAME COLUMN {} TO {}".format(table, *column.split(" ")))
        else:
            out.append(f"-- column {column} of {table} changes its type or constraints")
    return out


def _column_sql(c) -> str:
    kind = c.declared or {"bigint": "INTEGER", "string": "TEXT", "double": "REAL", "binary": "BLOB"}.get(c.type, c.type.upper())
    return f"{c.name} {kind}{'' if c.nullable else ' NOT NULL'}{f' DEFAULT {c.default}' if c.default else ''}"
