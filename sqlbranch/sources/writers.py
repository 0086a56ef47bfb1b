"""DataFrames and tables into files."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

from ..catalog.manifest import Manifest


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.csv(path, header=True, mode=mode, escape='"', quote='"')


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line."""
    df.write.json(path, mode=mode)


def render(df: DataFrame, form: str = "table", rows: int = 1000) -> str:
    """The first rows as text: table, tsv, json or csv."""
    import csv
    import io

    taken = df.limit(rows).collect()
    if form == "json":
        return json.dumps([r.asDict(recursive=True) for r in taken], default=str, ensure_ascii=False)
    shown = [["NULL" if v is None else str(v) for v in r] for r in taken]
    if form in ("csv", "tsv"):
        out = io.StringIO()
        csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n").writerows([df.columns, *([("" if v is None else v) for v in r] for r in taken)])
        return out.getvalue()
    widths = [max(map(len, column)) for column in zip(df.columns, *shown)]
    lines = [" | ".join(v.ljust(w) for v, w in zip(line, widths)).rstrip() for line in [df.columns, *shown]]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def export_archive(engine, path: str) -> None:
    """All tables of the current branch with their manifest in one zip file on the driver's disk: for workspaces of a size to be handed on. Larger ones are pushed."""
    workspace = engine.workspace
    manifest = workspace.manifest()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as pack, tempfile.TemporaryDirectory() as folder:
        pack.writestr("manifest.json", manifest.to_json())
        for p in dict.fromkeys(p for t in manifest.tables.values() for p in t.paths):
            local = os.path.join(folder, p.replace("/", "_"))
            workspace.files.fs.copyToLocalFile(False, workspace.files.path(p), workspace.files._path(f"file://{local}"), True)
            for name in sorted(os.listdir(local)):
                if not name.startswith((".", "_")):
                    pack.write(os.path.join(local, name), f"{p}/{name}")


def import_archive(engine, path: str) -> list[str]:
    """The tables of an archive into the current branch; tables of the same names are replaced."""
    workspace = engine.workspace
    with zipfile.ZipFile(path) as pack, tempfile.TemporaryDirectory() as folder:
        pack.extractall(folder)
        manifest = Manifest.from_json(pack.read("manifest.json").decode())
        for p in dict.fromkeys(p for t in manifest.tables.values() for p in t.paths):
            if not workspace.files.exists(p):
                workspace.files.fs.copyFromLocalFile(False, True, workspace.files._path(f"file://{os.path.join(folder, p)}"), workspace.files.path(p))
    workspace.update(lambda m: m.tables.update(manifest.tables))
    return list(manifest.tables)
