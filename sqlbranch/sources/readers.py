"""Files into DataFrames and tables."""

from __future__ import annotations

import os
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that decide on the types of a CSV file's columns.
SAMPLE_ROWS = 100


def clean_names(names: list[str]) -> list[str]:
    """Lower case, with _ for anything but letters and digits; repeated names get numbers."""
    out: list[str] = []
    for k, name in enumerate(names):
        base = re.sub(r"\W", "_", name.strip().lower()) or f"column_{k + 1}"
        base = f"_{base}" if base[0].isdigit() else base
        new, n = base, 2
        while new in out:
            new, n = f"{base}_{n}", n + 1
        out.append(new)
    return out


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True) -> DataFrame:
    """Quoted fields may hold separators and line ends. Types are those of the first SAMPLE_ROWS rows; what doesn't fit later is null."""
    raw = spark.read.csv(path, sep=separator, header=header, multiLine=True, escape='"', enforceSchema=True)
    raw = raw.toDF(*clean_names(raw.columns))
    sample = raw.limit(SAMPLE_ROWS).collect()

    def kind(column: str) -> str:
        values = [r[column] for r in sample if r[column] not in (None, "")]
        if values and all(re.fullmatch(r"\s*[+-]?\d{1,18}\s*", v) for v in values):
            return "bigint"
        if values and all(re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", v) for v in values):
            return "double"
        return "string"

    kinds = {c: kind(c) for c in raw.columns}
    return raw.select(*(F.col(c) if t == "string" else F.trim(c).try_cast(t).alias(c) for c, t in kinds.items()))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of objects, or one object a line: all keys, sorted, as text; nested values as JSON."""
    raw = spark.read.json(path, multiLine=not lines, primitivesAsString=True)
    names = sorted(c for c in raw.columns if c != "_corrupt_record")
    texts = [F.to_json(c) if raw.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(c).cast("string") for c in names]
    return raw.select(*(t.alias(n) for t, n in zip(texts, clean_names(names))))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, lines=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """With its own types, and clean names."""
    raw = spark.read.parquet(path)
    return raw.toDF(*clean_names(raw.columns))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table of another database, in ranges of a column if its bounds are given. The driver has to be on Spark's class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, skip: int = 0, chunk: int = 50_000) -> dict[str, DataFrame]:
    """The tables of a SQLite file, or one of them, without the first `skip` rows. The file is read on the driver, in chunks."""
    out = {}
    with sqlite3.connect(path) as db:
        names = [table] if table else [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for name in names:
            info = list(db.execute(f'PRAGMA table_info("{name}")'))
            kinds = [{"INTEGER": "bigint", "REAL": "double"}.get(_kind(r[2]), "string") for r in info]
            ddl = ", ".join(f"`{n}` {k}" for n, k in zip(clean_names([r[1] for r in info]), kinds))
            rows, df = db.execute(f'SELECT * FROM "{name}" LIMIT -1 OFFSET {int(skip)}'), None
            fit = {"bigint": int, "double": float, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}
            while part := rows.fetchmany(chunk):
                typed = [tuple(None if v is None else _fitted(fit[k], v) for k, v in zip(kinds, r)) for r in part]
                more = spark.createDataFrame(typed, ddl)
                df = more if df is None else df.unionByName(more)
            out[name] = df if df is not None else spark.createDataFrame([], ddl)
    return out


def _kind(declared: str) -> str:
    declared = declared.upper()
    return "INTEGER" if "INT" in declared else "REAL" if any(x in declared for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "TEXT"


def _fitted(function, value):
    try:
        return function(value)
    except (TypeError, ValueError):
        return None


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, with names in its first row, all as text. The file is read on the driver."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ET.fromstring(book.read(min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
    rows: list[dict[int, str]] = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells = {}
        for k, cell in enumerate(row.findall("m:c", ns)):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else k
            value = cell.find("m:v", ns)
            if cell.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{{{ns['m']}}}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        rows.append(cells)
    width = max((max(r) + 1 for r in rows if r), default=0)
    head = clean_names([rows[0].get(k, "") for k in range(width)]) if rows else []
    return spark.createDataFrame([tuple(r.get(k) for k in range(width)) for r in rows[1:]], ", ".join(f"`{n}` string" for n in head) or "empty string")


#: Formats by file extension; anything else is read as CSV.
FORMATS = {"json": read_json, "jsonl": read_jsonl, "ndjson": read_jsonl, "parquet": read_parquet, "xlsx": read_xlsx, "xls": read_xlsx}


def import_file(engine, path: str, table: str | None = None, mode: str = "append", separator: str = ",", header: bool = True) -> list[str]:
    """A file into tables of the current branch; gives their names. mode: append (which creates too), replace, or upsert by the primary key."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extension == "sql":
        with open(path, encoding="utf-8") as f:
            return run_script(engine, f.read())
    if extension in ("sqlite", "sqlite3", "db"):
        frames = read_sqlite(engine.spark, path, table)
    elif extension in ("pack", "zip"):
        from .writers import import_archive

        return import_archive(engine, path)
    else:
        name = table or clean_names([os.path.basename(path.rstrip("/")).rsplit(".", 1)[0]])[0]
        frames = {name: FORMATS[extension](engine.spark, path) if extension in FORMATS else read_csv(engine.spark, path, separator, header)}
    for name, df in frames.items():
        store(engine, name, df, mode)
    return list(frames)


def store(engine, name: str, df: DataFrame, mode: str = "append") -> None:
    if mode != "upsert" or not engine._exists(name):
        engine.save(name, df, mode)
        return
    info = engine.info(name)
    key = info.primary_key or (info.keys() or [[]])[0]
    if not key:
        raise ValueError(f"{name} has no key to upsert by")
    view = f"_import_{name}"
    engine.register(view, df)
    listed = ", ".join(f'"{c}"' for c in df.columns)
    sets = ", ".join(f'"{c}" = excluded."{c}"' for c in df.columns if c not in key)
    action = f"UPDATE SET {sets}" if sets else "NOTHING"
    engine.sql(f'INSERT INTO "{name}" ({listed}) SELECT {listed} FROM {view} ON CONFLICT ({", ".join(key)}) DO {action}')
    del engine.views[view.lower()]


def run_script(engine, text: str) -> list[str]:
    """Statements of a dump, one by one; those that fail are left out. Gives the messages of the failures."""
    from ..sql.lexer import lex

    failed, start = [], 0
    for token in lex(text):
        if token.text == ";" and token.kind == "op" or token.kind == "end":
            statement = text[start : token.at].strip()
            start = token.end
            if statement and not re.match(r"(?i)(pragma|begin|commit|end)\b", statement):
                try:
                    engine.script(statement)
                except Exception as error:  # a dump of another dialect holds statements that have no meaning here
                    failed.append(f"{statement[:60]}: {str(error)[:200]}")
    return failed
