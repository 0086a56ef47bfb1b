"""Runs registered queries against their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return db


def canonical(value):
    if value is None:
        return ("", "null")
    if isinstance(value, float):
        return ("n", "nan" if math.isnan(value) else f"{value:.9g}" if value else "0")
    if isinstance(value, bool) or not isinstance(value, int):
        return ("s", str(value))
    return ("n", f"{value:.9g}" if abs(value) < 10**9 else str(value))


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(canonical(r[k]) for k in order) for r in rows)


def compare(spark, db, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = db.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""


if __name__ == "__main__":
    from conftest import build_session

    import __spark_entry__ as entry

    spark, where = build_session(), sys.argv[1]
    database, bad = connect(where), 0
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            said = compare(spark, database, entry.queries()[name], sql, where)
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(said)
        print(name, said or "ok", flush=True)
    print("differ:", bad)
