"""Queries that write: statements over a workspace of their own, then the table that they leave."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..catalog.branching import branch_diff, merge_branches, migration
from ..engine import Engine
from ..sources import readers, writers
from .registry import folder, query, table


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """A new workspace in shared storage with copies of some tables."""
    out = Engine(spark, folder(spark))
    for name in tables:
        out.save(name, table(spark, sf_dir, name))
    return out


@query("SELECT * FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 100, 'NEW', 4")
def dml_insert(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (n_nationkey int, n_name text, n_regionkey int); INSERT INTO t SELECT * FROM nation WHERE n_regionkey < 2; INSERT INTO t VALUES (100, 'NEW', 4)")
    return e.sql("SELECT * FROM t").select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("SELECT CAST(k AS BIGINT) AS id, 'row ' || k AS name, CAST(7 AS DOUBLE) AS score FROM range(1, 4) t(k)")
def dml_defaults(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE t (id integer PRIMARY KEY AUTOINCREMENT, name text NOT NULL, score real DEFAULT 3.5 * 2); INSERT INTO t (name) VALUES ('row 1'), ('row 2'); INSERT INTO t (name) VALUES ('row 3')")
    return e.sql("SELECT * FROM t")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 4) THEN 'up ' || n_name || n_nationkey ELSE n_name END AS n_name FROM nation UNION ALL SELECT 50, 'fresh'")
def dml_upsert(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (n_nationkey int PRIMARY KEY, n_name text); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    e.sql("INSERT INTO t VALUES (3, 'up '), (4, 'up '), (50, 'fresh') ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name || t.n_name || excluded.n_nationkey")
    return e.sql("SELECT * FROM t").select(F.col("n_nationkey").cast("int"), "n_name")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 60, 'first'")
def dml_do_nothing(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (n_nationkey int PRIMARY KEY, n_name text); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    e.sql("INSERT INTO t VALUES (3, 'x'), (60, 'first'), (60, 'second') ON CONFLICT DO NOTHING; INSERT OR IGNORE INTO t VALUES (5, 'y')")
    return e.sql("SELECT * FROM t").select(F.col("n_nationkey").cast("int"), "n_name")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'replaced' ELSE n_name END AS n_name FROM nation")
def dml_replace(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (n_nationkey int PRIMARY KEY, n_name text); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT OR REPLACE INTO t VALUES (2, 'replaced')")
    return e.sql("SELECT * FROM t").select(F.col("n_nationkey").cast("int"), "n_name")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark, sf_dir):
    e = engine(spark, sf_dir, "customer", "nation")
    e.sql("UPDATE customer SET c_acctbal = c_acctbal + 10 WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
    return e.sql("SELECT c_custkey, c_acctbal FROM customer")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000))")
def dml_delete(spark, sf_dir):
    e = engine(spark, sf_dir, "customer", "orders")
    e.sql("DELETE FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
    return e.sql("SELECT c_custkey FROM customer")


@query("SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer WHERE c_custkey < 5")
def dml_returning(spark, sf_dir):
    return engine(spark, sf_dir, "customer").sql("UPDATE customer SET c_acctbal = c_acctbal * 2 WHERE c_custkey < 5 RETURNING c_custkey, c_acctbal AS doubled")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ddl_create_as(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE per_region AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return e.sql("SELECT * FROM per_region")


@query("SELECT r_regionkey AS id, CAST(9 AS BIGINT) AS extra, CAST(NULL AS VARCHAR) AS note FROM region")
def ddl_alter(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    e.sql("ALTER TABLE region ADD COLUMN extra integer DEFAULT 9; ALTER TABLE region DROP COLUMN r_name; ALTER TABLE region RENAME COLUMN r_regionkey TO id; ALTER TABLE region RENAME TO areas; ALTER TABLE areas ADD note text")
    return e.sql("SELECT id, extra, note FROM areas")


@query("SELECT 'kept' AS what, count(*) AS n FROM nation UNION ALL SELECT 'committed', count(*) - 5 FROM nation")
def transactions(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("BEGIN; DELETE FROM nation; ROLLBACK")
    first = e.sql("SELECT 'kept' AS what, count(*) AS n FROM nation")
    e.sql("BEGIN; DELETE FROM nation WHERE n_nationkey < 5; COMMIT")
    return first.unionByName(e.sql("SELECT 'committed' AS what, count(*) AS n FROM nation"))


@query("SELECT true AS refused, count(*) AS n FROM nation")
def unique_index(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE UNIQUE INDEX by_name ON nation (n_name)")
    try:
        e.sql("INSERT INTO nation VALUES (99, 'NATION_3', 1)")
        refused = False
    except RuntimeError:
        refused = True
    return e.sql("SELECT count(*) AS n FROM nation").select(F.lit(refused).alias("refused"), "n")


@query("SELECT 'main' AS branch, count(*) AS n FROM customer UNION ALL SELECT 'work', count(*) FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'snapshot/s1', count(*) FROM customer")
def branches(spark, sf_dir):
    e = engine(spark, sf_dir, "customer")
    e.workspace.create_snapshot("s1")
    e.workspace.create_branch("work")
    e.workspace.switch("work")
    e.sql("DELETE FROM customer WHERE c_acctbal < 0")
    e.workspace.checkout_snapshot("s1")
    counts = [e.workspace.table("customer", b).agg(F.count("*").alias("n")).select(F.lit(b).alias("branch"), "n") for b in ("main", "work", "snapshot/s1")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _forked(spark, sf_dir) -> Engine:
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (k int PRIMARY KEY, name text); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    e.workspace.create_branch("work")
    e.workspace.switch("work")
    e.sql("UPDATE t SET name = 'work' WHERE k < 5; INSERT INTO t VALUES (40, 'added')")
    e.workspace.switch("main")
    e.sql("DELETE FROM t WHERE k = 20; UPDATE t SET name = 'main' WHERE k = 10")
    return e


@query("SELECT CAST(k AS BIGINT) AS k, op FROM (VALUES (0, 'update'), (1, 'update'), (2, 'update'), (3, 'update'), (4, 'update'), (40, 'insert'), (20, 'insert'), (10, 'update')) t(k, op)")
def branch_differences(spark, sf_dir):
    return branch_diff(_forked(spark, sf_dir).workspace, "main", "work")["t"].select("k", "op")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 5 THEN 'work' WHEN n_nationkey = 10 THEN 'main' ELSE n_name END AS name FROM nation WHERE n_nationkey != 20 UNION ALL SELECT 40, 'added'")
def branch_merge(spark, sf_dir):
    e = _forked(spark, sf_dir)
    merge_branches(e.workspace, "work", "main")
    return e.sql("SELECT * FROM t")


@query("SELECT count(*) AS n FROM nation")
def remote_push(spark, sf_dir):
    e, other = engine(spark, sf_dir, "nation"), engine(spark, sf_dir)
    e.workspace.create_branch("shared")
    e.workspace.push(other.workspace.files.root, "shared")
    return other.workspace.table("nation", "shared").agg(F.count("*").alias("n"))


@query("SELECT statement FROM (VALUES ('ALTER TABLE nation ADD COLUMN note text'), ('ALTER TABLE nation DROP COLUMN n_regionkey')) t(statement)")
def migration_plan(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    old = e.workspace.manifest()
    e.sql("ALTER TABLE nation ADD COLUMN note text; ALTER TABLE nation DROP COLUMN n_regionkey")
    return spark.createDataFrame([(s,) for s in migration(old, e.workspace.manifest())], "statement string")


# files; each round trip writes a table where the driver and executors can read it

@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || ', \"q\"' AS n_name, n_regionkey + 0.5::DOUBLE AS half FROM nation")
def io_csv(spark, sf_dir):
    path = folder(spark) + "/nation.csv"
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "q"')).alias("N Name"), (F.col("n_regionkey") + F.lit(0.5)).alias("half"))
    writers.write_csv(nation, path)
    e = engine(spark, sf_dir)
    readers.import_file(e, path, "t")
    return e.sql("SELECT * FROM t")


@query("SELECT r_name, CAST(r_regionkey AS VARCHAR) AS r_regionkey FROM region")
def io_jsonl(spark, sf_dir):
    path = folder(spark) + "/region.jsonl"
    writers.write_json(table(spark, sf_dir, "region"), path)
    return readers.read_jsonl(spark, path)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part")
def io_parquet_modes(spark, sf_dir):
    part, e = table(spark, sf_dir, "part").select("p_partkey", "p_name"), engine(spark, sf_dir)
    even, odd = part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1")
    readers.store(e, "t", odd, "append")
    readers.store(e, "t", even, "replace")
    e.sql("CREATE TABLE u (p_partkey bigint PRIMARY KEY, p_name text); INSERT INTO u SELECT * FROM t")
    readers.store(e, "u", odd, "append")
    readers.store(e, "u", even.withColumn("p_name", F.upper("p_name")), "upsert")
    return e.sql("SELECT * FROM u")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def io_sqlite(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "t.sqlite")
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT)")
            db.executemany("INSERT INTO nation VALUES (?, ?)", rows)
        return readers.read_sqlite(spark, path)["nation"]


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
def io_sql_dump(spark, sf_dir):
    rows = table(spark, sf_dir, "region").collect()
    dump = "PRAGMA foreign_keys=OFF;\nBEGIN TRANSACTION;\nCREATE TABLE t (id INTEGER, name TEXT);\n" + "\n".join(f"INSERT INTO t VALUES ({r[0]}, {json.dumps(r[1]).replace(chr(34), chr(39))});" for r in rows) + "\nCREATE TRIGGER x;\nCOMMIT;"
    e = engine(spark, sf_dir)
    readers.run_script(e, dump)
    return e.sql("SELECT * FROM t")


@query("SELECT * FROM region")
def io_archive(spark, sf_dir):
    e, other = engine(spark, sf_dir, "region"), engine(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        writers.export_archive(e, os.path.join(folder, "a.pack"))
        readers.import_file(other, os.path.join(folder, "a.pack"))
    return other.sql("SELECT * FROM region")

