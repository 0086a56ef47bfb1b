"""Queries of what surrounds the tables: imports by format, functions of the user, errors, plans, branches, migrations, tools. Each gives rows that SQL can state."""

from __future__ import annotations

import os
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from .. import tools
from ..catalog import migrations
from ..sources import readers, writers
from .registry import folder, query, table
from .workspaces import engine


def _fails(action) -> bool:
    try:
        action()
    except Exception:
        return True
    return False


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def io_json(spark, sf_dir):
    """An array of objects, written as one file by one task: regions are five."""
    path = folder(spark) + "/regions.json"
    rows = table(spark, sf_dir, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))
    rows.write.text(path)
    e = engine(spark, sf_dir)
    readers.import_file(e, path, "t")
    return e.sql("SELECT r_regionkey, r_name FROM t")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def io_parquet(spark, sf_dir):
    path = folder(spark) + "/orders.parquet"
    table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "o OrderPriority").write.parquet(path)
    e = engine(spark, sf_dir)
    readers.import_file(e, path, "t")
    return e.sql("SELECT o_orderkey, o_custkey, o_orderpriority FROM t")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def io_xlsx(spark, sf_dir):
    """A workbook is a small file, so it is made and read on the driver."""
    rows = [("n_nationkey", "N Name"), *((str(r[0]), r[1]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())]
    cell = lambda c, k, v: f'<c r="{c}{k}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    sheet = "".join(f'<row r="{k}">{cell("A", k, a)}{cell("B", k, b)}</row>' for k, (a, b) in enumerate(rows, 1))
    with tempfile.TemporaryDirectory() as place:
        path = os.path.join(place, "n.xlsx")
        with zipfile.ZipFile(path, "w") as book:
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
        return readers.read_xlsx(spark, path)


@query("SELECT p_partkey, 'P:' || lower(p_name) AS tag, 'again ' || p_name AS other FROM part")
def udf_scalar(spark, sf_dir):
    e = engine(spark, sf_dir, "part")
    e.register_udf("Tag", lambda name: "P:" + name.lower())
    e.register_udf("again", lambda names: "again " + names, pandas=True)
    return e.sql("SELECT p_partkey, tag(p_name) AS tag, AGAIN(p_name) AS other FROM part")


@query("SELECT p_partkey, replace(p_name, ' ', chr(10)) AS lines FROM part")
def udf_from_module(spark, sf_dir):
    """CREATE FUNCTION with a function of a Python module; textwrap.fill puts a line end for each space when lines may hold one word."""
    e = engine(spark, sf_dir, "part")
    e.sql("CREATE FUNCTION one_word_lines FROM python 'sqlbranch.functions.samples:one_word_lines'")
    return e.sql("SELECT p_partkey, one_word_lines(p_name) AS lines FROM part")


@query("SELECT true AS had, false AS has, true AS refused, 0 AS names")
def udf_registry(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    e.register_udf("shout", str.upper)
    had, gone = e.has_udf("SHOUT") and e.udfs() == ["shout"], e.unregister_udf("Shout")
    refused = _fails(lambda: e.sql("SELECT shout(r_name) FROM region").collect())
    return spark.createDataFrame([(had and gone, e.has_udf("shout"), refused, len(e.udfs()))], "had boolean, has boolean, refused boolean, names int")


@query("SELECT 'arity' AS what, true AS refused UNION ALL SELECT 'two columns', true UNION ALL SELECT 'two rows', true UNION ALL SELECT 'ambiguous', true UNION ALL SELECT 'aggregate', true UNION ALL SELECT 'function', true UNION ALL SELECT 'repeatable', true UNION ALL SELECT 'plain', false")
def errors(spark, sf_dir):
    e = engine(spark, sf_dir, "nation", "region")
    strict = engine(spark, sf_dir, "region")
    strict.deterministic = True
    statements = {
        "arity": "SELECT n_name, n_nationkey FROM nation UNION SELECT r_name FROM region", "two columns": "SELECT (SELECT r_name, r_regionkey FROM region)", "two rows": "SELECT (SELECT r_name FROM region)",
        "ambiguous": "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", "aggregate": "SELECT n_name FROM nation WHERE count(*) > 1", "function": "SELECT no_such_function(n_name) FROM nation",
        "plain": "SELECT n_name FROM nation",
    }
    rows = [(what, _fails(lambda sql=sql: e.sql(sql).collect())) for what, sql in statements.items()]
    rows.append(("repeatable", _fails(lambda: strict.sql("SELECT random() FROM region"))))
    return spark.createDataFrame(rows, "what string, refused boolean")


@query("SELECT true AS scans, true AS pushed, 'ignored' AS pragma")
def explain_and_pragma(spark, sf_dir):
    e = engine(spark, sf_dir, "orders")
    lines = e.sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_custkey = 7")
    said = e.sql("PRAGMA foreign_keys = ON").message
    return lines.agg(F.max(F.contains("plan", F.lit("FileScan parquet"))).alias("scans"), F.max(F.contains("plan", F.lit("EqualTo(o_custkey,7)"))).alias("pushed")).withColumn("pragma", F.lit(said))


@query("SELECT false AS there, true AS refused, true AS repeats")
def ddl_drop(spark, sf_dir):
    e = engine(spark, sf_dir, "region", "nation")
    e.sql("DROP TABLE region; DROP TABLE IF EXISTS region; CREATE UNIQUE INDEX by_name ON nation (n_name); DROP INDEX by_name; INSERT INTO nation VALUES (99, 'NATION_1', 1)")
    repeats = e.sql("SELECT count(*) AS n FROM nation WHERE n_name = 'NATION_1'").first()[0] == 2
    return spark.createDataFrame([(e._exists("region"), _fails(lambda: e.sql("DROP TABLE region")), repeats)], "there boolean, refused boolean, repeats boolean")


@query('SELECT r_name AS "Mixed Case", upper(r_name) AS "upper(...)", r_regionkey AS "r.r_regionkey", r_regionkey + 1 AS "?column?" FROM region')
def default_names(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    df = e.sql('SELECT r_name AS "Mixed Case", upper(r_name), /* a comment */ r.r_regionkey, r_regionkey + 1 FROM region r -- the end')
    # DuckDB knows no columns with a dot in its own names, so the third is named in full
    return df.toDF(*("r.r_regionkey" if k == 2 else c for k, c in enumerate(df.columns)))


@query("SELECT 36 AS size, 2 AS ids, true AS same")
def unrepeatable_values(spark, sf_dir):
    """What RETURNING gives is what was stored, also of values that change from call to call."""
    e = engine(spark, sf_dir)
    e.sql("CREATE TABLE t (id text, n integer)")
    one = e.sql("INSERT INTO t VALUES (uuid(), 1), (uuid(), 2) RETURNING id")
    told = {r[0] for r in one.collect()}
    e.sql("UPDATE t SET n = random()")
    kept = e.sql("SELECT id, n FROM t").collect()
    return spark.createDataFrame([(min(map(len, told)), len(told), told == {r[0] for r in kept})], "size int, ids int, same boolean")


@query("SELECT count(*) AS n, 'work' AS branch, 1 AS snapshots, 0 AS after FROM customer")
def branches_listed_and_pulled(spark, sf_dir):
    e, other = engine(spark, sf_dir, "customer"), engine(spark, sf_dir)
    e.workspace.create_branch("work")
    e.workspace.create_snapshot("s")
    other.workspace.pull(e.workspace.files.root, "work")
    rows = other.workspace.table("customer", "work").agg(F.count("*").alias("n"))
    found = [b for b in other.workspace.branches() if b != "main"]
    snapshots = len(e.workspace.snapshots())
    e.workspace.delete_branch("work")
    e.workspace.delete_snapshot("s")
    left = len(e.workspace.branches()) - 1 + len(e.workspace.snapshots())
    return rows.select("n", F.lit(",".join(found)).alias("branch"), F.lit(snapshots).alias("snapshots"), F.lit(left).alias("after"))


@query("SELECT id, state FROM (VALUES ('0001_start', 'applied', 0), ('0002_more', 'applied', 0), ('0003_later', 'pending', 0)) t(id, state, x)")
def migration_status(spark, sf_dir):
    return spark.createDataFrame(migrations.status(_migrated(spark, sf_dir)), "id string, state string")


@query("SELECT r_regionkey AS id, r_name AS label, CAST(4 AS BIGINT) AS extra FROM region")
def migration_apply(spark, sf_dir):
    e = _migrated(spark, sf_dir)
    migrations.apply(e)
    e.register("given", table(spark, sf_dir, "region"))
    e.sql("INSERT INTO t (id, label) SELECT r_regionkey, r_name FROM given")
    return e.sql("SELECT id, label, extra FROM t").select(F.col("id").cast("int"), "label", "extra")


@query("SELECT 0 AS differing, true AS stopped")
def migration_replay(spark, sf_dir):
    e = _migrated(spark, sf_dir)
    differing = len(migrations.replay(e))
    e.workspace.files.write("migrations/0001_start.sql", "CREATE TABLE t (id integer, note text);", replace=True)
    return spark.createDataFrame([(differing, _fails(lambda: migrations.apply(e)))], "differing int, stopped boolean")


def _migrated(spark, sf_dir):
    """A workspace with two applied migrations and a planned one."""
    e, other = engine(spark, sf_dir), engine(spark, sf_dir)
    e.workspace.files.write("migrations/0001_start.sql", "CREATE TABLE t (id integer PRIMARY KEY, note text);")
    e.workspace.files.write("migrations/0002_more.sql", "ALTER TABLE t ADD COLUMN extra integer DEFAULT 4;")
    migrations.apply(e)
    other.workspace.update(lambda m: m.tables.update(e.workspace.manifest().copy().tables))
    other.sql("ALTER TABLE t RENAME COLUMN note TO label")
    migrations.plan(e, "later", other.workspace.manifest())
    return e


@query("SELECT code FROM (VALUES ('L001'), ('L002'), ('L003'), ('L004'), ('L005'), ('L006')) t(code)")
def lint_codes(spark, sf_dir):
    found = tools.lint('CREATE TABLE aB (x integer, "order" text UNIQUE); SELECT * FROM aB')
    return spark.createDataFrame([(c,) for c in sorted({code for code, _ in found})], "code string")


@query("SELECT 1 AS healthy_problems, 0 AS unchanged_problems, 2 AS seeded, 0 AS failures, 1 AS wrong")
def tools_report(spark, sf_dir):
    e = engine(spark, sf_dir, "region")
    expected = e.workspace.manifest().copy()
    unchanged = len(tools.doctor(e, expected))
    with tempfile.TemporaryDirectory() as place:
        os.mkdir(os.path.join(place, "dev"))
        for name, sql in (("1.sql", "CREATE TABLE t (x integer); INSERT INTO t VALUES (1)"), ("dev/2.sql", "INSERT INTO t VALUES (2)")):
            with open(os.path.join(place, name), "w") as f:
                f.write(sql)
        seeded = len(tools.seed(e, place, "dev"))
    right = tools.run_logic_test(e, "query I\nSELECT sum(x) FROM t\n----\n3\n\nstatement error\nSELECT nothing FROM nowhere")
    wrong = tools.run_logic_test(e, "query I\nSELECT sum(x) FROM t\n----\n4")
    problems = len(tools.doctor(e, expected))
    return spark.createDataFrame([(problems, unchanged, seeded, len(right), len(wrong))], "healthy_problems int, unchanged_problems int, seeded int, failures int, wrong int")


@query("SELECT 'json' AS form, 5 AS lines UNION ALL SELECT 'csv', 6 UNION ALL SELECT 'tsv', 6 UNION ALL SELECT 'table', 7")
def result_formats(spark, sf_dir):
    import json

    region = table(spark, sf_dir, "region")
    sizes = [("json", len(json.loads(writers.render(region, "json"))))] + [(form, len(writers.render(region, form).strip().split("\n"))) for form in ("csv", "tsv", "table")]
    return spark.createDataFrame(sizes, "form string, lines int")


@query("SELECT 'by_region' AS name, 'region' AS params, 'n_name:text,n:integer' AS columns")
def typed_queries(spark, sf_dir):
    e = engine(spark, sf_dir, "nation")
    found = tools.named_queries(e, "-- name: by_region\nSELECT n_name, count(*) AS n FROM nation WHERE n_regionkey = :region GROUP BY n_name")
    return spark.createDataFrame([(q.name, ",".join(q.params), ",".join(f"{n}:{k}" for n, k in q.columns)) for q in found], "name string, params string, columns string")
