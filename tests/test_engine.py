"""The dialect, the versioned tables and the tools around them, on small cases."""

import json
import zipfile

import pytest

from sqlbranch import tools
from sqlbranch.catalog.branching import branch_diff, merge_branches, migration, schema_diff
from sqlbranch.catalog.workspace import ConflictError, Workspace
from sqlbranch.engine import Engine
from sqlbranch.sources import readers, writers
from sqlbranch.sql.lexer import SqlError
from sqlbranch.sql.parser import parse


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "workspace"))


def rows(engine, sql, **params):
    return [tuple(r) for r in engine.sql(sql, params).collect()]


LOGIC = """
statement ok
CREATE TABLE t1 (id INTEGER, name TEXT, val INTEGER)

statement ok
INSERT INTO t1 VALUES (1, 'a', 10), (2, 'b', NULL), (3, 'c', 30)

query III
SELECT 1 + 2, 7 / 2, 7 % 0
----
3 3 NULL

# nulls are lowest
query T
SELECT name FROM t1 ORDER BY val
----
b a c

query IRI
SELECT count(val), avg(val), sum(val) FROM t1
----
2 20 40

query TT
SELECT a.name, b.name FROM t1 a LEFT JOIN t1 b ON a.id = b.id - 1 ORDER BY a.id
----
a b b c c NULL

query I
SELECT id FROM t1 WHERE val IN (10, NULL) OR name LIKE 'C' ORDER BY id DESC LIMIT 2
----
3 1

statement error
SELECT nothing FROM t1

statement error
SELECT unknown_function(id) FROM t1

statement error
SELECT id FROM t1 WHERE count(*) > 1

statement error
INSERT INTO t1 VALUES (1)

statement ok
UPDATE t1 SET val = val + 1, name = upper(name) WHERE id = 1; DELETE FROM t1 WHERE val IS NULL

query IT
SELECT val, name FROM t1 ORDER BY id
----
11 A 30 c
"""


def test_logic(engine):
    assert tools.run_logic_test(engine, LOGIC) == []
    assert tools.run_logic_test(engine, "query I\nSELECT 1\n----\n2") and tools.run_logic_test(engine, "statement error\nSELECT 1")


@pytest.mark.parametrize(
    "sql, wanted",
    [
        ("date('2024-01-31', '+1 month')", "2024-02-29"), ("date('2024-02-29', '+1 year')", "2025-02-28"), ("date('2024-03-31', '-1 months')", "2024-02-29"), ("datetime('2024-01-01 23:59:59', '+1 second')", "2024-01-02 00:00:00"),
        ("strftime('%s', '1970-01-01 00:01:00')", "60"), ("strftime('%q%Y', '2024-01-01')", "%q2024"), ("date('2024-13-01')", None), ("date(NULL)", None), ("time('2024-01-01T10:20:30.999')", "10:20:30"), ("julianday('1970-01-01')", 2440587.5),
        ("date('2024-05-05', 'rubbish')", None), ("datetime(0)", "1970-01-01 00:00:00"), ("substr('héllo', 2, 3)", "éll"), ("substr('abc', 10)", ""), ("trim('  x\t')", "x"), ("'a' || NULL", None), ("length('日本')", 2), ("length(12)", None),
        ("replace('aaa', 'a', '$1\\')", "$1\\$1\\$1\\"), ("replace('ab', '', '\\')", "\\a\\b\\"), ("instr('hello', 'l')", 3), ("instr('x', 'y')", 0), ("round(2.5)", 3.0), ("round(-2.5)", -3.0), ("round(1.005, 2)", 1.0), ("abs(-3)", 3),
        ("CAST('12abc' AS INTEGER)", None), ("CAST(' 7 ' AS INTEGER)", 7), ("CAST(3.99 AS INTEGER)", 3), ("CAST('t' AS BOOLEAN)", True), ("CAST(1 AS TEXT)", "1"), ("'10'::integer", 10), ("1 = '1'", True), ("2 > '1.5'", True), ("NULL = NULL", None),
        ("NOT NULL", None), ("NULL OR TRUE", True), ("1 AND 0", False), ("'a_b' LIKE 'A\\_B'", False), ("'É' LIKE 'é'", False), ("'abc' LIKE 'A%C'", True), ("'a' NOT LIKE 'b%'", True), ("3 BETWEEN 1 AND 3", True), ("1 NOT IN (2, NULL)", None),
        ("9223372036854775807 + 1", None), ("-7 / 2", -3), ("-7 % 3", -1), ("5.0 / 0", None), ("coalesce(NULL, 2, 3)", 2), ("nullif(1, 1)", None), ("min(3, 1)", 1), ("max(1, NULL)", None), ("quote('it''s')", "'it''s'"), ("quote(NULL)", "NULL"), ("hex('é')", "C3A9"),
        ("typeof(NULL)", "null"), ("typeof(2)", "integer"), ("typeof('x')", "text"), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("vector_distance('[0,0]', '[3,4]')", 5.0), ("vector_distance([0, 0], [1, 1], 'cosine')", 1.0), ("vector_dims('nope')", None), ("vector_norm([3, 4])", 5.0),
    ],
)
def test_scalar(engine, sql, wanted):
    got = rows(engine, f"SELECT {sql} AS x")[0][0]
    assert got == wanted and type(got) is type(wanted)


def test_parser_shapes():
    assert len(parse("SELECT 1; ; SELECT 2 SELECT 3")) == 3 and parse("-- only a comment\n/* and */") == []
    chain = parse("SELECT 1 EXCEPT SELECT 1 UNION SELECT 1 INTERSECT SELECT 2")[0]
    assert (chain.op, chain.left.op, chain.right.op) == ("UNION", "EXCEPT", "INTERSECT")
    for bad in ("SELECT", "SELECT 1 FROM", "FOO", "INSERT INTO t", "SELECT 'open", "CREATE TABLE t", "SELECT (1", "SELECT a b c"):
        with pytest.raises(SqlError):
            parse(bad)


def test_constraints(engine):
    engine.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, mail TEXT UNIQUE, n INTEGER DEFAULT 4, CHECK (n > 0))")
    engine.sql("INSERT INTO t (name, mail) VALUES ('a', 'x'), ('b', NULL), ('c', NULL)")
    assert rows(engine, "SELECT id, n FROM t ORDER BY id") == [(1, 4), (2, 4), (3, 4)]
    for bad in ("INSERT INTO t (name, mail) VALUES ('d', 'x')", "INSERT INTO t (name) VALUES (NULL)", "INSERT INTO t (id, name) VALUES (2, 'q')", "UPDATE t SET mail = 'y'", "UPDATE t SET name = NULL WHERE id = 1", "INSERT INTO t (name, mail) VALUES ('d', 'z'), ('e', 'z')"):
        with pytest.raises(ConflictError):
            engine.sql(bad)
    assert rows(engine, "SELECT count(*) AS n FROM t") == [(3,)]
    engine.sql("INSERT INTO t (id, name) VALUES (10, 'k'); INSERT INTO t (name) VALUES ('l')")
    assert rows(engine, "SELECT max(id) AS m FROM t") == [(11,)]


def test_upsert_within_one_batch(engine):
    engine.sql("CREATE TABLE kv (k TEXT PRIMARY KEY, v INTEGER); INSERT INTO kv VALUES ('a', 1)")
    engine.sql("INSERT INTO kv VALUES ('a', 5), ('b', 2), ('a', 7), ('b', 3) ON CONFLICT (k) DO UPDATE SET v = kv.v + excluded.v WHERE excluded.v != 5")
    assert rows(engine, "SELECT * FROM kv ORDER BY k") == [("a", 8), ("b", 5)]
    assert [tuple(r) for r in engine.sql("DELETE FROM kv WHERE v > 5 RETURNING k").collect()] == [("a",)]


def test_transactions_and_lost_races(spark, engine):
    engine.sql("CREATE TABLE t (a INTEGER); INSERT INTO t VALUES (1)")
    engine.sql("BEGIN; INSERT INTO t VALUES (2)")
    other = Engine(spark, engine.workspace.files.root)
    assert rows(other, "SELECT count(*) AS n FROM t") == [(1,)] and rows(engine, "SELECT count(*) AS n FROM t") == [(2,)]
    other.sql("INSERT INTO t VALUES (3)")
    with pytest.raises(ConflictError):
        engine.sql("COMMIT")
    assert rows(engine, "SELECT a FROM t ORDER BY a") == [(1,), (3,)]
    for bad in ("COMMIT", "ROLLBACK"):
        with pytest.raises(RuntimeError):
            engine.sql(bad)


def test_branches_merge_and_push(spark, engine, tmp_path):
    w = engine.workspace
    engine.sql("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); CREATE TABLE bag (x INTEGER); INSERT INTO bag VALUES (1), (1)")
    w.create_branch("dev/one")
    w.switch("dev/one")
    engine.sql("UPDATE t SET v = 'dev' WHERE k = 1; INSERT INTO bag VALUES (2); CREATE TABLE fresh (y TEXT)")
    w.switch("main")
    engine.sql("UPDATE t SET v = 'main' WHERE k = 2; DELETE FROM bag WHERE x = 1; INSERT INTO bag VALUES (1)")
    found = branch_diff(w, "main", "dev/one")
    assert found["fresh"] == "added" and {(r.k, r.op, tuple(r.changed)) for r in found["t"].collect()} == {(1, "update", ("v",)), (2, "update", ("v",))}
    assert merge_branches(w, "dev/one", "main", dry=True).changes == {"bag": "rows merged", "fresh": "taken", "t": "rows merged"}
    merge_branches(w, "dev/one", "main")
    assert rows(engine, "SELECT v FROM t ORDER BY k") == [("dev",), ("main",), ("c",)] and rows(engine, "SELECT x FROM bag ORDER BY x") == [(1,), (2,)]
    w.switch("dev/one")
    engine.sql("UPDATE t SET v = 'theirs' WHERE k = 3")
    w.switch("main")
    engine.sql("UPDATE t SET v = 'ours' WHERE k = 3")
    preview = merge_branches(w, "dev/one", "main")
    assert [r.k for r in preview.conflicts["t"].collect()] == [3] and rows(engine, "SELECT v FROM t WHERE k = 3") == [("ours",)]
    merge_branches(w, "dev/one", "main", prefer="theirs")
    assert rows(engine, "SELECT v FROM t WHERE k = 3") == [("theirs",)]
    Workspace(spark, str(tmp_path / "remote"))
    w.create_branch("out")
    w.push(str(tmp_path / "remote"), "out")
    assert Workspace(spark, str(tmp_path / "remote")).table("t", "out").count() == 3
    w.delete_branch("dev/one")
    with pytest.raises(ValueError):
        w.create_branch("../bad")
    with pytest.raises(KeyError):
        w.switch("dev/one")


def test_migration(engine):
    old = engine.workspace.manifest()
    engine.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT, b REAL)")
    middle = engine.workspace.manifest()
    engine.sql("ALTER TABLE t RENAME COLUMN a TO c; ALTER TABLE t DROP COLUMN b; ALTER TABLE t RENAME TO u")
    new = engine.workspace.manifest()
    assert schema_diff(middle, new) == [("drop column", "u", "b"), ("rename column", "u", "a c"), ("rename table", "t", "u")]
    assert migration(old, middle) == ["CREATE TABLE t (id INTEGER, a TEXT, b REAL, PRIMARY KEY (id))"] and migration(new, new) == []
    assert middle.fingerprint() != new.fingerprint()


def test_functions_of_the_user_and_determinism(spark, engine):
    engine.register_udf("Shout", lambda s: s.upper() + "!")
    assert rows(engine, "SELECT shout('a') AS x") == [("A!",)]
    engine.sql("CREATE FUNCTION base FROM PYTHON 'os.path:basename'")
    assert rows(engine, "SELECT base('/x/y') AS x") == [("y",)]
    strict = Engine(spark, engine.workspace.files.root, deterministic=True)
    for bad in ("SELECT random()", "SELECT date('now')", "SELECT 1 WHERE 1 IN (SELECT random())"):
        with pytest.raises(SqlError):
            strict.sql(bad)
    assert "Range" in engine.explain("SELECT 1 AS x") or engine.explain("SELECT 1 AS x")


def test_plans(spark, engine, sf):
    engine.register("lineitem", spark.read.parquet(f"{sf}/lineitem.parquet"))
    plan = engine.explain("SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 40 AND l_shipdate < '1999-01-01'::timestamp GROUP BY l_returnflag")
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_shipdate), GreaterThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan and plan.count("partial_") >= 1
    top = engine.explain("SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice DESC LIMIT 3")
    assert "TakeOrderedAndProject" in top
    semi = engine.explain("SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
    assert "LeftSemi" in semi and "CartesianProduct" not in semi


def test_files(spark, engine, tmp_path):
    (tmp_path / "In Put.csv").write_text('Id,Full Name,Full Name,9x\n1,"a, ""b""\nc",x,1.5\n2,d,,2\n')
    readers.import_file(engine, str(tmp_path / "In Put.csv"))
    assert rows(engine, "SELECT * FROM in_put ORDER BY id") == [(1, 'a, "b"\nc', "x", 1.5), (2, "d", None, 2.0)]
    (tmp_path / "a.json").write_text(json.dumps([{"b": 1, "a": {"x": [1]}}, {"c": None, "b": "t"}]))
    assert {tuple(r) for r in readers.read_json(spark, str(tmp_path / "a.json")).select("a", "b").collect()} == {('{"x":["1"]}', "1"), (None, "t")}
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>N</t></si><si><t>é</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>4</v></c></row><row><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_xlsx(spark, str(tmp_path / "s.xlsx")).collect()] == [("é", "4"), (None, "5")]
    engine.sql("CREATE TABLE kv (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO kv VALUES (1, 'old'), (2, 'kept')")
    (tmp_path / "kv.csv").write_text("k,v\n1,new\n3,more\n")
    readers.import_file(engine, str(tmp_path / "kv.csv"), mode="upsert")
    assert rows(engine, "SELECT * FROM kv ORDER BY k") == [(1, "new"), (2, "kept"), (3, "more")]
    assert writers.render(engine.sql("SELECT 1 AS a, NULL AS b")) == "a | b\n--+-----\n1 | NULL" and json.loads(writers.render(engine.sql("SELECT 'x' AS a"), "json")) == [{"a": "x"}]
    assert readers.clean_names(["A b", "a-b", "", "1"]) == ["a_b", "a_b_2", "column_3", "_1"]


def test_tools(spark, engine, tmp_path):
    assert {c for c, _ in tools.lint("CREATE TABLE Tbl (a TEXT, \"select\" TEXT, UNIQUE (a)); SELECT * FROM x")} == {"L001", "L002", "L003", "L004", "L005", "L006"}
    engine.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, a TEXT); INSERT INTO t VALUES (1, 'x')")
    assert tools.doctor(engine, engine.workspace.manifest()) == []
    info = engine.info("t")
    engine.workspace.files.delete(info.paths[0])
    assert len(tools.doctor(engine)) == 1
    (tmp_path / "seeds" / "dev").mkdir(parents=True)
    (tmp_path / "seeds" / "1.sql").write_text("CREATE TABLE s (x INTEGER)")
    (tmp_path / "seeds" / "dev" / "2.sql").write_text("INSERT INTO s VALUES (1)")
    assert tools.seed(engine, str(tmp_path / "seeds"), "dev") == ["1.sql", "2.sql"] and rows(engine, "SELECT x FROM s") == [(1,)]
    queries = tools.named_queries(engine, "-- name: one\nSELECT count(*) AS n, sum(x) AS total FROM s WHERE x > :low\n-- name: two\nSELECT x FROM s")
    assert [(q.name, q.params, q.columns) for q in queries] == [("one", ["low"], [("n", "integer"), ("total", "integer")]), ("two", [], [("x", "integer")])]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "bad.sql").write_text("-- EXPECT ERROR\nSELECT * FROM missing")
    assert tools.run_sql_tests(lambda: engine, str(tmp_path / "t")) == {"bad.sql": ""}


def test_stream(spark, sf, tmp_path):
    from sqlbranch.streaming.events import read_stream, windowed_counts

    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "events"))
    counted = windowed_counts(read_stream(spark, str(tmp_path / "events")))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


@pytest.mark.parametrize("statement", ["INSERT INTO t VALUES (2, 'x')", "INSERT OR REPLACE INTO t VALUES (1, 'x')", "INSERT INTO t VALUES (1, 'x') ON CONFLICT (k) DO UPDATE SET name = excluded.name", "INSERT OR IGNORE INTO t VALUES (2, 'x')", "UPDATE t SET name = 'x'", "DELETE FROM t WHERE k = 1"])
def test_no_commit_is_lost(spark, tmp_path, monkeypatch, statement):
    """Another writer commits between a statement's reading and its publishing."""
    one, other = Engine(spark, str(tmp_path / "w")), Engine(spark, str(tmp_path / "w"))
    one.sql("CREATE TABLE t (k integer PRIMARY KEY, name text); INSERT INTO t VALUES (1, 'a')")
    update = Workspace.update

    def late(self, change, rebase=False):
        if self is one.workspace:
            monkeypatch.setattr(Workspace, "update", update)
            other.sql("INSERT INTO t VALUES (3, 'c')")
        return update(self, change, rebase)

    monkeypatch.setattr(Workspace, "update", late)
    with pytest.raises(ConflictError):
        one.sql(statement)
    assert sorted(tuple(r) for r in one.sql("SELECT * FROM t").collect()) == [(1, "a"), (3, "c")]


def test_appends_without_keys_follow_other_writers(spark, tmp_path, monkeypatch):
    one, other = Engine(spark, str(tmp_path / "w")), Engine(spark, str(tmp_path / "w"))
    one.sql("CREATE TABLE t (k integer, name text)")
    update = Workspace.update

    def late(self, change, rebase=False):
        if self is one.workspace:
            monkeypatch.setattr(Workspace, "update", update)
            other.sql("INSERT INTO t VALUES (3, 'c')")
        return update(self, change, rebase)

    monkeypatch.setattr(Workspace, "update", late)
    one.sql("INSERT INTO t VALUES (1, 'a')")
    assert sorted(r[0] for r in one.sql("SELECT k FROM t").collect()) == [1, 3]
    monkeypatch.setattr(Workspace, "update", late)
    other.sql("ALTER TABLE t ADD COLUMN more text")
    monkeypatch.setattr(Workspace, "update", update)
    assert one.sql("SELECT count(*) AS n FROM t").first()[0] == 2


def test_merge_fails_if_its_target_moves(spark, tmp_path, monkeypatch):
    from sqlbranch.catalog import branching

    one, other = Engine(spark, str(tmp_path / "w")), Engine(spark, str(tmp_path / "w"))
    one.sql("CREATE TABLE t (k integer PRIMARY KEY, name text); INSERT INTO t VALUES (1, 'a')")
    one.workspace.create_branch("work")
    one.workspace.switch("work")
    one.sql("INSERT INTO t VALUES (2, 'b')")
    one.workspace.switch("main")
    one.sql("UPDATE t SET name = 'z'")
    merge = branching.three_way_merge

    def late(*args):
        other.sql("INSERT INTO t VALUES (9, 'q')")
        return merge(*args)

    monkeypatch.setattr(branching, "three_way_merge", late)
    with pytest.raises(ConflictError):
        branching.merge_branches(one.workspace, "work", "main")
    monkeypatch.setattr(branching, "three_way_merge", merge)
    branching.merge_branches(one.workspace, "work", "main")
    assert sorted(tuple(r) for r in one.sql("SELECT * FROM t").collect()) == [(1, "z"), (2, "b"), (9, "q")]


def test_upserts_of_odd_names_and_repetitions(engine):
    engine.sql("CREATE TABLE t (t integer PRIMARY KEY, excluded text, n integer); INSERT INTO t VALUES (1, 'a', 0)")
    engine.sql("INSERT INTO t VALUES (1, 'b', 5), (2, 'c', 6) ON CONFLICT (t) DO UPDATE SET excluded = t.excluded || excluded.excluded, n = excluded.n WHERE t.n < 1")
    assert sorted(tuple(r) for r in engine.sql("SELECT * FROM t").collect()) == [(1, "ab", 5), (2, "c", 6)]
    many = ", ".join(f"({1 + k % 2}, 'v{k}', {k})" for k in range(80))
    engine.sql(f"INSERT INTO t VALUES {many} ON CONFLICT (t) DO UPDATE SET excluded = excluded.excluded WHERE excluded.n < 70")
    assert sorted(tuple(r) for r in engine.sql("SELECT * FROM t").collect()) == [(1, "v68", 5), (2, "v69", 6)]
    engine.sql(f"INSERT INTO t VALUES {many.replace('(1, ', '(7, ')} ON CONFLICT (t) DO UPDATE SET n = excluded.n")
    assert tuple(engine.sql("SELECT excluded, n FROM t WHERE t = 7").first()) == ("v0", 78)
    with pytest.raises(ConflictError):
        engine.sql(f"INSERT INTO t VALUES {many} ON CONFLICT (t) DO UPDATE SET n = t.n + 1")
    engine.sql("INSERT INTO t VALUES (3, 'x', 1), (3, 'y', 2), (3, 'z', 3) ON CONFLICT (t) DO UPDATE SET n = t.n + excluded.n")
    assert tuple(engine.sql("SELECT excluded, n FROM t WHERE t = 3").first()) == ("x", 6)


def test_push_takes_up_where_it_broke_off(spark, engine, tmp_path):
    engine.sql("CREATE TABLE t (k integer); INSERT INTO t VALUES (1), (2); INSERT INTO t VALUES (3)")
    path = engine.info("t").paths[0]
    spark.range(1).write.parquet(f"{tmp_path}/other/{path}")
    (tmp_path / "other" / path / "_SUCCESS").unlink()
    engine.workspace.push(str(tmp_path / "other"))
    assert sorted(r[0] for r in Engine(spark, str(tmp_path / "other")).sql("SELECT k FROM t").collect()) == [1, 2, 3]
