"""The engine: statements of the dialect over a workspace."""

from __future__ import annotations

import importlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog.manifest import ColumnInfo, Manifest, TableInfo
from .catalog.workspace import ConflictError, Workspace
from .sql.ast import Item, Node, Select, SetOp, Source, With
from .sql.compile import UNREPEATABLE, Columns, Compiler, Scope, quoted
from .sql.lexer import SqlError
from .sql.parser import parse
from .types import kind_of, spark_type


#: How often a key may come in one upsert whose assignments look at the old row.
MAX_REPEATS = 32


@dataclass
class Status:
    """What a statement without rows has done."""

    message: str


class Engine:
    """sql() runs a text's statements. A query gives a lazy DataFrame; anything else takes effect at once, in the current branch."""

    def __init__(self, spark: SparkSession, root: str, branch: str = "main", deterministic: bool = False):
        self.spark, self.workspace, self.deterministic = spark, Workspace(spark, root, branch), deterministic
        self.views: dict[str, DataFrame] = {}
        self._udfs: set[str] = set()

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame that queries may use like a table; a table of that name hides it."""
        self.views[name.lower()] = df

    def register_udf(self, name: str, function, pandas: bool = False) -> None:
        """A function over texts that gives a text, called row by row over Arrow batches; with pandas, over Series of texts. A function of the same name is replaced; case doesn't count."""
        returned = F.pandas_udf(function, "string") if pandas else F.udf(function, "string", useArrow=True)
        self.spark.udf.register(name.lower(), returned)
        self._udfs.add(name.lower())

    def unregister_udf(self, name: str) -> bool:
        """Whether there was such a function."""
        if not self.has_udf(name):
            return False
        self._udfs.discard(name.lower())
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {quoted(name.lower())}")
        return True

    def has_udf(self, name: str) -> bool:
        return name.lower() in self._udfs

    def udfs(self) -> list[str]:
        """Names of the registered functions, sorted."""
        return sorted(self._udfs)

    def sql(self, text: str, params: dict | None = None) -> DataFrame | Status:
        """The result of the last statement. :name stands for a parameter, null if it isn't given."""
        results = self.script(text, params)
        return results[-1] if results else Status("nothing to do")

    def script(self, text: str, params: dict | None = None) -> list[DataFrame | Status]:
        return [self.run(s, params) for s in parse(text)]

    def run(self, statement, params: dict | None = None) -> DataFrame | Status:
        if isinstance(statement, (Select, SetOp, With)):
            return self.dataframe(lambda c: c.query(statement)[0], params)
        if statement.kind in ("begin", "commit", "rollback"):
            return getattr(self, f"_{statement.kind}")(statement.parts, params)
        with self.workspace.statement():
            return getattr(self, f"_{statement.kind}")(statement.parts, params)

    # queries

    def dataframe(self, build, params: dict | None = None, extra: dict[str, DataFrame] | None = None) -> DataFrame:
        """The DataFrame of what build(compiler) gives. Tables are views for as long as Spark resolves the query."""
        made: dict[str, tuple[str, Columns]] = {}
        manifest = self.workspace.manifest()

        def table(name: str) -> tuple[str, Columns]:
            key = name.lower()
            if key not in made:
                if extra and key in extra:
                    df = extra[key]
                else:
                    try:
                        df = self.workspace.read(manifest.tables[manifest.find(name)])
                    except KeyError:
                        if key not in self.views:
                            raise SqlError(f"no table {name}") from None
                        df = self.views[key]
                view = f"sqlbranch_{uuid.uuid4().hex}"
                df.createOrReplaceTempView(view)
                made[key] = view, [(f.name, kind_of(f.dataType)) for f in df.schema]
            return made[key]

        try:
            return self.spark.sql(build(Compiler(table, params, self._udfs | set(manifest.functions), self.deterministic)))
        finally:
            for view, _ in made.values():
                self.spark.catalog.dropTempView(view)

    def explain(self, text: str, params: dict | None = None) -> str:
        df = self.sql(text, params)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _explain(self, parts, params):
        df = self.run(parts["query"], params)
        text = df._jdf.queryExecution().toString() if isinstance(df, DataFrame) else df.message
        return self.spark.createDataFrame([(line,) for line in text.split("\n")], "plan string")

    # transactions

    def _begin(self, parts, params):
        self.workspace.begin()
        return Status("begun")

    def _commit(self, parts, params):
        self.workspace.commit()
        return Status("committed")

    def _rollback(self, parts, params):
        self.workspace.rollback()
        return Status("rolled back")

    def _pragma(self, parts, params):
        return Status("ignored")

    # tables

    def _exists(self, name: str) -> bool:
        try:
            self.workspace.manifest().find(name)
            return True
        except KeyError:
            return False

    def info(self, name: str) -> TableInfo:
        manifest = self.workspace.manifest()
        try:
            return manifest.tables[manifest.find(name)]
        except KeyError:
            raise SqlError(f"no table {name}") from None

    def _create_table(self, parts, params):
        name = parts["name"]
        if self._exists(name):
            if parts["if_not_exists"]:
                return Status(f"table {name} exists")
            raise SqlError(f"table {name} exists")
        if "query" in parts:
            return self.save(name, self.run(parts["query"], params))
        columns = [ColumnInfo(c.name, spark_type(c.type), c.nullable, c.default_sql, c.autoincrement, c.type) for c in parts["columns"]]
        info = TableInfo(columns, parts["primary_key"], parts["unique"])
        for group in info.keys():
            for column in group:
                info.column(column)
        for column in info.primary_key:
            if not info.column(column).autoincrement:
                info.column(column).nullable = len(info.primary_key) == 1 and info.column(column).type == "bigint"
        self.workspace.update(lambda m: m.tables.__setitem__(name, info))
        return Status(f"table {name} created")

    def save(self, name: str, df: DataFrame, mode: str = "error") -> Status:
        """A DataFrame as a table. mode: error, append (by name), replace."""
        with self.workspace.statement():
            return self._save(name, df, mode)

    def _save(self, name: str, df: DataFrame, mode: str) -> Status:
        if self._exists(name) and mode == "append":
            return self._append(name, df)
        if self._exists(name) and mode == "error":
            raise SqlError(f"table {name} exists")
        info = TableInfo([ColumnInfo(f.name, f.dataType.simpleString() if f.dataType.simpleString() != "void" else "string") for f in df.schema])
        info.paths = [self.workspace.write(df, info)]

        def change(m: Manifest):
            if name.lower() in (k.lower() for k in m.tables):
                del m.tables[m.find(name)]
            m.tables[name] = info

        self.workspace.update(change)
        return Status(f"table {name} saved")

    def _append(self, name: str, df: DataFrame) -> Status:
        info = self.info(name)
        known = {c.lower() for c in df.columns}
        rows = df.select(*(F.col(c.name).cast(c.type).alias(c.name) if c.name.lower() in known else F.lit(None).cast(c.type).alias(c.name) for c in info.columns))
        path, rows = self._written(rows, info)
        self._check(info, rows, self.workspace.read(info))
        self.workspace.update(self._adding(info, name, path), rebase=not info.keys())
        return Status(f"rows appended to {name}")

    def _written(self, rows: DataFrame, info: TableInfo) -> tuple[str, DataFrame]:
        """A new folder of the table and the rows as they are there: whatever else looks at them sees the same values, and no source is read again."""
        path = self.workspace.write(rows, info)
        return path, self.spark.read.schema(info.ddl()).parquet(f"{self.workspace.files.root}/{path}")

    @staticmethod
    def _adding(info: TableInfo, name: str, path: str):
        """A change that adds a folder to a table that still is the one that was read."""

        def change(m: Manifest):
            t = m.tables[m.find(name)]
            if t.id != info.id or t.fingerprint() != info.fingerprint():
                raise ConflictError(f"table {name} was changed by another writer")
            t.paths.append(path)

        return change

    def _staged(self, rows: DataFrame) -> DataFrame:
        """rows, computed once and kept beside the tables until the application ends."""
        path = f"{self.workspace.files.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.workspace.files.fs.deleteOnExit(self.workspace.files.path(path.removeprefix(self.workspace.files.root + "/")))
        return self.spark.read.schema(rows.schema).parquet(path)

    def _drop_table(self, parts, params):
        if not self._exists(parts["name"]):
            if parts["if_exists"]:
                return Status("no such table")
            raise SqlError(f"no table {parts['name']}")
        self.workspace.update(lambda m: m.tables.pop(m.find(parts["name"])))
        return Status(f"table {parts['name']} dropped")

    def _create_index(self, parts, params):
        info = self.info(parts["table"])
        if any(parts["name"] in t.indexes for t in self.workspace.manifest().tables.values()):
            raise SqlError(f"index {parts['name']} exists")
        columns = [info.column(e.value).name for e in parts["columns"]]
        if parts["unique"]:
            self._unique(self.workspace.read(info), columns)
        index = {"columns": columns, "unique": parts["unique"], "method": parts["method"]}
        self.workspace.update(lambda m: m.tables[m.find(parts["table"])].indexes.__setitem__(parts["name"], index))
        return Status(f"index {parts['name']} created")

    def _drop_index(self, parts, params):
        def change(m):
            for t in m.tables.values():
                if t.indexes.pop(parts["name"], None) is not None:
                    return
            if not parts["if_exists"]:
                raise SqlError(f"no index {parts['name']}")

        self.workspace.update(change)
        return Status(f"index {parts['name']} dropped")

    def _alter(self, parts, params):
        table, action = parts["table"], parts["action"]
        info = self.info(table)
        if action == "rename_table":
            if self._exists(parts["to"]):
                raise SqlError(f"table {parts['to']} exists")
            self.workspace.update(lambda m: m.tables.__setitem__(parts["to"], m.tables.pop(m.find(table))))
            return Status(f"table {table} is now {parts['to']}")
        rows, new = self.workspace.read(info), Manifest({"t": info}).copy().tables["t"]
        if action == "add":
            c = parts["column"]
            if any(k.name.lower() == c.name.lower() for k in info.columns):
                raise SqlError(f"column {c.name} exists")
            new.columns.append(ColumnInfo(c.name, spark_type(c.type), c.nullable, c.default_sql, c.autoincrement, c.type))
            if c.default is None:
                if not c.nullable and rows.limit(1).count():
                    raise ConflictError(f"{c.name} can't be null")
                self.workspace.update(lambda m: m.tables.__setitem__(m.find(table), new))  # old files lack the column, which reads as null
                return Status(f"column {c.name} added")
            value = Compiler(lambda n: (_ for _ in ()).throw(SqlError(f"no table {n}"))).expr(c.default, Scope())[0]
            rows = rows.withColumn(c.name, F.expr(value))
        elif action == "drop":
            name = info.column(parts["column"]).name
            if any(name in group for group in info.keys()):
                raise SqlError(f"column {name} is part of a key")
            new.columns = [c for c in new.columns if c.name != name]
            new.indexes = {k: i for k, i in new.indexes.items() if name not in i["columns"]}
        else:
            name, to = info.column(parts["column"]).name, parts["to"]
            if any(c.name.lower() == to.lower() for c in info.columns):
                raise SqlError(f"column {to} exists")
            swap = lambda group: [to if c == name else c for c in group]
            new.column(name).name = to
            new.primary_key, new.unique = swap(new.primary_key), [swap(u) for u in new.unique]
            for i in new.indexes.values():
                i["columns"] = swap(i["columns"])
            rows = rows.withColumnRenamed(name, to)
        new.paths = [self.workspace.write(rows, new)] if info.paths else []
        self.workspace.update(lambda m: m.tables.__setitem__(m.find(table), new))
        return Status(f"table {table} altered")

    def _create_function(self, parts, params):
        if parts["language"] != "python":
            raise SqlError(f"functions in {parts['language']} can't be loaded")
        module, _, function = parts["source"].partition(":")
        self.register_udf(parts["name"], getattr(importlib.import_module(module), function))
        return Status(f"function {parts['name']} created")

    # constraints

    def _unique(self, rows: DataFrame, key: list[str]) -> None:
        whole = rows.na.drop(subset=key)
        if whole.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise ConflictError(f"values of {', '.join(key)} repeat")

    def _check(self, info: TableInfo, new: DataFrame, old: DataFrame | None) -> None:
        """New rows against the table's constraints, and its old rows where there are any."""
        needed = [c.name for c in info.columns if not c.nullable]
        if needed:
            missing = F.greatest(*(F.col(c).isNull() for c in needed)) if len(needed) > 1 else F.col(needed[0]).isNull()
            if new.filter(missing).limit(1).count():
                raise ConflictError(f"one of {', '.join(needed)} is null")
        for key in info.keys():
            self._unique(new, key)
            if old is not None and new.na.drop(subset=key).join(old.select(*key), key, "left_semi").limit(1).count():
                raise ConflictError(f"values of {', '.join(key)} exist")

    # rows

    def _incoming(self, parts, params, info: TableInfo) -> DataFrame:
        """The rows of an INSERT with all columns of the table, in order (_ord)."""
        names = [info.column(c).name for c in parts["columns"]] if parts["columns"] else [c.name for c in info.columns]
        if "query" in parts:
            given = self.run(parts["query"], params).toDF(*(f"_{k}" for k in range(len(names)))).withColumn("_ord", F.monotonically_increasing_id())
        else:
            if any(len(row) != len(names) for row in parts["rows"]):
                raise SqlError(f"{len(names)} values are needed in a row")

            def build(c: Compiler) -> str:
                rows = [([f"{k}L", *(c.expr(e, Scope())[0] for e in row)], any(map(_unrepeatable, row))) for k, row in enumerate(parts["rows"])]
                listed = ["_ord", *(f"_{k}" for k in range(len(names)))]
                plain = [f"({', '.join(row)})" for row, odd in rows if not odd]
                # a list of values may not hold what changes from call to call
                selects = [f"SELECT {', '.join(f'{x} AS {n}' for x, n in zip(row, listed))}" for row, odd in rows if odd]
                return " UNION ALL ".join(([f"SELECT * FROM VALUES {', '.join(plain)} AS v({', '.join(listed)})"] if plain else []) + selects)

            given = self.dataframe(build, params)
        columns = []
        for c in info.columns:
            if c.name in names:
                source = F.col(f"_{names.index(c.name)}")
                columns.append(source.try_cast(c.type).alias(c.name))
            elif c.default:
                default = self.dataframe(lambda k, c=c: f"SELECT {k.expr(_expression(c.default), Scope())[0]} AS d").first()[0]
                columns.append(F.lit(default).cast(c.type).alias(c.name))
            else:
                columns.append(F.lit(None).cast(c.type).alias(c.name))
        rows = given.select(*columns, "_ord")
        auto = [c.name for c in info.columns if c.autoincrement or info.primary_key == [c.name] and c.type == "bigint" and c.nullable]
        if auto:
            # numbers of listed rows follow each other; those of a query's rows, which no single task should see, only rise
            place = F.monotonically_increasing_id() if "query" in parts else F.row_number().over(Window.orderBy("_ord")) - 1
            number = place + F.lit(info.next_rowid)
            rows = rows.withColumn(auto[0], F.coalesce(F.col(auto[0]), number.cast("bigint")))
        return rows

    def _insert(self, parts, params):
        table = parts["table"]
        info = self.info(table)
        old = self.workspace.read(info)
        conflict = parts["conflict"] or {"replace": ("replace",), "ignore": (None, None, None)}.get(parts["or"])
        names = [c.name for c in info.columns]
        rows = self._incoming(parts, params, info)
        if conflict is not None:
            rows = self._staged(rows)
            count = rows.count()
        if conflict is None:
            path, touched = self._written(rows.select(*names), info)
            self._check(info, touched, old)
            count = touched.count()
            paths = [path]
        elif conflict[0] == "replace":
            kept = old
            for key in info.keys():
                rows = _last(rows, key)
                kept = kept.join(rows.na.drop(subset=key).select(*key).distinct(), key, "left_anti").select(*names)
            touched = rows.select(*names)
            self._check(info, touched, None)
            count = touched.count()
            paths = [self.workspace.write(kept.unionByName(touched), info)]
        elif conflict[1] is None:
            keys = [[info.column(c).name for c in conflict[0]]] if conflict[0] else info.keys()
            needed = [c.name for c in info.columns if not c.nullable]
            rows = rows.na.drop(subset=needed) if needed else rows
            for key in keys:
                rows = _first(rows, key).join(old.select(*key), key, "left_anti")
            path, touched = self._written(rows.select(*names), info)
            self._check(info, touched, old)
            count = touched.count()
            paths = [path]
        else:
            touched, whole = self._upsert(info, old, rows, conflict, params)
            path, whole = self._written(whole, info)
            self._check(info, whole, None)
            touched = whole.join(touched, [info.column(c).name for c in conflict[0]] if conflict[0] else info.keys()[0], "left_semi").select(*names)
            paths = [path]
        adds = conflict is None or len(conflict) > 1 and conflict[1] is None
        auto = [c.name for c in info.columns if c.autoincrement or info.primary_key == [c.name] and c.type == "bigint"]
        top = touched.agg(F.max(auto[0])).first()[0] if auto else None

        def change(m: Manifest):
            t = m.tables[m.find(table)]
            if adds:
                self._adding(info, table, paths[0])(m)
            else:
                t.paths = paths
            t.next_rowid = max(t.next_rowid + count, (top or 0) + 1)

        result = self._returned(parts["returning"], touched, table, params)
        # rows that no key compares with others may follow whatever another writer has added meanwhile
        self.workspace.update(change, rebase=adds and not info.keys() and not auto)
        return result or Status(f"{count} rows inserted")

    def _upsert(self, info: TableInfo, old: DataFrame, rows: DataFrame, conflict, params) -> tuple[DataFrame, DataFrame]:
        """Keys of the incoming rows, and the whole table. Rows with one key follow each other: the second sees what the first has made, as if they came in statements of their own.

        Where no assignment looks at the old row, the last one of a key settles it. Otherwise each repetition of a key takes a join, and more than MAX_REPEATS are refused.
        """
        target, sets, where = conflict
        key = [info.column(c).name for c in target] if target else info.keys()[0]
        names = [c.name for c in info.columns]
        assigned = {info.column(c).name: _qualified(e) for c, e in sets}
        where = _qualified(where) if where is not None else None
        null_key = F.greatest(*(F.col(c).isNull() for c in key)) if len(key) > 1 else F.col(key[0]).isNull()
        rank = F.when(null_key, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(*key).orderBy("_ord")))
        rows = self._staged(rows.withColumn("_rank", rank))
        rounds = rows.agg(F.max("_rank")).first()[0] or 0
        if rounds > 2 and not any(_mentions(e, "n") for e in [*assigned.values(), where] if e is not None):
            later = rows.filter("_rank > 1")
            if where is not None:
                kinds = [(f.name, kind_of(f.dataType)) for f in old.schema]
                later = self.dataframe(lambda c: f"SELECT * FROM {c.table('later')[0]} e WHERE coalesce({c.truth(where, Scope([('e', kinds)]))}, false)", params, {"later": later})
            rows, rounds = rows.filter("_rank = 1").unionByName(_last(later, key).withColumn("_rank", F.lit(2))), 2
            rows = self._staged(rows)
        if rounds > MAX_REPEATS:
            raise ConflictError(f"a key comes {rounds} times; more than {MAX_REPEATS} can't follow each other in one statement")
        whole = old
        for k in range(1, rounds + 1):

            def build(c: Compiler) -> str:
                now, _ = c.table("now")
                new, _ = c.table("new")
                kinds = [(f.name, kind_of(f.dataType)) for f in old.schema]
                scope = Scope([("n", kinds), ("e", kinds)])
                hit = "(e.`_hit` IS NOT NULL" + (f" AND coalesce({c.truth(where, scope)}, false))" if where is not None else ")")
                columns = []
                for name in names:
                    if name in assigned:
                        columns.append(f"CASE WHEN {hit} THEN try_cast({c.expr(assigned[name], scope)[0]} AS {info.column(name).type}) ELSE n.{quoted(name)} END AS {quoted(name)}")
                    else:
                        columns.append(f"n.{quoted(name)} AS {quoted(name)}")
                on = " AND ".join(f"n.{quoted(c)} = e.{quoted(c)}" for c in key)
                listed = ", ".join(f"e.{quoted(n)}" for n in names)
                return (
                    f"SELECT {', '.join(columns)} FROM {now} n LEFT JOIN (SELECT *, true AS _hit FROM {new}) e ON {on} "
                    f"UNION ALL SELECT {listed} FROM {new} e LEFT ANTI JOIN {now} n ON {on}"
                )

            whole = self.dataframe(build, params, {"now": whole, "new": rows.filter(F.col("_rank") == k).select(*names)})
        return rows.select(*key).distinct(), whole

    def _update(self, parts, params):
        table = parts["table"]
        info = self.info(table)
        sets = {info.column(c).name: e for c, e in parts["set"]}

        def build(changed: bool):
            def sql(c: Compiler) -> str:
                view, columns = c.table(table)
                scope = Scope([(table, columns)])
                where = c.truth(parts["where"], scope) if parts["where"] is not None else "true"
                items = [f"try_cast({c.expr(sets[n], scope)[0]} AS {info.column(n).type}) AS {quoted(n)}" if changed and n in sets else quoted(n) for n, _ in columns]
                return f"SELECT {', '.join(items)} FROM {quoted(view)} AS {quoted(table)} WHERE {'' if changed else 'NOT '}coalesce({where}, false)"

            return self.dataframe(sql, params)

        touched = build(True)
        if any(map(_unrepeatable, [*sets.values(), *([parts["where"]] if parts["where"] is not None else [])])):
            touched = self._staged(touched)
        whole = build(False).unionByName(touched)
        self._check(info, whole, None)
        return self._rewritten(table, info, whole, touched, parts["returning"], params, "updated")

    def _delete(self, parts, params):
        table = parts["table"]
        info = self.info(table)

        def build(kept: bool):
            def sql(c: Compiler) -> str:
                view, columns = c.table(table)
                where = c.truth(parts["where"], Scope([(table, columns)])) if parts["where"] is not None else "true"
                return f"SELECT * FROM {quoted(view)} AS {quoted(table)} WHERE {'NOT ' if kept else ''}coalesce({where}, false)"

            return self.dataframe(sql, params)

        return self._rewritten(table, info, build(True), build(False), parts["returning"], params, "deleted")

    def _rewritten(self, table, info, whole, touched, returning, params, done):
        count = touched.count()
        result = self._returned(returning, touched, table, params)
        path = self.workspace.write(whole, info)
        self.workspace.update(lambda m: setattr(m.tables[m.find(table)], "paths", [path]))
        return result or Status(f"{count} rows {done}")

    def _returned(self, items: list[Item] | None, rows: DataFrame, table: str, params) -> DataFrame | None:
        if not items:
            return None
        return self.dataframe(lambda c: c.query(Select(items, Source(table, None)))[0], params, {table.lower(): rows})


def _expression(sql: str) -> Node:
    return parse(f"SELECT {sql}")[0].items[0].expr


def _qualified(e: Node) -> Node:
    """Columns under `excluded` are the new row's (e); unqualified ones, and those under the table's own name, are the old row's (n)."""
    if e.kind == "column":
        table = e.extra["table"]
        return Node("column", e.value, [], {"table": "e" if table and table.lower() == "excluded" else "n"})
    extra = {k: _qualified(v) if isinstance(v, Node) else v for k, v in e.extra.items()}
    return Node(e.kind, e.value, [_qualified(a) for a in e.args], extra)


def _nodes(e: Node):
    yield e
    for x in [*e.args, *(v for v in e.extra.values() if isinstance(v, Node))]:
        yield from _nodes(x)


def _mentions(e: Node, table: str) -> bool:
    """Whether an expression uses a column of the table; subqueries may."""
    return any(x.kind == "column" and x.extra["table"] == table or "query" in x.extra for x in _nodes(e))


def _unrepeatable(e: Node) -> bool:
    """Whether a second look may give another value; subqueries may."""
    return any(x.kind == "call" and str(x.value).lower() in UNREPEATABLE or "query" in x.extra for x in _nodes(e))


def _first(rows: DataFrame, key: list[str], last: bool = False) -> DataFrame:
    """One row for each key, in the order of _ord; rows with a null in the key stay."""
    order = F.col("_ord").desc() if last else F.col("_ord")
    whole = rows.na.drop(subset=key).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    return whole.unionByName(rows.filter(null))


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    return _first(rows, key, True)
