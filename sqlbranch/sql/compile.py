"""From the dialect's syntax tree to Spark SQL, which Catalyst plans.

Expressions are rewritten where the dialect's meaning differs from Spark's: whole-number division, arithmetic that gives null on overflow,
LIKE without regard to ASCII case, casts that give null, and its own functions. Joins, aggregation, windows, set operations and
subqueries stay declarative and are left to the optimiser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .. import functions
from ..functions.num import common_type
from .ast import Node, Order, Select, SetOp, Source, With
from .lexer import SqlError

AGGREGATES = {"count", "sum", "avg", "min", "max"}
WINDOWS = {"row_number", "rank", "dense_rank", "lag", "lead", "ntile", "first_value", "last_value", "nth_value", "percent_rank", "cume_dist"}
UNREPEATABLE = {"random", "uuid", "now", "current_timestamp", "current_date", "current_time"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Columns = list[tuple[str, str]]


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Scope:
    """Names that an expression may use: (alias, columns with their types) of each source, and the scope around a subquery."""

    sources: list[tuple[str, Columns]] = field(default_factory=list)
    outer: Scope | None = None

    def kind(self, table: str | None, column: str) -> str:
        for alias, columns in self.sources:
            if table is None or alias.lower() == table.lower():
                for name, kind in columns:
                    if name.lower() == column.lower():
                        return kind
        return self.outer.kind(table, column) if self.outer else "unknown"


class Compiler:
    """table: gives the name of a view and the columns of a table. udfs: names of registered functions. deterministic: refuses what changes from run to run."""

    def __init__(self, table: Callable[[str], tuple[str, Columns]], params: dict | None = None, udfs: set[str] | None = None, deterministic: bool = False):
        self.table, self.params, self.udfs, self.deterministic = table, params or {}, {u.lower() for u in udfs or ()}, deterministic
        self.ctes: list[dict[str, Columns]] = []

    # queries

    def query(self, q, outer: Scope | None = None) -> tuple[str, Columns]:
        if isinstance(q, With):
            self.ctes.append({})
            parts = []
            for name, body in q.tables:
                sql, columns = self.query(body, outer)
                self.ctes[-1][name.lower()] = columns
                parts.append(f"{quoted(name)} AS ({sql})")
            sql, columns = self.query(q.body, outer)
            self.ctes.pop()
            return f"WITH {', '.join(parts)} {sql}", columns
        if isinstance(q, SetOp):
            left, columns = self.query(q.left, outer)
            right, others = self.query(q.right, outer)
            if len(columns) != len(others) and all(c[0] != "*" for c in columns + others):
                raise SqlError(f"{q.op} of {len(columns)} and {len(others)} columns")
            return f"({left}) {q.op}{' ALL' if q.all else ''} ({right}){self.tail(q, Scope([('', columns)], outer))}", columns
        return self.select(q, outer)

    def tail(self, q, scope: Scope) -> str:
        out = " ORDER BY " + ", ".join(self.order(o, scope) for o in q.order) if q.order else ""
        if q.limit is not None and not (q.limit.kind == "unary" and q.limit.value == "-"):
            out += f" LIMIT cast({self.expr(q.limit, scope)[0]} as int)"
        return out + (f" OFFSET cast({self.expr(q.offset, scope)[0]} as int)" if q.offset is not None else "")

    def order(self, o: Order, scope: Scope) -> str:
        """Nulls are lowest unless it is said where they go."""
        nulls = o.nulls or ("LAST" if o.descending else "FIRST")
        return f"{self.expr(o.expr, scope, True)[0]} {'DESC' if o.descending else 'ASC'} NULLS {nulls}"

    def source(self, s: Source, outer: Scope | None) -> tuple[str, str, Columns]:
        if s.query is not None:
            sql, columns = self.query(s.query, outer)
            alias = s.alias or "q"
            return f"({sql}) AS {quoted(alias)}", alias, columns
        alias = s.alias or s.name
        for known in reversed(self.ctes):
            if s.name.lower() in known:
                return f"{quoted(s.name)} AS {quoted(alias)}", alias, known[s.name.lower()]
        view, columns = self.table(s.name)
        return f"{quoted(view)} AS {quoted(alias)}", alias, columns

    def select(self, q: Select, outer: Scope | None) -> tuple[str, Columns]:
        scope = Scope([], outer)
        sql = ""
        if q.source:
            text, alias, columns = self.source(q.source, outer)
            scope.sources.append((alias, columns))
            sql = f" FROM {text}"
            for j in q.joins:
                text, alias, columns = self.source(j.source, outer)
                scope.sources.append((alias, columns))
                kind = "CROSS" if j.kind == "INNER" and j.on is None and not j.using and not j.natural else j.kind
                sql += f" {'NATURAL ' if j.natural else ''}{kind} JOIN {text}"
                if j.on is not None:
                    sql += f" ON {self.truth(j.on, scope)}"
                elif j.using:
                    sql += f" USING ({', '.join(map(quoted, j.using))})"
        if q.where is not None:
            sql += f" WHERE {self.truth(q.where, scope)}"
        items, columns = [], []
        for item in q.items:
            if item.expr.kind == "star":
                items.append(f"{quoted(item.expr.value)}.*" if item.expr.value else "*")
                columns += [c for alias, cs in scope.sources if not item.expr.value or alias.lower() == item.expr.value.lower() for c in cs]
                continue
            text, kind = self.expr(item.expr, scope, True)
            name = item.alias or self.default_name(item.expr)
            items.append(f"{text} AS {quoted(name)}")
            columns.append((name, kind))
        if q.group:
            sql += " GROUP BY " + ", ".join(self.expr(g, scope)[0] for g in q.group)
        if q.having is not None:
            sql += f" HAVING {self.truth(q.having, scope, True)}"
        shown = Scope([("", columns), *scope.sources], outer)
        return f"SELECT {'DISTINCT ' if q.distinct else ''}{', '.join(items)}{sql}{self.tail(q, shown)}", columns

    @staticmethod
    def default_name(e: Node) -> str:
        return e.value if e.kind == "column" else f"{e.value}(...)" if e.kind == "call" else "?column?"

    # expressions

    def truth(self, e: Node, scope: Scope, aggregates: bool = False) -> str:
        """A condition; a number counts as true if it isn't zero."""
        sql, kind = self.expr(e, scope, aggregates)
        return f"({sql} <> 0)" if kind in ("integer", "real") else sql

    def expr(self, e: Node, scope: Scope, aggregates: bool = False) -> tuple[str, str]:
        return getattr(self, f"_{e.kind}")(e, scope, aggregates)

    def _lit(self, e, scope, aggregates):
        kind = e.extra["type"]
        if kind == "text":
            return literal(e.value), kind
        if kind == "integer" and int(e.value) < 1 << 63:
            return f"{e.value}L", kind
        return (f"{e.value}D", "real") if kind in ("real", "integer") else (e.value, kind)

    def _param(self, e, scope, aggregates):
        value = self.params.get(e.value)
        if isinstance(value, bool):
            return str(value).upper(), "boolean"
        if isinstance(value, int):
            return f"{value}L", "integer"
        if isinstance(value, float):
            return f"cast({literal(repr(value))} as double)", "real"
        return ("NULL", "null") if value is None else (literal(str(value)), "text")

    def _column(self, e, scope, aggregates):
        table = e.extra["table"]
        return (f"{quoted(table)}." if table else "") + quoted(e.value), scope.kind(table, e.value)

    def _star(self, e, scope, aggregates):
        raise SqlError("* stands alone or in count(*)")

    def _unary(self, e, scope, aggregates):
        if e.value == "NOT":
            sql, kind = self.expr(e.args[0], scope, aggregates)
            return (f"(NOT {sql})", "boolean") if kind in ("boolean", "unknown", "null") else ("cast(null as boolean)", "boolean")
        if e.args[0].kind == "lit":
            sql, kind = self.expr(e.args[0], scope, aggregates)
            return f"(-{sql})", kind
        sql, kind = self.expr(e.args[0], scope, aggregates)
        return (f"try_subtract(0L, {sql})" if kind == "integer" else f"(-{sql})"), kind

    def _binary(self, e, scope, aggregates):
        op = e.value
        if op in ("AND", "OR"):
            left, right = (self.truth(a, scope, aggregates) for a in e.args)
            return f"({left} {op} {right})", "boolean"
        (a, ka), (b, kb) = (self.expr(x, scope, aggregates) for x in e.args)
        if op == "||":
            return f"concat({functions.text_of((a, ka))}, {functions.text_of((b, kb))})", "text"
        numbers = ("integer", "real")
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if ka == "text" and kb in numbers:
                a = f"try_cast({a} as double)"
            elif kb == "text" and ka in numbers:
                b = f"try_cast({b} as double)"
            return f"({a} {op} {b})", "boolean"
        if ka == "text":
            a, ka = f"try_cast({a} as double)", "real"
        if kb == "text":
            b, kb = f"try_cast({b} as double)", "real"
        if op == "/":
            if ka == kb == "integer":
                return f"({a} div nullif({b}, 0))", "integer"
            return f"try_divide({a}, {b})", "real"
        kind = common_type(("", ka), ("", kb))
        name = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "%": "try_mod"}[op]
        return f"{name}({a}, {b})", kind

    def _is_null(self, e, scope, aggregates):
        return f"({self.expr(e.args[0], scope, aggregates)[0]} IS {'NOT ' if e.value else ''}NULL)", "boolean"

    def _in(self, e, scope, aggregates):
        parts = [self.expr(a, scope, aggregates) for a in e.args]
        if "query" in e.extra:
            inside = self.query(e.extra["query"], scope)[0]
        else:
            inside = ", ".join(f"try_cast({s} as double)" if k == "text" and parts[0][1] in ("integer", "real") else s for s, k in parts[1:])
        return f"({parts[0][0]} {'NOT ' if e.value else ''}IN ({inside}))", "boolean"

    def _between(self, e, scope, aggregates):
        x, low, high = (self.expr(a, scope, aggregates)[0] for a in e.args)
        return f"({x} {'NOT ' if e.value else ''}BETWEEN {low} AND {high})", "boolean"

    def _like(self, e, scope, aggregates):
        """Only ASCII letters match without regard to case, and no character escapes another."""
        fold = lambda s: f"translate({s}, '{_UPPER}', '{_LOWER}')"
        text, pattern = (functions.text_of(self.expr(a, scope, aggregates)) for a in e.args)
        pattern = f"replace({pattern}, '\\\\', '\\\\\\\\')"
        return f"({fold(text)} {'NOT ' if e.value else ''}LIKE {fold(pattern)})", "boolean"

    def _case(self, e, scope, aggregates):
        sql, kinds = "CASE", []
        for test, then in zip(e.args[::2], e.args[1::2]):
            text, kind = self.expr(then, scope, aggregates)
            sql += f" WHEN {self.truth(test, scope, aggregates)} THEN {text}"
            kinds.append(("", kind))
        if e.extra["else"] is not None:
            text, kind = self.expr(e.extra["else"], scope, aggregates)
            sql += f" ELSE {text}"
            kinds.append(("", kind))
        return sql + " END", common_type(*kinds)

    def _cast(self, e, scope, aggregates):
        from ..types import spark_type

        sql, kind = self.expr(e.args[0], scope, aggregates)
        to = spark_type(e.value)
        if kind == "text" and to != "string":
            sql = functions.call("trim", (sql, kind))[0]
        if kind == "text" and to == "bigint":
            sql = f"if({sql} rlike '^[+-]?[0-9]+$', {sql}, null)"
        name = {"bigint": "integer", "double": "real", "string": "text", "boolean": "boolean", "binary": "blob", "array<float>": "vector"}.get(to, "timestamp")
        if kind == "real" and to == "bigint":
            sql = f"if(isnan({sql}), 0D, {sql})"
            return f"coalesce(try_cast({sql} as bigint), if({sql} > 0, 9223372036854775807L, if({sql} < 0, -9223372036854775807L - 1L, null)))", name
        if to == "array<float>" and kind == "text":
            return f"from_json({sql}, 'array<float>')", name
        return f"try_cast({sql} as {to})", name

    def _vector(self, e, scope, aggregates):
        return f"array({', '.join(f'cast({self.expr(a, scope, aggregates)[0]} as float)' for a in e.args)})", "vector"

    def _exists(self, e, scope, aggregates):
        return f"EXISTS ({self.query(e.extra['query'], scope)[0]})", "boolean"

    def _scalar(self, e, scope, aggregates):
        sql, columns = self.query(e.extra["query"], scope)
        if len(columns) != 1:
            raise SqlError("a subquery that stands for a value has one column")
        return f"({sql})", columns[0][1]

    def _call(self, e, scope, aggregates):
        name, over = e.value, e.extra["over"]
        if self.deterministic and (name in UNREPEATABLE or any(a.kind == "lit" and a.value.lower() == "now" for a in e.args)):
            raise SqlError(f"{name} isn't allowed in deterministic mode")
        if name in self.udfs:
            args = [functions.text_of(self.expr(a, scope, aggregates)) for a in e.args]
            return f"{quoted(name)}({', '.join(args)})", "text"
        if name in AGGREGATES and (over or len(e.args) <= 1) or name in WINDOWS:
            if not aggregates:
                raise SqlError(f"{name} isn't allowed here")
            if over is None and name in WINDOWS:
                raise SqlError(f"{name} needs OVER")
            return self.aggregate(e, scope, over)
        try:
            return functions.call(name, *(self.expr(a, scope, aggregates) for a in e.args))
        except ValueError as error:
            raise SqlError(str(error)) from None

    def aggregate(self, e: Node, scope: Scope, over) -> tuple[str, str]:
        star = not e.args or e.args[0].kind == "star"
        inner = [] if star else [self.expr(a, scope, bool(over)) for a in e.args]
        distinct = "DISTINCT " if e.extra["distinct"] else ""
        if e.value == "count":
            sql, kind = ("count(*)" if star else f"count({distinct}{inner[0][0]})"), "integer"
        elif e.value == "sum":
            x = f"try_cast({inner[0][0]} as double)" if inner[0][1] == "text" else inner[0][0]
            sql, kind = f"try_sum({distinct}{x})", "integer" if inner[0][1] == "integer" else "real"
        elif e.value == "avg":
            x = f"try_cast({inner[0][0]} as double)" if inner[0][1] == "text" else f"cast({inner[0][0]} as double)"
            sql, kind = f"avg({distinct}{x})", "real"
        else:
            args = [s for s, _ in inner]
            if e.value in ("lag", "lead", "ntile", "nth_value") and len(args) > (e.value != "ntile"):
                k = 0 if e.value == "ntile" else 1
                args[k] = f"{max(1, int(e.args[k].value))}"
            sql = f"{e.value}({distinct}{', '.join(args)})"
            kind = inner[0][1] if e.value in ("min", "max", "lag", "lead", "first_value", "last_value", "nth_value") else "real" if e.value in ("percent_rank", "cume_dist") else "integer"
        if over:
            partition, order, frame = over
            spec = [f"PARTITION BY {', '.join(self.expr(p, scope, True)[0] for p in partition)}"] if partition else []
            spec += [f"ORDER BY {', '.join(self.order(o, scope) for o in order)}"] if order else []
            if not frame and e.value in AGGREGATES:
                frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
            sql = f"{sql} OVER ({' '.join([*spec, frame])})"
        return (f"cast({sql} as bigint)" if kind == "integer" and e.value in WINDOWS - {"lag", "lead", "first_value", "last_value", "nth_value"} else sql), kind
