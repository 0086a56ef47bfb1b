"""Recursive descent over the dialect's grammar.

Set operations associate to the left and INTERSECT binds tighter, as the standard has it; ORDER BY, LIMIT and OFFSET after a chain hold for all of it.
"""

from __future__ import annotations

from .ast import Column, Item, Join, Node, Order, Select, SetOp, Source, Statement, With
from .lexer import SqlError, Token, lex

_CLAUSES = set("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL AS SET VALUES RETURNING WITH AND OR NOT IS IN BETWEEN LIKE CASE WHEN THEN ELSE END ASC DESC NULLS SELECT INSERT UPDATE DELETE CREATE DROP ALTER BEGIN COMMIT ROLLBACK PRAGMA EXPLAIN".split())


def parse(sql: str) -> list:
    """All statements of a text; `;` between them may be left out."""
    return Parser(sql).program()


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at = sql, lex(sql), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, wanted: str):
        raise SqlError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def word(self, *words: str) -> bool:
        """Takes the words, one after another, if they all come next."""
        if all(self.peek(k).word == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(" ".join(words))

    def need_op(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def name(self) -> str:
        token = self.now
        if token.kind not in ("name", "ident"):
            self.fail("a name")
        self.at += 1
        return token.text

    def names(self) -> list[str]:
        self.need_op("(")
        out = self.listed(self.name)
        self.need_op(")")
        return out

    def listed(self, item) -> list:
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    # statements

    def program(self) -> list:
        out = []
        while True:
            while self.op(";"):
                pass
            if self.now.kind == "end":
                return out
            out.append(self.statement())

    def statement(self):
        w = self.now.word
        if w in ("SELECT", "WITH") or self.now.text == "(":
            return self.query()
        if w == "EXPLAIN":
            self.at += 1
            return Statement("explain", {"query": self.statement()})
        handler = getattr(self, f"_{w.lower()}", None) if w else None
        if handler is None:
            raise SqlError(f"unsupported statement: {self.now.text!r}")
        self.at += 1
        return handler()

    def _begin(self):
        self.word("TRANSACTION")
        return Statement("begin")

    def _commit(self):
        self.word("TRANSACTION")
        return Statement("commit")

    def _rollback(self):
        self.word("TRANSACTION")
        return Statement("rollback")

    def _pragma(self):
        while self.now.kind != "end" and self.now.text != ";":
            self.at += 1
        return Statement("pragma")

    def _truncate(self):
        self.word("TABLE")
        return Statement("delete", {"table": self.name(), "where": None, "returning": None})

    def _insert(self):
        conflict = None
        if self.word("OR"):
            conflict = "replace" if self.word("REPLACE") else "ignore"
            if conflict == "ignore":
                self.need("IGNORE")
        self.need("INTO")
        parts = {"table": self.name(), "or": conflict, "columns": None, "conflict": None}
        if self.now.text == "(" and self.peek().word != "SELECT":
            parts["columns"] = self.names()
        if self.word("VALUES"):
            parts["rows"] = self.listed(self.row)
        else:
            parts["query"] = self.query()
        if self.word("ON", "CONFLICT"):
            target = self.names() if self.now.text == "(" else None
            self.need("DO")
            if self.word("NOTHING"):
                parts["conflict"] = (target, None, None)
            else:
                self.need("UPDATE", "SET")
                sets = self.listed(self.assignment)
                parts["conflict"] = (target, sets, self.expr() if self.word("WHERE") else None)
        return Statement("insert", parts | {"returning": self.returning()})

    def row(self) -> list[Node]:
        self.need_op("(")
        out = self.listed(self.expr)
        self.need_op(")")
        return out

    def assignment(self) -> tuple[str, Node]:
        column = self.name()
        self.need_op("=")
        return column, self.expr()

    def returning(self) -> list[Item] | None:
        return self.listed(self.item) if self.word("RETURNING") else None

    def _update(self):
        table = self.name()
        self.need("SET")
        sets = self.listed(self.assignment)
        where = self.expr() if self.word("WHERE") else None
        return Statement("update", {"table": table, "set": sets, "where": where, "returning": self.returning()})

    def _delete(self):
        self.need("FROM")
        table = self.name()
        where = self.expr() if self.word("WHERE") else None
        return Statement("delete", {"table": table, "where": where, "returning": self.returning()})

    def _create(self):
        unique = self.word("UNIQUE")
        if self.word("INDEX"):
            parts = {"name": self.name(), "unique": unique}
            self.need("ON")
            parts["table"] = self.name()
            parts["method"] = self.name().lower() if self.word("USING") else "btree"
            self.need_op("(")
            parts["columns"] = [o.expr for o in self.listed(self.order_item)]
            self.need_op(")")
            return Statement("create_index", parts)
        if self.word("FUNCTION"):
            name = self.name()
            self.need("FROM")
            language = self.name().lower()
            return Statement("create_function", {"name": name, "language": language, "source": self.literal_text()})
        self.need("TABLE")
        parts = {"if_not_exists": self.word("IF", "NOT", "EXISTS"), "name": self.name()}
        if self.word("AS"):
            return Statement("create_table", parts | {"query": self.query()})
        parts |= {"columns": [], "primary_key": [], "unique": []}
        self.need_op("(")
        self.listed(lambda: self.element(parts))
        self.need_op(")")
        return Statement("create_table", parts)

    def literal_text(self) -> str:
        if self.now.kind != "text":
            self.fail("a text")
        self.at += 1
        return self.tokens[self.at - 1].text

    def element(self, parts: dict) -> None:
        named = self.word("CONSTRAINT") and bool(self.name())
        if self.word("PRIMARY", "KEY"):
            parts["primary_key"] = self.names()
        elif self.now.word == "UNIQUE" and self.peek().text == "(":
            self.at += 1
            parts["unique"].append(self.names())
        elif self.word("CHECK"):
            self.row()
        elif self.word("FOREIGN", "KEY"):
            self.names()
            self.need("REFERENCES")
            self.references()
        elif named:
            self.fail("a constraint")
        else:
            parts["columns"].append(self.column(parts))

    def references(self) -> None:
        self.name()
        if self.now.text == "(":
            self.names()

    def column(self, parts: dict) -> Column:
        out = Column(self.name())
        kind = []
        while self.now.kind in ("name", "ident") and self.now.word not in ("PRIMARY", "AUTOINCREMENT", "NOT", "NULL", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "CONSTRAINT"):
            kind.append(self.name())
            if self.op("("):
                sizes = [self.tokens[self.at].text]
                while not self.op(")"):
                    self.at += 1
                kind[-1] += f"({sizes[0]})"
        out.type = " ".join(kind)
        while True:
            if self.word("CONSTRAINT"):
                self.name()
            elif self.word("PRIMARY", "KEY"):
                parts["primary_key"] = [out.name]
            elif self.word("AUTOINCREMENT"):
                out.autoincrement = True
            elif self.word("NOT", "NULL"):
                out.nullable = False
            elif self.word("NULL"):
                pass
            elif self.word("UNIQUE"):
                parts["unique"].append([out.name])
            elif self.word("DEFAULT"):
                start = self.now.at
                out.default = self.additive()
                out.default_sql = self.sql[start : self.tokens[self.at - 1].end]
            elif self.word("CHECK"):
                self.row()
            elif self.word("REFERENCES"):
                self.references()
            else:
                return out

    def _drop(self):
        kind = "table" if self.word("TABLE") else "index"
        if kind == "index":
            self.need("INDEX")
        missing = self.word("IF", "EXISTS")
        name = self.name()
        self.word("CASCADE")
        return Statement(f"drop_{kind}", {"name": name, "if_exists": missing})

    def _alter(self):
        self.need("TABLE")
        table = self.name()
        if self.word("ADD"):
            self.word("COLUMN")
            return Statement("alter", {"table": table, "action": "add", "column": self.column({"unique": []})})
        if self.word("DROP"):
            self.word("COLUMN")
            return Statement("alter", {"table": table, "action": "drop", "column": self.name()})
        self.need("RENAME")
        if self.word("TO"):
            return Statement("alter", {"table": table, "action": "rename_table", "to": self.name()})
        self.word("COLUMN")
        column = self.name()
        self.need("TO")
        return Statement("alter", {"table": table, "action": "rename", "column": column, "to": self.name()})

    # queries

    def query(self):
        if self.word("WITH"):
            tables = []
            while True:
                name = self.name()
                self.need("AS")
                self.need_op("(")
                tables.append((name, self.query()))
                self.need_op(")")
                if not self.op(","):
                    return With(tables, self.query())
        body = self.chain()
        tail = self.tail()
        if any(tail):
            if isinstance(body, SetOp) or body.order or body.limit or body.offset:
                body = body if isinstance(body, SetOp) else Select([Item(Node("star"))], Source(None, "q", body))
            body.order, body.limit, body.offset = tail
        return body

    def tail(self) -> tuple[list[Order], Node | None, Node | None]:
        order = self.listed(self.order_item) if self.word("ORDER", "BY") else []
        limit = self.expr() if self.word("LIMIT") else None
        offset = self.expr() if self.word("OFFSET") else None
        return order, limit, offset

    def chain(self):
        left = self.intersections()
        while self.now.word in ("UNION", "EXCEPT"):
            op = self.name().upper()
            left = SetOp(op, self.word("ALL"), left, self.intersections())
        return left

    def intersections(self):
        left = self.operand()
        while self.word("INTERSECT"):
            left = SetOp("INTERSECT", self.word("ALL"), left, self.operand())
        return left

    def operand(self):
        if self.op("("):
            inner = self.query()
            self.need_op(")")
            return inner
        self.need("SELECT")
        out = Select([], distinct=self.word("DISTINCT"))
        if not out.distinct:
            self.word("ALL")
        out.items = self.listed(self.item)
        if self.word("FROM"):
            out.source = self.source()
            while self.op(","):
                out.joins.append(Join("CROSS", self.source()))
            while (join := self.join()) is not None:
                out.joins.append(join)
        out.where = self.expr() if self.word("WHERE") else None
        out.group = self.listed(self.expr) if self.word("GROUP", "BY") else []
        out.having = self.expr() if self.word("HAVING") else None
        return out

    def source(self) -> Source:
        if self.op("("):
            query = self.query()
            self.need_op(")")
            return Source(None, self.alias(), query)
        return Source(self.name(), self.alias())

    def alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        if self.now.kind == "ident" or self.now.kind == "name" and self.now.word not in _CLAUSES:
            return self.name()
        return None

    def join(self) -> Join | None:
        natural = self.word("NATURAL")
        kind = "INNER"
        if self.word("CROSS"):
            kind = "CROSS"
        elif self.now.word in ("LEFT", "RIGHT", "FULL"):
            kind = self.name().upper()
            self.word("OUTER")
        elif not self.word("INNER") and self.now.word != "JOIN":
            return None
        self.need("JOIN")
        out = Join(kind, self.source(), natural=natural)
        if self.word("ON"):
            out.on = self.expr()
        elif self.word("USING"):
            out.using = self.names()
        return out

    def item(self) -> Item:
        if self.op("*"):
            return Item(Node("star"))
        if self.now.kind in ("name", "ident") and self.peek().text == "." and self.peek(2).text == "*":
            table = self.name()
            self.at += 2
            return Item(Node("star", table))
        return Item(self.expr(), self.alias())

    def order_item(self) -> Order:
        out = Order(self.expr())
        out.descending = self.word("DESC")
        if not out.descending:
            self.word("ASC")
        if self.word("NULLS"):
            out.nulls = self.name().upper()
        return out

    # expressions

    def expr(self) -> Node:
        left = self.conjunction()
        while self.word("OR"):
            left = Node("binary", "OR", [left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.word("AND"):
            left = Node("binary", "AND", [left, self.negation()])
        return left

    def negation(self) -> Node:
        return Node("unary", "NOT", [self.negation()]) if self.word("NOT") else self.comparison()

    def comparison(self) -> Node:
        left = self.additive()
        while True:
            if self.word("IS"):
                left = Node("is_null", self.word("NOT"), [left])
                self.need("NULL")
                continue
            negated = self.now.word == "NOT" and self.peek().word in ("IN", "BETWEEN", "LIKE") and self.word("NOT")
            if self.word("IN"):
                self.need_op("(")
                if self.now.word in ("SELECT", "WITH"):
                    left = Node("in", negated, [left], {"query": self.query()})
                else:
                    left = Node("in", negated, [left, *self.listed(self.expr)])
                self.need_op(")")
            elif self.word("BETWEEN"):
                low = self.additive()
                self.need("AND")
                left = Node("between", negated, [left, low, self.additive()])
            elif self.word("LIKE"):
                left = Node("like", negated, [left, self.additive()])
            elif self.now.kind == "op" and self.now.text in ("=", "==", "!=", "<>", "<", "<=", ">", ">="):
                op = {"==": "=", "!=": "<>"}.get(self.now.text, self.now.text)
                self.at += 1
                left = Node("binary", op, [left, self.additive()])
            else:
                return left

    def additive(self) -> Node:
        left = self.multiplicative()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            op = self.now.text
            self.at += 1
            left = Node("binary", op, [left, self.multiplicative()])
        return left

    def multiplicative(self) -> Node:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%"):
            op = self.now.text
            self.at += 1
            left = Node("binary", op, [left, self.unary()])
        return left

    def unary(self) -> Node:
        if self.op("-"):
            return Node("unary", "-", [self.unary()])
        if self.op("+"):
            return self.unary()
        out = self.primary()
        while self.op("::"):
            out = Node("cast", self.type_name(), [out])
        return out

    def type_name(self) -> str:
        out = self.name()
        while self.now.kind == "name" and self.now.word in ("PRECISION", "VARYING"):
            out += " " + self.name()
        if self.op("("):
            while not self.op(")"):
                self.at += 1
        return out

    def primary(self) -> Node:
        t = self.now
        if t.kind in ("int", "real", "text", "param"):
            self.at += 1
            return Node("param", t.text[1:]) if t.kind == "param" else Node("lit", t.text, extra={"type": {"int": "integer"}.get(t.kind, t.kind)})
        if self.op("("):
            out = Node("scalar", extra={"query": self.query()}) if self.now.word in ("SELECT", "WITH") else self.expr()
            self.need_op(")")
            return out
        if self.op("["):
            out = Node("vector", None, [] if self.now.text == "]" else self.listed(self.expr))
            self.need_op("]")
            return out
        if t.kind == "name":
            if t.word in ("NULL", "TRUE", "FALSE"):
                self.at += 1
                return Node("lit", t.word, extra={"type": "null" if t.word == "NULL" else "boolean"})
            if self.word("CASE"):
                return self.case()
            if t.word == "CAST" and self.peek().text == "(":
                self.at += 2
                inner = self.expr()
                self.need("AS")
                out = Node("cast", self.type_name(), [inner])
                self.need_op(")")
                return out
            if t.word == "EXISTS" and self.peek().text == "(":
                self.at += 2
                out = Node("exists", extra={"query": self.query()})
                self.need_op(")")
                return out
            if self.peek().text == "(" and self.peek().kind == "op":
                return self.call()
        if t.kind == "ident" or t.kind == "name" and t.word not in _CLAUSES:
            name = self.name()
            return Node("column", self.name(), extra={"table": name}) if self.op(".") else Node("column", name, extra={"table": None})
        self.fail("an expression")

    def case(self) -> Node:
        subject = None if self.now.word == "WHEN" else self.expr()
        args = []
        while self.word("WHEN"):
            test = self.expr()
            self.need("THEN")
            args += [Node("binary", "=", [subject, test]) if subject else test, self.expr()]
        otherwise = self.expr() if self.word("ELSE") else None
        self.need("END")
        return Node("case", None, args, {"else": otherwise})

    def call(self) -> Node:
        name = self.name().lower()
        self.need_op("(")
        out = Node("call", name, [], {"distinct": self.word("DISTINCT"), "over": None})
        if self.op("*"):
            out.args = [Node("star")]
        elif self.now.text != ")":
            out.args = self.listed(self.expr)
        self.need_op(")")
        if self.word("OVER"):
            self.need_op("(")
            partition = self.listed(self.expr) if self.word("PARTITION", "BY") else []
            order = self.listed(self.order_item) if self.word("ORDER", "BY") else []
            frame = []
            while self.now.text != ")":
                if self.now.kind == "end":
                    self.fail("')'")
                frame.append(self.now.text)
                self.at += 1
            self.need_op(")")
            out.extra["over"] = (partition, order, " ".join(frame))
        return out
