"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<real>\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+)
      | (?P<int>\d+)
      | (?P<text>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<name>[^\W\d]\w*)
      | (?P<param>:[^\W\d]\w*)
      | (?P<op>::|\|\||<=|>=|<>|!=|==|[-+*/%(),.;<>=\[\]])""",
    re.X | re.S,
)


class SqlError(ValueError):
    """A statement that can't be read or isn't allowed."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    end: int

    @property
    def word(self) -> str:
        """The upper-case form of an unquoted name, else nothing."""
        return self.text.upper() if self.kind == "name" else ""


def lex(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m or (m.lastgroup == "op" and m[0] == "/" and sql.startswith("/*", at)):
            raise SqlError(f"unexpected character {sql[at]!r} at {at}")
        at = m.end()
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "text":
            text = text[1:-1].replace("''", "'")
        elif kind == "quoted":
            kind, text = "ident", text[1:-1].replace('""', '"')
        out.append(Token(kind, text, m.start(), m.end()))
    out.append(Token("end", "", len(sql), len(sql)))
    return out
