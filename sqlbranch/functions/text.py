"""Text functions. Positions and lengths count characters; a null argument gives null."""

from __future__ import annotations

from . import scalar, text_of

# White_Space characters of Unicode, for trimming.
_SPACE = r"[\\s\\x85\\p{Z}]"


@scalar("lower")
def lower(s):
    return (f"lower({s[0]})", "text") if s[1] in ("text", "unknown") else s


@scalar("upper")
def upper(s):
    return (f"upper({s[0]})", "text") if s[1] in ("text", "unknown") else s


@scalar("length")
def length(s):
    if s[1] not in ("text", "unknown"):
        return "cast(null as bigint)", "integer"
    return f"cast(char_length({s[0]}) as bigint)", "integer"


@scalar("substr", "substring", least=2, most=3)
def substr(s, start, n=None):
    """A start before the first character means the first, a negative length none."""
    rest = f", cast(greatest({n[0]}, 0) as int)" if n else ""
    return f"substring({s[0]}, cast(greatest({start[0]}, 1) as int){rest})", "text"


@scalar("trim")
def trim(s):
    return f"regexp_replace({s[0]}, '^{_SPACE}+|{_SPACE}+$', '')", "text"


@scalar("ltrim")
def ltrim(s):
    return f"regexp_replace({s[0]}, '^{_SPACE}+', '')", "text"


@scalar("rtrim")
def rtrim(s):
    return f"regexp_replace({s[0]}, '{_SPACE}+$', '')", "text"


@scalar("replace", least=3, most=3)
def replace(s, old, new):
    """An empty pattern stands between all characters and at both ends."""
    between = f"concat({new[0]}, regexp_replace({s[0]}, '(?s)(.)', concat('$1', regexp_replace({new[0]}, '([$\\\\\\\\])', '\\\\\\\\$1'))))"
    return f"if({old[0]} = '', {between}, replace({s[0]}, {old[0]}, {new[0]}))", "text"


@scalar("instr", least=2, most=2)
def instr(s, part):
    return f"cast(instr({s[0]}, {part[0]}) as bigint)", "integer"


@scalar("concat", least=1, most=None)
def concat(*parts):
    return f"concat({', '.join(map(text_of, parts))})", "text"


@scalar("hex")
def hexadecimal(s):
    if s[1] not in ("text", "blob", "unknown"):
        return "cast(null as string)", "text"
    return f"hex(cast({s[0]} as binary))", "text"


@scalar("quote")
def quote(s):
    """The argument as a literal of SQL."""
    if s[1] in ("text", "unknown"):
        return f"coalesce(concat(char(39), replace({s[0]}, char(39), repeat(char(39), 2)), char(39)), 'NULL')", "text"
    if s[1] == "blob":
        return f"coalesce(concat('X', char(39), hex({s[0]}), char(39)), 'NULL')", "text"
    return f"coalesce(cast({s[0]} as string), 'NULL')", "text"
