"""Dates as text, in UTC and whole seconds. What can't be read as a time gives null."""

from __future__ import annotations

import re

from . import scalar

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_NOW = f"({_EPOCH} + make_dt_interval(0, 0, 0, unix_timestamp()))"
_UNITS = {"day": "make_dt_interval({n})", "hour": "make_dt_interval(0, {n})", "minute": "make_dt_interval(0, 0, {n})", "second": "make_dt_interval(0, 0, 0, {n})", "month": "make_ym_interval(0, {n})", "year": "make_ym_interval({n})"}


def instant(value, *modifiers) -> str:
    """A time value, changed by modifiers, as a timestamp without time zone."""
    sql, kind = value
    if sql.lower() == "'now'":
        out = _NOW
    elif kind == "integer":
        out = f"({_EPOCH} + make_dt_interval(0, 0, 0, {sql}))"
    elif kind == "timestamp":
        out = f"cast({sql} as timestamp_ntz)"
    else:
        s = sql if kind == "text" else f"cast({sql} as string)"
        out = (
            f"case when lower({s}) = 'now' then {_NOW}"
            f" when {s} rlike '^-?[0-9]+$' then {_EPOCH} + make_dt_interval(0, 0, 0, try_cast({s} as bigint))"
            f" when {s} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?)?$' then try_cast(regexp_replace({s}, '[.][0-9]+$', '') as timestamp_ntz)"
            f" when {s} rlike '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?$' then try_cast(concat('2000-01-01 ', {s}) as timestamp_ntz) end"
        )
    for m in modifiers:
        out = _modified(out, m[0])
    return f"({out})"


def _modified(ts: str, modifier: str) -> str:
    text = modifier.strip("'").strip().lower()
    if found := re.fullmatch(r"([+-]?\d+)\s+(day|hour|minute|second|month|year)s?", text):
        return f"({ts} + {_UNITS[found[2]].format(n=int(found[1]))})"
    if text == "start of day":
        return f"cast(cast({ts} as date) as timestamp_ntz)"
    if text in ("start of month", "start of year"):
        return f"cast(trunc(cast({ts} as date), '{text[9:]}') as timestamp_ntz)"
    return "cast(null as timestamp_ntz)"


_PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}
_SHAPES = {
    "j": "lpad(cast(dayofyear({t}) as string), 3, '0')",
    "w": "cast(dayofweek({t}) - 1 as string)",
    "s": "cast(timestampdiff(SECOND, " + _EPOCH + ", {t}) as string)",
}


@scalar("strftime", least=2, most=None)
def strftime(fmt, value, *modifiers):
    """Codes %Y %m %d %H %M %S %j %w %s %%; others stand for themselves. The format must be a literal."""
    if not (fmt[0].startswith("'") and fmt[0].endswith("'")):
        raise ValueError("strftime needs a literal format")
    t, parts = instant(value, *modifiers), []
    for piece in re.findall(r"%.|[^%]+|%$", fmt[0][1:-1], re.S):
        code = piece[1:] if piece[0] == "%" else ""
        if code in _PATTERNS and code:
            parts.append(f"date_format({t}, '{_PATTERNS[code]}')")
        elif code in _SHAPES and code:
            parts.append(_SHAPES[code].format(t=t))
        else:
            parts.append("'%'" if piece == "%%" else f"'{piece}'")
    return f"if({t} is null, null, concat({', '.join(parts) or chr(39) * 2}))", "text"


def _formatted(pattern: str):
    def function(value=("'now'", "text"), *modifiers):
        return f"date_format({instant(value, *modifiers)}, '{pattern}')", "text"

    return function


for _name, _pattern in (("date", "yyyy-MM-dd"), ("time", "HH:mm:ss"), ("datetime", "yyyy-MM-dd HH:mm:ss")):
    scalar(_name, least=0, most=None)(_formatted(_pattern))
for _name, _pattern in (("now", "yyyy-MM-dd HH:mm:ss"), ("current_timestamp", "yyyy-MM-dd HH:mm:ss"), ("current_date", "yyyy-MM-dd"), ("current_time", "HH:mm:ss")):
    scalar(_name, least=0, most=0)(_formatted(_pattern))


@scalar("unixepoch", least=0, most=None)
def unixepoch(value=("'now'", "text"), *modifiers):
    return f"timestampdiff(SECOND, {_EPOCH}, {instant(value, *modifiers)})", "integer"


@scalar("julianday", least=0, most=None)
def julianday(value=("'now'", "text"), *modifiers):
    return f"(timestampdiff(SECOND, {_EPOCH}, {instant(value, *modifiers)}) / 86400D + 2440587.5D)", "real"
