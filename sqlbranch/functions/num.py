"""Numbers, nulls and types."""

from __future__ import annotations

from . import scalar


def common_type(*args) -> str:
    kinds = {a[1] for a in args} - {"null"}
    if len(kinds) == 1:
        return kinds.pop()
    return "real" if kinds == {"integer", "real"} else "null" if not kinds else "unknown"


@scalar("abs")
def absolute(x):
    return (f"try_multiply({x[0]}, sign({x[0]}))" if x[1] == "real" else f"if({x[0]} < 0, try_subtract(0, {x[0]}), {x[0]})"), x[1]


@scalar("round", least=1, most=2)
def rounded(x, n=None):
    """Half away from zero on the binary value scaled by a power of ten; whole numbers stay as they are."""
    if x[1] == "integer":
        return x
    if n is None:
        return f"(sign({x[0]}) * floor(abs({x[0]}) + 0.5D))", "real"
    scale = f"power(10D, {n[0]})"
    return f"(sign({x[0]}) * floor(abs({x[0]}) * {scale} + 0.5D) / {scale})", "real"


@scalar("min", "least", least=2, most=None)
def smallest(*xs):
    """Null if any argument is."""
    return f"if({' or '.join(f'({x[0]}) is null' for x in xs)}, null, least({', '.join(x[0] for x in xs)}))", common_type(*xs)


@scalar("max", "greatest", least=2, most=None)
def largest(*xs):
    return f"if({' or '.join(f'({x[0]}) is null' for x in xs)}, null, greatest({', '.join(x[0] for x in xs)}))", common_type(*xs)


@scalar("coalesce", least=1, most=None)
def coalesce(*xs):
    return f"coalesce({', '.join(x[0] for x in xs)})", common_type(*xs)


@scalar("ifnull", least=2, most=2)
def ifnull(x, y):
    return f"coalesce({x[0]}, {y[0]})", common_type(x, y)


@scalar("nullif", least=2, most=2)
def nullif(x, y):
    return f"nullif({x[0]}, {y[0]})", x[1]


@scalar("typeof")
def typeof(x):
    if x[1] == "unknown":
        names = "case typeof({0}) when 'string' then 'text' when 'double' then 'real' when 'float' then 'real' when 'boolean' then 'boolean' when 'binary' then 'blob' when 'void' then 'null' else 'integer' end"
        return f"if({x[0]} is null, 'null', {names.format(x[0])})", "text"
    return f"if({x[0]} is null, 'null', '{x[1]}')", "text"


@scalar("random", least=0, most=0)
def random():
    return "cast(floor(rand() * 9223372036854775807D) as bigint)", "integer"


@scalar("uuid", least=0, most=0)
def uuid():
    return "uuid()", "text"
