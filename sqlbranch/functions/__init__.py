"""Scalar functions of the dialect, each as a rewriting of SQL arguments into a Spark SQL expression.

One definition serves the SQL frontend, which passes rendered arguments, and DataFrame code, through column(). No
expression depends on the session's ANSI mode or time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A function gets its arguments as (SQL, type) pairs and gives (SQL, type); types are those of typeof(), or "unknown".
Arg = tuple[str, str]
REGISTRY: dict[str, tuple[int, int | None, Callable[..., Arg]]] = {}


def scalar(*names: str, least: int = 1, most: int | None = 1):
    """Registers a function under its names with its least and greatest number of arguments (None: any)."""

    def register(function: Callable[..., Arg]) -> Callable[..., Arg]:
        for name in names:
            REGISTRY[name] = (least, most, function)
        return function

    return register


def call(name: str, *args: Arg) -> Arg:
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown function {name}")
    least, most, function = REGISTRY[name.lower()]
    if len(args) < least or most is not None and len(args) > most:
        raise ValueError(f"{name} takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments, not {len(args)}")
    return function(*args)


def column(name: str, *args: str, types: tuple[str, ...] = ()) -> Column:
    """The function over SQL expressions as a Column: column("substr", "c_name", "0", "3")."""
    kinds = types or ("unknown",) * len(args)
    return F.expr(call(name, *zip(args, kinds))[0])


def text_of(arg: Arg) -> str:
    """An argument as text, as results are shown: whole reals keep their point."""
    return arg[0] if arg[1] == "text" else f"cast({arg[0]} as string)"


from . import dates, num, text, vector  # noqa: E402, F401
