"""Vectors: arrays, or text such as '[1, 2, 3]'. Vectors of different or no dimension, or that can't be read, give null."""

from __future__ import annotations

from . import scalar


def vector(arg) -> str:
    """An argument as an array of doubles."""
    return f"try_cast({arg[0]} as array<double>)" if arg[1] == "vector" else f"from_json({arg[0]}, 'array<double>')"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (a, x) -> a + x)"


@scalar("vector_distance", "vec_distance", least=2, most=3)
def distance(a, b, metric=("'l2'", "text")):
    """Euclidean, or with 'cosine' one minus the cosine; that is 1 if either norm is zero."""
    x, y = vector(a), vector(b)
    if metric[0].strip("'").lower() == "cosine":
        dot, norm = _sum(f"zip_with({x}, {y}, (p, q) -> p * q)"), f"sqrt({_sum(f'transform({x}, p -> p * p)')} * {_sum(f'transform({y}, p -> p * p)')})"
        value = f"if({norm} = 0, 1D, 1D - {dot} / nullif({norm}, 0D))"
    else:
        value = f"sqrt({_sum(f'zip_with({x}, {y}, (p, q) -> (p - q) * (p - q))')})"
    return f"if(size({x}) = size({y}) and size({x}) > 0, {value}, null)", "real"


@scalar("vector_dims")
def dims(a):
    return f"cast(nullif(size({vector(a)}), -1) as bigint)", "integer"


@scalar("vector_norm")
def norm(a):
    return f"sqrt({_sum(f'transform({vector(a)}, p -> p * p)')})", "real"
