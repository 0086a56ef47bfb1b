"""Differences between versions of a table, and three-way merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unique(df: DataFrame, key: list[str], name: str) -> None:
    if df.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"the key repeats in {name}")


def keyed_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, op (insert, delete, update), before, after (rows as structs), and changed: names of columns that differ. One row for each key that differs."""
    if old.columns != new.columns:
        raise ValueError("the layouts differ")
    _unique(old, key, "the old version")
    _unique(new, key, "the new version")
    whole = F.struct(*old.columns)
    a, b = old.select(*key, whole.alias("before")), new.select(*key, whole.alias("after"))
    rest = [c for c in old.columns if c not in key]
    changed = F.array_compact(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in rest))) if rest else F.array().cast("array<string>")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return a.join(b, key, "full").withColumns({"op": op, "changed": F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), changed).otherwise(F.array().cast("array<string>"))}).filter("op != 'update' OR size(changed) > 0")


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The columns with n: how many more times (fewer, if negative) the new version has a row."""
    both = old.withColumn("n", F.lit(-1)).unionByName(new.withColumn("n", F.lit(1)))
    return both.groupBy(*old.columns).agg(F.sum("n").alias("n")).filter("n != 0")


def diff(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keyed where there is a key, else of whole rows; if the layouts differ, only the columns that were added or removed."""
    if old.dtypes != new.dtypes:
        a, b = dict(old.dtypes), dict(new.dtypes)
        rows = [(c, "remove" if c not in b else "add" if c not in a else "change") for c in {**a, **b} if a.get(c) != b.get(c)]
        return old.sparkSession.createDataFrame(rows, "name string, op string")
    return keyed_diff(old, new, key) if key else multiset_diff(old, new)


@dataclass
class Merge:
    """merged: all rows that can be settled, and conflicts' rows as the base has them. conflicts: key, base, ours, theirs of keys that both sides changed, differently."""

    merged: DataFrame
    conflicts: DataFrame


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str], prefer: str | None = None) -> Merge:
    """A row that one side changed or removed takes that side; with prefer ('ours' or 'theirs'), conflicts take the preferred side too."""
    for df, name in ((base, "the base"), (ours, "ours"), (theirs, "theirs")):
        _unique(df, key, name)
    columns = base.columns
    side = lambda df, name: df.select(*key, F.struct(*columns).alias(name))
    met = side(base, "base").join(side(ours, "ours"), key, "full").join(side(theirs, "theirs"), key, "full")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    conflict = ~same("ours", "theirs") & ~same("base", "ours") & ~same("base", "theirs")
    settled = F.when(same("base", "ours"), F.col("theirs")).when(conflict, F.col(prefer or "base")).otherwise(F.col("ours"))
    merged = met.select(settled.alias("row")).filter("row IS NOT NULL").select("row.*")
    return Merge(merged, met.filter(conflict))


def multiset_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """For tables without a key: the base with what either side added and without what either removed."""
    names = base.columns
    counted = None
    for df, b, o, t in ((base, 1, 0, 0), (ours, 0, 1, 0), (theirs, 0, 0, 1)):
        part = df.withColumns({"_b": F.lit(b), "_o": F.lit(o), "_t": F.lit(t)})
        counted = part if counted is None else counted.unionByName(part)
    total = counted.groupBy(*names).agg(*(F.sum(c).alias(c) for c in ("_b", "_o", "_t")))
    n = F.greatest(F.lit(0), F.col("_o") + F.col("_t") - F.col("_b")).cast("int")
    return total.withColumn("_n", F.explode(F.expr("sequence(1, greatest(0, cast(_o + _t - _b as int)))"))).filter(n > 0).select(*names)
