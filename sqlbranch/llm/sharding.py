"""Shards of nearly equal size by sampled splitters.

A size-weighted sample of the keys gives quantile boundaries of many small ranges. The key of a record is
(hash of its text, doc_id, row), so that equal texts lie side by side; a boundary falls between two texts unless
one text's copies alone fill more than a range, whose range is then subdivided by doc_id, and by row where one document's rows fill more than a range. Exact sizes of the ranges decide
which run of ranges makes each shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

#: Limits of what the driver holds: keys in a sample, 32 bytes each, and ranges, of which each shard gets four at least.
SAMPLE_KEYS, MAX_RANGES, LEAST_RANGES = 400_000, 4096, 4

_LEAST = -(1 << 63)


def _boundaries(keys: np.ndarray, weights: np.ndarray, target: float) -> list[tuple[int, ...]]:
    """First keys of all ranges but the lowest, from a sample (a row of three numbers for each key) whose weights add up to the size of all records."""
    order = np.lexsort(keys.T[::-1])
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.r_[True, keys[1:, 0] != keys[:-1, 0]])
    out, filled = [], 0.0
    for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
        group = float(weights[a:b].sum())
        if filled >= target or (filled and filled + group > 1.5 * target):
            out.append((int(keys[a, 0]), _LEAST, _LEAST))
            filled = 0.0
        if group > 2 * target:  # copies of one text fill ranges of their own
            cuts = a + np.searchsorted(np.cumsum(weights[a:b]), np.arange(target, group - target / 2, target))
            out += [tuple(map(int, keys[k])) for k in cuts]
            filled = target
        else:
            filled += group
    return list(dict.fromkeys(out))


def _ranks(columns: list[np.ndarray], bounds: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds aren't above each row, column by column."""
    if len(columns) == 1:
        return np.searchsorted(bounds[:, 0], columns[0], "right")
    low, out = (np.searchsorted(bounds[:, 0], columns[0], side) for side in ("left", "right"))
    tied = np.flatnonzero(out > low)
    for value in np.unique(columns[0][tied]):
        rows = tied[columns[0][tied] == value]
        a, b = low[rows[0]], out[rows[0]]
        out[rows] = a + _ranks([c[rows] for c in columns[1:]], bounds[a:b, 1:])
    return out


def _numbered(df: DataFrame, boundaries: list[tuple[int, ...]], key: list[str], to: str) -> DataFrame:
    bounds = np.array(boundaries, np.int64).reshape(-1, len(key))

    @F.pandas_udf("int")
    def number(h: pd.Series, i: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(_ranks([x.to_numpy(np.int64) for x in (h, i, r)], bounds).astype(np.int32))

    return df.withColumn(to, number(*key))


def assign_shards(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 128) -> DataFrame:
    """docs with size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Null texts count as empty; a doc_id may be null, and of any type whose text tells its values apart. Equal rows get slots of their own, and where they fill more than a range they are dealt over several.
    Ties are kept in no order beyond that. A text of any length goes to one shard as a whole. An empty table gives an empty table. Existing columns of the new names are replaced; others stay as they are.
    No range but one of a single large record exceeds two targets, by further samples inside those that do.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    names = docs.columns
    key = [unused(docs, k) for k in ("hash", "id", "row")]
    at, place, offset_name = (unused(docs, k) for k in ("range", "at", "offset"))

    def keyed_by(rows: DataFrame, row) -> DataFrame:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        whole = dict(docs.dtypes).get("doc_id") in ("tinyint", "smallint", "int", "bigint")
        number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string")))
        return rows.withColumns({
            "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")),
            key[0]: F.xxhash64(text), key[1]: F.coalesce(number, F.lit(_LEAST)), key[2]: row,
        })

    n = max(min(MAX_RANGES, shards * ranges_per_shard), LEAST_RANGES * shards)

    def ranged(keyed: DataFrame) -> tuple[list, dict[int, tuple[int, int]], float]:
        """Boundaries, and the size and the number of rows of each range."""
        keys = keyed.select(*key, "size")
        total = keys.agg(F.sum("size")).first()[0] or 0
        target = max(total / n, 1.0)

        def sample(source: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
            chance = F.least(F.col("size") * share, F.lit(1.0))
            drawn = F.pmod(F.xxhash64(*key, F.lit(5)), F.lit(1 << 31)) / float(1 << 31)
            # rows of one key are drawn together: one row stands for all of them
            rows = source.filter(drawn < chance).groupBy(*key).agg(F.sum(F.col("size") / chance).alias("weight")).toPandas()
            return rows[key].to_numpy(np.int64), rows["weight"].to_numpy(float)

        boundaries = _boundaries(*sample(keys, SAMPLE_KEYS / 2 / max(total, 1)), target) if total else []
        sized = lambda b: {r[0]: (r[1], r[2]) for r in _numbered(keys, b, key, at).groupBy(at).agg(F.sum("size"), F.count("*")).collect()}
        sizes = sized(boundaries)
        over = sorted(k for k, (size, rows) in sizes.items() if size > 2 * target and rows > 1)
        if over:
            heavy = sum(sizes[k][0] for k in over)
            inside = _numbered(keys, boundaries, key, at).filter(F.col(at).isin(over)).select(*key, "size")
            boundaries = sorted({*boundaries, *_boundaries(*sample(inside, SAMPLE_KEYS / heavy), target)})
            sizes = sized(boundaries)
        return boundaries, sizes, target

    keyed = keyed_by(docs, F.lit(0).cast("long"))
    boundaries, sizes, target = ranged(keyed)
    if any(size > 2 * target and rows > 1 for size, rows in sizes.values()):
        # rows of one document fill a range: rows are told apart by their places in a stored copy, which are the same whenever it is read
        keyed = keyed_by(stored(docs, "shards"), F.monotonically_increasing_id())
        boundaries, sizes, target = ranged(keyed)
    total = sum(size for size, _ in sizes.values())
    shard, offset, before, filled = {}, {}, 0, {}
    for k in sorted(sizes):
        size, rows = sizes[k]
        shard[k] = min(shards - 1, int(shards * (before + size / 2) / total))
        offset[k] = filled.get(shard[k], 0)
        filled[shard[k]] = offset[k] + rows
        before += size

    plan = docs.sparkSession.createDataFrame([(k, shard[k], offset[k]) for k in sizes], f"{at} int, shard int, {offset_name} long")
    in_range = F.row_number().over(Window.partitionBy(at).orderBy(*key))
    # at most MAX_RANGES and the subdivisions
    out = _numbered(keyed, boundaries, key, at).withColumn(place, in_range).join(F.broadcast(plan), at)
    return out.withColumn("slot", F.col(offset_name) + F.col(place) - 1).select(*names, "size", "text_crc32", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Each shard as a folder `shard=N` of Parquet files. Empty shards have no folder, an empty table no files of rows; all other columns are kept, and an existing folder is an error."""
    sharded.write.partitionBy("shard").parquet(path)
