"""Near-duplicates by SimHash fingerprints, with the generalised pigeonhole principle.

The 64 bits are divided into m parts. If thresholds t (-1 or more) of the parts satisfy sum(t + 1) = tau + 1, two fingerprints with
at most tau differing bits differ in at most t bits within some part. Correlated bits go into the same part, which leaves the parts
independent of each other, and dynamic programming gives each part the threshold that keeps the
estimated work, rows to deal out and candidates to verify, lowest. Each fingerprint is indexed under its value in each part and probes
all values within the threshold; matches are verified on all bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stored, unused
from .graph import connected_components

#: Fingerprints in the sample that bits are grouped and candidates estimated on.
SAMPLE = 3000
#: Relative costs of a row dealt out and of a candidate verified.
ROW_COST, CANDIDATE_COST = 2.0, 0.05
#: An index value of more fingerprints than this is divided further, by parts of the remaining bits.
HEAVY = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the text's word shingles, as an unsigned number; 0 without words.

    Words are runs of other bytes than white space, A-Z lower-cased; fewer words than `width` make one shingle; a bit is set if it is set in over half the XXH64 hashes (seed 42).
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash_of(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter((hash_of(s, 42) for s in shingles), "<u8", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """docs with the fingerprint of each text as a signed long, in column `to`, which is replaced if it is there; a null text is empty.

    Rows are independent: repeated ones have equal fingerprints, and an empty table gives an empty table.
    """

    @F.arrow_udf("long")
    def fingerprints(column: pa.Array) -> pa.Array:
        out = [fingerprint(t) for at in range(0, len(column), 128) for t in column.slice(at, 128).to_pylist()]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return docs.withColumn(to, fingerprints(as_bytes(text)))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, 64)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of 64 bits, of nearly equal width; each grows from a seed by the bit most correlated with it."""
    with np.errstate(invalid="ignore", divide="ignore"):
        strength = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    left, parts = list(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (strength[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = tau + 1. costs[i][t + 1]: the cost of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t1, more in enumerate(part):
                if spent + t1 <= tau + 1:
                    step[spent + t1] = min(step.get(spent + t1, (float("inf"), [])), (cost + more, [*chosen, t1 - 1]))
        best = step
    return best[tau + 1]


def plan_parts(sample: np.ndarray, n: int, tau: int, widest: int = 6) -> list[tuple[list[int], int]]:
    """Parts with thresholds (parts at -1 left out) for n distinct fingerprints."""
    bits, best = _bits(sample), (float("inf"), [])
    half = len(sample) // 2
    for m in range(2, widest + 1):
        parts, costs = group_bits(bits, m), []
        for part in parts:
            values = bits[:, part].astype(np.int16)
            a, b = values[:half], values[half:]
            apart = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a.astype(np.float32) @ b.T.astype(np.float32)) if half else np.zeros((1, 0))
            cost, balls, chance = [0.0], 0, 0.0
            for t in range(tau + 1):
                balls += len(list(combinations(range(len(part)), t))) if t else 1
                seen = float((apart <= t).mean()) if apart.size else 0.0
                chance = max(seen, balls * 2.0 ** -len(part))
                cost.append(ROW_COST * n * (1 + balls) + CANDIDATE_COST * chance * n * n / 2)
            costs.append(cost)
        total, chosen = allocate(costs, tau)
        if total < best[0]:
            best = (total, [(p, t) for p, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _value(fp: str, bits: list[int]):
    mask = sum(1 << b for b in bits)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _flips(part: list[int], t: int) -> list[int]:
    """XOR masks of up to t bits of a part, as signed numbers."""
    masks = [sum(1 << b for b in chosen) for k in range(t + 1) for chosen in combinations(part, k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(fps: DataFrame, tau: int = 3) -> DataFrame:
    """u, v: pairs (u < v) of the distinct fingerprints in column fp that differ in at most tau bits; a pair may come more than once.

    A value shared by more than HEAVY fingerprints is divided: those agree in its part but for the flipped bits, and of the remaining bits at
    least one of tau + 1 groups agrees fully, so they meet again under (value, group's value). All pairs within tau bits are found.
    """
    n = fps.count()
    rows = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    parts = plan_parts(np.array([r[0] for r in rows], np.int64).view(np.uint64), max(n, 1), tau)

    # all parts in one table: (part, value) of each fingerprint, and of all values within the part's threshold of its own
    entries = lambda flips_of: F.explode(F.array(*(F.struct(F.lit(k).alias("part"), _value("fp", part).bitwiseXOR(F.lit(m)).alias("value")) for k, (part, t) in enumerate(parts) for m in flips_of(part, t))))
    index = fps.select("fp", entries(lambda part, t: [0]).alias("e")).select("fp", "e.*")
    probes = fps.select("fp", entries(_flips).alias("e")).select("fp", "e.*")
    heavy = index.groupBy("part", "value").count().filter(F.col("count") > HEAVY).select("part", "value", F.lit(True).alias("heavy"))
    whole = F.array(F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("sub")))
    finer = None
    for k, (part, _) in enumerate(parts):
        rest = [b for b in range(64) if b not in part]
        groups = F.array(*(F.struct(F.lit(g).alias("g"), _value("fp", rest[g :: tau + 1]).alias("sub")) for g in range(tau + 1)))
        finer = F.when(F.col("part") == k, groups) if finer is None else finer.when(F.col("part") == k, groups)

    def divided(side: DataFrame) -> DataFrame:
        keys = F.explode(F.when(F.col("heavy"), finer).otherwise(whole)).alias("key")
        return side.join(heavy, ["part", "value"], "left").select("fp", "part", "value", keys).select("fp", "part", "value", "key.*")

    left, right = divided(index).withColumnRenamed("fp", "u"), divided(probes).withColumnRenamed("fp", "v")
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau)
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("part", "value", "g", "sub")] + [close]).select("u", "v")


def link(docs: DataFrame, tau: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without their text, with fp (signed) and component_id: the smallest doc_id that is reachable over fingerprints at most tau bits apart.

    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other; a text of any length counts as a whole. A null doc_id is never a component_id unless
    its component has no other; ids may be of any type that has an order. Repeated rows and equal texts get the same component; an empty table gives an empty table.
    Existing columns of the new names are replaced, others stay as they are.
    """
    # fingerprints are taken once and stored beside the other columns
    docs = stored(with_fingerprints(docs.drop("fp", "component_id"), text).drop(text), "fingerprinted")
    classes = components(docs, tau, doc_id).drop("root")
    return docs.join(classes, "fp", "left").select(*docs.columns, "component_id")


def components(prints: DataFrame, tau: int = 3, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """fp, component_id and root (its smallest fingerprint): a row for each distinct fingerprint in column fp of prints."""
    distinct = stored(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first_id")), "fingerprints")
    roots = connected_components(near_pairs(distinct.select("fp"), tau))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return joined.join(least, "root").select("fp", "component_id", "root")


def keep_one(docs: DataFrame, tau: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id; of repeated rows of that, one, and of several texts of that document that are near, any.

    A component without any doc_id keeps one row too. Null and empty texts make a component; texts of any length count as a whole; an empty table gives an empty table; columns stay as they are, whatever their names.
    """
    own, first, root = (unused(docs, n) for n in ("fp", "first", "root"))
    prints = stored(with_fingerprints(docs, text, own), "fingerprinted")
    classes = components(prints, tau, doc_id, own).select(F.col("fp").alias(own), F.col("component_id").alias(first), F.col("root").alias(root))
    kept = prints.join(classes, own).filter(F.col(doc_id).eqNullSafe(F.col(first)))
    return kept.dropDuplicates([root, doc_id]).select(*docs.columns)
