"""Toxicity by two class-conditional Kneser-Ney models.

Both models are learnt from the distinct texts of labelled documents, over all of their words. A word counts, as Kneser and Ney count for lower orders, once for each distinct word that it follows,
so copies of a passage are no evidence; pairs of words count by their occurrences. Each count is discounted by what the counts that both classes share predict of it and
by DISCOUNT standard errors, and what is left is added to the shared distribution. A rare word thus has its share in the counts of its beginning (of six, five and four bytes, below a
root for all words), and pairs of which neither class has more than their words explain back off to those. A text scores by its length-normalised log-likelihood ratio, of the whole and of its most suspicious
passages of some lengths, mapped to 0..1 by a logistic curve that is fitted on texts that the models haven't seen.

Notation: c is a class (1 toxic, 0 ordinary), x0 and x1 are the counts of a child, m0 and m1 those of its parent; share = (x0 + x1) / (m0 + m1), the expected count is
m_c * share, e_c is x_c less that, brought nearer to 0 by DISCOUNT * (1 + root of the expected count), and p_c(child | parent) is share + e_c / m_c, normalised over the children.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, stored

#: Standard errors of a count, by which it is discounted.
DISCOUNT = 3.0
#: Bytes of the beginnings of words, and words of the passages that a text is normalised over besides the whole.
BEGINNINGS, PASSAGES = (4, 5, 6), (4, 16, 64)
#: Labelled texts that the logistic curve is fitted on, about; at most an eighth of all. The models are counted over all others.
CURVE_ROWS = 4000
#: Weights (16 bytes each) in a part of the models. Parts are collected, broadcast and looked up one after another, so memory doesn't follow their number.
PART_WEIGHTS = 2 << 20
#: Labelled texts (about 100 bytes each, without the text) that may be broadcast to fetch their texts; more are joined by a merge.
BROADCAST_IDS = 300_000
#: Words that a worker keeps between texts, and tokens that a task gathers before it counts them.
KEPT_WORDS, GATHERED = 200_000, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: A text's first word follows this one, of this key.
_START, _START_KEY = b"", len(BEGINNINGS) + 1 << 48


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters (A-Z lower-cased), digits and non-ASCII characters."""
    return _WORD.findall(text.translate(_LOWER))


def numbers_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key and longest beginning of each word, the latter as a number of six bytes, zeros after a shorter word, which is its own key. The key of a longer word is a hash with the highest bit set."""
    longest = BEGINNINGS[-1]
    begun = np.fromiter((int.from_bytes(w[:longest].ljust(longest, b"\0"), "big") for w in words), np.uint64, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) if len(w) > longest else 0 for w in words), np.uint64, len(words))
    return np.where(hashes > 0, hashes | np.uint64(1 << 63), begun | np.uint64(len(BEGINNINGS) + 1 << 48)), begun


def _rotated(x, bits: int):
    """Of 64 bits; x is an array or a column."""
    if isinstance(x, np.ndarray):
        return x << np.uint64(bits) | x >> np.uint64(64 - bits)
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _tagged(begun, k: int):
    """Key of the beginning k of a word, from its longest one."""
    bits = 8 * (BEGINNINGS[-1] - BEGINNINGS[k])
    if isinstance(begun, np.ndarray):
        return begun >> np.uint64(bits) | np.uint64((k + 1) << 48)
    return F.shiftright(begun, bits).bitwiseOR(F.lit((k + 1) << 48))


def _pair_counts(training: DataFrame) -> DataFrame:
    """left, word (keys), begun (the longest beginning of a word that is longer, else 0), n0 and n1: occurrences of each pair of words in each class. Tasks sum before they pass on."""

    def count(batches):
        numbers: dict[bytes, int] = {_START: 0}
        held: list[np.ndarray] = []
        size = 0

        def flushed():
            nonlocal size
            keys, begun = numbers_of(list(numbers))
            begun[keys >> np.uint64(63) == 0] = 0
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            toxic = (pairs & 1).astype(bool)
            left, word = keys[pairs >> 32], pairs >> 1 & 0x7FFFFFFF
            columns = [left.view(np.int64), keys[word].view(np.int64), begun[word].view(np.int64), np.where(toxic, 0, counts), np.where(toxic, counts, 0)]
            for at in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], names=["left", "word", "begun", "n0", "n1"])
            numbers.clear()
            numbers[_START] = 0
            held.clear()
            size = 0

        for texts, classes in slices(batches):
            for body, toxic in zip(texts, classes):
                words = words_of(body)
                for w in words:
                    if w not in numbers:
                        numbers[w] = len(numbers)
                ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                held.append(np.r_[0, ids[:-1]][: len(ids)] << 32 | ids << 1 | toxic)
                size += len(ids)
                if size > GATHERED:
                    yield from flushed()
        if size:
            yield from flushed()

    counted = training.select("text", "toxic").mapInArrow(count, "left long, word long, begun long, n0 long, n1 long")
    return counted.groupBy("left", "word", "begun").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _excess(x: str, expected):
    """The count x less what is expected, nearer to 0 by the discount."""
    apart = F.col(x) - expected
    return F.signum(apart) * F.greatest(F.abs(apart) - DISCOUNT * (1 + F.sqrt(expected)), F.lit(0.0))


def _per(x, m: str):
    return F.when(F.col(m) > 0, x / F.col(m)).otherwise(0.0)


def _level(kids: DataFrame, parent: str) -> DataFrame:
    """kids (child, parent, x0, x1) with p0 and p1, their probabilities given the parent, and marked: whether a class differs from the other."""
    parents = kids.groupBy(parent).agg(F.sum("x0").alias("m0"), F.sum("x1").alias("m1"))
    share = (F.col("x0") + F.col("x1")) / (F.col("m0") + F.col("m1"))
    each = kids.join(parents, parent).withColumn("share", share).withColumns({f"e{c}": _excess(f"x{c}", F.col("share") * F.col(f"m{c}")) for c in (0, 1)})
    totals = each.filter("e0 != 0 OR e1 != 0").groupBy(parent).agg(*(F.sum(_per(F.col(f"e{c}"), f"m{c}")).alias(f"z{c}") for c in (0, 1)))
    out = each.join(totals, parent, "left").withColumn("marked", F.expr("e0 != 0 OR e1 != 0"))
    return out.withColumns({f"p{c}": (F.col("share") + _per(F.col(f"e{c}"), f"m{c}")) / (1 + F.coalesce(f"z{c}", F.lit(0.0))) for c in (0, 1)})


def _ratio(one, zero):
    return F.log(one) - F.log(zero)


def model_weights(training: DataFrame) -> DataFrame:
    """key, weight: what tokens add to a log-likelihood ratio, by their beginnings, words, words before them, and pairs. Key 0 is what each token adds.

    training: distinct texts with toxic (0 or 1). What isn't listed adds nothing.
    """
    pairs = _pair_counts(training)
    none, short = F.lit(0).cast("long"), F.lit((1 << 48) - 1)
    # the same exchange feeds both, so the texts are read once
    words = pairs.groupBy("word", "begun").agg(F.count_if(F.col("n0") > 0).alias("x0"), F.count_if(F.col("n1") > 0).alias("x1"), F.sum("n0").alias("m0"), F.sum("n1").alias("m1"))
    words = words.select(none.alias("left"), "word", F.when(F.col("word") < 0, F.col("begun")).otherwise(F.col("word").bitwiseAND(short)).alias("begun"), "x0", "x1", "m0", "m1")
    often = pairs.filter(F.col("n0") + F.col("n1") > DISCOUNT).select("left", "word", none.alias("begun"), F.col("n0").alias("x0"), F.col("n1").alias("x1"), none.alias("m0"), none.alias("m1"))
    counts = stored(words.withColumn("pair", F.lit(False)).unionByName(often.withColumn("pair", F.lit(True))), "toxicity-counts")
    words, often = counts.filter("NOT pair"), counts.filter("pair").select("left", "word", "x0", "x1")
    # how often a word stands before another or at the end; a text's start stands once in each
    start = training.groupBy().agg(F.lit(_START_KEY).alias("left"), F.count_if(F.col("toxic") == 0).alias("m0"), F.count_if(F.col("toxic") == 1).alias("m1"))
    heads = words.select(F.col("word").alias("left"), "m0", "m1").unionByName(start)
    words = words.select("word", "begun", "x0", "x1")

    names = ["root", *(f"b{k}" for k in range(len(BEGINNINGS))), "word"]
    chain = words.withColumns({"root": none} | {f"b{k}": _tagged(F.col("begun"), k) for k in range(len(BEGINNINGS))})
    levels, weights = [], None
    for parent, child in zip(names, names[1:]):
        kids = chain.groupBy(child, parent).agg(F.sum("x0").alias("x0"), F.sum("x1").alias("x1"))
        level = stored(_level(kids, parent).select(child, parent, "share", "marked", "e0", "e1", "z0", "z1", "p0", "p1"), f"toxicity-{child}")
        levels.append(level)
        marked = level.filter("marked")
        total = lambda c: 1 + F.coalesce(f"z{c}", F.lit(0.0))
        norms = marked.groupBy(parent).agg(F.max(_ratio(total(0), total(1))).alias("weight")).select(F.col(parent).alias("key"), "weight")
        own = marked.select(F.col(child).alias("key"), (_ratio(F.col("p1"), F.col("p0")) - _ratio(total(0), total(1))).alias("weight"))
        weights = own.unionByName(norms) if weights is None else weights.unionByName(own).unionByName(norms)

    # log-probabilities of the words of frequent pairs, down the chain
    logs = chain.join(often.select("word").distinct(), "word", "left_semi").select(*names[1:], F.lit(0.0).alias("l0"), F.lit(0.0).alias("l1"))
    for level, child in zip(levels, names[1:]):
        logs = logs.join(level.select(child, "p0", "p1"), child).withColumns({f"l{c}": F.col(f"l{c}") + F.log(f"p{c}") for c in (0, 1)}).drop("p0", "p1")
    met = often.join(heads, "left").join(logs.select("word", "l0", "l1"), "word")
    # what the words explain of the difference between the classes is no difference of the pair
    by_words = [F.col(f"m{c}") * F.exp(f"l{c}") for c in (0, 1)]
    explained = [(F.col("x0") + F.col("x1")) * w / (by_words[0] + by_words[1]) for w in by_words]
    marked = met.filter((_excess("x0", explained[0]) != 0) | (_excess("x1", explained[1]) != 0)).withColumn("share", (F.col("x0") + F.col("x1")) / (F.col("m0") + F.col("m1")))
    marked = marked.withColumns({f"p{c}": F.col("share") + _per(_excess(f"x{c}", F.col("share") * F.col(f"m{c}")), f"m{c}") for c in (0, 1)})
    per_head = marked.groupBy("left").agg(*(x for c in (0, 1) for x in (F.sum(f"p{c}").alias(f"s{c}"), F.sum(F.exp(f"l{c}")).alias(f"b{c}"), F.max(f"m{c}").alias(f"h{c}"))))
    per_head = per_head.withColumns({f"z{c}": F.greatest(F.lit(1.0), F.col(f"s{c}") + 1 / (F.col(f"h{c}") + 1)) for c in (0, 1)})
    left_over = [(1 - F.col(f"s{c}") / F.col(f"z{c}")) / F.greatest(1 - F.col(f"b{c}"), F.lit(1e-9)) for c in (0, 1)]
    per_head = per_head.select("left", "z0", "z1", _ratio(left_over[1], left_over[0]).alias("rest"))
    before = per_head.select(_rotated(F.col("left"), 7).alias("key"), F.col("rest").alias("weight"))
    after = _ratio(F.col("p1") / F.col("z1"), F.col("p0") / F.col("z0")) - (F.col("l1") - F.col("l0")) - F.col("rest")
    both = marked.join(per_head, "left").select(F.col("left").bitwiseXOR(_rotated(F.col("word"), 21)).alias("key"), after.alias("weight"))
    return weights.unionByName(before).unionByName(both).groupBy("key").agg(F.sum("weight").alias("weight"))


class Models:
    """Log-likelihood ratio (toxic over ordinary) of texts. parts: sorted keys with their weights, as pairs of arrays or broadcasts of such."""

    def __init__(self, parts: list, weights: np.ndarray | None = None, offset: float = -1.0):
        self.parts, self.weights, self.offset = parts, np.zeros(len(PASSAGES) + 1) if weights is None else weights, offset
        self._forget()

    def __getstate__(self):
        return self.parts, self.weights, self.offset

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes, self.alone, self.before, self.leads = (np.zeros(0, kind) for kind in (np.uint64, float, float, bool))
        self._take([_START])

    def looked_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each key, 0 if it isn't listed, and whether it is."""
        out, there = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for part in self.parts:
            listed, weights = part if isinstance(part, tuple) else part.value
            if len(listed):
                at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
                found = listed[at] == keys
                out[found] = weights[at[found]]
                there |= found
            if len(self.parts) > 1 and not isinstance(part, tuple):
                del part._value  # it stays in the executor's file
        return out, there

    def _take(self, words: list[bytes]) -> None:
        """Looks up all that a word adds by itself and as the one before another."""
        for w in words:
            self.numbers[w] = len(self.numbers)
        hashes, begun = numbers_of(words)
        keys = [np.zeros(len(words), np.uint64), hashes, *(_tagged(begun, k) for k in range(len(BEGINNINGS)))]
        alone = sum(self.looked_up(k)[0] for k in keys)
        before, leads = self.looked_up(_rotated(hashes, 7))
        self.hashes, self.alone, self.before, self.leads = (np.concatenate(x) for x in ((self.hashes, hashes), (self.alone, alone), (self.before, before), (self.leads, leads)))

    def ratios(self, texts: list[bytes]) -> list[np.ndarray]:
        """The log-likelihood ratio of each word of each text, given the one before it."""
        if len(self.numbers) > KEPT_WORDS:
            self._forget()
        split = [words_of(t) for t in texts]
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.numbers))
        if fresh:
            self._take(fresh)
        lengths = np.array([len(ws) for ws in split], np.int64)
        ids = np.fromiter((self.numbers[w] for ws in split for w in ws), np.int64, int(lengths.sum()))
        ends = np.cumsum(lengths)
        left = np.r_[0, ids[:-1]][: len(ids)]
        left[(ends - lengths)[lengths > 0]] = 0
        out = self.alone[ids] + self.before[left]
        at = np.flatnonzero(self.leads[left])
        out[at] += self.looked_up(self.hashes[left[at]] ^ _rotated(self.hashes[ids[at]], 21))[0]
        return np.split(out, ends[:-1]) if len(ends) else []

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """For each text the highest mean ratio of a passage of each length (of the whole text if that is shorter), then that of the whole; 0 without words."""
        out = np.zeros((len(texts), len(PASSAGES) + 1))
        for row, ratios in zip(out, self.ratios(texts)):
            n = len(ratios)
            if n:
                sums = np.cumsum(np.r_[0.0, ratios])
                row[:] = [(sums[k:] - sums[: n + 1 - k]).max() / k for k in (min(n, length) for length in (*PASSAGES, n))]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.weights + self.offset, -30, 30)))

    def score(self, text: bytes) -> float:
        return float(self.scores([text])[0])


def _parts(weights: DataFrame) -> list:
    """Broadcasts of at most about PART_WEIGHTS weights each, by the remainder of the key."""
    n = -(-weights.count() // PART_WEIGHTS) or 1
    out = []
    for k in range(n):
        table = weights.filter(F.pmod("key", F.lit(n)) == k).toArrow()
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        part = keys[order], table.column("weight").to_numpy()[order]
        out.append(weights.sparkSession.sparkContext.broadcast(part) if n > 1 else part)
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Models:
    """Models of all labelled documents. Labels of one document or of equal texts that differ count as toxic; null labels are none, and neither are null doc_ids.

    Equal texts count once. Without documents of both classes there is no evidence, and every score is less than 0.5.
    """
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    source = docs.select(F.col(doc_id).alias("_id"), as_bytes(text).alias("text")).withColumns({"hash": F.xxhash64("text"), "size": F.octet_length("text")})
    # labels grow with the documents, so they are joined by a merge, with ids and hashes alone; one document stands for equal texts
    labelled = source.select("_id", "hash", "size").join(marks.hint("merge"), "_id").groupBy("hash", "size", "_id").agg(F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    chosen = stored(labelled.groupBy("hash", "size").agg(F.max("toxic").alias("toxic"), F.min_by(F.struct("_id", "n"), "_id").alias("first")).select("hash", "size", "toxic", "first.*"), "toxicity-chosen")
    n, most = chosen.agg(F.count("*"), F.max("n")).first()
    few = chosen.drop("n").hint("broadcast" if n <= BROADCAST_IDS else "merge")
    training = source.join(few, ["_id", "hash", "size"]).select("hash", "toxic", "text")
    training = stored(training.dropDuplicates(["hash"]) if (most or 0) > 1 else training, "toxicity")
    share = min(1 / 8, CURVE_ROWS / max(n, 1))
    sampled = F.pmod(F.xxhash64("hash", F.lit(3)), F.lit(1 << 31)) < round(share * (1 << 31))
    weights = stored(model_weights(training.filter(~sampled)), "toxicity-weights")
    models = Models(_parts(weights))
    names = [f"e{k}" for k in range(len(PASSAGES) + 1)]

    def measured(batches):
        for texts, classes in slices(batches):
            found = models.evidence(texts)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), *(pa.array(c) for c in found.T)], names=["toxic", *names])

    points = training.filter(sampled).select("text", "toxic").mapInArrow(measured, "toxic int, " + ", ".join(f"{c} double" for c in names)).collect()
    models.weights, models.offset = _curve(np.array([p[1:] for p in points]).reshape(-1, len(names)), np.array([p[0] for p in points], float))
    return models


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic curve, with both classes of equal weight, by Newton's steps with a little shrinkage. Without both classes, the mean ratio alone counts."""
    if not len(x) or y.min() == y.max():
        return np.r_[np.zeros(x.shape[1] - 1), 1.0], -1.0
    middle, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a, b = np.c_[(x - middle) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        hessian = a.T @ (a * (weight * p * (1 - p))[:, None]) + 0.05 * np.eye(len(b))
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - 0.05 * b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1] / scale, float(b[-1] - (b[:-1] * middle / scale).sum())


def score_toxicity(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """docs with score (0 to 1). Null and empty texts have no evidence either way; nothing but the text counts.

    A text of any length is scored as a whole. Repeated rows score alike; an empty table gives an empty table; an existing column score is replaced.
    """
    docs = docs.drop("score")

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        step = 128 if len(models.parts) == 1 else len(column)
        return pa.array(np.concatenate([np.empty(0), *(models.scores(column.slice(at, step).to_pylist()) for at in range(0, len(column), step))]))

    return docs.withColumn("score", scored(as_bytes(text)))


def held_out(doc_id: str = "doc_id"):
    """True where labels must not be learnt from: crc32 of the doc_id as text leaves 1, divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
