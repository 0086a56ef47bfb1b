"""Quality rules: how far a document's histograms lie from those of its language.

Two references for each language are gathered from all documents: shares of character classes, and shares of the language's most
frequent words among all words. A document is compared with both by Jensen-Shannon distance (the root of the divergence, base 2), if it has
enough words for its histogram to mean something. Base rules on length and repetition come before.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Interner, as_bytes, per_row, slices, stored

#: A document needs so many words.
MIN_WORDS = 50
#: Largest distances from the language's reference that are kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.5
#: Frequent words of a language.
COMMON_WORDS = 64
#: References may be broadcast up to so many languages and bytes of their words; documents are joined with theirs where there is more, which gives the same.
MAX_LANGUAGES, MAX_REFERENCE_BYTES = 2000, 8 << 20

#: Character classes: lower-case, upper-case, digits, white space, symbols, other ASCII, the rest.
CLASSES = 7
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def _class(byte: int) -> int:
    if byte >= 128:
        return 6 if byte >= 192 else 7  # a character counts at its first byte
    if 97 <= byte <= 122 or 65 <= byte <= 90:
        return 0 if byte >= 97 else 1
    return 2 if 48 <= byte <= 57 else 3 if byte in _SPACE else 4 if byte in _SYMBOLS else 5


_CLASS_OF = np.array([_class(b) for b in range(256)], np.uint8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of `width` words that come more than once."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    keys = ids[:n]
    for k in range(1, width):
        _, keys = np.unique(keys, return_inverse=True)
        keys = keys * (int(ids.max()) + 1) + ids[k : k + n]
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / middle), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, classes (characters of each class), words (its COMMON_WORDS most frequent ones) and shares (of them among all words).

    Every document counts. Tasks count words themselves and pass on sums; ties at the last place go to the words of lower bytes.
    """

    def count(batches):
        words: dict[object, Counter] = {}
        classes: dict[object, np.ndarray] = {}
        size = 0

        def flushed():
            rows = [(key, 1, w, n) for key, c in words.items() for w, n in c.items()]
            rows += [(key, 2, b"", sum(c.values())) for key, c in words.items()]
            rows += [(key, 0, b"%d" % k, int(n)) for key, c in classes.items() for k, n in enumerate(c)]
            words.clear()
            classes.clear()
            nonlocal size
            size = 0
            for at in range(0, len(rows), 50_000):
                part = list(zip(*rows[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema)], schema=schema)

        for texts, langs in slices(batches):
            for body, key in zip(texts, langs):
                words.setdefault(key, Counter()).update(body.translate(_LOWER).split())
                classes[key] = classes.get(key, 0) + class_counts(body)
                size += len(body)
            if sum(map(len, words.values())) > 300_000 or size > 64 << 20:
                yield from flushed()
        yield from flushed()

    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
    counted = docs.select(as_bytes(text), F.coalesce(F.col(lang).cast("string"), F.lit(""))).mapInArrow(count, "lang string, kind int, key binary, n long")
    summed = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "key")
    most = summed.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= max(COMMON_WORDS, CLASSES))
    listed = most.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("kind", "at", "key", "n"))).alias("rows"))
    of = lambda kind: F.filter("rows", lambda r: (r["kind"] == kind))
    by_class = F.transform(F.array_sort(F.transform(of(0), lambda r: F.struct(r["key"].cast("string").cast("int").alias("k"), r["n"]))), lambda r: r["n"])
    top = F.slice(of(1), 1, COMMON_WORDS)
    total = F.try_element_at(of(2), F.lit(1))["n"]
    return listed.select("lang", by_class.alias("classes"), F.transform(top, lambda r: r["key"]).alias("words"), F.transform(top, lambda r: r["n"] / total).alias("shares"))


class Judge:
    """Measures texts against references by language: (classes, words, shares). A text is compared over the common words of its own language, all others counting as one."""

    def __init__(self, references: dict[str, tuple[list[int], list[bytes], list[float]]]):
        self.references = {}
        for key, (classes, words, shares) in references.items():
            self.references[key] = np.array(classes, float), {w: k for k, w in enumerate(words)}, np.array([*shares, max(0.0, 1 - sum(shares))])
        self.ids = Interner()

    def __call__(self, text: bytes, lang: str, *_) -> tuple:
        words, counts = text.split(), class_counts(text)
        if len(self.ids) > 400_000:
            self.ids.clear()
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        repeats, n = repeated_words(ids), len(words)
        failed = n < MIN_WORDS or 100 * repeats > 50 * n
        by_class = by_word = None
        if n >= MIN_WORDS and lang in self.references:
            classes, index, spread = self.references[lang]
            found = np.zeros(len(spread))
            for w, k in Counter(text.translate(_LOWER).split()).items():
                found[index.get(w, -1)] += k
            by_class, by_word = jensen_shannon(counts.astype(float), classes), jensen_shannon(found, spread)
        kept = not failed and not (by_class or 0) > MAX_CLASS_DISTANCE and not (by_word or 0) > MAX_WORD_DISTANCE
        return n, int(counts.sum() - counts[3]), int(counts[4]), duplicate_lines(text), repeats, failed, kept, by_class, by_word


_SCHEMA = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge_quality(docs: DataFrame, references: DataFrame | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """key, the base counts, base_failed, kept, and the two distances of each document (null for fewer than MIN_WORDS words, or in a language without a reference).

    kept is false if the base rules fail or a distance exceeds its limit. A null text has no words, a null language is the same as an empty one. key may be of any type and null.
    Repeated rows and ties are judged alike; texts of any length are judged as a whole; an empty table gives an empty table; other columns are left out, whatever their names.
    """
    references = stored(language_references(docs, text, lang), "quality-references") if references is None else references
    size = references.agg(F.count("*"), F.sum(F.expr("aggregate(words, 0L, (n, w) -> n + octet_length(w))"))).first()
    wanted = docs.select(F.col(key), as_bytes(text).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"))
    kind = wanted.schema[0].dataType
    schema = pa.schema([wanted.select(F.col(key)).limit(0).toArrow().schema.field(0), *_SCHEMA])
    ddl = f"`{key}` {kind.simpleString()}, {_DDL}"
    if size[0] <= MAX_LANGUAGES and (size[1] or 0) <= MAX_REFERENCE_BYTES:
        plain = {r[0]: (list(r[1]), [bytes(w) for w in r[2]], list(r[3])) for r in references.collect()}

        def judge(batches):
            measure = Judge(plain)
            yield from per_row(lambda k, t, la: (k, *measure(t, la)), schema)(batches)

        return wanted.mapInArrow(judge, ddl)

    def judge_joined(batches):
        def one(k, t, la, classes, words, shares):
            return k, *Judge({} if classes is None else {la: (classes, words, shares)})(t, la)

        yield from per_row(one, schema)(batches)

    by_lang = references.select(F.col("lang").alias("_lang"), "classes", "words", "shares")
    joined = wanted.join(by_lang, "_lang", "left").select(F.col(key), "_text", "_lang", "classes", "words", "shares")
    return joined.mapInArrow(judge_joined, ddl)
