import random

import pytest

LONG = "lorem ipsum dolor " * 12000

TAKEN = ["_bytes", "_at", "_offset", "_doc", "_th", "_spans", "_fp", "_FIRST", "_root", "_encoded", "_judged", "_hash", "_id", "_row", "_range", "_text", "text_crc32", "slot"]

#: doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, fp long, size string, component_id string, contaminated int, ids int, _note string, " + ", ".join(f"`{n}` int" for n in TAKEN)


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 0.5, 1, 2, "x", "y", 3, 4, "z", *range(len(TAKEN)))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns of clashing names."""
    rows = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, LONG), row(5, "a b"), row(5, "a b"), row(None, "text without id"), row(7, "é ñ 漢字 🙂 ſ", None), row(8, "x" * 50_000), (None,) * (13 + len(TAKEN))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, first=0):
        return spark.createDataFrame([row(first + k, t) for k, t in enumerate(texts)], SCHEMA)

    return build


@pytest.fixture()
def prose():
    """Sentences of words that hardly repeat."""
    rng = random.Random(7)

    def build(n, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))

    return build
