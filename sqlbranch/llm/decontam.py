"""Benchmark decontamination with a positional inverted index that is split by document.

Each block of documents, a row of the index table, keeps the sorted word hashes of its documents and for each the sorted positions at which it
occurs. A query is sent to all blocks: for each run of test words a block takes the positions of the rarest one,
less its offset, and intersects them with those of the next rarest, until none is left or all words agree. No posting crosses the network,
and a word that is frequent everywhere costs no more than its occurrences in a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, as_bytes, unused

#: A block is closed once it holds this many words; a longer document makes a block by itself.
BLOCK_WORDS = 1 << 17
#: Test words broadcast at a time, 8 bytes each; a larger test set is broadcast in several parts, which each block is searched for one after another.
QUERY_WORDS = 4 << 20
#: Blocks of an index that are searched for a part of the test set before the next part is loaded.
BLOCKS = 16
#: Free positions between documents. A phrase or neighbourhood of up to this length stays in one document.
GAP = 64

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased) and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


class Query:
    """Windows of test words: as rows of word numbers (-1 beyond a short item's end), with the items that hold each."""

    def __init__(self, items: Iterable[tuple[object, bytes]], width: int):
        hashed, windows = Hasher(), {}
        self.names: list[str] = []
        numbers: dict[object, int] = {}
        for item, text in items:
            words = hashed.array(words_of(text))
            if len(words):
                number = numbers.setdefault(item, len(numbers))
                if number == len(self.names):
                    self.names.append("" if item is None else str(item))
                for at in range(max(1, len(words) - width + 1)):
                    windows.setdefault(words[at : at + width].tobytes(), {})[number] = None
        self.items = [[self.names[n] for n in x] for x in windows.values()]
        self.lengths = np.array([len(w) // 8 for w in windows], np.int64)
        padded = np.zeros((len(windows), width), np.uint64)
        for row, w in zip(padded, windows):
            row[: len(w) // 8] = np.frombuffer(w, np.uint64)
        self.terms, flat = np.unique(padded, return_inverse=True)
        self.grid = flat.reshape(padded.shape)
        self.used = np.arange(width) < self.lengths[:, None]


def queries(items: DataFrame, width: int, text: str = "text", item: str = "item_id") -> Iterator[Query]:
    """The test set, QUERY_WORDS words at a time; it is never in the driver as a whole. An item longer than that makes a part by itself."""
    held, size = [], 0
    for row in items.select(F.col(item), as_bytes(text)).toLocalIterator():
        more = (len(row[1]) // 2 + 1) * width
        if held and size + more > QUERY_WORDS:
            yield Query(held, width)
            held, size = [], 0
        held.append((row[0], bytes(row[1])))
        size += more
    if held:
        yield Query(held, width)


class Parts:
    """The test set as broadcasts, of which a worker holds one at a time; the others stay in its executor's files."""

    def __init__(self, items: DataFrame, width: int):
        context = items.sparkSession.sparkContext
        self.broadcasts = [context.broadcast(q) for q in queries(items, width)]

    def __iter__(self) -> Iterator[Query]:
        for part in self.broadcasts:
            yield part.value
            if len(self.broadcasts) > 1:
                del part._value


class Block:
    """Postings of some documents. starts: the first position of each document; they lie GAP positions apart."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, bounds: np.ndarray, positions: np.ndarray):
        self.lengths, self.terms, self.bounds, self.positions = lengths, terms, bounds, positions
        self.starts = np.r_[0, np.cumsum(lengths + GAP)[:-1]].astype(np.int64)
        self.hit = np.zeros(int(lengths.sum()) + GAP * len(lengths), bool)
        self.found: list[set] = [set() for _ in lengths]
        self.near: list[set] = [set() for _ in lengths]

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Block:
        lengths = np.array([len(d) for d in documents], np.int64)
        hashes = np.concatenate([*documents, np.empty(0, np.uint64)])
        places = np.arange(len(hashes)) + np.repeat(np.arange(len(documents)) * GAP, lengths)
        order = np.argsort(hashes, kind="stable")
        terms, bounds = np.unique(hashes[order], return_index=True)
        return cls(lengths, terms, np.r_[bounds, len(hashes)], places[order])

    def search(self, query: Query, near: int) -> None:
        """Marks the words inside phrase matches, and the items with phrase and proximity matches in each document."""
        if not len(query.lengths) or not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, query.terms), len(self.terms) - 1)
        there = self.terms[at] == query.terms
        counts = np.where(there, self.bounds[at + 1] - self.bounds[at], 0)
        have = np.where(query.used, counts[query.grid], 1 << 60)
        lists = lambda term: self.positions[self.bounds[at[term]] : self.bounds[at[term] + 1]]
        for w in np.flatnonzero(have.min(axis=1) > 0).tolist():
            n = int(query.lengths[w])
            order = np.argsort(have[w, :n], kind="stable").tolist()
            terms = query.grid[w, :n].tolist()
            rarest = lists(terms[order[0]])
            starts = rarest - order[0]
            for k in order[1:]:
                other = lists(terms[k])
                spot = np.minimum(np.searchsorted(other, starts + k), len(other) - 1)
                starts = starts[other[spot] == starts + k]
                if not len(starts):
                    break
            exact = set()
            if len(starts):
                for start in starts.tolist():
                    self.hit[start : start + n] = True
                exact = set((np.searchsorted(self.starts, starts, "right") - 1).tolist())
                for d in exact:
                    self.found[d].update(query.items[w])
                    self.near[d].update(query.items[w])
            if near and n > 1:
                rarest = lists(terms[order[0]])
                if exact:  # what has the window itself needs no second look
                    rarest = rarest[~np.isin(np.searchsorted(self.starts, rarest, "right") - 1, list(exact))]
                for k in order[1:]:
                    if not len(rarest):
                        break
                    other = lists(terms[k])
                    after = np.searchsorted(other, rarest - near)
                    rarest = rarest[(after < len(other)) & (other[np.minimum(after, len(other) - 1)] <= rarest + near)]
                spread = [lists(t) for t in dict.fromkeys(terms)] if len(rarest) else []
                close = [p for p in rarest.tolist() if self._within([x[np.searchsorted(x, p - near) : np.searchsorted(x, p + near, "right")] for x in spread], near)]
                for d in set((np.searchsorted(self.starts, close, "right") - 1).tolist()):
                    self.near[d].update(query.items[w])

    @staticmethod
    def _within(places: list[np.ndarray], near: int) -> bool:
        """Whether one place of each list can be chosen so that all lie at most `near` apart."""
        marked = sorted((p, k) for k, x in enumerate(places) for p in x.tolist())
        last: dict[int, int] = {}
        for p, k in marked:
            last[k] = p
            if len(last) == len(places) and p - min(last.values()) <= near:
                return True
        return False

    def results(self) -> dict[str, list]:
        total = np.r_[0, np.cumsum(self.hit)]
        n_hit = (total[self.starts + self.lengths] - total[self.starts]).tolist() if len(self.lengths) else []
        found = [sorted(x) for x in self.found]
        return {
            "n_words": self.lengths.tolist(), "n_hit": n_hit, "n_items": [len(x) for x in found],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found],
            "contaminated": [n > 0 for n in n_hit], "n_near_items": [len(x) for x in self.near], "items": found,
        }


_RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near_items", pa.int64()), ("items", pa.list_(pa.string()))])
_RESULT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long, items array<string>"


def _searched(blocks: list[Block], parts: Iterable[Query], near: int) -> list[dict[str, list]]:
    """All blocks are searched for one part before the next is loaded."""
    for query in parts:
        for block in blocks:
            block.search(query, near)
    return [block.results() for block in blocks]


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index of all words of all documents, a row for each block; write it, with small row groups, to search it often.

    doc_ids are kept as long numbers, or null. Null and empty texts have no words but stay in the index; repeated rows are rows of their own; a longer text than a block makes one by itself; no documents make no blocks.
    """

    def index(batches):
        hashed = Hasher()
        ids, held, size = [], [], 0

        def row():
            block = Block.of(held)
            deltas = np.diff(block.positions, prepend=0).astype("<i4")
            columns = [ids, block.lengths, block.terms.view(np.int64), block.bounds, deltas.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for key, data in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    ids.append(key)
                    held.append(hashed.array(words_of(data)))
                    size += len(held[-1]) + GAP
                    if size >= BLOCK_WORDS:
                        yield row()
                        ids, held, size = [], [], 0
        if ids:
            yield row()

    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())), ("positions", pa.binary())])
    return docs.select(F.col(doc_id).cast("long"), as_bytes(text)).mapInArrow(index, "doc_ids array<long>, lengths array<long>, terms array<long>, bounds array<long>, positions binary")


def search_index(index: DataFrame, items: DataFrame, width: int = 10, near: int = 15) -> DataFrame:
    """For each indexed document what flag_contaminated() says of it, with its doc_id.

    Rows of the index are whole blocks, so any split of them over tasks gives the same result. Nulls, ties, repeated rows, long texts and empty tables are treated as there.
    """
    shared = Parts(items, width)
    schema = pa.schema([("doc_id", pa.int64()), *_RESULT])

    def search(batches):
        for batch in batches:
            step = BLOCKS if len(shared.broadcasts) > 1 else 1
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                blocks = []
                for at in range(part.num_rows):
                    _, lengths, terms, bounds, deltas = (c[at] for c in part.columns)
                    numbers = lambda x: x.values.to_numpy(zero_copy_only=False)
                    positions = np.cumsum(np.frombuffer(deltas.as_buffer(), "<i4"), dtype=np.int64)
                    blocks.append(Block(numbers(lengths), numbers(terms).view(np.uint64), numbers(bounds), positions))
                for at, found in enumerate(_searched(blocks, shared, near)):
                    out = {"doc_id": part.column(0)[at].values} | found
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return index.mapInArrow(search, f"doc_id long, {_RESULT_DDL}")


def flag_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, near: int = 15, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside a window of `width` words of an item, or of a whole shorter item), n_items and
    items (those with such windows), items_sha256, contaminated (n_hit > 0) and n_near_items.

    n_near_items counts, besides those, the items of which some window has all its words at most `near` places apart, in any order.
    The blocks are indexed and searched in one pass, and nothing is stored. A null text has no words; items without
    words are never found; an item_id that comes more than once counts once, a null one as an empty name. Repeated documents, and those that tie in any way, are judged
    alike; a text of any length is searched as a whole, in a block of its own if it is long; ids of any type stay as they are. Empty tables on either side give no rows or no hits.
    Existing columns of the new names are replaced, others stay as they are.
    """
    docs = docs.drop(*_RESULT.names)
    shared = Parts(items, width)
    names = docs.columns

    def flag(batches):
        hashed = Hasher()
        for batch in batches:
            held, sizes, last = [[]], [0], [0]
            for at in range(batch.num_rows):
                words = hashed.array(words_of(batch.column(len(names))[at].as_py()))
                if sizes[-1] and sizes[-1] + len(words) + GAP > BLOCK_WORDS:
                    held.append([])
                    sizes.append(0)
                    last.append(at)
                held[-1].append(words)
                sizes[-1] += len(words) + GAP
            if not batch.num_rows:
                continue
            for first, found in zip(last, _searched([Block.of(d) for d in held], shared, near)):
                part = batch.slice(first, len(found["n_words"]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(pa.array(found[f.name], f.type) for f in _RESULT)], names=[*names, *_RESULT.names])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [_RESULT_DDL])
    body = unused(docs, "bytes")
    return docs.withColumn(body, as_bytes(text)).select(*docs.columns, body).mapInArrow(flag, ddl)
