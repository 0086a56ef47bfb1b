"""Token counts of a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

A unigram tokenizer takes the segmentation of highest total score. The best score of a prefix does not depend on what follows,
so pre-tokens with a common prefix share its scores: distinct pre-tokens go into a trie, each new node gets its best score and number of tokens
once, from the nodes above it, and a pre-token's count stands at its last node. Scores are whole numbers, so that ties
are exact; a tie goes to fewer tokens.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MAX_VOCABULARY_BYTES, read_ranks
from .common import kept

#: Nodes of a worker's trie; it starts anew when it is full. Scores are logarithms in units of 2^-20.
MAX_NODES, UNIT = 250_000, 1 << 20
#: Cost of a byte that no token covers.
UNKNOWN = 40 * UNIT


def zipf_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Minus the log-probability of each token, if its frequency falls as Zipf's law says with its rank.

    Rank files hold no probabilities, and tokenizers aren't trained here.
    """
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(ranks))))
    return {token: round((math.log(rank + 2.7) + norm) * UNIT) for token, rank in ranks.items()}


class TrieCounter:
    """Counts tokens of pre-tokens. Node: (children by byte, best cost, tokens)."""

    def __init__(self, costs: dict[bytes, int], pattern: str):
        self.costs, self.pieces_of = costs, regex.compile(pattern).findall
        self.longest = max(map(len, costs), default=1)
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes, self.counts = ({}, 0, 0), 1, {}

    def insert(self, piece: str) -> int:
        """The number of tokens of a pre-token, whose new nodes are scored on the way."""
        data, costs, longest = piece.encode(), self.costs, self.longest
        path = [self.root]
        node = self.root
        for end in range(1, len(data) + 1):
            child = node[0].get(data[end - 1])
            if child is None:
                best, tokens = path[end - 1][1] + UNKNOWN, path[end - 1][2] + 1
                for start in range(max(0, end - longest), end):
                    cost = costs.get(data[start:end])
                    if cost is not None:
                        above = path[start]
                        total = above[1] + cost
                        if total < best or total == best and above[2] + 1 < tokens:
                            best, tokens = total, above[2] + 1
                child = node[0][data[end - 1]] = ({}, best, tokens)
                self.nodes += 1
            node = child
            path.append(node)
        return node[2]

    def count(self, text: str) -> int:
        if self.nodes > MAX_NODES:
            self.clear()
        known, total = self.counts, 0
        for piece in self.pieces_of(text):
            n = known.get(piece)
            if n is None:
                n = self.insert(piece) if len(piece) <= 64 else self.alone(piece)
                if len(piece) <= 64:
                    known[piece] = n
            total += n
        return total

    def alone(self, piece: str) -> int:
        """A very long pre-token, which would fill the trie with nodes that nothing shares, by the same recurrence over an array."""
        data, costs, longest = piece.encode(), self.costs, self.longest
        best = [(0, 0)]
        for end in range(1, len(data) + 1):
            options = [(best[end - 1][0] + UNKNOWN, best[end - 1][1] + 1)]
            for start in range(max(0, end - longest), end):
                cost = costs.get(data[start:end])
                if cost is not None:
                    options.append((best[start][0] + cost, best[start][1] + 1))
            best.append(min(options))
        return best[-1][1]


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens. A null or empty text has none; a text of any length is counted as a whole.

    Each worker keeps its trie from task to task, up to MAX_NODES nodes. Of segmentations with one score that of fewest tokens counts. Repeated rows count alike; an empty table gives an empty table; an existing column n_tokens is replaced, others stay as they are.
    """
    ranks = read_ranks(vocabulary)
    if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than what may be broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(zipf_costs(ranks))
    key = hashlib.sha256(b"".join(sorted(ranks)) + pattern.encode()).hexdigest()
    docs = docs.drop("n_tokens")

    @F.arrow_udf("long")
    def counted(column: pa.Array) -> pa.Array:
        counter = kept("trie", key, lambda: TrieCounter(shared.value, pattern))
        return pa.array([counter.count(t) if t else 0 for at in range(0, len(column), 128) for t in column.slice(at, 128).to_pylist()], pa.int64())

    return docs.withColumn("n_tokens", counted(F.col(text).cast("string")))
