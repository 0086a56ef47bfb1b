"""Byte-level BPE by backtracking over longest matches.

The text's bytes, read as Latin-1, go through an Aho-Corasick automaton of the vocabulary, which gives all tokens that
start at each place. A token sequence is the one that merging would make exactly if each pair of neighbours in it is:
if merging the bytes of the two alone gives them back. So the encoder takes the longest token that is compatible with its
left neighbour, shorter ones after that, and steps back where none is left; places found to be dead ends are not tried again,
and compatibility is remembered, which keeps the work in proportion to the length.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, unused

#: Remembered pairs and pre-tokens in a worker; the memory is emptied when it is full.
MAX_PAIRS, MAX_PIECES = 250_000, 200_000
#: A rank file may be broadcast up to this size.
MAX_VOCABULARY_BYTES = 32 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens: base64 and rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces_of = regex.compile(pattern).findall
        self.pairs: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: for short strings only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        none, rank_of = 1 << 60, ranks.get
        pairs = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]  # of each part with the next one; only those beside a merge change
        while pairs and (rank := min(pairs)) != none:
            at = pairs.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank_of(parts[at] + parts[at + 1], none)
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def backtrack(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        text, n = data.decode("latin-1"), len(data)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by start, shortest first
        for end, (length, rank) in self.automaton.iter(text):
            starting[end - length + 1].append((length, rank))
        dead, remembered = bytearray(n + 1), self.pairs.get
        out: list[tuple[int, int, int]] = []  # start, choices left, id
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            options = starting[at]
            while choice >= 0:
                length, rank = options[choice]
                if not dead[at + length]:
                    if not out:
                        break
                    left = out[-1][2]
                    known = remembered(left << 32 | rank)
                    if known or known is None and self.compatible(left, rank):
                        break
                choice -= 1
            if choice >= 0:
                out.append((at, choice, rank))
                at += length
                choice = len(starting[at]) - 1 if at < n else -1
            elif not out:
                return self.merged(data)  # the vocabulary lacks single bytes, or holds tokens that merging cannot make
            else:
                dead[at] = 1
                at, choice, _ = out.pop()
                choice -= 1
        return [rank for _, _, rank in out]

    def pack(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.backtrack(data)
        if len(self.packed) >= MAX_PIECES:
            self.packed.clear()
        if len(piece) <= 64:
            self.packed[piece] = struct.pack(f"<{len(ids)}I", *ids)
            return self.packed[piece]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.packed, []
        for piece in self.pieces_of(text):
            got = known.get(piece)
            out.append(got if got is not None else self.pack(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", digests: bool = True) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit) and n_tokens; with digests, ids_sha256 and decoded_sha256 too.

    The rank file is read on the driver and broadcast; one beyond MAX_VOCABULARY_BYTES is refused. A null text counts as empty: no ids. A text of any length is encoded as a whole. Rows are independent, so
    repeated rows, ties, ids of any type and empty tables need no rule; existing columns of the new names are replaced, others stay as they are.
    """
    ranks = read_ranks(vocabulary)
    if sum(map(len, ranks)) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than what may be broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(b"".join(sorted(ranks))).hexdigest()
    names = ["n_tokens", "ids", *(["ids_sha256", "decoded_sha256"] if digests else [])]
    kinds = {"n_tokens": pa.int64(), "ids": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    docs = docs.drop(*kinds)

    @F.arrow_udf("struct<" + ",".join(f"{n}:{ {pa.int64(): 'bigint', pa.binary(): 'binary', pa.string(): 'string'}[kinds[n]] }" for n in names) + ">")
    def encode(column: pa.Array) -> pa.Array:
        coder = kept("bpe", (key, pattern), lambda: BytePairEncoder(shared.value, pattern))
        out: dict[str, list] = {n: [] for n in names}
        for at in range(0, len(column), 64):
            for value in column.slice(at, 64).to_pylist():
                ids = coder.encode(value or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids"].append(ids)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(out[n], kinds[n]) for n in names], names)

    own = unused(docs, "encoded")
    return docs.withColumn(own, encode(F.col(text).cast("string"))).select(*docs.columns, f"{own}.*")


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the bytes that the ids in column `ids` stand for, in column `to`, which is replaced if it is there.

    Null ids decode to null, empty ones to no bytes; an id that the vocabulary lacks is an error. Rows are independent; an empty table gives an empty table.
    """
    ranks = read_ranks(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        tokens = shared.value
        return pa.array([None if x is None else b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in column.to_pylist()], pa.binary())

    return encoded.withColumn(to, decode(ids))
