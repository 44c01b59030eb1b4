"""Byte-level BPE by automaton: longest matches, backtracking, and memoised compatibility of neighbours.

A chain of tokens is what the merges would give exactly when every two neighbours are: a token, then
the next one, are compatible if no merge across their border would have come before theirs. So a
piece is encoded from the left by the longest token that fits there, going back to a shorter one
where neighbours clash or no way on is left; positions that were given up are not tried again, which
bounds the work by the number of (position, token) pairs. All tokens that start at a position come from one
pass of an Aho-Corasick automaton over the piece, its bytes taken as Latin-1 characters.

Defined results: null texts are empty; an empty text has no ids; every text decodes to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import chunks

_CACHE: dict[tuple[str, str], Bpe] = {}


class Bpe:
    """Encoder and decoder of one vocabulary; a token's rank is its id and the order of its merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.prefixes: dict[int, int | None] = {}
        self.fits = lru_cache(1 << 18)(self._fits)
        self.chunks = chunks.ChunkEncoder(lambda pieces: [chunks.little_endian(self.encode_piece(p.encode())) for p in pieces], pattern)

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joined; None for a single byte. Found when asked for."""
        if token not in self.halves:
            raw, found = self.tokens[token], None
            for i in range(len(raw) - 1, 0, -1):
                left, right = self.ranks.get(raw[:i], token), self.ranks.get(raw[i:], token)
                if left < token and right < token and self._fits(left, right, token):
                    found = left, right
                    break
            self.halves[token] = found
        return self.halves[token]

    def _fits(self, left: int, right: int, below: int = 1 << 62) -> bool:
        """Whether no merge of rank under ``below`` would have joined across the border of two tokens.

        Both tokens are undone from their last merge on, the later one first; whatever then touches the
        border must not merge before the merge that was just undone.
        """
        while True:
            whole = self.ranks.get(self.tokens[left] + self.tokens[right])
            if whole is not None and whole < below:
                return False
            if left > right:
                parts, below = self._parts(left), left
                if parts is not None:
                    left = parts[1]
                    continue
                parts, below = self._parts(right), right + 1
                if parts is None:
                    return True
                right = parts[0]
            else:
                parts, below = self._parts(right), right + 1
                if parts is not None:
                    right = parts[0]
                    continue
                parts, below = self._parts(left), left
                if parts is None:
                    return True
                left = parts[1]

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [0] * n
        for last, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            longest[last + 1 - length] = token  # a longer one ends later
        ids: list[int] = []
        place, fits, tokens = 0, self.fits, self.tokens
        token, given_up = longest[0], bytearray(n + 1)
        while place < n:
            while token is not None:
                after = place + len(tokens[token])
                if not given_up[after] and (not ids or fits(ids[-1], token)):
                    break
                token = self._shorter(token)
            if token is not None:
                ids.append(token)
                place = after
                token = longest[place] if place < n else None
            else:  # no way on from here: the token before gives way to a shorter one
                given_up[place] = 1
                last = ids.pop()
                place -= len(tokens[last])
                token = self._shorter(last)
        return ids

    def _shorter(self, token: int) -> int | None:
        """The longest other token that ``token`` begins with."""
        if token not in self.prefixes:
            raw = self.tokens[token]
            self.prefixes[token] = next((self.ranks[raw[:i]] for i in range(len(raw) - 1, 0, -1) if raw[:i] in self.ranks), None)
        return self.prefixes[token]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes of little-endian unsigned 32-bit integers."""
        return self.chunks(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str, pattern: str) -> Bpe:
    """The encoder of a rank file; kept for later batches of the same worker."""
    if (path, pattern) not in _CACHE:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[path, pattern] = Bpe(ranks, pattern)
    return _CACHE[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (raw little-endian unsigned 32-bit) of every document."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path, pattern)
        for batch in batches:
            for at, texts in chunks.blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(bpe.encode(texts), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(path: str, pattern: str) -> Column:
    """A function of an ``ids`` column that gives the bytes they stand for."""

    @F.pandas_udf(T.BinaryType())
    def run(ids):
        bpe = load(path, pattern)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return run


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of what they decode to.

    Encodes, then decodes the ids in the same pass over the text; only digests leave the task.
    """

    def run(batches):
        import pyarrow as pa

        bpe, names = load(path, pattern), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for at, texts in chunks.blocks(batch.column("text")):
                ids = bpe.encode(texts)
                sha = lambda items: pa.array([hashlib.sha256(x).hexdigest() for x in items], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(map(bpe.decode, ids))], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
