"""Byte-level BPE by merge ranks: a priority queue over a doubly linked list of symbols.

A piece starts as one symbol a byte, each linked to its neighbours. The queue holds the merges of adjacent
symbols by rank, then by place; the least is taken, its right symbol joins its left one, and the merges with the new
neighbours are put in. An entry whose two symbols have changed since is stale and skipped, so nothing is ever taken out of
the middle of the queue, and a piece of n bytes costs n log n. Pieces repeat, so their ids are kept in the bounded memos of
``chunks``. Decoding concatenates the vocabulary's strings and reads them back as bytes.

The vocabulary and merges are those of a tokenizers JSON file (byte-level BPE without normalizer, prefix space or
dropout; others are refused). Strings of added tokens in a text become their ids, as in the library.

Defined results: null texts are empty; an empty text has no ids and decodes to nothing; repeated rows give equal rows; an empty
table gives no rows; other columns are not looked at. Ids that the vocabulary hasn't decode to nothing, bytes that
are no UTF-8 to U+FFFD, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import chunks, common

_CACHE: dict[str, Bpe] = {}


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        out.setdefault(b, chr(0x100 + len(out) - len(printable)))
    return [out[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or not plain or odd or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer, prefix space or dropout is supported")
        vocabulary: dict[str, int] = model["vocab"]
        letters = byte_characters()
        self.symbols = [vocabulary.get(c, -1) for c in letters]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left id, right id): (rank, id of both together)
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        added = {t["content"]: t for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added.values()):
            raise ValueError("added tokens that take their surroundings in are not supported")
        ids = {**vocabulary, **{c: t["id"] for c, t in added.items()}}
        #: The bytes of each id; a string with a character that stands for no byte is its own UTF-8.
        self.strings = [b""] * (max(ids.values(), default=-1) + 1)
        for string, i in ids.items():
            raw = [back.get(c) for c in string]
            self.strings[i] = string.encode() if None in raw else b"".join(raw)
        encode = chunks.ChunkEncoder(lambda pieces: [chunks.little_endian(self.encode_piece(p.encode())) for p in pieces])
        self.encode = chunks.AddedTokens(encode, {c: t["id"] for c, t in added.items()})

    def encode_piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        symbols = [s for b in raw if (s := self.symbols[b]) >= 0]
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)  # a rank has one id, so entries stand by rank, then by place
        while queue:
            _, whole, left = heapq.heappop(queue)
            right = after[left]
            if right >= n or symbols[left] < 0 or merges.get((symbols[left], symbols[right]), (0, -1))[1] != whole:
                continue  # stale: one of the two has become part of another symbol
            symbols[left], symbols[right] = whole, -1
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if m := merges.get((whole, symbols[far])):
                    heapq.heappush(queue, (*m, left))
            near = before[left]
            if near >= 0 and (m := merges.get((symbols[near], whole))):
                heapq.heappush(queue, (*m, near))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: bytes) -> str:
        """The text of ids given as little-endian unsigned 32-bit integers."""
        strings, top = self.strings, len(self.strings)
        own = np.frombuffer(ids, "<u4")
        own = own if not own.size or own.max() < top else own[own < top]
        return b"".join(map(strings.__getitem__, own.tolist())).decode("utf-8", "replace")


def load(path: str) -> Bpe:
    """The encoder of a tokenizers file; kept for later batches of the same worker."""
    if path not in _CACHE:
        with open(path, encoding="utf-8") as f:
            _CACHE[path] = Bpe(json.load(f))
    return _CACHE[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (raw little-endian unsigned 32-bit) of every document."""

    def run(batches):
        import pyarrow as pa

        encode = load(path).encode
        for batch in batches:
            for at, texts in chunks.blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(encode(texts), pa.binary())], names=["doc_id", "ids"])
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(path: str) -> Column:
    """A function of an ``ids`` column that gives the text they stand for; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(ids):
        own = load(path)
        return ids.map(lambda x: None if x is None else own.decode(x))

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of the text that they decode to.

    Ids are decoded in the pass that made them; only digests leave the task.
    """

    def run(batches):
        import pyarrow as pa

        own, names = load(path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for at, texts in chunks.blocks(batch.column("text")):
                ids = own.encode(texts)
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in items], pa.string()) for items in (ids, (own.decode(x).encode() for x in ids))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), *digests], names=names)
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
