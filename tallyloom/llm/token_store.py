"""Token ids on disk with keyed access: shard files of raw ids under a minimal perfect hash index.

Documents are range-partitioned by doc_id, each task encodes its range in order and writes shard
files of bounded size, and one manifest row a file is what Spark passes on. A file holds, in this
order: a header of ``HEADER`` integers, the ids (2 bytes each where all fit, else 4, little-endian), the
starts and doc_ids of its rows, and the index: the bits of a level-by-level minimal perfect hash over
the distinct keys and, for each slot, the key's fingerprint and its first row. A lookup hashes the
key once a level (two on average), counts bits below, compares the fingerprint and has the offset.

A task writes under a name of its own, and only files named in the checkpointed manifest count, so a
repeated or lost task leaves no half file in the store. Paths go through pyarrow's file systems.

Defined results: a null or empty text has only the end id; repeated doc_ids stand side by side and a
lookup gives the first with their number; rows with a null doc_id come first and have no key; an
empty table gives an empty store.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import chunks, common

END = 2
#: Ids and documents after which a task starts its next shard file.
SHARD_IDS, SHARD_DOCS = 1 << 24, 1 << 18
MAGIC, HEADER = 0x544C494453303031, 8
_MANIFEST = "task int, seq int, file string, n_docs long, n_ids long, low long, high long, nulls long"


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of integer keys for a salt."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct integers: n keys to 0..n-1, built level by level.

    Keys that are alone at their bit of a level stay there; the rest go to the next level.
    """

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while keys.size:
            m = max(64, cls.GAMMA * keys.size)
            at = (_mix(keys, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels).astype(np.uint8) if levels else np.zeros(0, np.uint8))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that were not there (others get any slot: compare fingerprints)."""
        out, open_ = np.full(keys.size, -1, np.int64), np.arange(keys.size)
        for level, m in enumerate(self.sizes):
            at = (_mix(keys[open_], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            hit = self.bits[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF1) >> np.uint64(32)).astype("<u4")


def _file_bytes(parts: list[bytes], keys: list, lengths: list[int]):
    """The sections of a shard file, in order."""
    n_ids = sum(lengths)
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not ids.size or ids.max() < 1 << 16 else 4
    nulls = sum(k is None for k in keys)  # they come first
    docs = np.array([0 if k is None else k for k in keys], "<i8")
    distinct, first = np.unique(docs[nulls:], return_index=True)
    index = PerfectHash.build(distinct)
    slots = index(distinct)
    prints, rows = np.zeros(distinct.size, "<u4"), np.zeros(distinct.size, "<i8")
    prints[slots], rows[slots] = _fingerprints(distinct), first + nulls
    yield np.array([MAGIC, width, n_ids, docs.size, nulls, distinct.size, index.sizes.size, index.bits.size], "<i8").tobytes()
    yield ids.astype(f"<u{width}").tobytes()
    yield np.concatenate([[0], np.cumsum(lengths)]).astype("<i8").tobytes()
    yield docs.tobytes()
    yield index.sizes.astype("<i8").tobytes()
    yield np.packbits(index.bits).tobytes()
    yield prints.tobytes()
    yield rows.tobytes()


@dataclass
class Shard:
    """An opened shard file: the index in memory, the ids read where they are asked for."""

    uri: str

    def __post_init__(self):
        filesystem, path = _filesystem(self.uri)
        self.file = filesystem.open_input_file(path)
        magic, self.width, self.n_ids, self.n_docs, self.nulls, n_keys, n_levels, n_bits = np.frombuffer(self.file.read(8 * HEADER), "<i8").tolist()
        if magic != MAGIC:
            raise ValueError(f"not a shard file: {self.uri}")
        self.file.seek(8 * HEADER + self.width * self.n_ids)
        take = lambda n, kind: np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)
        self.starts, self.docs, sizes = take(self.n_docs + 1, "<i8"), take(self.n_docs, "<i8"), take(n_levels, "<i8")
        self.index = PerfectHash(sizes, np.unpackbits(take((n_bits + 7) // 8, "u1"), count=n_bits))
        self.prints, self.rows = take(n_keys, "<u4"), take(n_keys, "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where the fingerprint says that it is not here."""
        slots = self.index(keys)
        hit = slots >= 0
        hit[hit] = self.prints[slots[hit]] == _fingerprints(keys[hit])
        out = np.full(keys.size, -1, np.int64)
        out[hit] = self.rows[slots[hit]]
        return out

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        """The ids of ``rows`` documents from ``row`` on, as unsigned 32-bit integers."""
        a, b = int(self.starts[row]), int(self.starts[row + rows])
        self.file.seek(8 * HEADER + self.width * a)
        return np.frombuffer(self.file.read(self.width * (b - a)), f"<u{self.width}").astype("<u4")

    def crcs(self, rows: np.ndarray) -> list[int]:
        """crc32 of the ids of each row; rows that stand side by side are read at once."""
        out: list[int] = []
        for run in np.split(rows, np.flatnonzero(np.diff(rows) != 1) + 1):
            if run.size:
                ids, starts = self.ids(int(run[0]), run.size), self.starts[run[0] : run[0] + run.size + 1] - self.starts[run[0]]
                out += [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        return out

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, tokenizer: str, *, end: int = END) -> DataFrame:
    """Write the store under ``folder`` (a URI that all executors reach); the manifest, one row a file.

    The manifest has the files in ascending order of doc_id with ``first_id``, the ids in all files before.
    """
    mark = np.array([end], "<u4").tobytes()

    def write_shards(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        encode = chunks.tokenizers_encoder(tokenizer)
        parts, keys, lengths, n_ids = [], [], [], 0
        schema = pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.int64())])

        def close():
            uri = f"{folder}/ids-{task:06d}-{seq:04d}-{attempt}.bin"
            filesystem, path = _filesystem(uri)
            with filesystem.open_output_stream(path) as out:
                for section in _file_bytes(parts, keys, lengths):
                    out.write(section)
            own = [k for k in keys if k is not None]
            row = (task, seq, uri, len(keys), n_ids, min(own, default=None), max(own, default=None), len(keys) - len(own))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            ids_of = batch.column("doc_id")
            for at, texts in chunks.blocks(batch.column("text")):
                for doc, raw in zip(ids_of.slice(at, len(texts)).to_pylist(), encode(texts)):
                    parts.append(raw + mark)
                    keys.append(doc)
                    lengths.append(len(raw) // 4 + 1)
                    n_ids += lengths[-1]
                if n_ids >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield close()
                    parts, keys, lengths, n_ids, seq = [], [], [], 0, seq + 1
        if keys:
            yield close()

    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")  # deals rows of one doc_id over many tasks
    ordered = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    manifest = common.cut(ordered.mapInArrow(write_shards, _MANIFEST))
    # Files of a task in its own window, tasks (a row each) in the only one that spans all.
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("_ids"))
    tasks = tasks.select("task", F.coalesce(F.sum("_ids").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(tasks, "task").withColumn("first_id", F.col("_before") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("_before")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; keys go through the index."""

    def read_shards(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for uri, first_id in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist()):
                shard = Shard(uri)
                docs, nulls = shard.docs, shard.nulls
                rows = np.arange(shard.n_docs)
                if shard.n_docs > nulls:  # each key's first row by the index, then the rows of the same key
                    new = np.concatenate([[True], docs[nulls + 1 :] != docs[nulls:-1]])
                    first = shard.find(docs[nulls:])
                    rows[nulls:] = first + (np.arange(first.size) - np.maximum.accumulate(np.where(new, np.arange(first.size), 0)))
                for at in range(0, shard.n_docs, 4096):
                    own = rows[at : at + 4096]
                    lengths = shard.starts[own + 1] - shard.starts[own]
                    crcs = shard.crcs(own)
                    keys = pa.array(docs[own], pa.int64(), mask=own < nulls)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(shard.starts[own] + first_id, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=names)
                shard.close()

    files = max(1, manifest.count())  # an explicit number, so that small manifest rows aren't put into one task
    own = manifest.select("file", "first_id").repartition(files, "file")
    return own.mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """The ids of one document (the first of that doc_id): one file by its key range, one index probe, one read."""
    for r in manifest.where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("task", "seq").select("file").toLocalIterator():
        shard = Shard(r["file"])
        row = int(shard.find(np.array([doc_id], np.int64))[0])
        found = shard.ids(row) if row >= 0 else None
        shard.close()
        if found is not None:
            return found
    return None


def new_folder(spark: SparkSession) -> str:
    """A folder for one store in the shared checkpoint folder."""
    return f"{common.ensure_checkpoint_dir(spark)}/token-store-{uuid.uuid4().hex}"
