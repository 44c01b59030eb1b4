"""Best-two-fit packing of token sequences.

Documents are encoded and cut into pieces once. Pieces of one length are interchangeable, so the
packing is decided on the histogram of lengths (at most ``capacity`` numbers, whatever the input):
a bin takes the longest piece left, is filled greedily with the longest that fits, and then gives
back its smallest piece for two unpacked ones that fill the widened gap better. The same bin is
repeated as often as the counts allow. The plan is then joined back: a piece with rank r among
those of its length belongs to the bin whose range of ranks holds r.

Defined results: a null or empty text is one piece with only the end id; repeated rows are packed
as often as they occur; null ids are ids like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import chunks, common

CAPACITY, END, BUCKET_ROWS = 1024, 2, 1 << 15
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and the raw ids if asked for.

    A document longer than ``capacity`` is cut so that only its first piece is shorter.
    """
    mark = np.array([end], "<u4").tobytes()

    def pieces(batches):
        import pyarrow as pa

        encode = chunks.tokenizers_encoder(tokenizer)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for at, texts in chunks.blocks(batch.column("text")):
                rows = []
                for doc, raw in zip(ids_of.slice(at, len(texts)).to_pylist(), encode(texts)):
                    raw += mark
                    n = len(raw) // 4
                    stops = list(range(n, 0, -capacity))[::-1]
                    for k, stop in enumerate(stops):
                        start = stops[k - 1] if k else 0
                        part = raw[4 * start : 4 * stop]
                        rows.append((doc, k, start, stop - start, zlib.crc32(part), *([part] if with_ids else [])))
                schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                schema = pa.schema(schema + [("ids", pa.binary())] * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        common.release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(pieces, _PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins for a histogram {length: pieces}: (times, lengths in a bin), by best-two-fit.

    Lengths are from 1 to ``capacity``. There are fewer than capacity * (2 + ln capacity) kinds of bins whatever the counts: each
    leaves fewer pieces of one length than it takes, after the first time fewer than capacity / length, and fewer each time.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        took: list[int] = []
        gap, top = capacity, longest
        while gap and (fits := np.flatnonzero(left[1 : min(gap, top) + 1])).size:
            top = int(fits[-1]) + 1
            n = min(gap // top, int(left[top]))
            took += [top] * n
            left[top] -= n
            gap -= n * top
            top -= 1
        if gap and len(took) > 1 and (pair := _two(left, gap + took[-1], took[-1])):
            left[took[-1]] += 1
            took[-1:] = pair
            for x in pair:
                left[x] -= 1
        for x in took:
            left[x] += 1
        own: dict[int, int] = {}
        for x in took:
            own[x] = own.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in own.items())
        for x, n in own.items():
            left[x] -= times * n
        out.append((times, took))


def _two(left: np.ndarray, room: int, smallest: int) -> list[int] | None:
    """Two unpacked lengths, each shorter than ``room``, whose sum is the largest up to it and beyond ``smallest``."""
    there = np.flatnonzero(left[:room])
    there = there[there > 0]
    if not there.size:
        return None
    at_most = np.zeros(room + 1, np.int64)  # the largest length there of at most i
    at_most[there] = there
    at_most = np.maximum.accumulate(at_most)
    first = there[::-1]
    second = at_most[np.minimum(room - first, first)]
    lone = (second == first) & (left[first] < 2)
    second[lone] = at_most[first[lone] - 1]
    sums = np.where(second > 0, first + second, 0)
    i = int(np.argmax(sums))
    return [int(first[i]), int(second[i])] if sums[i] > smallest else None


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. They are read three times, so pass a checkpointed frame.

    Ranks within a length are taken by hash bucket, one for about ``BUCKET_ROWS`` pieces of the length: equal rows count
    once with their number of copies, a bucket's first rank is a running sum over the bucket counts, so a length that
    holds a third of all pieces is still dealt over many tasks, however many pieces there are.
    """
    spark, keys = pieces.sparkSession, pieces.columns
    of = {r["length"]: r["count"] // BUCKET_ROWS + 1 for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not of:
        return pieces.select(*keys, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    many = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in of.items() for x in pair)), F.col("length"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many).cast("int")
    counted = pieces.groupBy(*keys).agg(F.count("*").alias("_copies")).withColumn("_bucket", bucket)
    sizes = counted.groupBy("length", "_bucket").agg(F.sum("_copies").alias("_n"))
    got = [(r["length"], r["_bucket"], r["_n"]) for r in sizes.collect()]  # a row a bucket
    counts: dict[int, int] = {}
    firsts = []
    for length, b, n in sorted(got):
        firsts.append((length, b, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    ranges, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for times, lengths in plan(counts, capacity):
        offset = 0
        for x in lengths:
            ranges.append((x, used[x], used[x] + times, sequence - used[x], offset))
            used[x] += times
            offset += x
        sequence += times
    first = spark.createDataFrame(firsts, "length long, _bucket int, _first long")
    spans = spark.createDataFrame(ranges, "length long, _from long, _to long, _shift long, offset long")
    before = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_first") + F.coalesce(F.sum("_copies").over(before), F.lit(0))
    ranked = counted.join(first, ["length", "_bucket"]).withColumn("_start", start)
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_copies") - 1)))
    # The plan's size has a bound of its own (see ``plan``), whatever the input.
    placed = ranked.join(F.broadcast(spans), (ranked["length"] == spans["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*(ranked[k] for k in keys), (F.col("_rank") + F.col("_shift")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Where every piece of every document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(common.cut(cut_documents(docs, tokenizer, capacity=capacity, end=end)), capacity=capacity)


def sequences(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (raw little-endian unsigned 32-bit), length, doc_ids."""
    placed = pack(common.cut(cut_documents(docs, tokenizer, capacity=capacity, end=end, with_ids=True)), capacity=capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` pieces
    return (
        placed.groupBy("sequence_id")
        .agg(parts.alias("_p"), F.sum("length").alias("length"))
        .select("sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "length", F.col("_p.doc_id").alias("doc_ids"))
    )
