"""Sharding: a keyed Feistel permutation of global row numbers, in DataFrame functions only.

Rows are numbered 0..n-1 by (bucket, key columns) without a global sort: equal rows are first
counted together, buckets are hashes of the whole key, and a bucket's first number is a running
sum over the bucket counts, one for about ``BUCKET_ROWS`` rows (``BUCKETS`` at least). The permutation is a Feistel network over
a x b >= n, a = ceil(sqrt n), walked until it is below n again. Row number i goes to shard
p(i) mod s at slot p(i) div s, so shard sizes differ by one at most and either side can be computed
from the other.

Defined results: null keys are keys like any other; fully equal rows get neighbouring numbers;
an empty table gives no rows; columns other than the named ones are carried by the caller's join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import common

BUCKETS, BUCKET_ROWS, ROUNDS, SEED = 1024, 1 << 20, 4, 20_240_607
_P = 2_147_483_647  # rounds work modulo this prime, so that no product leaves 63 bits


def _keys(seed: int) -> list[tuple[int, int]]:
    out, x = [], seed % _P
    for _ in range(ROUNDS):
        x = (x * 48_271 + 11) % _P
        y = (x * 69_621 + 7) % _P
        out.append((x or 1, y))
    return out


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0..n-1 for a seed; the same one for plain integers and for columns."""

    n: int
    seed: int = SEED

    @property
    def side(self) -> int:
        return max(1, math.isqrt(max(self.n, 1) - 1) + 1)

    @staticmethod
    def _mix(right, a, b):
        t = (right * a + b) % _P
        return (t * ((t + b) % _P) + right) % _P

    def _once(self, x: int) -> int:
        m = self.side
        left, right = divmod(x, m)
        for a, b in _keys(self.seed):
            left, right = right, (left + self._mix(right, a, b)) % m
        return left * m + right

    def walks(self) -> int:
        """Passes that the longest walk needs: found from the fewer than 2*sqrt(n)+1 numbers outside."""
        outside = {y: self._once(y) for y in range(self.n, self.side**2)}
        entered = set(outside) - set(outside.values())  # from below n; the rest follow these, or go round outside for ever
        longest = 0
        for y in entered:
            k = 1
            while (y := outside[y]) >= self.n:
                k += 1
            longest = max(longest, k)
        return 1 + longest

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def column(self, x: Column) -> Column:
        """The permuted number as a long; ``x`` is a column of longs from 0 to n-1."""
        m = F.lit(self.side).cast("long")
        keys = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in _keys(self.seed)))

        def once(y: Column) -> Column:
            start = F.struct(F.call_function("div", y, m).alias("l"), (y % m).alias("r"))
            return F.aggregate(
                keys,
                start,
                lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + self._mix(s["r"], k["a"], k["b"])) % m).alias("r")),
                lambda s: s["l"] * m + s["r"],
            )

        walk = F.sequence(F.lit(1), F.lit(self.walks()))
        return F.aggregate(walk, x, lambda y, i: F.when((i == 1) | (y >= F.lit(self.n)), once(y)).otherwise(y))


def number_rows(rows: DataFrame, keys: list[str], *, buckets: int | None = None) -> tuple[DataFrame, int]:
    """(keys and ``row_number`` 0..n-1, n). ``rows`` is read twice, so pass a checkpointed frame.

    The order is by hash bucket, then keys. Equal rows are counted together first, so a row that is
    repeated very often is one record until it gets its numbers.
    """
    buckets = buckets or max(BUCKETS, rows.count() // BUCKET_ROWS)  # so that no task sorts more than a bucket
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_copies")).withColumn("_bucket", bucket)
    sizes = [(r["_bucket"], r["_n"]) for r in counted.groupBy("_bucket").agg(F.sum("_copies").alias("_n")).collect()]
    starts, n = [], 0
    for b, k in sorted(sizes):
        starts.append((b, n))
        n += k
    first = rows.sparkSession.createDataFrame(starts, "_bucket int, _first long")  # a row a bucket: a millionth of the rows
    before = Window.partitionBy("_bucket").orderBy(*(F.col(k).asc_nulls_first() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(first, "_bucket").withColumn("_start", F.col("_first") + F.coalesce(F.sum("_copies").over(before), F.lit(0)))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    numbered = placed.select(*keys, "_start", copies.alias("_k")).select(*keys, (F.col("_start") + F.col("_k")).alias("row_number"))
    return numbered, n


def assign(rows: DataFrame, keys: list[str], n_shards: int, *, seed: int = SEED) -> DataFrame:
    """The key columns of every row with ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in each shard)."""
    numbered, n = number_rows(rows, keys)
    at = Feistel(n, seed).column(F.col("row_number"))
    return numbered.select(*keys, "row_number", at.alias("_at")).select(
        *keys, "row_number", (F.col("_at") % n_shards).cast("int").alias("shard"), F.call_function("div", F.col("_at"), F.lit(n_shards)).alias("slot")
    )


def document_digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text: 1) and text_crc32 (null text: 0) of every row."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def shard_documents(docs: DataFrame, n_shards: int = 8, *, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    keys = ["doc_id", "size", "text_crc32"]
    placed = assign(common.cut(document_digests(docs)), keys, n_shards, seed=seed)
    return placed.select(*keys, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, *, seed: int = SEED) -> None:
    """The whole rows of ``docs`` as Parquet under ``path``/shard=N, in slot order within each file.

    Every column is a key here, so equal rows stay interchangeable; map columns can't be keys.
    """
    placed = assign(docs, docs.columns, n_shards, seed=seed)
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
