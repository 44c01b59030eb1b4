"""Whitening of embeddings by a tall and skinny QR: principal directions without a covariance matrix.

Entries become integers (floor of SCALE times the entry), so that equal vectors are equal and sums are exact. The fit list
is each distinct vector once. Its rows are centred by the exact sums, each partition is reduced to the R factor of
its rows, block after block, and R factors are merged in a tree, FAN at a time, until few are left for the driver; a
factor is dimension by dimension whatever the input. The singular values of the last R give the variances, its right
vectors the components. Squaring is left out until then, so components keep full double precision.

Defined results: rows whose vector is null, or has null or non-finite entries, are left out, and so are those
whose length isn't the most common one (of ties the longer); null and repeated ids are ids like any other, and repeated rows
give repeated rows; entries whose product with SCALE leaves the 64-bit range stand for its end. Fewer dimensions than
components give as many components. Components without variance (one distinct vector, or fewer than dimensions) have
a null ``whitened`` and don't count in ``identity_error``, which is null if there are no others; without any variance
``explained`` is null too. A deviation beyond 64 bits is null. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

SCALE, COMPONENTS = 256, 4
#: R factors merged at once, and numbers of a block of rows that is reduced at once.
FAN, BLOCK = 8, 1 << 20
#: Singular values under this share of the largest are rounding.
NOTHING = 2e-13


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with exact sums; unit components as rows, all variances, and how white the fit list has become."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Which components have variance."""
        top = self.variances[:1].max(initial=0.0)
        own = self.variances[: len(self.components)]
        return (own > 0) & (np.sqrt(own) > NOTHING * np.sqrt(top))

    @property
    def explained(self) -> list[float | None]:
        """The share of each component in all variance."""
        whole = self.variances.sum()
        return [float(e / whole) if whole else None for e in self.variances[: len(self.components)]]


def integers(vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key as long, x: array of long) of the rows that count, see the module."""
    entry = F.col(column)
    finite = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    there = vectors.where(entry.isNotNull() & finite)
    common_size = there.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common_size["size"] if common_size else 0
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE))
    return there.where((F.size(column) == size) & F.lit(size > 0)).select(F.col(key).cast("long").alias(key), x.alias("x"))


def _matrix(batch) -> np.ndarray:
    """The vectors of a batch as rows."""
    own = batch.column("x")
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def _offsets(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """x less the whole part of the mean (exact), and the rest of the sums: n * x - S = n * offsets - rests."""
    wholes, rests = zip(*(divmod(s, n) for s in sums))
    near = x.size == 0 or (max(abs(int(x.min())), abs(int(x.max()))) < 2**62 and max(map(abs, wholes)) < 2**62)
    return (x - np.array(wholes, np.int64) if near else x.astype(object) - np.array(wholes, object)), list(rests)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the mean, rounded once."""
    offsets, rests = _offsets(x, n, sums)
    return offsets.astype(np.float64) - np.array([r / n for r in rests])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 for each row, exact; None beyond 64 bits."""
    offsets, rests = _offsets(x, n, sums)
    most = max((abs(int(v)) for v in (offsets.min(), offsets.max())), default=0) if x.size else 0
    if x.shape[1] * most * max(most, n) >= 2**62:
        offsets = offsets.astype(object)
    squares, products = (offsets * offsets).sum(1), (offsets * np.array(rests, offsets.dtype)).sum(1)
    rest = sum(r * r for r in rests)
    out = [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares.tolist(), products.tolist())]
    return [v if v < 2**63 else None for v in out]


def _totals(batches):
    """For each dimension the exact sum over a partition, and its rows at place -1."""
    import pyarrow as pa

    n, total = 0, None
    for batch in batches:
        x = _matrix(batch)
        if len(x):
            safe = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < 2**62
            own = x.sum(0, dtype=np.int64 if safe else object).tolist()
            total = own if total is None else [a + b for a, b in zip(total, own)]
            n += len(x)
    if total is not None:
        places = pa.array([-1, *range(len(total))], pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["place", "total"])


def _reduce(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factor_batch(part: int, r: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])


def last_factor(x: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The R factor of all centred rows, from a tree of those of partitions. Every level of the tree is written to the shared folder."""
    width = len(sums)
    step = max(width, BLOCK // width)

    def first(batches):
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            own = _matrix(batch)
            for at in range(0, len(own), step):
                r = _reduce(np.vstack([r, centred(own[at : at + step], n, sums)]))
        if len(r):
            yield _factor_batch(TaskContext.get().partitionId(), r)
        common.release()

    def merge(table):
        import pyarrow as pa

        r = np.zeros((0, width))
        for raw in table.column("r").to_pylist():
            r = _reduce(np.vstack([r, np.frombuffer(raw, "<f8").reshape(-1, width)]))
        return pa.Table.from_batches([_factor_batch(table.column("part")[0].as_py(), r)])

    level = common.cut(x.mapInArrow(first, "part long, r binary"))
    while level.count() > FAN:
        level = common.cut(level.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(merge, "part long, r binary"))
    factors = [np.frombuffer(row["r"], "<f8").reshape(-1, width) for row in level.collect()]  # FAN at most
    return _reduce(np.vstack(factors))


def fit(vectors: DataFrame, *, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> Whitening | None:
    """The whitening of the distinct vectors; None if there are none. What comes to the driver is bounded by the dimension."""
    with common.scratch(integers(vectors, key=key, column=column).select("x").distinct(), "whitening") as x:
        totals = x.mapInArrow(_totals, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).collect()
        if not totals:
            return None
        n, *sums = (int(r["total"]) for r in sorted(totals, key=lambda r: r["place"]))
        r = last_factor(x, n, tuple(sums))
        _, singular, right = np.linalg.svd(r, full_matrices=True)
        variances = np.zeros(len(sums))
        variances[: singular.size] = singular**2 / n
        model = Whitening(n, tuple(sums), right[:components], variances)
        white = [F.get("whitened", F.lit(int(i))) for i in np.flatnonzero(model.usable)]
        if not white:
            return model
        pairs = [(i, j) for i in range(len(white)) for j in range(i + 1)]
        (got,) = whiten_integers(x, model).agg(*(F.covar_pop(white[i], white[j]).alias(f"_{i}_{j}") for i, j in pairs)).collect()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs))
        return Whitening(n, model.sums, model.components, variances, float(error))


def whiten_integers(x: DataFrame, model: Whitening) -> DataFrame:
    """The columns before ``x``, then ``deviation`` and ``whitened`` (an array with an entry a component, null without variance)."""
    n, sums, usable = model.n, model.sums, model.usable
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, model.variances[: usable.size], 1)), np.nan)
    turn = model.components.T * scale
    keys = [c for c in x.columns if c != "x"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = _matrix(batch) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
            white = (centred(own, n, sums) @ turn).ravel()
            entries = pa.array(white, pa.float64(), mask=np.tile(~usable, len(own)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * usable.size), entries)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(deviations(own, n, sums), pa.int64()), lists], names=[*keys, "deviation", "whitened"])

    kinds = "".join(f"`{k}` {x.schema[k].dataType.simpleString()}, " for k in keys)
    return x.mapInArrow(run, f"{kinds}deviation long, whitened array<double>")


def whiten(vectors: DataFrame, model: Whitening | None, *, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Key, exact ``deviation`` and ``whitened`` of every row that counts."""
    x = integers(vectors, key=key, column=column)
    if model is None:
        return x.select(key, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).where(F.lit(False))
    return whiten_integers(x, model)


def whiten_vectors(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """A row for each row that counts and each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components=components)
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_place", "whitened"))
    shares = F.array(*(F.lit(v).cast("double") for v in model.explained)) if model else F.lit(None).cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("_place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_place")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
