"""Media columns: copies of pictures by local descriptors, cropped and edited ones included.

Pictures of equal pixels are one picture first, whatever they show. Each is taken at several scales; corners are
all local maxima of the smaller eigenvalue of the gradient's moments; a patch around each is turned by its
intensity centroid and compared at fixed pairs of points, which gives 128 bits. Bits are cut into four tables of
32; descriptors that agree in a table meet at the smallest picture there (a star, not all pairs), and
a pair of pictures counts as copies when enough of its meetings agree on one scale, turn and shift.

A star hides a pair whose cells have smaller foreign pictures. So each corner is also put, with each of its NEAR
nearest corners, into cells of both descriptors and the step between them; there every two pictures that are still
in different groups are compared by the other bits of their descriptors and vote, and what CANDIDATE corners agree
on is decided by all cells of both pictures. These cells are far rarer, but the comparisons in one are
quadratic in its pictures of different groups. They are never rows: nearly all have one picture, so corners are dealt
over ranges by one part of their bits, as packed bytes with the cells of that part, and a task that has a range
lets the corners of a cell meet; a cell with more than WIDE of them is dealt again and joined over several tasks.

Defined results: null, empty or malformed pictures have no descriptors and are alone; repeated pictures
are copies of each other; a null media_id has a null group; an empty table gives no rows. Edited copies with
fewer than AGREE common corners (flat or smaller than 2 * RADIUS + 5 pixels a side) are not found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import common, components

SCALES, BITS, TABLES, RADIUS, AGREE = (1.0, 0.75, 0.5), 128, 4, 9, 7
#: Neighbours a corner is paired with, pixels that steps between them are rounded to, bits that may differ, corners that make a pair a candidate.
NEAR, STEP, DIFFER, CANDIDATE = 3, 4, 16, 3
#: Corners of a cell that meet in the task of its range; records of a range; corners with one part, at least, that are dealt by cell and not by that part.
WIDE, RANGE, FREQUENT = 256, 500_000, 65_536
#: Rows that a side of a join is broadcast up to.
_BROADCAST = 65_536
_TURNS, _CHUNK, _MEMO, _FLUSH = 32, 1024, 256, 100_000


def _pairs() -> np.ndarray:
    """The points compared, for every turn: (turns, bits, 2 ends, 2 axes) of whole offsets."""
    at = np.random.default_rng(5).normal(0, RADIUS / 2.2, (BITS, 2, 2)).clip(-RADIUS, RADIUS)
    angle = np.arange(_TURNS) * 2 * np.pi / _TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
    return np.einsum("tij,bej->tbei", turn, at).round().astype(int)


_PAIRS = _pairs()


def _smooth(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        x = (np.roll(x, 1, axis) + 2 * x + np.roll(x, -1, axis)) / 4
    return x


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, int(n * scale)) for n in x.shape)
    y, z = (np.linspace(0, n - 1, m) for n, m in zip(x.shape, (h, w)))
    y0, z0 = y.astype(int), z.astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(z0 + 1, x.shape[1] - 1)
    fy, fz = (y - y0)[:, None], (z - z0)[None]
    return (x[y0][:, z0] * (1 - fy) + x[y1][:, z0] * fy) * (1 - fz) + (x[y0][:, z1] * (1 - fy) + x[y1][:, z1] * fy) * fz


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def _nearest(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """The NEAR nearest other corners of each (fewer where there are not so many)."""
    n, most = ys.size, min(NEAR, ys.size - 1)
    out = np.zeros((n, most), int)
    for k in range(0, n, _CHUNK):
        own = np.arange(k, min(n, k + _CHUNK))
        far = (ys[own, None] - ys) ** 2 + (xs[own, None] - xs) ** 2
        far[np.arange(own.size), own] = np.iinfo(far.dtype).max
        out[own] = np.argsort(far, 1, kind="stable")[:, :most]
    return out


def _pair_cells(ys, xs, turn, parts) -> np.ndarray:
    """Of each corner, near corner and part a 64-bit cell: that part of both, and the step between them in the corner's own turn."""
    near = _nearest(ys, xs)
    angle = (turn * 2 * np.pi / _TURNS)[:, None]
    dy, dx = ys[near] - ys[:, None], xs[near] - xs[:, None]
    u = np.rint((np.cos(angle) * dx + np.sin(angle) * dy) / STEP).astype(np.int64)
    v = np.rint((np.cos(angle) * dy - np.sin(angle) * dx) / STEP).astype(np.int64)
    step = ((u & 0xFFFF) * 2**16 + (v & 0xFFFF))[..., None] * TABLES + np.arange(TABLES)
    both = parts[:, None].astype(np.uint64) * np.uint64(2**32) + parts[near].astype(np.uint64)
    return _mix(both ^ _mix(step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def describe(pixels: bytes | None, width: int | None, height: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each corner its place (y, x, scale and turn in one number, in the picture's own coordinates) and its four 32-bit parts."""
    none = np.zeros(0, np.int64), np.zeros((0, TABLES), np.int64)
    if not pixels or not width or not height or len(pixels) != width * height:
        return none
    picture = np.frombuffer(pixels, np.uint8).reshape(height, width).astype(float)
    found = []
    for scale in SCALES:
        x = _smooth(_smooth(_scaled(picture, scale)))
        if min(x.shape) <= 2 * RADIUS + 4:
            continue
        gy, gx = np.gradient(x)
        a, b, c = _smooth(_smooth(gy * gy)), _smooth(_smooth(gx * gx)), _smooth(_smooth(gy * gx))
        least = (a + b) / 2 - np.sqrt(((a - b) / 2) ** 2 + c * c)
        m = RADIUS + 2
        inner = least[m:-m, m:-m]
        top = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    top &= inner > least[m + dy : least.shape[0] - m + dy, m + dx : least.shape[1] - m + dx]
        ys, xs = np.nonzero(top & (inner > 2.0))
        if not ys.size:
            continue
        ys, xs = ys + m, xs + m
        got = [_bits(x, ys[k : k + _CHUNK], xs[k : k + _CHUNK]) for k in range(0, ys.size, _CHUNK)]
        turn, parts = (np.concatenate(c) for c in zip(*got))
        at = np.rint(ys / scale).astype(np.int64) * 2**40 + np.rint(xs / scale).astype(np.int64) * 2**16 + round(scale * 100) * 64 + turn
        found.append((at, parts))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else none


def _step_cells(at: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Cells of each corner with its near ones of the same scale: (corners, NEAR, TABLES), 0 where there are fewer near ones."""
    out = np.zeros((at.size, NEAR, TABLES), np.uint64)
    scales = at // 64 % 1024
    for scale in np.unique(scales):
        own = np.flatnonzero(scales == scale)
        y, x = (np.rint(c * (scale / 100)).astype(np.int64) for c in (at[own] >> 40, (at[own] >> 16) % 2**24))
        cells = _pair_cells(y, x, at[own] % 64, parts[own])
        out[own, : cells.shape[1]] = np.maximum(cells & np.uint64(2**48 - 1), np.uint64(1))
    return out


def _bits(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turn and the four 32-bit parts of corners."""
    reach = np.arange(-6, 7)
    patch = x[ys[:, None, None] + reach[None, :, None], xs[:, None, None] + reach[None, None]]
    patch = patch * ((reach[:, None] ** 2 + reach[None] ** 2) <= 36)
    angle = np.arctan2((patch * reach[:, None]).sum((1, 2)), (patch * reach[None]).sum((1, 2)))
    turn = np.round(angle / (2 * np.pi) * _TURNS).astype(int) % _TURNS
    points = _PAIRS[turn]  # its first axis is y after the turn below
    py = np.clip(ys[:, None, None] + points[..., 1], 0, x.shape[0] - 1)
    px = np.clip(xs[:, None, None] + points[..., 0], 0, x.shape[1] - 1)
    bits = x[py[..., 0], px[..., 0]] < x[py[..., 1], px[..., 1]]
    return turn, np.packbits(bits, axis=1).view(">u4").astype(np.int64)


_CORNERS = f"array<struct<at:long,{','.join(f'p{i}:long' for i in range(TABLES))}>>"


def pictures(media: DataFrame) -> DataFrame:
    """media_id, digest (null where malformed) and corners of every picture with an id (columns pixels, width, height)."""

    def run(batches):
        names, memo = ["at", *(f"p{i}" for i in range(TABLES))], {}
        for batch in batches:
            ids, digests, found = [], [], [describe(None, None, None)]
            for i, pixels, width, height in zip(*(batch.column(c).to_pylist() for c in ("media_id", "pixels", "width", "height"))):
                if i is None:
                    continue
                sound = pixels and width and height and len(pixels) == width * height
                digest = hashlib.sha256(f"{width},{height},".encode() + pixels).digest() if sound else None
                if digest not in memo:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[digest] = describe(pixels, width, height) if sound else describe(None, None, None)
                ids.append(i)
                digests.append(digest)
                found.append(memo[digest])
            ends = pa.array(np.cumsum([len(at) for at, _ in found]), pa.int32())
            at, parts = (np.concatenate(c) for c in zip(*found))
            corners = pa.StructArray.from_arrays([pa.array(c) for c in (at, *(np.ascontiguousarray(p) for p in parts.T))], names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, corners)], names=["media_id", "digest", "corners"])

    own = media.select(F.col("media_id").cast("long").alias("media_id"), "pixels", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    return own.mapInArrow(run, f"media_id long, digest binary, corners {_CORNERS}")


def _agreed(met: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of which ``least`` corners of b agree on one scale, turn and shift; ``met`` has the places at_a and at_b of corners.

    Meetings go to the task of their pair once, as they are; those that too few others agree with on scale and turn end there.
    """
    met = met.select("a", "b", "at_a", "at_b").repartition("a", "b")

    def part(at: str) -> dict:
        c = F.col(at)
        return {"y": F.shiftright(c, 40), "x": F.shiftright(c, 16) % 2**24, "scale": (F.shiftright(c, 6) % 1024) / 100, "turn": c % 64}

    a, b = part("at_a"), part("at_b")
    turn = F.pmod(b["turn"] - a["turn"], F.lit(_TURNS))
    angle = turn * (2 * np.pi / _TURNS)
    ratio = a["scale"] / b["scale"]
    shift_x = b["x"] - ratio * (F.cos(angle) * a["x"] - F.sin(angle) * a["y"])
    shift_y = b["y"] - ratio * (F.sin(angle) * a["x"] + F.cos(angle) * a["y"])
    votes = met.select(
        "a", "b", F.round(F.log2(ratio)).alias("r"), F.floor(turn / 2).alias("t"),
        F.floor(shift_x / 12).alias("u"), F.floor(shift_y / 12).alias("v"), F.col("at_b").alias("corner"),
    )
    together = F.count(F.lit(1)).over(Window.partitionBy("a", "b", "r", "t"))
    votes = votes.withColumn("_n", together).where(F.col("_n") >= least)
    for du in (0, 1):
        for dv in (0, 1):  # every two by two neighbouring shifts are one square of one of these four tilings
            square = Window.partitionBy("a", "b", "r", "t", F.floor((F.col("u") + du) / 2), F.floor((F.col("v") + dv) / 2))
            votes = votes.withColumn(f"n{du}{dv}", F.size(F.collect_set("corner").over(square)))
    return votes.where(F.greatest("n00", "n01", "n10", "n11") >= least).select("a", "b").distinct()


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is written already, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= _BROADCAST else df


def _arrays(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and parts of each picture of a column of corners."""
    ends, flat = column.offsets.to_numpy(), column.values
    at, parts = flat.field("at").to_numpy(), np.stack([flat.field(f"p{i}").to_numpy() for i in range(TABLES)], 1)
    return ((at[k:n], parts[k:n]) for k, n in zip(ends[:-1], ends[1:]))


def _frequent(found: DataFrame, corners: int, least: int) -> set[int]:
    """Parts that so many corners have that a range would grow with them; from one picture in 16, a few thousand numbers at most. Decides who deals with a cell and not who meets."""
    least = max(least, corners // 4096)
    if corners <= least:
        return set()
    some = found.where(F.pmod(F.xxhash64("media_id"), F.lit(16)) == 0).select(F.inline("corners"))
    cells = some.select(F.explode(F.array(*(F.col(f"p{i}") + i * 2**32 for i in range(TABLES)))).alias("cell"))
    return {r["cell"] for r in cells.groupBy("cell").count().where(F.col("count") * 16 > least).select("cell").collect()}


#: Bytes of a corner's record: NEAR cells of one part, the other three parts, its place, its picture, the picture's group.
_FIELDS = {"cells": 6 * NEAR, "rest": 4 * (TABLES - 1), "at": 8, "media_id": 8, "c": 8}


def _dealt(own: DataFrame, ranges: int, frequent: set[int]) -> DataFrame:
    """(range, records) of the corners of ``own`` (media_id, c, corners): of each a record for each part, byte by byte over many corners."""
    common_parts = np.array(sorted(frequent), np.int64)

    def packed(media_id, c, at, parts):
        cells, n = _step_cells(at, parts), at.size
        for t in range(TABLES):
            rest = np.delete(parts, t, 1).astype("<u4")
            key = parts[:, t] + t * 2**32
            goes = np.repeat((_mix((key + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(ranges)).astype(np.int64), NEAR).reshape(n, NEAR)
            mine = cells[..., t]
            often = np.isin(key, common_parts)
            for some, columns in ((~often, [slice(0, NEAR)]), (often, [slice(k, k + 1) for k in range(NEAR)])):
                for k in columns if some.any() else []:
                    held = np.zeros((int(some.sum()), NEAR), "<u8")
                    held[:, : k.stop - k.start] = mine[some, k]
                    to = goes[some, 0] if k.stop - k.start == NEAR else (held[:, 0] % np.uint64(ranges)).astype(np.int64)
                    m = held.shape[0]
                    longs = [np.broadcast_to(np.asarray(v, "<i8"), n)[some] for v in (at, media_id, c)]
                    parts_of = [held.view(np.uint8).reshape(m, NEAR, 8)[..., :6].reshape(m, -1), np.ascontiguousarray(rest[some]).view(np.uint8).reshape(m, -1), *(np.ascontiguousarray(v).view(np.uint8).reshape(m, 8) for v in longs)]
                    used = held.any(1)
                    yield to[used], np.concatenate(parts_of, 1)[used]

    def batch_of(waiting):
        to, records = (np.concatenate(x) for x in zip(*waiting))
        order = np.argsort(to, kind="stable")
        to, records = to[order], records[order]
        which, first = np.unique(to, return_index=True)
        blobs = [np.ascontiguousarray(r.T).tobytes() for r in np.split(records, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "records"])

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            for i, c, (at, parts) in zip(batch.column("media_id").to_pylist(), batch.column("c").to_pylist(), _arrays(batch.column("corners"))):
                for to, records in packed(i, c, at, parts) if at.size > 1 else ():
                    waiting.append((to, records))
                    size += to.size
                if size >= _FLUSH:
                    yield batch_of(waiting)
                    waiting, size = [], 0
        if size:
            yield batch_of(waiting)
        common.release()

    return own.select("media_id", "c", "corners").mapInArrow(run, "range int, records binary")


_REST = [f"q{i}" for i in range(TABLES - 1)]
_MET = "a long, b long, at_a long, at_b long, cell long, n long, c long, " + ", ".join(f"{q} long" for q in _REST)


def _meetings(dealt: DataFrame, wide: int) -> DataFrame:
    """Corners (a, at_a, b, at_b) of different groups that meet in a cell and differ in DIFFER bits at most; those of cells with more than ``wide`` singly, without b."""
    names = [f.split()[0] for f in _MET.split(", ")]

    def rows(**columns):
        n = len(columns["a"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(r, np.uint8).reshape(sum(_FIELDS.values()), -1) for batch in batches for r in batch.column("records").to_pylist()]
        raw = np.split(np.concatenate(raw, 1), np.cumsum(list(_FIELDS.values()))[:-1])
        cells, rest, at, media_id, c = (np.ascontiguousarray(x.T) for x in raw)
        at, media_id, c, rest = at.view("<i8")[:, 0], media_id.view("<i8")[:, 0], c.view("<i8")[:, 0], rest.view("<u4")
        cells = np.pad(cells.reshape(-1, 6), ((0, 0), (0, 2))).view("<u8")[:, 0]
        order = np.argsort(cells, kind="stable")
        order = order[np.searchsorted(cells[order], 1) :]
        cells, row = cells[order], order // NEAR
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        sizes = np.diff(np.r_[first, cells.size])
        torn = np.minimum.reduceat(c[row], first) < np.maximum.reduceat(c[row], first)
        for kept in (torn & (sizes > wide), torn & (sizes <= wide)):
            some, size = row[np.repeat(kept, sizes)], sizes[kept]
            if not some.size:
                continue
            if size.max() > wide:
                yield rows(a=media_id[some], at_a=at[some], cell=cells[np.repeat(kept, sizes)], n=np.repeat(size, size), c=c[some], **{q: rest[some, k] for k, q in enumerate(_REST)})
                continue
            end, place, found = np.repeat(np.cumsum(size), size), np.arange(some.size), []
            for d in range(1, size.max()):
                i = place[: place.size - d][place[: place.size - d] + d < end[: place.size - d]]
                x, y = some[i], some[i + d]
                near = (c[x] != c[y]) & (np.bitwise_count(rest[x] ^ rest[y]).sum(1) <= DIFFER)
                x, y = x[near], y[near]
                less = media_id[x] < media_id[y]
                x, y = np.where(less, x, y), np.where(less, y, x)
                found.append(np.stack([media_id[x], at[x], media_id[y], at[y]], 1))
                if d == size.max() - 1 or sum(map(len, found)) > _FLUSH:
                    met = np.unique(np.concatenate(found), axis=0)
                    yield rows(a=met[:, 0], at_a=met[:, 1], b=met[:, 2], at_b=met[:, 3])
                    found = []
        common.release()

    return dealt.groupBy("range").applyInArrow(run, _MET)


def _joined(many: DataFrame) -> DataFrame:
    """What _meetings does, for corners of wide cells: each cell is joined with itself over as many tasks as it takes."""
    many = many.withColumn("salts", F.ceil(F.col("n") / 64).cast("int"))
    one, two = (many.select("cell", "salts", F.col("a").alias(x), F.col("at_a").alias(f"at_{x}"), F.col("c").alias(f"c_{x}"), *(F.col(q).alias(f"{q}_{x}") for q in _REST)) for x in ("a", "b"))
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    two = two.withColumn("salt", F.pmod(F.xxhash64("b", "at_b"), F.col("salts")).cast("int")).drop("salts")
    differ = sum((F.bit_count(F.col(f"{q}_a").bitwiseXOR(F.col(f"{q}_b"))) for q in _REST), F.lit(0))
    return one.join(two, ["cell", "salt"]).where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & (differ <= DIFFER)).select("a", "b", "at_a", "at_b")


def _cells_of(pairs: DataFrame) -> DataFrame:
    """All meetings (a, b, at_a, at_b) of pairs of pictures (a, b, corners_a, corners_b): corners that have a part in common and differ in DIFFER bits at most. Pairs with fewer than AGREE such corners are left out."""

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 4), np.int64)]
            for a, b, (at_a, p), (at_b, q) in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _arrays(batch.column("corners_a")), _arrays(batch.column("corners_b"))):
                one, two = [], []
                for k in range(0, at_a.size, _MEMO):
                    apart = p[k : k + _MEMO, None] ^ q[None]
                    i, j = np.nonzero((apart == 0).any(2) & (np.bitwise_count(apart).sum(2) <= DIFFER))
                    one.append(at_a[k + i])
                    two.append(at_b[j])
                one, two = np.concatenate(one), np.concatenate(two)
                if np.unique(two).size >= AGREE:
                    found.append(np.stack([np.full(one.size, a), np.full(one.size, b), one, two], 1))
            met = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in met.T], names=["a", "b", "at_a", "at_b"])

    return pairs.select("a", "b", "corners_a", "corners_b").mapInArrow(run, "a long, b long, at_a long, at_b long")


def _missed(found: DataFrame, corners: int, label: DataFrame, wide: int, frequent: int) -> DataFrame:
    """Pairs of copies that no star has linked: of different groups, met in cells of two corners, decided by all their cells."""
    own = found.join(_small(label.select(F.col("id").alias("media_id"), "component")), "media_id", "left").withColumn("c", F.coalesce("component", "media_id"))
    ranges = max(64, -(-corners * TABLES // RANGE))
    with common.scratch(_meetings(_dealt(own, ranges, _frequent(found, corners, frequent)), wide), "meetings") as met:
        narrow, many = met.where("b is not null").select("a", "b", "at_a", "at_b"), met.where("b is null")
        candidates = common.cut(_agreed(narrow if many.isEmpty() else narrow.union(_joined(many)), CANDIDATE))
    wanted = common.cut(candidates.select(F.explode(F.array("a", "b")).alias("media_id")).distinct())
    whole = found.join(_small(wanted), "media_id", "left_semi")
    one, two = (whole.select(F.col("media_id").alias(x), F.col("corners").alias(f"corners_{x}")) for x in ("a", "b"))
    return _agreed(_cells_of(candidates.join(one, "a").join(two, "b")), AGREE)


def copies(media: DataFrame, ids: DataFrame | None = None, wide: int = WIDE, frequent: int = FREQUENT) -> DataFrame:
    """One row per picture: media_id, n_corners, group_id (the smallest media_id among its copies).

    ``ids`` is where the media_id of all pictures are read from, if that costs less than reading ``media`` again.
    A corner goes through the tables as three longs: its cell (table and 32 bits), its picture, its place. ``wide`` and
    ``frequent`` decide how the cells of two corners are dealt and not what comes of them.
    """
    every = common.stage(pictures(media).withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.size("corners")), "corners")
    first = every.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("media_id", "row")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = common.cut(first.select("digest", F.col("first.media_id").alias("rep"), F.col("first.row").alias("kept")))
    again = common.cut(every.select("media_id", "digest", "row").join(_small(first), "digest").where(F.col("row") != F.col("kept")).select("media_id", "row", "rep"))
    equal = again.where(F.col("media_id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("media_id").alias("b")).distinct()
    found = every.where("n > 0").select("media_id", "row", "corners").join(_small(again.select("row")), "row", "left_anti")
    entries = found.select("media_id", F.inline("corners")).select("media_id", "at", F.explode(F.array(*(F.col(f"p{i}") + i * 2**32 for i in range(TABLES)))).alias("cell"))
    hubs = entries.groupBy("cell").agg(F.min("media_id").alias("hub"), F.min_by("at", "media_id").alias("hub_at"), F.max("media_id").alias("other"))
    met = entries.join(hubs.where("other > hub").drop("other"), "cell").where(F.col("media_id") != F.col("hub"))
    links = common.cut(_agreed(met.select(F.col("hub").alias("a"), F.col("media_id").alias("b"), F.col("hub_at").alias("at_a"), F.col("at").alias("at_b")), AGREE).union(equal))
    label = components.components(links)
    corners = every.agg(F.sum("n")).first()[0] or 0
    more = common.cut(_missed(found, corners, label, wide, frequent))
    if not more.isEmpty():
        label = components.components(links.union(more))
    sums = every.groupBy("media_id").agg(F.sum("n").alias("n_corners"))
    ids = (media if ids is None else ids).select(F.col("media_id").cast("long").alias("media_id"))
    out = ids.join(sums, "media_id", "left").join(label.select(F.col("id").alias("media_id"), "component"), "media_id", "left")
    return out.select("media_id", F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("component", "media_id").alias("group_id"))


#: How every fourth rendered picture is edited, in turn.
EDITS = ("crop", "turn", "scale", "light")


def render(vectors: DataFrame, size: int = 64) -> DataFrame:
    """Pictures for a table of vectors (vec_id, embedding): blocks and spots placed by the vector's numbers.

    Every fourth picture by id is an edited copy of the one before it: cropped at two sides, turned by a right angle, made
    smaller, or with other light and contrast, each with some noise. There is no table of pictures, so this is what the media query runs
    over; columns media_id, pixels, width, height, source_id (what it was made from), edit (null for originals).
    """
    before = Window.partitionBy(F.floor(F.col("vec_id") / 4)).orderBy("vec_id")
    source = vectors.select("vec_id", "embedding", F.lag("vec_id").over(before).alias("source"), F.lag("embedding").over(before).alias("other"))

    def run(batches):
        names = ["media_id", "pixels", "width", "height", "source_id", "edit"]
        for batch in batches:
            rows = []
            for i, own, s, other in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "embedding", "source", "other"))):
                copy = i is not None and i % 4 == 3 and s is not None and other is not None
                picture, kind = _picture(other if copy else own, size, s if copy else i), None
                if copy:
                    kind = EDITS[i // 4 % len(EDITS)]
                    picture = _edited(picture, kind, i)
                rows.append((i, picture.tobytes(), picture.shape[1], picture.shape[0], s if copy else i, kind))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=names)

    return source.mapInArrow(run, "media_id long, pixels binary, width int, height int, source_id long, edit string")


def _edited(picture: np.ndarray, kind: str, i: int) -> np.ndarray:
    x = picture.astype(float)
    if kind == "crop":
        cut = 5 + i % 7
        x = x[cut:, : x.shape[1] - cut // 2] * 0.93 + 9
    elif kind == "turn":
        x = np.rot90(x, 1 + i // 16 % 3)
    elif kind == "scale":
        x = _scaled(x, 0.75)
    else:
        x = x * 0.7 + 40
    return np.ascontiguousarray(np.clip(x + np.random.default_rng(i).normal(0, 1.5, x.shape), 0, 255).astype(np.uint8))


def _picture(vector, size: int, seed: int | None) -> np.ndarray:
    v = np.nan_to_num(np.array([x or 0.0 for x in vector or [0.0]], float))
    rng = np.random.default_rng([abs(int(x * 1e6)) for x in v] + [seed or 0])
    out = np.full((size, size), 40.0)
    for _ in range(26):
        y, x = rng.integers(0, size, 2)
        h, w = rng.integers(4, 18, 2)
        out[y : y + h, x : x + w] = rng.integers(0, 255)
    return out.astype(np.uint8)
