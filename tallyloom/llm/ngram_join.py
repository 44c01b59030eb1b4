"""N-gram Jaccard join by parity sketches, exact.

A document's set of word 5-grams is hashed to 64 bits each. For a size band the sketch is an array of
cells (SPREAD times the band's largest size): a hash falls into one cell and is XORed into it. An element
that only one of two sets has changes one cell, so the number of differing cells is at most the
symmetric difference, which for Jaccard >= 3/4 is at most (|A| + |B|) / 7 = d. Hence of the cells of
both, all but d agree, and by the pigeonhole principle two such documents share one of their d + 1
first cells under any fixed order of cell values. The order used is rarest first (by counts of a
sample; it decides the cost only), empty cells last. Sizes of a pair differ by 4/3 at most, so a
document emits its cells in its own band and, near the upper end, in the next.

Cells that meet link their documents to the most central one there (a star, never all pairs): the one
whose cells are the most frequent on average, which in a group of edited copies is what they are copies of. Cells that
the sample shows to be frequent are dealt over many tasks first, and the centres of these parts meet again. A packed
parity sketch of one or two bits a shingle, whose Hamming distance is a lower bound too, drops most
false meetings, and whole sets verify the rest.

Where after that the documents of one cell are in several components (the cell is torn), the
pairs between different components are looked at as well, once for all torn cells of the same documents; pairs within one need not be. With each cell goes its document's
``lone``: the number of cells before it, in the order, that hold a single element. Of the first cell that two documents
share, all those before are shared by none of them; one of a single element that differs stands for an element of its own
in the symmetric difference, so lone(A) + lone(B) <= d is needed there. With excess = 7 * lone - size this is excess(A) + excess(B) <= 0:
two documents of positive excess, as those that share a passage or a template but have more than a seventh of their
own, are never put together. The join is on cell and size band, of documents of excess <= 0 with those of
opposite excess; full sketches and whole sets decide. So every link between components is found, and the components are those of all links.

Equal sets are taken once per task first (of MEMO sets), then once overall.

Defined results: texts without words (null, empty, blank) have size 0 and are alone; rows that share a
doc_id are one document with several texts; a null doc_id has a null component and links nothing;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import common, components

WORDS, BAND, LEAST_BITS = 5, 4, 1024
LEAST_LONGS = LEAST_BITS // 64
#: One of SAMPLE texts is counted for the order of cells; slots seen RARE times or more there are ranked, the COUNTED most frequent at most.
SAMPLE, RARE, SLOTS, COUNTED = 8, 2, 1 << 26, 1 << 18
#: Cells of a sketch for each element of the band's largest set; rows of one cell that go to one task (about), by the sample; sets a task remembers.
SPREAD, PART, MEMO = 8, 1 << 15, 1 << 19
_U = np.uint64
#: Words whose hashes a worker keeps, hashes or keys that a task holds before it passes them on.
_MEMO, _HELD = 150_000, 1 << 18
_PLACE = 1 << 32  # a cell's place: part * _PLACE + lone


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words of a worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(32))) * _U(0xD6E8FEB86659FD93)
    z = (z ^ (z >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return z ^ (z >> _U(32))


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's 5-word shingles; of all its words where it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, n)
    size = min(n, WORDS)
    out = np.full(n - size + 1, size, _U)
    for k in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
    return np.unique(_mix(out))


def _band(size: int) -> int:
    """Cells of the sketch of a size's band: SPREAD times the power of BAND above the size."""
    top = BAND
    while top <= size:
        top *= BAND
    return SPREAD * top


def ranked(hashes: np.ndarray, slots: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How frequent each shingle is: the rank of its slot, 0 for one that isn't counted."""
    if not slots.size:
        return np.zeros(hashes.size, np.int64)
    slot = (hashes & _U(SLOTS - 1)).astype(np.int64)
    at = np.minimum(np.searchsorted(slots, slot), slots.size - 1)
    return np.where(slots[at] == slot, ranks[at], 0)


def keys(hashes: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The 64-bit keys of the d + 1 first cells of a set, their ``lone`` and ranks, in its own band and where needed in the next."""
    n = hashes.size
    if not n:
        return []
    need = (n + 4 * n // 3) // 7 + 1
    out = []
    for cells in dict.fromkeys((_band(n), _band(4 * n // 3))):
        cell = ((hashes >> _U(24)) % _U(cells)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        cell = cell[starts]
        value = np.bitwise_xor.reduceat(hashes[order], starts)
        common_ = np.maximum.reduceat(rank[order], starts)
        key = _mix(value ^ _mix(cell.astype(_U) * _U(0x2545F4914F6CDD1D) + _U(cells)))
        first = np.lexsort((key, common_))
        alone = (np.diff(starts, append=n) == 1)[first]
        lone = np.cumsum(alone) - alone
        out.append((key[first[:need]], lone[:need], common_[first[:need]]))
        if cell.size < need:  # then cells without elements count too, in their order
            empty = np.setdiff1d(np.arange(min(cells, need + cell.size)), cell)[: need - cell.size]
            key = _mix(empty.astype(_U) * _U(0x2545F4914F6CDD1D) + _U(cells) ^ _U(0x5DEECE66D))
            out.append((key, np.full(key.size, int(alone.sum())), np.zeros(key.size, np.int64)))
    return out


def places(lone: np.ndarray, rank: np.ndarray, doc: int) -> np.ndarray:
    """part * _PLACE + lone of a document's cells: part is 0 but for frequent cells, of which each gets about PART documents a part."""
    parts = (_U(SAMPLE) << np.minimum(rank, 50).astype(_U)) // _U(PART)
    if not parts.any():
        return lone.astype(np.int64)
    own = _mix(np.array([doc], np.int64).view(_U))[0]
    return (np.where(parts > 0, 1 + own % np.maximum(parts, _U(1)), _U(0)).astype(np.int64) * _PLACE) + lone


def _sketch(hashes: np.ndarray) -> list[int]:
    """The packed parity sketch: bit i is the parity of the number of hashes that fall on it.

    It has as many bits as the power of two from the size of the set on. Sizes of a pair differ by 4/3 at
    most, so their sketches are of one length or one is twice the other; that one's halves are then XORed.
    """
    n_bits = LEAST_BITS
    while n_bits < hashes.size:
        n_bits *= 2
    bits = np.bincount(((hashes >> _U(8)) & _U(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8").tolist()


def _texts(batches):
    """(doc_id, hashes) of the rows of Arrow batches."""
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            yield doc, shingles(text.as_py())


def _counts(batches):
    """slot, n: how many documents of a run have a shingle in the slot; sets that the task has seen (of the last MEMO) count once."""
    import pyarrow as pa
    import xxhash

    def counted(own: list[np.ndarray]):
        slot, n = np.unique(np.concatenate([*own, np.zeros(0, _U)]).astype(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    seen: set[bytes] = set()
    own: list[np.ndarray] = []
    held = 0
    for _, hashes in _texts(batches):
        if (digest := xxhash.xxh3_128_digest(hashes.tobytes())) not in seen:
            if len(seen) >= MEMO:
                seen.clear()
            seen.add(digest)
            own.append(hashes & _U(SLOTS - 1))
            held += hashes.size
        if held >= _HELD:
            yield counted(own)
            own, held = [], 0
    yield counted(own)
    _words.clear()  # the worker may go on to something else
    common.release()


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of shingles that many documents of a sample share, ascending, and the log2 of their counts.

    At most COUNTED pairs of integers: a fixed bound for what is broadcast. They order cells and so decide
    how many documents meet for nothing; which links are found doesn't depend on them.
    """
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE)
    with common.scratch(counts, "counts") as counts:
        level = F.floor(F.log2("n") * 64).cast("int")
        least, room = 0, COUNTED
        for lv, k in sorted(((r["lv"], r["count"]) for r in counts.groupBy(level.alias("lv")).count().collect()), reverse=True):
            room -= k
            if room < 0:
                least = lv + 1
                break
        got = sorted((r["slot"], r["n"]) for r in counts.where(level >= least).collect())
    return np.array([s for s, _ in got], np.int64), np.log2(np.array([n for _, n in got], float) + 1e-9).astype(np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, leader (a row of the task with the same set); of leaders digest, sketch, centre (the smaller the more central), cell keys and their places."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("leader", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64())), ("centre", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])
        first: dict[bytes, int] = {}
        slots, ranks = shared.value

        def lists(own: list, kind):
            ends = np.cumsum([0, *(0 if k is None else k.size for k in own)])
            flat = np.concatenate([np.zeros(0, kind), *(k for k in own if k is not None)]).view(np.int64)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([k is None for k in own]))

        def flush(rows: list[tuple]):
            *plain, own, at = zip(*rows)
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(plain, schema)), lists(own, _U), lists(at, np.int64)], schema=schema)

        rows: list[tuple] = []
        n_keys = 0
        for doc, hashes in _texts(batches):
            row = (doc, hashes.size, doc, *[None] * 5)
            if doc is not None and hashes.size:
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                if len(first) >= MEMO:
                    first.clear()
                leader = first.setdefault(digest, doc)
                row = (doc, hashes.size, leader, *[None] * 5)
                if leader == doc:
                    rank = ranked(hashes, slots, ranks)
                    own, lone, common_ = map(np.concatenate, zip(*keys(hashes, rank)))
                    row = (doc, hashes.size, doc, digest, _sketch(hashes), -int(64 * rank.mean()), own, places(lone, common_, doc))
                    n_keys += own.size
            rows.append(row)
            if n_keys >= _HELD or len(rows) >= 10_000:
                yield flush(rows)
                rows, n_keys = [], 0
        if rows:
            yield flush(rows)
        _words.clear()
        common.release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, leader long, digest binary, sketch array<long>, centre long, keys array<long>, places array<long>")


def _stars(batches):
    """(key, hub, hub_lone, doc_id, lone, centre, part) for rows in order of key, part, centre and doc_id: every document of a key's part with its first.

    The first with itself comes out only where the key has parts, for the parts have still to meet.
    """
    import pyarrow as pa

    names = ("key", "part", "doc_id", "centre", "lone")
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, doc, centre, lone = (batch.column(c).to_numpy() for c in names)
        new = np.concatenate([[last is None or (key[0], part[0]) != last[:2]], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        starts = np.maximum.accumulate(np.where(new, np.arange(key.size), -1))
        before = last or (0, 0, 0, 0, 0)
        hub, of, hub_lone = (np.where(starts >= 0, x[np.maximum(starts, 0)], y) for x, y in zip((doc, centre, lone), before[2:]))
        last = key[-1], part[-1], hub[-1], of[-1], hub_lone[-1]
        meet = (hub != doc) | (new & (part > 0))
        yield pa.RecordBatch.from_arrays([pa.array(x[meet]) for x in (key, hub, hub_lone, doc, lone, of, part)], names=["key", "hub", "hub_lone", "doc_id", "lone", "centre", "part"])


_MET = "key long, hub long, hub_lone long, doc_id long, lone long, centre long, part long"


def _meet(cells: DataFrame) -> DataFrame:
    """The stars of rows (key, lone, part, doc_id, centre): what differs between a document's rows stands side by side, which shuffle files compress better."""
    return cells.repartition("key", "part").sortWithinPartitions("key", "part", "centre", "doc_id").mapInArrow(_stars, _MET)


@F.pandas_udf(T.BooleanType())
def _jaccard(a, b):
    """Whether 100 * intersection >= 75 * union, for pairs of sets as raw ascending hashes."""
    import pandas as pd

    def linked(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
        at = np.minimum(np.searchsorted(y, x), y.size - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= 75 * (x.size + y.size - both)

    return pd.Series([linked(x, y) for x, y in zip(a, b)], dtype="boolean")


def _sets(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            got = list(_texts([batch.slice(at, 500)]))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array([h.tobytes() for _, h in got], pa.binary())], names=["id", "hashes"])
    _words.clear()
    common.release()


def _apart(a: str, b: str):
    """Differing bits of two sketches; the longer one is folded to the length of the other."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def folded(x: str, n):
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), xor)).otherwise(F.col(x))

    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, n), folded(b, n), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + x)


def _fold(sketch: str, k: int):
    """The k-th long of a sketch folded to LEAST_BITS."""
    return F.aggregate(F.filter(sketch, lambda x, i: i % LEAST_LONGS == k), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: first by size and packed sketch, then by whole sets.

    ``sets`` has doc_id, n_shingles and sketch of one document for each set.
    """
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(4 * small >= 3 * large).where(7 * _apart("s_a", "s_b") <= F.col("n_a") + F.col("n_b"))
    near = common.cut(near.select("a", "b").distinct())
    # A table on disk, so that Spark knows its size and sends the few ids to the texts and not the texts to them.
    with (
        common.scratch(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids") as ids,
        common.scratch(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "id long, hashes binary"), "sets") as own,
    ):
        one, two = (own.select(F.col("id").alias(x), F.col("hashes").alias(f"h_{x}")) for x in ("a", "b"))
        return common.cut(near.join(two, "b").join(one, "a").where(_jaccard("h_a", "h_b")).select("a", "b").distinct())


def _crossing(members: DataFrame, sets: DataFrame, keep) -> DataFrame:
    """Pairs (a, b) of different components that share a cell and may be links by excess, size and folded sketch.

    ``members`` has key, rep, c (component), n (size) and excess of the documents of torn cells; ``keep`` writes a table for a while.
    """
    # Cells of the same documents (those of one passage) count as one; the least excess of a document is what counts there.
    own = F.xxhash64("rep")
    alike = members.groupBy("key").agg(F.bit_xor(own).alias("_x"), F.bit_xor(F.xxhash64(own, "rep")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    members = members.join(alike, "key").groupBy(F.xxhash64("_x", "_y", "_n").alias("key"), "_x", "_y", "rep", "c", "n").agg(F.min("excess").alias("excess")).drop("_x", "_y")
    # Those that no document there can offset go first. A row of the least excess stays; it has opposites or none stays in the join.
    least = members.groupBy("key").agg(F.min(F.struct("excess", "c")).alias("_m")).where("_m.excess <= 0")
    left = members.join(least, "key").where((F.col("excess") + F.col("_m.excess") <= 0) | (F.col("c") == F.col("_m.c"))).drop("_m")
    folds = [_fold("sketch", k).alias(f"x{k}") for k in range(LEAST_LONGS)]
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.34))  # a little over 4/3: sizes of a pair are one band apart at most
    left = left.join(sets.select(F.col("doc_id").alias("rep"), *folds), "rep").withColumn("band", band)
    left = keep(left, "opposites")
    one, two = (left.select("key", "band", *(F.col(c).alias(f"{c}_{i}") for c in left.columns if c not in ("key", "band"))) for i in ("a", "b"))
    one = one.where("excess_a <= 0").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    alike = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    once = (F.col("excess_b") > 0) | (F.col("rep_a") < F.col("rep_b"))
    apart = sum((F.bit_count(F.col(f"x{k}_a").bitwiseXOR(F.col(f"x{k}_b"))) for k in range(LEAST_LONGS)), F.lit(0))
    met = one.join(two, ["key", "band"]).where((F.col("c_a") != F.col("c_b")) & once & (F.col("excess_a") + F.col("excess_b") <= 0) & alike & (7 * apart <= F.col("n_a") + F.col("n_b")))
    return met.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with contextlib.ExitStack() as tables:
        label, every = _labels(docs, lambda df, name: tables.enter_context(common.scratch(df, name)))
    out = every.join(label.select(F.col("id").alias("leader"), "component"), "leader", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "leader").alias("component_id"))


def _labels(docs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the linked documents, and the summary of all; ``keep`` writes a table that goes when both are there."""
    with common.scratch(profiles(docs), "profiles") as found:
        every = common.stage(found.drop("keys", "places", "centre"), "summaries")
        cells = found.select("doc_id", "centre", F.explode(F.arrays_zip("keys", "places")).alias("_c"))
        part, lone = F.floor(F.col("_c.places") / _PLACE), F.col("_c.places") % _PLACE
        parts = keep(_meet(cells.select(F.col("_c.keys").alias("key"), lone.alias("lone"), part.alias("part"), "doc_id", "centre")), "parts")
    centres = parts.where("part > 0 and hub = doc_id").select("key", "lone", F.lit(0).cast("long").alias("part"), "doc_id", "centre")
    meetings = parts.where("hub != doc_id").union(keep(_meet(centres), "centres")).drop("part")
    leaders = every.where(F.col("digest").isNotNull())
    same = leaders.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    of = keep(leaders.join(same, "digest").select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")), "representatives")
    sets = of.where(F.col("sketch").isNotNull())

    own = every.where(F.col("digest").isNotNull() | (F.col("doc_id") != F.col("leader"))).select("doc_id", "leader")
    reps = common.cut(own.join(of.select(F.col("doc_id").alias("leader"), "rep"), "leader").select("doc_id", "rep").distinct())

    copies = of.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(own.select("doc_id", "leader")).where("a != b")
    # Each document's most central partner first; of the other pairs only those that are still apart.
    first = common.cut(_as_reps(meetings.groupBy("doc_id").agg(F.min_by("hub", "centre").alias("hub")), reps))
    links = common.cut(verified(first, docs, sets).union(copies))
    label = components.components(links)

    def astride() -> DataFrame:
        """The meetings whose two documents are in different components."""
        ends = [label.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in ("hub", "doc_id")]
        both = meetings.join(ends[0], "hub", "left").join(ends[1], "doc_id", "left")
        return both.where(F.coalesce("c_hub", "hub") != F.coalesce("c_doc_id", "doc_id")).select("key", "hub", "doc_id")

    tried = common.cut(_as_reps(astride().select("hub", "doc_id").distinct(), reps).union(first).distinct())
    more = verified(tried.join(first, ["a", "b"], "left_anti"), docs, sets)
    if not more.isEmpty():
        links = common.cut(links.union(more))
        label = components.components(links)

    torn = astride().select("key").distinct()
    there = meetings.join(torn, "key", "left_semi")
    hubs = there.groupBy("key", "hub").agg(F.min("hub_lone").alias("lone"))  # once a cell, not once a meeting
    members = hubs.withColumnRenamed("hub", "id").union(there.select("key", "doc_id", "lone"))
    who = of.select(F.col("doc_id").alias("id"), "rep", "n_shingles")
    members = members.join(label, "id", "left").join(who, "id").select("key", "rep", F.coalesce("component", "id").alias("c"), F.col("n_shingles").alias("n"), (7 * F.col("lone") - F.col("n_shingles")).alias("excess"))
    crossing = _crossing(keep(members.distinct(), "members"), sets, keep)
    more = verified(crossing.join(tried, ["a", "b"], "left_anti"), docs, sets)
    if not more.isEmpty():
        label = components.components(links.union(more))
    return label, every


def _as_reps(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (hub, doc_id) as distinct pairs a < b of the documents that stand for their sets."""
    x, y = (reps.select(F.col("doc_id").alias(i), F.col("rep").alias(f"r_{i}")) for i in ("hub", "doc_id"))
    both = pairs.join(x, "hub").join(y, "doc_id").where(F.col("r_hub") != F.col("r_doc_id"))
    return both.select(F.least("r_hub", "r_doc_id").alias("a"), F.greatest("r_hub", "r_doc_id").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies, that of the smallest doc_id (null last); rows without words all stay.

    Rows and not documents are grouped: of repeated rows one stays, whatever their doc_id, and a row never goes because of
    another one with its doc_id.
    """
    own = common.stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(own.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), "_row")
    first = own.select("_row", "doc_id").join(groups, "_row").groupBy("_group").agg(F.min(rank)["_row"].alias("_row"))
    return own.join(first, "_row", "left_semi").select(*docs.columns)
