"""Operators over ordered rows: keep-last, turns, bounds, pairing, as-of, gaps, canonical copies, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The last row of each key in recorded order: a hash aggregate with map-side combine, no sort."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(sequence)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col("_last")[c].alias(c) for c in rest))


def turns(df: DataFrame, source: str, sequence: str, opener: Column, name: str = "turn_idx") -> DataFrame:
    """Each row's turn: the number of openers up to it in its source; rows before the first are turn 0."""
    so_far = Window.partitionBy(source).orderBy(sequence).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(opener, F.lit(False)).cast("int")).over(so_far).cast("long"))


def turn_windows(openers: DataFrame, source: str, at: str, sequence: str) -> DataFrame:
    """Each opener's window [start, end): starts never run backwards (and are flagged where they were moved); the last is open."""
    by = Window.partitionBy(source).orderBy(sequence)
    start = F.max(at).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = openers.withColumn("start", start)
    return out.withColumn("clamped", F.col(at) < F.col("start")).withColumn("end", F.lead("start").over(by))


def asof(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """``rows`` with the ``value`` of the last mark at or before ``at``: both sides in one window, no range join."""
    both = rows.select("*", F.lit(None).cast(marks.schema[value].dataType).alias(name), F.lit(1).alias("_side"))
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) if c not in (*keys, at) else F.col(c) for c in rows.columns]
    both = both.unionByName(marks.select(*blank, F.col(value).alias(name), F.lit(0).alias("_side")))
    before = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(before)).where("_side = 1").drop("_side")


def fifo_pairs(df: DataFrame, key: str, sequence: str, is_open: Column, is_close: Column) -> DataFrame:
    """Openers with closers of one key, first open first; a closer pairs only with an earlier opener.

    A closer is matched when the balance of open ones before it, floored at 0, is positive; matched
    closers and openers then pair by rank. (key, k, open_seq, close_seq), either side null if unmatched.
    """
    step = df.where(is_open | is_close).select(key, F.col(sequence).alias("_seq"), F.when(is_open, 1).otherwise(-1).alias("_d"))
    so_far, before = (Window.partitionBy(key).orderBy("_seq").rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    step = step.withColumn("_sum", F.sum("_d").over(so_far))
    floor = F.least(F.lit(0), F.coalesce(F.min("_sum").over(before), F.lit(0)))
    held = F.coalesce(F.sum("_d").over(before), F.lit(0)) - floor
    step = step.withColumn("_kind", F.when(F.col("_d") == 1, "open").when(held > 0, "close").otherwise("stray"))
    step = step.withColumn("k", F.row_number().over(Window.partitionBy(key, "_kind").orderBy("_seq")).cast("long"))
    opened = step.where("_kind = 'open'").select(key, "k", F.col("_seq").alias("open_seq"))
    closed = step.where("_kind = 'close'").select(key, "k", F.col("_seq").alias("close_seq"))
    stray = step.where("_kind = 'stray'").select(key, F.lit(None).cast("long").alias("k"), F.lit(None).cast(df.schema[sequence].dataType).alias("open_seq"), F.col("_seq").alias("close_seq"))
    return opened.join(closed, [key, "k"], "left").unionByName(stray)


def canonical(copies: DataFrame, key: str, place: str, preferred: Column, at: str) -> DataFrame:
    """One place for every key found in two or more: the only preferred one, else the earliest, else the least name.

    (key, canonical, n_places, clause): which rule decided, 'i', 'ii' or 'iii'. All by aggregation.
    """
    own = copies.select(key, F.col(place).alias("_place"), F.coalesce(preferred, F.lit(False)).alias("_own"), F.col(at).alias("_at"))
    own = own.groupBy(key, "_place").agg(F.bool_and("_own").alias("_own"), F.min("_at").alias("_at"))
    far = F.lit(2**62)
    rank = F.struct(F.coalesce(F.col("_at").cast("long"), far).alias("at"), F.col("_place").alias("place"))
    first = F.coalesce(F.col("_at").cast("long"), far)
    got = own.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_places"),
        F.count_if("_own").alias("_n_own"),
        F.min(F.when(F.col("_own"), F.col("_place"))).alias("_own_place"),
        F.min(rank).alias("_first"),
        F.max(F.struct(-first, F.col("_place"))).alias("_last"),
    ).where("n_places > 1")
    clause = F.when(F.col("_n_own") == 1, "i").when(F.col("_last")["_place"] == F.col("_first")["place"], "ii").otherwise("iii")
    return got.select(key, F.when(F.col("_n_own") == 1, F.col("_own_place")).otherwise(F.col("_first")["place"]).alias("canonical"), F.col("n_places").cast("long").alias("n_places"), clause.alias("clause"))


def partners(copies: DataFrame, key: str, place: str) -> DataFrame:
    """Pairs of places that share keys, and how many (a < b).

    Places of a key are made distinct first; the pairs are those of places that really share a key, of which
    there are few (sources, sessions), not those of its rows.
    """
    own = copies.where(F.col(key).isNotNull()).select(key, place).distinct()
    shared = own.join(own.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), key, "left_semi")
    a, b = shared.select(key, F.col(place).alias("a")), shared.select(key, F.col(place).alias("b"))
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def latest(df: DataFrame, keys: Sequence[str], sequence: str, values: Sequence[str]) -> DataFrame:
    """Per key the latest recorded value of each column (nulls skipped) and how many rows recorded it."""
    aggs = [a for v in values for a in (F.max_by(v, F.when(F.col(v).isNotNull(), F.col(sequence))).alias(v), F.count(v).alias(f"n_{v}"))]
    return df.groupBy(*keys).agg(*aggs)


def lineage(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(id, root, depth, cyclic) of every child and parent: pointer jumping, so log2(depth) rounds of joins.

    An id that meets itself upwards is cyclic and has a null root. Rounds go on until all ids have a root or one
    adds no root: while an id without a cycle above it is open, each round finishes at least one.
    """
    from tallyloom.operators.storage import cut

    up = edges.select(F.col(child).alias("id"), F.col(parent).alias("up")).where("id is not null")
    ids = up.select("id").union(up.where("up is not null").select("up")).distinct()
    state = ids.join(up.groupBy("id").agg(F.min("up").alias("up")), "id", "left").select("id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.coalesce("up", "id").alias("root"))
    open_before = None
    while True:
        state = cut(state)
        still = state.where("up is not null").count()
        if not still or still == open_before:
            break
        open_before = still
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        state = state.join(above, "up", "left").select("id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_root", "root").alias("root"))
    loop = F.col("up").isNotNull()
    return state.select("id", F.when(~loop, F.col("root")).alias("root"), F.when(~loop, F.col("depth").cast("long")).alias("depth"), loop.alias("cyclic"))
