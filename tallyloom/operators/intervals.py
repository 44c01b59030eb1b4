"""Interval and time-axis operators: rates in effect, occupancy, union length, stretches, bins, days touched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_effect(rows: DataFrame, rates: DataFrame, key: str, day: Column) -> DataFrame:
    """Left join with the rate interval (key, valid_from, valid_to; inclusive, null is open) of each row's day.

    An unknown day matches only a key with a single interval that is open on both sides. Rate tables are
    small by nature (a row for each model and price change); Spark broadcasts them by their size.
    """
    lone = F.count(F.lit(1)).over(Window.partitionBy(F.col("key")))
    r = rates.withColumn("_lone", (lone == 1) & F.col("valid_from").isNull() & F.col("valid_to").isNull())
    own = rows.withColumn("_day", day)
    hit = (F.col("valid_from").isNull() | (F.col("_day") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("_day") <= F.col("valid_to")))
    return own.join(r, (own[key] == r["key"]) & (hit | F.col("_lone")) & (F.col("_day").isNotNull() | F.col("_lone")), "left").drop("_day", "_lone", "key")


def _axis(df: DataFrame, at: str) -> Column:
    """A bucket of the time axis for each row: a few for every shuffle partition, so that a key with a third of all rows is
    sorted by many tasks. What crosses an edge between buckets is put right from a row a bucket."""
    low, high = df.agg(F.min(at), F.max(at)).first()
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 1 if low is None else max(1, -(-(int(high) - int(low) + 1) // parts))
    return F.call_function("div", F.col(at).cast("long") - F.lit(int(low or 0)).cast("long"), F.lit(width).cast("long"))


def occupancy(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Segments (keys, t0, t1, level) of how many intervals are open; ends come before starts at one time."""
    ok = df.where(F.col(end) > F.col(start))
    steps = ok.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    at = steps.groupBy(*keys, F.col("e.t").alias("t0")).agg(F.sum("e.d").alias("_d"))
    at = at.withColumn("_b", _axis(steps.select(F.col("e.t").alias("t0")), "t0"))
    over = Window.partitionBy(*keys).orderBy("_b")
    edges = at.groupBy(*keys, "_b").agg(F.sum("_d").alias("_sum"), F.min("t0").alias("_first"))
    edges = edges.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_b").alias("_k"), F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"), F.lead("_first").over(over).alias("_next"))
    w = Window.partitionBy(*keys, "_b").orderBy("t0")
    level = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    own = at.select(*keys, "_b", "t0", F.lead("t0").over(w).alias("_t1"), level.alias("_level"))
    same = own["_b"] == edges["_k"]
    for k in keys:
        same = same & own[k].eqNullSafe(edges[f"_k_{k}"])
    own = own.join(edges, same)
    return own.select(*keys, "t0", F.coalesce("_t1", "_next").alias("t1"), (F.col("_level") + F.col("_open")).cast("long").alias("level")).where("level > 0")


def concurrency(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, most, points): the most intervals open at a time, and how many have no length; keys with points alone are left out."""
    points = df.where(F.col(end) == F.col(start)).groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))
    most = occupancy(df, keys, start, end).groupBy(*keys).agg(F.max("level").alias("most"))
    return most.join(points, list(keys), "left").select(*keys, "most", F.coalesce("points", F.lit(0)).alias("points"))


def wide_gaps(df: DataFrame, keys: Sequence[str], at: str, share: float = 0.2) -> DataFrame:
    """(keys, t0, t1) of stretches without a mark that are at least ``share`` of what all marks of the key span."""
    w = Window.partitionBy(*keys)
    own = df.select(*keys, F.col(at).alias("t1"), (F.max(at).over(w) - F.min(at).over(w)).alias("_span")).withColumn("t0", F.lag("t1").over(w.orderBy("t1")))
    return own.where((F.col("t1") - F.col("t0")) >= F.col("_span") * share).select(*keys, "t0", "t1")


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, active, span, n_islands): length of the union of intervals and of all they span. Inverted ones are left out."""
    ok = df.where(F.col(end) >= F.col(start)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ok.withColumn("_reach", reach)
    gained = F.when(F.col("_reach").isNull(), F.col("_e") - F.col("_s")).otherwise(F.greatest(F.lit(0), F.col("_e") - F.greatest("_s", "_reach")))
    fresh = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach"))
    return new.groupBy(*keys).agg(F.sum(gained).cast("long").alias("active"), (F.max("_e") - F.min("_s")).cast("long").alias("span"), F.count_if(fresh).alias("n_islands"))


def empty_stretches(df: DataFrame, keys: Sequence[str], at: str, least: int) -> DataFrame:
    """(keys, t0, t1) of stretches of ``least`` or more without a mark, between marks."""
    own = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("t1"))
    own = own.withColumn("_b", _axis(own, "t1"))
    inside = own.select(*keys, F.lag("t1").over(Window.partitionBy(*keys, "_b").orderBy("t1")).alias("t0"), "t1")
    edges = own.groupBy(*keys, "_b").agg(F.min("t1").alias("t1"), F.max("t1").alias("_last"))
    edges = edges.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("t0"), "t1")
    return inside.unionByName(edges).where(F.col("t1") - F.col("t0") >= least)


def bins(df: DataFrame, keys: Sequence[str], at: str, origin: int, width: int) -> DataFrame:
    """(keys, bin, n) of marks by columns of a fixed width."""
    return df.groupBy(*keys, F.floor((F.col(at) - origin) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fitting_bins(df: DataFrame, at: str, origin: int, width: int, most: int) -> tuple[DataFrame, int]:
    """Bins of the least doubled width for which there are at most ``most`` (1 at least).

    One pass: the bins of the finest width are lifted to every doubling at once, and a count a doubling comes to the driver. Marks on both
    sides of the origin never share a bin.
    """
    fine = bins(df, [], at, origin, width)
    levels = fine.where("bin is not null").select(F.explode(F.sequence(F.lit(0), F.lit(62))).alias("k"), "bin")
    lifted = levels.select("k", F.expr("shiftright(bin, k)").alias("bin")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    wide = max(0, min((r["k"] for r in lifted.where(F.col("n") <= max(1, most)).collect()), default=62 if not df.isEmpty() else 0))
    return fine.groupBy(F.expr(f"shiftright(bin, {wide})").alias("bin")).agg(F.sum("n").cast("long").alias("n")), width << wide


def days_touched(df: DataFrame, start: str, end: str) -> DataFrame:
    """(day, n): intervals that touch each calendar day.

    One step up at the first day and one down after the last; what is sorted are the days on which a step falls, of
    which a calendar has few, and not the days of all intervals.
    """
    a, b = F.to_date(start), F.to_date(end)
    steps = df.where(b >= a).select(F.explode(F.array(F.struct(a.alias("d"), F.lit(1).alias("n")), F.struct(F.date_add(b, 1).alias("d"), F.lit(-1).alias("n")))).alias("e"))
    steps = steps.groupBy(F.col("e.d").alias("d")).agg(F.sum("e.n").alias("n"))
    w = Window.orderBy("d")  # a row a calendar day at most
    level = steps.select("d", F.date_sub(F.lead("d").over(w), 1).alias("last"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("n")).where("n > 0")
    return level.select(F.explode(F.sequence("d", "last")).alias("d"), "n").select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n")
