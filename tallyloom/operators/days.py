"""Calendar days of a named time zone: the day of an instant, turns by the days they touch, ranges of days, months.

An instant is milliseconds since 1970. Days are those of the zone's calendar, so one on which the clock changes has 23 or 25 hours;
nothing depends on the session's own zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
#: A turn that spans more days than this has a wrong clock: it counts in this many days after its first, and is reported.
MOST_DAYS = 100_000


def _convert(source: str, target: str, ts: Column) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


def local_day(ms: Column, zone: str) -> Column:
    """The zone's calendar day of an instant; null stays null."""
    wall = F.timestamp_add("MILLISECOND", ms.cast("long"), F.expr(_EPOCH))
    return F.to_date(_convert("UTC", zone, wall))


def day_start(day: Column, zone: str) -> Column:
    """The instant at which a day begins in the zone; null where the day isn't known."""
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), _convert(zone, "UTC", day.cast("timestamp_ntz")))


def _days(turns: DataFrame, at: str, end: str, zone: str) -> DataFrame:
    """``turns`` that have a start, with the first and last day that they touch; an end before the start, or none, is the start."""
    until = F.greatest(F.col(at), F.coalesce(F.col(end), F.col(at)))
    return turns.where(F.col(at).isNotNull()).withColumns({"_first": local_day(F.col(at), zone), "_last": local_day(until, zone)})


def turn_bands(bands: DataFrame, turns: DataFrame, at: str, end: str, zone: str) -> DataFrame:
    """``bands`` (local_date and any other columns, a row a day) with turns (long) and start_ms.

    A turn counts once in every day it touches, but makes no band: days without one are left out. A band whose day is null has no
    turns and no start. A step up at the first day and one down after the last are summed by day before anything is sorted.
    """
    own = _days(turns, at, end, zone)
    stop = F.least(F.col("_last"), F.date_add("_first", MOST_DAYS))
    steps = own.select(F.explode(F.array(F.struct(F.col("_first").alias("d"), F.lit(1).alias("n")), F.struct(F.date_add(stop, 1).alias("d"), F.lit(-1).alias("n")))).alias("e"))
    steps = steps.groupBy(F.col("e.d").alias("d")).agg(F.sum("e.n").alias("n"))
    marks = steps.unionByName(bands.select(F.col("local_date").alias("d")).where("d is not null").distinct().withColumn("n", F.lit(None).cast("long")))
    both = marks.groupBy("d").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    # A row a calendar day at most.
    level = both.select(F.col("d").alias("local_date"), F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("turns"))
    return bands.join(level, "local_date", "left").withColumns({"turns": F.coalesce("turns", F.lit(0)), "start_ms": day_start(F.col("local_date"), zone)})


def overlong(turns: DataFrame, at: str, end: str, zone: str) -> DataFrame:
    """One problem row (code, severity, scope, n) if turns span more than MOST_DAYS days; none otherwise."""
    n = _days(turns, at, end, zone).where(F.date_diff("_last", "_first") > MOST_DAYS).agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 0").select(F.lit("day-span-capped").alias("code"), F.lit("warning").alias("severity"), F.lit("store").alias("scope"), "n")


def newest_first(bands: DataFrame) -> DataFrame:
    """Bands by the instant their day begins, the newest first, unknown days last."""
    return bands.orderBy(F.col("start_ms").desc_nulls_last())


def turns_in_range(turns: DataFrame, keys: Sequence[str], at: str, end: str, zone: str, first: str | None = None, last: str | None = None, slugs: Sequence[str] = ()) -> DataFrame:
    """One row: turns (by ``keys``, once each) that have a day in the range, and those of them that have days outside it too.

    A turn that ends as a day begins isn't in that day. Without bounds every turn counts and none is at an edge; without ``slugs`` every project counts.
    """
    own = turns.where(F.col("slug").isin(*slugs)) if slugs else turns
    own = _days(own, at, end, zone)
    until = F.when(F.col(end) > F.col(at), local_day(F.col(end) - 1, zone)).otherwise(F.col("_first"))
    own = own.withColumn("_until", until)
    low, high = (F.lit(x).cast("date") if x else None for x in (first, last))
    true = F.lit(True)
    touches = (F.col("_until") >= low if first else true) & (F.col("_first") <= high if last else true)
    inside = (F.col("_first") >= low if first else true) & (F.col("_until") <= high if last else true)
    own = own.groupBy(*keys).agg(F.bool_or(touches).alias("_touches"), F.bool_or(touches & ~inside).alias("_edge"))
    return own.agg(F.count_if("_touches").alias("turns"), F.count_if("_edge").alias("boundary_turns"))


def band_months(bands: DataFrame, sums: Sequence[str], sessions: str | None = None) -> DataFrame:
    """(month, days, sums, sessions, sessions_reason): bands by month; the null day is the month null.

    Days have counts of sessions, which can't be summed: a session of two days would count twice. So sessions is null with a
    reason, unless ``sessions`` names a column with the ids of each day, of which the different ones are counted.
    """
    own = bands.withColumn("month", F.date_format("local_date", "yyyy-MM"))
    out = own.groupBy("month").agg(F.count(F.lit(1)).alias("days"), *(F.sum(c).alias(c) for c in sums))
    if sessions is None:
        return out.withColumns({"sessions": F.lit(None).cast("long"), "sessions_reason": F.lit("counts by day can't be summed")})
    ids = own.select("month", F.explode(sessions).alias("_s")).groupBy("month").agg(F.countDistinct("_s").alias("sessions"))
    out = out.withColumn("_m", F.coalesce("month", F.lit(""))).join(ids.select(F.coalesce("month", F.lit("")).alias("_m"), "sessions"), "_m", "left").drop("_m")
    return out.withColumn("sessions", F.coalesce("sessions", F.lit(0))).withColumn("sessions_reason", F.lit(None).cast("string"))
