"""Table algebra: filters, sorts with unknowns last, pages, groups, shares, censuses, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_filter(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Rows where any of the text columns has the needle, case ignored. An empty needle keeps all."""
    hit = F.lit(not needle)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return df.where(hit)


def kind_filter(df: DataFrame, kind: str, wanted: Sequence[str], separator: str = ":") -> DataFrame:
    """Rows whose kind is wanted in full or by its part before the separator."""
    return df.where(F.col(kind).isin(*wanted) | F.split_part(kind, F.lit(separator), F.lit(1)).isin(*wanted))


def order(keys: Sequence[tuple[str, bool]], tie: str) -> list[Column]:
    """Sort keys (column, descending) with unknowns last either way, and a unique column to end ties."""
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys] + [F.col(tie).asc()]


def page(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str, index: int, size: int = 300, most: int = 5_000) -> DataFrame:
    """One page in total order; sizes beyond ``most`` are clamped. Planned as a top-k, not a full sort."""
    size = max(1, min(size, most))
    return df.orderBy(*order(keys, tie)).limit((index + 1) * size).offset(index * size) if index else df.orderBy(*order(keys, tie)).limit(size)


def after(df: DataFrame, keys: Sequence[str], last: Sequence, size: int) -> DataFrame:
    """The next ``size`` rows after a cursor in ascending key order, by predicate and not by offset."""
    beyond, equal = F.lit(False), F.lit(True)
    for c, v in zip(keys, last):
        beyond = beyond | (equal & (F.col(c) > F.lit(v)))
        equal = equal & (F.col(c) == F.lit(v))
    return df.where(beyond).orderBy(*keys).limit(size)


def shares(df: DataFrame, label: str, value: str, digits: int = 4) -> DataFrame:
    """Contribution ranking: each label's part of the listed total (a null value is listed, not counted)."""
    total = df.agg(F.sum(value).alias("_total"))  # one row
    return df.crossJoin(F.broadcast(total)).select(label, value, F.round(F.col(value) / F.when(F.col("_total") != 0, F.col("_total")), digits).alias("share"))


def top_with_overflow(df: DataFrame, label: str, value: str, most: int = 12) -> DataFrame:
    """(label or 'other', value): the ``most`` largest by value, then label, and the rest summed up."""
    first = df.orderBy(F.col(value).desc_nulls_last(), F.col(label).asc()).limit(most).select(label, F.lit(True).alias("_top"))
    own = F.when(F.col("_top"), F.col(label)).otherwise(F.lit("other"))
    return df.join(F.broadcast(first), label, "left").groupBy(own.alias(label)).agg(F.sum(value).cast("long").alias(value))


def census(df: DataFrame, column: str) -> DataFrame:
    """(value, n, recorded, not_recorded): counts with both denominators beside them."""
    whole = df.agg(F.count(column).alias("recorded"), F.count_if(F.col(column).isNull()).alias("not_recorded"))
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole))


def fold_problems(df: DataFrame, code: str, scope: str, source: str, message: str, sequence: str, most: int = 25) -> DataFrame:
    """Problems by (code, scope): how many, at most ``most`` distinct sources by name, the first message.

    Sources are made distinct before they are ranked, so no group is ever gathered whole.
    """
    counts = df.groupBy(code, scope).agg(F.count(F.lit(1)).alias("n"), F.min_by(message, sequence).alias("first_message"))
    distinct = df.where(F.col(source).isNotNull()).select(code, scope, source).distinct()
    rank = F.row_number().over(Window.partitionBy(code, scope).orderBy(source))
    named = distinct.withColumn("_k", rank).groupBy(code, scope).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(source).cast("string")))), ",").alias("sources"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    return counts.join(named, [code, scope], "left")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer comparison of two computations: in_left, in_right, and whether every value is the same (unknown = unknown)."""
    a = left.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("_a"))
    b = right.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("_b"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    there = [F.col(c).isNotNull() for c in ("_a", "_b")]
    return a.join(b, list(keys), "full").select(*keys, there[0].alias("in_left"), there[1].alias("in_right"), *(f"{s}_{v}" for v in values for s in "ab"), (there[0] & there[1] & same).alias("same"))


def changes(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change): changed, new and vanished keys by fingerprint, each once."""
    both = old.select(key, F.col(mark).alias("_old")).join(new.select(key, F.col(mark).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "vanished").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def groups_in_order(df: DataFrame, by: str, sequence: str) -> DataFrame:
    """(by, n, place): groups by one field, unknown a group of its own, numbered as they first appear."""
    own = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(sequence).alias("_first"))
    return own.withColumn("place", F.row_number().over(Window.orderBy("_first")).cast("long")).drop("_first")  # a row a group


def separators(df: DataFrame, day: str) -> DataFrame:
    """``df`` (a row a day) with ``opens``: the month that a day opens, from the latest on; null within a month."""
    month = F.substring(day, 1, 7)
    return df.withColumn("opens", F.when(~month.eqNullSafe(F.lag(month).over(Window.orderBy(F.col(day).desc_nulls_last()))), month))


def latest_verdicts(df: DataFrame, name: str, sequence: str, passed: str) -> DataFrame:
    """(verdict, n): of each name the last verdict counts: pass, fail, or unreported where it is null."""
    last = df.groupBy(name).agg(F.max_by(F.struct(F.col(passed).alias("p")), sequence).alias("_l"))
    verdict = F.when(F.col("_l.p").isNull(), "unreported").when(F.col("_l.p"), "pass").otherwise("fail")
    return last.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
