"""Rollups where every parent is the sum of its children, and partial aggregates that rates are applied to later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_scope(df: DataFrame, levels: Sequence[str], measures: dict[str, Column], root: str = "store") -> DataFrame:
    """One pass for all levels of a hierarchy (outermost first): scope, the level columns, the measures.

    Planned as one Expand with partial aggregation; a rolled-up key is null and told from a recorded null by ``scope``.
    """
    sets = [list(levels[:k]) for k in range(len(levels) + 1)]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *levels).agg(F.grouping_id().alias("_g"), *(m.alias(n) for n, m in measures.items()))
    scope = F.lit(None)
    for k in range(len(levels) + 1):
        mask = 2 ** (len(levels) - k) - 1
        scope = F.when(F.col("_g") == mask, F.lit(levels[k - 1] if k else root)).otherwise(scope)
    return out.select(scope.alias("scope"), *levels, *measures)


def children_sum(rolled: DataFrame, levels: Sequence[str], measure: str, root: str = "store") -> DataFrame:
    """For each level but the last: parents, and parents whose measure is not the sum of their children."""
    out = None
    for k in range(len(levels)):
        keys, name = list(levels[:k]), levels[k - 1] if k else root
        parent = rolled.where(F.col("scope") == name).select(*keys, F.col(measure).alias("_p"))
        child = rolled.where(F.col("scope") == levels[k])
        child = (child.groupBy(*keys) if keys else child.groupBy()).agg(F.sum(measure).alias("_c"))
        both = parent.join(child, keys, "full") if keys else parent.crossJoin(child)  # two single rows at the root
        one = both.agg(F.count(F.lit(1)).alias("parents"), F.count_if(~F.col("_p").eqNullSafe(F.col("_c"))).alias("broken")).select(F.lit(name).alias("scope"), "parents", "broken")
        out = one if out is None else out.unionByName(one)
    return out


def partial(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Counts and sums by keys on which no price depends but through a join: what is kept between runs."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(s).cast("long").alias(s) for s in sums))
