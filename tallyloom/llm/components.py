"""Connected components of a link table, by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. Null ends and loops are left out.

    Every round each id takes the least label among its own and its neighbours', then the label of
    that label; the frame is written to the checkpoint folder each round, and only the number of
    changes comes to the driver.
    """
    ends = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = common.cut(ends.union(ends.select("v", "u")).distinct())
    labels = common.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["u"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        over = labels.select(F.col("id").alias("now"), F.col("component").alias("next"))
        step = common.cut(step.join(over, "now", "left").select("id", "was", F.least("now", F.coalesce("next", "now")).alias("component")))
        labels = step.select("id", "component")
        if step.where(F.col("was") != F.col("component")).isEmpty():
            return labels
