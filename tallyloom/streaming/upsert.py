"""Incremental refresh: what a batch says about a key replaces what was known of it.

State is a Parquet table of generations: each batch writes the rows of the keys it touched under its
number, and a key's current rows are those of its highest generation. A batch that runs again writes the
same place, so a restart changes nothing; ``compact`` rewrites the current rows as one generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_by_key(stream: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, **trigger):
    """Start a query that writes fold(batch) for the keys in each batch; a key folded to nothing keeps a tombstone."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = batch.select(key).distinct().withColumn("_there", F.lit(True))
        touched.join(fold(batch), key, "left").write.mode("overwrite").parquet(f"{table}/generation={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The rows of each key's last generation, tombstones left out."""
    own = spark.read.parquet(table)
    last = own.groupBy(key).agg(F.max("generation").alias("generation"))
    values = [c for c in own.columns if c not in (key, "generation", "_there")]
    there = F.coalesce(*(F.col(c).isNotNull().cast("int") for c in values[:1]), F.lit(0)) if not values else F.greatest(F.lit(0), *(F.col(c).isNotNull().cast("int") for c in values))
    return own.join(last, [key, "generation"]).where(there > 0).drop("generation", "_there")


def compact(spark: SparkSession, table: str, key: str, into: str) -> None:
    current(spark, table, key).withColumns({"_there": F.lit(True), "generation": F.lit(0)}).write.partitionBy("generation").mode("overwrite").parquet(into)
