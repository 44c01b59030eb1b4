"""Structured Streaming over a file source, run to the end of what is there.

Results go through foreachBatch into a Parquet table in the checkpoint folder: a batch that is run
again after a failure writes under its own number and so replaces what it wrote before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import millis
from tallyloom.operators import storage


def _folder(spark: SparkSession) -> str:
    return f"{storage.folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a Parquet file's or folder's rows; ``at`` is the event time."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    own = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").option("recursiveFileLookup", "false")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").limit(1).count() if not name.endswith(".parquet") else 0
    stream = own.parquet(path if listed else folder)
    return stream.withColumn("at", F.timestamp_millis(millis(F.col("ts"))))


def run(stream: DataFrame, mode: str, *, once: bool = True) -> DataFrame:
    """Run a stream over all that is there; the rows it emitted (update mode: the last of each batch).

    ``once=False`` is for sources that don't know what is there when they start: the query stops when nothing is left.
    """
    spark = stream.sparkSession
    folder = _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(**({"availableNow": True} if once else {"processingTime": "0 seconds"})).start()
    if once:
        q.awaitTermination()
    else:
        q.processAllAvailable()
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def tumbling(spark: SparkSession, path: str) -> DataFrame:
    """Events by hour and kind."""
    own = source(spark, path).withWatermark("at", "2 hours").groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = run(own, "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Runs of one user's events less than half an hour apart."""
    own = source(spark, path).withWatermark("at", "2 hours").groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return run(own, "complete").select("user_id", F.unix_millis("w.start").alias("t0"), "n")


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """The first event of each user, kind and day, counted."""
    own = source(spark, path).withColumn("day", F.date_format("ts", "yyyy-MM-dd")).select("user_id", "event_type", "day").dropDuplicates(["user_id", "event_type", "day"])
    return run(own, "append").groupBy("user_id", "event_type", "day").agg(F.count(F.lit(1)).alias("n"))


def arrivals(spark: SparkSession, parts: list[DataFrame]) -> str:
    """A folder into which the parts arrive one after another, a file each."""
    folder = f"{_folder(spark)}/arrivals"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of such a folder, a file a batch, in the order of arrival."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def closed_windows(spark: SparkSession, folder: str, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n) of windows that the watermark has passed, each emitted once; rows behind the watermark are left out."""
    own = arriving(spark, folder).withColumn("at", F.timestamp_millis(millis(F.col("ts")))).withWatermark("at", late)
    out = run(own.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")), "append")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")
