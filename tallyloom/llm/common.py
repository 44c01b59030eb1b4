"""What the training-data operators share: reading tables, the shared folder, labelled samples."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most (the rows with the smallest hash of doc_id).
FIT_ROWS = 20_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyloom-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), for tables of many rows: a Parquet table in the shared folder, compressed and read by column."""
    return _written(df, f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(df: DataFrame, name: str):
    """Like stage(), for a table that nothing reads after the block: its folder is deleted there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield _written(df, path)
    finally:
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release() -> None:
    """Give memory that Arrow holds for later back to the system, at the end of a task: its worker may go on to something else."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id's text, mod 3, is not 1. A null id is not learnable."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, chosen by hash of doc_id among all learnable ones.

    Null ids and null labels are left out; of several labels of one document the larger counts. The
    chosen ids (at most ``bound``, a documented constant) are what is broadcast. Of several rows of one
    document the text with the least hash stands for it, so that ``bound`` is one of rows.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.min_by("text", F.struct(F.xxhash64("text").alias("hash"), "text")).alias("text")
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(text).select("doc_id", "text", "y")
