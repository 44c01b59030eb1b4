"""A log of versions of a store's sessions: what changed, since when, and what has gone stale.

Under ``folder``, ``boot=<id>/version=<n>`` has the sessions that version n added, changed or removed. A version counts once
its _SUCCESS is there, so a commit that was broken off leaves nothing; a folder that is built anew gets another boot id, and cursors of
the old one get everything. Asking whether anything is new lists names and reads no data.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (boot, version): what a reader has seen. Version -1: nothing.
Cursor = tuple[str, int]


def _names(spark: SparkSession, path: str, pattern: str, done: bool = False) -> list[str]:
    """What the folders in ``path`` are called, as far as ``pattern`` has it; with ``done`` only those whose write has ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    ended = lambda p: not done or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [m[1] for p in found if (m := re.fullmatch(pattern, p.getName())) and ended(p)]


def cursor(spark: SparkSession, folder: str) -> Cursor | None:
    """The latest version; None before the first. Of several boots the greatest name counts (they begin with a number)."""
    boots = _names(spark, folder, r"boot=(\d{6}-[0-9a-f]+)")
    if not boots:
        return None
    versions = _names(spark, f"{folder}/boot={max(boots)}", r"version=(\d+)", done=True)
    return max(boots), max(map(int, versions), default=-1)


def boot(spark: SparkSession, folder: str) -> Cursor:
    """Begin anew: what was committed before no longer counts."""
    before = _names(spark, folder, r"boot=(\d{6})-[0-9a-f]+")
    name = f"{max(map(int, before), default=-1) + 1:06d}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/boot={name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return name, -1


_CHANGE = "session_id string, slug string, fingerprint string, change string"


def _changes(spark: SparkSession, folder: str, name: str, first: int, last: int) -> DataFrame:
    paths = [f"{folder}/boot={name}/version={v}" for v in range(first, last + 1)]
    if not paths:
        return spark.createDataFrame([], _CHANGE + ", version int")
    own = spark.read.schema(_CHANGE).parquet(*paths).withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"version=(\d+)/", 1).cast("int"))
    return own


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, slug, fingerprint, version) of the sessions that are there now, with the version that they are of."""
    now = cursor(spark, folder)
    own = _changes(spark, folder, now[0], 0, now[1]) if now else _changes(spark, folder, "", 0, -1)
    last = own.groupBy("session_id").agg(F.max_by(F.struct("slug", "fingerprint", "change", "version"), "version").alias("_s"))
    return last.select("session_id", "_s.slug", "_s.fingerprint", "_s.version", F.col("_s.change").alias("_change")).where("_change <> 'removed'").drop("_change")


def diff(known: DataFrame, now: DataFrame) -> DataFrame:
    """(session_id, slug, fingerprint, change) of sessions that are new, another, or gone."""
    a, b = known.select("session_id", F.col("slug").alias("_slug"), F.col("fingerprint").alias("_was")), now.select("session_id", "slug", "fingerprint")
    both = a.join(b, "session_id", "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("fingerprint").isNull(), "removed").when(F.col("_was") != F.col("fingerprint"), "changed")
    return both.select("session_id", F.coalesce("slug", "_slug").alias("slug"), "fingerprint", change.alias("change")).where("change is not null")


def commit(spark: SparkSession, folder: str, now: DataFrame) -> tuple[Cursor, DataFrame | None]:
    """Commit what ``now`` (session_id, slug, fingerprint) differs in from the last version: the cursor, and the changes (None: nothing is new, no version)."""
    at = cursor(spark, folder) or boot(spark, folder)
    found = diff(snapshot(spark, folder), now)
    path = f"{folder}/boot={at[0]}/version={at[1] + 1}"
    pending = f"{folder}/boot={at[0]}/pending-{uuid.uuid4().hex}"
    found.write.parquet(pending)  # counted and renamed as written: the listing may go on changing
    if spark.read.schema(_CHANGE).parquet(pending).isEmpty():
        _delete(spark, pending)
        return at, None
    _delete(spark, path)  # of a commit that was broken off
    source = spark._jvm.org.apache.hadoop.fs.Path(pending)
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"version {at[1] + 1} was committed by another run")
    return (at[0], at[1] + 1), spark.read.schema(_CHANGE).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def since(spark: SparkSession, folder: str, seen: Cursor | None) -> tuple[Cursor | None, DataFrame | None]:
    """The cursor of now and what changed after ``seen``: None if nothing did; a cursor of another boot or of the future gets all that is there."""
    now = cursor(spark, folder)
    if now is None or seen == now:
        return now, None
    if seen is not None and seen[0] == now[0] and seen[1] < now[1]:
        last = _changes(spark, folder, now[0], seen[1] + 1, now[1]).groupBy("session_id").agg(F.max_by(F.struct("slug", "fingerprint", "change"), "version").alias("_s"))
        return now, last.select("session_id", "_s.*")
    return now, snapshot(spark, folder).select("session_id", "slug", "fingerprint", F.lit("added").alias("change"))


def stale(spark: SparkSession, folder: str, now: DataFrame) -> DataFrame:
    """(session_id, change) of sessions that have moved since the last version and that no call has told of since then."""
    at = cursor(spark, folder) or boot(spark, folder)
    told = f"{folder}/boot={at[0]}/told-{at[1]}"
    found = diff(snapshot(spark, folder), now).select("session_id", "change")
    before = _names(spark, told, r"call=(\d+)", done=True)
    if before:
        own = spark.read.schema("session_id string, change string").parquet(*(f"{told}/call={k}" for k in before))
        found = found.join(own.select("session_id").distinct(), "session_id", "left_anti")
    path = f"{told}/call={max(map(int, before), default=-1) + 1}"
    found.write.mode("overwrite").parquet(path)
    return spark.read.schema("session_id string, change string").parquet(path)
