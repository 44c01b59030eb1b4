"""A store's files by the tasks that list and read them, so that neither their number nor their paths pass through the driver.

Spark's file sources list in the driver and deal by file: a store of small files is a task for each few of them, and every status comes to the
driver. Here folders are dealt over tasks, level by level as far as a session, and files by what they hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import storage
from tallyloom.sources.tail import _filesystem

#: Files up to this many bytes are read whole, in the task that reads them.
WHOLE = 1 << 25
#: What one task lists and reads, about: folders, files and bytes; and the bytes that it hands on at once.
FOLDERS, FILES, BYTES, AT_ONCE = 256, 2048, 1 << 25, 1 << 22

_ENTRY = "rel string, size long, mtime timestamp, folder boolean"


def _shown(rel: str) -> bool:
    """Whether Spark's own sources would show a path: no step begins with a dot or, unless it names a partition or metadata, with an underscore, or is being copied."""
    named = lambda step: "=" in step or step.startswith(("_metadata", "_common_metadata"))
    return not any(step.startswith(".") or step.endswith("._COPYING_") or (step.startswith("_") and not named(step)) for step in rel.split("/"))


def _lister(root: str, recursive: bool) -> Callable:
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        filesystem, base = _filesystem(root)
        base = base.rstrip("/")
        types = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                found = filesystem.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/") or "/", recursive=recursive, allow_not_found=True))
                for i in range(0, len(found), 8192):
                    own = [(x.path[len(base) + 1 :], x) for x in found[i : i + 8192]]
                    own = [(r, x) for r, x in own if _shown(r[len(rel) :].lstrip("/")) and x.type in (fs.FileType.File, fs.FileType.Directory)]
                    if own:
                        columns = [[r for r, _ in own], [x.size if x.is_file else None for _, x in own], [x.mtime_ns // 1_000_000 * 1000 for _, x in own], [not x.is_file for _, x in own]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["rel", "size", "mtime", "folder"])

    return run


def relative(path: Column, root: str) -> Column:
    """The path below ``root`` of a file that Spark's own sources name."""
    rel = F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/+", "/"), "^" + re.escape(re.sub("^[a-z]+:/+", "/", root.rstrip("/"))) + "/", "")
    return F.url_decode(F.regexp_replace(rel, r"\+", "%2B"))


def _over(df: DataFrame, least: int) -> DataFrame:
    """``df`` by path over at least so many tasks, and over all of the cluster's if there is something for each."""
    return df.repartition(max(1, least), F.xxhash64("rel"))


def listed(spark: SparkSession, root: str, ending: str = "") -> DataFrame:
    """(rel, size, mtime) of every file below ``root`` whose path ends so, as they are now. OSError if the root is no folder that can be read."""
    from pyarrow import fs

    filesystem, base = _filesystem(root)
    if filesystem.get_file_info(base.rstrip("/") or "/").type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    level, out, cores = spark.createDataFrame([("",)], "rel string"), None, spark.sparkContext.defaultParallelism
    for depth in range(3):  # projects, sessions, and whatever is in a session
        found = storage.cut(level.mapInArrow(_lister(root, depth == 2), _ENTRY))
        own = found.where(~F.col("folder") & F.col("rel").endswith(ending)).select("rel", "size", "mtime")
        out = own if out is None else out.unionByName(own)
        folders = found.where("folder").select("rel")
        n = folders.count() if depth < 2 else 0
        if not n:
            break
        level = _over(folders, max(n // FOLDERS, min(n, cores)))
    return out


def dealt(files: DataFrame) -> DataFrame:
    """``files`` (rel, size and more) over as many tasks as their number and bytes ask for; dealt once, so that nothing below is exchanged again."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return storage.cut(_over(files, max(n // FILES, size // BYTES, min(n, files.sparkSession.sparkContext.defaultParallelism))))


def reader(root: str) -> Callable:
    """For mapInArrow: rows with ``rel`` and ``size`` get their file's ``content`` in the place of its size."""

    def run(batches):
        import pyarrow as pa

        filesystem, base = _filesystem(root)
        for batch in batches:
            rels, sizes, at, held, contents = batch.column("rel").to_pylist(), batch.column("size").to_pylist(), [], 0, []

            def whole(own=batch):
                rest = [k for k in own.schema.names if k != "size"]
                taken = own.select(rest).take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, pa.array(contents, pa.binary())], names=[*rest, "content"])

            for i, (rel, size) in enumerate(zip(rels, sizes)):
                if at and held + size > AT_ONCE:
                    yield whole()
                    at, held, contents = [], 0, []
                with filesystem.open_input_file(f"{base.rstrip('/')}/{rel}") as f:
                    contents.append(f.read())
                at.append(i)
                held += size
            if at:
                yield whole()

    return run


def paths_of(large: DataFrame, root: str) -> list[str]:
    """Paths of files over WHOLE bytes, for Spark's text source, which splits them; that is at most one path for each WHOLE bytes of a store."""
    return [f"{root.rstrip('/')}/" + re.sub(r"([\[\]{}*?\\])", r"\\\1", r["rel"]) for r in large.select("rel").collect()]


def plain_lines(spark: SparkSession, root: str) -> DataFrame:
    """(rel, place, value) of the lines of all logs as plain text, ``place`` in their order; shares only the listing with the log reader: texts are split by Spark."""
    logs = listed(spark, root, ".jsonl")
    text = F.col("content").cast("string")
    small = dealt(logs.where(F.col("size") <= WHOLE)).select("rel", "size").mapInArrow(reader(root), "rel string, content binary")
    small = small.select("rel", F.posexplode(F.split(F.when(text.startswith("\ufeff"), F.substring(text, 2, 1 << 30)).otherwise(text), "\n")).alias("i", "value"))
    place = lambda a, b: F.struct(a.cast("long").alias("block"), b.cast("long").alias("line")).alias("place")
    out = small.select("rel", place(F.lit(0), F.col("i")), "value")
    if paths := paths_of(logs.where(F.col("size") > WHOLE), root):
        raw = spark.read.text(paths, lineSep="\n")
        out = out.unionByName(raw.select(relative(F.col("_metadata.file_path"), root).alias("rel"), place(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()), "value"))
    return out
