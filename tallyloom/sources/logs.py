"""Session logs as DataFrames: a store's files, their lines, and the lines' JSON as VARIANT.

A store is a folder of projects; in it <session>.jsonl, and beside it <session>/subagents/ and
<session>/workflows/. Lines end in LF alone, the unterminated tail of a growing file is held back, and
a line that is not one JSON object is kept and marked torn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.sources.listing import WHOLE, dealt, listed, paths_of, reader, relative

#: Session ids, agent ids and run ids. Fixed values.
SESSION, AGENT, RUN = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "[A-Za-z0-9]+", "wf_[0-9a-f]{8}-[0-9a-f]{3}"
#: Keys of long encoded values, with the least length that is taken out, and what such values are written in. Fixed values.
HEAVY, _ENCODED = {"data": 500, "base64": 500, "signature": 100}, "[A-Za-z0-9+/=_-]"
_CLASSES = (
    ("main", rf"^[^/]+/{SESSION}\.jsonl$"),
    ("journal", rf"/subagents/workflows/{RUN}/journal\.jsonl$"),
    ("agent", rf"/subagents/(workflows/{RUN}/)?agent-{AGENT}\.jsonl$"),
    ("meta", rf"/subagents/(workflows/{RUN}/)?agent-{AGENT}\.meta\.json$"),
    ("script", r"/workflows/scripts/[^/]+\.js$"),
    ("manifest", rf"/workflows/{RUN}\.json$"),
    ("spill", r"/tool-results/[^/]+$"),
    ("memory", r"^[^/]+/memory/.*\.md$"),
)


def classify(rel: Column) -> Column:
    """A store path's class, from its shape alone."""
    out = F.lit("unclassified")
    for name, pattern in reversed(_CLASSES):
        out = F.when(rel.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _named(df: DataFrame) -> DataFrame:
    """``df`` with what the path in ``rel`` says: project, session, class, agent and run."""
    session = F.nullif(F.lower(F.regexp_extract("rel", rf"^[^/]+/({SESSION})(?:\.jsonl$|/)", 1)), F.lit(""))
    return df.withColumns({"slug": F.split_part("rel", F.lit("/"), F.lit(1)), "session_id": session, "kind": classify(F.col("rel")),
                           "agent_id": F.nullif(F.regexp_extract("rel", rf"/agent-({AGENT})\.(?:meta\.json|jsonl)$", 1), F.lit("")),
                           "run_id": F.nullif(F.regexp_extract("rel", rf"({RUN})", 1), F.lit(""))})


def files(spark: SparkSession, root: str) -> DataFrame:
    """rel, size, mtime, slug, session_id, kind, agent_id, run_id of every file; no content is read."""
    return _named(listed(spark, root))


def sessions(listing: DataFrame) -> DataFrame:
    """One row per session id: owner (least project with a main file, else least with any), files, bytes, fragments, fingerprint."""
    own = listing.where(F.col("session_id").isNotNull())
    slug_of_main = F.when(F.col("kind") == "main", F.col("slug"))
    mark = F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", "rel", F.col("size").cast("string"), F.unix_millis("mtime").cast("string")))), "").cast("binary"))
    return own.groupBy("session_id").agg(
        F.coalesce(F.min(slug_of_main), F.min("slug")).alias("slug"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("size").alias("bytes"),
        F.countDistinct("slug").alias("n_projects"),
        F.count_if(F.col("kind") == "main").alias("n_mains"),
        mark.alias("fingerprint"),  # a session's own files: hundreds, not a corpus
    )


def with_object(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the VARIANT of a text that is one JSON object and nothing more; null for any other.

    The built-in parser lets what follows a value pass. As the only element of a list and as a field before another one
    it doesn't: what would end the list early breaks the object, and the other way round.
    """
    t = F.col(text)
    df = df.withColumns({"_list": F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "_field": F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit(',"y":1}')))})
    df = df.withColumn("_one", F.try_variant_get("_list", "$[0]", "variant"))
    alone = F.try_variant_get("_list", "$[1]", "variant").isNull() & F.try_variant_get("_field", "$.y", "variant").isNotNull()
    alone = F.ltrim(t).startswith("{") & F.schema_of_variant("_one").startswith("OBJECT") & alone
    # The first condition always holds. It keeps filters above from being moved below, where they would parse again.
    return df.withColumn(name, F.when((F.monotonically_increasing_id() >= 0) & alone, F.col("_one"))).drop("_list", "_field", "_one")


def strip_heavy(text: Column) -> Column:
    """The text without the values of HEAVY that are long enough; only texts long enough to hold one are searched."""
    out, there = text, F.lit(False)
    for key, least in HEAVY.items():
        there = there | ((F.length(text) >= least) & text.contains(f'"{key}"'))
        out = F.regexp_replace(out, f'("{key}":\\s*)"{_ENCODED}{{{least},}}"', '$1""')
    return F.when(there, out).otherwise(text)


def heavy(text: Column) -> Column:
    """The values that strip_heavy takes out, in order: key, length, decoded bytes (null for signatures, which encode nothing), first 24 characters."""
    pattern = F.lit(f'"({"|".join(HEAVY)})":\\s*"({_ENCODED}{{{min(HEAVY.values())},}})"')
    long = F.length(text) >= min(HEAVY.values())
    none = F.array().cast("array<string>")
    keys, bodies = (F.when(long, F.regexp_extract_all(text, pattern, k)).otherwise(none) for k in (1, 2))
    size = lambda k, b: F.when(k != "signature", F.floor(F.length(F.rtrim(b, F.lit("="))) * 3 / 4).cast("long"))
    one = lambda k, b: F.struct(k.alias("key"), F.length(b).alias("length"), size(k, b).alias("bytes"), F.substring(b, 1, 24).alias("head"))
    least = F.create_map(*(F.lit(x) for pair in HEAVY.items() for x in pair))
    return F.filter(F.zip_with(keys, bodies, one), lambda b: b["length"] >= least[b["key"]])


_PLACE = ("rel", "slug", "session_id", "kind", "agent_id", "run_id", "line", "byte_offset", "bytes", "bom")


def raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """rel, line (from 1), byte_offset, bytes, bom, text as recorded, and where the file stands.

    No text is shuffled for files of up to WHOLE bytes; larger ones are read by byte range, see ``_ranged``. A CR before the LF and a first BOM
    go; an unterminated tail isn't there yet.
    """
    logs = listed(spark, root, ".jsonl")
    own = _whole(spark, root, logs)
    if paths := paths_of(logs.where(F.col("size") > WHOLE), root):
        own = own.unionByName(_ranged(spark, root, paths).select(*_PLACE, "_x"))
    t = F.make_valid_utf8(F.col("_x").cast("string"))
    ending = F.when(t.endswith("\r\n"), 2).when(t.endswith("\n") | t.endswith("\r"), 1).otherwise(0)  # patterns would look at every character
    return own.withColumn("text", F.substring(t, F.lit(1), F.length(t) - ending)).where(F.length("text") > 0).select(*_PLACE, "text")


def _whole(spark: SparkSession, root: str, own: DataFrame | None = None) -> DataFrame:
    """The lines of files up to WHOLE bytes. One pass: the task that reads a file numbers its lines."""
    own = listed(spark, root, ".jsonl") if own is None else own
    small = _named(dealt(own.where(F.col("size") <= WHOLE))).select(*_PLACE[:6], "size")
    read = reader(root)
    return small.mapInArrow(lambda batches: _numbered(read(batches)), "rel string, slug string, session_id string, kind string, agent_id string, run_id string, line long, byte_offset long, bytes long, bom boolean, _x binary")


def _numbered(batches):
    """The lines of whole files with their numbers and offsets; all files of a batch at once, as one run of bytes."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        content = batch.column("content")
        if not len(content):
            continue
        content = content.cast(pa.large_binary())
        stops = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
        data = np.frombuffer(content.buffers()[2], np.uint8) if stops[-1] else np.zeros(0, np.uint8)
        cuts = np.unique(np.concatenate([stops, np.flatnonzero(data[stops[0] : stops[-1]] == 10) + stops[0] + 1]))
        begin, end = cuts[:-1], cuts[1:]
        if not begin.size:
            continue
        values = pa.Array.from_buffers(pa.large_binary(), begin.size, [None, pa.py_buffer(cuts), content.buffers()[2]])
        file = np.searchsorted(stops, begin, "right") - 1
        first = np.searchsorted(begin, stops[:-1])[file]
        whole = data[end - 1] == 10
        marked = begin[first] == begin
        head = begin[marked]
        bom = np.zeros(begin.size, bool)
        bom[marked] = [data[a : a + 3].tobytes() == b"\xef\xbb\xbf" and b - a >= 3 for a, b in zip(head.tolist(), end[marked].tolist())]
        own = [batch.column(k).take(pa.array(file)) for k in _PLACE[:6]]
        numbers = [np.arange(begin.size) - first + 1, begin - stops[file], end - begin - 1]
        table = pa.Table.from_arrays([*own, *map(pa.array, numbers), pa.array(bom), values], names=[*_PLACE, "_x"]).filter(pa.array(whole))
        at = np.flatnonzero(table.column("bom").to_numpy())
        if at.size:  # a BOM is no text
            texts = table.column("_x").to_pylist()
            for i in at.tolist():
                texts[i] = texts[i][3:]
            table = table.set_column(table.schema.get_field_index("_x"), "_x", pa.array(texts, pa.large_binary()))
        table = table.set_column(table.schema.get_field_index("_x"), "_x", table.column("_x").cast(pa.binary()))
        yield from table.to_batches(max_chunksize=4096)


def _ranged(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The lines of files over WHOLE bytes, read by byte range, so that one file is dealt over many tasks; places within a file come from the counts of the ranges before."""
    meta = F.col("_metadata")
    raw = spark.read.text(paths, lineSep="\n")
    raw = raw.select(F.col("value").alias("_x"), meta["file_path"].alias("path"), meta["file_block_start"].alias("_block"), meta["file_size"].alias("_size"), F.monotonically_increasing_id().alias("_id"))
    size = F.octet_length("_x").cast("long")
    blocks = raw.groupBy("path", "_block", "_size").agg(F.count(F.lit(1)).alias("_n"), F.sum(size + 1).alias("_bytes"))
    whole, before = Window.partitionBy("path"), Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("_size") - F.sum("_bytes").over(whole)  # -1: the last line has no LF; 3 more: a BOM, which the reader has skipped
    blocks = blocks.withColumns({"_bom": F.when(over >= 2, 3).otherwise(0), "_open": over.isin(-1, 2), "_lines": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_at": F.coalesce(F.sum("_bytes").over(before), F.lit(0))})
    blocks = _named(blocks.withColumn("rel", relative(F.col("path"), root)))
    own = raw.drop("_size").join(blocks.drop("_n", "_bytes"), ["path", "_block"])
    inside = Window.partitionBy("path", "_block").orderBy("_id")
    own = own.withColumns({"line": F.col("_lines") + F.row_number().over(inside), "_end": F.col("_at") + F.sum(size + 1).over(inside), "bytes": size})
    head = F.when(F.col("line") == 1, F.col("_bom")).otherwise(0)
    own = own.withColumns({"byte_offset": F.when(F.col("line") == 1, F.lit(0)).otherwise(F.col("_end") + F.col("_bom") - size - 1).cast("long"), "bytes": (size + head).cast("long"), "bom": head > 0})
    own = own.where(~(F.col("_open") & (F.col("_end") + F.col("_bom") > F.col("_size"))))
    return own.withColumn("_x", F.col("_x").cast("binary"))


def texts(spark: SparkSession, root: str, ending: str, kind: str | None = None) -> DataFrame:
    """``value``, the whole text of each file (of a class) whose path ends so, and where the file stands."""
    own = listed(spark, root, ending)
    own = own if kind is None else own.where(classify(F.col("rel")) == kind)
    own = dealt(own).select("rel", "size").mapInArrow(reader(root), "rel string, content binary")
    return _named(own.select("rel", F.col("content").cast("string").alias("value")))


def lines(spark: SparkSession, root: str) -> DataFrame:
    """The raw lines with text stripped of long encoded values, those as blobs, event (VARIANT) and torn (the line isn't one JSON object)."""
    own = raw_lines(spark, root).withColumnRenamed("text", "_t").withColumns({"text": strip_heavy(F.col("_t")), "blobs": heavy(F.col("_t"))})
    own = with_object(own, "text", "event").withColumn("torn", F.col("event").isNull())
    return own.select(*_PLACE, "text", "blobs", "torn", "event")


def byte_range(spark: SparkSession, root: str, rel: str, start: int, length: int) -> DataFrame:
    """(rel, size, content): bytes of one file from ``start`` on."""
    raw = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{rel}")
    return raw.select(F.lit(rel).alias("rel"), F.col("length").alias("size"), F.substring("content", start + 1, length).alias("content"))


def preview(spark: SparkSession, root: str, *, most: int | None = None) -> DataFrame:
    """(readable, files, sessions, bytes, capped) of a folder that may become a store; counts are null, never 0, where it can't be listed.

    All files count, unless the caller asks for a glance at ``most`` of them.
    """
    try:
        own = files(spark, root)
    except OSError:
        nothing = {"files": "long", "sessions": "long", "bytes": "long"}
        return spark.range(1).select(F.lit(False).alias("readable"), *(F.lit(None).cast(k).alias(c) for c, k in nothing.items()), F.lit(False).alias("capped"))
    some = own if most is None else own.limit(most + 1)  # the listing's own order; more than that is only said to be more
    out = some.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("kind") == "main", F.col("session_id"))).alias("sessions"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    kept, over = (F.col("n"), F.lit(False)) if most is None else (F.least("n", F.lit(most)).cast("long"), F.col("n") > most)
    return out.select(F.lit(True).alias("readable"), kept.alias("files"), "sessions", "bytes", over.alias("capped"))
