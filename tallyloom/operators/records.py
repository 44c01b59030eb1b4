"""Addresses in a log: lines by number and window, blocks within a line, and what stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines and bytes of one window at most.
LINES, BYTES = 500, 16 << 20
_BLOCK = r"^(?:[0-9]+(?:\.[0-9]+)?|r(?:\.[0-9]+)?)$"


def point(lines: DataFrame, rel: str, line: int) -> DataFrame:
    """One line of a file."""
    return lines.where((F.col("rel") == rel) & (F.col("line") == line))


def window(lines: DataFrame, first: int, *, most: int = LINES, budget: int = BYTES) -> DataFrame:
    """Of every file in ``lines`` the lines from ``first`` on: ``most`` of them, as many as the budget of bytes holds, one at least."""
    own = lines.where((F.col("line") >= first) & (F.col("line") < first + min(most, LINES)))
    so_far = F.sum("bytes").over(Window.partitionBy("rel").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    least = F.min("line").over(Window.partitionBy("rel"))
    return own.withColumns({"_bytes": so_far, "_least": least}).where((F.col("_bytes") <= budget) | (F.col("line") == F.col("_least"))).drop("_bytes", "_least")


def aligned(line: Column, size: int = LINES) -> Column:
    """The first line of the block of ``size`` lines that a line is in."""
    return (F.floor((line - 1) / size) * size + 1).cast("long")


def locator(line: Column, block: Column) -> Column:
    """``line[.block]``; null for lines before the first and for no block address."""
    whole = F.when(block.isNull(), line.cast("string")).when(block.rlike(_BLOCK), F.concat_ws(".", line.cast("string"), block))
    return F.when(line >= 1, whole)


def parsed(text: Column) -> Column:
    """(line, block) of a locator, cut at its first dot; null if either part isn't an address."""
    t = F.trim(text)
    line = F.try_to_number(F.regexp_extract(t, r"^([0-9]{1,18})(?:\.|$)", 1), F.lit("9" * 18)).cast("long")
    block = F.nullif(F.regexp_extract(t, r"^[0-9]+\.(.+)$", 1), F.lit(""))
    return F.when(line.isNotNull() & (line >= 1) & ~t.endswith(".") & (block.isNull() | block.rlike(_BLOCK)), F.struct(line.alias("line"), block.alias("block")))


def json_path(block: Column) -> Column:
    """Where a block stands in its event."""
    a, b = F.split_part(block, F.lit("."), F.lit(1)), F.split_part(block, F.lit("."), F.lit(2))
    content = F.concat(F.lit("$.message.content["), a, F.lit("]"), F.when(b != "", F.concat(F.lit(".content["), b, F.lit("]"))).otherwise(F.lit("")))
    sidecar = F.concat(F.lit("$.toolUseResult"), F.when(b != "", F.concat(F.lit("["), b, F.lit("]"))).otherwise(F.lit("")))
    return F.when(block.rlike(_BLOCK), F.when(a == "r", sidecar).otherwise(content))


def siblings(rows: DataFrame) -> DataFrame:
    """``rows`` with the addresses of the blocks before and after in the same line."""
    w = Window.partitionBy("rel", "line").orderBy("ord")
    return rows.withColumns({"before": F.lag("bi").over(w), "after": F.lead("bi").over(w)})


def block_texts(own: DataFrame) -> DataFrame:
    """(rel, line, ord, bi, text): the whole text of every block of ``transcripts.events``, with its address, in the order in which hits are told.

    A block has its text, its thinking, its input as JSON, or its result; a result's own parts are i.j; the sidecar is r, its parts r.j, as
    JSON unless it is a string. Content that is one string has no blocks. JSON has its keys in the order of VARIANT.
    """
    get = lambda v, path: F.try_variant_get(v, path, "variant")
    is_ = lambda v, kind: F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))
    string = lambda v: F.when(is_(v, "STRING"), v.cast("string"))
    items = lambda v: F.when(is_(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    b, kind = F.col("b"), F.try_variant_get("b", "$.type", "string")
    blocks = own.select("rel", "line", F.posexplode(items(F.col("content"))).alias("i", "b"))
    parts = F.array(string(get(b, "$.text")), string(get(b, "$.thinking")), F.when(kind == "tool_use", F.to_json(get(b, "$.input"))), F.when(kind == "tool_result", string(get(b, "$.content"))))
    place = lambda i, j, k: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))
    none = F.lit(-1)
    plain = blocks.select("rel", "line", "i", F.posexplode(parts).alias("k", "text")).select("rel", "line", place(F.col("i"), none, F.col("k")).alias("ord"), F.col("i").cast("string").alias("bi"), "text")
    nested = blocks.where(kind == "tool_result").select("rel", "line", "i", F.posexplode(items(get(b, "$.content"))).alias("j", "c"))
    nested = nested.select("rel", "line", place(F.col("i"), F.col("j"), none).alias("ord"), F.concat_ws(".", "i", "j").alias("bi"), string(get(F.col("c"), "$.text")).alias("text"))
    beside = own.select("rel", "line", get(F.col("event"), "$.toolUseResult").alias("s")).where(F.col("s").isNotNull() & ~F.is_variant_null("s"))
    end = F.lit(1 << 30)
    listed = beside.select("rel", "line", F.posexplode(items(F.col("s"))).alias("j", "c")).select("rel", "line", place(end, F.col("j"), none).alias("ord"), F.concat(F.lit("r."), F.col("j")).alias("bi"), F.to_json("c").alias("text"))
    one = beside.where(~is_(F.col("s"), "ARRAY")).select("rel", "line", place(end, none, none).alias("ord"), F.lit("r").alias("bi"), F.coalesce(string(F.col("s")), F.to_json("s")).alias("text"))
    return plain.unionByName(nested).unionByName(listed).unionByName(one).where("text is not null")


def block_of_hit(hits: DataFrame, own: DataFrame, find, context: str = "ctx") -> DataFrame:
    """``hits`` (a row a line) with ``bi``: the first block whose whole text holds the hit, and that block's ``ctx``; where none does the hit is the line's.

    ``find`` is a search of ``operators.search`` over a column ``text``. Only lines with a hit are taken apart.
    """
    lines = own.join(hits.select("rel", "line").distinct(), ["rel", "line"], "left_semi")
    found = find(block_texts(lines)).groupBy("rel", "line").agg(F.min_by(F.struct("bi", F.col("ctx").alias("_ctx")), "ord").alias("_b"))
    out = hits.join(found, ["rel", "line"], "left")
    return out.withColumns({"bi": F.col("_b.bi"), context: F.coalesce(F.col("_b._ctx"), F.col(context))}).drop("_b")


def payload_blocks(lines: DataFrame) -> DataFrame:
    """(rel, line, bi, key, bytes, media head): emptied payloads by the block that held them.

    Payloads of a key and blocks that lack one are matched by their order in the line, and only where their numbers agree. The part of
    the event that stands first in the text comes first.
    """
    e = F.col("event")
    get = lambda v, p, kind="variant": F.try_variant_get(v, p, kind)
    own = lines.where(F.size("blobs") > 0).select("rel", "line", "event", "blobs", (F.instr("text", '"toolUseResult":') < F.instr("text", '"message":')).alias("side_first"))
    side = F.when(F.col("side_first") & (F.lit(1) > 0), 0).otherwise(2)
    blocks = own.select("rel", "line", "side_first", F.posexplode(get(e, "$.message.content", "array<variant>")).alias("i", "b"))
    empty = lambda v: get(v, "$.source.data", "string") == ""
    image = lambda v: get(v, "$.type", "string") == "image"
    plain = blocks.where(image(F.col("b")) & empty(F.col("b"))).select("rel", "line", F.lit(1).alias("p"), "i", F.lit(-1).alias("j"), F.col("i").cast("string").alias("bi"), F.lit("data").alias("key"))
    nested = blocks.select("rel", "line", "i", F.posexplode(get(F.col("b"), "$.content", "array<variant>")).alias("j", "b"))
    nested = nested.where(image(F.col("b")) & empty(F.col("b"))).select("rel", "line", F.lit(1).alias("p"), "i", "j", F.concat_ws(".", "i", "j").alias("bi"), F.lit("data").alias("key"))
    listed = own.select("rel", "line", side.alias("p"), F.posexplode(get(e, "$.toolUseResult", "array<variant>")).alias("i", "b"))
    listed = listed.where(empty(F.col("b"))).select("rel", "line", "p", "i", F.lit(-1).alias("j"), F.concat(F.lit("r."), F.col("i")).alias("bi"), F.lit("data").alias("key"))
    file = own.where(get(e, "$.toolUseResult.file.base64", "string") == "").select("rel", "line", side.alias("p"), F.lit(0).alias("i"), F.lit(-1).alias("j"), F.lit("r").alias("bi"), F.lit("base64").alias("key"))
    w = Window.partitionBy("rel", "line", "key")
    places = plain.unionByName(nested).unionByName(listed).unionByName(file).withColumns({"k": F.row_number().over(w.orderBy("p", "i", "j")), "n": F.count(F.lit(1)).over(w)})
    found = own.select("rel", "line", F.posexplode("blobs").alias("pos", "x")).where("x.key <> 'signature'").select("rel", "line", F.col("x.key").alias("key"), "pos", F.col("x.bytes").alias("bytes"), F.col("x.head").alias("head"))
    found = found.withColumns({"k": F.row_number().over(w.orderBy("pos")), "n": F.count(F.lit(1)).over(w)})
    return places.join(found, ["rel", "line", "key", "k", "n"]).select("rel", "line", "bi", "key", "bytes", "head")


#: Media types that a picture may be said to be. Fixed values.
MEDIA = ("image/png", "image/jpeg", "image/webp", "image/gif")


def pictures(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """(rel, line, bi, media_type, content): the payloads of blocks, decoded from the lines as recorded.

    The recorded type counts if it is one of MEDIA, else what the payload begins like; content is null where it is no base64.
    """
    from tallyloom.operators.inventory import media_type

    own = blocks.select("rel", "line", "bi").join(raw.select("rel", "line", "text"), ["rel", "line"])
    path = json_path(F.col("bi"))
    get = lambda p: F.call_function("get_json_object", F.col("text"), p)
    body = F.coalesce(get(F.concat(path, F.lit(".source.data"))), get(F.concat(path, F.lit(".file.base64"))))
    said = get(F.concat(path, F.lit(".source.media_type")))
    own = own.withColumns({"_body": body, "_said": said})
    kind = F.when(F.col("_said").isin(*MEDIA), F.col("_said")).otherwise(media_type(F.col("_body")))
    return own.select("rel", "line", "bi", kind.alias("media_type"), F.try_to_binary("_body", F.lit("base64")).alias("content"))
