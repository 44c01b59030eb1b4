"""What a log's lines say: rows in file order, turns, sub-agents and the turn each belongs to.

Order is always (file, line, place in the line); time never orders anything but the fallback that
puts an agent without a recorded edge into the turn whose window holds its first event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.columns import head, utf16_length
from tallyloom.operators import sequences
from tallyloom.sources.logs import texts

_BLOCK_KINDS = ("text", "thinking", "tool_use", "tool_result", "fallback", "image")
#: Event types that are snapshots of a state: their latest value and number count, not each row. Fixed values.
SNAPSHOTS = ("last-prompt", "ai-title", "custom-title", "mode", "pr-link", "frame-link")
#: Of each file tool, the input field that holds its path and what it does to it. Fixed values.
PATH_TOOLS = {"Read": ("file_path", "read"), "Write": ("file_path", "write"), "Edit": ("file_path", "edit"), "NotebookEdit": ("notebook_path", "edit"), "Glob": ("path", "search"), "Grep": ("path", "search")}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def events(lines: DataFrame) -> DataFrame:
    """The readable lines with their type, time and flags as columns."""
    e = F.col("event")
    content = F.try_variant_get(e, "$.message.content", "variant")
    origin, text = _get(e, "$.origin.kind"), F.when(_is(content, "STRING"), _get(e, "$.message.content"))
    kind = F.coalesce(_get(e, "$.type"), F.lit("(none)"))
    prompt = (kind == "user") & (F.coalesce(origin == "human", F.lit(False)) | (F.try_variant_get(e, "$.origin", "variant").isNull() & F.coalesce(text.startswith("<command-message>"), F.lit(False))))
    return lines.where(~F.col("torn")).select(
        "rel", "slug", "session_id", "agent_id", "run_id", "line", F.col("kind").alias("tier"), kind.alias("type"),
        F.unix_millis(F.try_to_timestamp(_get(e, "$.timestamp"))).alias("at"),
        (prompt & (F.col("kind") == "main")).alias("opener"),
        F.coalesce(_get(e, "$.isMeta", "boolean"), F.lit(False)).alias("meta"),
        F.coalesce(_get(e, "$.isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
        content.alias("content"), "event",
    )


def rows(own: DataFrame) -> DataFrame:
    """One row per block in file order: rel, line, bi (the block's address), kind, at, head, size, tool, tool_id, is_error.

    String content is one block. A tool result's own blocks are rows i.j below the result's row i; the text
    parts of a user's message are one prompt after its other rows.
    """
    listed = F.when(_is(F.col("content"), "ARRAY"), F.try_variant_get("content", "$", "array<variant>"))
    base = own.select("rel", "slug", "session_id", "agent_id", "tier", "line", "type", "at", "meta", "event", listed.alias("list"), F.when(_is(F.col("content"), "STRING"), F.col("content").cast("string")).alias("string"))
    spoken = base.where(F.col("type").isin("assistant", "user"))
    keep = ["rel", "slug", "session_id", "agent_id", "tier", "line", "type", "at", "meta"]

    def shaped(df: DataFrame, b: Column, bi: Column, order: Column) -> DataFrame:
        t = _get(b, "$.type")
        kind = F.when(t.isin(*_BLOCK_KINDS), t).otherwise(F.concat(F.lit("unknown:"), F.coalesce(t, F.lit("(none)"))))
        body = F.coalesce(_get(b, "$.text"), _get(b, "$.thinking"), F.when(_is(F.try_variant_get(b, "$.content", "variant"), "STRING"), _get(b, "$.content")), _preview(b), F.lit(""))
        return df.select(
            *keep, bi.alias("bi"), order.alias("ord"), kind.alias("kind"), head(body).alias("head"), utf16_length(body).alias("size"),
            _get(b, "$.name").alias("tool"), F.coalesce(_get(b, "$.id"), _get(b, "$.tool_use_id")).alias("tool_id"), F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
            _path(b).alias("path"),
        )

    blocks = spoken.where("list is not null").select(*keep, F.posexplode("list").alias("i", "b"))
    text_of_user = (F.col("type") == "user") & (_get(F.col("b"), "$.type") == "text")
    plain = shaped(blocks.where(~F.coalesce(text_of_user, F.lit(False))), F.col("b"), F.col("i").cast("string"), F.struct(F.col("i").alias("i"), F.lit(-1).alias("j")))
    inner = F.try_variant_get("b", "$.content", "array<variant>")
    nested = blocks.where(_get(F.col("b"), "$.type") == "tool_result").where(_is(F.try_variant_get("b", "$.content", "variant"), "ARRAY")).select(*keep, "i", F.posexplode(inner).alias("j", "c"))
    nested = shaped(nested, F.col("c"), F.concat_ws(".", "i", "j"), F.struct("i", "j"))
    end = F.struct(F.lit(1 << 30).alias("i"), F.lit(-1).alias("j"))
    parts = F.filter(F.col("list"), lambda b: _get(b, "$.type") == "text")
    said = F.coalesce(F.col("string"), F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda b: F.coalesce(_get(b, "$.text"), F.lit(""))), "\n")))
    prompts = spoken.withColumn("said", said).where((F.col("type") == "user") & F.col("said").isNotNull())
    answers = spoken.where("type = 'assistant' and string is not null").withColumn("said", F.col("string"))
    one = lambda df, kind: df.select(
        *keep, F.lit("0").alias("bi"), end.alias("ord"), F.lit(kind).alias("kind"), head(F.col("said")).alias("head"), utf16_length(F.col("said")).alias("size"),
        *(F.lit(None).cast("string").alias(c) for c in ("tool", "tool_id")), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("path"),
    )
    e, t = F.col("event"), F.col("type")
    other = base.where(~t.isin("assistant", "user", *SNAPSHOTS))
    kind = F.when(t == "attachment", F.concat(F.lit("attachment:"), F.coalesce(_get(e, "$.attachment.type"), F.lit("(none)")))).when(t == "system", F.concat(F.lit("system:"), F.coalesce(_get(e, "$.subtype"), F.lit("(none)")))).when(t == "queue-operation", t).otherwise(F.concat(F.lit("unknown:"), t))
    other = other.withColumn("said", F.coalesce(_get(e, "$.error.formatted"), _get(e, "$.error.message"), F.when(_is(F.try_variant_get(e, "$.content", "variant"), "STRING"), _get(e, "$.content")), F.lit("")))
    other = other.select(*keep, F.lit("r").alias("bi"), end.alias("ord"), kind.alias("kind"), head(F.col("said")).alias("head"), utf16_length(F.col("said")).alias("size"), *(F.lit(None).cast("string").alias(c) for c in ("tool", "tool_id")), F.lit(False).alias("is_error"), F.lit(None).cast("string").alias("path"))
    return plain.unionByName(nested).unionByName(one(prompts, "prompt")).unionByName(one(answers, "text")).unionByName(other)


def _preview(b: Column) -> Column:
    """What best tells a tool call: the first of its usual fields that isn't blank."""
    fields = ("description", "file_path", "path", "pattern", "command", "prompt")
    return F.coalesce(*(F.nullif(F.trim(_get(b, f"$.input.{f}")), F.lit("")) for f in fields))


def _path(b: Column) -> Column:
    """The path that a file tool names in the field that is its own; path-like fields of other tools are no file operations."""
    out = F.lit(None).cast("string")
    for field in sorted({f for f, _ in PATH_TOOLS.values()}):
        out = F.when(_get(b, "$.name").isin(*(t for t, (f, _) in PATH_TOOLS.items() if f == field)), _get(b, f"$.input.{field}")).otherwise(out)
    return out


def turn_of_lines(own: DataFrame) -> DataFrame:
    """(rel, session_id, line, turn_idx) of main files: openers so far, 0 before the first."""
    main = own.where("tier = 'main'").select("rel", "session_id", "line", "opener")
    return sequences.turns(main, "rel", "line", F.col("opener")).drop("opener")


def turns(own: DataFrame) -> DataFrame:
    """One row per turn: opener_line, window [start, end), at and end_at of its conversation, clamped where time ran backwards."""
    main = own.where("tier = 'main'")
    placed = main.join(turn_of_lines(own), ["rel", "session_id", "line"])
    talk = F.col("type").isin("assistant", "user") & ~F.col("meta") & ~F.col("sidechain")
    spans = placed.groupBy("rel", "session_id", "turn_idx").agg(F.min(F.when(F.col("opener"), F.col("line"))).alias("opener_line"), F.min(F.when(F.col("opener"), F.col("at"))).alias("opened"), F.min(F.when(talk, F.col("at"))).alias("at"), F.max(F.when(talk, F.col("at"))).alias("end_at"), F.count(F.lit(1)).alias("n_events"))
    windows = sequences.turn_windows(spans.where("turn_idx > 0").select("rel", "turn_idx", F.col("opened").alias("_at")), "rel", "_at", "turn_idx").drop("_at")
    return spans.join(windows, ["rel", "turn_idx"], "left").drop("opened")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """What stands beside each agent: type, description, the call that spawned it, its parent, its depth."""
    own = texts(spark, root, ".meta.json").withColumn("v", F.try_parse_json("value"))
    v = F.col("v")
    return own.select("session_id", "agent_id", _get(v, "$.agentType").alias("agent_type"), _get(v, "$.description").alias("description"), _get(v, "$.toolUseId").alias("tool_id"), _get(v, "$.parentAgentId").alias("parent_id"), _get(v, "$.spawnDepth", "int").alias("depth"))


def call_descriptions(own: DataFrame) -> DataFrame:
    """(session_id, tool_id, description, model): what each call says of itself, over all transcripts of its session; of several the last one counts."""
    b = F.col("b")
    calls = own.select("session_id", "tier", "rel", "line", F.posexplode(F.when(_is(F.col("content"), "ARRAY"), F.try_variant_get("content", "$", "array<variant>"))).alias("i", "b")).where(_get(b, "$.type") == "tool_use")
    text = lambda p: F.when(_is(F.try_variant_get(b, p, "variant"), "STRING"), _get(b, p))
    said = calls.select("session_id", _get(b, "$.id").alias("tool_id"), F.struct(F.col("tier") != "main", "rel", "line", "i").alias("at"), text("$.input.description").alias("description"), text("$.input.model").alias("model"))
    said = said.where(F.col("tool_id").isNotNull() & (F.col("description").isNotNull() | F.col("model").isNotNull()))
    return said.groupBy("session_id", "tool_id").agg(F.max_by(F.struct("description", "model"), "at").alias("_d")).select("session_id", "tool_id", "_d.description", "_d.model")


def labels(known: DataFrame, own: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """(session_id, agent_id, label, label_source) of agents with agent_type, description (their sidecar's), tool_id and prompt.

    The first of: the run record's label, the prompt's own tag, the description of the call (or of its result), the sidecar's, type and id.
    """
    calls = call_descriptions(own).select("session_id", "tool_id", F.col("description").alias("_call"))
    e = F.col("event")
    results = own.where("tier = 'main'").select("session_id", "line", _get(e, "$.toolUseResult.agentId").alias("agent_id"), _get(e, "$.toolUseResult.description").alias("_result"))
    results = results.where("agent_id is not null and _result is not null").groupBy("session_id", "agent_id").agg(F.max_by("_result", "line").alias("_result"))
    out = known.join(calls, ["session_id", "tool_id"], "left").join(results, ["session_id", "agent_id"], "left")
    if progress is None:
        out = out.withColumn("_listed", F.lit(None).cast("string"))
    else:
        out = out.join(progress.select("session_id", "agent_id", F.col("label").alias("_listed")).dropDuplicates(["session_id", "agent_id"]), ["session_id", "agent_id"], "left")
    tag = F.trim(F.regexp_extract(F.substring("prompt", 1, 500), r"\[AGENT:\s*([^\]]+)\]", 1))
    fallback = F.concat_ws(" ", F.coalesce("agent_type", F.lit("agent")), "agent_id")
    ladder = (("workflowProgress", F.col("_listed")), ("prompt-tag", tag), ("input.description", F.coalesce("_call", "_result")), ("meta.description", F.col("description")))
    there = [(name, F.nullif(text, F.lit(""))) for name, text in ladder]
    source = F.coalesce(*(F.when(text.isNotNull(), F.lit(name)) for name, text in there), F.lit("fallback"))
    return out.select("session_id", "agent_id", F.coalesce(*(text for _, text in there), fallback).alias("label"), source.alias("label_source"))


def agents(own: DataFrame, all_rows: DataFrame, beside: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """One row per agent transcript: its span, label with its source, parent, and its turn with the edge that gave it.

    The edge is the recorded call, else the parent's (through any number of parents), else the turn whose
    window holds the agent's first event; cycles are reported and have no turn.
    """
    spans = own.where("tier = 'agent'").groupBy("session_id", "agent_id", "rel").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n_events"))
    calls = all_rows.where("tier = 'main' and kind = 'tool_use'").select("session_id", "rel", "line", "tool_id").join(turn_of_lines(own), ["rel", "session_id", "line"]).groupBy("session_id", "tool_id").agg(F.min("turn_idx").alias("call_turn"))
    prompt = all_rows.where("tier = 'agent' and kind = 'prompt'").groupBy("session_id", "agent_id").agg(F.min_by("head", "line").alias("prompt"))
    known = spans.join(beside, ["session_id", "agent_id"], "left").join(calls, ["session_id", "tool_id"], "left").join(prompt, ["session_id", "agent_id"], "left")
    name = lambda c: F.concat_ws("/", "session_id", c)
    up = sequences.lineage(known.select(name("agent_id").alias("id"), F.when(F.col("call_turn").isNull() & F.col("parent_id").isNotNull(), name("parent_id")).alias("up")), "id", "up")
    roots = known.select(name("agent_id").alias("root"), F.col("call_turn").alias("root_turn"), F.col("first_at").alias("root_at"))
    placed = known.withColumn("id", name("agent_id")).join(up.select("id", "root", "cyclic"), "id", "left").join(roots, "root", "left")
    starts = turns(own).where("turn_idx > 0").groupBy("session_id", F.col("start").alias("first_at")).agg(F.max("turn_idx").alias("idx"))
    timed = sequences.asof(placed.where("first_at is not null").select("session_id", "agent_id", "first_at"), starts, ["session_id"], "first_at", "idx", "time_turn").select("session_id", "agent_id", "time_turn")
    out = placed.join(timed, ["session_id", "agent_id"], "left")
    out = out.join(labels(known.select("session_id", "agent_id", "agent_type", "description", "tool_id", "prompt"), own, progress), ["session_id", "agent_id"], "left")
    turn = F.when(F.col("cyclic"), F.lit(None)).otherwise(F.coalesce("call_turn", "root_turn", "time_turn", F.when(F.col("first_at").isNotNull(), F.lit(0).cast("long"))))
    edge = F.when(F.col("cyclic"), "cycle").when(F.col("call_turn").isNotNull(), "call").when(F.col("root_turn").isNotNull(), "parent").when(turn.isNotNull(), "time")
    return out.select("session_id", "agent_id", "rel", "agent_type", "label", "label_source", "parent_id", "first_at", "last_at", "n_events", turn.alias("turn_idx"), edge.alias("edge"))


def kind_census(all_rows: DataFrame) -> DataFrame:
    return all_rows.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def tool_spans(all_rows: DataFrame) -> DataFrame:
    """Calls and results of each tool id paired first-open-first in file order; unmatched sides stay."""
    place = F.row_number().over(Window.partitionBy("rel").orderBy("line", "ord")).cast("long")
    own = all_rows.where("kind in ('tool_use', 'tool_result') and tool_id is not null").withColumn("seq", place)
    return sequences.fifo_pairs(own.withColumn("call", F.concat_ws("\0", "rel", "tool_id")), "call", "seq", F.col("kind") == "tool_use", F.col("kind") == "tool_result")


def tool_histogram(all_rows: DataFrame) -> DataFrame:
    """(tool, server, n): calls by tool, the server of tools that come from one."""
    server = F.nullif(F.regexp_extract("tool", "^mcp__(.+?)__", 1), F.lit(""))
    return all_rows.where("kind = 'tool_use'").groupBy("tool", server.alias("server")).agg(F.count(F.lit(1)).alias("n"))


def file_ledger(all_rows: DataFrame) -> DataFrame:
    """(path, tier, op counts): what tools did to each path."""
    op = F.create_map(*(F.lit(x) for tool, (_, does) in PATH_TOOLS.items() for x in (tool, does)))
    own = all_rows.where("kind = 'tool_use' and path is not null").withColumn("op", op[F.col("tool")]).where("op is not null")
    return own.groupBy("path", "tier").agg(*(F.count_if(F.col("op") == o).alias(o) for o in ("read", "write", "edit", "search")))


def journal_census(lines: DataFrame) -> DataFrame:
    """(session_id, run_id, agent_id, started, results, state) from the runs' journals."""
    e = F.col("event")
    own = lines.where("kind = 'journal' and not torn").select("session_id", "run_id", _get(e, "$.agentId").alias("agent_id"), _get(e, "$.type").alias("type"))
    out = own.groupBy("session_id", "run_id", "agent_id").agg(F.count_if(F.col("type") == "started").alias("started"), F.count_if(F.col("type") == "result").alias("results"))
    state = F.when(F.col("results") == 0, "running").when(F.col("started") == 0, "result only").when(F.col("started") > 1, "retried").otherwise("done")
    return out.withColumn("state", state)


def snapshots(own: DataFrame) -> DataFrame:
    """(rel, type, n, value): how often a state was written and what it last was."""
    e = F.col("event")
    value = F.coalesce(_get(e, "$.customTitle"), _get(e, "$.aiTitle"), _get(e, "$.lastPrompt"), _get(e, "$.mode"), _get(e, "$.prUrl"), _get(e, "$.frameUrl"))
    return own.where(F.col("type").isin(*SNAPSHOTS)).groupBy("rel", "type").agg(F.count(F.lit(1)).alias("n"), F.max_by(value, F.when(value.isNotNull(), F.col("line"))).alias("value"))
