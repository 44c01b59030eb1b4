"""What a session's events say beside its turns and its money: extents, first prompts, links, senders, leaves, agents' states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.transcripts import _get


def spans(events: DataFrame) -> DataFrame:
    """One row per session: first and last time, the first time in file order, folders and versions seen, the last branch, ids of other sessions."""
    e = F.col("event")
    main = events.where("tier = 'main'").withColumns({"_cwd": _get(e, "$.cwd"), "_version": _get(e, "$.version"), "_branch": _get(e, "$.gitBranch"), "_own": F.lower(_get(e, "$.sessionId"))})
    seen = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  distinct folders or versions of one session: a handful
    return main.groupBy("session_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min_by("at", F.when(F.col("at").isNotNull(), F.col("line"))).alias("opened_at"),
        seen("_cwd").alias("cwds"), seen("_version").alias("versions"), F.max_by("_branch", F.when(F.col("_branch").isNotNull(), F.col("line"))).alias("branch"),
        F.array_sort(F.array_except(F.collect_set("_own"), F.array(F.first("session_id")))).alias("other_ids"),
    )


def first_prompts(rows: DataFrame) -> DataFrame:
    """(session_id, prompt): the first thing that was asked in the main file."""
    return rows.where("tier = 'main' and kind = 'prompt' and not meta").groupBy("session_id").agg(F.min_by("head", "line").alias("prompt"))


def titled(cards: DataFrame, prompts: DataFrame) -> DataFrame:
    """``cards`` (session_id, custom_title, ai_title) with ``title`` and where it comes from."""
    own = cards.join(prompts, "session_id", "left")
    ladder = (("custom", "custom_title"), ("ai", "ai_title"), ("prompt", "prompt"), ("id", "session_id"))
    source = F.lit(None).cast("string")
    for name, c in reversed(ladder):
        source = F.when(F.col(c).isNotNull(), F.lit(name)).otherwise(source)
    return own.withColumns({"title": F.coalesce(*(F.col(c) for _, c in ladder)), "title_from": source})


def day_extents(events: DataFrame) -> DataFrame:
    """(day, session_id, first_at, last_at, n) of the main files' events."""
    own = events.where("tier = 'main' and at is not null").withColumn("day", F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd"))
    return own.groupBy("day", "session_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def links(events: DataFrame) -> DataFrame:
    """(session_id, type, url, n, place): links of a session, each once, with its number of events and its place by first appearance."""
    e = F.col("event")
    url = F.coalesce(_get(e, "$.prUrl"), _get(e, "$.frameUrl"))
    own = events.where(F.col("type").isin("pr-link", "frame-link")).select("session_id", "type", "line", url.alias("url")).where("url is not null")
    own = own.groupBy("session_id", "type", "url").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("_line"))
    place = F.row_number().over(Window.partitionBy("session_id", "type").orderBy("_line")).cast("long")
    return own.withColumn("place", place).drop("_line")


def senders(events: DataFrame) -> DataFrame:
    """(session_id, sender, n): messages of peers by who sent them; null where that isn't recorded."""
    e = F.col("event")
    own = events.where(_get(e, "$.origin.kind") == "peer")
    return own.groupBy("session_id", _get(e, "$.origin.senderTaskId").alias("sender")).agg(F.count(F.lit(1)).alias("n"))


def leaves(events: DataFrame) -> DataFrame:
    """(session_id, leaf, line): the event that a session's last prompt names, and the line that it is on (null: nowhere)."""
    e = F.col("event")
    named = events.where("type = 'last-prompt'").groupBy("session_id", "rel").agg(F.max_by(_get(e, "$.leafUuid"), "line").alias("leaf"))
    at = events.select("rel", _get(e, "$.uuid").alias("leaf"), "line").where("leaf is not null").groupBy("rel", "leaf").agg(F.min("line").alias("line"))
    return named.join(at, ["rel", "leaf"], "left").select("session_id", "leaf", "line")


def results_of_agents(events: DataFrame) -> DataFrame:
    """(session_id, agent_id, status, model, description): what the last answer about an agent records."""
    e = F.col("event")
    own = events.where("tier = 'main'").select("session_id", "line", _get(e, "$.toolUseResult.agentId").alias("agent_id"), _get(e, "$.toolUseResult.status").alias("status"), _get(e, "$.toolUseResult.resolvedModel").alias("model"), _get(e, "$.toolUseResult.description").alias("description"))
    own = own.where("agent_id is not null").groupBy("session_id", "agent_id").agg(F.max_by(F.struct("status", "model", "description"), "line").alias("r"))
    return own.select("session_id", "agent_id", "r.*")


def missing_runs(calls: DataFrame, listing: DataFrame) -> DataFrame:
    """(session_id, run_id): runs that calls name and of which the store has no file: a Problem each."""
    there = listing.where("run_id is not null").select("session_id", "run_id").distinct()
    return calls.select("session_id", "run_id").distinct().join(there, ["session_id", "run_id"], "left_anti")


def runs(agents: DataFrame, journal: DataFrame, records: DataFrame) -> DataFrame:
    """All (session_id, run_id) that anything names, with what does."""
    of = lambda df, name: df.where("run_id is not null").select("session_id", "run_id").distinct().withColumn(name, F.lit(True))
    out = of(agents, "in_agents").join(of(journal, "in_journal"), ["session_id", "run_id"], "full").join(of(records, "in_manifest"), ["session_id", "run_id"], "full")
    return out.select("session_id", "run_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_agents", "in_journal", "in_manifest")))


def turns_of_runs(calls: DataFrame, lines_to_turns: DataFrame) -> DataFrame:
    """(session_id, run_id, turn_idx, owner): the turn of the first call of a run owns it, those of later calls only refer to it."""
    own = calls.select("session_id", "run_id", "first_line", F.explode("lines").alias("line")).join(lines_to_turns.select("session_id", "line", "turn_idx"), ["session_id", "line"])
    return own.groupBy("session_id", "run_id", "turn_idx").agg(F.bool_or(F.col("line") == F.col("first_line")).alias("owner"))


def state_code(listed: Column, result_empty: Column, started: Column, has_result: Column) -> Column:
    """An agent's state by what is recorded: a manifest's error, an empty result, the manifest's word, the journal's."""
    return (
        F.when(listed == "error", "error").when(result_empty, "no-result").when(listed.isin("done", "superseded", "running"), listed).when(listed.isNotNull(), "other")
        .when(started & ~F.coalesce(has_result, F.lit(False)), "running").when(started & has_result, "done").otherwise("unrecorded")
    )


def workflow_input(v: Column) -> Column:
    """Which of the recorded shapes the input of a workflow call has."""
    there = lambda p: F.try_variant_get(v, p, "variant").isNotNull()
    truthy = lambda p: F.coalesce(_get(v, p) != "", F.lit(False))
    return (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not recorded").when(truthy("$.resumeFromRunId"), "resume").when(F.schema_of_variant(F.try_variant_get(v, "$.script", "variant")) == "STRING", "inline script")
        .when(truthy("$.scriptPath"), "scriptPath").when(truthy("$.name") & there("$.args"), "registered workflow with args").when(truthy("$.name"), "registered workflow").otherwise("unrecognised shape")
    )


def project_label(cwds: DataFrame) -> DataFrame:
    """(slug, cwd): the recorded folder whose name, with separators as dashes, is the project's."""
    own = cwds.where(F.regexp_replace("cwd", r"[\\/:. ]", "-") == F.col("slug"))
    return own.groupBy("slug").agg(F.min("cwd").alias("cwd"))


def model_of_agent(result: Column, listed: Column, sidecar: Column, own: Column, *, own_first: bool = False) -> Column:
    """An agent's model by the ladder of a view: what the server resolved first, or what its own events say first."""
    return F.coalesce(own, result, listed, sidecar) if own_first else F.coalesce(result, listed, sidecar, own)


def lanes(agents: DataFrame) -> DataFrame:
    """``agents`` with ``lane``, their order in a view: by first event, else queueing, unknown last, then by id."""
    w = Window.partitionBy("session_id").orderBy(F.coalesce("first_at", "queued_at").asc_nulls_last(), "agent_id")
    return agents.withColumn("lane", F.row_number().over(w).cast("long"))


def overlap(agents: DataFrame, spans_: DataFrame) -> DataFrame:
    """(session_id, ratio): how many of its agents a session ran at a time on average: their spans over its span."""
    own = agents.groupBy("session_id").agg(F.sum(F.col("last_at") - F.col("first_at")).alias("busy"))
    span = F.col("last_at") - F.col("first_at")
    return own.join(spans_, "session_id").select("session_id", "busy", span.alias("span"), F.round(F.col("busy") / F.when(span > 0, span), 6).alias("ratio"))


def unread_tails(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """(rel, tail): bytes behind a log's last complete line; any mean that it is being written."""
    read = lines.groupBy("rel").agg(F.max(F.col("byte_offset") + F.col("bytes") + 1).alias("read"))
    return listing.where("kind in ('main', 'agent', 'journal')").join(read, "rel", "left").select("rel", F.greatest(F.lit(0), F.col("size") - F.coalesce("read", F.lit(0))).alias("tail"))


def latest_first(sessions: DataFrame, mtime: str = "mtime") -> DataFrame:
    """Scan order: what was changed last comes first, then by id."""
    return sessions.orderBy(F.col(mtime).desc_nulls_last(), "session_id")


def inventory(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """(what, n) of a whole store: files by class, ids with several main files, torn lines, files of no class: those that should be none are there too."""
    own = listing.groupBy(F.concat(F.lit("files:"), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    twice = listing.where("kind = 'main'").groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate ids").alias("what"), "n")
    torn = lines.agg(F.count_if("torn").alias("n")).select(F.lit("torn lines").alias("what"), "n")
    odd = listing.agg(F.count_if(F.col("kind") == "unclassified").alias("n")).select(F.lit("files of no class").alias("what"), "n")
    return own.unionByName(twice).unionByName(torn).unionByName(odd)


def event_fates(events: DataFrame, rows: DataFrame) -> DataFrame:
    """(type, fate, n): events by type and what became of them: rows of their own, a session's state, or counted only."""
    from tallyloom.operators.transcripts import SNAPSHOTS

    shown = rows.select("rel", "line").distinct().withColumn("_shown", F.lit(True))
    fate = F.when(F.col("type").isin(*SNAPSHOTS), "state").when(F.col("_shown"), "rows").otherwise("counted")
    return events.join(shown, ["rel", "line"], "left").groupBy("type", fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))
