"""What a store holds beside its transcripts: runs and manifests, memory notes, spilled outputs, images, and the cards of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.columns import day
from tallyloom.operators import ledger, transcripts
from tallyloom.operators.transcripts import _get
from tallyloom.sources.logs import RUN, texts

#: First base64 characters of the media types that are told apart. Fixed values.
MAGIC = (("iVBOR", "image/png"), ("/9j/", "image/jpeg"), ("UklGR", "image/webp"), ("R0lGOD", "image/gif"), ("JVBER", "application/pdf"))


def media_type(head: Column) -> Column:
    """The media type that a base64 text begins like; null for any other."""
    out = F.lit(None).cast("string")
    for start, kind in reversed(MAGIC):
        out = F.when(head.startswith(start), F.lit(kind)).otherwise(out)
    return out


def _time(v: Column, path: str) -> Column:
    """A manifest's time: a number of milliseconds or a text."""
    number = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.lit(False))
    return F.when(number, _get(v, path, "bigint")).otherwise(F.unix_millis(F.try_to_timestamp(_get(v, path))))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per run record: status, times, gauges as recorded, and its ``progress`` (VARIANT array)."""
    v = F.col("v")
    own = texts(spark, root, ".json", "manifest").withColumn("v", F.try_parse_json("value"))
    return own.select(
        "session_id", "run_id", v.isNull().alias("unreadable"), _get(v, "$.status").alias("status"), _get(v, "$.workflowName").alias("name"), _time(v, "$.startTime").alias("started_at"), _time(v, "$.timestamp").alias("ended_at"),
        _get(v, "$.durationMs", "bigint").alias("duration_ms"), _get(v, "$.agentCount", "bigint").alias("agent_count"), _get(v, "$.totalTokens", "bigint").alias("total_tokens"), _get(v, "$.totalToolCalls", "bigint").alias("total_tool_calls"),
        F.try_variant_get(v, "$.workflowProgress", "array<variant>").alias("progress"),
    )


def progress(records: DataFrame) -> DataFrame:
    """One row per agent of a run record; of several entries of an agent the last counts."""
    own = records.select("session_id", "run_id", F.posexplode("progress").alias("i", "p")).where(_get(F.col("p"), "$.type") == "workflow_agent")
    p = F.col("p")
    cols = own.select(
        "session_id", "run_id", "i", _get(p, "$.agentId").alias("agent_id"), _get(p, "$.label").alias("label"), _get(p, "$.phaseTitle").alias("phase"), _get(p, "$.model").alias("model"), _get(p, "$.state").alias("state"),
        _time(p, "$.queuedAt").alias("queued_at"), _time(p, "$.startedAt").alias("started_at"), _get(p, "$.durationMs", "bigint").alias("duration_ms"), F.coalesce(_get(p, "$.cached", "boolean"), F.lit(False)).alias("cached"),
    )
    rest = [c for c in cols.columns if c not in ("session_id", "run_id", "agent_id", "i")]
    return cols.where("agent_id is not null").groupBy("session_id", "run_id", "agent_id").agg(F.max_by(F.struct(*rest), "i").alias("p")).select("session_id", "run_id", "agent_id", "p.*")


def run_agents(records: DataFrame, journal: DataFrame, own: DataFrame) -> DataFrame:
    """Manifest, journal and transcripts of each run's agents side by side, with the state that is recorded.

    done or error as the manifest says; superseded if a finished manifest leaves out what the journal began;
    running if there is a start and no manifest yet; null where nothing says. ``lost``: begun, no transcript.
    """
    keys = ["session_id", "run_id", "agent_id"]
    disk = own.where("tier = 'agent' and run_id is not null").select(*keys).distinct().withColumn("on_disk", F.lit(True))
    listed = progress(records).select(*keys, F.col("state").alias("listed_state"), "label", "phase", "model", F.lit(True).alias("in_manifest"))
    noted = journal.select(*keys, "started", "results", F.lit(True).alias("in_journal"))
    finished = records.where("not unreadable").select("session_id", "run_id", F.lit(True).alias("_finished")).distinct()
    both = listed.join(noted, keys, "full").join(disk, keys, "full").join(finished, keys[:2], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    begun = F.coalesce("started", F.lit(0)) > 0
    state = F.when(flag("in_manifest"), F.col("listed_state")).when(flag("_finished") & begun, "superseded").when(begun & (F.col("results") == 0), "running")
    out = both.withColumn("state", state).withColumn("lost", begun & ~flag("on_disk"))
    return out.withColumns({c: flag(c) for c in ("in_manifest", "in_journal", "on_disk")}).drop("_finished")


def run_files(listing: DataFrame, known: DataFrame, cost_by_agent: DataFrame | None = None) -> DataFrame:
    """One row per agent transcript that stands in a run's folder, with what the session knows of its agent.

    ``known``: (session_id, agent_id, rel, and any of run_id, model, label ...). A file meets its agent by path; only a file that no path meets
    is looked up by agent id, where of several entries the one with the greatest path counts. ``matched`` is rel, id or null: a file that
    the session doesn't know yet is a row of its own, and its cost is unknown, not zero. ``cost_by_agent``: (session_id, agent_id, requests, tcu).
    """
    files = listing.where("kind = 'agent' and run_id is not null").select("slug", "session_id", "agent_id", F.col("run_id").alias("_run"), "rel")
    files = files.withColumn("file", F.element_at(F.split("rel", "/"), -1))
    rest = [c for c in known.columns if c not in ("session_id", "agent_id", "rel")]
    facts = F.struct(F.lit(True).alias("_there"), *rest)
    by_rel = known.where("rel is not null").groupBy("session_id", "rel").agg(F.max_by(facts, "agent_id").alias("_r"))
    by_id = known.where("agent_id is not null").groupBy("session_id", F.col("agent_id").alias("_id")).agg(F.max_by(facts, F.coalesce("rel", F.lit(""))).alias("_i"))
    first = files.join(by_rel, ["session_id", "rel"], "left").withColumn("_id", F.when(F.col("_r").isNull(), F.col("agent_id")))
    both = first.join(by_id, ["session_id", "_id"], "left").withColumn("_hit", F.coalesce("_r", "_i"))
    out = both.withColumn("matched", F.when(F.col("_r").isNotNull(), "rel").when(F.col("_i").isNotNull(), "id"))
    run = F.coalesce("_hit.run_id", "_run") if "run_id" in rest else F.col("_run")
    out = out.select("session_id", "agent_id", "rel", "file", "matched", run.alias("run_id"), *(F.col(f"_hit.{c}").alias(c) for c in rest if c != "run_id"))
    if cost_by_agent is None:
        return out
    zero = F.when(F.col("matched").isNotNull(), F.lit(0).cast("long"))
    out = out.join(cost_by_agent.select("session_id", "agent_id", F.col("requests").alias("_n"), F.col("tcu").alias("_tcu")), ["session_id", "agent_id"], "left")
    return out.withColumns({"requests": F.coalesce("_n", zero), "tcu": F.coalesce("_tcu", zero)}).drop("_n", "_tcu")


def run_badges(records: DataFrame, journal: DataFrame) -> DataFrame:
    """(session_id, badges) of sessions with runs: what their records and journals say, in this order; sessions without any are left out.

    retried: a journal began more agents than its run's record lists. running: a run without a record has an agent begun and not
    ended. cached: a record lists an agent whose result was taken from before. An unreadable record counts as none.
    """
    keys = ["session_id", "run_id"]
    listed = F.size(F.filter("progress", lambda p: _get(p, "$.type") == "workflow_agent")).cast("long")
    own = records.where("not unreadable").groupBy(*keys).agg(F.max(F.when(F.col("progress").isNotNull(), listed)).alias("_listed"), F.lit(True).alias("_record"))
    noted = journal.groupBy(*keys).agg(F.sum("started").alias("_begun"), F.bool_or((F.col("started") > 0) & (F.col("results") == 0)).alias("_open"))
    runs = own.join(noted, keys, "full").join(progress(records).where("cached").select(*keys, F.lit(True).alias("_cached")).distinct(), keys, "left")
    says = {"retried": F.col("_begun") > F.col("_listed"), "running": F.col("_record").isNull() & F.col("_open"), "cached": F.col("_cached")}
    out = runs.groupBy("session_id").agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(b) for b, c in says.items()))
    return out.select("session_id", F.array_compact(F.array(*(F.when(F.col(b), F.lit(b)) for b in says))).alias("badges")).where(F.size("badges") > 0)


def run_calls(own: DataFrame) -> DataFrame:
    """(session_id, run_id, first_line, lines): the calls that name a run; the first owns it, the others resume it."""
    e = F.col("event")
    side = _get(e, "$.toolUseResult.runId")
    said = F.to_json(F.col("content"))
    found = own.where("tier = 'main'").select("session_id", "line", F.array_union(F.coalesce(F.regexp_extract_all(said, F.lit(f"({RUN})"), 1), F.array().cast("array<string>")), F.array_compact(F.array(side))).alias("runs"))
    return found.select("session_id", "line", F.explode("runs").alias("run_id")).groupBy("session_id", "run_id").agg(F.min("line").alias("first_line"), F.array_sort(F.collect_set("line")).alias("lines"))


def front_matter(text: Column) -> Column:
    """Front matter as a map: ``key: value`` lines, those under a key without a value as ``key.name``; quotes around values go. Null where a text has none.

    This is the part of YAML that notes use: no lists, no values over several lines.
    """
    front = F.nullif(F.regexp_extract(text, r"^(?:\uFEFF)?---\r?\n([\s\S]*?)\r?\n---", 1), F.lit(""))
    part = lambda x, k: F.regexp_extract(x, r"^(\s*)([A-Za-z_][\w-]*):\s*(.*?)\s*$", k)
    lines = F.filter(F.split(front, "\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][\w-]*:"))
    entries = F.transform(lines, lambda x: F.struct(F.length(part(x, 1)).alias("indent"), part(x, 2).alias("key"), F.regexp_replace(part(x, 3), "^([\"'])(.*)\\1$", "$2").alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    whole = F.aggregate(
        entries, F.struct(F.lit("").alias("under"), none.alias("got")),
        lambda s, e: F.struct(F.when(e["indent"] == 0, e["key"]).otherwise(s["under"]).alias("under"), F.when(e["value"] == "", s["got"]).otherwise(F.concat(s["got"], F.array(F.struct(F.when(e["indent"] > 0, F.concat_ws(".", s["under"], e["key"])).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))).alias("got")),
        lambda s: s["got"],
    )
    return F.when(front.isNotNull(), F.map_from_entries(F.filter(whole, lambda e, i: ~F.exists(F.slice(whole, F.lit(1), i), lambda b: b["key"] == e["key"]))))


def memory(spark: SparkSession, root: str, sessions: DataFrame) -> DataFrame:
    """Memory notes with the session that wrote them: resolved, in another project, dangling, or not recorded."""
    front = F.regexp_extract("value", r"^(?:﻿)?---\r?\n([\s\S]*?)\r?\n---", 1)
    origin = F.nullif(F.lower(F.regexp_extract(front, r"originSessionId:\s*[\"']?([0-9a-fA-F-]{36})", 1)), F.lit(""))
    notes = texts(spark, root, ".md", "memory").select("rel", "slug", origin.alias("origin"))
    known = sessions.select(F.col("session_id").alias("origin"), F.col("slug").alias("home"))
    link = F.when(F.col("origin").isNull(), "not recorded").when(F.col("home").isNull(), "dangling").when(F.col("home") == F.col("slug"), "resolved").otherwise("other project")
    return notes.join(known, "origin", "left").select("rel", "slug", "origin", link.alias("link"))


def spills(own: DataFrame) -> DataFrame:
    """(rel, line, path): places that a tool's answer says its output was saved to, each once a text."""
    said = F.concat_ws("\n", F.to_json(F.col("content")), _get(F.col("event"), "$.toolUseResult.persistedOutputPath"))
    text = F.regexp_replace(said, r'\\n|\\"', "\n")
    named = F.regexp_extract_all(text, F.lit(r"\bsaved to:?\s+((?:[A-Za-z]:\\|/)[^\n\"\]]+)"), 1)
    recorded = F.array_compact(F.array(_get(F.col("event"), "$.toolUseResult.persistedOutputPath")))
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), ";.*$", ""), r"[.,)\]'\"]+$", ""))
    paths = F.array_distinct(F.transform(F.concat(F.coalesce(named, F.array().cast("array<string>")), recorded), clean))
    return own.where("type = 'user'").select("rel", "line", F.explode(paths).alias("path")).where("path <> ''")


def spill_census(listing: DataFrame, refs: DataFrame, root: str) -> DataFrame:
    """Spilled files and whether any answer names them, by exact path without case."""
    named = refs.select(F.lower("path").alias("p")).distinct()
    own = listing.where("kind = 'spill'").withColumn("p", F.lower(F.concat(F.lit(root.rstrip("/") + "/"), F.col("rel"))))
    return own.join(named.withColumn("referenced", F.lit(True)), "p", "left").select("rel", "size", F.coalesce("referenced", F.lit(False)).alias("referenced"))


def images(lines: DataFrame) -> DataFrame:
    """(rel, line, bi, media_type, bytes, twin): payloads by the address of their block.

    On a line that has a picture in its content and one in its sidecar both are the same: the sidecar's is the twin, whatever its
    bytes, and has the type of the first block's where its own isn't known.
    """
    from pyspark.sql import Window

    from tallyloom.operators.records import payload_blocks

    own = payload_blocks(lines).select("rel", "line", "bi", "bytes", media_type(F.col("head")).alias("media_type"))
    line = Window.partitionBy("rel", "line")
    beside = (F.col("bi") == "r") | F.col("bi").startswith("r.")
    part = lambda k: F.try_to_number(F.split_part("bi", F.lit("."), F.lit(k)), F.lit("9" * 9)).cast("int")
    first = F.min_by("media_type", F.when(~beside, F.struct(part(1).alias("i"), part(2).alias("j")))).over(line)
    own = own.withColumns({"twin": beside & (F.count_if(~beside).over(line) > 0), "_first": first})
    return own.withColumn("media_type", F.coalesce("media_type", F.when(F.col("twin"), F.col("_first")))).drop("_first")


def stripped_census(lines: DataFrame) -> DataFrame:
    """What search doesn't see: payloads and signatures taken out, with their bytes."""
    own = lines.select(F.explode("blobs").alias("b"))
    return own.groupBy(F.when(F.col("b.key") == "signature", "signature").otherwise("payload").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("b.bytes").alias("bytes"))


def session_cards(listing_sessions: DataFrame, events: DataFrame, rows: DataFrame, priced: DataFrame, of_runs: DataFrame | None = None) -> DataFrame:
    """One row per session: title, span, counts, cost, and badges for what is recorded about it, with those of ``run_badges`` where they are given."""
    titles = events.where("type in ('custom-title', 'ai-title')").groupBy("session_id").agg(
        F.max_by(_get(F.col("event"), "$.customTitle"), F.when(F.col("type") == "custom-title", F.col("line"))).alias("custom_title"),
        F.max_by(_get(F.col("event"), "$.aiTitle"), F.when(F.col("type") == "ai-title", F.col("line"))).alias("ai_title"),
    )
    seen = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count_if("opener").alias("turns"),
        F.countDistinct(F.when(F.col("tier") == "agent", F.col("agent_id"))).alias("agents"),
        F.bool_or(F.lower(_get(F.col("event"), "$.sessionId")) != F.col("session_id")).alias("_forked"),
        F.max_by(_get(F.col("event"), "$.cwd"), F.when(_get(F.col("event"), "$.cwd").isNotNull(), F.col("line"))).alias("cwd"),
    )
    parts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "tool_use").alias("tool_calls"), F.sum(F.when(F.col("kind") == "thinking", F.col("size"))).alias("thinking_chars"))
    money = ledger.cost(priced, "session_id")
    own = listing_sessions.join(seen, "session_id", "left").join(parts, "session_id", "left").join(titles, "session_id", "left").join(money, "session_id", "left")
    badges = {"fragment": (F.col("n_mains") == 0) | (F.col("n_projects") > 1), "forked": F.coalesce("_forked", F.lit(False)) | (F.coalesce("inherited", F.lit(0)) > 0), "no-reply": (F.col("turns") > 0) & (F.coalesce("requests", F.lit(0)) == 0)}
    label = F.coalesce("custom_title", "ai_title", "session_id")
    own = own.withColumn("title", label).withColumn("badges", F.array_compact(F.array(*(F.when(c, F.lit(b)) for b, c in badges.items())))).drop("_forked")
    if of_runs is None:
        return own
    own = own.join(of_runs.select("session_id", F.col("badges").alias("_runs")), "session_id", "left")
    return own.withColumn("badges", F.concat("badges", F.coalesce("_runs", F.array().cast("array<string>")))).drop("_runs")


def project_table(cards: DataFrame) -> DataFrame:
    """Sums of the sessions of each project, latest activity first when ordered by ``last_at``."""
    return cards.groupBy("slug").agg(F.count(F.lit(1)).alias("sessions"), *(F.sum(c).alias(c) for c in ("bytes", "events", "turns", "agents", "requests", "tcu")), F.max("ended_at").alias("last_at"))


def day_bands(priced: DataFrame) -> DataFrame:
    """Tokens, money and sessions of each local day (the session's time zone) over billed rows."""
    own = priced.where("channel = 'billed' and at is not null").withColumn("day", day(F.timestamp_millis("at")))
    return own.groupBy("day").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("input") + F.col("output")).alias("tokens"), F.sum("tcu").alias("tcu"), F.countDistinct("session_id").alias("sessions"))


def cost_by_turn(priced: DataFrame, events: DataFrame, agent_turns: DataFrame) -> DataFrame:
    """Cost of each turn: its own main rows by line, and the rows of the agents that belong to it."""
    by_line = transcripts.turn_of_lines(events).select("rel", "line", F.col("turn_idx").alias("_line_turn"))
    by_agent = agent_turns.select("session_id", "agent_id", F.col("turn_idx").alias("_agent_turn"))
    own = priced.join(by_line, ["rel", "line"], "left").join(by_agent, ["session_id", "agent_id"], "left")
    return ledger.cost(own.withColumn("turn_idx", F.coalesce("_line_turn", "_agent_turn")), "session_id", "turn_idx")


