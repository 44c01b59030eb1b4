"""The second computation: money and counts again from the raw text, by another plan, and what must hold between the two.

Shares no step with the ledger: lines come from texts that Spark splits (only the listing of files is the same), JSON goes into typed structs, kept lines by a
window, the first place of a response by ranking, prices by a join on exploded rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.ledger import WEB_SEARCH
from tallyloom.operators.tables import reconcile
from tallyloom.sources.listing import plain_lines

_NESTED = "input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint, cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>"
_EVENT = f"struct<type: string, uuid: string, timestamp: string, sessionId: string, isSidechain: boolean, message: struct<id: string, model: string, usage: struct<{_NESTED}, iterations: array<struct<model: string, {_NESTED}>>, speed: string, service_tier: string, server_tool_use: struct<web_search_requests: bigint>>>>"


def recount(spark: SparkSession, root: str, rates: DataFrame) -> DataFrame:
    """(session_id, requests, tcu, unpriced) of every session of a store, from its text."""
    raw = plain_lines(spark, root).select("value", F.concat(F.lit("/"), "rel").alias("path"), F.col("place").alias("seq"))
    own = raw.where(F.col("value").contains('"assistant"') & F.col("value").contains('"usage"') & F.rtrim("value").endswith("}"))
    own = own.select("path", "value", F.from_json("value", _EVENT, {"mode": "PERMISSIVE"}).alias("e"), "seq")
    own = own.where("e.type = 'assistant' and e.message.usage is not null")
    session = F.lower(F.regexp_extract("path", r"^.*/([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?:\.jsonl|/subagents/.*)$", 1))
    main = ~F.col("path").contains("/subagents/")
    own = own.withColumns({"session_id": session, "main": main, "msg": F.coalesce("e.message.id", "e.uuid"), "at": F.try_to_timestamp("e.timestamp")})
    own = own.withColumn("_k", F.row_number().over(Window.partitionBy("path", "msg").orderBy(F.col("seq").desc()))).where("_k = 1")
    whole = F.col("value").rlike(r'"iterations"\s*:\s*null')
    own = own.where(~whole)
    # The earliest main file is the one that is billed.
    begun = raw.select("path", F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("t"), "seq").where("t is not null").groupBy("path").agg(F.min_by("t", "seq").alias("begun"))
    own = own.join(begun, "path", "left")
    own_name = F.when(F.coalesce("e.sessionId", "session_id") == F.col("session_id"), 1).otherwise(0)
    claims = F.sum(own_name).over(Window.partitionBy("main", "msg"))
    own = own.withColumns({"_own": own_name, "_claims": claims})
    rank = F.row_number().over(Window.partitionBy("main", "msg").orderBy(F.when(F.col("_claims") == 1, -F.col("_own")).otherwise(0), F.col("begun").asc_nulls_last(), "path"))
    own = own.withColumn("_r", F.when(F.col("main"), rank).otherwise(1)).where("_r = 1")
    u = F.col("e.message.usage")
    many = F.coalesce(F.size(u["iterations"]), F.lit(0)) > 0
    single = F.array(F.struct(F.col("e.message.model").alias("model"), *(u[c].alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cache_creation"))))
    items = F.when(many, u["iterations"]).otherwise(single)
    own = own.select("session_id", "at", "e.message.model", u["speed"].alias("speed"), u["service_tier"].alias("tier"), u["server_tool_use"]["web_search_requests"].alias("web"), F.size(items).alias("n"), F.posexplode(items).alias("i", "x"))
    model = F.regexp_replace(F.coalesce("x.model", "model"), r"^claude-|\[1m\]$|-[0-9]{8}(?=\[1m\]$|$)", "")
    model = F.regexp_replace(model, "^3(?:-([0-9]))?-(haiku|sonnet|opus)$", "$2-3-$1")
    model = F.regexp_replace(model, "-3-$", "-3")
    std = (F.coalesce("speed", F.lit("standard")) == "standard") & (F.coalesce("tier", F.lit("standard")) == "standard")
    key = F.when(std, model).when(F.coalesce("tier", F.lit("standard")) == "standard", F.concat(model, F.lit("@"), "speed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    five, hour = F.col("x.cache_creation.ephemeral_5m_input_tokens"), F.col("x.cache_creation.ephemeral_1h_input_tokens")
    split = five.isNotNull() & hour.isNotNull()
    tokens = own.select(
        "session_id", key.alias("k"), F.to_date("at").alias("d"), zero(F.col("x.input_tokens")).alias("a"), zero(F.col("x.output_tokens")).alias("b"), zero(F.col("x.cache_read_input_tokens")).alias("c"),
        F.when(split, five).otherwise(zero(F.col("x.cache_creation_input_tokens"))).alias("f"), F.when(split, hour).otherwise(0).alias("h"), F.when(F.col("i") == F.col("n") - 1, zero(F.col("web"))).otherwise(0).alias("w"),
    )
    r = rates.select(F.col("key").alias("k"), F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("v0"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")).alias("v1"), F.col("input_u").alias("ru"), F.col("output_u").alias("ro"), (F.col("valid_from").isNull() & F.col("valid_to").isNull()).alias("always"))
    both = tokens.join(r, (tokens["k"] == r["k"]) & (r["always"] | tokens["d"].between(r["v0"], r["v1"])), "left")
    # Everything in quarter units, so that no rate is divided before it is summed.
    quarter = 20 * (F.col("a") * F.col("ru") + F.col("b") * F.col("ro")) + 25 * F.col("f") * F.col("ru") + 40 * F.col("h") * F.col("ru") + 2 * F.col("c") * F.col("ru")
    tcu = F.call_function("div", quarter, F.lit(20)) + F.when(F.col("ru").isNotNull(), F.col("w") * WEB_SEARCH)
    return both.groupBy("session_id").agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(tcu), F.lit(0)).cast("long").alias("tcu"), F.count_if(F.col("ru").isNull()).alias("unpriced"))


def compare(ledger_cost: DataFrame, recounted: DataFrame) -> DataFrame:
    """Session by session: both computations and whether they agree."""
    return reconcile(ledger_cost.select("session_id", "requests", "tcu", "unpriced"), recounted, ["session_id"], ["requests", "tcu", "unpriced"])


def invariants(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(name, value, passed): what must hold of a store; passed is null where the value is only reported."""
    torn = lines.agg(F.count_if("torn").alias("v"))
    one = rows.agg(
        F.sum("violations").alias("usage_integers"),
        F.count_if((F.col("channel") == "billed") & ~F.col("finalized")).alias("never_finalized"),
        F.count_if("premium_unknown").alias("premium_unknown"),
        F.count_if((F.col("channel") == "billed") & F.col("unpriced")).alias("unpriced"),
        F.coalesce(F.max(F.abs("tcu")), F.lit(0)).alias("largest_row"),
        F.count_if("cache_break").alias("cache_identity"),  # 5 minutes + 1 hour = the flat count, where all are recorded
    )
    must = {"usage_integers": 0, "premium_unknown": 0, "cache_identity": 0, "largest_row": 2**53}
    out = torn.select(F.lit("torn_lines").alias("name"), F.col("v").cast("long").alias("value"), (F.col("v") == 0).alias("passed"))
    for name in one.columns:
        passed = F.lit(None).cast("boolean") if name not in must else (F.coalesce(F.col(name), F.lit(0)) <= must[name])
        out = out.unionByName(one.select(F.lit(name).alias("name"), F.col(name).cast("long").alias("value"), passed.alias("passed")))
    return out


def coverage(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, n): billed rows of a model that has rates but none on the row's day; there should be none."""
    from tallyloom.functions.columns import model_key

    known = rates.select(F.split_part("key", F.lit("@"), F.lit(1)).alias("_k")).distinct()
    own = rows.where("channel = 'billed' and unpriced").withColumn("_k", model_key(F.col("model")))
    return own.join(known, "_k", "left_semi").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def split_sums(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """(msg_id, rel) of responses split by iteration whose rows don't add up to the recorded web requests, or don't count 0, 1, 2, ..."""
    web = F.coalesce(F.try_variant_get(F.parse_json("usage"), "$.server_tool_use.web_search_requests", "bigint"), F.lit(0))
    parts = rows.where("iter_index is not null").groupBy("rel", "msg_id").agg(F.sum("web_search").alias("web"), F.count(F.lit(1)).alias("n"), F.max("iter_index").alias("top"), F.countDistinct("iter_index").alias("d"))
    own = parts.join(kept.select("rel", "msg_id", web.alias("recorded")), ["rel", "msg_id"])
    return own.where((F.col("web") != F.col("recorded")) | (F.col("n") != F.col("top") + 1) | (F.col("d") != F.col("n"))).select("msg_id", "rel")


def both_ways(listing: DataFrame, lines: DataFrame, events: DataFrame, kept: DataFrame, rows: DataFrame, canonical: DataFrame, agents: DataFrame, recounted: DataFrame) -> DataFrame:
    """(name, a, b, passed): counts that two ways to them must agree on, and counts that must be 0."""
    one = lambda df, c: df.agg(c.cast("long").alias("v"))
    n = F.count(F.lit(1))
    billed = rows.where("channel = 'billed'")
    compared = {
        "files": (one(listing.where("kind in ('main', 'agent', 'journal') and size > 0"), n), one(lines.select("rel").distinct(), n)),
        "agents": (one(listing.where("kind = 'agent'"), n), one(events.where("tier = 'agent'").select("session_id", "agent_id").distinct(), n)),
        "agents_of_turns": (one(agents, n), one(agents.where("turn_idx is not null"), n)),
        "journals": (one(listing.where("kind = 'journal'"), n), one(lines.where("kind = 'journal'").select("rel").distinct(), n)),
        "requests": (one(billed, n), one(recounted, F.coalesce(F.sum("requests"), F.lit(0)))),
        "tcu": (one(billed, F.coalesce(F.sum("tcu"), F.lit(0))), one(recounted, F.coalesce(F.sum("tcu"), F.lit(0)))),
        "unpriced": (one(billed.where("unpriced"), n), one(recounted, F.coalesce(F.sum("unpriced"), F.lit(0)))),
        "kept_lines": (one(kept, n), one(rows.select("rel", "msg_id").distinct(), n)),
        "ties": (one(canonical.where("clause = 'iii'"), n), None),
        "split_sums": (one(split_sums(kept, rows), n), None),
    }
    out = None
    for name, (a, b) in compared.items():
        pair = a.select(F.lit(name).alias("name"), F.col("v").alias("a"))
        pair = pair.crossJoin(b.select(F.col("v").alias("b"))) if b is not None else pair.withColumn("b", F.lit(0).cast("long"))  # one row each
        out = pair if out is None else out.unionByName(pair)
    return out.withColumn("passed", F.col("a") == F.col("b"))


def evidence(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(msg_id, rel, line, output, again): the billed row with the most output (the first of equals) and its output read again from the text."""
    best = rows.where("channel = 'billed'").agg(F.max_by(F.struct("msg_id", "rel", "line", "output"), F.struct("output", F.struct(-F.col("line")))).alias("b")).select("b.*")
    text = lines.select("rel", "line", F.get_json_object("text", "$.message.usage.output_tokens").cast("long").alias("again"))
    return best.join(text, ["rel", "line"]).select("msg_id", "output", "again")
