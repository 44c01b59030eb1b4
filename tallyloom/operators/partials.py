"""The ledger as partial aggregates: what is kept of each session between runs, and the cost that is made of it when it is read.

Rates, channels and the choice of a canonical copy depend on the whole store, so none of them is kept. Rows that no other session can
contest are summed by BUCKET; rows of main files, which may turn out to be copies, stay single with what the choice needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ledger

#: What rows are told apart by that are summed: everything that a price or a count depends on.
BUCKET = ("model", "speed", "service_tier", "utc_date", "local_date", "finalized", "synthetic", "ttl")
SINGLE = ("msg_id", "line", "iter_index", "rel", "recorded_session", "first_at", "sidechain")
COUNTS = ("requests", *ledger.TOKENS, "web_search", "web_fetch", "thinking_tokens", "thinking_recorded", "ttl_assumed", "over_200k", "violations")


def partials(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Sums of ``ledger.billed_rows`` by slug, session_id, BUCKET and, for rows of main files, SINGLE. ``starts``: ``ledger.first_times``."""
    main = F.col("kind") == "main"
    at = F.timestamp_millis("at")
    own = rows.join(starts, "rel", "left").withColumns({"utc_date": F.to_date(F.to_utc_timestamp(at, F.current_timezone())), "local_date": F.date_format(at, "yyyy-MM-dd"), "ttl": F.when(F.col("ttl_recorded"), "split").otherwise("flat")})
    single = {c: F.when(main, F.col(c)) for c in SINGLE}
    side = F.col("input") + F.col("cache_read") + F.col("cache5m") + F.col("cache1h") + F.col("cache_flat")
    own = own.withColumns({**single, "_main": main, "thinking_recorded": F.col("thinking_tokens").isNotNull().cast("int"), "ttl_assumed": (F.col("cache_flat") > 0).cast("int"), "over_200k": (side > ledger.LONG_CONTEXT).cast("int"), "requests": F.lit(1)})
    return own.groupBy("slug", "session_id", F.col("_main").alias("main"), *BUCKET, *SINGLE).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS))


def canonical(kept: DataFrame) -> DataFrame:
    """The session that is billed for each response of several main files, from the single rows of all sessions."""
    own = kept.where("main").select("msg_id", "rel", "session_id", "recorded_session", "first_at", F.lit("main").alias("kind"))
    return ledger.canonical_sessions(own.drop("first_at"), own.groupBy("rel").agg(F.min("first_at").alias("first_at")))


def cost(kept: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Cost by scope, with the columns of ``ledger.cost`` and equal to it over the same rows."""
    own = kept.withColumns({"kind": F.when(F.col("main"), "main").otherwise("agent"), "sidechain": F.coalesce("sidechain", F.lit(False)), "at": F.unix_millis(F.to_timestamp_ltz(F.concat(F.col("utc_date").cast("string"), F.lit(" 00:00:00+00:00"))))})
    own = ledger.priced(ledger.channels(own, canonical(kept)), table)
    billed = F.col("channel") == "billed"
    good = billed & ~F.col("unpriced")
    total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c) if isinstance(c, str) else c)), F.lit(0)).cast("long")
    count = lambda on: total("requests", on)
    covered: Column = ledger.model_key(F.col("model")).isin(*ledger.LONG_CONTEXT_MODELS)
    flat = F.col("ttl_assumed")
    return own.groupBy(*keys).agg(
        count(billed).alias("requests"),
        *(total(t, good).alias(t) for t in ledger.TOKENS),
        *(total(p, good).alias(p) for p in ledger.PARTS),
        total("tcu", good).alias("tcu"),
        count(billed & F.col("unpriced")).alias("unpriced"),
        total("input", billed & F.col("unpriced")).alias("unpriced_input"),
        total("output", billed & F.col("unpriced")).alias("unpriced_output"),
        *(count(F.col("channel") == c).alias(c) for c in ("inherited", "embedded", "synthetic")),
        count(billed & ~F.col("finalized")).alias("never_finalized"),
        total("output", billed & ~F.col("finalized")).alias("never_finalized_output"),
        total("thinking_tokens", billed).alias("thinking_tokens"),
        total("thinking_recorded", billed).alias("thinking_recorded"),
        total(F.col("requests") - F.col("thinking_recorded"), billed).alias("thinking_not_recorded"),
        total(flat, billed).alias("ttl_assumed"),
        total("ttl_delta", good).alias("ttl_delta"),
        total("over_200k", billed & ~F.coalesce(covered, F.lit(False))).alias("premium_unknown"),
        total("web_search", billed).alias("web_search"),
        total("web_fetch", billed).alias("web_fetch"),
        total("violations", F.lit(True)).alias("violations"),
    )
