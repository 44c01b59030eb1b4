"""What lists and pages show of rows that other operators make: path spellings, markers, light aggregates, rates, footers, page checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ledger
from tallyloom.operators.transcripts import _get

#: Tools that change a file. Fixed values.
EDITS = ("Edit", "Write", "NotebookEdit")


def session_path(slug: Column, session_id: Column, rel: Column) -> Column:
    """A store path as its session spells it: without the session's folder; ``frag/`` before a path of another project."""
    folder = F.concat_ws("/", slug, session_id)
    main = F.concat(folder, F.lit(".jsonl"))
    inside = F.substring(rel, F.length(folder) + 2, F.length(rel))
    out = F.when(rel == main, F.concat(session_id, F.lit(".jsonl"))).when(F.startswith(rel, F.concat(folder, F.lit("/"))), inside)
    return out.when(~F.contains(rel, F.lit("/")), rel).otherwise(F.concat(F.lit("frag/"), rel))


def store_paths(asked: DataFrame, listing: DataFrame) -> DataFrame:
    """``asked`` (slug, session_id or null, path) with ``rel``: the listed file that the path names, null where it is refused.

    Refused: empty paths, ones with a backslash, a colon or a leading slash, with an empty, ``.`` or ``..`` step, and whatever isn't listed. ``frag/`` names
    a path from the store's root, ``mem/`` a memory note of the project, another path one in the session's folder, the main file itself,
    or without a session one in the project.
    """
    p, slug, session = F.col("path"), F.col("slug"), F.col("session_id")
    clean = lambda x: (x != "") & ~x.rlike(r"[\\:\x00]|^/") & ~F.exists(F.split(x, "/"), lambda s: s.isin("", ".", ".."))
    ok = clean(p) & F.coalesce(clean(slug), F.lit(True)) & F.coalesce(clean(session), F.lit(True))
    here = F.when(session.isNotNull(), F.concat_ws("/", slug, session, p)).otherwise(F.concat(slug, F.lit("/"), p))
    first = F.when(p.startswith("frag/"), F.substring(p, 6, 1 << 30)).when(p.startswith("mem/"), F.concat(slug, F.lit("/memory/"), F.substring(p, 5, 1 << 30))).otherwise(here)
    second = F.when((p == F.concat(session, F.lit(".jsonl"))), F.concat(slug, F.lit("/"), p))
    own = asked.withColumns({"_one": F.when(ok & clean(first), first), "_two": F.when(ok & clean(second), second)})
    known = listing.select(F.col("rel").alias("_rel")).distinct()
    own = own.join(known.withColumnRenamed("_rel", "_a"), F.col("_one") == F.col("_a"), "left").join(known.withColumnRenamed("_rel", "_b"), F.col("_two") == F.col("_b"), "left")
    return own.withColumn("rel", F.coalesce("_a", "_b")).drop("_one", "_two", "_a", "_b")


def image_source(bi: Column) -> Column:
    """Where a picture was recorded, from the address of its block."""
    return F.when((bi == "r") | bi.startswith("r."), "toolUseResult").when(F.contains(bi, F.lit(".")), "tool_result").otherwise("content")


def markers(rows: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, rel, line, at, kind): queue operations, system events, denied results and edits of the main files, a row a block."""
    denied = events.where("tier = 'main'").select("rel", "line", _get(F.col("event"), "$.toolDenialKind").alias("denial")).where("denial <> ''")
    own = rows.where("tier = 'main'").join(denied, ["rel", "line"], "left")
    k = F.col("kind")
    kind = F.when((k == "queue-operation") | k.startswith("system:"), k).when((k == "tool_result") & F.col("denial").isNotNull(), "denial").when((k == "tool_use") & F.col("tool").isin(*EDITS), "edit")
    return own.withColumn("kind", kind).where("kind is not null").select("session_id", "rel", "line", "at", "kind")


def file_sources(rows: DataFrame, events: DataFrame) -> DataFrame:
    """(path, tier, reads, writes, edits, searches, sidecar): paths of tool calls together with those that results of main files record."""
    from tallyloom.operators.transcripts import PATH_TOOLS

    op = F.create_map(*(F.lit(x) for tool, (_, does) in PATH_TOOLS.items() for x in (tool, does)))
    calls = rows.where("kind = 'tool_use' and path <> ''").select("path", "tier", op[F.col("tool")].alias("op")).where("op is not null")
    beside = events.where("tier = 'main' and type = 'user'").select(_get(F.col("event"), "$.toolUseResult.filePath").alias("path"), "tier", F.lit("sidecar").alias("op")).where("path <> ''")
    names = {"read": "reads", "write": "writes", "edit": "edits", "search": "searches", "sidecar": "sidecar"}
    return calls.unionByName(beside).groupBy("path", "tier").agg(*(F.count_if(F.col("op") == o).alias(c) for o, c in names.items()))


def lite(cost: DataFrame, *keys: str) -> DataFrame:
    """A cost aggregate as lists carry it: totals and counts, no parts of the money; what was left out only as numbers of requests."""
    kept = ["requests", *ledger.TOKENS, "tcu", "never_finalized", "never_finalized_output", "synthetic", "ttl_assumed", "ttl_delta", "premium_unknown", "web_search", "web_fetch"]
    return cost.select(*keys, *dict.fromkeys(kept), F.col("inherited").alias("inherited_requests"), F.col("unpriced").alias("unpriced_requests"))


def rate_rows(table: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to, and five rates as money units for a million tokens) of each interval of the rate table."""
    r, o = F.col("input_u"), F.col("output_u")
    million = lambda x: (x * 1_000_000).cast("long")
    five, read = F.call_function("div", r * 5, F.lit(4)), F.call_function("div", r, F.lit(10))
    return table.select("key", "valid_from", "valid_to", million(r).alias("input"), million(o).alias("output"), million(five).alias("write_5m"), million(r * 2).alias("write_1h"), million(read).alias("read"))


def project_rows(cards: DataFrame, memories: DataFrame) -> DataFrame:
    """(slug, memory_only, sessions, events, tcu, last_at, notes): projects with transcripts, and those that hold notes alone, whose figures are null."""
    with_cards = cards.groupBy("slug").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.sum("tcu").alias("tcu"), F.max("last_at").alias("last_at"))
    notes = memories.groupBy("slug").agg(F.count(F.lit(1)).alias("notes"))
    out = with_cards.join(notes, "slug", "full")
    return out.select("slug", F.col("sessions").isNull().alias("memory_only"), "sessions", "events", "tcu", "last_at", F.coalesce("notes", F.lit(0)).alias("notes"))


def footer(projects: DataFrame) -> DataFrame:
    """One row: sums over the projects that have transcripts, and how many were left out because they hold notes alone."""
    own = F.when(~F.col("memory_only"), F.lit(1))
    total = lambda c: F.coalesce(F.sum(F.when(~F.col("memory_only"), F.col(c))), F.lit(0)).cast("long")
    return projects.agg(F.count(own).alias("projects"), *(total(c).alias(c) for c in ("sessions", "events", "tcu")), F.count_if("memory_only").alias("memory_only"))


def projects_in_order(projects: DataFrame) -> DataFrame:
    """Latest activity first, unknown last, then by name."""
    return projects.orderBy(F.coalesce("last_at", F.lit(0)).desc(), "slug")


def sessions_in_order(cards: DataFrame) -> DataFrame:
    """Latest start first, unknown last, then by id."""
    return cards.orderBy(F.coalesce("started_at", F.lit(0)).desc(), "session_id")


def reprice(page: DataFrame, table: DataFrame, keys: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Each page's money again from its rows' counters, against what the rows carry or, where a row carries none, against its scope.

    ``page``: ledger rows; ``scope``: (keys, total_rows, total_tcu). Synthetic, inherited and embedded rows are left out and counted.
    basis ``rows``: every counted row carries its money. ``scope``: some don't, but the page has all rows of its scope. Else ``page``:
    nothing to hold it against, so ok is null.
    """
    again = ledger.priced(page.withColumnRenamed("tcu", "_carried").drop("unpriced", "premium_unknown", "ttl_delta", *ledger.PARTS), table)
    counted = F.col("channel") == "billed"
    total = lambda c: F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).cast("long")
    left = {c: F.count_if(F.col("channel") == c).alias(f"excluded_{c}") for c in ("inherited", "synthetic", "embedded")}
    out = again.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(counted).alias("counted"), F.count_if(counted & F.col("_carried").isNull()).alias("_bare"),
        total("tcu").alias("page_tcu"), total("_carried").alias("_rows_tcu"), F.count_if(counted & F.col("unpriced")).alias("unpriced"), *left.values(),
    )
    if scope is None:
        out = out.withColumns({"total_rows": F.lit(None).cast("long"), "total_tcu": F.lit(None).cast("long")})
    else:
        out = out.join(scope.select(*keys, "total_rows", "total_tcu"), keys, "left")
    rows = (F.col("_bare") == 0) & (F.col("counted") > 0)
    whole = (F.col("_rows") >= F.col("total_rows")) & F.col("total_tcu").isNotNull()
    basis = F.when(rows, "rows").when(F.coalesce(whole, F.lit(False)), "scope").otherwise("page")
    out = out.withColumn("basis", basis).withColumn("reference_tcu", F.when(F.col("basis") == "rows", F.col("_rows_tcu")).when(F.col("basis") == "scope", F.col("total_tcu")))
    return out.withColumns({"delta": F.col("page_tcu") - F.col("reference_tcu"), "ok": F.col("page_tcu") == F.col("reference_tcu")}).drop("_rows", "_bare", "_rows_tcu", "total_rows", "total_tcu")
