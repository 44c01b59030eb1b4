"""The audit's own view of a scope: which files it has, by path alone, and what it must disclose.

Shares nothing with ``scopes`` and ``logs``: paths are split here again, the owner of a session is found here again. A session's owner is
the least project with its main file. Folders of the session in other projects are fragments and go to the owner; where no
project has the main file they stay where they are and are orphans.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEX = "[0-9a-fA-F]"
_ID = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"


def routed(listing: DataFrame) -> DataFrame:
    """(rel, size, held, session, owner, part, agent) of every file: the project that holds it and the one that it belongs to.

    ``part`` is main, agent, journal or other. Owners are a row a session, joined by the session; no path is compared with another.
    """
    steps = F.split("rel", "/")
    held, second = steps[0], F.try_element_at(steps, F.lit(2))
    main = (F.size(steps) == 2) & second.rlike(f"^{_ID}\\.jsonl$")
    session = F.when(main, F.lower(F.substring(second, 1, 36))).when((F.size(steps) > 2) & second.rlike(f"^{_ID}$"), F.lower(second))
    name = F.element_at(steps, -1)
    agent = F.nullif(F.regexp_extract(name, r"^agent-([A-Za-z0-9]+)\.jsonl$", 1), F.lit(""))
    part = F.when(main, "main").when(agent.isNotNull() & (F.try_element_at(steps, F.lit(3)) == "subagents"), "agent").when((name == "journal.jsonl") & (F.try_element_at(steps, F.lit(4)) == "workflows"), "journal").otherwise("other")
    own = listing.select("rel", "size", held.alias("held"), session.alias("session"), F.coalesce(part, F.lit("other")).alias("part"), agent.alias("agent"))
    owners = own.where("part = 'main'").groupBy("session").agg(F.min("held").alias("_owner"))
    return own.join(owners, "session", "left").withColumn("orphan", F.col("session").isNotNull() & F.col("_owner").isNull()).withColumn("owner", F.coalesce("_owner", "held")).drop("_owner")


def census(files: DataFrame) -> DataFrame:
    """One row per project: files and bytes that its audit reads, agents, fragment folders taken in, files routed out, orphaned folders.

    ``files`` is what ``routed`` gives. Every project that holds or owns a file has a row.
    """
    one = lambda slug, taken: files.select(F.col(slug).alias("slug"), taken.alias("_in"), "size", "session", "held", "owner", "part", "orphan")
    away = F.col("held") != F.col("owner")
    both = one("owner", F.lit(True)).unionByName(one("held", F.lit(False)).where(away))
    root = F.concat_ws("/", "held", "session")
    taken = F.col("_in")
    return both.groupBy("slug").agg(
        F.count_if(taken).alias("files"), F.coalesce(F.sum(F.when(taken, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(taken & (F.col("part") == "agent")).alias("agents"),
        F.countDistinct(F.when(taken & away, root)).alias("unioned"), F.count_if(~taken).alias("routed_out"), F.countDistinct(F.when(taken & F.col("orphan"), root)).alias("orphaned"),
    )


def narrow(files: DataFrame, scope: str | None) -> DataFrame:
    """The rows of ``routed`` that the audit of a scope reads; a turn's is its session's, since turns aren't known from paths."""
    kind, _, rest = (scope or "store").partition(":")
    parts = [unquote(p) for p in rest.split("/")] if rest else []
    want = {"store": 0, "project": 1, "session": 2, "turn": 3, "agent": 3}
    if kind not in want or len(parts) != want[kind]:
        raise ValueError(f"no scope: {scope}")
    if kind == "store":
        return files
    if kind == "project":
        return files.where(F.col("owner") == parts[0])
    own = files.where(F.col("session") == parts[1].lower())
    # The main file counts where the scope names its project; folders of the session count everywhere.
    own = own.where((F.col("part") != "main") | (F.col("held") == parts[0]))
    if kind == "agent":
        own = own.where((F.col("part") != "agent") | F.lit(parts[2] != "main") & (F.col("agent") == parts[2]))
    return own


def disclosures(files: DataFrame, scope: str | None) -> DataFrame:
    """(code, scope, n) of what narrowing did: folders taken in from other projects, files routed out, a turn read as its session."""
    kind, _, rest = (scope or "store").partition(":")
    spark = files.sparkSession
    none = spark.createDataFrame([], "code string, scope string, n bigint")
    if kind == "store":
        return none
    slug = unquote(rest.split("/")[0])
    own = narrow(files, scope)
    level = "project" if kind == "project" else "session"
    foreign = own.where((F.col("held") != slug) & (F.col("part") != "main")).agg(F.countDistinct(F.concat_ws("/", "held", "session")).alias("n"))
    out = foreign.select(F.lit("session-fragment").alias("code"), F.lit(level).alias("scope"), "n")
    if kind == "project":
        gone = files.where((F.col("held") == slug) & (F.col("owner") != slug)).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(gone.select(F.lit("routed-out").alias("code"), F.lit(level).alias("scope"), "n"))
    if kind == "turn":
        out = out.unionByName(spark.createDataFrame([("audit-scope-note", level, 1)], none.schema))
    return out.where("n > 0")


def pair_recount(text: DataFrame) -> DataFrame:
    """(pair, n) of recorded speed and service tier over the last line of each response of a file, from the raw lines (rel, line, text); ``line``: any value by which a file's lines are in order.

    The second computation beside ``ledger.pair_census``: JSON paths on the text, the last line by rank.
    """
    get = lambda p: F.get_json_object("text", p)
    own = text.where(F.col("text").contains('"usage"') & F.rtrim("text").endswith("}")).where(get("$.type") == "assistant")
    usage = F.from_json(get("$.message.usage"), "map<string,string>")
    own = own.select("rel", "line", F.coalesce(get("$.message.id"), get("$.uuid"), F.to_json(F.struct("line"))).alias("_id"), usage.alias("u")).where("u is not null")
    last = F.row_number().over(Window.partitionBy("rel", "_id").orderBy(F.col("line").desc()))
    said = lambda k: F.when(~F.map_contains_key("u", F.lit(k)), "ABSENT").otherwise(F.coalesce(F.col("u")[k], F.lit("null")))
    kept = own.withColumn("_k", last).where("_k = 1")
    return kept.groupBy(F.concat(said("speed"), F.lit("|"), said("service_tier")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def pair_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """(pair, a, b, passed): both censuses side by side, pairs of one alone included."""
    a, b = first.select("pair", F.col("n").alias("a")), second.select("pair", F.col("n").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "pair", "full").select("pair", zero("a"), zero("b")).withColumn("passed", F.col("a") == F.col("b"))
