"""Queries over a store that grows: the incremental ledger, provisional results, versions, problems, and a search that is taken up again.

The store is that of ``log_queries``; which sessions arrive, change or go when follows from conv_id, so that SQL over the table says what must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import ledger, partials, search, storage
from tallyloom.plans.catalog import query
from tallyloom.plans.log_queries import _COST, _COST_COLUMNS, lines, over
from tallyloom.sources import logbook, logs
from tallyloom.streaming import incremental, versions


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, c, fork) of the store's sessions."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("c")).distinct()
    mine = talks.select(logbook.session_id(F.col("c"), "s").alias("session_id"), "c", F.lit(False).alias("fork"))
    return mine.unionByName(talks.where("c % 5 = 0").select(logbook.session_id(F.col("c"), "f").alias("session_id"), "c", F.lit(True).alias("fork")))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{storage.folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(over(f"SELECT slug, session_id, {_COST} FROM b GROUP BY 1, 2"))
def ledger_partials(spark, sf_dir):
    """Cost from partial aggregates, rates and canonical copies applied when they are read."""
    own = lines(spark, sf_dir)
    kept = partials.partials(ledger.billed_rows(ledger.responses(own)), ledger.first_times(own))
    return partials.cost(kept, ledger.rates(spark), "slug", "session_id").where("requests > 0").select("slug", "session_id", *_COST_COLUMNS)


#: After the changes below: sessions of c % 10 = 0 are gone, those of c % 4 = 1 lack their answers after turn 3; a fork is billed for what it alone has.
_AFTER = """, x AS (SELECT * FROM b WHERE c % 10 <> 0 AND NOT (agent_id IS NULL AND c % 4 = 1 AND t > 3)
UNION ALL SELECT b.* REPLACE ((SELECT fork FROM talks WHERE talks.c = b.c) AS session_id, 'q' AS slug) FROM b WHERE c % 5 = 0 AND agent_id IS NULL AND (c % 10 = 0 OR c % 4 = 1 AND t > 3))"""


@query(over(f"SELECT slug, session_id, {_COST} FROM x GROUP BY 1, 2", _AFTER))
def stream_ledger_index(spark, sf_dir):
    """The ledger after three batches: all sessions, some of them again with less in them, and some that are gone."""
    known, own = _sessions(spark, sf_dir), lines(spark, sf_dir)
    turn = F.try_to_number(F.regexp_extract(F.try_variant_get("event", "$.message.id", "string"), r"^m[0-9]+-([0-9]+)$", 1), F.lit("9" * 9)).cast("int")
    changed = own.join(known.where("not fork and c % 4 = 1"), "session_id", "left_semi").where(F.coalesce(turn, F.lit(0)) <= 3)
    gone = own.join(known.where("not fork and c % 10 = 0"), "session_id", "left_semi").select("slug", "session_id").distinct()
    parts = [incremental.arriving_rows(own), incremental.arriving_rows(changed), incremental.arriving_rows(own.where(F.lit(False)), gone)]
    folder = _folder(spark, "ledger-index")
    incremental.in_turn(spark, parts, f"{folder}/in", lambda stream: incremental.ledger_index(stream, f"{folder}/table", f"{folder}/state"))
    return incremental.costs(spark, f"{folder}/table", "slug", "session_id").where("requests > 0").select("slug", "session_id", *_COST_COLUMNS)


@query(over("""SELECT z.batch, s.session_id, coalesce(CAST(sum(n) FILTER (bills) AS BIGINT), 0) + coalesce(max(extra), 0) AS requests, coalesce(CAST(sum(u) FILTER (bills) AS BIGINT), 0) AS unpriced, CAST(coalesce(sum(tcu) FILTER (bills), 0) + coalesce(max(extra), 0) * 2200000 AS BIGINT) AS tcu,
coalesce(CAST(sum(n) FILTER (NOT bills) AS BIGINT), 0) AS inherited, coalesce(bool_or(twice AND m > 0), false) AND z.batch < 2 AS pending, z.batch = 2 AS complete, max(z.known) AS known, max(z."of") AS "of"
FROM z JOIN s ON s.batch <= z.batch LEFT JOIN (SELECT b.c, count(*) AS n, count(*) FILTER (unpriced) AS u, sum(tcu) AS tcu FROM b WHERE agent_id IS NULL GROUP BY 1) v ON v.c = s.c LEFT JOIN (SELECT c, count(*) AS m FROM a GROUP BY 1) w ON w.c = s.c
LEFT JOIN LATERAL (SELECT NOT s.fork OR NOT EXISTS (SELECT 1 FROM s o WHERE o.c = s.c AND NOT o.fork AND o.batch <= z.batch) AS bills, (SELECT count(*) FROM s o WHERE o.c = s.c AND o.batch <= z.batch) > 1 AS twice, CASE WHEN NOT s.fork AND s.c % 3 = 1 AND EXISTS (SELECT 1 FROM a WHERE a.c = s.c) THEN 1 ELSE 0 END AS extra) q ON true GROUP BY 1, 2""",
""", s AS (SELECT c, me AS session_id, false AS fork, CASE WHEN c % 2 = 0 THEN 0 ELSE 2 END AS batch FROM talks UNION ALL SELECT c, fork, true, CASE WHEN c % 10 = 5 THEN 0 ELSE 1 END FROM talks WHERE c % 5 = 0),
z AS (SELECT batch, (SELECT count(*) FROM s WHERE s.batch <= y.batch) AS known, (SELECT count(*) FROM s) AS "of" FROM (SELECT unnest([0, 1, 2]) AS batch) y)"""))
def stream_provisional(spark, sf_dir):
    """What is billed after each of three batches: forks before what they copy, forks after it, and the rest."""
    known = _sessions(spark, sf_dir).withColumn("batch", F.expr("case when not fork then if(c % 2 = 0, 0, 2) when c % 10 = 5 then 0 else 1 end"))
    folder = _folder(spark, "provisional")
    rows = incremental.arriving_rows(lines(spark, sf_dir))
    held = incremental.holdings(rows, ledger.rates(spark)).join(known.select("session_id", "batch"), "session_id")
    held.write.partitionBy("batch").parquet(f"{folder}/held")
    parts = [spark.read.parquet(f"{folder}/held/batch={k}") for k in range(3)]
    incremental.in_turn(spark, parts, f"{folder}/in", lambda stream: incremental.provisional(stream, f"{folder}/table", f"{folder}/state"))
    return incremental.after_each(spark, f"{folder}/table", known.select("batch", "session_id"), known.count())


@query(over("""SELECT * FROM (SELECT 'version 0' AS what, 'added' AS change, count(*) AS n FROM s UNION ALL SELECT 'version 1', 'changed', count(*) FROM s WHERE NOT fork AND c % 4 = 1 AND c % 10 <> 0 UNION ALL SELECT 'version 1', 'removed', count(*) FROM s WHERE NOT fork AND c % 10 = 0
UNION ALL SELECT 'since 0', 'changed', count(*) FROM s WHERE NOT fork AND c % 4 = 1 AND c % 10 <> 0 UNION ALL SELECT 'since 0', 'removed', count(*) FROM s WHERE NOT fork AND c % 10 = 0 UNION ALL SELECT 'since another boot', 'added', count(*) FROM s WHERE fork OR c % 10 <> 0
UNION ALL SELECT 'stale', 'changed', count(*) FROM s WHERE NOT fork AND c % 4 = 1 AND c % 10 <> 0 UNION ALL SELECT 'stale', 'added', count(*) FROM s WHERE NOT fork AND c % 10 = 0) WHERE n > 0""",
", s AS (SELECT c, me AS session_id, false AS fork FROM talks UNION ALL SELECT c, fork, true FROM talks WHERE c % 5 = 0)"))
def store_versions(spark, sf_dir):
    """Three commits of the store's sessions, the last without news; what cursors are answered; and what a listing shows as stale, told once."""
    folder = _folder(spark, "versions")
    known = _sessions(spark, sf_dir)
    first = logs.sessions(logs.files(spark, logbook.store(spark, sf_dir))).join(known, "session_id").select("session_id", "slug", "fingerprint", "c", "fork")
    then = first.where("fork or c % 10 <> 0").withColumn("fingerprint", F.when(F.expr("not fork and c % 4 = 1"), F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")))
    a, new = versions.commit(spark, folder, first)
    b, changes = versions.commit(spark, folder, then)
    same, nothing = versions.commit(spark, folder, then)
    now, unchanged = versions.since(spark, folder, b)
    if same != b or nothing is not None or now != b or unchanged is not None:
        raise AssertionError("a version without news")
    told = [("version 0", new), ("version 1", changes), ("since 0", versions.since(spark, folder, a)[1]), ("since another boot", versions.since(spark, folder, ("000000-0", 1))[1]), ("stale", versions.stale(spark, folder, first)), ("stale again", versions.stale(spark, folder, first))]
    out = None
    for what, df in told:
        own = df.select(F.lit(what).alias("what"), "change")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("what", "change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT role AS code, seq, message FROM (SELECT role, conv_id * 1000 + turn AS seq, left(text, 20) AS message, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) AS k FROM conversations) WHERE k <= 25")
def stream_problem_log(spark, sf_dir):
    """A log that keeps the last 25 entries of each code over three batches, each by a query that starts anew."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = own.select(F.col("role").alias("code"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.substring("text", 1, 20).alias("message"), (F.col("conv_id") % 3).alias("_p"))
    folder = _folder(spark, "problems")
    incremental.in_turn(spark, [rows.where(F.col("_p") == k).drop("_p") for k in (1, 0, 2)], f"{folder}/in", lambda stream: incremental.problem_log(stream, f"{folder}/log", f"{folder}/state", 25))
    return incremental.last_problems(spark, f"{folder}/log")


@query(over("""SELECT session_id, slug, line, page FROM (SELECT *, 1 AS page FROM p1 UNION ALL SELECT * FROM (SELECT g.*, 2 AS page FROM g, cur WHERE CASE WHEN g.session_id = cur.session_id THEN (g.rest, g.line) > (cur.rest, cur.line) WHEN g.m2 > cur.m1 OR g.m2 = cur.m1 AND g.session_id < cur.session_id THEN g.m2 > (SELECT max(c * 37 % 101 * 1000) FROM talks) ELSE true END ORDER BY g.m2 DESC, g.session_id, g.rest, g.line LIMIT 30))""",
""", g AS (SELECT session_id, slug, line, file = 'agent' AS rest, c * 37 % 101 * 1000 AS m1, c * 37 % 101 * 1000 + CASE WHEN c % 3 = 0 THEN 1000000 ELSE 0 END AS m2 FROM l WHERE contains(lower(text), 'onhe')),
p1 AS (SELECT * FROM g ORDER BY m1 DESC, session_id, rest, line LIMIT 15), cur AS (SELECT * FROM p1 ORDER BY m1, session_id DESC, rest DESC, line DESC LIMIT 1)"""))
def find_resume_changed(spark, sf_dir):
    """A page of hits and, after a third of the sessions have changed, the next one: those are searched again, nothing is left out."""
    known = _sessions(spark, sf_dir).select("session_id", "c")
    own = logs.files(spark, logbook.store(spark, sf_dir)).drop("mtime").join(known, "session_id").where("kind in ('main', 'agent')")
    listed = lambda more: own.withColumn("mtime", F.col("c") * 37 % 101 * 1000 + F.when(F.col("c") % 3 == 0, more).otherwise(0))
    hits = search.substring(lines(spark, sf_dir), "text", "Onhe").select("session_id", "slug", "rel", "line", "kind")
    first = storage.cut(search.scan(hits, listed(0), None, 15))
    last = first.collect()[-1]["cursor"]  # a page of 15
    pages = first.withColumn("page", F.lit(1)).unionByName(search.scan(hits, listed(1_000_000), last, 30).withColumn("page", F.lit(2)))
    return pages.select("session_id", "slug", "line", "page")
