"""Queries over the store of ``runbook``: runs and their files, scopes as the audit sees them, local days, and what lists show."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import days, inventory, ledger, narrowed, projections, storage, transcripts
from tallyloom.plans import runbook
from tallyloom.plans.catalog import query
from tallyloom.plans.log_queries import _case, _id
from tallyloom.sources import listing, logbook, logs

_ROOTS: dict[tuple[str, str], str] = {}


def root(spark: SparkSession, sf_dir: str) -> str:
    """The store of a folder's tables, with its parsed lines beside it, written once a session; written again when the table's files change."""
    path = spark.read.parquet(f"{sf_dir}/conversations.parquet").inputFiles()
    stamp = spark.read.format("binaryFile").load(path).select(F.max("modificationTime"), F.sum("length")).first()
    key = (spark.sparkContext.applicationId, f"{path}{stamp}")
    if key not in _ROOTS:
        own = runbook.store(spark, sf_dir)
        base = f"{storage.folder(spark)}/runbook-tables-{uuid.uuid4().hex}"
        logs.lines(spark, own).write.parquet(f"{base}/lines")
        lines = spark.read.parquet(f"{base}/lines")
        transcripts.rows(transcripts.events(lines)).write.parquet(f"{base}/rows")
        ledger.ledger(lines).write.parquet(f"{base}/ledger")
        _ROOTS[key] = f"{own}\n{base}"
    return _ROOTS[key]


def _store(spark: SparkSession, sf_dir: str) -> str:
    return root(spark, sf_dir).split("\n")[0]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root(spark, sf_dir).split(chr(10))[1]}/{name}")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.events(_table(spark, sf_dir, "lines"))


#: The store in SQL: talks, lines of main files in order (l) with their turn, answers with their money (a), files (f).
_RUNS = f"""WITH k AS (SELECT CAST(conv_id AS BIGINT) AS c, CAST(turn AS BIGINT) AS t, CAST(conv_id + turn AS BIGINT) AS n, role FROM conversations),
talks AS (SELECT c, {_id('s')} AS me, {_id('o')} AS orphan, 'p' || (c % 3) AS slug, 'wf_' || substr(md5('w' || c), 1, 8) || '-' || substr(md5('w' || c), 9, 3) AS run, max(t) AS top FROM k GROUP BY c),
l0 AS (SELECT c, 0 AS ord, 'title' AS what, CAST(NULL AS BIGINT) AS t, CAST(NULL AS BIGINT) AS m FROM talks
UNION ALL SELECT c, t * 4 + 1, CASE role WHEN 'user' THEN 'user' ELSE 'note' END, t, 1 FROM k WHERE role IN ('user', 'system')
UNION ALL SELECT c, t * 4 + 2, 'queue', t, 2 FROM k WHERE role = 'user' AND n % 5 = 2
UNION ALL SELECT c, t * 4 + 1, 'part', t, 1 FROM k WHERE role = 'assistant' AND n % 3 = 0
UNION ALL SELECT c, t * 4 + 2, 'whole', t, 2 FROM k WHERE role = 'assistant'
UNION ALL SELECT c, t * 4 + 3, 'result', t, 3 FROM k WHERE role = 'assistant' AND n % 4 <> 0
UNION ALL SELECT c, top * 4 + 5, 'mention', NULL, NULL FROM talks WHERE c % 4 = 1 UNION ALL SELECT c, top * 4 + 6, 'mention', NULL, NULL FROM talks WHERE c % 8 = 1
UNION ALL SELECT c, top * 4 + 7, 'late', NULL, NULL FROM talks WHERE c % 50 = 7),
l AS (SELECT l0.*, talks.me, slug, CASE WHEN what = 'late' THEN {runbook.START + runbook.WRONG} ELSE {runbook.START} + l0.c % 20 * 86400000 + l0.t * 25200000 + m * 60000 END AS ms,
row_number() OVER (PARTITION BY l0.c ORDER BY ord) AS line, count(*) FILTER (what = 'user') OVER (PARTITION BY l0.c ORDER BY ord) AS idx FROM l0 JOIN talks ON talks.c = l0.c),
turns AS (SELECT c, me, slug, idx, min(ms) AS a, max(ms) AS z FROM l WHERE idx > 0 AND what IN ('user', 'part', 'whole', 'result', 'late') GROUP BY 1, 2, 3, 4),
a AS (SELECT k.c, k.t, n, me, slug, 10 + n % 7 AS input, 5 + n % 5 AS output, (10 + n % 7) * 20000 + (5 + n % 5) * 100000 AS tcu, {runbook.START} + k.c % 20 * 86400000 + k.t * 25200000 + 120000 AS ms FROM k JOIN talks ON talks.c = k.c WHERE role = 'assistant'),
agents AS (SELECT c, me, slug, run, unnest(['r', 'e', 's', 'u']) AS x FROM talks WHERE c % 4 = 1),
f AS (SELECT slug AS held, me AS session, slug AS owner, 'main' AS part, slug || '/' || me || '.jsonl' AS rel FROM talks
UNION ALL SELECT slug, me, slug, 'agent', slug || '/' || me || '/subagents/workflows/' || run || '/agent-' || x || c || '.jsonl' FROM agents
UNION ALL SELECT slug, me, slug, 'journal', slug || '/' || me || '/subagents/workflows/' || run || '/journal.jsonl' FROM talks WHERE c % 4 = 1
UNION ALL SELECT slug, me, slug, 'other', slug || '/' || me || '/workflows/' || run || '.json' FROM talks WHERE c % 8 = 1
UNION ALL SELECT 'x', me, slug, 'agent', 'x/' || me || '/subagents/workflows/' || run || '/agent-r' || c || '.jsonl' FROM talks WHERE c % 12 = 9
UNION ALL SELECT 'x', me, slug, 'agent', 'x/' || me || '/subagents/agent-b' || c || '.jsonl' FROM talks WHERE c % 5 = 2
UNION ALL SELECT slug, orphan, slug, 'agent', slug || '/' || orphan || '/subagents/agent-o' || c || '.jsonl' FROM talks WHERE c % 5 = 3
UNION ALL SELECT slug, NULL, slug, 'other', slug || '/memory/n' || c || '.md' FROM talks WHERE c % 6 IN (2, 3)
UNION ALL SELECT 'm' || c, NULL, 'm' || c, 'other', 'm' || c || '/memory/only.md' FROM talks WHERE c % 10 = 9)"""


def over(sql: str, more: str = "") -> str:
    return f"{_RUNS}{more} {sql}"


def _day(ms: str) -> str:
    """Days since 1970 on the zone's calendar, by whole numbers alone."""
    return f"(({ms} - 3600000 * CASE WHEN {ms} < 1793512800000 THEN 4 ELSE 5 END) // 86400000)"


# Runs


@query(over("""SELECT me AS session_id, run AS run_id, a || c AS agent_id, st AS started, re AS results, CASE WHEN re = 0 THEN 'running' WHEN st = 0 THEN 'result only' WHEN st > 1 THEN 'retried' ELSE 'done' END AS state FROM (
SELECT me, run, c, unnest(['r', 'e', 's', 'q']) AS a, unnest([CASE WHEN c % 3 = 1 THEN 2 ELSE 1 END, CASE WHEN c % 3 = 2 THEN 0 ELSE 1 END, CASE WHEN c % 3 = 0 THEN 2 ELSE 1 END, 1]) AS st, unnest([1, 1, 0, 0]) AS re FROM talks WHERE c % 4 = 1)"""))
def run_journals(spark, sf_dir):
    return transcripts.journal_census(_table(spark, sf_dir, "lines")).withColumns({c: F.col(c).cast("int") for c in ("started", "results")})


@query(over("""SELECT me AS session_id, run AS run_id, a || c AS agent_id, CASE WHEN a = 'r' THEN 'fetch ' ELSE 'check ' END || c AS label, CASE WHEN a = 'r' THEN 'one' ELSE 'two' END AS phase, CASE WHEN a = 'r' THEN 'done' ELSE 'error' END AS state, a = 'e' AS cached
FROM (SELECT *, unnest(['r', 'e']) AS a FROM talks WHERE c % 8 = 1)"""))
def run_progress(spark, sf_dir):
    return inventory.progress(inventory.manifests(spark, _store(spark, sf_dir))).select("session_id", "run_id", "agent_id", "label", "phase", "state", "cached")


@query(over(f"SELECT me AS session_id, run AS run_id, false AS unreadable, 'completed' AS status, 'check' AS name, {runbook.START} + c % 20 * 86400000 AS started_at, CAST(60000 AS BIGINT) AS duration_ms, CAST(2 AS BIGINT) AS agent_count, 4 AS entries FROM talks WHERE c % 8 = 1"))
def run_records(spark, sf_dir):
    own = inventory.manifests(spark, _store(spark, sf_dir))
    return own.select("session_id", "run_id", "unreadable", "status", "name", "started_at", "duration_ms", "agent_count", F.size("progress").alias("entries"))


@query(over("""SELECT me AS session_id, run AS run_id, x || c AS agent_id, CASE WHEN c % 8 = 1 AND x = 'r' THEN 'done' WHEN c % 8 = 1 AND x = 'e' THEN 'error' WHEN x IN ('s', 'q') THEN CASE WHEN c % 8 = 1 THEN 'superseded' ELSE 'running' END END AS state,
x = 'q' AS lost, c % 8 = 1 AND x IN ('r', 'e') AS in_manifest, x <> 'u' AS in_journal, x <> 'q' AS on_disk FROM (SELECT *, unnest(['r', 'e', 's', 'q', 'u']) AS x FROM talks WHERE c % 4 = 1)"""))
def run_agent_states(spark, sf_dir):
    """The run's record, its journal and the transcripts on disk side by side."""
    lines = _table(spark, sf_dir, "lines")
    own = inventory.run_agents(inventory.manifests(spark, _store(spark, sf_dir)), transcripts.journal_census(lines), transcripts.events(lines))
    return own.select("session_id", "run_id", "agent_id", "state", "lost", "in_manifest", "in_journal", "on_disk")


@query(over("""SELECT me AS session_id, x || c AS agent_id, rel, 'agent-' || x || c || '.jsonl' AS file, matched, run AS run_id, CASE WHEN matched IS NULL THEN NULL WHEN x = 'r' AND c % 8 = 1 THEN 'fetch ' || c WHEN x = 'e' AND c % 8 = 1 THEN 'check ' || c ELSE 'agent ' || x || c END AS label,
CASE WHEN matched IS NOT NULL THEN CAST(1 AS BIGINT) END AS requests, CASE WHEN matched IS NOT NULL THEN CAST(2200000 AS BIGINT) END AS tcu FROM (
SELECT c, me, run, x, slug || '/' || me || '/subagents/workflows/' || run || '/agent-' || x || c || '.jsonl' AS rel, CASE WHEN x <> 'u' THEN 'rel' END AS matched FROM agents
UNION ALL SELECT c, me, run, 'r', 'x/' || me || '/subagents/workflows/' || run || '/agent-r' || c || '.jsonl', 'id' FROM talks WHERE c % 12 = 9)"""))
def run_files(spark, sf_dir):
    """Files of run folders with their agents by path, then by id; agents u came after the session was read, those in project x are copies elsewhere."""
    own = _events(spark, sf_dir).where("slug <> 'x' and coalesce(agent_id, '') not like 'u%'")
    at = _store(spark, sf_dir)
    known = transcripts.agents(own, _table(spark, sf_dir, "rows"), transcripts.sidecars(spark, at), inventory.progress(inventory.manifests(spark, at))).select("session_id", "agent_id", "rel", "label")
    cost = ledger.cost(_table(spark, sf_dir, "ledger").where("agent_id is not null"), "session_id", "agent_id")
    return inventory.run_files(logs.files(spark, at), known, cost).select("session_id", "agent_id", "rel", "file", "matched", "run_id", "label", "requests", "tcu")


@query(over("SELECT me AS session_id, run AS run_id, min(line) AS first_line, CAST(count(*) AS INTEGER) AS n FROM (SELECT l.c, l.me, line, run FROM l JOIN talks ON talks.c = l.c WHERE what = 'mention') GROUP BY 1, 2"))
def run_call_lines(spark, sf_dir):
    return inventory.run_calls(_events(spark, sf_dir)).select("session_id", "run_id", "first_line", F.size("lines").alias("n"))


@query(over("SELECT me AS session_id, concat_ws(',', CASE WHEN c % 8 = 1 AND c % 3 <> 2 THEN 'retried' END, CASE WHEN c % 8 = 5 THEN 'running' END, CASE WHEN c % 8 = 1 THEN 'cached' END) AS badges FROM talks WHERE c % 4 = 1"))
def run_badges(spark, sf_dir):
    own = inventory.run_badges(inventory.manifests(spark, _store(spark, sf_dir)), transcripts.journal_census(_table(spark, sf_dir, "lines")))
    return own.select("session_id", F.array_join("badges", ",").alias("badges"))


# The audit's scopes


@query(over("""SELECT slug, CAST(sum(fi) AS BIGINT) AS files, CAST(sum(ag) AS BIGINT) AS agents, CAST(count(DISTINCT un) AS BIGINT) AS unioned, CAST(sum(ro) AS BIGINT) AS routed_out, CAST(count(DISTINCT o) AS BIGINT) AS orphaned FROM (
SELECT owner AS slug, 1 AS fi, CASE WHEN part = 'agent' THEN 1 ELSE 0 END AS ag, CASE WHEN held <> owner THEN held || session END AS un, 0 AS ro, CASE WHEN session IN (SELECT orphan FROM talks) THEN session END AS o FROM f
UNION ALL SELECT held, 0, 0, NULL, 1, NULL FROM f WHERE held <> owner) GROUP BY 1"""))
def audit_scope_census(spark, sf_dir):
    """What each project's audit reads, takes in, sends away and finds without a main file."""
    return narrowed.census(narrowed.routed(logs.files(spark, _store(spark, sf_dir)))).drop("bytes")


@query(over("SELECT slug, count(*) AS a, count(*) AS b, true AS passed FROM (SELECT owner AS slug FROM f WHERE session IS NOT NULL) GROUP BY 1"))
def audit_scope_both_ways(spark, sf_dir):
    """Files of sessions by project: sessions as the store groups them against the audit's own routing, which share no step."""
    listing = logs.files(spark, _store(spark, sf_dir))
    first = logs.sessions(listing).groupBy("slug").agg(F.sum("n_files").alias("a"))
    second = narrowed.routed(listing).where("session is not null").groupBy(F.col("owner").alias("slug")).agg(F.count(F.lit(1)).alias("b"))
    both = first.join(second, "slug", "full").select("slug", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.withColumn("passed", F.col("a") == F.col("b"))


@query(over("""SELECT unnest(['session-fragment', 'routed-out', 'session-fragment']) AS code, unnest(['project:p1', 'project:x', 'store']) AS scope, unnest([(SELECT count(DISTINCT session) FROM f WHERE owner = 'p1' AND held <> 'p1'), (SELECT count(*) FROM f WHERE held = 'x'), (SELECT count(DISTINCT held || session) FROM f WHERE held <> owner)]) AS n"""))
def audit_disclosures(spark, sf_dir):
    """What narrowing to two projects discloses, and the sum of the folders that any project takes in."""
    own = narrowed.routed(logs.files(spark, _store(spark, sf_dir)))
    one = lambda s: narrowed.disclosures(own, f"project:{s}").select("code", F.lit(f"project:{s}").alias("scope"), "n")
    every = narrowed.census(own).agg(F.sum("unioned").alias("n")).select(F.lit("session-fragment").alias("code"), F.lit("store").alias("scope"), "n")
    return one("p1").unionByName(one("x")).unionByName(every)


@query(over("""SELECT pair, count(*) AS a, count(*) AS b, true AS passed FROM (SELECT CASE n % 4 WHEN 0 THEN 'ABSENT|ABSENT' WHEN 1 THEN 'null|standard' WHEN 2 THEN 'standard|standard' ELSE 'standard|ABSENT' END AS pair FROM a
UNION ALL SELECT 'ABSENT|ABSENT' FROM agents WHERE x <> 'u') GROUP BY 1"""))
def audit_pairs(spark, sf_dir):
    """Recorded speed and service tier by the ledger and by JSON paths over the files' text."""
    text = listing.plain_lines(spark, _store(spark, sf_dir)).select("rel", F.col("place").alias("line"), F.col("value").alias("text"))
    return narrowed.pair_check(ledger.pair_census(_table(spark, sf_dir, "ledger")), narrowed.pair_recount(text))


# Days of a zone


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.turns(_events(spark, sf_dir)).where("turn_idx > 0").withColumn("slug", F.split_part("rel", F.lit("/"), F.lit(1)))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "ledger").where("channel = 'billed' and agent_id is null")
    return own.groupBy(days.local_day(F.col("at"), runbook.ZONE).alias("local_date")).agg(F.count(F.lit(1)).alias("requests"), F.sum("tcu").alias("tcu"), F.array_sort(F.collect_set("session_id")).alias("session_ids"))


_BANDS = f""", bands AS (SELECT {_day('ms')} AS d, count(*) AS requests, CAST(sum(tcu) AS BIGINT) AS tcu FROM a GROUP BY 1)"""


@query(over(f"""SELECT CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS local_date, requests, tcu, (SELECT count(*) FROM turns WHERE {_day('a')} <= bands.d AND {_day('z')} >= bands.d) AS turns,
d * 86400000 + 3600000 * CASE WHEN d <= 20758 THEN 4 ELSE 5 END AS start_ms FROM bands""", _BANDS))
def turn_bands(spark, sf_dir):
    """Turns by the local days they touch, over a change of the clock, in days that have answers."""
    own = days.turn_bands(_bands(spark, sf_dir), _turns(spark, sf_dir), "at", "end_at", runbook.ZONE)
    return days.newest_first(own).select(F.col("local_date").cast("string").alias("local_date"), "requests", "tcu", "turns", "start_ms")


@query(over(f"SELECT 'day-span-capped' AS code, 'warning' AS severity, 'store' AS scope, count(*) AS n FROM turns WHERE z - a > 86400000 * {days.MOST_DAYS}.0 HAVING count(*) > 0"))
def turn_day_problems(spark, sf_dir):
    return days.overlong(_turns(spark, sf_dir), "at", "end_at", runbook.ZONE)


@query(over(f"""SELECT count(*) FILTER (x <= 20758 AND y >= 20753) AS turns, count(*) FILTER (x <= 20758 AND y >= 20753 AND NOT (x >= 20753 AND y <= 20758)) AS boundary_turns
FROM (SELECT {_day('a')} AS x, CASE WHEN z > a THEN {_day('(z - 1)')} ELSE {_day('a')} END AS y FROM turns WHERE slug IN ('p0', 'p1'))"""))
def turns_of_range(spark, sf_dir):
    """Turns of two projects within six days up to a change of the clock, and those that reach over its edges."""
    return days.turns_in_range(_turns(spark, sf_dir), ["slug", "session_id", "turn_idx"], "at", "end_at", runbook.ZONE, "2026-10-27", "2026-11-01", ["p0", "p1"])


@query(over(f"""SELECT strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m') AS month, count(*) AS days, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tcu) AS BIGINT) AS tcu,
(SELECT count(DISTINCT me) FROM a WHERE strftime(DATE '1970-01-01' + CAST({_day('ms')} AS INTEGER), '%Y-%m') = strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m')) AS sessions, NULL AS by_count, 'counts by day can''t be summed' AS reason FROM bands GROUP BY 1, 5""", _BANDS))
def band_months(spark, sf_dir):
    """Months of local days: with the ids of each day sessions can be counted, with counts alone they are null with a reason."""
    own = _bands(spark, sf_dir)
    ids = days.band_months(own, ["requests", "tcu"], "session_ids").drop("sessions_reason")
    counts = days.band_months(own, ["requests"]).select("month", F.col("sessions").alias("by_count"), F.col("sessions_reason").alias("reason"))
    return ids.join(counts, "month").select("month", "days", "requests", "tcu", "sessions", "by_count", "reason")


# What lists and pages show


@query(over(f"""SELECT me AS session_id, kind, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(ms) AS BIGINT) AS at FROM (SELECT me, line, ms, CASE WHEN what = 'queue' THEN 'queue-operation' WHEN what = 'note' THEN 'system:note' WHEN what = 'result' AND (c + t) % 8 = 1 THEN 'denial'
WHEN what = 'whole' AND {_case('(c + t)', logbook.TOOLS)} IN ('Edit', 'Write', 'NotebookEdit') THEN 'edit' END AS kind FROM l) WHERE kind IS NOT NULL GROUP BY 1, 2"""))
def session_markers(spark, sf_dir):
    own = projections.markers(_table(spark, sf_dir, "rows"), _events(spark, sf_dir))
    return own.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"), F.sum("at").alias("at"))


@query(over(f"""SELECT path, 'main' AS tier, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'write') AS writes, count(*) FILTER (op = 'edit') AS edits, count(*) FILTER (op = 'search') AS searches, count(*) FILTER (op = 'side') AS sidecar FROM (
SELECT CASE tool WHEN 'Grep' THEN '/w/g' || (n % 3) ELSE '/w/f' || (n % 4) END AS path, CASE tool WHEN 'Read' THEN 'read' WHEN 'Write' THEN 'write' WHEN 'Edit' THEN 'edit' ELSE 'search' END AS op FROM (SELECT n, {_case('n', logbook.TOOLS)} AS tool FROM a) WHERE tool IN ('Read', 'Write', 'Edit', 'Grep')
UNION ALL SELECT '/w/f' || (n % 3), 'side' FROM a WHERE n % 8 = 2) GROUP BY 1"""))
def file_sources(spark, sf_dir):
    """Paths that tool calls name together with those that results record."""
    return projections.file_sources(_table(spark, sf_dir, "rows"), _events(spark, sf_dir))


@query(over("SELECT session, CASE WHEN part = 'main' THEN session || '.jsonl' WHEN held = owner THEN substr(rel, length(held) + length(session) + 3) ELSE 'frag/' || rel END AS path, rel FROM f WHERE session IS NOT NULL"))
def session_paths(spark, sf_dir):
    """Every file of a session as the session spells it, and back to the file through the guard."""
    listing = logs.files(spark, _store(spark, sf_dir))
    owners = logs.sessions(listing).select("session_id", F.col("slug").alias("_owner"))
    own = listing.join(owners, "session_id").select(F.col("_owner").alias("slug"), "session_id", projections.session_path(F.col("_owner"), F.col("session_id"), F.col("rel")).alias("path"))
    return projections.store_paths(own, listing).select(F.col("session_id").alias("session"), "path", "rel")


@query(over("SELECT kind, count(*) AS asked, count(*) FILTER (kind = 'mem') AS found FROM (SELECT unnest(['up', 'root', 'back', 'unknown', 'dot']) AS kind FROM f UNION ALL SELECT 'mem' FROM f WHERE session IS NULL) GROUP BY 1"))
def refused_paths(spark, sf_dir):
    """Paths that leave the store or aren't in it are refused, for every file of it; notes are found by their short form."""
    listing = logs.files(spark, _store(spark, sf_dir))
    r = F.col("rel")
    forms = {"up": F.concat(F.lit("frag/x/../"), r), "root": F.concat(F.lit("/"), r), "back": F.concat(F.lit("frag\\"), r), "unknown": F.concat(F.lit("frag/"), r, F.lit("x")), "dot": F.concat(F.lit("frag/./"), r)}
    none = F.lit(None).cast("string")
    own = listing.select(F.lit("p0").alias("slug"), none.alias("session_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), p.alias("path")) for k, p in forms.items()))).alias("q")).select("slug", "session_id", "q.*")
    notes = listing.where("kind = 'memory'").select("slug", none.alias("session_id"), F.lit("mem").alias("kind"), F.concat(F.lit("mem/"), F.element_at(F.split("rel", "/"), -1)).alias("path"))
    return projections.store_paths(own.unionByName(notes), listing).groupBy("kind").agg(F.count(F.lit(1)).alias("asked"), F.count("rel").alias("found"))


@query(over("""SELECT slug || '/memory/n' || c || '.md' AS rel, slug, CASE c % 4 WHEN 0 THEN me WHEN 2 THEN (SELECT {0} FROM (SELECT o.c + 1 AS c)) END AS origin,
CASE c % 4 WHEN 0 THEN 'resolved' WHEN 2 THEN CASE WHEN c + 1 IN (SELECT c FROM talks) THEN 'other project' ELSE 'dangling' END ELSE 'not recorded' END AS link FROM talks o WHERE c % 6 IN (2, 3)
UNION ALL SELECT 'm' || c || '/memory/only.md', 'm' || c, NULL, 'not recorded' FROM talks WHERE c % 10 = 9""".replace("{0}", _id("s"))))
def memory_links(spark, sf_dir):
    at = _store(spark, sf_dir)
    return inventory.memory(spark, at, logs.sessions(logs.files(spark, at))).select("rel", "slug", "origin", "link")


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir)
    seen = own.where("tier = 'main'").groupBy("slug", "session_id").agg(F.count(F.lit(1)).alias("events"), F.max("at").alias("last_at"))
    cards = seen.join(ledger.cost(_table(spark, sf_dir, "ledger"), "session_id").select("session_id", "tcu"), "session_id", "left")
    return projections.project_rows(cards, logs.files(spark, _store(spark, sf_dir)).where("kind = 'memory'"))


_PROJECTS = """, sess AS (SELECT slug, me, count(*) AS events, max(ms) AS last_at, (SELECT coalesce(sum(tcu), 0) FROM a WHERE a.me = l.me) + CASE WHEN c % 4 = 1 THEN 6600000 ELSE 0 END AS tcu FROM l GROUP BY slug, me, c)"""


@query(over("SELECT count(DISTINCT slug) AS projects, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, CAST(sum(tcu) AS BIGINT) AS tcu, (SELECT count(*) FROM talks WHERE c % 10 = 9) AS memory_only FROM sess", _PROJECTS))
def project_footer(spark, sf_dir):
    """Sums of the projects with transcripts; those that hold notes alone are counted beside them."""
    return projections.footer(_projects(spark, sf_dir))


@query(over("""SELECT slug, row_number() OVER (ORDER BY coalesce(last_at, 0) DESC, slug) AS place, last_at, sessions FROM (SELECT slug, max(last_at) AS last_at, count(*) AS sessions FROM sess GROUP BY 1 UNION ALL SELECT 'm' || c, NULL, NULL FROM talks WHERE c % 10 = 9)""", _PROJECTS))
def project_order(spark, sf_dir):
    """Projects by latest activity, then by name, with their place."""
    from pyspark.sql import Window

    own = projections.projects_in_order(_projects(spark, sf_dir))
    place = F.row_number().over(Window.orderBy(F.coalesce("last_at", F.lit(0)).desc(), "slug")).cast("long")  # a row a project
    return own.select("slug", place.alias("place"), "last_at", "sessions")


@query(over("""SELECT me AS session_id, count(*) + CASE WHEN c % 4 = 1 THEN 3 ELSE 0 END AS requests, CAST(sum(input) + CASE WHEN c % 4 = 1 THEN 30 ELSE 0 END AS BIGINT) AS input, CAST(sum(tcu) + CASE WHEN c % 4 = 1 THEN 6600000 ELSE 0 END AS BIGINT) AS tcu, CAST(0 AS BIGINT) AS never_finalized, CAST(0 AS BIGINT) AS inherited_requests, CAST(0 AS BIGINT) AS unpriced_requests FROM a GROUP BY me, c"""))
def lite_costs(spark, sf_dir):
    own = projections.lite(ledger.cost(_table(spark, sf_dir, "ledger"), "session_id"), "session_id")
    return own.join(_events(spark, sf_dir).where("tier = 'main' and type = 'assistant'").select("session_id").distinct(), "session_id", "left_semi").select("session_id", "requests", "input", "tcu", "never_finalized", "inherited_requests", "unpriced_requests")


@query(over("SELECT 'fable-5' AS key, CAST(20000000000 AS BIGINT) AS input, CAST(100000000000 AS BIGINT) AS output, CAST(25000000000 AS BIGINT) AS write_5m, CAST(40000000000 AS BIGINT) AS write_1h, CAST(2000000000 AS BIGINT) AS read, count(*) + (SELECT count(*) FROM agents WHERE x <> 'u') AS requests FROM a"))
def rates_in_use(spark, sf_dir):
    """Displayed rates of the models that the store has answers of, with their number."""
    used = ledger.by_model(_table(spark, sf_dir, "ledger")).select(ledger.model_key(F.col("model")).alias("key"), "requests")
    return projections.rate_rows(ledger.rates(spark)).join(used, "key").drop("valid_from", "valid_to")


@query(over("""SELECT me AS session_id, CASE WHEN c % 5 = 0 THEN CASE WHEN c % 2 = 0 THEN 'scope' ELSE 'page' END ELSE 'rows' END AS basis, count(*) AS counted, CAST(sum(tcu) AS BIGINT) AS page_tcu, CAST(CASE WHEN c % 5 <> 0 THEN sum(tcu + CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END) WHEN c % 2 = 0 THEN sum(tcu) END AS BIGINT) AS reference_tcu,
CASE WHEN c % 5 <> 0 THEN c % 7 <> 0 WHEN c % 2 = 0 THEN true END AS ok FROM a GROUP BY me, c"""))
def page_reprice(spark, sf_dir):
    """Pages priced again: some rows come without their money, some pages aren't whole, and some rows carry a unit too much."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("c")).distinct().select("c", logbook.session_id(F.col("c"), "s").alias("session_id"))
    page = _table(spark, sf_dir, "ledger").where("agent_id is null").join(talks, "session_id")
    page = page.withColumn("tcu", F.when(F.col("c") % 5 != 0, F.col("tcu") + (F.col("c") % 7 == 0).cast("int")))
    cost = ledger.cost(_table(spark, sf_dir, "ledger").where("agent_id is null"), "session_id").join(talks, "session_id")
    scope = cost.select("session_id", F.when(F.col("c") % 2 == 0, F.col("requests")).otherwise(F.col("requests") + 1).alias("total_rows"), F.col("tcu").alias("total_tcu"))
    return projections.reprice(page.drop("c"), ledger.rates(spark), ["session_id"], scope).select("session_id", "basis", "counted", "page_tcu", "reference_tcu", "ok")


@query(over("SELECT 'first' AS place, count(*) AS lines, count(*) FILTER (c % 7 = 3) AS bom, CAST(0 AS BIGINT) AS torn FROM talks"))
def log_byte_order_marks(spark, sf_dir):
    """Titles after a byte order mark are read like others, and the mark is noted."""
    own = _table(spark, sf_dir, "lines").where("kind = 'main' and line = 1")
    return own.agg(F.lit("first").alias("place"), F.count(F.lit(1)).alias("lines"), F.count_if("bom").alias("bom"), F.count_if("torn").alias("torn"))
