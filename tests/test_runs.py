import pytest
from pyspark.sql import functions as F

from tallyloom.operators import days, inventory, narrowed, projections

A, B, C = ("11111111-aaaa-4aaa-8aaa-00000000000%d" % k for k in (1, 2, 3))
FILES = [
    (f"p/{A}.jsonl", 10), (f"p/{A}/subagents/agent-a1.jsonl", 5), (f"p/{A}/subagents/workflows/wf_12345678-abc/journal.jsonl", 1),
    (f"q/{A}/subagents/agent-a2.jsonl", 7), (f"q/{B}.jsonl", 20), (f"p/{B}/subagents/agent-b1.jsonl", 3), (f"q/{C}/subagents/agent-c1.jsonl", 2), ("p/memory/n.md", 4), ("stray.txt", 1),
]


@pytest.fixture(scope="module")
def routed(spark):
    return narrowed.routed(spark.createDataFrame(FILES, "rel string, size long")).cache()


def names(df):
    return sorted(r["rel"] for r in df.collect())


def test_scopes_by_path_alone(routed):
    of = lambda s: names(narrowed.narrow(routed, s))
    a = sorted(r for r, _ in FILES if A in r)
    assert of(None) == of("store") == sorted(r for r, _ in FILES)
    assert of("project:p") == sorted([*a, "p/memory/n.md"])
    assert of("project:q") == sorted([f"q/{B}.jsonl", f"p/{B}/subagents/agent-b1.jsonl", f"q/{C}/subagents/agent-c1.jsonl"])
    assert of(f"session:p/{A.upper()}") == of(f"turn:p/{A}/3") == a
    assert of(f"session:q/{A}") == [r for r in a if r != f"p/{A}.jsonl"]
    assert of(f"agent:p/{A}/a2") == [r for r in a if "agent-a1" not in r]
    assert of(f"agent:p/{A}/main") == [r for r in a if "agent-" not in r]
    for bad in ("nothing:p", "project:", "project:p/q", "session:p"):
        with pytest.raises(ValueError):
            narrowed.narrow(routed, bad)


def test_what_narrowing_discloses(routed):
    said = lambda s: sorted(map(tuple, narrowed.disclosures(routed, s).collect()))
    assert said("store") == []
    assert said("project:p") == [("routed-out", "project", 1), ("session-fragment", "project", 1)]
    assert said(f"session:p/{A}") == [("session-fragment", "session", 1)]
    assert said(f"turn:p/{A}/1") == [("audit-scope-note", "session", 1), ("session-fragment", "session", 1)]
    rows = {r["slug"]: r for r in narrowed.census(routed).collect()}
    assert (rows["p"]["files"], rows["p"]["bytes"], rows["p"]["agents"], rows["p"]["unioned"], rows["p"]["routed_out"], rows["p"]["orphaned"]) == (5, 27, 2, 1, 1, 0)
    assert (rows["q"]["files"], rows["q"]["unioned"], rows["q"]["routed_out"], rows["q"]["orphaned"]) == (3, 1, 1, 1)


def test_pairs_that_differ_fail(spark):
    a = spark.createDataFrame([("x|y", 2), ("only|a", 1)], "pair string, n long")
    b = spark.createDataFrame([("x|y", 3), ("only|b", 1)], "pair string, n long")
    assert sorted(map(tuple, narrowed.pair_check(a, b).collect())) == [("only|a", 1, 0, False), ("only|b", 0, 1, False), ("x|y", 2, 3, False)]
    line = '{"type":"assistant","message":{"id":"%s","usage":{%s}}}'
    text = spark.createDataFrame([("f", 1, line % ("m", '"speed":"fast"')), ("f", 2, line % ("m", '"speed":null,"service_tier":"s"')), ("g", 1, line % ("m", "")), ("g", 2, '{"type":"assistant","message":{"usage":{"cut"'), ("g", 3, '{"type":"user","message":{"usage":{}}}')], "rel string, line int, text string")
    assert sorted(map(tuple, narrowed.pair_recount(text).collect())) == [("ABSENT|ABSENT", 1), ("null|s", 1)]


NY, HOUR = "America/New_York", 3_600_000
MIDNIGHT = 1_793_505_600_000  # 2026-11-01 in New York, a day of 25 hours


@pytest.mark.parametrize("own", ["UTC", "Asia/Tokyo"])
def test_days_of_a_zone_whatever_the_session_has(spark, own):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", own)
    try:
        at = spark.createDataFrame([(MIDNIGHT - 1,), (MIDNIGHT,), (MIDNIGHT + 25 * HOUR - 1,), (MIDNIGHT + 25 * HOUR,), (None,)], "ms long")
        got = at.select(days.local_day(F.col("ms"), NY).cast("string").alias("d"), days.day_start(days.local_day(F.col("ms"), NY), NY).alias("s")).collect()
        assert [r["d"] for r in got] == ["2026-10-31", "2026-11-01", "2026-11-01", "2026-11-02", None]
        assert [r["s"] for r in got] == [MIDNIGHT - 24 * HOUR, MIDNIGHT, MIDNIGHT, MIDNIGHT + 25 * HOUR, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_turns_count_only_in_days_that_have_a_band(spark):
    far = MIDNIGHT + (days.MOST_DAYS + 5) * 24 * HOUR
    turns = spark.createDataFrame([("p", 1, MIDNIGHT - HOUR, MIDNIGHT + HOUR), ("p", 2, MIDNIGHT, None), ("q", 1, MIDNIGHT + HOUR, MIDNIGHT), ("q", 2, None, MIDNIGHT), ("q", 3, MIDNIGHT + 30 * HOUR, far)], "slug string, i int, a long, z long")
    bands = spark.createDataFrame([("2026-10-31", 1), ("2026-11-01", 2), ("2026-12-25", 3), (None, 4), ("2026-10-01", 5)], "d string, n int").select(F.to_date("d").alias("local_date"), "n")
    got = days.newest_first(days.turn_bands(bands, turns, "a", "z", NY)).collect()
    assert [(r["n"], r["turns"]) for r in got] == [(3, 1), (2, 3), (1, 1), (5, 0), (4, 0)] and got[-1]["start_ms"] is None
    assert [tuple(r) for r in days.overlong(turns, "a", "z", NY).collect()] == [("day-span-capped", "warning", "store", 1)]
    assert days.overlong(turns.where("i < 3"), "a", "z", NY).count() == 0
    assert days.turn_bands(bands, turns.where("false"), "a", "z", NY).where("turns > 0").count() == 0
    assert days.turn_bands(bands.where("false"), turns, "a", "z", NY).count() == 0


def test_turns_of_a_range(spark):
    turns = spark.createDataFrame([("p", 1, MIDNIGHT - HOUR, MIDNIGHT + HOUR), ("p", 1, MIDNIGHT - HOUR, MIDNIGHT + HOUR), ("p", 2, MIDNIGHT - HOUR, MIDNIGHT), ("q", 1, MIDNIGHT, None), ("q", 2, None, None)], "slug string, i int, a long, z long")
    of = lambda *r: tuple(days.turns_in_range(turns, ["slug", "i"], "a", "z", NY, *r).first())
    assert of() == (3, 0) and of("2026-11-01") == (2, 1) and of(None, "2026-10-31") == (2, 1) and of("2026-11-01", None, ["q"]) == (1, 0) and of("2026-12-01") == (0, 0)


def test_files_of_runs_meet_agents_by_path_then_by_id(spark):
    run = "wf_12345678-abc"
    at = lambda p, a: f"{p}/{A}/subagents/workflows/{run}/agent-{a}.jsonl"
    listing = spark.createDataFrame([("p", A, "a1", run, at("p", "a1"), "agent"), ("x", A, "a1", run, at("x", "a1"), "agent"), ("p", A, "a2", run, at("p", "a2"), "agent"), ("p", A, "a3", None, f"p/{A}/subagents/agent-a3.jsonl", "agent"), ("p", B, "a1", run, at("p", "a1").replace(A, B), "agent")], "slug string, session_id string, agent_id string, run_id string, rel string, kind string")
    known = spark.createDataFrame([(A, "a1", at("p", "a1"), "m1"), (A, "a1", None, "m0"), (A, None, None, "m9")], "session_id string, agent_id string, rel string, model string")
    cost = spark.createDataFrame([(A, "a2", 3, 30)], "session_id string, agent_id string, requests long, tcu long")
    got = {(r["session_id"], r["rel"]): (r["matched"], r["model"], r["requests"], r["tcu"]) for r in inventory.run_files(listing, known, cost).collect()}
    assert got == {(A, at("p", "a1")): ("rel", "m1", 0, 0), (A, at("x", "a1")): ("id", "m1", 0, 0), (A, at("p", "a2")): (None, None, 3, 30), (B, at("p", "a1").replace(A, B)): (None, None, None, None)}


def test_sources_of_pictures_and_orders(spark):
    own = spark.createDataFrame([("0",), ("2.1",), ("r",), ("r.0",)], "bi string")
    assert [r[0] for r in own.select(projections.image_source(F.col("bi"))).collect()] == ["content", "tool_result", "toolUseResult", "toolUseResult"]
    cards = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 5)], "session_id string, started_at long")
    assert [r["session_id"] for r in projections.sessions_in_order(cards).collect()] == ["d", "a", "b", "c"]
    empty = projections.footer(projections.project_rows(spark.createDataFrame([], "slug string, events long, tcu long, last_at long"), spark.createDataFrame([("m",)], "slug string")))
    assert tuple(empty.first()) == (0, 0, 0, 0, 1)


def test_month_without_sessions_and_day_unknown(spark):
    bands = spark.createDataFrame([("2026-11-01", ["a", "b"], 1), ("2026-11-02", ["b"], 2), (None, ["c"], 4), ("2026-12-01", None, 8)], "d string, ids array<string>, n long").select(F.to_date("d").alias("local_date"), "ids", "n")
    got = {r["month"]: (r["days"], r["n"], r["sessions"]) for r in days.band_months(bands, ["n"], "ids").collect()}
    assert got == {"2026-11": (2, 3, 2), None: (1, 4, 1), "2026-12": (1, 8, 0)}
