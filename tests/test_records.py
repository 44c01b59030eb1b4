import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ledger, records, scopes, sessions, tables, transcripts
from tallyloom.sources import logs

from store import A, assistant, usage, user


def stored(spark, folder, events, name=A):
    (folder / "p").mkdir(exist_ok=True)
    (folder / "p" / f"{name}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    return logs.lines(spark, str(folder))


def test_windows_stay_within_lines_and_bytes(spark):
    own = spark.createDataFrame([("a", i, 100 * i) for i in range(1, 12)] + [("b", 1, 5)], "rel string, line long, bytes long")
    got = lambda df: [r["line"] for r in df.where("rel = 'a'").orderBy("line").collect()]
    assert got(records.window(own, 4, most=3)) == [4, 5, 6]
    assert got(records.window(own, 4, budget=1000)) == [4, 5]
    assert got(records.window(own, 9, budget=10)) == [9]  # one at least
    assert got(records.window(own, 40)) == []
    assert records.point(own, "a", 3).count() == 1
    assert [r[0] for r in spark.sql("select explode(array(1L, 500L, 501L, 1000L, 1001L)) as n").select(records.aligned(F.col("n"))).collect()] == [1, 1, 501, 501, 1001]


def test_locators_parse_back(spark):
    good = [("1", 1, None), ("412.2.11", 412, "2.11"), (" 7.r ", 7, "r"), ("7.r.3", 7, "r.3"), ("9.0", 9, "0")]
    bad = ["", "0", "x", "5.", "5.a", "5.1.2.3", "5.r.x", ".1", None, "-1"]
    own = spark.createDataFrame([(t, i, b) for t, i, b in good] + [(t, None, None) for t in bad], "t string, line long, block string")
    got = own.select("line", "block", records.parsed(F.col("t")).alias("p")).collect()
    assert all((r["p"] and tuple(r["p"])) == ((r["line"], r["block"]) if r["line"] else None) for r in got)
    back = spark.createDataFrame([(3, None), (3, "1.2"), (0, None), (3, "x")], "line long, block string").select(records.locator(F.col("line"), F.col("block"))).collect()
    assert [r[0] for r in back] == ["3", "3.1.2", None, None]
    paths = spark.createDataFrame([("2",), ("2.11",), ("r",), ("r.4",), ("x",)], "b string").select(records.json_path(F.col("b"))).collect()
    assert [r[0] for r in paths] == ["$.message.content[2]", "$.message.content[2].content[11]", "$.toolUseResult", "$.toolUseResult[4]", None]


def test_payloads_go_to_the_blocks_that_held_them(spark, tmp_path):
    image = lambda n: {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "iVBOR" + "A" * n}}
    first = user(A, "u1", "09:00:00", [{"type": "text", "text": "x"}, image(600), {"type": "tool_result", "tool_use_id": "t", "content": [image(700)]}], toolUseResult=[{"type": "text"}, image(800)])
    side_first = {"toolUseResult": {"file": {"base64": "/9j/" + "B" * 900}}} | user(A, "u2", "09:01:00", [image(650)])
    odd = user(A, "u3", "09:02:00", [image(640), {"type": "note", "data": "C" * 640}])  # two payloads, one block: none is assigned
    got = records.payload_blocks(stored(spark, tmp_path, [first, side_first, odd])).orderBy("line", "bi").collect()
    assert [(r["line"], r["bi"], r["key"], r["bytes"]) for r in got] == [(1, "1", "data", 605 * 3 // 4), (1, "2.0", "data", 705 * 3 // 4), (1, "r.1", "data", 805 * 3 // 4), (2, "0", "data", 655 * 3 // 4), (2, "r", "base64", 904 * 3 // 4)]


def test_scopes_are_strict_and_never_empty(spark):
    own = spark.createDataFrame([("p", "ab", 1, "x"), ("q r", "cd", 0, None)], "slug string, session_id string, turn_idx int, agent_id string")
    assert scopes.within(own, "project:q%20r").count() == 1 == scopes.within(own, "session:p/AB").count() == scopes.within(own, "turn:p/ab/1").count() == scopes.within(own, "agent:p/ab/x").count()
    assert scopes.within(own, None).count() == 2 == scopes.within(own, "store").count()
    for bad in ("project", "project:", "session:p", "turn:p/ab/x", "turn:p/ab/-1", "planet:p", "store:p", "agent:p//x"):
        with pytest.raises(scopes.BadScope):
            scopes.parse(bad)
    with pytest.raises(scopes.UnknownScope):
        scopes.within(own, "project:none")
    assert scopes.date_range("2024-02-30", "2024-03-01") == (None, "2024-03-01", ["from: 2024-02-30"])
    assert scopes.date_range("2024-03-02", "2024-03-01")[:2] == (None, None) and scopes.date_range("2024-3-1", None)[2] == ["from: 2024-3-1"]
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-05",)], "d string")
    assert scopes.in_days(days, "d", "2024-01-02", "")[0].count() == 1


def test_states_inputs_and_ladders(spark):
    own = spark.createDataFrame([("error", True, True, True), ("done", True, True, True), ("done", None, True, True), ("odd", None, True, None), (None, None, True, None), (None, None, True, True), (None, None, False, None)], "listed string, empty boolean, started boolean, result boolean")
    got = [r[0] for r in own.select(sessions.state_code(F.col("listed"), F.coalesce("empty", F.lit(False)), F.col("started"), F.col("result"))).collect()]
    assert got == ["error", "no-result", "done", "other", "running", "done", "unrecorded"]
    inputs = ['{"resumeFromRunId":"wf"}', '{"script":"x"}', '{"scriptPath":"/a"}', '{"name":"n","args":null}', '{"name":"n"}', '{"other":1}', "[1]", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").orderBy("i").select(sessions.workflow_input(F.try_parse_json("x"))).collect()]
    assert got == ["resume", "inline script", "scriptPath", "registered workflow with args", "registered workflow", "unrecognised shape", "not recorded", "not recorded"]
    cards = spark.createDataFrame([("s1", "c", "a"), ("s2", None, "a"), ("s3", None, None), ("s4", None, None)], "session_id string, custom_title string, ai_title string")
    got = sessions.titled(cards, spark.createDataFrame([("s3", "ask")], "session_id string, prompt string")).orderBy("session_id").collect()
    assert [(r["title"], r["title_from"]) for r in got] == [("c", "custom"), ("a", "ai"), ("ask", "prompt"), ("s4", "id")]
    cwds = spark.createDataFrame([("-w-my-app", "/w/my.app"), ("-w-my-app", "/w/other"), ("-x", "/y")], "slug string, cwd string")
    assert [tuple(r) for r in sessions.project_label(cwds).collect()] == [("-w-my-app", "/w/my.app")]


def test_runs_calls_and_what_is_missing(spark):
    calls = spark.createDataFrame([("s", "wf_1", 3, [3, 9]), ("s", "wf_2", 5, [5])], "session_id string, run_id string, first_line long, lines array<long>")
    at = spark.createDataFrame([("s", 3, 1), ("s", 5, 1), ("s", 9, 2)], "session_id string, line long, turn_idx long")
    assert sorted(map(tuple, sessions.turns_of_runs(calls, at).collect())) == [("s", "wf_1", 1, True), ("s", "wf_1", 2, False), ("s", "wf_2", 1, True)]
    listing = spark.createDataFrame([("s", "wf_1")], "session_id string, run_id string")
    assert [tuple(r) for r in sessions.missing_runs(calls, listing).collect()] == [("s", "wf_2")]
    assert {r["run_id"]: (r["in_agents"], r["in_journal"], r["in_manifest"]) for r in sessions.runs(listing, calls, listing.where("false")).collect()} == {"wf_1": (True, True, False), "wf_2": (False, True, False)}


def test_results_of_agents_and_order_of_lanes(spark, tmp_path):
    side = lambda s: {"agentId": "a1", "status": s, "resolvedModel": "m"}
    own = stored(spark, tmp_path, [user(A, "u1", "09:00:00", "x", toolUseResult=side("async")), user(A, "u2", "09:01:00", "y", toolUseResult=side("completed"))])
    assert [tuple(r)[1:4] for r in sessions.results_of_agents(transcripts.events(own)).collect()] == [("a1", "completed", "m")]
    agents = spark.createDataFrame([("s", "z", 5, None), ("s", "y", None, 3), ("s", "x", None, None), ("s", "w", 5, 1)], "session_id string, agent_id string, first_at long, queued_at long")
    assert [r["agent_id"] for r in sessions.lanes(agents).orderBy("lane").collect()] == ["y", "w", "z", "x"]


def test_forks_count_where_responses_are_billed(spark, tmp_path):
    b, c = "22222222-bbbb-4bbb-8bbb-000000000002", "33333333-cccc-4ccc-8ccc-000000000003"
    one = assistant(A, "u1", "09:00:00", "m1", usage(1, 1))
    null = assistant(A, "u2", "09:00:01", "m2", usage(0, 0, iterations=None))
    stored(spark, tmp_path, [one, null])
    stored(spark, tmp_path, [assistant(b, "v", "10:00:00", "m3", usage(1, 1)), one, null], b)
    own = stored(spark, tmp_path, [assistant(c, "w", "11:00:00", "m4", usage(1, 1)), one], c)
    kept = ledger.responses(own)
    got = {(r["session_id"][:1], r["partner"][:1]): tuple(r)[2:] for r in ledger.fork_partners(kept, ledger.canonical_sessions(kept, ledger.first_times(own))).collect()}
    assert got == {("1", "2"): (2, 1, 0, 0), ("2", "1"): (2, 0, 1, 0), ("1", "3"): (1, 1, 0, 0), ("3", "1"): (1, 0, 1, 0), ("2", "3"): (1, 0, 0, 1), ("3", "2"): (1, 0, 0, 1)}


def test_money_of_models_without_a_price_is_unknown_and_not_zero(spark, tmp_path):
    own = stored(spark, tmp_path, [assistant(A, "u1", "09:00:00", "m1", usage(10, 10)), assistant(A, "u2", "09:00:01", "m2", usage(5, 5), model="claude-3-opus-20240229"), assistant(A, "u3", "09:00:02", "m3", usage(2, 2), model=None)])
    rows = ledger.ledger(own)
    got = {r["model"]: (r["requests"], r["tcu"]) for r in ledger.by_model(rows).collect()}
    assert got["claude-3-opus-20240229"] == (1, None) and got["(unrecorded)"] == (1, None) and got["claude-fable-5"] == (1, 1_200_000)
    assert {r["model"] for r in ledger.unpriced_by_model(rows).collect()} == {"claude-3-opus-20240229", "(unrecorded)"}


def test_groups_keep_the_order_of_first_appearance(spark):
    own = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 4)], "g string, i int")
    assert [(r["g"], r["n"]) for r in tables.groups_in_order(own, "g", "i").orderBy("place").collect()] == [("b", 2), (None, 1), ("a", 1)]


def test_front_matter_previews_and_ranges(spark, tmp_path):
    from tallyloom.operators.inventory import front_matter

    texts = ["---\nname: a b\nmetadata:\n  originSessionId: 'x-1'\n  kind: \"q\"\nlast: 1\nname: again\n---\nbody: no", "no front", "---\nempty:\n---\n", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(front_matter(F.col("x"))).collect()]
    assert got == [{"name": "a b", "metadata.originSessionId": "x-1", "metadata.kind": "q", "last": "1"}, None, {}, None]
    stored(spark, tmp_path, [user(A, "u", "09:00:00", "x")])
    assert tuple(logs.preview(spark, str(tmp_path)).first())[:3] == (True, 1, 1)
    assert logs.preview(spark, str(tmp_path), most=0).first()["capped"]
    assert tuple(logs.preview(spark, str(tmp_path / "none")).first()) == (False, None, None, None, False)
    own = logs.byte_range(spark, str(tmp_path), f"p/{A}.jsonl", 1, 6).first()
    assert bytes(own["content"]) == (tmp_path / "p" / f"{A}.jsonl").read_bytes()[1:7]
