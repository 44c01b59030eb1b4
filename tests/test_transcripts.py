import json
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit, intervals, ledger, records, search, sequences, tables, transcripts
from tallyloom.sources import logs

from store import A, AGENT, B, CHILD, RUN, TCU_A, TCU_B, assistant, build, usage, user


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return str(build(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def lines(spark, root):
    return logs.lines(spark, root).cache()


@pytest.fixture(scope="module")
def events(lines):
    return transcripts.events(lines).cache()


@pytest.fixture(scope="module")
def rows(events):
    return transcripts.rows(events).cache()


def test_rows_keep_file_order_and_kinds(rows):
    own = rows.where(F.col("session_id") == A).where("tier = 'main'").orderBy("line", "ord").select("line", "bi", "kind", "head").collect()
    assert [(r["line"], r["kind"]) for r in own] == [(2, "prompt"), (3, "text"), (4, "thinking"), (4, "tool_use"), (5, "tool_result"), (5, "text"), (6, "text"), (9, "prompt"), (10, "text"), (11, "text"), (12, "text")]
    assert [r["bi"] for r in own if r["line"] == 5] == ["0", "0.0"] and own[3]["head"] == "look"


def test_turns_open_at_prompts_only(events):
    own = {(r["session_id"], r["turn_idx"]): r for r in transcripts.turns(events).collect()}
    assert sorted(own) == [(A, 0), (A, 1), (A, 2), (B, 1)]
    assert own[A, 1]["opener_line"] == 2 and own[A, 1]["end"] == own[A, 2]["start"] and own[A, 2]["end"] is None
    assert not own[A, 2]["clamped"]


def test_agents_take_the_turn_of_their_call_or_parent(spark, root, events, rows):
    own = {r["agent_id"]: r for r in transcripts.agents(events, rows, transcripts.sidecars(spark, root)).collect()}
    assert (own[AGENT]["turn_idx"], own[AGENT]["edge"], own[AGENT]["label"]) == (1, "call", "look")
    assert (own[CHILD]["turn_idx"], own[CHILD]["edge"], own[CHILD]["parent_id"]) == (1, "parent", AGENT)


def test_tool_calls_pair_with_later_results(rows):
    got = transcripts.tool_spans(rows).collect()
    assert len(got) == 1 and got[0]["open_seq"] < got[0]["close_seq"]
    assert transcripts.tool_histogram(rows).first()["tool"] == "Task"


def test_journal_and_snapshots(lines, events):
    j = transcripts.journal_census(lines).first()
    assert (j["run_id"], j["agent_id"], j["state"]) == (RUN, CHILD, "running")
    s = transcripts.snapshots(events).first()
    assert (s["type"], s["n"], s["value"]) == ("custom-title", 1, "one")


def test_two_computations_agree(spark, root, lines):
    rows = ledger.ledger(lines)
    got = {r["session_id"]: r for r in audit.compare(ledger.cost(rows, "session_id"), audit.recount(spark, root, ledger.rates(spark))).collect()}
    assert got[A]["a_tcu"] == TCU_A and got[B]["b_tcu"] == TCU_B
    assert all(r["same"] for r in got.values()), got
    held = {r["name"]: (r["value"], r["passed"]) for r in audit.invariants(lines, rows).collect()}
    assert held["torn_lines"] == (2, False) and held["usage_integers"] == (1, False) and held["cache_identity"] == (0, True)


def test_a_broken_cache_identity_is_found(spark, tmp_path):
    good, bad = usage(1, 1, 0, 30, 70), usage(1, 1, 0, 30, 70) | {"cache_creation_input_tokens": 99}
    events = [assistant(A, f"u{i}", "09:00:00", f"m{i}", u | {"iterations": [u]}) for i, u in enumerate((good, bad, {k: v for k, v in bad.items() if k != "cache_creation_input_tokens"}))]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"{A}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    own = logs.lines(spark, str(tmp_path))
    held = {r["name"]: (r["value"], r["passed"]) for r in audit.invariants(own, ledger.ledger(own)).collect()}
    assert held["cache_identity"] == (1, False)


def test_file_tools_name_paths_in_their_own_fields(spark, tmp_path):
    calls = [("Read", {"file_path": "/a"}), ("Grep", {"path": "/b", "file_path": "/no"}), ("NotebookEdit", {"notebook_path": "/a"}), ("Glob", {"file_path": "/no"}), ("MultiEdit", {"file_path": "/no"}), ("mcp__x__y", {"path": "/no"})]
    content = [{"type": "tool_use", "id": f"t{i}", "name": n, "input": x} for i, (n, x) in enumerate(calls)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"{A}.jsonl").write_text(json.dumps(assistant(A, "u", "09:00:00", "m", usage(1, 1), content=content)) + "\n")
    got = transcripts.file_ledger(transcripts.rows(transcripts.events(logs.lines(spark, str(tmp_path))))).collect()
    assert sorted(map(tuple, got)) == [("/a", "main", 1, 0, 1, 0), ("/b", "main", 0, 0, 0, 1)]


def test_unsafe_patterns_are_refused():
    for bad in ("(a+)+", "(x*)*y", "((ab)*)+", "(", "(a{2,})*", "((a|b+)c){3,}", "(?:a+)+"):
        with pytest.raises(search.UnsafePattern):
            search.check_pattern(bad)
    for good in ("a+b*", "(ab)+", r"[(+]+x", r"\(a+\)+", r"([0-9]+\.){3}[0-9]+", "(ab{2})*", "(a+){2,3}", "(a+)?", r"([a+]\+)+"):
        search.check_pattern(good)


def test_patterns_are_tried_on_whole_texts(spark):
    far = "\U0001f600" + "x" * 300_000
    own = spark.createDataFrame([(1, f"{far} 12.3.4"), (2, f"12.3.4 {far}"), (3, far), (4, None)], "id int, text string")
    got = search.pattern(own, "text", r"[0-9]{2,3}\.[0-9]+\.[0-9]+").select("id", "hit", "truncated").collect()
    assert sorted(map(tuple, got)) == [(1, "12.3.4", False), (2, "12.3.4", False)]


def test_patterns_ignore_case_and_composition_unless_told(spark):
    own = spark.createDataFrame([(1, "Une CRE\u0301ME brul\u00e9e"), (2, "cr\u00e9me"), (3, "creme")], "id int, text string")
    found = lambda **how: sorted(r["id"] for r in search.pattern(own, "text", "cr\u00e9me?", **how).collect())
    assert (found(), found(ignore_case=False), found(normalise=False)) == ([1, 2], [2], [2])


def test_context_is_a_window_with_its_white_space_collapsed(spark):
    text = "a" * 50 + " \n\t needle  of\n" + "b" * 50
    own = spark.createDataFrame([(text,), ("needle",), ("x needle",)], "text string")
    got = [r["ctx"] for r in search.pattern(own, "text", "needle").collect()]

    def plain(t, width=80):
        a = t.index("needle")
        half = (width - 6) // 2
        lo, hi = max(0, a - half), min(len(t), a + 6 + half)
        return "…" * (lo > 0) + re.sub(r"\s+", " ", t[lo:hi]) + "…" * (hi < len(t))

    assert got == [plain(text), "needle", "x needle"]


def test_hits_are_addressed_by_whole_block_texts(spark, tmp_path):
    long = "x " * 300
    content = [{"type": "text", "text": f"{long}alpha"}, {"type": "thinking", "thinking": "beta", "signature": "s"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": f"{long}gamma"}}]
    result = [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "no"}, {"type": "text", "text": f"{long}delta"}]}, {"type": "tool_result", "tool_use_id": "v", "content": "epsilon"}]
    events = [assistant(A, "u", "09:00:00", "m", usage(1, 1), content=content), user(A, "v", "09:00:01", result, toolUseResult=[{"a": 1}, {"b": f"{long}zeta"}]), user(A, "w", "09:00:02", "kappa", toolUseResult="theta", cwd="/iota")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"{A}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    lines = logs.lines(spark, str(tmp_path))
    own = transcripts.events(lines)
    want = {"ALPHA": (1, "0"), "beta": (1, "1"), "gamma": (1, "2"), "delta": (2, "0.1"), "epsilon": (2, "1"), "zeta": (2, "r.1"), "kappa": (3, None), "theta": (3, "r"), "iota": (3, None)}
    for word, place in want.items():
        for find in (lambda df, w=word: search.substring(df, "text", w), lambda df, w=word: search.pattern(df, "text", w)):
            (hit,) = records.block_of_hit(find(lines), own, find).collect()
            assert (hit["line"], hit["bi"]) == place and word.lower() in hit["ctx"].lower()


def test_deep_lineage_has_a_root_and_long_intervals_all_days(spark):
    deep = spark.range(300).selectExpr("id + 1 as id", "id as up").union(spark.sql("select * from values (1001L, 1002L), (1002L, 1001L), (1003L, 1001L)"))
    got = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in sequences.lineage(deep, "id", "up").collect()}
    assert got == {**{i: (0, i, False) for i in range(301)}, **{i: (None, None, True) for i in (1001, 1002, 1003)}}
    ages = spark.sql("select date'1500-01-01' as s, date'2000-01-01' as e")
    assert intervals.days_touched(ages, "s", "e").count() == 182_622


def test_unknown_sorts_last_both_ways_and_poisons_sums(spark):
    own = spark.createDataFrame([("b", 2, 1), ("a", None, 2), ("c", 1, 3), ("d", 2, 4)], "t string, n int, ord int")
    assert [r["t"] for r in tables.page(own, [("n", False)], "ord", 0).collect()] == ["c", "b", "d", "a"]
    assert [r["t"] for r in tables.page(own, [("n", True)], "ord", 0).collect()] == ["b", "d", "c", "a"]
    from tallyloom.functions.columns import dollars, poison_sum

    assert own.agg(poison_sum(F.col("n")).alias("s")).first()["s"] is None
    assert own.where("false").agg(poison_sum(F.col("n")).alias("s")).first()["s"] == 0
    assert [r[0] for r in spark.sql("select explode(array(0, 99999, 100000, 2000000000, -300000)) as x").select(dollars(F.col("x").cast("long"))).collect()] == ["0.0000", "0.0000", "0.0001", "1.0000", "-0.0002"]


def test_bins_fit_at_the_least_doubled_width(spark):
    marks = [-7, -1, 0, 3, 5, 6, 40, 41, 900, None]
    own = spark.createDataFrame([(m,) for m in marks], "t long")
    for most in (2, 3, 4, 6, 100):
        width = 3
        while len({m // width for m in marks if m is not None}) > most:
            width *= 2
        got, chosen = intervals.fitting_bins(own.where("t is not null"), "t", 0, 3, most)
        assert chosen == width and {r["bin"]: r["n"] for r in got.collect()} == {b: sum(m is not None and m // width == b for m in marks) for b in {m // width for m in marks if m is not None}}
    assert intervals.fitting_bins(own.where("false"), "t", 0, 3, 5)[1] == 3
