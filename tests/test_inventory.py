import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import inventory, ledger, transcripts
from tallyloom.sources import logs

from store import A, AGENT, B, CHILD, RUN, TCU_A, TCU_B, assistant, build, final, user

PNG = "iVBORw0KGgo" + "A" * 600


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    own = build(tmp_path_factory.mktemp("store"))
    (own / f"p/{A}/workflows").mkdir(parents=True, exist_ok=True)
    record = {"runId": RUN, "status": "completed", "startTime": 1000, "timestamp": "2026-03-01T09:00:00.000Z", "agentCount": 1, "workflowProgress": [{"type": "workflow_phase", "index": 0}, {"type": "workflow_agent", "agentId": CHILD, "label": "first", "state": "error"}, {"type": "workflow_agent", "agentId": CHILD, "label": "second", "state": "done", "queuedAt": 5}]}
    (own / f"p/{A}/workflows/{RUN}.json").write_text(json.dumps(record))
    (own / f"p/{A}/tool-results").mkdir()
    (own / f"p/{A}/tool-results/out.txt").write_text("x")
    (own / "p/memory/lost.md").write_text("no front matter")
    more = [
        user(A, "z1", "09:10:00", [{"type": "tool_result", "tool_use_id": "q", "content": f"Output has been saved to: {own}/p/{A}/tool-results/out.txt."}]),
        user(A, "z2", "09:11:00", [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": PNG}}], toolUseResult={"file": {"base64": PNG}}),
        user(A, "z3", "09:12:00", [{"type": "tool_result", "tool_use_id": "r", "content": f"started {RUN}"}]),
    ]
    path = own / f"p/{A}.jsonl"
    path.write_bytes(path.read_bytes().rsplit(b"\n", 1)[0] + b"\n" + "".join(json.dumps(e) + "\n" for e in more).encode())
    return str(own)


def test_inventory(spark, root):
    lines = logs.lines(spark, root).cache()
    events = transcripts.events(lines).cache()
    rows = transcripts.rows(events)
    listing = logs.files(spark, root).cache()
    sessions = logs.sessions(listing)

    records = inventory.manifests(spark, root)
    one = records.first()
    assert (one["status"], one["started_at"], one["ended_at"]) == ("completed", 1000, 1772355600000)
    agent = inventory.run_agents(records, transcripts.journal_census(lines), events).collect()
    assert [(r["agent_id"], r["state"], r["label"], r["lost"], r["on_disk"]) for r in agent] == [(CHILD, "done", "second", False, True)]
    assert inventory.run_calls(events).first()["first_line"] == 15

    notes = {r["rel"].rsplit("/", 1)[-1]: r["link"] for r in inventory.memory(spark, root, sessions).collect()}
    assert notes == {"notes.md": "resolved", "lost.md": "not recorded"}
    refs = inventory.spills(events)
    assert inventory.spill_census(listing, refs, root).first()["referenced"]
    pictures = inventory.images(lines).orderBy("bi").collect()
    assert [(r["bi"], r["media_type"], r["twin"]) for r in pictures] == [("0", "image/png", False), ("r", "image/png", True)]
    assert inventory.stripped_census(lines).first()["n"] == 2

    priced = ledger.ledger(lines).cache()
    cards = inventory.session_cards(sessions, events, rows, priced).cache()
    got = {r["session_id"]: r for r in cards.collect()}
    assert got[A]["title"] == "one" and got[A]["turns"] == 2 and got[A]["agents"] == 2 and got[A]["tcu"] == TCU_A
    marks = cards.sparkSession.createDataFrame([(B, ["retried", "cached"]), ("other", ["running"])], "session_id string, badges array<string>")
    more = {r["session_id"]: r["badges"] for r in inventory.session_cards(sessions, events, rows, priced, marks).collect()}
    assert more[B] == ["forked", "retried", "cached"] and more[A] == [] and len(more) == len(got)
    assert got[B]["badges"] == ["forked"] and got[A]["badges"] == []
    assert inventory.project_table(cards).first()["tcu"] == TCU_A + TCU_B
    assert inventory.day_bands(priced).agg(F.sum("tcu").alias("t")).first()["t"] == TCU_A + TCU_B

    agents = transcripts.agents(events, rows, transcripts.sidecars(spark, root))
    turns = {(r["session_id"], r["turn_idx"]): r["tcu"] for r in inventory.cost_by_turn(priced, events, agents).collect()}
    assert turns[A, 1] == 30_000_000 + 5_300_000 + 120_000 and sum(turns.values()) == TCU_A + TCU_B
    assert {r["agent_id"]: r["edge"] for r in agents.collect()} == {AGENT: "call", CHILD: "parent"}


def test_pictures_beside_a_block_are_twins_whatever_their_bytes(spark, tmp_path):
    picture = lambda data: {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": data}}
    events = [
        user(A, "a", "09:00:00", [picture(PNG), picture(PNG)]),  # two blocks are two pictures
        user(A, "b", "09:00:01", [{"type": "tool_result", "tool_use_id": "q", "content": [picture(PNG)]}], toolUseResult={"file": {"base64": "QUJD" * 200}}),
        user(A, "c", "09:00:02", "x", toolUseResult={"file": {"base64": PNG}}),
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"{A}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events))
    got = inventory.images(logs.lines(spark, str(tmp_path))).select("line", "bi", "media_type", "twin").collect()
    assert sorted(map(tuple, got)) == [(1, "0", "image/png", False), (1, "1", "image/png", False), (2, "0.0", "image/png", False), (2, "r", "image/png", True), (3, "r", "image/png", False)]


def test_labels_come_from_the_first_source_that_has_one(spark, tmp_path):
    """An agent for each rung of the ladder, each with all the lower ones too."""
    ids = ["a1", "a2", "a3", "a4", "a5", "a6"]
    calls = [{"type": "tool_use", "id": f"t{i}", "name": "Task", "input": {"description": "called", "prompt": "x"}} for i in (1, 2, 3)]
    main = [user(A, "u", "09:00:00", "go", origin={"kind": "human"}), assistant(A, "v", "09:00:01", "m", final(1, 1), content=calls), user(A, "w", "09:00:02", [{"type": "tool_result", "tool_use_id": "t9", "content": "x"}], toolUseResult={"agentId": "a4", "description": "resulted"})]
    folder = tmp_path / "p" / A / "subagents"
    folder.mkdir(parents=True)
    (tmp_path / "p" / f"{A}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in main))
    for i, agent in enumerate(ids, 1):
        (folder / f"agent-{agent}.jsonl").write_text(json.dumps(user(A, f"x{i}", "09:00:03", "[AGENT:  tagged ] look" if i < 3 else "look", isSidechain=True)) + "\n")
        meta = {"agentType": "general", "toolUseId": f"t{i}"} | ({"description": "beside"} if i < 6 else {})
        (folder / f"agent-{agent}.meta.json").write_text(json.dumps(meta))
    lines = logs.lines(spark, str(tmp_path))
    events = transcripts.events(lines)
    listed = spark.createDataFrame([(A, "a1", "listed")], "session_id string, agent_id string, label string")
    got = transcripts.agents(events, transcripts.rows(events), transcripts.sidecars(spark, str(tmp_path)), listed).select("agent_id", "label", "label_source").collect()
    assert sorted(map(tuple, got)) == [("a1", "listed", "workflowProgress"), ("a2", "tagged", "prompt-tag"), ("a3", "called", "input.description"), ("a4", "resulted", "input.description"), ("a5", "beside", "meta.description"), ("a6", "general a6", "fallback")]
