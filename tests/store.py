"""A small session-log store of our own, with its money worked out by hand."""

import json
from pathlib import Path

A, B = "11111111-aaaa-4aaa-8aaa-000000000001", "22222222-bbbb-4bbb-8bbb-000000000002"
AGENT, CHILD, RUN = "a00000000000000f1", "a00000000000000f2", "wf_12345678-abc"


def usage(i, o, read=0, m5=0, h1=0, **more):
    own = {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": read, "cache_creation_input_tokens": m5 + h1, "cache_creation": {"ephemeral_5m_input_tokens": m5, "ephemeral_1h_input_tokens": h1}}
    return own | more


def final(i, o, read=0, m5=0, h1=0, **more):
    return usage(i, o, read, m5, h1, speed="standard", service_tier="standard", iterations=[usage(i, o, read, m5, h1)], **more)


def assistant(session, uid, at, msg, use, model="claude-fable-5", content=None, **more):
    return {"type": "assistant", "uuid": uid, "timestamp": f"2026-03-01T{at}.000Z", "sessionId": session, "message": {"id": msg, "model": model, "role": "assistant", "content": content or [{"type": "text", "text": "ok"}], "stop_reason": "end_turn", "usage": use}} | more


def user(session, uid, at, content, **more):
    return {"type": "user", "uuid": uid, "timestamp": f"2026-03-01T{at}.000Z", "sessionId": session, "message": {"role": "user", "content": content}} | more


def build(root: Path) -> Path:
    first = [
        {"type": "custom-title", "customTitle": "one", "sessionId": A},
        user(A, "u1", "09:00:00", "please build", origin={"kind": "human"}, cwd="/w/p"),
        assistant(A, "u2", "09:00:05", "m1", usage(200, 4, 1000, 0, 500), content=[{"type": "text", "text": "part"}]),
        assistant(A, "u3", "09:00:09", "m1", final(200, 40, 1000, 0, 500), content=[{"type": "thinking", "thinking": "hm", "signature": "s"}, {"type": "tool_use", "id": "t1", "name": "Task", "input": {"description": "look"}}]),
        user(A, "u4", "09:00:20", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "found"}]}]),
        assistant(A, "u5", "09:01:00", "m2", usage(0, 0, iterations=None, speed=None, service_tier=None), model="<synthetic>"),
        '{"type":"assistant","cut',
        '{"type":"user"} trailing',
        user(A, "u6", "09:02:00", "go on", origin={"kind": "human"}),
        assistant(A, "u7", "09:02:30", "m3", usage(30, 7, iterations=[], service_tier="standard")),
        assistant(A, "u8", "09:03:00", "m4", final(500, 600), model="claude-3-opus-20240229"),
        assistant(A, "u9", "09:03:30", "m5", final("12", 5)),
    ]
    # A fork of the first: it begins later and copies m1.
    second = [
        user(B, "u0", "10:59:00", "resume", origin={"kind": "human"}),
        assistant(B, "u3", "09:00:09", "m1", final(200, 40, 1000, 0, 500)),
        assistant(B, "v1", "11:00:00", "m6", final(20, 30, server_tool_use={"web_search_requests": 2, "web_fetch_requests": 1})),
        assistant(B, "v2", "11:01:00", "m7", {"input_tokens": 9, "output_tokens": 9, "cache_creation_input_tokens": 40, "cache_read_input_tokens": 0, "speed": "standard", "service_tier": "standard", "iterations": [{"input_tokens": 9, "output_tokens": 9, "cache_creation_input_tokens": 40, "cache_read_input_tokens": 0}]}),
        assistant(B, "v3", "11:02:00", "m8", usage(3, 4, speed="standard", service_tier="standard", server_tool_use={"web_search_requests": 1}, iterations=[usage(1, 2) | {"model": "claude-haiku-4-5-20251001"}, usage(2, 2)])),
    ]
    agent = [
        user(A, "w1", "09:00:10", "look around", isSidechain=True, agentId=AGENT),
        assistant(A, "w2", "09:00:15", "m9", final(10, 20, 300, 100), isSidechain=True, agentId=AGENT),
    ]
    child = [assistant(A, "x1", "09:00:16", "m10", final(1, 1), isSidechain=True, agentId=CHILD)]
    text = lambda events: "".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events)
    put = {
        f"p/{A}.jsonl": "﻿" + text(first) + '{"type":"user","tail',
        f"p/{B}.jsonl": text(second),
        f"p/{A}/subagents/agent-{AGENT}.jsonl": text(agent),
        f"p/{A}/subagents/agent-{AGENT}.meta.json": json.dumps({"agentType": "general", "description": "look", "toolUseId": "t1", "spawnDepth": 1}),
        f"p/{A}/subagents/workflows/{RUN}/agent-{CHILD}.jsonl": text(child),
        f"p/{A}/subagents/workflows/{RUN}/agent-{CHILD}.meta.json": json.dumps({"agentType": "general", "parentAgentId": AGENT, "spawnDepth": 2}),
        f"p/{A}/subagents/workflows/{RUN}/journal.jsonl": text([{"type": "started", "key": "k", "agentId": CHILD}]),
        "p/memory/notes.md": f"---\nmetadata:\n  originSessionId: {A}\n---\nnote\n",
    }
    for rel, body in put.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(body.encode())
    return root


# m1 200*20000 + 40*100000 + 500*40000 + 1000*2000 = 30,000,000; m3 30*20000 + 7*100000 = 1,300,000;
# m5 (input is no integer: 0) 5*100000 = 500,000; m9 10*20000 + 20*100000 + 100*25000 + 300*2000 = 5,300,000; m10 120,000
TCU_A = 30_000_000 + 1_300_000 + 500_000 + 5_300_000 + 120_000
# m6 20*20000 + 30*100000 + 2*2e7 = 43,400,000; m7 9*20000 + 9*100000 + 40*25000 = 2,080,000;
# m8 haiku 1*2000 + 2*10000 = 22,000 and fable 2*20000 + 2*100000 + 2e7 = 20,240,000
TCU_B = 43_400_000 + 2_080_000 + 22_000 + 20_240_000
