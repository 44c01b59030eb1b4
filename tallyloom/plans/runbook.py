"""A second store written from ``conversations``: runs with journals and records, fragments, orphans, memory notes, wrong clocks.

What is in it follows from conv_id and turn, so that SQL over the table says what a query over the store must give. Every session spans days
around a change of the clock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.storage import folder
from tallyloom.sources.logbook import TOOLS, _choose, _text, session_id, write

#: The first moment of all (2026-10-20), what a wrong clock adds to it, and the zone whose clock changes meanwhile.
START, WRONG, ZONE = 1_792_454_400_000, 12_000_000_000_000, "America/New_York"


def run_id(c: Column) -> Column:
    h = F.md5(F.concat(F.lit("w"), c.cast("string")).cast("binary"))
    return F.concat(F.lit("wf_"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 3))


def lines(conversations: DataFrame) -> DataFrame:
    """(rel, ord, line) of every file of the store."""
    own = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("t"), "role", F.coalesce("text", F.lit("")).alias("text"))
    c, t, n = F.col("c"), F.col("t"), F.col("c") + F.col("t")
    me, orphan, run = session_id(c, "s"), session_id(c, "o"), run_id(c)
    slug = F.concat(F.lit("p"), c % 3)
    join = lambda *parts: F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    home, main = join(slug, me), F.concat(join(slug, me), F.lit(".jsonl"))
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    at = lambda k: stamp(START + c % 20 * 86_400_000 + t * 25_200_000 + k * 60_000)

    def row(df: DataFrame, rel: Column, order: Column | int, line: Column) -> DataFrame:
        order = F.lit(order) if isinstance(order, int) else order
        return df.select(rel.alias("rel"), order.cast("long").alias("ord"), line.alias("line"))

    def user(when: Column | None, content: Column, more: Column | str = "") -> Column:
        more = F.lit(more) if isinstance(more, str) else more
        time = F.lit("") if when is None else F.format_string('"timestamp":"%s",', when)
        return F.format_string('{"type":"user",%s"sessionId":"%s"%s,"message":{"role":"user","content":%s}}', time, me, more, content)

    def answer(when: Column, name: Column, content: Column, usage: Column) -> Column:
        return F.format_string('{"type":"assistant","timestamp":"%s","sessionId":"%s","message":{"id":"%s","model":"claude-fable-5","role":"assistant","content":%s,"usage":%s}}', when, me, name, content, usage)

    counts = F.format_string('"input_tokens":%d,"output_tokens":%d', 10 + n % 7, 5 + n % 5)
    tier = F.when(n % 4 == 0, "").when(n % 4 == 1, ',"speed":null,"service_tier":"standard"').when(n % 4 == 2, ',"speed":"standard","service_tier":"standard"').otherwise(',"speed":"standard"')
    whole = F.concat(F.lit("{"), counts, tier, F.lit(',"iterations":[{'), counts, F.lit("}]}"))
    call = F.format_string('[{"type":"tool_use","id":"t%d-%d","name":"%s","input":{"file_path":"/w/f%d","path":"/w/g%d"}}]', c, t, _choose(n, TOOLS), n % 4, n % 3)
    name = F.format_string("m%d-%d", c, t)
    done = F.format_string('[{"type":"tool_result","tool_use_id":"t%d-%d","content":"ok"}]', c, t)
    asks, replies, notes = own.where("role = 'user'"), own.where("role = 'assistant'"), own.where("role = 'system'")
    talks = own.groupBy("c").agg(F.max("t").alias("top")).withColumn("t", F.lit(0).cast("long"))
    beside = F.when(n % 8 == 1, F.lit(',"toolDenialKind":"user-rejected"')).when(n % 8 == 2, F.format_string(',"toolUseResult":{"filePath":"/w/f%d"}', n % 3)).otherwise(F.lit(""))
    last = F.col("top") * 4
    mention = user(None, F.format_string('[{"type":"tool_result","tool_use_id":"x","content":"began %s"}]', run), F.format_string(',"toolUseResult":{"runId":"%s"}', run))
    out = [
        row(talks, main, 0, F.concat(F.when(c % 7 == 3, F.lit("﻿")).otherwise(F.lit("")), F.format_string('{"type":"custom-title","customTitle":"talk %d","sessionId":"%s"}', c, me))),
        row(asks, main, t * 4 + 1, user(at(F.lit(1)), _text(F.col("text")), ',"origin":{"kind":"human"}')),
        row(asks.where(n % 5 == 2), main, t * 4 + 2, F.format_string('{"type":"queue-operation","operation":"enqueue","timestamp":"%s","sessionId":"%s","content":"later"}', at(F.lit(2)), me)),
        row(notes, main, t * 4 + 1, F.format_string('{"type":"system","subtype":"note","timestamp":"%s","sessionId":"%s","content":"n"}', at(F.lit(1)), me)),
        row(replies.where(n % 3 == 0), main, t * 4 + 1, answer(at(F.lit(1)), name, F.lit('[{"type":"text","text":"part"}]'), F.lit('{"input_tokens":1,"output_tokens":1,"speed":"fast"}'))),
        row(replies, main, t * 4 + 2, answer(at(F.lit(2)), name, call, whole)),
        row(replies.where(n % 4 != 0), main, t * 4 + 3, user(at(F.lit(3)), done, beside)),
        row(talks.where("c % 4 = 1"), main, last + 5, mention),
        row(talks.where("c % 8 = 1"), main, last + 6, mention),
        row(talks.where("c % 50 = 7"), main, last + 7, user(stamp(F.lit(START + WRONG)), F.lit('[{"type":"tool_result","tool_use_id":"y","content":"late"}]'))),
    ]
    look = user(at(F.lit(0)), F.lit('"look"'))
    runs = talks.where("c % 4 = 1")
    place = lambda a: F.concat(join(home, "subagents", "workflows", run), F.lit(f"/agent-{a}"), c, F.lit(".jsonl"))
    for a in "resu":
        out.append(row(runs, place(a), 1, look))
        if a != "u":
            out.append(row(runs, place(a), 2, answer(at(F.lit(1)), F.concat(F.lit(a), c), F.lit('[{"type":"text","text":"found"}]'), F.lit('{"input_tokens":10,"output_tokens":20,"iterations":[{"input_tokens":10,"output_tokens":20}]}'))))
    journal = join(home, "subagents", "workflows", run, "journal.jsonl")
    note = lambda a, kind: F.format_string(f'{{"type":"{kind}","agentId":"{a}%d"}}', c)
    for k, (a, kind, when) in enumerate((("r", "started", "true"), ("r", "started", "c % 3 = 1"), ("e", "started", "c % 3 <> 2"), ("s", "started", "true"), ("s", "started", "c % 3 = 0"), ("q", "started", "true"), ("r", "result", "true"), ("e", "result", "true"))):
        out.append(row(runs.where(when), journal, k, note(a, kind)))
    record = F.format_string(
        '{"runId":"%s","status":"completed","workflowName":"check","startTime":%d,"durationMs":60000,"agentCount":2,"workflowProgress":[{"type":"workflow_phase","title":"one"},'
        '{"type":"workflow_agent","agentId":"r%d","label":"fetch %d","phaseTitle":"one","state":"running"},{"type":"workflow_agent","agentId":"r%d","label":"fetch %d","phaseTitle":"one","state":"done"},'
        '{"type":"workflow_agent","agentId":"e%d","label":"check %d","phaseTitle":"two","state":"error","cached":true}]}',
        run, START + c % 20 * 86_400_000, c, c, c, c, c, c,
    )
    out.append(row(talks.where("c % 8 = 1"), F.concat(join(home, "workflows", run), F.lit(".json")), 1, record))
    out.append(row(runs.where("c % 3 = 0"), F.concat(join("x", me, "subagents", "workflows", run), F.lit("/agent-r"), c, F.lit(".jsonl")), 1, look))
    out.append(row(talks.where("c % 5 = 2"), F.concat(join("x", me, "subagents"), F.lit("/agent-b"), c, F.lit(".jsonl")), 1, look))
    out.append(row(talks.where("c % 5 = 3"), F.concat(join(slug, orphan, "subagents"), F.lit("/agent-o"), c, F.lit(".jsonl")), 1, look))
    origin = F.when(c % 4 == 0, me).when(c % 4 == 2, session_id(c + 1, "s"))
    front = F.format_string("---\nname: n%d\nmetadata:\n  originSessionId: %s\n---\nkept", c, F.coalesce(origin, F.lit("none")))
    out.append(row(talks.where("c % 6 in (2, 3)"), F.concat(join(slug, "memory"), F.lit("/n"), c, F.lit(".md")), 1, front))
    out.append(row(talks.where("c % 10 = 9"), F.concat(F.lit("m"), c, F.lit("/memory/only.md")), 1, F.lit("kept")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def store(spark: SparkSession, sf_dir: str) -> str:
    """The root of a store newly written from a folder's conversations, in the shared folder."""
    return write(lines(spark.read.parquet(f"{sf_dir}/conversations.parquet")), f"{folder(spark)}/runbook-{uuid.uuid4().hex}")
