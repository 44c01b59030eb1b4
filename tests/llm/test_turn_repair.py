import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from tallyloom.llm import turn_repair

KIND = "conv_id long, turn long, role string, text string, note string"


def damaged(rows):
    """The contract, row by row: {conv: rows after damage}, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain(conv, rows):
    """What the contract asks of rows in order, by trying every edit from every place."""
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, so_far, inserts=0):
        """(cost, audit) of what is left; ``so_far``: start, s, u or a."""
        ways = [(0, "")] if i == len(rows) and so_far in ("start", "a") else []
        follows = {"start": "su", "s": "u", "u": "a", "a": "u"}[so_far]
        if inserts < 3:
            ways += [(2 + c, "I" + x) for r in follows if r in "ua" for c, x in [best(i, r, inserts + 1)]]
        if i < len(rows):
            c, x = best(i + 1, so_far)
            ways.append((3 + c, "D" + x))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for r in follows:
                    c, x = best(i + 1, r)
                    ways += [(more + c, "K" + x)] * (rows[i][1][:1] == r) + [(2 + more + c, "R" + x)] * (r in "ua")
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "start")
    lines, state, left = [], "", iter(rows)
    for edit in audit:
        _, role, text = (0, "", "") if edit == "I" else next(left)
        if edit != "D":
            state = role[0] if edit == "K" else "a" if state == "u" else "u"
            lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha), lines


def key(row):
    return row[0] is not None, row[0] or 0


def conversation(rng, n):
    texts = ["Yes.", "No!", "well", "why? ", " ", "", None, "a.\n", "b\x0b", "é。", "c. d"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "assistant"]
    turn, out = rng.randint(-2, 3), []
    for _ in range(n):
        out.append((None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
        turn += rng.choice([1, 1, 1, 2, 5])
    return out


@pytest.fixture(scope="module")
def many():
    rng = random.Random(11)
    rows = [(conv, *r) for conv in range(300) for r in conversation(rng, rng.randint(0, 7))]
    rows += [(None, *r) for r in conversation(rng, 6)]
    rows += [(9000, *r) for r in conversation(rng, 60)]
    return rows


def ordered(spark, many):
    """Rows as the operator takes them where a turn has several: by role, then by hash of the text."""
    from pyspark.sql import functions as F

    damage = [(c, t, r, x) for c, own in damaged(many).items() for t, r, x in own]
    marked = spark.createDataFrame(damage, "c long, t long, r string, x string").withColumn("h", F.xxhash64("x")).collect()
    out = {c: [] for c in damaged(many)}
    for r in sorted(marked, key=lambda r: (r["t"] is not None, r["t"] or 0, r["r"], r["h"])):
        out[r["c"]].append((r["t"], r["r"], r["x"]))
    return out


def test_against_every_edit(spark, many):
    docs = spark.createDataFrame([(*r, "x") for r in many], KIND).repartition(6)
    want = sorted((plain(c, rows)[0] for c, rows in ordered(spark, many).items()), key=key)
    assert sorted(map(tuple, turn_repair.repair_damaged(docs).collect()), key=key) == want


@pytest.mark.parametrize("rows", [1, 3])
def test_conversations_over_many_segments_come_out_the_same(spark, many, monkeypatch, rows):
    want = {c: plain(c, own) for c, own in ordered(spark, many).items()}
    monkeypatch.setattr(turn_repair.Segment, "full", lambda self, most=rows: len(self.kinds) >= most)
    found = turn_repair._ordered(turn_repair.damage(spark.createDataFrame([(*r, "x") for r in many], KIND)))
    segments, by_conv = [], {}
    for r in found.collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    for at, (conv, own) in enumerate(by_conv.items()):
        seen, now, k = set(), turn_repair.Segment(conv), 0
        for r in own:
            for _ in range(r["copies"]):
                if now.full():
                    segments.append(now.row((at << 33) + k))
                    now, seen, k = turn_repair.Segment(conv, False), set(), k + 1
                now.add(r["turn"], r["role"], r["text"], seen)
        segments.append(now.row((at << 33) + k))
    spread = spark.createDataFrame(segments, turn_repair._SEGMENT).repartition(5)
    edited = turn_repair._edited_segments(spread)
    got = edited.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(turn_repair._digest, turn_repair.RESULT)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((row for row, _ in want.values()), key=key)


def test_the_turns_themselves(spark, many):
    rows = turn_repair.damage(spark.createDataFrame([(*r, "x") for r in many], KIND))
    got = {}
    for r in sorted(turn_repair.repaired_turns(rows).collect(), key=lambda r: (r["segment"], r["place"])):
        if r["edit"] != "D":
            got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert got == {c: lines for c, own in ordered(spark, many).items() if (lines := plain(c, own)[1])}


def test_every_short_sequence_of_kinds():
    for n in range(5):
        for kinds in itertools.product("0145 8c 9d 3 6".replace(" ", ""), repeat=n):
            roles = [{0: "tool", 1: "system", 2: "user", 3: "assistant"}[int(k, 16) >> 2] for k in kinds]
            texts = [{0: f"{i}.", 1: f"{i}", 2: None, 3: ""}[int(k, 16) & 3] for i, k in enumerate(kinds)]
            if None in texts:
                continue  # copies need an earlier turn: in the random tests
            costs, ranks, moves = turn_repair.run("".join(kinds))
            end = turn_repair.ending(costs, ranks)
            after = turn_repair.AFTER[turn_repair.STATES[end]]
            audit = "".join(turn_repair.trace(moves, end)) + "I" * after
            want = plain(1, list(zip(range(n), roles, texts)))[0]
            assert (costs[end] + 2 * after, audit) == want[6:8]


def test_nothing(spark):
    assert turn_repair.repair_damaged(spark.createDataFrame([], KIND)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = turn_repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "")], KIND)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
