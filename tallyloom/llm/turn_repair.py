"""Conversation structure repair: the cheapest edits that give a conversation its form, by a DP over the turns that stay.

The form is an optional system turn and then user and assistant turns in pairs, or nothing at all. A turn is kept (K), gets
another role (R), or is deleted (D), and empty turns are inserted (I). Only turns that stay are states of the DP: what
lies between two of them is deleted, which prefix deletion sums price, and the inserts that a gap needs follow from the
two roles at its ends. So for each role of the last turn that stays, a running minimum of cost less deletion
sum is enough. Of equal costs the audit (the edits' initials) that is ASCII-least stays: all audits so far have used
up the same turns, so none begins another, and their order among the few states settles every later tie.

Rows are range-partitioned by conversation and turn, so one conversation may spread over many tasks. A task reads its rows in
order, in segments of SEGMENT_ROWS rows or SEGMENT_BYTES bytes at most. Conversations that lie inside one segment are finished there. Of
the others each segment is reduced to a table of costs from state to state, the tables are chained for each conversation, and
each segment then finds its own edits between the two states it got. Only the digest, which is of one long text, is
taken by one task a conversation, as a stream.

Defined results: rows of one turn stand by role, then by a hash of their text; null turns come first and count in no gap; null roles
and texts are one space; a role that doesn't begin with s, u or a is never kept; null conversations are one conversation;
repeated rows are duplicates; a gap beyond 64 bits is the largest long; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import common

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SEGMENT_ROWS, SEGMENT_BYTES = 1 << 13, 1 << 22
#: States: the role of the last turn that stays, none at the start. Inserts between two such turns, and after the last one.
STATES = ("", "s", "u", "a")
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
NAMES = {"s": "system", "u": "user", "a": "assistant"}
_WHITE = " \t\n\v\f\r"
FINE, TORN, COPY, EMPTY = range(4)
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SEGMENT = f"{RESULT}, segment long, kinds string, digests array<binary>, roles array<string>, texts array<string>, low long, high long, turns long"
_SUMMARY = "conv_id long, segment long, kinds string, ends string, faults array<long>, costs array<long>, ranks array<int>, low long, high long, turns long"
_PATH = "segment long, entry int, exit int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_EDITED = "conv_id long, segment long, edits array<string>, roles array<string>, texts array<string>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` of every row, damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user; nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(how == 0, 0).when(how == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copies"))


# The DP. A front has, for each state, the least cost less the deletion sum so far (None: not reached) and the place of its
# audit among those of the others; costs are less their least, which keeps the number of different fronts small.


def start(state: int = 0) -> tuple:
    return tuple(0 if i == state else None for i in range(4)), (0, 0, 0, 0)


@lru_cache(1 << 16)
def step(front: tuple, kind: str) -> tuple:
    """(front after one more turn, what was taken off its costs, for each state the one before and the edits)."""
    costs, ranks = front
    initial, fault = STATES[int(kind, 16) >> 2], int(kind, 16) & 3
    best: list = [None] * 4
    for i, cost in enumerate(costs):
        if cost is None:
            continue
        ways = [(0, "D", STATES[i])]
        if fault < COPY:
            stays = TRUNCATED * (fault == TORN) - DELETE  # the deletion sum goes on through turns that stay
            ways += [(stays + INSERT * BETWEEN[STATES[i], r] + REROLE * (edit == "R"), "I" * BETWEEN[STATES[i], r] + edit, r) for edit, r in (("K", initial), ("R", "u"), ("R", "a")) if (STATES[i], r) in BETWEEN]
        for more, edits, r in ways:
            way = (cost + more, ranks[i], edits, i)
            j = STATES.index(r)
            if best[j] is None or way < best[j]:
                best[j] = way
    least = min(way[0] for way in best if way)
    order = sorted((way[1:3], j) for j, way in enumerate(best) if way)
    places = [0] * 4
    for place, (_, j) in enumerate(order):
        places[j] = place
    return (tuple(way and way[0] - least for way in best), tuple(places)), least, tuple(way and (way[3], way[2]) for way in best)


def run(kinds: str, entry: int = 0) -> tuple[list, tuple, list]:
    """(costs by state, places of their audits, moves turn by turn) of turns from one state."""
    front, base, moves = start(entry), DELETE * len(kinds), []
    for kind in kinds:
        front, least, move = step(front, kind)
        base += least
        moves.append(move)
    costs, ranks = front
    return [None if c is None else c + base for c in costs], ranks, moves


def trace(moves: list, exit_: int) -> list[str]:
    """The edits turn by turn; inserts stand before the turn that stays after them."""
    out = []
    for move in reversed(moves):
        exit_, edits = move[exit_]
        out.append(edits)
    return out[::-1]


def ending(costs: list, ranks) -> int:
    """The state in which a conversation is cheapest to end."""
    return min((c + INSERT * AFTER[STATES[i]], ranks[i], i) for i, c in enumerate(costs) if c is not None)[2]


def edited(edits: list[str], roles: list[str], texts: list[str], entry: int = 0, after: int = 0):
    """(edit, role, text) one by one, deleted turns as they were, ``after`` inserts at the end."""
    state = STATES[entry]
    for own, role, text in [*zip(edits, roles, texts), *[("I" * after, "", "")] * (after > 0)]:
        for edit in own:
            if edit == "D":
                yield edit, role, text
                continue
            state = role[0] if edit == "K" else "a" if state == "u" else "u"
            yield edit, role if edit == "K" else NAMES[state], "" if edit == "I" else text


def kind_of(role: str, text: str, seen: bool) -> str:
    """Initial and first fault of a turn as one hexadecimal digit."""
    initial = STATES.index(role[:1]) if role[:1] in STATES else 0
    own = text.rstrip(_WHITE)
    fault = EMPTY if not own else COPY if seen else FINE if own[-1] in ".!?" else TORN
    return f"{4 * initial + fault:x}"


def counts(kinds: str) -> dict[str, int]:
    numbers = [int(k, 16) for k in kinds]
    pairs = sum((STATES[a >> 2] + STATES[b >> 2]) not in ("su", "ua", "au") for a, b in zip(numbers, numbers[1:]))
    faults = [n & 3 for n in numbers]
    return {"blank": faults.count(EMPTY), "duplicate": faults.count(COPY), "truncated": faults.count(TORN), "illegal": pairs}


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)


@dataclass
class Segment:
    """Turns of one conversation that stand together, copies told by what was seen in the segment itself."""

    conv: int | None
    whole: bool = True
    size: int = 0
    kinds: list = field(default_factory=list)
    digests: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, seen: set) -> None:
        digest = hashlib.blake2b(repr((self.conv, role)).encode() + text.encode(), digest_size=16).digest()
        self.kinds.append(kind_of(role, text, digest in seen))
        seen.add(digest)
        for own, x in ((self.digests, digest), (self.roles, role), (self.texts, text)):
            own.append(x)
        self.size += len(text)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def full(self) -> bool:
        return len(self.kinds) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def result(self) -> tuple:
        """The finished row of a conversation that lies in this segment."""
        kinds = "".join(self.kinds)
        costs, ranks, moves = run(kinds)
        exit_ = ending(costs, ranks)
        after = AFTER[STATES[exit_]]
        all_ = list(edited(trace(moves, exit_), self.roles, self.texts, 0, after))
        lines = "\n".join(f"{role}:{text}" for edit, role, text in all_ if edit != "D")
        return (self.conv, _gaps(self.low, self.high, self.turns), *counts(kinds).values(), costs[exit_] + INSERT * after, "".join(edit for edit, _, _ in all_), hashlib.sha256(lines.encode()).hexdigest())

    def row(self, segment: int) -> tuple:
        return (self.conv, *[None] * 8, segment, "".join(self.kinds), self.digests, self.roles, self.texts, self.low, self.high, self.turns)


def _batches(rows, schema: str, size: int = 1 << 23):
    """Rows as Arrow batches of bounded length and about ``size`` characters."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    own = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])
    held, n = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), own)], schema=own)
    for row in rows:
        held.append(row)
        n += 64 + sum(len(x) if isinstance(x, str) else sum(map(len, x)) if isinstance(x, list) and x and isinstance(x[0], (str, bytes)) else 0 for x in row)
        if len(held) >= 4096 or n >= size:
            yield pack()
            held, n = [], 0
    if held:
        yield pack()


def _read(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _segments(finish: bool):
    """What a task makes of its rows in order: results of conversations that lie inside one segment, and the segments of the others."""

    def make(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        own, seen, first = None, set(), True
        for conv, turn, role, text, copies in _read(batches):
            if own is not None and conv != own.conv:
                if own.whole and not first and finish:
                    yield (*own.result(), *[None] * 8)
                else:
                    yield own.row(at)
                    at += 1
                own, seen, first = None, set(), False
            own = own or Segment(conv)
            for _ in range(copies):
                if own.full():
                    yield own.row(at)
                    at += 1
                    own, seen = Segment(conv, False), set()
                own.add(turn, role, text, seen)
        if own is not None:  # the last one may go on in the next task
            yield own.row(at)

    return lambda batches: _batches(make(batches), _SEGMENT)


def _first_seen(batches):
    """(segment, digest) of the turns that a segment has first."""
    import pyarrow as pa

    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in ("segment", "kinds", "digests")))
        held = [(s, d) for s, kinds, own in rows for k, d in zip(kinds, own) if int(k, 16) & 3 < COPY]
        segments, digests = zip(*held) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(digests, pa.binary())], names=["segment", "digest"])


def _summaries(batches):
    """Costs from each state to each, and places of the audits from one state, of every segment; copies of earlier segments marked."""

    def make():
        for conv, segment, kinds, digests, low, high, turns, seen in _read(batches):
            seen = set(seen or ())
            kinds = "".join(f"{int(k, 16) & 12 | COPY:x}" if int(k, 16) & 3 < COPY and d in seen else k for k, d in zip(kinds, digests))
            ways = [run(kinds, entry)[:2] for entry in range(4)]
            yield conv, segment, kinds, kinds[:1] + kinds[-1:], list(counts(kinds).values()), [c for costs, _ in ways for c in costs], [r for _, ranks in ways for r in ranks], low, high, turns

    return _batches(make(), _SUMMARY)


def _chain(table):
    """The states between the segments of one conversation on its cheapest way, and the conversation's numbers beside its last segment."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
    costs, ranks = [0, None, None, None], [0] * 4
    back = []
    total = [0, 0, 0, 0]
    low = high = None
    turns, last = 0, ""
    for row in rows:
        best: list = [None] * 4
        for i, cost in enumerate(costs):
            for j in range(4):
                more = row["costs"][4 * i + j]
                if cost is not None and more is not None:
                    way = (cost + more, ranks[i], row["ranks"][4 * i + j], i)
                    best[j] = way if best[j] is None or way < best[j] else best[j]
        back.append([way and way[3] for way in best])
        order = sorted((way[1:3], j) for j, way in enumerate(best) if way)
        costs, ranks = [way and way[0] for way in best], [0] * 4
        for place, (_, j) in enumerate(order):
            ranks[j] = place
        total = [a + b for a, b in zip(total, row["faults"])]
        total[3] += counts(last + row["ends"][:1])["illegal"]  # the pair between two segments
        last = row["ends"][-1:] or last
        turns += row["turns"] - (row["low"] is not None and row["low"] == high)
        low = row["low"] if low is None else low
        high = high if row["high"] is None else row["high"]
    exit_ = ending(costs, ranks)
    cost = costs[exit_] + INSERT * AFTER[STATES[exit_]]
    out = []
    for k, (row, from_) in enumerate(zip(rows[::-1], back[::-1])):
        numbers = (_gaps(low, high, turns), *total, cost) if k == 0 else [None] * 6
        out.append((row["segment"], from_[exit_], exit_, k == 0, *numbers))
        exit_ = from_[exit_]
    return pa.Table.from_batches(list(_batches(out, _PATH)))


def _edit(batches):
    """The edits of each segment between the two states it got."""

    def make():
        for conv, segment, kinds, roles, texts, entry, exit_, last, *numbers in _read(batches):
            own = trace(run(kinds, entry)[2], exit_)
            all_ = list(edited(own, roles, texts, entry, AFTER[STATES[exit_]] if last else 0))
            yield conv, segment, *([list(c) for c in zip(*all_)] if all_ else [[], [], []]), last, *numbers

    return _batches(make(), _EDITED)


def _digest(batches):
    """One row a conversation from its segments in order, read as a stream."""

    def make():
        sha, audit, empty = hashlib.sha256(), [], True
        for conv, _, edits, roles, texts, last, *numbers in _read(batches):
            audit.append("".join(edits))
            for edit, role, text in zip(edits, roles, texts):
                if edit != "D":
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if last:
                yield conv, *numbers, "".join(audit), sha.hexdigest()
                sha, audit, empty = hashlib.sha256(), [], True

    return _batches(make(), RESULT)


def _ordered(rows: DataFrame) -> DataFrame:
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_hash", "_row"]
    own = rows.select("conv_id", "turn", "role", "text", "copies", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    return own.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "copies")


def _edited_segments(segments: DataFrame) -> DataFrame:
    """The edits of conversations that lie in more than one segment, or may, segment by segment."""
    firsts = common.stage(segments.select("segment", "kinds", "digests").mapInArrow(_first_seen, "segment long, digest binary"), "turn-digests")
    earliest = firsts.groupBy("digest").agg(F.min("segment").alias("_first"))
    seen = firsts.join(earliest, "digest").where("segment != _first").groupBy("segment").agg(F.collect_list("digest").alias("seen"))  # SEGMENT_ROWS at most
    skeleton = segments.select("conv_id", "segment", "kinds", "digests", "low", "high", "turns").join(seen, "segment", "left")
    summaries = common.stage(skeleton.select("conv_id", "segment", "kinds", "digests", "low", "high", "turns", "seen").mapInArrow(_summaries, _SUMMARY), "turn-summaries")
    paths = summaries.drop("kinds").groupBy("conv_id").applyInArrow(_chain, _PATH)
    whole = segments.select("conv_id", "segment", "roles", "texts").join(summaries.select("segment", "kinds"), "segment").join(paths, "segment")
    return whole.select("conv_id", "segment", "kinds", "roles", "texts", *(c.split(" ")[0] for c in _PATH.split(", ")[1:])).mapInArrow(_edit, _EDITED)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text, copies): counts of faults, cost, audit, and the digest of what the edits give."""
    found = common.stage(_ordered(rows).mapInArrow(_segments(True), _SEGMENT), "turn-segments")
    spread = _edited_segments(found.where("segment is not null"))
    spread = spread.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_digest, RESULT)
    return found.where("segment is null").select(*(c.split(" ")[0] for c in RESULT.split(", "))).unionByName(spread)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, segment and place (their order), edit, role, text; deleted turns have edit D."""
    found = common.stage(_ordered(rows).mapInArrow(_segments(False), _SEGMENT), "turn-segments")
    turns = F.posexplode(F.arrays_zip("edits", "roles", "texts")).alias("place", "_t")
    return _edited_segments(found).select("conv_id", "segment", turns).select("conv_id", "segment", "place", F.col("_t.edits").alias("edit"), F.col("_t.roles").alias("role"), F.col("_t.texts").alias("text"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged table, a row for each original conversation."""
    return repair(damage(conversations))
