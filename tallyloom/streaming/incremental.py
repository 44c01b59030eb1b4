"""The ledger of a store that grows: batches of whole sessions come in, and what they say replaces, adds to or withdraws what was known.

``ledger_index`` keeps partial aggregates by session. ``provisional`` answers while a store is still being read: each response has
the sessions that hold it as keyed state, and when another copy arrives what was billed before is taken back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators import ledger, partials
from tallyloom.streaming import upsert


def in_turn(spark: SparkSession, parts: Iterable[DataFrame], folder: str, start: Callable[[DataFrame], object]) -> None:
    """Let parts arrive in a folder one after another and run the query that ``start`` begins after each, from its own checkpoint: a restart between any two batches."""
    schema = None
    for k, part in enumerate(parts):
        part.write.mode("overwrite").parquet(f"{folder}/part={k:04d}")
        schema = schema or spark.read.parquet(f"{folder}/part={k:04d}").schema
        start(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)).awaitTermination()


def arriving_rows(lines: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """What a batch says of its sessions: their billed rows with the first time of each file; ``removed`` (slug, session_id) are gone."""
    kept = ledger.responses(lines)
    rows = ledger.billed_rows(kept).join(ledger.first_times(lines), "rel", "left").withColumn("gone", F.lit(False))
    there = lines.select("slug", "session_id").distinct()  # a session without a response is known too
    rows = there.join(rows.drop("slug"), "session_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return rows if removed is None else rows.unionByName(removed.select("slug", "session_id", F.lit(True).alias("gone")), allowMissingColumns=True)


def ledger_index(stream: DataFrame, table: str, checkpoint: str):
    """Keep the partial aggregates of each session in ``table``; a batch replaces those of its sessions, and sessions that are gone leave a tombstone."""

    def fold(batch: DataFrame) -> DataFrame:
        own = batch.where("not gone and msg_id is not null")
        return partials.partials(own.drop("gone", "first_at"), own.where("kind = 'main'").groupBy("rel").agg(F.min("first_at").alias("first_at")))

    return upsert.replace_by_key(stream, "session_id", fold, table, checkpoint)


def costs(spark: SparkSession, table: str, *keys: str) -> DataFrame:
    """Cost by scope of what the index has now: rates, channels and canonical copies are those of this moment."""
    return partials.cost(upsert.current(spark, table, "session_id"), ledger.rates(spark), *keys)


# Provisional results

_DELTA = "session_id string, requests long, unpriced long, tcu long, inherited long, contested long"
_NUMBERS = ("requests", "unpriced", "tcu", "inherited", "contested")


def holdings(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(key, session_id, place, own, first_at, requests, unpriced, tcu, gone): what each session would be billed for each response if it held it alone.

    Responses of other than main files can't be contested and have a key of their own; sidechain and synthetic rows are billed nowhere.
    """
    own = ledger.priced(rows.where("not gone and msg_id is not null"), table)
    main = F.col("kind") == "main"
    key = F.when(main, F.col("msg_id")).otherwise(F.concat_ws("\0", "rel", "msg_id"))
    bills = ~F.col("synthetic") & ~(main & F.col("sidechain"))
    mine = F.coalesce(F.col("recorded_session"), F.col("session_id")) == F.col("session_id")
    count = lambda on: F.count_if(on).cast("long")
    held = own.groupBy(key.alias("key"), "session_id").agg(F.min("rel").alias("place"), F.bool_and(mine).alias("own"), F.min("first_at").alias("first_at"), count(bills).alias("requests"), count(bills & F.col("unpriced")).alias("unpriced"), F.coalesce(F.sum(F.when(bills, F.col("tcu"))), F.lit(0)).cast("long").alias("tcu"))
    return held.withColumn("gone", F.lit(False))


def _billed(holders: dict) -> dict:
    """What each session has of one response: its numbers if it is billed for it, else as inherited."""
    if not holders:
        return {}
    own = [s for s, h in holders.items() if h["own"]]
    far = 2**62
    to = own[0] if len(own) == 1 else min(holders, key=lambda s: (far if holders[s]["first_at"] is None else holders[s]["first_at"], holders[s]["place"], s))
    many = int(len(holders) > 1)
    zero = {"requests": 0, "unpriced": 0, "tcu": 0, "inherited": 0}
    return {s: ({**zero, **{k: h[k] for k in ("requests", "unpriced", "tcu")}} if s == to else {**zero, "inherited": h["requests"]}) | {"contested": many} for s, h in holders.items()}


def _settle(key, frames, state: GroupState):
    """The change that a batch makes for one response: what it adds and what it takes back, session by session."""
    import pandas as pd

    holders = json.loads(state.get[0]) if state.exists else {}
    before = _billed(holders)
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.gone:
                holders.pop(r.session_id, None)
            else:
                holders[r.session_id] = {"place": r.place, "own": bool(r.own), "first_at": None if pd.isna(r.first_at) else int(r.first_at), "requests": int(r.requests), "unpriced": int(r.unpriced), "tcu": int(r.tcu)}
    after = _billed(holders)
    state.update((json.dumps(holders),))
    none = dict.fromkeys(_NUMBERS, 0)
    rows = [(s, *(after.get(s, none)[k] - before.get(s, none)[k] for k in _NUMBERS)) for s in sorted({*before, *after})]
    yield pd.DataFrame([r for r in rows if any(r[1:])], columns=["session_id", *_NUMBERS])


def provisional(stream: DataFrame, table: str, checkpoint: str):
    """Keep in ``table`` what each batch of ``holdings`` changes: their sum is what is billed so far. The state of a response is the sessions that hold it."""
    deltas = stream.groupBy("key").applyInPandasWithState(_settle, _DELTA, "holders string", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("session_id").agg(*(F.sum(c).cast("long").alias(c) for c in _NUMBERS))
        summed.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return deltas.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after_each(spark: SparkSession, table: str, arrived: DataFrame, of: int) -> DataFrame:
    """(batch, session_id, numbers so far, pending, complete, known, of) after every batch.

    ``arrived`` (batch, session_id) says when each session came in first. A store is complete when ``of`` sessions are known; until then a
    session with a contested response is pending, and none is afterwards.
    """
    deltas = spark.read.parquet(table)
    batches = arrived.select("batch").distinct()  # a row a batch
    grid = arrived.withColumnRenamed("batch", "_first").join(batches, F.col("batch") >= F.col("_first")).drop("_first")
    so_far = Window.partitionBy("session_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    own = grid.join(deltas, ["batch", "session_id"], "left").select("batch", "session_id", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).cast("long").alias(c) for c in _NUMBERS))
    known = grid.groupBy("batch").agg(F.count(F.lit(1)).alias("known"))
    own = own.join(known, "batch").withColumns({"of": F.lit(of).cast("long"), "complete": F.col("known") >= of})
    return own.withColumn("pending", ~F.col("complete") & (F.col("contested") > 0)).drop("contested")


# Problems

_PROBLEM = "code string, seq long, message string"


def problem_log(stream: DataFrame, table: str, checkpoint: str, most: int = 500):
    """Append problems (code, seq, message) and keep the last ``most`` of each code; the log is read from the last batch's folder."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = last_problems(spark, table, number)
        latest = Window.partitionBy("code").orderBy(F.desc("seq"), F.desc("message"))
        kept = before.unionByName(batch.select("code", "seq", "message")).withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= most).drop("_k")
        kept.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_problems(spark: SparkSession, table: str, below: int | None = None) -> DataFrame:
    """The log as the last batch (before batch ``below``) left it."""
    from tallyloom.streaming.versions import _names

    done = [k for k in map(int, _names(spark, table, r"batch=(\d+)", done=True)) if below is None or k < below]
    return spark.read.schema(_PROBLEM).parquet(f"{table}/batch={max(done)}") if done else spark.createDataFrame([], _PROBLEM)
