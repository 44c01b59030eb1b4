import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ledger, partials, search
from tallyloom.sources import logs
from tallyloom.streaming import incremental, versions

from store import A, B, TCU_A, TCU_B, build


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    return logs.lines(spark, str(build(tmp_path_factory.mktemp("store")))).cache()


def same(a, b):
    assert set(a.columns) == set(b.columns)
    b = b.select(*a.columns)
    key = lambda r: str(tuple(r)[:2])
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_cost_of_partials_is_the_cost_of_the_ledger(spark, lines):
    fresh = ledger.ledger(lines)
    kept = partials.partials(ledger.billed_rows(ledger.responses(lines)), ledger.first_times(lines))
    for keys in (("session_id",), ("slug",), ("session_id", "model")):
        same(partials.cost(kept, ledger.rates(spark), *keys), ledger.cost(fresh, *keys))
    assert kept.where("not main").agg(F.sum("requests")).first()[0] > 0 and kept.where("not main and msg_id is not null").count() == 0


def test_index_after_additions_changes_and_removals_is_a_fresh_run(spark, lines, tmp_path):
    first, less = lines.where(F.col("session_id") == B), lines.where((F.col("session_id") == A) & (F.col("line") < 9))
    gone = lambda s: spark.createDataFrame([("p", s)], "slug string, session_id string")
    steps = [(first, None, first), (lines, None, lines), (less, None, less.unionByName(first)), (lines.where("false"), gone(A), first), (lines.where(F.col("session_id") == A), gone(B), lines.where(F.col("session_id") == A))]
    table, state = f"{tmp_path}/table", f"{tmp_path}/state"
    for k, (rows, removed, now) in enumerate(steps):
        incremental.arriving_rows(rows, removed).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/part={k}").schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        incremental.ledger_index(stream, table, state).awaitTermination()
        same(incremental.costs(spark, table, "session_id"), ledger.cost(ledger.ledger(now), "session_id"))


def test_provisional_totals_take_back_what_another_copy_changes(spark, lines, tmp_path):
    held = incremental.holdings(incremental.arriving_rows(lines), ledger.rates(spark)).cache()
    gone = held.where(F.col("session_id") == A).withColumn("gone", F.lit(True))
    parts = [held.where(F.col("session_id") == B), held.where(F.col("session_id") == A), gone]
    table = f"{tmp_path}/table"
    incremental.in_turn(spark, parts, f"{tmp_path}/in", lambda s: incremental.provisional(s, table, f"{tmp_path}/state"))
    arrived = spark.createDataFrame([(0, B), (1, A), (2, A)], "batch int, session_id string").groupBy("session_id").agg(F.min("batch").alias("batch"))
    arrived = arrived.unionByName(spark.createDataFrame([("none", 2)], "session_id string, batch int"))
    got = {(r["batch"], r["session_id"]): (r["tcu"], r["inherited"], r["pending"], r["complete"], r["known"]) for r in incremental.after_each(spark, table, arrived, 3).collect()}
    whole = TCU_B + 30_000_000  # m1 is B's own while A isn't known
    assert got[0, B] == (whole, 0, False, False, 1)
    assert got[1, A] == (TCU_A, 0, True, False, 2) and got[1, B] == (TCU_B, 1, True, False, 2)
    assert got[2, A][0] == 0 and got[2, B] == (whole, 0, False, True, 3) and got[2, "none"][0] == 0


def snapshot(spark, **own):
    return spark.createDataFrame([(k, "p", v) for k, v in own.items()] or [("", "", "")], "session_id string, slug string, fingerprint string").where("session_id <> ''")


def told(df):
    return None if df is None else sorted((r["session_id"], r["change"]) for r in df.collect())


def test_versions_say_what_changed_since_a_cursor(spark, tmp_path):
    folder = f"{tmp_path}/v"
    assert versions.cursor(spark, folder) is None and versions.since(spark, folder, None) == (None, None)
    a, one = versions.commit(spark, folder, snapshot(spark, x="1", y="1"))
    assert told(one) == [("x", "added"), ("y", "added")]
    b, two = versions.commit(spark, folder, snapshot(spark, x="2", z="1"))
    assert told(two) == [("x", "changed"), ("y", "removed"), ("z", "added")]
    assert versions.commit(spark, folder, snapshot(spark, x="2", z="1")) == (b, None) and b == (a[0], 1)
    assert versions.since(spark, folder, b) == (b, None)
    assert told(versions.since(spark, folder, a)[1]) == told(two)
    everything = [("x", "added"), ("z", "added")]
    for odd in (None, ("other", 1), (b[0], 9)):
        assert told(versions.since(spark, folder, odd)[1]) == everything
    # A commit that was broken off doesn't count, and the next one takes its place.
    snapshot(spark, w="1").withColumn("change", F.lit("added")).write.parquet(f"{folder}/boot={b[0]}/version=2")
    (tmp_path / "v" / f"boot={b[0]}" / "version=2" / "_SUCCESS").unlink()
    assert versions.cursor(spark, folder) == b
    c, three = versions.commit(spark, folder, snapshot(spark, x="2"))
    assert c == (b[0], 2) and told(three) == [("z", "removed")]
    again = versions.boot(spark, folder)
    assert again[0] > b[0] and versions.cursor(spark, folder) == again and told(versions.commit(spark, folder, snapshot(spark, x="2"))[1]) == [("x", "added")]


def test_stale_sessions_are_told_once_until_the_next_version(spark, tmp_path):
    folder = f"{tmp_path}/v"
    versions.commit(spark, folder, snapshot(spark, x="1", y="1"))
    assert told(versions.stale(spark, folder, snapshot(spark, x="2", y="1"))) == [("x", "changed")]
    assert told(versions.stale(spark, folder, snapshot(spark, x="3", y="1"))) == []
    assert told(versions.stale(spark, folder, snapshot(spark, x="3"))) == [("y", "removed")]
    versions.commit(spark, folder, snapshot(spark, x="3", y="1"))
    assert told(versions.stale(spark, folder, snapshot(spark, x="4", y="1"))) == [("x", "changed")]


def test_problem_log_is_capped_by_code_and_outlives_its_query(spark, tmp_path):
    part = lambda code, *seqs: spark.createDataFrame([(code, s, f"{code}{s}") for s in seqs], "code string, seq long, message string")
    parts = [part("a", 1, 2, 3).unionByName(part("b", 9)), part("a", 4), part("b", 10, 11, 12)]
    incremental.in_turn(spark, parts, f"{tmp_path}/in", lambda s: incremental.problem_log(s, f"{tmp_path}/log", f"{tmp_path}/state", 3))
    got = sorted((r["code"], r["seq"]) for r in incremental.last_problems(spark, f"{tmp_path}/log").collect())
    assert got == [("a", 2), ("a", 3), ("a", 4), ("b", 10), ("b", 11), ("b", 12)]


def test_a_search_is_taken_up_where_it_stopped(spark):
    files = [("s1", "p/s1.jsonl", "main", 50), ("s1", "p/s1/a.jsonl", "agent", 90), ("s2", "p/s2.jsonl", "main", 70), ("s3", "p/s3.jsonl", "main", 70), ("s4", "p/s4.jsonl", "main", 10)]
    listing = lambda rows: spark.createDataFrame(rows, "session_id string, rel string, kind string, mtime long")
    hits = spark.createDataFrame([(s, rel, k, line) for s, rel, k, _ in files for line in (1, 2, 10)], "session_id string, rel string, kind string, line long")
    order = [(rel, line) for rel in ("p/s1.jsonl", "p/s1/a.jsonl", "p/s2.jsonl", "p/s3.jsonl", "p/s4.jsonl") for line in (1, 2, 10)]
    page = lambda rows, cursor, most: [(r["rel"], r["line"], r["cursor"]) for r in search.scan(hits, listing(rows), cursor, most).collect()]
    for size in (4, 100):
        got, cursor = [], None
        while rows := page(files, cursor, size):
            got += [r[:2] for r in rows]
            cursor = rows[-1][2]
        assert got == order
    cursor = page(files, None, 8)[-1][2]  # in s2
    moved = [f if f[0] != "s1" else (*f[:3], 95) for f in files]  # searched, then changed: again
    assert [r[:2] for r in page(moved, cursor, 100)] == order[:6] + order[8:]
    moved = [f if f[0] != "s4" else (*f[:3], 95) for f in files]  # not searched yet, now first
    assert [r[:2] for r in page(moved, cursor, 100)] == order[12:] + order[8:12]
    for time, want in ((5, order[9:] + [order[8]]), (95, order[8:])):  # its own session has moved: the rest is what it was
        moved = [f if f[0] != "s2" else (*f[:3], time) for f in files]
        assert [r[:2] for r in page(moved, cursor, 100)] == want
    for bad in ("", "x", cursor[:-4]):
        with pytest.raises(search.StaleCursor):
            search.scan(hits, listing(files), bad)
    with pytest.raises(search.StaleCursor):
        search.scan(hits, listing([f for f in files if f[0] != "s2"]), cursor)
