"""Stores of many files: listed and read by tasks, a few tasks for many files."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import listing, logs, tail

from store import A, build


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for k in range(600):
        home = root / f"p{k % 7}" / f"{k:08d}-0000-4000-8000-000000000000"
        (home / "subagents" / "deep").mkdir(parents=True)
        home.with_suffix(".jsonl").write_text('{"type":"user"}\n' * (k % 3 + 1))
        (home / "subagents" / "agent-a1.jsonl").write_text("{}\n")
        (home / "subagents" / "deep" / "a b%20+é[1].txt").write_text("x" * k)
    (root / "top.txt").write_text("t")
    for hidden in (".h.jsonl", "_h.jsonl", "p0/_tmp/a.jsonl", "p0/.git/a.jsonl"):
        (root / hidden).parent.mkdir(exist_ok=True)
        (root / hidden).write_text("{}\n")
    return str(root)


def test_every_file_is_listed_with_its_size_and_time(spark, many):
    want = set()
    for folder, _, names in os.walk(many):
        for name in names:
            rel = os.path.relpath(os.path.join(folder, name), many)
            if not any(s[0] in "._" for s in rel.split("/")):
                stat = os.stat(os.path.join(many, rel))
                want.add((rel, stat.st_size, stat.st_mtime_ns // 1_000_000))
    for root in (many, f"file://{many}", f"{many}/"):
        own = logs.files(spark, root)
        assert {tuple(r) for r in own.select("rel", "size", F.unix_millis("mtime")).collect()} == want and own.count() == len(want)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and "binaryFile" not in plan  # no file source lists in the driver
    with pytest.raises(OSError):
        logs.files(spark, f"{many}/none")


def test_many_small_files_share_tasks(spark, many):
    own = logs._whole(spark, many)
    assert own.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert own.groupBy("rel").count().count() == 1200
    assert logs.texts(spark, many, ".txt").agg(F.count(F.lit(1)), F.sum(F.length("value"))).first()[:2] == (601, sum(range(600)) + 1)


def test_a_backlog_of_small_files_is_a_few_tasks(many):
    reader = tail._Reader(many)
    shares = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(shares) <= 2
    got = {}
    for share in shares:
        for rel, at, _ in reader.read(share):
            got.setdefault(rel, []).append(at)
    assert sum("/p" in f"/{rel}" and "subagents" not in rel for rel in got) >= 600
    assert all(got[f"p{k % 7}/{k:08d}-0000-4000-8000-000000000000.jsonl"] == [16 * i for i in range(k % 3 + 1)] for k in range(600))


def test_an_unchanged_file_is_not_opened_again(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\ntw")
    (tmp_path / "b.jsonl").write_bytes(b"x\n")
    reader, opened = tail._Reader(str(tmp_path)), []
    complete = reader._complete
    reader._complete = lambda fs, path, size: (opened.append(os.path.basename(path)), complete(fs, path, size))[1]
    first = reader.latestOffset()
    assert sorted(opened) == ["a.jsonl", "b.jsonl"] and reader.latestOffset() == first and len(opened) == 2
    with (tmp_path / "a.jsonl").open("ab") as f:
        f.write(b"o\n")
    os.remove(tmp_path / "b.jsonl")
    assert reader.latestOffset() == {"files": '{"a.jsonl": 8}'} and opened[2:] == ["a.jsonl"]


def test_plain_lines_are_the_same_from_whole_texts_and_from_spans(spark, tmp_path, monkeypatch):
    root = build(tmp_path)
    (root / "p" / "x [1].jsonl").write_bytes(b"\xef\xbb\xbfone\n\ntwo\r\nlast")
    own = lambda: sorted((r["rel"], r["value"]) for r in listing.plain_lines(spark, str(root)).collect() if r["value"])
    whole = own()
    assert [v for rel, v in whole if rel == "p/x [1].jsonl"] == ["last", "one", "two\r"] and sum(A in rel for rel, _ in whole) > 10
    monkeypatch.setattr(listing, "WHOLE", 0)
    assert own() == whole


def test_a_preview_counts_all_files(spark, tmp_path, monkeypatch):
    path = F.concat(F.lit("p/"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000.jsonl"))
    monkeypatch.setattr(logs, "files", lambda spark, root: spark.range(100_001).select(F.lit("main").alias("kind"), path.alias("session_id"), F.lit(2).alias("size")))
    assert tuple(logs.preview(spark, str(tmp_path)).first()) == (True, 100_001, 100_001, 200_002, False)
    assert tuple(logs.preview(spark, str(tmp_path), most=10).first())[1::3] == (10, True)
