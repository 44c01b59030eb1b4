from pyspark.sql import functions as F

from tallyloom.sources import tail
from tallyloom.sources.tail import LogTail
from tallyloom.streaming import upsert


def test_tail_reads_complete_lines_once_as_files_grow(spark, tmp_path):
    root, out = tmp_path / "logs", tmp_path / "out"
    (root / "p").mkdir(parents=True)
    log = root / "p" / "a.jsonl"
    log.write_bytes(b"one\ntwo\nthr")
    spark.dataSource.register(LogTail)

    def turn():
        q = spark.readStream.format("log_tail").load(str(root)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.read.parquet(str(out)).orderBy("rel", "byte_offset").collect()]

    assert turn() == [("p/a.jsonl", 0, "one"), ("p/a.jsonl", 4, "two")]
    with log.open("ab") as f:
        f.write(b"ee\r\nfour")
    (root / "p" / "b.jsonl").write_bytes("é\n".encode())
    assert turn() == [("p/a.jsonl", 0, "one"), ("p/a.jsonl", 4, "two"), ("p/a.jsonl", 8, "three"), ("p/b.jsonl", 0, "é")]


def test_spans_of_a_large_file_give_each_line_once(tmp_path, monkeypatch):
    import random

    rng = random.Random(4)
    body = b"".join(b"x" * rng.choice([0, 1, 5, 30, 200]) + rng.choice([b"\n", b"\r\n"]) for _ in range(300))
    (tmp_path / "a.jsonl").write_bytes(body + b"tail")
    want = [x.removesuffix(b"\r").decode() for x in body.split(b"\n")[:-1]]
    for most in (7, 64, 1 << 20):
        monkeypatch.setattr(tail, "MOST", most)
        reader = tail._Reader(str(tmp_path))
        end = reader.latestOffset()
        got = [line for span in reader.partitions(reader.initialOffset(), end) for line in reader.read(span)]
        assert [t for _, _, t in got] == want and all(body[at : at + len(t)] == t.encode() for _, at, t in got)
        # A new reader, as after a restart, goes on where the last one was.
        again = tail._Reader(str(tmp_path))
        assert again.latestOffset() == end and again.partitions(end, again.latestOffset()) == []


def test_upsert_replaces_and_retracts_by_key(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    fold = lambda df: df.where("v > 0").groupBy("k").agg(F.sum("v").alias("total"))
    for batch in ([("a", 1), ("a", 2), ("b", 5)], [("a", 7)], [("b", -1)]):
        spark.createDataFrame(batch, "k string, v long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v long").parquet(source)
        upsert.replace_by_key(stream, "k", fold, table, str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in upsert.current(spark, table, "k").collect()] == [("a", 7)]
    upsert.compact(spark, table, "k", str(tmp_path / "compact"))
    assert upsert.current(spark, str(tmp_path / "compact"), "k").count() == 1
