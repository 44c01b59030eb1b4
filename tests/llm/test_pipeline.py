import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = start = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == start.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert start.count() > counts[0] >= counts[1] > counts[2] == counts[3] <= counts[4]
    placed = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in placed) <= 1024


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages_take_null_empty_long_and_repeated_rows_and_other_columns(spark, odd):
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("_t"), F.lit(2).alias("kept"), F.lit(3).alias("component_id"))
    docs = docs.unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    for own in (docs, docs.where("false")):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, own, DATA)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
            got = out.collect()
            if own is not docs:
                assert got == [], name
            elif name == "near_duplicates":
                # 1, 6 and 8 are one text but for case, 9 stands there three times; texts without words all stay.
                assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, (1, 2, 3, 4, 5, 7, 9, 10)))
            elif name == "personal_data":
                assert sorted(map(str, got)) == sorted(map(str, own.withColumn("n_chars", F.coalesce("n_chars", F.lit(0).cast("long"))).collect()))
            elif name == "best_fit_packing":
                assert {r["doc_id"] for r in got} == {*range(1, 11), None}
