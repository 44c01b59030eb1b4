import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Rows that every operator must take: nulls, blanks, repeats, odd letters, clashing columns.
ODD = [
    (1, "plain words in a row that go on for a while and then stop", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \n\t ", "en"),
    (5, "Ünï çödé 日本語 \U0001f600 \x1c \x85  two  spaces \n\n 's 12.3", "de"),
    (6, "plain words in a row that go on for a while and then stop", "en"),
    (7, "a" * 70_000, "xx"),
    (8, "PLAIN words in a row that go on for a while and then stop", "en"),
    (9, " ".join(f"w{i}" for i in range(3000)), "en"),
    (9, " ".join(f"w{i}" for i in range(3000)), "en"),
    (10, "<|endoftext|> tail ", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    own = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return own.withColumns({"score": F.lit(1), "n_words": F.lit("clash"), "shard": F.lit(0), "key": F.lit("x"), "component": F.lit(0)})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
