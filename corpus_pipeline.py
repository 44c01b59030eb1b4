"""A corpus from raw documents to packed token sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import common, ngram_join, packing, pii_crf, quality_gbt, rule_list


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more.

    Null and empty texts are scored like any other, equal rows alike; without usable labels every score is 0.5 and all stay.
    """
    model = quality_gbt.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return docs.where(quality_gbt.score(model)("text") >= 0.5).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and that no learned rule rejects.

    Null and empty texts have no words and fail the base test; without usable labels there are no rules beside it. Columns of
    any name keep their values.
    """
    learned = rule_list.fit(docs, common.read_table(spark, sf_dir, "labels"))
    own = [F.col(c).alias(f"_own_{c}") for c in docs.columns if c != "text"]
    judged = rule_list.judge(docs.select("text", *own), learned).where("kept")
    return judged.select(*(F.col("text" if c == "text" else f"_own_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id (null last), of each group of near copies.

    Of repeated rows one stays; rows without words (null, empty, blank) are near nothing and all stay.
    """
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by its kind; n_chars is counted anew.

    Null texts stay null with 0 characters; every row stays, repeated ones too.
    """
    field = pii_crf.fit(docs)
    out = docs.withColumn("text", pii_crf.redact(field)("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of at most 1024 tokens.

    Null and empty texts are one piece with the end id alone; repeated rows are packed as often as they occur.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", pack),
]

#: The stages learn from labels, compare word sets and run a tokenizer: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    folder = f"{common.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:  # a stage reads what the one before it wrote and nothing earlier
            common.drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
