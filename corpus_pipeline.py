"""The corpus pipeline: from raw documents to token files, in five stages.

Each stage is a function of (spark, docs, sf_dir). All but the last return the
columns of ``documents``; each works on what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import (
    op3_decontaminate,
    op4_language,
    op6_near_duplicates,
    op8_token_files,
    op10_mixing,
)
from framewright.session import shared_path, stage_scope

SHINGLE_WORDS = 5
SIMILARITY = 80
TOKENIZER = "byte_bpe_50k.json"
# Texts encoded and rows sent together: the executors' memory is shared with what the stages before left.
TOKEN_SLICE_BYTES, TOKEN_BATCH_ROWS = 1 << 20, 1_000

# The classifier, the mix and the token ids can't be expressed in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or without a clear language go."""
    return op4_language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id, and one of rows that repeat it.

    Documents without an id are in no group; of those with equal texts one stays.
    """
    groups = op6_near_duplicates.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)
    kept = groups.filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates(
        ["doc_id", "text"]
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return op3_decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row for each time one is taken, shuffled inside the shards."""
    return op10_mixing.mix(docs).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; per row what is read back from them."""
    path = shared_path(spark, "tokens")
    tokenizer = public_tokenizers.path(TOKENIZER)
    op8_token_files.write_tokens(
        docs, path, tokenizer, kept_words=0, slice_bytes=TOKEN_SLICE_BYTES, batch_rows=TOKEN_BATCH_ROWS
    )
    return op8_token_files.token_digests(op8_token_files.read_tokens(spark, path))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again.

    What a stage writes for itself is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with stage_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
