"""The corpus pipeline: stages applied one after the other, each written and read again.

1. language: documents in which no language is found go (no letter); mixed text stays, whatever the
   shares of its languages.
2. exact: of equal texts the row with the largest doc_id stays.
3. near: of near copies (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays.
4. passages: passages of 50 words and more that an earlier document has are taken out; a
   document of nothing else goes.
5. packing: sequences of at most 4096 token ids.

All stages but the last return the columns of documents. Null texts and texts without a letter go
in the first stage; rows with a null id and rows that share one are documents like others, of which
stages 2 and 3 keep one of a group, the choice among equals being free; empty tables pass through.

A stage begins when the result of the one before is written: it removes the tables that led there.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import chunk_dedup, exact_dedup, language, near_dedup, packing
from webgrain.llm.scratch import cut, step
from webgrain.ship import ship


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    found = language.found(spark, F.col("text"), model, with_spans=False)
    return docs.select(F.struct("*").alias("_row"), found.alias("_found")).where(F.col("_found.lang_pred") != language.UNKNOWN).select("_row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = cut(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_key")), "exact-rows")
    own = rows.select("_key", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    gone = exact_dedup.exact_dedup(own, row_col="_key").where("not kept").select(F.col("row_id").alias("_key"))
    return rows.join(gone, "_key", "left_anti").select("_row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken, removed = {c.lower() for c in docs.columns}, "_removed"
    while removed in taken:
        removed += "_"
    cleaned = chunk_dedup.dedup_passages(docs, removed_col=removed)
    changed = F.col(removed).isNotNull()
    left = cleaned.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes()
    return packing.pack(docs, vocabulary, end_id=2, max_len=4096).withColumn("ids_crc32", F.crc32("ids"))


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with step(ship(spark)):
            return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("language", language_stage), ("exact", exact_stage), ("near", near_stage), ("passages", passage_stage), ("packing", packing_stage))]

#: Language identification, fingerprints and chunks have no SQL form; tests compare the exact, near and passages stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
