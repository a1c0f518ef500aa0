"""Corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir) on the rows that its predecessor kept. All but the last return
the columns of ``documents``; the last returns the packed pieces.

Defined results: rows with a null or blank text fail the quality rules; rows with a null id are judged like all others (toxicity
never learns from them) and of equal texts one row stays, the one with the smallest id, null ids last; rows that are repeated whole
become one; rows that share an id but not a text are told apart; columns beside id and text go along untouched, whatever their
names; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgrid.functions.lineage import passing_checkpoints, remove, shared_folder
from loomgrid.llm.common import read
from loomgrid.llm.near_dedup import keep_one
from loomgrid.llm.packing import pack
from loomgrid.llm.quality import keep_good
from loomgrid.llm.queries import tokenizer_file
from loomgrid.llm.toxicity import keep_clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]

#: EM, a trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. They run when this is called, not when the result is used: what a stage keeps is stored in the shared
    folder for the next one; its checkpoints, and what its predecessor had stored, are removed then. In the end the packed
    pieces alone are left there, as the table that the result reads."""
    docs, stored = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        with passing_checkpoints(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if stored:
            remove(spark, stored)
        stored = f"{folder}/{name}"
        docs = spark.read.parquet(stored)
    return docs
