"""A training corpus from raw documents: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
`run` writes each stage's result as a table in the shared folder and reads it again for the next.  All
stages but the last return the columns of documents; the last returns the packed pieces.

In all stages texts of any length are taken whole, an empty table gives no rows, and columns other than
doc_id and text pass through the filtering stages under their names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.llm import decontam, language_id, line_dedup, near_dedup, packing
from lexisift.llm.common import drop_staged, scope, staged
from lexisift.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from those not held out.

    A null text, one without a letter, and every text where nothing can be learned, goes; rows are judged each on
    their own, so repeated rows stay or go together; a null lang is not learned from."""
    return language_id.keep_known(docs, language_id.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere already; those left without a line go.

    Null texts and texts of blank lines stay as they are; of similar lines the first by doc_id (null first), text hash
    and place stays; rows with equal doc_id and text are one document and keep the same lines."""
    return line_dedup.dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8.

    Texts without words (null, empty) all stay; the least doc_id of a group stays (a null one only where there is
    no other), and of several texts with it that of the least hash; of repeated rows with words one stays."""
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated (a hit word in twenty) and hold no run of 13 hit words.

    Null and empty texts have no words and stay; rows are judged each on their own; benchmark items without words have
    no windows, those without an item_id are searched too, and an empty benchmark leaves every document."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, with a checksum of each piece's ids.

    A null or empty text is its end id alone; repeated rows are packed each on their own; a null doc_id stays null; of
    open windows with equal room the first takes a piece; other columns are ignored."""
    from public_tokenizers import path

    pieces = packing.pack_documents(docs, path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near", near), ("clean", clean), ("pack", pack)]

#: The first and last stages are a trained model and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:  # what a stage staged goes once its result is written, and so does its predecessor's
            after = keep(staged(stage(spark, docs, sf_dir), f"stage-{name}"))
        drop_staged(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
