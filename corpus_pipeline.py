"""The corpus pipeline: five stages over documents, each written as Parquet before the next reads it.

1. toxicity: documents whose lexicon score reaches the threshold go; the lexicon is learned from the labelled rows
   outside the fold that is held out for measuring it.
2. line dedup: later copies of repeated runs of lines and of sentences are deleted to their ends; a document that loses all its lines goes, every
   other stays, and ``n_chars`` follows the text.
3. near-duplicates: of each group linked by five-word shingles at 0.8 or more, the document with the smallest id stays.
4. mixing: documents are repeated by Poisson numbers so that sources meet their target weights, and shuffled.
5. pieces: texts are encoded with their source offsets and decoded again.

Stages 1 to 4 return the columns of documents, in their order and with their values, whatever else they are called (only
text and n_chars change, in stage 2); stage 5 returns ids, offsets and decoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplight.llm import toxicity
from skiplight.llm.common import durable, numbered, place, restored
from skiplight.llm.line_dedup import dedup_lines
from skiplight.llm.mixing import replicate
from skiplight.llm.near_dup import near_duplicates
from skiplight.llm.pieces import encode_pieces
from skiplight.llm.queries import PIECES, crc_fold, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_fold("k", 4) != 2)
    return toxicity.drop_toxic(docs, lexicon)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = numbered(dedup_lines(docs, sentences=True))
    n = len(docs.columns)
    lines, removed, chars = (F.col(f"c{n + i}") for i in range(3))
    out = out.where((lines == 0) | (removed < lines))
    if "n_chars" in docs.columns:
        own = place(docs, "n_chars")
        out = out.withColumn(own, F.when(chars > 0, F.length(place(docs, "text")).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return restored(out, docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, shingle=5, num=80, den=100)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return restored(numbered(docs).join(gone, F.col(place(docs, "doc_id")).cast("long") == F.col("gone"), "left_anti"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # under numbered names no column of the input gives way to those that are added
    mixed = replicate(numbered(docs), id_col=place(docs, "doc_id"), source_col=place(docs, "source"), text_col=place(docs, "text"))
    return restored(mixed, docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode_pieces(docs, PIECES)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: A learned lexicon and the tokenizer's merges can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
