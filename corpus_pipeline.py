"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

language_id     documents without a recognisable language go; lang becomes the language found
line_dedup      later copies of repeated runs of lines go, then of words, wherever in a line they start; so do
                documents of which nothing is left
jaccard_join    of each component of near duplicates the document with the least doc_id stays
mixing          documents are drawn by probabilities raked to the target shares
nbest           the N best segmentations of each text; the last stage returns their digest

Every stage but the last returns the columns of documents. Each stage's result is written as Parquet and
read again before the next one.

Edge cases: null and empty texts and those without letters have no language and go in the first stage; given
to a later one, they stay as they are, alone in their group, and are drawn by the probability of their cell.
A null doc_id is never a near duplicate and stays; a null lang is found, a null source is a source of its own,
a null n_chars stays null unless the text is cut. Repeated rows and repeated doc_ids are one document: what
happens to one of the rows happens to all of equal text, and the near-duplicate stage keeps all rows of the
doc_id that stands for a group (of equally good ones, ties, the least). Very long texts go through whole.
Further columns, whatever their names, are left out of every stage's result; an empty table gives an empty
result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaplens.llm.common import Scratch, read
from heaplens.llm.op1_language_id import UNKNOWN, language_id
from heaplens.llm.op5_mixing import mixed
from heaplens.llm.op7_line_dedup import WORD, line_dedup, passage_dedup
from heaplens.llm.op9_jaccard_join import jaccard_components
from heaplens.llm.op10_nbest import digest, nbest_segmentations
from heaplens.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Part of the tokens that the mixing stage keeps.
KEEP = 0.9
#: Results that SQL cannot express: EM, raking and segmentation are iterative. Tested against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id(docs, columns=COLUMNS).where(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup(docs).where((F.col("n_lines_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines = Scratch(spark, "lines-cut").table(line_stage(spark, docs, sf_dir), "lines")
    cut = passage_dedup(lines).where((F.col("n_words_deleted") == 0) | F.col("text").rlike(WORD))
    n_chars = F.when(F.col("n_words_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard_components(docs).where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, keep=KEEP).where("sampled").select(*[f"row.{c}" for c in COLUMNS])


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(nbest_segmentations(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", passage_stage),
    ("jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("nbest", segmentation_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
