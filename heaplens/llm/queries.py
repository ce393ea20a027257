"""One query per corpus operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heaplens.llm.common import read


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op1_language_id import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op2_quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op3_pii import personal_data

    return personal_data(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op4_secret_scan import secret_scan

    return secret_scan(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.common import Scratch
    from heaplens.llm.op5_mixing import calibrated, cells_of, drawn, measured

    m = measured(read(spark, sf_dir, "documents")).withColumn("row", F.struct("row.doc_id"))
    m = Scratch(spark, "mixing").table(m, "measured")
    return drawn(m, calibrated(cells_of(m))).select("row.doc_id", "source", "lang", "topic", "tokens", "ratio", "probability", "sampled")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op6_media import media_column, media_features

    return media_features(media_column(read(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op7_line_dedup import line_dedup, words_in

    cut = line_dedup(read(spark, sf_dir, "documents"))
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return cut.select("doc_id", "n_lines_deleted", n_lines.cast("long").alias("n_lines_left"), F.coalesce(words_in(F.col("text")), F.lit(0)).cast("long").alias("n_words_left"), F.sha2("text", 256).alias("text_sha256"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op8_token_output import token_output

    return token_output(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op9_jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op10_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heaplens.llm.op10_nbest import digest, nbest_segmentations

    return digest(nbest_segmentations(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_pii, op4_secret_scan, op5_mixing, op6_media, op7_line_dedup, op8_token_output, op9_jaccard_join, op10_nbest)}


def oracle_sql() -> dict[str, str]:
    from heaplens.llm.oracle import SQL

    return dict(SQL)
