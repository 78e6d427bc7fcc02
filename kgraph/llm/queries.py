"""The registered queries of this subpackage: thin uses of its operators on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import SQL as PHRASES_SQL
from .collocations import collocations
from .common import table
from .decontaminate import decontaminate
from .jaccard_join import jaccard_components
from .license_scan import license_scan
from .line_dedup import dedup_lines
from .media import text_media
from .packing import best_fit_packing
from .quality import quality_scores
from .simhash_dedup import simhash_components
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import tokens_round_trip
from .turns import SQL as TURNS_SQL
from .turns import reassembled, replayed


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; operators get the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=13, with_text=False)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents"), similarity=0.8, radius=3, bands=14)
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), context=4096, end_id=1)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), least=200, with_bytes=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = reassembled(replayed(table(spark, sf_dir, "conversations"), batches=12), batches=12, idle=3)
    said = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(F.col("payload"))
    return events.select("event", F.sha2(said.cast("binary"), 256).alias("sha256"), "conv_id", "turn", "batch", "n_missing", "n_breaks")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_substring_dedup, op2_quality_classifier, op3_line_dedup, op4_license_scan, op5_best_fit_packing, op6_suffix_array_dedup, op7_token_files, op8_decontamination, op9_media_columns, op10_jaccard_join, op11_conversation_turns, op12_phrase_collocations, op13_simhash_dedup)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_turns": TURNS_SQL, "op12_phrase_collocations": PHRASES_SQL}
