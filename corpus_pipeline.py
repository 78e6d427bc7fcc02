"""A training-text pipeline over ``documents``: each stage works on all that the one before kept.

Rows without a doc_id are no documents and end at the first stage. Rows that share a doc_id are one
document to the near-duplicate stage, which keeps one of them, the first by text. Extra columns pass through all stages
but the last, which returns the pieces of packed sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import stored, table
from kgraph.llm.decontaminate import decontaminate
from kgraph.llm.jaccard_join import jaccard_components
from kgraph.llm.line_dedup import dedup_lines
from kgraph.llm.packing import best_fit_packing
from kgraph.llm.quality import accepted
from kgraph.llm.queries import vocabulary


def _fresh() -> str:
    """A column name that no input has."""
    return f"_{uuid.uuid4().hex}"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this corpus, scores 0.3 or more."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere already. A document that loses all its lines goes;
    n_chars, where there is such a column, follows the text."""
    total, gone = _fresh(), _fresh()
    lines = dedup_lines(docs, counts=(total, gone)).where((F.col(gone) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        lines = lines.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return lines.select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group linked by five-word shingles at 0.8 or more.
    At this threshold a set sends twice as many keys as at 0.9, and stages write denser files: smaller chunks."""
    groups = stored(jaccard_components(docs, k=5, num=80, den=100, chunk_bytes=2 << 20), "groups")
    own = _fresh()
    ids = groups.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(ids, F.col("doc_id").cast("long") == F.col(own), "left_semi")
    if groups.count() != groups.select("doc_id").distinct().count():
        first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
        kept = kept.withColumn(own, F.row_number().over(first)).where(F.col(own) == 1)
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, keep=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in as few sequences as best fit finds."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"), context=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", packing),
]

#: A trained model, SimHash and a tokenizer are no SQL; tests/llm/test_pipeline.py recomputes each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
