"""Stored extraction records: micro-batches merged in, any number of times, without a second copy of anything.

Records lie in partitions by a hash of chunk_id. A batch is merged with the stored records of its own partitions
alone, and those are swapped in by one dynamic overwrite, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut

PARTS = 64


def stored_records(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored records, None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def merge_records(path: str, new: DataFrame, batch: int, chunks: DataFrame | None = None, parts: int = PARTS) -> None:
    """Merges records(chunk_id, error, ...) of a batch into those at ``path``. A record without an error stands
    against one with, then the later batch counts; of equal ones the least by content. Ids that ``chunks`` doesn't
    have are dropped, of the partitions touched."""
    spark = new.sparkSession
    new = new.withColumn("batch", F.lit(batch).cast("long")).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    new = cut(new)
    touched = [r.part for r in new.select("part").distinct().collect()]
    if not touched:
        return
    old = stored_records(spark, path)
    every = new if old is None else old.where(F.col("part").isin(touched)).select(*new.columns).unionByName(new)
    if chunks is not None:
        every = every.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    rest = [c for c in new.columns if c not in ("chunk_id", "part")]
    order = F.struct(F.col("error").isNull(), "batch", F.xxhash64(*[F.col(c).cast("string") for c in rest if c != "batch"]))
    merged = cut(every.groupBy("chunk_id", "part").agg(F.max_by(F.struct(*rest), order).alias("r")).select("chunk_id", "r.*", "part"))
    # read, then swapped in: only the partitions that the batch touched
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def in_order(records: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """Records of known chunks in the order of chunks(chunk_id, <order>)."""
    return records.join(chunks.select("chunk_id", order), "chunk_id").orderBy(order).drop(order, "batch", "part")
