"""Incremental extraction as a stream: new chunk files in, each micro-batch's records merged into the stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .records import merge_records, stored_records


def extract_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], retry_failed: bool = False) -> StreamingQuery:
    """Starts the query and returns it; it ends when all present files are read. Chunks that have a record are
    skipped, with ``retry_failed`` only if it has no error. A record without a column error has none. A batch that is
    run again finds its chunks done, or merges the same records again."""

    def batch(df: DataFrame, epoch: int) -> None:
        fresh, done = df.dropDuplicates(["chunk_id"]), stored_records(spark, sink)
        if done is not None:
            settled = done.where(F.col("error").isNull()) if retry_failed else done
            # what this very batch has stored before a failure is done again
            fresh = fresh.join(settled.where(F.col("batch") != epoch).select("chunk_id"), "chunk_id", "left_anti")
        records = extract(fresh)
        if "error" not in records.columns:
            records = records.withColumn("error", F.lit(None).cast("string"))
        merge_records(sink, records, epoch)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
