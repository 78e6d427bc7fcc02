"""Reading, cutting lineage and sizing for the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_folder

__all__ = ["CHUNK_BYTES", "chunk_count", "chunked", "cut", "documents", "opened", "partitions", "shared_folder", "size_of", "stored", "swept", "table"]

#: Bytes of a table (as its files hold it) that one chunk of documents may take.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone. A row without a doc_id can't be named in a result and is left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def stored(df: DataFrame, name: str, codec: str = "zstd", **options) -> DataFrame:
    """Writes a table into the shared folder and reads it back, so that what follows reads files
    that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).options(**options).parquet(path)
    swept(spark)
    return spark.read.parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that nothing refers to any more: it only learns of them when
    the driver collects garbage, which a small driver with a long job may not do for hours."""
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes, from file sizes: no job runs. 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 60 else size


def chunk_count(df: DataFrame, bytes_each: int = CHUNK_BYTES) -> int:
    """Chunks to deal a table into: as many as shuffle partitions, or more where those would be large."""
    return max(1, partitions(df.sparkSession), min(1 << 24, -(-size_of(df) // bytes_each)))


def chunked(df: DataFrame, n: int) -> DataFrame:
    """(chunk, packed, size): documents dealt by a hash of doc_id, so that each pass finds them in their
    chunk. What a batch has for one chunk travels as one compressed blob, so shuffles move half the bytes
    and no row a document; ``opened`` gives the documents back."""

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            chunk = b.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            chunk, ids = chunk[order], b.column("doc_id").to_numpy()[order].astype(np.int64)
            text = pc.fill_null(pc.cast(b.column("text"), pa.large_binary()), b"").take(pa.array(order))
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2] or b"")
            cuts = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)].tolist()
            blobs = [b"".join((np.int64(z - a).tobytes(), ids[a:z].tobytes(), np.diff(offsets[a : z + 1]).tobytes(), data[offsets[a] : offsets[z]])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]], pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in blobs], pa.binary()), pa.array(list(map(len, blobs)), pa.int64())], names=["chunk", "packed", "size"])

    dealt = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("chunk"))
    return dealt.mapInArrow(pack, "chunk int, packed binary, size long")


def opened(rows: pa.Table) -> pa.Table:
    """A chunk's documents, null texts empty, in an order that a second run finds again: by doc_id, then text."""
    ids, lengths, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for blob, size in zip(rows.column("packed").to_pylist(), rows.column("size").to_pylist(), strict=True):
        raw = pa.decompress(blob, size, "zstd", asbytes=True)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids.append(np.frombuffer(raw, np.int64, n, 8))
        lengths.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
        texts.append(memoryview(raw)[8 + 16 * n :])
    offsets = np.r_[0, np.cumsum(np.concatenate(lengths))]
    text = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(texts))])
    table = pa.table({"doc_id": np.concatenate(ids), "text": text})
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
