"""Token ids in Parquet list columns, in ascending doc_id order, for selective reads.

A shard is one Parquet file: a range of doc_ids in order, with doc_id, the document's place in the
shard, its length and its ids as a list column. Row groups and pages have a set size, so a reader
that wants a few documents finds their pages by the column and offset indexes, and a reader of
lengths never touches ids. Ids are dictionary-encoded (two bytes or less each) or delta-packed.

Defined results: a null or empty text has the end id alone; rows that repeat a doc_id stand one behind
the other, in order of their text; rows without a doc_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunk_count, documents, shared_folder
from .kernels import lean, slabs, tidy
from .tokens import encoder

#: Bytes of text that are encoded at once: what a worker needs for it is some twenty times that.
SLAB = 4 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def token_rows(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int) -> DataFrame:
    """Shards as partitions: doc_id, place in the shard, n_tokens, tokens."""

    def encode(batches):
        place = 0
        for batch in batches:
            for s in slabs(batch.column("doc_id").to_numpy(), batch.column("text"), SLAB):
                ids, bounds = encoder(tokenizer, spaced).slab(s)
                n = len(s.ids)
                closed = np.full(len(ids) + n, end_id, np.int32)
                keep = np.ones(len(closed), bool)
                keep[bounds[1:] + np.arange(n)] = False
                closed[keep] = ids
                offsets = bounds + np.arange(n + 1)
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(closed))
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(offsets[:-1] + place), pa.array(np.diff(offsets)), tokens], schema=SCHEMA)
                place += int(offsets[-1])
            tidy()

    docs = documents(docs)
    return docs.repartitionByRange(chunk_count(docs), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(lean(encode), "doc_id long, place long, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, spaced: bool = True, end_id: int = 2, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 512) -> None:
    """Writes the shards below ``path``. ``encoding``: "dictionary", or "delta" for binary-packed deltas."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    # one file a shard, whatever the session says: places count from a file's first id
    options = {"maxRecordsPerFile": 0, "compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0", "parquet.dictionary.page.size": 1 << 20}
    token_rows(docs, tokenizer, spaced, end_id).write.options(**options).parquet(path)


def shard_bases(df: DataFrame) -> DataFrame:
    """(file, base): ids in all shards before; one row a shard. Reads lengths only."""
    per = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(df: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start over all shards, n_tokens and tokens, of all documents or some; the filter on
    doc_id reaches the row-group and page indexes."""
    rows = df.select(F.col("_metadata.file_path").alias("file"), "doc_id", "place", "n_tokens", "tokens")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(shard_bases(df), "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "tokens")


def token_digests(df: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches):
        for b in batches:
            tokens = b.column("tokens")
            flat, ends = tokens.flatten().to_numpy().astype("<u4"), np.r_[0, np.cumsum(pc.list_value_length(tokens).to_numpy())]
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file").cast(pa.string()), b.column("doc_id"), b.column("place"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], schema=schema)

    rows = df.select(F.col("_metadata.file_path").alias("file"), "doc_id", "place", "tokens").mapInArrow(lean(digest), "file string, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(shard_bases(df), "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes all documents into the shared folder and returns what its files say."""
    spark = docs.sparkSession
    import uuid

    path = f"{shared_folder(spark)}/tables/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id=end_id)
    return token_digests(spark.read.schema("doc_id long, place long, n_tokens long, tokens array<int>").parquet(path))
