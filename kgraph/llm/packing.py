"""Best-fit packing of token sequences, with bins certified by dual feasible functions.

Documents are tokenised once to pieces of at most the context length; from there on only lengths move.
Pieces are dealt into partitions of bounded size, each packed by best-fit decreasing. Dual feasible
functions bound the bins of a partition from below; one whose count equals its bound is certified and
keeps its bins, but for its emptiest, whose bin the sum of several partitions may save. What is left
(the pieces of open bins in partitions with a gap, and those emptiest bins) is exchanged: dealt anew
into an eighth of the partitions and packed again, until one partition is left.

Defined results: a null or empty text is the end id alone; equal rows are packed each by itself; rows
without a doc_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, stored
from .kernels import slabs
from .tokens import encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())])
PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long, sequence_id long, offset long, open boolean"
#: Pieces that one partition packs: 50,000 rows of a few numbers, some MB.
PARTITION_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer: str, context: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ``deal``, a fixed random number)."""

    def cut_up(batches):
        for batch in batches:
            for s in slabs(batch.column("doc_id").to_numpy(), batch.column("text"), 8 << 20):
                ids, bounds = encoder(tokenizer, False).slab(s)
                out: list[tuple] = []
                for i, doc_id in enumerate(s.ids.tolist()):
                    own = np.r_[ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)].astype("<u4")
                    for k, start in enumerate(range(0, len(own), context)):
                        part = own[start : start + context]
                        crc = zlib.crc32(part)
                        out.append((doc_id, k, start, len(part), crc, zlib.crc32(b"%d %d %d" % (doc_id, k, crc))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    return documents(docs).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the room left in each bin. Open bins wait by their room; one
    integer's bits tell which rooms there are, so the tightest is found in one step."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The greatest bound of the families of dual feasible functions of Fekete and Schepers (2001): a
    function f with sum f(x) <= 1 wherever sum x <= 1 makes the sum of f over all items a bound."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 51):  # u^(k): rounds down to k-ths unless (k + 1) x is whole
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    large = np.cumsum(count[::-1])[::-1]
    weight = np.cumsum(count * x)
    for e in range(0, capacity // 2 + 1):  # U^(e): over 1 - e counts whole, under e not at all
        over = capacity - e
        more = int(large[over + 1]) if over < capacity else 0
        best = max(best, more + -(-int(weight[over] - (weight[e - 1] if e else 0)) // capacity))
    for e in np.unique(np.minimum(lengths, capacity // 2)).tolist():  # phi^(e): what is left over a large item, in units of e
        if e:
            n = capacity // e
            value = np.where(2 * x > capacity, 2 * (n - (capacity - x) // e), np.where(2 * x == capacity, n, 2 * (x // e)))
            best = max(best, -(-int((count * value).sum()) // (2 * n)))
    return best


def _packer(turn: int, last: bool, context: int, columns: list[str]):
    def pack(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("piece").to_numpy(), rows.column("doc_id").to_numpy(), rows.column("deal").to_numpy()))
        rows = rows.take(pa.array(order))
        lengths = rows.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, context)
        certified = len(left) == lower_bound(lengths, context)
        open_bin = np.zeros(len(left), bool)
        if not last:
            open_bin |= (left > 0) & (not certified)
            open_bin[np.argmax(left)] |= left.max() > 0
        number = (turn << 56) + (rows.column("part")[0].as_py() << 24) + bins
        return pa.Table.from_arrays([*(rows.column(c) for c in columns), pa.array(number), pa.array(offsets), pa.array(open_bin[bins])], names=[*columns, "sequence_id", "offset", "open"])

    return pack


def best_fit_packing(docs: DataFrame, tokenizer: str, context: int = 4096, end_id: int = 1, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
    todo = stored(pieces(docs, tokenizer, context, end_id), "pieces")
    full = todo.where(F.col("length") == context)
    # a whole sequence needs no packing; packed ones are numbered from 2**56 on
    result = stored(full.select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset")), "whole")
    todo = todo.where(F.col("length") < context)
    n = max(1, -(-todo.count() // partition_rows))
    turn = 1
    while True:
        last = n == 1

        packed = todo.withColumn("part", F.pmod(F.xxhash64("deal", "doc_id", F.lit(turn)), F.lit(n))).groupBy("part").applyInArrow(_packer(turn, last, context, columns), PACKED_DDL)
        if last:
            return result.drop("deal").unionByName(packed.drop("deal", "open"))
        packed = stored(packed, "packed")
        result = result.unionByName(packed.where(~F.col("open")).drop("open"))
        todo = cut(packed.where("open").select(*columns))
        n, turn = -(-n // 8), turn + 1


def report(packed: DataFrame, context: int = 4096) -> tuple[int, int]:
    """Sequences used, and the bound for all pieces at once, from a histogram of at most ``context`` lengths."""
    hist = packed.groupBy("length").count().collect()
    bound = lower_bound(np.repeat([r["length"] for r in hist], [r["count"] for r in hist]) if hist else np.zeros(0, np.int64), context)
    return packed.select("sequence_id").distinct().count(), bound
