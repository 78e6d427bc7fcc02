"""Benchmark decontamination by suffix arrays over the training text.

A test set is cut into blocks of bounded size; each block's words, windows and items go to the workers
as one small broadcast value. A worker lays a slab of documents end to end as word numbers of that
block and sorts the suffixes that can begin a window (those whose first words do in some item; no
other suffix can match). Every window of every item is binary-searched in that suffix array, and what
is found is compared as words and followed to its longest verbatim match.

Defined results: null and empty texts have no words and are never contaminated; items without words
match nothing; equal items are each listed; rows that repeat a document are judged each by itself;
rows without a doc_id, items without an item_id, are left out; with an empty test set nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .kernels import LOWER, NOT_ALNUM, Slab, covered, lean, slabs, word_bounds, word_hashes

#: Text of one block of the test set, in bytes; each block is broadcast by itself.
BLOCK_BYTES = 16 << 20
FOUND = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
FOUND_DDL = "doc_id long, copy int, n_words long, spans binary, items array<string>, longest long"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64())])
OUT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"


def _words(s: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[s.data]
    starts, ends, first = word_bounds(data, s.bounds, NOT_ALNUM)
    return data, starts, ends, first


class TestBlock:
    """The windows of a block of items, as word numbers in the order of the words' hashes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.names = window, [i for i, _ in items]
        words: list[list[bytes]] = []
        hashes: list[np.ndarray] = []
        for s in slabs(np.arange(len(items)), pa.array([t for _, t in items], pa.string())):
            data, starts, ends, first = _words(s)
            h = word_hashes(data, starts, ends)
            raw = data.tobytes()
            for i in range(len(s.ids)):
                a, b = first[i], first[i + 1]
                words.append([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
                hashes.append(h[a:b])
        self.words = words
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        self.numbers = [np.searchsorted(self.vocabulary, h) + 1 for h in hashes]
        where: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, n in enumerate(self.numbers):
            if len(n):
                key = spell(n)
                for j in range(max(1, len(n) - window + 1)):
                    where[key[4 * j : 4 * min(j + window, len(n))]].append((i, j))
        self.windows = sorted(where)
        self.where = [where[w] for w in self.windows]
        self.low = np.array([w.ljust(4 * window, b"\1") for w in self.windows], f"S{4 * window}")
        self.high = np.array([w.ljust(4 * window, b"\xff") for w in self.windows], f"S{4 * window}")
        heads = defaultdict(set)
        for w in self.windows:
            n = min(3, len(w) // 4)
            heads[n].add(w[: 4 * n])
        self.heads = {n: np.array(sorted(x), f"S{4 * n}") for n, x in heads.items()}


def spell(numbers: np.ndarray) -> bytes:
    """Four bytes from 2 to 254 a number, so that byte order is number order and no byte is 0, 1 or 255."""
    out = np.empty((len(numbers), 4), np.uint8)
    rest = numbers.astype(np.int64)
    for d in range(3, -1, -1):
        out[:, d] = rest % 253 + 2
        rest = rest // 253
    return out.tobytes()


def _suffixes(numbers: np.ndarray, heads: dict[int, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array: places that can begin a window, in order of the ``width`` words from there."""
    padded = np.r_[numbers, np.zeros(width, np.int64)]
    flat = np.frombuffer(spell(padded), np.uint8).reshape(-1, 4)
    known = padded > 0
    chosen = np.zeros(len(numbers), bool)
    for n, keys in heads.items():
        ok = known[: len(numbers)].copy()
        for d in range(1, n):
            ok &= known[d : len(numbers) + d]
        at = np.flatnonzero(ok)
        own = np.ascontiguousarray(np.concatenate([flat[at + d] for d in range(n)], axis=1)).view(f"S{4 * n}").reshape(-1) if len(at) else np.zeros(0, f"S{4 * n}")
        chosen[at[keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own]] = True
    at = np.flatnonzero(chosen)
    if not len(at):
        return at, np.zeros(0, f"S{4 * width}")
    keys = np.ascontiguousarray(np.concatenate([flat[at + d] for d in range(width)], axis=1)).view(f"S{4 * width}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _search(s: Slab, block: TestBlock) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]], np.ndarray]:
    """Words of each document, matched spans by word, items found, and the longest verbatim match."""
    data, starts, ends, first = _words(s)
    n_words = np.diff(first)
    spans: list[list[tuple[int, int]]] = [[] for _ in s.ids]
    items: list[set[int]] = [set() for _ in s.ids]
    longest = np.zeros(len(s.ids), np.int64)
    if not len(starts) or not block.windows:
        return n_words, spans, items, longest
    h = word_hashes(data, starts, ends)
    rank = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    numbers = np.where(block.vocabulary[rank] == h, rank + 1, 0)
    # a sign that no word has stands between documents
    shift = np.repeat(np.arange(len(s.ids)), n_words)
    line = np.zeros(len(numbers) + len(s.ids), np.int64)
    line[np.arange(len(numbers)) + shift] = numbers
    at, keys = _suffixes(line, block.heads, block.window)
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    line_first = first + np.arange(len(first))
    for w in np.flatnonzero(hi > lo).tolist():
        size = len(block.windows[w]) // 4
        for p in at[lo[w] : hi[w]].tolist():
            doc = int(np.searchsorted(line_first, p, "right")) - 1
            a = p - doc
            i, j = block.where[w][0]
            if [data[starts[k] : ends[k]].tobytes() for k in range(a, a + size)] != block.words[i][j : j + size]:
                continue
            spans[doc].append((a - int(first[doc]), a - int(first[doc]) + size))
            for i, j in block.where[w]:
                items[doc].add(i)
                longest[doc] = max(longest[doc], _length(line, p, block.numbers[i], j, size))
    return n_words, spans, items, longest


def _length(line: np.ndarray, p: int, item: np.ndarray, j: int, size: int) -> int:
    """Words that agree from p and j on, ``size`` of which are known to."""
    n = min(len(line) - p, len(item) - j)
    differ = np.flatnonzero(line[p + size : p + n] != item[j + size : j + n])
    return size + int(differ[0]) if len(differ) else n


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256, contaminated and longest (words of the longest
    verbatim match). With ``keep`` instead: the rows of ``docs`` that share no window with the test set.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = docs.select(*columns, *(([F.struct(*docs.columns).alias("row")]) if keep else [])).where(F.col("doc_id").isNotNull())
    if n_blocks > 1:
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")).cast("int"))
    else:
        rows = rows.withColumn("copy", F.lit(1))

    def block_of(k: int):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        return spark.sparkContext.broadcast(TestBlock([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], window))

    if n_blocks == 1:
        block = block_of(0)
        if keep:
            return _kept(rows, block)
        return rows.select("doc_id", "text").mapInArrow(lean(_digests(block)), OUT_DDL)
    found = None
    for k in range(n_blocks):
        # one block at a time: what it finds is written before the next is read
        block = block_of(k)
        part = stored(rows.select("doc_id", "copy", "text").mapInArrow(_found(block), FOUND_DDL), "found")
        block.unpersist()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "copy").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"))
    done = merged.mapInArrow(_merged, "copy int, " + OUT_DDL)
    if keep:
        return rows.join(done.where(~F.col("contaminated")).select("doc_id", "copy"), ["doc_id", "copy"], "left_semi").select("row.*")
    return done.drop("copy")


def _row(doc_id: int, n_words: int, spans: np.ndarray, items: list[str], longest: int) -> tuple:
    n_hit = int(covered(n_words, spans[:, 0], spans[:, 1]).sum()) if len(spans) else 0
    return (doc_id, n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0, longest)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _digests(block):
    def work(batches):
        for b in batches:
            for s in slabs(b.column("doc_id").to_numpy(), b.column("text")):
                n_words, spans, items, longest = _search(s, block.value)
                yield _table([_row(d, int(n_words[i]), np.array(spans[i], np.int64).reshape(-1, 2), [block.value.names[x] for x in items[i]], int(longest[i])) for i, d in enumerate(s.ids.tolist())], OUT)

    return work


def _found(block):
    def work(batches):
        for b in batches:
            for s in slabs(b.column("doc_id").to_numpy(), b.column("text")):
                n_words, spans, items, longest = _search(s, block.value)
                copies = b.column("copy").to_pylist()[s.first : s.first + len(s.ids)]
                yield _table([(d, copies[i], int(n_words[i]), np.array(spans[i], np.int64).tobytes(), [block.value.names[x] for x in items[i]], int(longest[i])) for i, d in enumerate(s.ids.tolist())], FOUND)

    return work


def _merged(batches):
    schema = pa.schema([("copy", pa.int32()), *OUT])
    for b in batches:
        rows = []
        for r in b.to_pylist():
            spans = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in r["spans"]])
            rows.append((r["copy"], *_row(r["doc_id"], r["n_words"], spans, r["items"], r["longest"])))
        yield _table(rows, schema)


def _kept(rows: DataFrame, block) -> DataFrame:
    """Rows without a hit, every column as it was."""

    def work(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for s in slabs(b.column("doc_id").to_numpy(), b.column("text")):
                _, spans, _, _ = _search(s, block.value)
                keep[s.first : s.first + len(s.ids)] = [not x for x in spans]
            yield pa.RecordBatch.from_struct_array(b.column("row").filter(pa.array(keep)))

    return rows.select("doc_id", "text", "row").mapInArrow(lean(work), rows.schema["row"].dataType)
