"""Finding what recurs without shipping the corpus: chunks of documents ask, buckets of hashes answer.

Every chunk (some MB of documents, dealt by doc_id) winnows its windows to anchors and sends each
bucket the anchors' hashes, each once, so a text that a third of all documents share costs one entry
a chunk. A bucket answers each chunk with those of its anchors that occur elsewhere too. Only
stretches around such anchors are compared as text, in ``settled``, again once per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened
from .kernels import Runs, i64, lean, u64

ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("often", pa.binary())])
ASK_DDL = "bucket int, chunk int, once binary, often binary"
STRETCH = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("seg", pa.int64()), ("anchor", pa.int64()), ("body", pa.binary()), ("weight", pa.int64()), ("places", pa.binary())])
STRETCH_DDL = "kind int, bucket int, chunk int, seg long, anchor long, body binary, weight long, places binary"


def recurring(docs: DataFrame, n_chunks: int, anchors: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(chunk, hashes): the anchors of each chunk that recur in it or lie in another chunk as well.

    ``anchors`` gives the hashes of a chunk's anchors and a document (or place) for each; a hash
    with two of those recurs. ``docs`` is as ``common.chunked`` makes it.
    """

    def ask(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return ASK.empty_table()
        chunk = rows.column("chunk")[0].as_py()
        h, place = anchors(opened(rows))
        order = np.lexsort((place, h))
        h, place = h[order], place[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = np.zeros(len(new) and group[-1] + 1, bool)
        many[group[1:][(~new[1:]) & (place[1:] != place[:-1])]] = True
        h = h[new]
        bucket = (h % np.uint64(n_chunks)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, many, bucket = h[order], many[order], bucket[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(h)]
        out = [(int(bucket[a]), chunk, h[a:b][~many[a:b]].tobytes(), h[a:b][many[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ASK, strict=True)], schema=ASK) if out else ASK.empty_table()

    answer_schema = pa.schema([("chunk", pa.int32()), ("hashes", pa.binary())])

    def answer(rows: pa.Table) -> pa.Table:
        chunks = rows.column("chunk").to_pylist()
        once, often = ([u64(x) for x in rows.column(c).to_pylist()] for c in ("once", "often"))
        every = np.sort(np.concatenate([*once, *often])) if chunks else np.zeros(0, np.uint64)
        twice = every[1:][every[1:] == every[:-1]]
        known = np.unique(np.concatenate([twice, *often]))
        out = []
        for chunk, a, b in zip(chunks, once, often, strict=True):
            mine = a[known[np.minimum(np.searchsorted(known, a), max(len(known) - 1, 0))] == a] if len(known) else a[:0]
            if len(mine) + len(b):
                out.append((chunk, np.concatenate([mine, b]).tobytes()))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(answer_schema)], schema=answer_schema)

    asked = docs.groupBy("chunk").applyInArrow(lean(ask), ASK_DDL)
    return asked.groupBy("bucket").applyInArrow(lean(answer), "chunk int, hashes binary")


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def known_of(answers: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(u64(x) for x in answers.column("hashes").to_pylist())]))


class Stretches:
    """Distinct stretches of one chunk, each with a weight, and where they stand."""

    def __init__(self, chunk: int, n_buckets: int, join: Callable[[int, int], int]):
        self.chunk, self.n, self.join = chunk, n_buckets, join
        self.seen: dict[bytes, int] = {}
        self.anchor: list[int] = []
        self.weight: list[int] = []
        self.rows: list[np.ndarray] = []

    def add(self, r: Runs, bodies: list[bytes], weights: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> None:
        """A run for each body; docs are row numbers in the chunk, starts the first unit in the document."""
        segs = np.empty(len(bodies), np.int64)
        hashes = r.hash.view(np.int64).tolist()
        for i, body in enumerate(bodies):
            s = self.seen.get(body)
            if s is None:
                s = self.seen[body] = len(self.weight)
                self.anchor.append(hashes[i])
                self.weight.append(int(weights[i]))
            else:
                self.weight[s] = self.join(self.weight[s], int(weights[i]))
            segs[i] = s
        if len(bodies):
            self.rows.append(np.stack([docs, starts, segs]))

    def table(self) -> pa.Table:
        n = len(self.weight)
        anchor = np.array(self.anchor, np.int64)
        bucket = (anchor.view(np.uint64) % np.uint64(self.n)).astype(np.int32)
        places = np.concatenate(self.rows, axis=1) if self.rows else np.zeros((3, 0), np.int64)
        cols = [
            pa.array(np.r_[np.zeros(n, np.int32), np.int32(1)]), pa.array([*bucket.tolist(), None], pa.int32()), pa.array(np.full(n + 1, self.chunk, np.int32)),
            pa.array(np.r_[np.arange(n), -1]), pa.array([*self.anchor, None], pa.int64()), pa.array([*self.seen, None], pa.binary()), pa.array([*self.weight, None], pa.int64()),
            pa.array([None] * n + [np.ascontiguousarray(places.T).tobytes()], pa.binary()),
        ]
        return pa.Table.from_arrays(cols, schema=STRETCH)


def verdicts(stretches: DataFrame, judge: Callable[[list[bytes], np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """Rows like those of places: for each chunk's stretches what ``judge`` says of each distinct body.

    ``judge`` gets a bucket's distinct bodies with their joined weights and anchors.
    """
    schema = pa.schema([("chunk", pa.int32()), ("segs", pa.binary()), ("said", pa.binary()), ("lengths", pa.binary())])

    def settle(rows: pa.Table) -> pa.Table:
        bodies = rows.column("body").to_pylist()
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(b, len(index)) for b in bodies), np.int64, len(bodies))
        said = judge(list(index), which, rows)
        chunk, seg = rows.column("chunk").to_numpy(), rows.column("seg").to_numpy()
        order = np.lexsort((seg, chunk))
        out: list[tuple] = []
        cuts = np.r_[0, np.flatnonzero(np.diff(chunk[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = [i for i in order[a:b] if said[which[i]]]
            if part:
                texts = [said[which[i]] for i in part]
                out.append((int(chunk[part[0]]), seg[part].astype(np.int64).tobytes(), b"".join(texts), np.array([len(t) for t in texts], np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return stretches.where(F.col("kind") == 0).select("bucket", "chunk", "seg", "anchor", "body", "weight").groupBy("bucket").applyInArrow(lean(settle), "chunk int, segs binary, said binary, lengths binary")


def collected(rows: pa.Table) -> tuple[np.ndarray, dict[int, bytes]]:
    """From a chunk's own rows: the places (row, start, seg) in order, and what was said of each seg."""
    places, said = np.zeros((0, 3), np.int64), {}
    for r in rows.select(["places", "segs", "said", "lengths"]).to_pylist():
        if r["places"] is not None:
            places = i64(r["places"]).reshape(-1, 3)
        else:
            ends = np.cumsum(i64(r["lengths"]))
            for seg, end, n in zip(i64(r["segs"]).tolist(), ends.tolist(), i64(r["lengths"]).tolist(), strict=True):
                said[seg] = r["said"][end - n : end]
    return places[np.argsort(places[:, 0], kind="stable")], said


def returned(stretches: DataFrame, replies: DataFrame) -> DataFrame:
    """What goes back to the chunks: their own places and the verdicts."""
    none = F.lit(None).cast("binary")
    return stretches.where(F.col("kind") == 1).select("chunk", "places", none.alias("segs"), none.alias("said"), none.alias("lengths")).unionByName(replies.select("chunk", none.alias("places"), "segs", "said", "lengths"))
