"""SimHash near-duplicates: deletion-variant signatures of three segments, equality of variants, exact verification.

1. Every text's fingerprint: 64 bits, each by majority over the XXH64 of its shingles, repeats included.
2. Equal fingerprints are one class, named by its least doc_id. Of each class 64 variants are indexed:
   a fingerprint is cut into three segments (22, 21 and 21 bits), so of at most four differing bits one
   segment has one or none. Masking each bit of a segment in turn gives its one-wildcard variants, and two
   segments that differ in at most one bit have a variant in common. No link is lost.
3. Classes of an equal variant meet in parts of many variants each, where xor and bit counts verify them;
   of what is linked there a part returns a star, not its pairs. A variant of more than ``BLOCK`` classes
   is dealt into blocks, and each two of them are a tile of its own, so no task holds a whole large group.
4. Components of the links, by classes.

Defined results: null, empty and blank texts have no shingles and fingerprint zero, which links like any
other; texts of fewer than k words have their whole word sequence as the one shingle; rows that repeat a
doc_id are rows of their own; rows without a doc_id are left out; an empty table gives no rows; other
columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, partitions, stored
from .components import components, joined_by
from .kernels import LOWER, joined, lean, slabs, word_bounds

SEED = 42
#: Differing bits at which fingerprints link: at most one in the least differing of three segments.
RADIUS = 4
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Classes of one variant that are compared in one tile's side, rows of a part, and shingles counted at once.
BLOCK, PART, VOTES = 2048, 400_000, 1 << 16
#: Large variants that are broadcast; more are joined by a shuffle.
FEW = 10_000


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words, each followed by one space, and where each begins."""
    lengths = ends - starts
    begin = np.r_[0, np.cumsum(lengths + 1)]
    out = np.full(begin[-1], 0x20, np.uint8)
    word = np.repeat(np.arange(len(starts)), lengths)
    within = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[begin[:-1][word] + within] = data[starts[word] + within]
    return out.tobytes(), begin


def fingerprints_of(data: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each document of a slab."""
    n_docs = len(bounds) - 1
    starts, ends, first = word_bounds(data, bounds)
    n = np.diff(first)
    text, begin = spaced(data, starts, ends)
    shingles = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    doc = np.repeat(np.arange(n_docs), shingles)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(at + k, first[1:][doc])
    votes = np.zeros((n_docs, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for x in range(0, len(at), VOTES):
        y = min(x + VOTES, len(at))
        h = np.fromiter((digest(text[s:e], SEED) for s, e in zip(begin[at[x:y]].tolist(), (begin[last[x:y]] - 1).tolist(), strict=True)), np.uint64, y - x)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.r_[True, np.diff(doc[x:y]) != 0])
        votes[doc[x:y][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    over = (2 * votes > shingles[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0] if n_docs else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs`` that has a doc_id, without a shuffle."""

    def each(batches):
        for b in batches:
            for s in slabs(b.column("doc_id").to_numpy(), b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(fingerprints_of(LOWER[s.data], s.bounds, k).view(np.int64))], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(lean(each), "doc_id long, fp long")


def variants(fp: Column) -> Column:
    """The one-wildcard variants of all segments, each with the number of its masked bit."""
    out = []
    for low, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        out += [segment.bitwiseAND(F.lit(~(1 << j))) + F.lit((low + j) << 22) for j in range(bits)]
    return F.array(*out)


def near_pairs(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows, as a star for each component within a group. ``group`` is sorted."""
    ends = np.r_[np.flatnonzero(np.diff(group)) + 1, len(group)] if len(group) else np.zeros(0, np.int64)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(end - np.arange(len(group)) > 1)
    wide = np.repeat(np.diff(np.r_[0, ends]), np.diff(np.r_[0, ends])) > 64
    step = 1
    rest = small[~wide[small]]
    while len(rest):  # small groups, all at once: each row with the one that lies `step` further
        rest = rest[rest + step < end[rest]]
        hit = rest[np.bitwise_count(fp[rest] ^ fp[rest + step]) <= radius]
        a.append(hit)
        b.append(hit + step)
        step += 1
    label = np.arange(len(group))
    for i in small[wide[small]].tolist():  # large groups: a row with all behind it that aren't connected with it yet
        hit = i + 1 + np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 : end[i]]) <= radius)
        other, one = np.unique(label[hit], return_index=True)
        hit = hit[one[other != label[i]]]
        if len(hit):
            a.append(np.full(len(hit), i))
            b.append(hit)
            begin = end[i] - np.diff(np.r_[0, ends])[np.searchsorted(ends, i, "right")]
            part = label[begin : end[i]]
            part[np.isin(part, other)] = label[i]
    return joined(np.concatenate(a), np.concatenate(b))


def links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links of classes(node, fp) that connect all whose fingerprints differ in at most ``radius`` bits."""
    spark = classes.sparkSession
    keys = classes.select("node", "fp", F.explode(variants(F.col("fp"))).alias("key"))
    large = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    n_large = large.count()
    dealt = keys.withColumn("tile", F.lit(0))
    if n_large:
        some = F.broadcast(large) if n_large <= FEW else large
        blocks = F.ceil(F.col("n") / block).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        # a row of a large variant goes to each tile that its block has a part in
        tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(o, own) * blocks + F.greatest(o, own))
        split = keys.join(some, "key").select("node", "fp", "key", F.explode(tiles).alias("tile"))
        dealt = dealt.join(some, "key", "left_anti").unionByName(split)
    parts = max(partitions(spark), 64 * classes.count() // PART)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", "tile"), F.lit(parts)).cast("int"))

    def verify(rows: pa.Table) -> pa.Table:
        key, t, node, fp = (rows.column(c).to_numpy() for c in ("key", "tile", "node", "fp"))
        order = np.lexsort((node, t, key))
        key, t, node, fp = key[order], t[order], node[order], fp[order].view(np.uint64)
        new = np.r_[False, (key[1:] != key[:-1]) | (t[1:] != t[:-1])] if len(key) else np.zeros(0, bool)
        a, b = near_pairs(np.cumsum(new), fp, radius)
        a, b = joined(node[a], node[b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("part").applyInArrow(lean(verify), "a long, b long")


def simhash_components(docs: DataFrame, k: int = 4, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id, the least doc_id that links reach."""
    if not 0 <= radius <= 5:
        raise ValueError("three segments hold one with at most one differing bit only up to radius 5")
    prints = stored(fingerprints(docs, k), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    labels = components(links(classes.select("node", "fp"), radius, block))
    named = classes.join(labels, F.col("node") == F.col("id"), "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    out = joined_by(prints, named, "fp", classes.select("fp", "n"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
