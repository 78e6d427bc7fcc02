"""Suffix-array dedup of byte strings by threshold-bounded interval expansion.

Chunks find the 200-byte strings that may recur through winnowed 96-byte anchors (``repeats``). The
stretches around recurring anchors meet in the bucket of their anchor, once a chunk. A bucket sorts
the suffixes of its distinct stretches, forms the Burrows-Wheeler transform and derives the common
prefixes of neighbouring suffixes by breadth-first backward extension of intervals: step l sets those
of length l, and the search stops at the threshold, so what is still unset shares 200 bytes or more.

Defined results: a null or empty text has no bytes; shorter texts than the threshold lose nothing;
rows that repeat a document count as documents of their own; rows without a doc_id are left out; an
empty table gives no rows. Kept bytes need not be valid UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import chunk_count, chunked, documents, opened, stored
from .kernels import byte_prefix, chosen, covered, lean, mix, powers, runs, sha, slabs

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end, each closed by a sign of its own: symbols, suffix array and ranks.

    Symbols 0 to m-1 close the m texts; byte b is m + b. Prefix doubling on packed symbols; places
    whose rank is already theirs alone are not sorted again.
    """
    m = len(texts)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, m)
    close = np.cumsum(lengths + 1) - 1
    sym = joined.astype(np.int64) + m
    sym[close] = np.arange(m)
    n = len(sym)
    # eight bytes in one key, nothing behind a closing sign; `tie` orders what is equal up to there
    ahead = np.repeat(close, lengths + 1) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for d in range(8):
        key[: max(n - d, 0)] |= joined[d:].astype(np.uint64) << np.uint64(56 - 8 * d)
    short = np.flatnonzero(ahead < 8)
    cutoff = (np.uint64(8) * ahead[short].astype(np.uint64)) % np.uint64(64)
    key[short] &= np.where(ahead[short] == 0, np.uint64(0), ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> cutoff))
    tie = np.full(n, 8 * m, np.int64)
    tie[short] = ahead[short] * m + np.repeat(np.arange(m), lengths + 1)[short]
    sa = np.argsort(key)
    sorted_key = key[sa]
    heads = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    open_ = np.flatnonzero(~(heads & np.r_[heads[1:], True]))
    h, after = 0, tie
    while len(open_):
        at = sa[open_]
        behind = after[at] if h == 0 else after[np.minimum(at + h, n - 1)]
        both = rank[at] * (9 * n) + behind
        sub = np.argsort(both)
        at, both = at[sub], both[sub]
        sa[open_] = at
        head = np.r_[True, both[1:] != both[:-1]]
        rank[at] = open_[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        open_ = open_[~(head & np.r_[head[1:], True])]
        h, after = max(8, 2 * h), rank
    return sym, sa, rank


def shared_prefixes(sym: np.ndarray, sa: np.ndarray, rank: np.ndarray, m: int, least: int) -> np.ndarray:
    """For each suffix in order (but the first) the common prefix with the one before it, or ``least``
    where that is as long or longer, by breadth-first backward extension over the transform."""
    n = len(sa)
    lf = rank[np.where(sa == 0, n - 1, sa - 1)]
    front = sym[sa]
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    lb, rb = np.zeros(1, np.int64), np.full(1, n, np.int64)
    owner = np.full(n, -1, np.int64)
    for length in range(least):
        if not len(lb):
            break
        size = rb - lb
        of = np.repeat(np.arange(len(lb)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lb[of]
        to = lf[place]
        owner[to] = of
        to = np.sort(to)
        new = np.r_[True, (np.diff(to) != 1) | (np.diff(owner[to]) != 0) | (np.diff(front[to]) != 0)]
        begin = to[new]
        end = to[np.r_[np.flatnonzero(new)[1:] - 1, len(to) - 1]] + 1
        fresh = lcp[end] < 0
        # an interval that a closing sign heads is a single suffix and ends here once its border is set
        lcp[end[fresh]] = length
        lb, rb = begin[fresh], end[fresh]
    return np.where(lcp[1:n] < 0, least, lcp[1:n])


def repeated_starts(texts: list[bytes], weights: np.ndarray, least: int) -> list[np.ndarray]:
    """For each text, which of its places begin a string of ``least`` bytes that occurs twice or more;
    weights say how often a text stands in the corpus."""
    sym, sa, rank = suffix_order(texts)
    m = len(texts)
    lcp = shared_prefixes(sym, sa, rank, m, least)
    lengths = np.fromiter(map(len, texts), np.int64, m)
    close = np.cumsum(lengths + 1) - 1
    text_of = np.repeat(np.arange(m), lengths + 1)
    group = np.cumsum(np.r_[True, lcp < least]) - 1
    total = np.bincount(group, weights=np.minimum(weights[text_of[sa]], 2))
    good = np.zeros(len(sa), bool)
    good[sa] = total[group] >= 2
    begins = close - lengths
    return [good[a : a + max(0, k - least + 1)] for a, k in zip(begins.tolist(), lengths.tolist(), strict=True)]


def suffix_dedup(docs: DataFrame, least: int = 200, anchor: int = 96, with_bytes: bool = True) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_bytes``, the kept bytes."""
    docs = documents(docs)
    n = chunk_count(docs)
    docs = chunked(docs, n)

    def byte_runs(s):
        c = byte_prefix(s.data)
        k = len(s.data) - anchor + 1
        g = mix((c[anchor:] - c[:k]) * powers(len(c))[1][:k]) if k > 0 else np.zeros(0, np.uint64)
        return g, runs(g, least, anchor, s.bounds)

    def anchors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, place = [np.zeros(0, np.uint64)], 0
        for s in slabs(rows.column("doc_id").to_numpy(), rows.column("text")):
            h.append(byte_runs(s)[1].hash)
        h = np.concatenate(h)
        return h, np.arange(len(h)) + place

    def stretch(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return repeats.STRETCH.empty_table()
        out = repeats.Stretches(rows.column("chunk")[0].as_py(), n, lambda a, b: a + b)
        rows, known = opened(rows), repeats.known_of(answers)
        for s in slabs(rows.column("doc_id").to_numpy(), rows.column("text")):
            _, r = byte_runs(s)
            r = chosen(r, repeats.among(r.hash, known))
            data = s.data.tobytes()
            out.add(r, [data[a:b] for a, b in zip(r.first.tolist(), (r.last + least).tolist(), strict=True)], np.ones(len(r.hash), np.int64), s.first + r.doc, r.first - s.bounds[r.doc])
        return out.table()

    def judge(bodies: list[bytes], which: np.ndarray, rows: pa.Table) -> list[bytes]:
        weight = np.zeros(len(bodies), np.int64)
        np.add.at(weight, which, rows.column("weight").to_numpy())
        anchor_of = np.zeros(len(bodies), np.int64)
        anchor_of[which] = rows.column("anchor").to_numpy()
        # where all stretches of an anchor occur twice as they are, no suffix needs sorting
        unsure = np.isin(anchor_of, anchor_of[weight < 2])
        said = [b"" if u else b"\1" * (len(b) - least + 1) for u, b in zip(unsure.tolist(), bodies, strict=True)]
        at = np.flatnonzero(unsure)
        # anchors are independent of each other: sort some MB of them at a time
        at = at[np.argsort(anchor_of[at], kind="stable")]
        sizes = np.cumsum([len(bodies[i]) for i in at]) if len(at) else np.zeros(0)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (2 << 20), "right")))
            while hi < len(at) and anchor_of[at[hi]] == anchor_of[at[hi - 1]]:
                hi += 1
            part = at[lo:hi]
            for i, flags in zip(part.tolist(), repeated_starts([bodies[i] for i in part], weight[part], least), strict=True):
                said[i] = flags.tobytes() if flags.any() else b""
            lo = hi
        return said

    def kept(rows: pa.Table, mine: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return OUT.empty_table()
        rows = opened(rows)
        places, said = repeats.collected(mine)
        flags = {seg: np.flatnonzero(np.frombuffer(x, np.uint8)) for seg, x in said.items()}
        out: list[tuple] = []
        for s in slabs(rows.column("doc_id").to_numpy(), rows.column("text")):
            own = places[np.searchsorted(places[:, 0], s.first) : np.searchsorted(places[:, 0], s.first + len(s.ids))]
            spans = [flags[seg] + start + s.bounds[row - s.first] for row, start, seg in own.tolist() if seg in flags]
            at = np.concatenate([np.zeros(0, np.int64), *spans])
            gone = covered(len(s.data), at, at + least)
            for i, doc_id in enumerate(s.ids.tolist()):
                a, b = s.bounds[i], s.bounds[i + 1]
                g = gone[a:b]
                lost = int(g.sum())
                text = s.data[a:b][~g].tobytes() if lost else s.text(i)
                out.append((doc_id, int(b - a), lost, int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if lost else 0, sha(text), text if with_bytes else None))
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(OUT)], schema=OUT)

    answers = repeats.recurring(docs, n, anchors)
    stretches = stored(docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(stretch), repeats.STRETCH_DDL), "stretches")
    back = repeats.returned(stretches, repeats.verdicts(stretches, judge))
    done = docs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lean(kept), OUT_DDL)
    return done if with_bytes else done.drop("kept")
