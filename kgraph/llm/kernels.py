"""Array kernels that the text operators share: byte slabs, word bounds, rolling hashes, winnowing.

All of them work on whole documents laid end to end in one byte array, so the cost per byte is a
few array operations and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import hashlib
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLAB = 1 << 20
_MULT, _GRAM_MULT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are no part of a word made of ASCII letters, digits and all bytes over 0x7F.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and those of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLAB + 1)
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 2**64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Slab:
    """Documents end to end: their row numbers in the table, their bytes, and where each begins."""

    first: int
    ids: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def slabs(ids: np.ndarray, column: pa.Array | pa.ChunkedArray, limit: int = SLAB) -> Iterator[Slab]:
    """Cuts a text column into runs of whole documents of about ``limit`` bytes. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.cast(pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""), pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Slab(at, ids[at:end], raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


def word_bounds(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each document its first word (one entry more at the end)."""
    n = len(data)
    gap = breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, last = edge[:n].copy(), edge[1:].copy()
    first[1:] |= gap[:-1]
    last[:-1] |= gap[1:]
    starts, ends = np.flatnonzero(~gap & first), np.flatnonzero(~gap & last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, wherever the span lies."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(byte_prefix(data), starts, ends)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k values in a row; shorter input gives none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= U64(_GRAM_MULT)
        out += h[j : j + n]
    return mix(out)


def lowest(g: np.ndarray, w: int, block: int = 1 << 22) -> np.ndarray:
    """For each w values in a row, the place of the leftmost least one (by its upper 40 bits)."""
    total = len(g) - w + 1
    out = np.zeros(max(total, 0), np.int64)
    for at in range(0, max(total, 0), block):
        part = g[at : min(at + block, total) + w - 1]
        key = (part & U64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < w:
            step = min(have, w - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        out[at : at + len(key)] = (key & U64(0xFFFFFF)).astype(np.int64) + at
    return out


@dataclass
class Runs:
    """Windows in a row whose least gram is the same one, as arrays: its hash and place, first and last window, document."""

    hash: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def runs(g: np.ndarray, window: int, gram: int, unit_bounds: np.ndarray) -> Runs:
    """Winnowing: every window of ``window`` units is named by its least ``gram``-unit hash, so equal
    windows get the same name, and windows in a row that share one are one run."""
    docs = np.diff(unit_bounds)
    low = lowest(g, window - gram + 1)
    doc = np.repeat(np.arange(len(docs)), docs)[: len(low)]
    ok = np.arange(len(low)) + window <= unit_bounds[1:][doc] if len(low) else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    if not len(at):
        return Runs(np.zeros(0, np.uint64), at, at, at, at)
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(low[at]) != 0) | (np.diff(doc[at]) != 0)]
    first = at[new]
    last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
    return Runs(g[low[first]], low[first], first, last, doc[first])


def chosen(r: Runs, take: np.ndarray) -> Runs:
    return Runs(r.hash[take], r.at[take], r.first[take], r.last[take], r.doc[take])


def tidy() -> None:
    """Gives freed memory back to the system, so that an idle worker of an earlier stage doesn't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """``f`` of one group (or two) or of an iterator of batches, tidied up behind."""
    args = f.__code__.co_argcount
    if args == 2:

        def two(rows, more):
            out = f(rows, more)
            tidy()
            return out

        return two

    def one(rows):
        out = f(rows)
        tidy()
        return out

    def each(batches):
        yield from f(batches)
        tidy()

    return each if f.__code__.co_flags & inspect.CO_GENERATOR else one


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the half-open spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def i64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What links a, b connect: each id but the least of its component, and that least one."""
    ids, places = np.unique(np.r_[a, b], return_inverse=True)
    i, j = places[: len(a)], places[len(a) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[i], label[j]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]
