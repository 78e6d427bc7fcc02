"""Substring dedup by repeated-phrase automata.

1. Every window of 13 words is named by its least 5-word phrase (winnowing), so a window can recur
   only if its phrase does; ``repeats.recurring`` finds the phrases that occur in two documents.
2. The passages around them go, once a chunk, to the bucket of their phrase, where windows are compared
   as words with those of all other chunks: the least and the greatest doc_id of each window. A passage
   is confirmed if one of its windows stands in two documents.
3. A bucket sends each chunk the phrases of its confirmed passages. The chunk's shard compiles them into
   an Aho-Corasick automaton (words spelt in two letters each) and streams all its documents through it,
   which gives every occurrence of every confirmed passage; nothing else says where one stands.
4. At each occurrence the passage is looked up by a 128-bit digest of its words, and the words that a
   window of a smaller doc_id covers are marked. Letters decide nothing.

Defined results: a null or empty text has no words and keeps the empty string; documents under 13
words lose nothing; rows that repeat a doc_id are judged each by itself and never against each other
(neither id is smaller); rows without a doc_id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import chunk_count, chunked, documents, opened, stored
from .kernels import Slab, chosen, covered, grams, i64, lean, runs, sha, slabs, word_bounds, word_hashes

PHRASE = 5
#: A word is spelt in so many letters of 32, by its hash: a node has 32 children at most, which the
#: automaton searches in a row. Passages spelt alike are told apart by their digests.
_SPELT = 2
PASSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary()), ("phrase", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
PASSAGE_DDL = "bucket int, chunk int, body binary, phrase int, low long, high long"
CONFIRMED = pa.schema([("chunk", pa.int32()), ("phrases", pa.binary()), ("digests", pa.binary()), ("lengths", pa.binary()), ("least", pa.binary())])
CONFIRMED_DDL = "chunk int, phrases binary, digests binary, lengths binary, least binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
OUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def spelt(h: np.ndarray) -> str:
    """Words by their hashes as text, ``_SPELT`` letters each."""
    out = np.empty((len(h), _SPELT), np.uint8)
    for d in range(_SPELT):
        out[:, d] = ((h >> np.uint64(20 + 5 * d)) & np.uint64(31)).astype(np.uint8) + np.uint8(65)
    return out.tobytes().decode("latin-1")


def compiled(phrases: bytes, size: int) -> ahocorasick.Automaton | None:
    """The automaton of phrases of ``size`` words each, all in one text; None without any."""
    data = np.frombuffer(phrases, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    if not len(starts):
        return None
    letters, step = spelt(word_hashes(data, starts, ends)), size * _SPELT
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in {letters[i : i + step] for i in range(0, len(letters), step)}:
        automaton.add_word(p)
    automaton.make_automaton()
    return automaton


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _passages(s: Slab, starts: np.ndarray, ends: np.ndarray, r, window: int) -> list[bytes]:
    data = s.data.tobytes()
    return [b" ".join(data[i:j].split()) for i, j in zip(starts[r.first].tolist(), ends[r.last + window - 1].tolist(), strict=True)]


def covered_words(s: Slab, automaton, confirmed: dict[bytes, np.ndarray], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a slab go, and the first word of each document."""
    starts, ends, first = word_bounds(s.data, s.bounds)
    hit = np.zeros(len(starts) + 1, bool)
    h = word_hashes(s.data, starts, ends)
    if automaton is not None and len(starts):
        found = np.fromiter((end for end, _ in automaton.iter(spelt(h))), np.int64) + 1
        hit[found[found % _SPELT == 0] // _SPELT - phrase] = True
    if not hit.any():
        return np.zeros(len(starts), bool), first
    r = runs(grams(h, phrase), window, phrase, first)
    r = chosen(r, hit[r.at])
    gone = [np.zeros(0, np.int64)]
    for body, at, doc_id in zip(_passages(s, starts, ends, r, window), r.first.tolist(), s.ids[r.doc].tolist(), strict=True):
        least = confirmed.get(digest(body))
        if least is not None:
            gone.append(np.flatnonzero(least < doc_id) + at)
    at = np.concatenate(gone)
    return covered(len(starts), at, at + window), first


def _ids(rows: pa.Table) -> np.ndarray:
    return rows.column("doc_id").to_numpy()


def substring_dedup(docs: DataFrame, window: int = 13, phrase: int = PHRASE, with_text: bool = True) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 and, with ``with_text``, the kept words."""
    docs = documents(docs)
    n = chunk_count(docs)
    docs = chunked(docs, n)

    def anchors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in slabs(_ids(rows), rows.column("text")):
            starts, ends, first = word_bounds(s.data, s.bounds)
            r = runs(grams(word_hashes(s.data, starts, ends), phrase), window, phrase, first)
            found[0].append(r.hash)
            found[1].append(s.ids[r.doc])
        return np.concatenate(found[0]), np.concatenate(found[1])

    def passages(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows or not answers.num_rows:
            return PASSAGE.empty_table()
        chunk, rows, known = rows.column("chunk")[0].as_py(), opened(rows), repeats.known_of(answers)
        seen: dict[bytes, int] = {}
        bucket, place, low, high = [], [], [], []
        for s in slabs(_ids(rows), rows.column("text")):
            starts, ends, first = word_bounds(s.data, s.bounds)
            r = runs(grams(word_hashes(s.data, starts, ends), phrase), window, phrase, first)
            r = chosen(r, repeats.among(r.hash, known))
            of = (r.hash % np.uint64(n)).tolist()
            for body, b, at, doc_id in zip(_passages(s, starts, ends, r, window), of, (r.at - r.first).tolist(), s.ids[r.doc].tolist(), strict=True):
                k = seen.setdefault(body, len(seen))
                if k == len(low):
                    bucket.append(b)
                    place.append(at)
                    low.append(doc_id)
                    high.append(doc_id)
                else:
                    low[k], high[k] = min(low[k], doc_id), max(high[k], doc_id)
        columns = [bucket, [chunk] * len(seen), list(seen), place, low, high]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PASSAGE, strict=True)], schema=PASSAGE)

    def confirm(rows: pa.Table) -> pa.Table:
        bodies, low, high = rows.column("body").to_pylist(), rows.column("low").to_pylist(), rows.column("high").to_pylist()
        span: dict[bytes, tuple[int, int]] = {}
        for body, a, b in zip(bodies, low, high, strict=True):
            x = span.get(body)
            span[body] = (a, b) if x is None else (min(a, x[0]), max(b, x[1]))
        least: dict[bytes, int] = {}
        listed: dict[bytes, list[bytes]] = {}
        for body, (a, _) in span.items():
            words = body.split(b" ")
            listed[body] = windows = [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]
            for x in windows:
                if least.setdefault(x, a) > a:
                    least[x] = a
        mins = {body: np.array([least[x] for x in windows], np.int64) for body, windows in listed.items()}
        out: dict[int, list[list]] = {}
        for body, chunk, at, b in zip(bodies, rows.column("chunk").to_pylist(), rows.column("phrase").to_pylist(), high, strict=True):
            if mins[body].min() < b:
                parts = out.setdefault(chunk, [[], [], [], []])
                words = body.split(b" ")
                for x, y in zip(parts, (b" ".join(words[at : at + phrase]), digest(body), len(mins[body]), mins[body].tobytes()), strict=True):
                    x.append(y)
        table = [(c, b"\n".join(dict.fromkeys(p)), b"".join(d), np.array(k, np.int64).tobytes(), b"".join(m)) for c, (p, d, k, m) in out.items()]
        return pa.Table.from_arrays([pa.array([r[i] for r in table], f.type) for i, f in enumerate(CONFIRMED)], schema=CONFIRMED)

    def kept(rows: pa.Table, mine: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return OUT.empty_table()
        rows = opened(rows)
        confirmed: dict[bytes, np.ndarray] = {}
        for r in mine.select(["digests", "lengths", "least"]).to_pylist():
            ends, least = np.cumsum(i64(r["lengths"])), i64(r["least"])
            for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                confirmed[r["digests"][16 * i : 16 * i + 16]] = least[a:b]
        automaton = compiled(b"\n".join(mine.column("phrases").to_pylist()), phrase)
        out: list[tuple] = []
        for s in slabs(_ids(rows), rows.column("text")):
            gone, first = covered_words(s, automaton, confirmed, window, phrase)
            out += _kept(s, gone, first, with_text)
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(OUT)], schema=OUT)

    answers = repeats.recurring(docs, n, anchors)
    found = docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(passages), PASSAGE_DDL)
    confirmed = found.groupBy("bucket").applyInArrow(lean(confirm), CONFIRMED_DDL)
    confirmed = stored(confirmed, "passages")
    done = docs.groupBy("chunk").cogroup(confirmed.groupBy("chunk")).applyInArrow(lean(kept), OUT_DDL)
    return done if with_text else done.drop("kept")


def _kept(s: Slab, gone: np.ndarray, first: np.ndarray, with_text: bool) -> list[tuple]:
    out = []
    count = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(first[:-1], len(gone))) if len(first) > 1 else []
    for i, doc_id in enumerate(s.ids.tolist()):
        n = int(first[i + 1] - first[i])
        lost = int(count[i]) if n else 0
        words = s.text(i).split()
        text = b" ".join(compress(words, (~gone[first[i] : first[i + 1]]).tolist()) if lost else words)
        out.append((doc_id, n, lost, sha(text), text.decode("utf-8") if with_text else None))
    return out
