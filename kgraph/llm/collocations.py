"""Phrase collocations: vertical inverted lists of positions, extended by merge-joins level by level.

1. Each task cuts its documents into shards of some MB and makes an inverted list for each distinct
   (lang, word) of a shard: its sorted positions. Words in a row within a piece have positions in a row;
   between pieces and documents a position is left out. The documents are not shuffled.
2. A level's lists tell their names and lengths to buckets, in packed rows; a bucket sums them over all shards by
   the names themselves and gives those of ``least`` occurrences at least a global id. Shards learn the ids of their own.
3. In a shard the positions of frequent phrases of m words are merged with those of the frequent phrases
   that begin one word later, which end in the adjacent word: each meeting is an occurrence of a phrase of
   m + 1 words, named by the pair of ids. A phrase that is frequent has frequent parts, so none is missed,
   and the length of a list is the exact frequency, overlaps included.
4. Scores, cuts and containment are joins of the frequent phrases by their ids.

Defined results: null texts have no words; a null lang is ``und``; rows without a doc_id and repeated rows
count like any; an empty table gives no rows; a lang without candidates has none; other columns are not
looked at.
"""

from __future__ import annotations

import gc
import pickle
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, size_of, stored, swept
from .kernels import LOWER, lean, mix, slabs, word_bounds, word_hashes

#: Bytes of text in a shard.
SHARD = 8 << 20
#: Bytes of input whose names a bucket sums up.
BUCKET = 64 << 20
#: Words of the longest phrases.
LONGEST = 4
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
SHARDS = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("packed", pa.binary()), ("n", pa.int64()), ("sizes", pa.binary()), ("positions", pa.binary())])
SHARDS_DDL = "shard long, bucket int, packed binary, n long, sizes binary, positions binary"
FOUND = pa.schema([("shard", pa.int64()), ("idx", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("f", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
FOUND_DDL = "shard long, idx binary, ids binary, id long, f long, lang string, word string, a long, b long, n long"


def squeezed(values: np.ndarray) -> bytes:
    """Integers under 2**32 or 2**63 as differences, byte by byte of all of them, compressed: lists are sorted, names nearly."""
    wide = np.uint32 if values.dtype.itemsize == 4 else np.uint64
    steps = np.diff(values.astype(wide), prepend=wide(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return pa.compress(planes, "zstd", asbytes=True) if len(values) else b""


def restored(blob: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint32 if width == 4 else np.uint64).ravel()
    return np.cumsum(steps, dtype=steps.dtype).astype(kind)


def packed(rows: pa.Table) -> bytes:
    """Columns of integers squeezed, others as they are."""
    columns = {c: squeezed(rows.column(c).to_numpy()) if pa.types.is_integer(rows.schema.field(c).type) else rows.column(c).combine_chunks() for c in rows.column_names}
    text = pa.table({c: v for c, v in columns.items() if not isinstance(v, bytes)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, text.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        if text.num_columns:
            out.write_table(text)
    whole = {c: (v, np.dtype(rows.schema.field(c).type.to_pandas_dtype()).str) for c, v in columns.items() if isinstance(v, bytes)}
    return pickle.dumps((rows.num_rows, whole, sink.getvalue().to_pybytes() if text.num_columns else None), protocol=5)


def unpacked(blob: bytes) -> pa.Table:
    n, whole, text = pickle.loads(blob)
    rows = pa.table({c: pa.array(restored(v, n, np.dtype(kind).type)) for c, (v, kind) in whole.items()})
    if text is not None:
        held = pa.ipc.open_stream(text).read_all()
        for c in held.column_names:
            rows = rows.append_column(c, held.column(c))
    return rows


def listed(shard: int, keys: dict[str, pa.Array], hashes: np.ndarray, which: np.ndarray, positions: np.ndarray, last: bool, buckets: int) -> pa.Table:
    """The lists of a shard's names, the positions (in order) of each: a packed row for each bucket, the names and lengths
    of the lists that it sums up; and a row that holds the lists end to end, in order of buckets and names, unless they
    are the ``last``. ``which``: the name at each position."""
    sizes = np.bincount(which, minlength=len(hashes))
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    ids = [keys[k].to_numpy() for k in ("b", "a") if k in keys]
    order = np.lexsort((*ids, bucket))
    rows = pa.table({**keys, "n": pa.array(sizes.astype(np.int64))}).take(pa.array(order))
    bucket, sizes = bucket[order], sizes[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)].tolist() if len(bucket) else [0]
    out = [{"shard": shard, "bucket": int(bucket[x]), "n": x, "packed": packed(rows.slice(x, y - x))} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    if not last:
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = positions[np.argsort(place[which], kind="stable")]
        out.append({"shard": shard, "sizes": squeezed(sizes.astype(np.uint32)), "n": len(sizes), "positions": squeezed(lists.astype(np.uint32))})
    return pa.Table.from_pylist(out, schema=SHARDS)


def words_of(shard: int, langs: pa.Array, data: np.ndarray, bounds: np.ndarray, buckets: int) -> pa.Table:
    """The word lists of a shard."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, bounds, GAP)
    lang = langs.dictionary_encode()
    code = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
    breaks = np.r_[0, np.cumsum(BREAK[data])]
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    apart = (breaks[starts[1:]] != breaks[ends[:-1]]) | (doc[1:] != doc[:-1])
    positions = np.cumsum(np.r_[0, 1 + apart])[: len(starts)]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~GAP[data]].tobytes())]).dictionary_encode()
    kinds = max(1, len(lang.dictionary))
    distinct, which = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * kinds + code, return_inverse=True)
    names, spelt = lang.dictionary.take(pa.array(distinct % kinds)).cast(pa.large_binary()), words.dictionary.take(pa.array(distinct // kinds))
    size = pc.cast(pc.cast(pc.binary_length(names), pa.string()), pa.large_binary())
    # the lang's length tells where the word begins
    key = pc.binary_join_element_wise(size, pc.binary_join_element_wise(names, spelt, pa.scalar(b"", pa.large_binary())), pa.scalar(b":", pa.large_binary()))
    return listed(shard, {"key": key}, hashes_of(key), which, positions, False, buckets)


def hashes_of(keys: pa.Array) -> np.ndarray:
    _, offsets, data = keys.buffers()
    bounds = np.frombuffer(offsets, np.int64)[keys.offset : keys.offset + len(keys) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if len(keys) else np.zeros(0, np.uint8)
    return word_hashes(raw, bounds[:-1] - bounds[0], bounds[1:] - bounds[0])


def word_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """The word lists of all shards."""

    def each(batches):
        own, held, number = TaskContext.get().partitionId() << 32, [], 0

        def shards():
            nonlocal number
            rows = pa.Table.from_batches(held)
            langs = rows.column("lang").combine_chunks()
            langs = langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs
            for s in slabs(np.arange(rows.num_rows), rows.column("text"), SHARD):
                yield from words_of(own + number, langs.slice(s.first, len(s.ids)), s.data, s.bounds, buckets).to_batches()
                number += 1
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= SHARD:
                yield from shards()
        if held:
            yield from shards()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(lean(each), SHARDS_DDL)


def summed(shards: DataFrame, buckets: int, least: int) -> DataFrame:
    """What a level's lists come to. A bucket sums the lengths of the lists of its names and gives each name of ``least``
    at least an id of its own (id, f, and lang and word, or a and b); each shard hears, in one packed row a bucket,
    the ids of those it has (shard, idx, ids). Of words also their number in each lang (lang, n)."""

    def settle(rows: pa.Table) -> pa.Table:
        tables = [unpacked(x) for x in rows.column("packed").to_pylist()]
        shard = np.repeat(rows.column("shard").to_numpy(), [t.num_rows for t in tables])
        every = pa.concat_tables(tables)
        n = every.column("n").to_numpy()
        idx = np.concatenate([first + np.arange(t.num_rows, dtype=np.int32) for first, t in zip(rows.column("n").to_pylist(), tables, strict=True)]).astype(np.int32)
        if "key" in every.column_names:
            key = every.column("key").combine_chunks()
            key = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).dictionary_encode()
            which = key.indices.to_numpy(zero_copy_only=False)
            total = np.zeros(len(key.dictionary), np.int64)
        else:
            a, b = every.column("a").to_numpy(), every.column("b").to_numpy()
            order = np.lexsort((b, a))
            new = np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]
            which = np.empty(len(a), np.int64)
            which[order] = np.cumsum(new) - 1
            total = np.zeros(int(new.sum()), np.int64)
        np.add.at(total, which, n)
        often = np.flatnonzero(total >= least)
        ids = np.full(len(total), -1, np.int64)
        ids[often] = rows.column("bucket")[0].as_py() + buckets * np.arange(len(often))
        out = {"id": pa.array(ids[often]), "f": pa.array(total[often])}
        if "key" in every.column_names:
            lang, word = [], []
            for k in key.dictionary.to_pylist():
                size, _, rest = k.partition(b":")
                lang.append(rest[: int(size)].decode())
                word.append(rest[int(size) :])
            out |= {"lang": pa.array([lang[i] for i in often]), "word": pa.array([word[i].decode() for i in often])}
            words: dict[str, int] = {}
            for x, t in zip(lang, total.tolist(), strict=True):
                words[x] = words.get(x, 0) + t
            counts = pa.table({"lang": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})
        else:
            first = order[new]
            out |= {"a": pa.array(a[first][often]), "b": pa.array(b[first][often])}
            counts = None
        own = np.flatnonzero(ids[which] >= 0)
        own = own[np.argsort(shard[own], kind="stable")]
        cuts = np.r_[0, np.flatnonzero(np.diff(shard[own])) + 1, len(own)].tolist() if len(own) else [0]
        told = [{"shard": int(shard[own[x]]), "n": y - x, "idx": squeezed(idx[own[x:y]]), "ids": squeezed(ids[which[own[x:y]]])} for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        parts = [pa.Table.from_pylist(told, schema=FOUND), pa.table(out), *([counts] if counts is not None else [])]
        return pa.concat_tables([pa.Table.from_arrays([p.column(f.name).cast(f.type) if f.name in p.column_names else pa.nulls(p.num_rows, f.type) for f in FOUND], schema=FOUND) for p in parts])

    return shards.where("bucket IS NOT NULL").select("bucket", "shard", "n", "packed").groupBy("bucket").applyInArrow(lean(settle), FOUND_DDL)


def extended(shards: DataFrame, found: DataFrame, last: bool, buckets: int) -> DataFrame:
    """The lists of phrases one word longer, of those that are frequent."""

    def merge(mine: pa.Table, answers: pa.Table) -> pa.Table:
        if not mine.num_rows or not answers.num_rows:
            return SHARDS.empty_table()
        row = mine.to_pylist()[0]
        sizes = restored(row["sizes"], row["n"], np.uint32)
        ids = np.full(len(sizes), -1, np.int64)
        for idx, own, n in zip(answers.column("idx").to_pylist(), answers.column("ids").to_pylist(), answers.column("n").to_pylist(), strict=True):
            ids[restored(idx, n, np.int32)] = restored(own, n, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        positions = restored(row["positions"], len(owner), np.uint32).astype(np.int64)
        keep = ids[owner] >= 0
        owner, positions = owner[keep], positions[keep]
        order = np.argsort(positions, kind="stable")  # a merge of sorted lists
        owner, positions = owner[order], positions[order]
        at = np.flatnonzero(np.diff(positions) == 1)
        distinct, which = np.unique(owner[at] * len(sizes) + owner[at + 1], return_inverse=True)
        a, b = ids[distinct // len(sizes)], ids[distinct % len(sizes)]
        hashes = mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))
        return listed(row["shard"], {"a": pa.array(a), "b": pa.array(b)}, hashes, which, positions[at], last, buckets)

    whole = shards.where("positions IS NOT NULL").select("shard", "n", "sizes", "positions")
    known = found.where("shard IS NOT NULL").select(F.col("shard").alias("of"), "n", "idx", "ids")
    return whole.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(lean(merge), SHARDS_DDL)


def cleaned(spark) -> None:
    """Lets files that no frame refers to any more go: once Python has let go of its own and told the driver, a moment later."""
    gc.collect()
    time.sleep(1)
    swept(spark)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each lang (lang, n), and for 1 to LONGEST words the phrases that occur ``least`` times: words as
    (id, lang, word, f), longer ones as (id, a, b, f), a and b the phrases without the last and the first word."""
    spark = docs.sparkSession
    buckets = max(partitions(spark), size_of(docs) // BUCKET)
    # lists are checkpoints, whose files go as soon as the next level's are there
    shards, every, n = cut(word_lists(docs, buckets)), [], None
    for words in range(1, LONGEST + 1):
        found = cut(summed(shards, buckets, least))
        cleaned(spark)
        if words == 1:
            n = stored(found.where("lang IS NOT NULL AND n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent = found.where("id IS NOT NULL").select("id", "f", *(("lang", "word") if words == 1 else ("a", "b")))
        every.append(stored(frequent, f"frequent-{words}"))
        if words < LONGEST:
            shards = cut(extended(shards, found, words + 1 == LONGEST, buckets))
            del found
            cleaned(spark)
    return n, every


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 a / (l + r)), in decimals: products may pass 64 bits."""
    top = F.lit(2_000_000).cast("decimal(18,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", top, (l + r).cast("decimal(20,0)"))


def with_lowest_cut(df: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """Adds l, r and score of the lowest-scoring cut, the first of equal ones."""
    each = [F.struct(score(F.col("f"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate(cuts)]  # noqa: E741
    return df.withColumn("cut", F.array_min(F.array(*each)))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, num: int = 80, den: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` phrases of 2 to 4 words, without those inside a
    longer candidate of ``num`` / ``den`` their frequency or more."""
    n, (one, two, three, four) = frequent_phrases(docs, least)

    def by(df: DataFrame, side: str, what: DataFrame, **columns: str) -> DataFrame:
        return df.join(what.select(F.col("id").alias(side), *(F.col(c).alias(name) for name, c in columns.items())), side)

    two = by(by(two, "a", one, lang="lang", head="word", fa="f"), "b", one, tail="word", fb="f")
    two = stored(two.withColumn("phrase", F.concat_ws(" ", "head", "tail")), "two")
    three = by(three, "a", two, lang="lang", head="phrase", f12="f", f1="fa")
    three = by(three, "b", two, tail="tail", f23="f", f3="fb")
    three = stored(three.withColumn("phrase", F.concat_ws(" ", "head", "tail")), "three")
    four = by(four, "a", three, lang="lang", head="phrase", f123="f", f12="f12", f1="f1", w12="a", w23="b")
    four = by(four, "b", three, tail="tail", f234="f", f34="f23", f4="f3", w34="b")
    four = stored(four.withColumn("phrase", F.concat_ws(" ", "head", "tail")), "four")
    parts = [(three, 2, "a"), (three, 2, "b"), (four, 3, "a"), (four, 3, "b"), (four, 2, "w12"), (four, 2, "w23"), (four, 2, "w34")]
    inside = None
    for df, words, part in parts:
        rows = df.select(F.lit(words).alias("words"), F.col(part).alias("id"), F.col("f").alias("longer"))
        inside = rows if inside is None else inside.unionByName(rows)
    inside = inside.groupBy("words", "id").agg(F.max("longer").alias("longer"))
    found = None
    for words, df, cuts in ((2, two, [("fa", "fb")]), (3, three, [("f1", "f23"), ("f12", "f3")]), (4, four, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])):
        rows = with_lowest_cut(df, cuts).select(F.lit(words).alias("words"), "id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    large = F.lit(den).cast("decimal(18,0)") * F.col("longer") >= F.lit(num).cast("decimal(18,0)") * F.col("a")
    found = found.join(inside, ["words", "id"], "left").where(F.col("longer").isNull() | ~large)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = found.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same in DuckDB, with the query's parameters.
SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
), pieces AS (SELECT d, lang, unnest(range(len(pieces))) AS k, unnest(pieces) AS piece FROM texts),
spelt AS (SELECT d, lang, k, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT d, lang, k, unnest(range(len(w))) AS i, unnest(w) AS w FROM spelt),
grams AS (
  SELECT lang, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS e FROM words WINDOW p AS (PARTITION BY d, k ORDER BY i)
), counts AS (
  SELECT lang, a AS g, 1 AS m, count(*) AS f FROM grams GROUP BY lang, g
  UNION ALL SELECT lang, a || ' ' || b AS g, 2, count(*) FROM grams WHERE b IS NOT NULL GROUP BY lang, g
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c AS g, 3, count(*) FROM grams WHERE c IS NOT NULL GROUP BY lang, g
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || e AS g, 4, count(*) FROM grams WHERE e IS NOT NULL GROUP BY lang, g
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, g, m, f, string_split(g, ' ') AS w FROM counts WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.g, c.m, c.f, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) AS c
  JOIN counts AS x ON x.lang = c.lang AND x.m = c.k AND x.g = array_to_string(c.w[1:c.k], ' ')
  JOIN counts AS y ON y.lang = c.lang AND y.m = c.m - c.k AND y.g = array_to_string(c.w[c.k + 1:c.m], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(w[i:i + j - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM candidates)))
  GROUP BY lang, g
), ranked AS (
  SELECT o.lang, o.g AS phrase, o.f AS a, o.l, o.r, o.score, row_number() OVER (PARTITION BY o.lang ORDER BY o.score DESC, o.f DESC, o.g) AS rank
  FROM lowest AS o LEFT JOIN inside AS i ON i.lang = o.lang AND i.g = o.g
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * o.f
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
