"""Token files, packing, media and decontamination against plain recomputation."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_repeats import DDL, corpus
from tokenizers import Tokenizer

from kgraph.llm import media, tokens
from kgraph.llm.decontaminate import decontaminate
from kgraph.llm.kernels import slabs
from kgraph.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound, report
from kgraph.llm.token_files import read_tokens, token_digests, tokens_round_trip, write_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["  a  b\n\n c\t\td\n \n e  ", "\n\nx", "don't 'S I'm <|endoftext|> x", "A\r\nB\n\n\n C \t", "ñ ́é é x\xa0 y", "   ", "12 345\n67 !!?? a's\x1cb", "ΑΣ ΑΣ. İ", "a \nb \n c\n d", "x<|startoftext|>", "日本 語　x", "¡Hola! l'été—où?"]


def rows_of(seed):
    rows = corpus(random.Random(seed), 40)
    return rows + [(9000 + i, t, "en", "c", 1) for i, t in enumerate(ODD)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    rows, lib = rows_of(1), Tokenizer.from_file(BYTE)
    want, start = [], 0
    for i, t in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    df = spark.createDataFrame(rows, DDL)
    assert sorted(map(tuple, tokens_round_trip(df, BYTE).collect())) == want
    write_tokens(df, f"{tmp_path}/t", BYTE, encoding="delta")
    files = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, token_digests(files).collect())) == want
    one = read_tokens(files, [9002]).collect()
    assert [(r.doc_id, r.start, r.n_tokens, crc(r.tokens)) for r in one] == [w for w in want if w[0] == 9002]
    assert tokens_round_trip(spark.createDataFrame([], DDL), BYTE).collect() == []


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_CACHE", 100)
    rng, lib = random.Random(5), Tokenizer.from_file(BYTE)
    e = tokens.PieceEncoder(BYTE, True)
    for i in range(6):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + rng.choice(["", ",", "."]) for _ in range(9)) for _ in range(5)]
        for s in slabs(np.arange(5), pa.array(texts)):
            ids, bounds = e.slab(s)
            assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert max(len(e.ids), len(e.words)) <= 100


def test_token_files_whatever_the_session_says(spark, tmp_path):
    rows = [(i, f"text number {i} of many", "en", "c", 0) for i in range(200)]
    df = spark.createDataFrame(rows, DDL)
    want = sorted(map(tuple, tokens_round_trip(df, BYTE).collect()))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        assert sorted(map(tuple, tokens_round_trip(df, BYTE).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_token_files_have_page_indexes_and_the_encoding_asked_for(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, f"text number {i} of many " * 40, "en", "c", 0) for i in range(3000)], DDL).coalesce(1)
    for encoding, found in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        write_tokens(df, f"{tmp_path}/{encoding}", BYTE, encoding=encoding, page_rows=100)
        file = max((tmp_path / encoding).glob("*.parquet"), key=lambda p: p.stat().st_size)
        group = pq.ParquetFile(file).metadata.row_group(0)
        ids = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "doc_id")
        tokens = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("tokens"))
        assert ids.has_column_index and ids.has_offset_index and tokens.has_offset_index
        assert any(e == found or (found == "RLE_DICTIONARY" and e.endswith("DICTIONARY")) for e in tokens.encodings)


def test_packing(spark):
    rows, lib = rows_of(2), Tokenizer.from_file(WORD)
    want = []
    for i, t in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + 64]), crc(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64))]
    packed = best_fit_packing(spark.createDataFrame(rows, DDL), WORD, context=64, partition_rows=100)
    got = packed.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 64
    used, bound = report(packed, 64)
    assert used == len(places) and bound <= used <= bound * 1.02 + 1
    assert best_fit_packing(spark.createDataFrame([], DDL), WORD).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 40))
        bins, offsets, left = best_fit_decreasing(lengths, 20)
        assert lower_bound(lengths, 20) <= len(left) and (np.bincount(bins, lengths) + left == 20).all()
    assert lower_bound(np.array([11, 11, 11]), 20) == 3 and lower_bound(np.array([7] * 6), 20) == 3


def test_media(spark):
    rows = rows_of(3)
    got = {(r.doc_id, r.n_bytes): r for r in media.text_media(spark.createDataFrame(rows, DDL)).collect()}
    for i, t, *_ in rows:
        if i is None:
            continue
        text = (t or "").encode()
        payload = text + b"\xff" * (max(576, -(-len(text) // 576) * 576) - len(text))
        tiles = np.frombuffer(payload, np.uint8).reshape(-1, 24, 24)
        out = io.BytesIO()
        np.save(out, tiles)
        r = got[i, len(text)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        image = tiles.reshape(-1, 24).astype(float)
        y = np.linspace(0, len(image), 9)
        cell = lambda a, b, x0, x1: sum(max(0, min(b, k + 1) - max(a, k)) * max(0, min(x1, m + 1) - max(x0, m)) * image[k, m] for k in range(int(a), min(len(image), int(np.ceil(b)))) for m in range(int(x0), min(24, int(np.ceil(x1)))))
        if len(text) < 600:
            small = np.array([[cell(y[p], y[p + 1], 24 * q / 9, 24 * (q + 1) / 9) for q in range(9)] for p in range(8)]) / (len(image) / 8 * 24 / 9)
            assert r.feature == np.packbits(np.round(small, 6)[:, :-1] < np.round(small, 6)[:, 1:]).tobytes().hex()
    assert media.text_media(spark.createDataFrame([], DDL)).collect() == []


def test_image_forms(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    p6 = b"P6 # c\n7 5\n255\n" + a.tobytes()
    p3 = b"P3\n7 5\n255\n" + b" ".join(b"%d" % v for v in a.reshape(-1))
    pad = np.zeros((5, 3), np.uint8)
    bmp = b"BM" + b"\0" * 8 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\1\0" + (24).to_bytes(2, "little") + b"\0" * 24 + b"".join(row[:, ::-1].tobytes() + p.tobytes() for row, p in zip(a[::-1], pad, strict=True))
    for data in (p6, p3, bmp):
        assert (media.decode(data) == a).all()
    bits = rng.integers(0, 2, (3, 11), dtype=np.uint8)
    p4 = b"P4\n11 3\n" + np.packbits(bits, axis=1).tobytes()
    p1 = b"P1\n11 3\n" + b"\n".join(b"".join(b"%d" % v for v in row) for row in bits)
    assert (media.decode(p4) == (1 - bits) * 255).all() and (media.decode(p1) == (1 - bits) * 255).all()
    g = b"P2\n2 1\n15\n0 15"
    assert media.decode(g).tolist() == [[0, 255]]
    for bad in (b"", b"P5\n3 3\n255\nab", b"BM123", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)
    df = spark.createDataFrame([(1, bytearray(p6), "k"), (2, None, None), (3, bytearray(b"no"), "n")], "id int, img binary, dhash string")
    got = {r.id: r for r in media.tiles(df, "img", 4).collect()}
    assert (got[1].height, got[1].width, got[1].channels) == (5, 7, 3) and media.from_tiles(got[1].npy).shape == (4, 4, 4, 3)
    assert got[2].npy is None and got[3].dhash is None


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def test_decontaminate(spark):
    rng = random.Random(4)
    docs = corpus(rng, 60)
    texts = [r[1] for r in docs if r[1] and len(r[1]) > 300]
    items = [(i, rng.choice(["!", " "]).join(rng.choice(texts).upper().split()[2 : 2 + rng.choice([1, 2, 3, 9, 10, 14, 40])])) for i in range(12)]
    items += [(50, None), (51, "..."), (52, "never seen anywhere"), (53, items[0][1]), (None, "x")]
    named = [(str(i), words(t)) for i, t in items if i is not None]
    want = []
    for d, t, *_ in docs:
        if d is None:
            continue
        w = words(t)
        hit, found = [False] * len(w), []
        for name, x in named:
            n = min(10, len(x))
            wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else set()
            places = [a for a in range(len(w) - n + 1) if n and tuple(w[a : a + n]) in wins]
            for a in places:
                hit[a : a + n] = [True] * n
            if places:
                found.append(name)
        want.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    df, bench = spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 400):
        got = decontaminate(df, bench, block_bytes=size).drop("longest").collect()
        assert sorted(map(tuple, got)) == sorted(want)
        kept = decontaminate(df, bench, block_bytes=size, keep=True)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    assert decontaminate(spark.createDataFrame([], DDL), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate(df, spark.createDataFrame([], "item_id long, text string")).collect())
