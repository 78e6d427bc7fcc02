"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from kgraph.llm.substring_dedup import substring_dedup
from kgraph.llm.suffix_dedup import repeated_starts, shared_prefixes, suffix_dedup, suffix_order

DDL = "doc_id long, text string, lang string, chunk string, bucket int"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def corpus(rng: random.Random, n: int = 60) -> list[tuple]:
    word = lambda: rng.choice(["a", "the", "é", "of,", "ß", "x" * rng.randint(1, 9), str(rng.randint(0, 99))])
    shared = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(5)]
    rows: list[tuple] = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        for p in range(2):
            if rng.random() < 0.5:
                parts.insert(p, rng.choice(shared))
        rows.append((i * 3 + 1, rng.choice(["\n", " ", "\t "]).join(parts), "en", "c", 1))
    rows += [(1000 + i, rows[i][1], "en", "c", 2) for i in range(10)]
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0), (5002, " \n", "", "", 0), (None, "x", "", "", 0), (5003, "ab " * 4000, "", "", 0), (5004, "z" * 900, "", "", 0)]
    return rows + [rows[0]]


def by_words(rows, window=13):
    docs = [(i, t or "") for i, t, *_ in rows if i is not None]
    least: dict = {}
    lists = [(i, t.encode().split()) for i, t in docs]
    for i, w in lists:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def by_bytes(rows, least=200):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows if i is not None]
    seen = Counter(t[k : k + least] for _, t in docs for k in range(len(t) - least + 1))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        g = gone[: len(t)]
        out.append((i, len(t), int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()) if len(t) else 0, sha(bytes(np.frombuffer(t, np.uint8)[~g]))))
    return sorted(out)


def test_substring_dedup_equals_brute_force(spark):
    for seed in range(2):
        rows = corpus(random.Random(seed))
        got = substring_dedup(spark.createDataFrame(rows, DDL), with_text=False).collect()
        assert sorted(map(tuple, got)) == by_words(rows)


def test_suffix_dedup_equals_brute_force(spark):
    for seed in range(2):
        rows = corpus(random.Random(seed + 10))
        got = suffix_dedup(spark.createDataFrame(rows, DDL), with_bytes=False).collect()
        assert sorted(map(tuple, got)) == by_bytes(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert substring_dedup(empty).collect() == [] and suffix_dedup(empty).collect() == []


def test_suffix_order_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        sym, sa, rank = suffix_order(texts)
        tails = [tuple(sym[i:].tolist()) for i in range(len(sym))]
        assert sa.tolist() == sorted(range(len(sym)), key=tails.__getitem__)
        assert (rank[sa] == np.arange(len(sa))).all()
        for least in (1, 3, 8):
            common = []
            for a, b in zip(sa[:-1], sa[1:], strict=True):
                k = 0
                while tails[a][k] == tails[b][k]:
                    k += 1
                common.append(min(k, least))
            assert shared_prefixes(sym, sa, rank, len(texts), least).tolist() == common
        flags = repeated_starts(texts, np.ones(len(texts), np.int64), 3)
        seen = Counter(t[k : k + 3] for t in texts for k in range(len(t) - 2))
        assert [f.tolist() for f in flags] == [[seen[t[k : k + 3]] > 1 for k in range(max(0, len(t) - 2))] for t in texts]


def test_nothing_goes_without_the_automaton():
    import pyarrow as pa

    from kgraph.llm.kernels import slabs
    from kgraph.llm.substring_dedup import compiled, covered_words, digest

    text = " ".join(f"w{i}" for i in range(17))
    s = next(slabs(np.array([5]), pa.array([f"a b c {text} d e f"])))
    words = s.data.tobytes().split()
    # every passage of every phrase counts as confirmed, so that the winnowed one is among them
    known = {digest(b" ".join(words[i:j])): np.full(j - i - 12, 1) for i in range(len(words)) for j in range(i + 13, len(words) + 1)}
    phrases = b"\n".join(b" ".join(words[i : i + 5]) for i in range(len(words) - 4))
    gone, first = covered_words(s, compiled(phrases, 5), known, 13, 5)
    assert gone.all() and first.tolist() == [0, 23]
    assert not covered_words(s, compiled(b"", 5), known, 13, 5)[0].any()
    assert not covered_words(s, compiled(phrases, 5), {}, 13, 5)[0].any()


def test_a_text_longer_than_a_slab(spark):
    from kgraph.llm.kernels import SLAB

    rng = random.Random(2)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(SLAB // 5))
    rows = [(1, long, "", "", 0), (2, "x y z " + long[:300_000], "", "", 0), (3, long, "", "", 0)]
    df = spark.createDataFrame(rows, DDL)
    assert sorted(map(tuple, substring_dedup(df, with_text=False).collect())) == by_words(rows)
    assert sorted(map(tuple, suffix_dedup(df, with_bytes=False).collect())) == by_bytes(rows)
