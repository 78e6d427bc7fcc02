"""SimHash components against brute force."""

import random
import re

import numpy as np
import xxhash
from test_repeats import DDL, corpus

from kgraph.llm.simhash_dedup import RADIUS, links, near_pairs, simhash_components


def near(rng):
    rows = corpus(rng, 20)
    for base in range(5):
        words = [str(rng.randint(0, 10**6)) for _ in range(rng.choice([1, 3, 4, 5, 9, 60, 300]))]
        for j in range(12):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(["Q", "zz", "É"])
            rows.append((20000 + base * 100 + (j * 7) % 50, rng.choice([" ", "  ", "\t\x0b"]).join(w), "en", "c", 0))
    return [*rows, (None, "no id", "en", "c", 0), (5, " \n", "en", "c", 0), (5, "twice", "en", "c", 0)]


def fingerprint(text, k=4):
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in (text or "").encode().split()]
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, prints):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= RADIUS:
                label[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(least.get(find(a), i), i)
    return [least[find(a)] for a in range(len(ids))]


def test_components_equal_brute_force(spark):
    for seed, block in ((1, 2048), (2, 3)):
        rows = near(random.Random(seed))
        own = [(i, fingerprint(t)) for i, t, *_ in rows if i is not None]
        want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(own, brute(*map(list, zip(*own, strict=True))), strict=True))
        # columns of the caller named as the operator's own
        docs = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS fp", "'x' AS key", "2 AS node", "3 AS component_id")
        assert sorted(map(tuple, simhash_components(docs, block=block).collect())) == want
    assert simhash_components(spark.createDataFrame([], DDL)).collect() == []


def test_long_text(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randint(0, 99999)) for _ in range(300_000))
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame([(1, long, "en", "c", 0), (2, long + " end", "en", "c", 0)], DDL)).collect()}
    assert got[1].fingerprint == f"{fingerprint(long):016x}" and got[2].component_id == 1


def test_links_of_clouds(spark):
    """Fingerprints around a few centres, at all distances up to 8 bits, in tiles of a few rows."""
    rng = np.random.default_rng(3)
    prints = []
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            flip = rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist()
            prints.append(centre ^ sum(1 << b for b in flip))
    prints = sorted(set(prints))
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    for block in (2048, 4):
        found = links(spark.createDataFrame(rows, "node long, fp long"), block=block).collect()
        root = list(range(len(prints)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in found:
            x, y = find(r.a), find(r.b)
            root[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(prints))] == brute(list(range(len(prints))), prints)


def test_large_groups_return_stars():
    rng = np.random.default_rng(5)
    for n, groups in ((300, 1), (500, 3), (200, 20)):
        group = np.sort(rng.integers(0, groups, n))
        centre = rng.integers(0, 2**63, 9, dtype=np.uint64)
        fp = centre[rng.integers(0, 9, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 9, n).astype(np.uint64))
        a, b = near_pairs(group, fp, RADIUS)
        assert len(a) < n
        label = np.arange(n)
        label[a] = b
        for g in range(groups):
            mine = np.flatnonzero(group == g)
            want = brute(mine.tolist(), fp[mine].tolist())
            assert label[mine].tolist() == want
