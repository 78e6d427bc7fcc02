"""Collocations against brute force, and against the query's own SQL."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
from test_repeats import DDL, corpus

from kgraph.llm.collocations import SQL, collocations
from kgraph.llm.queries import op12_phrase_collocations


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                covered |= {p[i : i + m] for i in range(len(p) - m + 1) if 100 * a >= 80 * c[p[i : i + m]]}
        best = []
        for p, a in cand.items():
            if p not in covered:
                s, k = min((int(Fraction(2_000_000 * a, c[p[:k]] + c[p[k:]])), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def texts(rng):
    rows = corpus(rng, 15)
    vocabulary = ["New", "york", "city", "hall", "É", "a", "b", "of the"]
    for i in range(60):
        w = rng.choices(vocabulary, [5, 5, 4, 3, 2, 6, 6, 1], k=rng.randint(0, 80))
        rows.append((500 + i, "".join(x + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", " \x0b"]) for x in w), rng.choice(["en", "de", None, ""]), "c", 0))
    return [*rows, (None, "new york " * 9, "en", "c", 0), (3, None, "xx", "c", 0), (4, "york york york york", "xx", "c", 0)]


def test_equals_brute_force(spark):
    for seed, least, top in ((1, 3, 2000), (2, 2, 7), (3, 30, 5)):
        rows = texts(random.Random(seed))
        docs = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS word", "2 AS a", "3 AS shard").repartition(3)
        assert sorted(map(tuple, collocations(docs, least, top).collect())) == brute(rows, least, top)
    assert collocations(spark.createDataFrame([], DDL)).collect() == []


def test_long_text(spark):
    long = "one two three, " * 200_000
    got = collocations(spark.createDataFrame([(1, long, "en", "c", 0)], DDL)).collect()
    assert [(r.phrase, r.a, r.score) for r in got] == [("one two three", 200_000, 1_000_000)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(SQL)
    got = op12_phrase_collocations(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
