"""Classes of alike names against brute force."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from kgraph.functions.text import similarity_name, strip_titles
from kgraph.operators.similar import least_labels, shared_runs, similar_names
from kgraph.sources.views import nodes


def brute(rows, least):
    """rows: (id, norm, type)."""
    rows = sorted(r for r in rows if r[1])
    label = {r[0]: r[0] for r in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x, t) in enumerate(rows):
        for b, y, u in rows[i + 1 :]:
            if t == u and find(a) != find(b) and (x == y or (min(len(x), len(y)) >= 4 and difflib.SequenceMatcher(None, x, y).ratio() >= least)):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return sorted((r[0], find(r[0])) for r in rows)


def _norms(df):
    return [(r.id, r.n, r.type) for r in df.select("id", similarity_name(strip_titles(F.col("name"))).alias("n"), "type").collect()]


@pytest.mark.parametrize(("least", "block"), [(0.88, 1000), (0.92, 7)])
def test_classes_equal_brute_force_on_all_types(spark, least, block):
    df = nodes(spark, "/root/testdata/sf0.001")
    got = sorted((r.id, r.class_id) for r in similar_names(df, least, block).collect())
    assert got == brute(_norms(df), least)


def test_classes_of_edited_names(spark):
    rng = random.Random(8)
    rows = []
    for base in range(25):
        word = "".join(rng.choice("abcdeé 12") for _ in range(rng.choice([4, 5, 8, 11, 12, 15, 16, 30, 60])))
        for _ in range(8):
            w = list(word)
            for _ in range(rng.randint(0, 1 + len(word) // 8)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "x"])
            rows.append((f"n{len(rows):04}", rng.choice(["", "Dr. ", "MR "]) + "".join(w), rng.choice(["P", "P", "Q"])))
    rows += [("z1", None, "P"), ("z2", "", "P"), ("z3", "!", None), (None, "abcd", "P")]
    df = spark.createDataFrame(rows, "id string, name string, type string")
    want = brute([r for r in _norms(df) if r[0]], 0.88)
    for block in (1000, 3):
        assert sorted((r.id, r.class_id) for r in similar_names(df, 0.88, block).collect()) == want


def test_shared_runs_is_a_bound():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 30)))
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.choice([0, 1])] = rng.choice(["", "d"])
        b = "".join(b)
        if b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.88:
            for k in (2, 3):
                grams = lambda t: sorted(t[i : i + k] for i in range(len(t) - k + 1))  # noqa: B023, E731
                left, both = grams(b), 0
                for g in grams(a):
                    if g in left:
                        left.remove(g)
                        both += 1
                assert both >= shared_runs(len(a), k, 0.88)


def test_least_labels(spark):
    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("m", "k")]
    got = {r.id: r.label for r in least_labels(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(61)} | {"x": "x", "y": "x", "m": "k", "k": "k"}


def test_types_joined_by_one_letter_are_not_taken_apart(spark, monkeypatch):
    from kgraph.operators import similar

    rows = [(f"c{i:03}", "Customer", f"customer#{i:09}") for i in range(60)] + [("p1", "Part", "large red gear box"), ("p2", "Part", "small blue bolt")]
    taken, cut = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df: taken.append(kept := cut(df)) or kept)
    got = {r.id: r.class_id for r in similar.similar_names(spark.createDataFrame(rows, "id string, type string, name string"), 0.88).collect()}
    assert got == {i: "c000" if t == "Customer" else i for i, t, _ in rows}
    runs = [df for df in taken if "run" in df.columns and "size" in df.columns]
    assert runs and {r.type for r in runs[0].select("type").distinct().collect()} == {"Part"}
