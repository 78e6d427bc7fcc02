"""The quality classifier on held-out labels, and licence scans against the same model in plain Python."""

import math
import random

import pytest

from kgraph.llm import license_scan as L
from kgraph.llm.quality import accepted, quality_scores

DIR = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.97
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_odd_rows(spark):
    rows = [(1, None, 3), (2, "", 3), (2, "", 3), (3, "words " * 9000, 1), (None, "x", 1), (4, "\n", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, features int")
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (some, none):
        got = quality_scores(df, labels).collect()
        assert sorted(r.doc_id for r in got) == [1, 2, 2, 3, 4] and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert quality_scores(df.limit(0), some).collect() == []
    assert accepted(df, none).columns == df.columns


def plain(text):
    """Families and probability of a document by the model's own Python."""
    m, found = L.model(), []
    for line in (text or "").split("\n"):
        w = L.words_of(line)
        grams = {g for g in L.ngrams(w) if g in m.weights}
        if not grams:
            continue
        p = m.probabilities(grams)
        best = max(range(len(p)), key=p.__getitem__)
        if m.classes[best] == L.UNKNOWN or p[best] < 0.6:
            continue
        n = min(3, len(w))
        own = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
        share = 0.0
        for t in L.TEMPLATES[m.classes[best]]:
            x = L.words_of(t)
            k = min(3, len(x))
            tris = {" ".join(x[i : i + k]) for i in range(len(x) - k + 1)}
            share = max(share, len(own & tris) / min(len(own), len(tris)))
        if share >= 0.5:
            found.append((m.classes[best], p[best]))
    return found


def test_model_is_accurate():
    assert L.model().accuracy > 0.9


def test_license_scan(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(["er tion an", text, "the end"]), "p") for i, text in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    docs += [(100 + i, t, "p") for i, t in enumerate(L.DISTRACTORS)] + [(200, None, "p"), (201, "", "p"), (None, "MIT License", "p"), (202, "license " * 3000, "p"), docs[0]]
    docs += [(300 + i, "  ".join(rng.sample(L.words_of(t), 6)), "p") for i, t in enumerate(x for ts in L.TEMPLATES.values() for x in ts if len(L.words_of(x)) > 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, families string")
    got = {}
    for r in L.license_scan(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(i for i, rs in got.items() for _ in rs) == sorted(d[0] for d in docs if d[0] is not None)
    for i, text, _ in docs:
        if i is None:
            continue
        want = plain(text)
        for r in got[i]:
            assert (r.n_licensed, r.families) == (len(want), ",".join(sorted({f for f, _ in want})))
            assert r.n_paragraphs == sum(bool(x.strip(" ")) for x in (text or "").split("\n")) if text else r.n_paragraphs == 0
            assert r.probability == (pytest.approx(max(p for _, p in want), abs=1e-5) if want else None)
    families = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    right = sum(got[i][0].families == f for i, f in enumerate(families))
    assert right >= math.ceil(0.95 * len(families)) and not any(got[100 + i][0].families for i in range(len(L.DISTRACTORS)))
    assert L.license_scan(df.limit(0)).collect() == []


def test_notices_without_a_word_of_licences(spark):
    rows = [(1, "some text\nCC BY-SA 4.0\nmore"), (2, "CC BY-NC 4.0"), (3, "in source and binary forms, with or without modification"), (4, "a day at the sea")]
    got = {r.doc_id: r.families for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "cc-by-sa-4.0", 2: "cc-by-nc-4.0", 3: "bsd", 4: ""}
    assert all(set(w[i : i + 3]) & set(L.ANCHORS) for ts in L.TEMPLATES.values() for t in ts for w in [L.words_of(t)] for i in range(max(1, len(w) - 2)))


def test_risk_and_its_slope():
    import numpy as np

    from kgraph.llm.quality import PuModel, risk, risk_slope, told_apart

    rng = np.random.default_rng(1)
    for prior, shift in ((0.3, 2.0), (0.7, 1.0), (0.5, -4.0)):
        f = np.r_[rng.normal(1, 1, 7), rng.normal(-shift, 1, 9)]
        l = lambda z: [math.log(1 + math.exp(-x)) for x in z]  # noqa: E731, E741
        mean = lambda z: sum(z) / len(z)
        gain, rest = prior * mean(l(f[:7])), mean(l(-f[7:])) - prior * mean(l(-f[:7]))
        assert risk(f, 7, prior) == pytest.approx((gain, rest))
        slope = risk_slope(f, 7, prior)
        for i in range(len(f)):
            up, down = f.copy(), f.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            whole = lambda z: sum(risk(z, 7, prior)) if rest >= 0 else -risk(z, 7, prior)[1]  # noqa: E731, B023
            assert slope[i] == pytest.approx((whole(up) - whole(down)) / 2e-5, abs=1e-6)
            apart = lambda z: mean(l(z[:7])) + mean(l(-z[7:]))
            assert told_apart(f, 7)[i] == pytest.approx((apart(up) - apart(down)) / 2e-5, abs=1e-6)
    # the prior is found without a negative label
    for prior in (0.25, 0.6):
        p = rng.normal(1.5, 1, (3000, 30))
        u = np.concatenate([rng.normal(1.5, 1, (int(8000 * prior), 30)), rng.normal(-1.5, 1, (int(8000 * (1 - prior)), 30))])
        assert PuModel().fit(p, u).prior == pytest.approx(prior, abs=0.1)


def test_wrapped_notices_are_one_paragraph(spark):
    import textwrap

    mit = next(t for t in L.TEMPLATES["mit"] if len(t) > 150)
    rows = [(1, "Some words of another kind.\n" + textwrap.fill(mit, 72) + "\nThe end of it."), (2, mit), (3, "One line.\nTwo lines."), (4, "\n".join(["a word " * 10] * 3))]
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_paragraphs, got[1].n_licensed, got[1].families) == (3, 1, "mit")
    assert got[1].probability == got[2].probability and [got[i].n_paragraphs for i in (2, 3, 4)] == [1, 2, 1]
