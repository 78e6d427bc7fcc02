"""Each pipeline stage against a recomputation from its own input."""

import corpus_pipeline
from test_jaccard import brute
from test_tokens_packing_media import words

from kgraph.llm.common import stored
from kgraph.llm.line_dedup import dedup_lines
from kgraph.llm.quality import quality_scores

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first, stages, seen = docs, dict(corpus_pipeline.STAGES), {}
    for name, f in corpus_pipeline.STAGES:
        out = stored(f(spark, docs, DIR), "test")
        assert name == "best_fit_packing" or out.columns == first.columns
        seen[name], docs = (docs, out), out
    assert list(stages) == ["quality_classifier", "line_dedup", "jaccard_join", "benchmark_decontamination", "best_fit_packing"]

    before, after = ({r.doc_id: r.text for r in df.collect()} for df in seen["quality_classifier"])
    scores = {r.doc_id: r.predicted for r in quality_scores(seen["quality_classifier"][0], spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    assert after == {i: t for i, t in before.items() if scores[i]}

    before, after = seen["line_dedup"]
    lines = {r.doc_id: r for r in dedup_lines(before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == {i: r.text for i, r in lines.items() if not r.n_removed or r.text.strip()}
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in seen["jaccard_join"])
    assert sorted(i for i, _ in after) == sorted(i for i, _, c in brute(before, 5, 80, 100) if i == c)

    before, after = ({r.doc_id: r.text for r in df.collect()} for df in seen["benchmark_decontamination"])
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[j : j + min(10, len(w))]) for j in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(t):
        w = words(t)
        return not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))

    assert after == {i: t for i, t in before.items() if clean(t)}

    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and clashing columns pass the stages that keep documents."""
    ddl = "doc_id long, text string, lang string, source string, n_chars int, n_lines string, n_removed int, chunk int, copy long, rep string, label int"
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, "en", None, None, "a", 1, 2, 3, "x", 4), (2, "", "en", "s", 0, "b", 1, 2, 3, "x", 4), (3, long, "en", "s", 9, "c", 1, 2, 3, None, 4), (3, long, "en", "s", 9, "c", 1, 2, 3, None, 4), (3, "other text", "en", "s", 9, "d", 1, 2, 3, None, 4), (4, long + " more", "en", "s", 9, "e", 1, 2, 3, None, 4), (None, "x", "en", "s", 1, "f", 1, 2, 3, "x", 4)]
    for docs in (spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            docs = stored(f(spark, docs, DIR), "odd")
            assert docs.columns == [c.split()[0] for c in ddl.split(", ")], name
        got = {r.doc_id: r for r in docs.collect()}
        assert None not in got and all(r.n_lines in "abcde" and r.n_removed == 1 for r in got.values())
        assert corpus_pipeline.packing(spark, docs, DIR).count() >= len(got)
    docs = spark.createDataFrame(rows, ddl)
    lines = {(r.doc_id, r.text): r.n_chars for r in corpus_pipeline.line_dedup(spark, docs, DIR).collect()}
    assert lines == {(1, None): None, (2, ""): 0, (3, long): 9, (3, "other text"): 9}
    kept = corpus_pipeline.jaccard_join(spark, docs, DIR).collect()
    assert sorted((r.doc_id, r.n_lines) for r in kept) == [(1, "a"), (2, "b"), (3, "d")]
