"""The extraction runner and the record store."""

import pytest
from pyspark.sql import functions as F

from kgraph.operators import extraction as X
from kgraph.streaming.incremental import extract_new
from kgraph.streaming.records import in_order, merge_records, stored_records


def _tried(model, content="x" * 4000, bucket=None, **over):
    waits = []
    args = {"limit": 8000, "margin": 400, "prompt": 900, "low": 800, "high": 6000, "tries": 5, "delay": 10.0, "shrinks": 4} | over
    rows = list(X.calls(7, content, model, bucket, waits.append, **args))
    return rows, waits


def test_rate_limits_wait_twice_as_long_each_time():
    def model(attempt, **_):
        if attempt < 4:
            raise RuntimeError("Error 429: slow down")
        return 'Here: ```json\n{"entities": [{"name": "é"}]}\n```'

    rows, waits = _tried(model)
    assert waits == [10, 20, 40] and [r[2] for r in rows] == ["rate_limited"] * 3 + ["ok"]
    assert rows[-1][-1] == '{"entities": [{"name": "é"}], "relationships": []}'

    def always(**_):
        raise RuntimeError("rate_limit reached")

    rows, waits = _tried(always)
    assert waits == [10, 20, 40, 80] and [r[2] for r in rows] == ["rate_limited"] * 4 + ["failed"]


def test_long_requests_shrink_the_answer_then_the_content():
    seen = []

    def model(content, completion, **_):
        seen.append((len(content), completion))
        used = 900 + len(content) // 4 + completion
        if used > 5000:
            raise RuntimeError(f"Request too large. Limit 5000, Requested {used}")
        return "{}"

    rows, waits = _tried(model, "y" * 20_000)
    assert [r[2] for r in rows] == ["too_long", "ok"] and waits == []
    # 7,600 - 900 - 5,000 leaves 1,700 for the answer; 2,600 and the margin are too many for it, so content goes
    assert seen == [(20_000, 1700), (20_000 - 4 * 3000, 800)]
    rows, _ = _tried(model, "y" * 4000)
    assert [(r[2], r[5]) for r in rows] == [("too_long", 5700), ("ok", 5700 - 2600 - 400)]

    def stubborn(**_):
        raise RuntimeError("Limit 10, Requested 100000")

    assert [r[2] for r in _tried(stubborn)[0]] == ["failed"]


def test_other_errors_end_the_chunk():
    for model in (lambda **_: "no braces", lambda **_: '{"entities": 3}', lambda **_: "{broken}"):
        rows, waits = _tried(model)
        assert [r[2] for r in rows] == ["failed"] and waits == []


def test_token_bucket_spaces_calls():
    clock = [0.0]
    bucket = X.Bucket(600, lambda: clock[0])  # ten a second
    assert bucket.wait(600) == 0 and bucket.wait(50) == 5
    clock[0] = 5.0
    assert bucket.wait(100) == 10
    clock[0] = 1000.0
    assert bucket.wait(600) == 0


def test_attempts_in_spark(spark):
    def model(chunk_id, attempt, **_):
        if chunk_id % 3 == 0 and attempt == 1:
            raise RuntimeError("Too Many Requests")
        if chunk_id % 5 == 0:
            raise RuntimeError("boom")
        return "{}"

    tried = X.attempts(spark.createDataFrame([(i, None if i == 4 else "t") for i in range(20)], "chunk_id int, content string"), model, 3, 1e9, sleep=lambda s: None)
    got = {r.chunk_id: (r.error, r.attempts) for r in X.outcomes(tried).collect()}
    assert got == {i: ("boom" if i % 5 == 0 else None, 2 if i % 3 == 0 else 1) for i in range(20)}


def test_merge_replaces_errors_and_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/records"
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, error string, record string")
    assert stored_records(spark, path) is None
    first = make([("c1", None, "one"), ("c2", "bad", None), ("c3", "bad", None), ("gone", None, "x")])
    second = make([("c2", None, "two"), ("c1", "late", None), ("c3", "worse", None)])
    chunks = spark.createDataFrame([("c3", 1), ("c1", 2), ("c2", 3), ("c9", 4)], "chunk_id string, ord int")
    merge_records(path, make([]), 0)
    for batch, rows in ((0, first), (1, second), (1, second)):
        merge_records(path, rows, batch, chunks)
    got = [tuple(r) for r in in_order(stored_records(spark, path), chunks, "ord").collect()]
    assert got == [("c3", "worse", None), ("c1", None, "one"), ("c2", None, "two")]


def test_failed_batch_runs_again(spark, tmp_path):
    src, sink, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c"
    crash = [True]

    def extract(df):
        out = df.withColumn("error", F.when(F.col("chunk_id") == 2, "bad").cast("string"))
        if crash[0]:
            merge_records(sink, out, 0)  # stored, and then the driver dies
            raise RuntimeError("lost")
        return out

    spark.createDataFrame([(i, "t") for i in (1, 2)], "chunk_id long, content string").write.parquet(src)
    with pytest.raises(Exception, match="lost"):
        extract_new(spark, src, "chunk_id long, content string", sink, check, extract).awaitTermination()
    crash[0] = False
    extract_new(spark, src, "chunk_id long, content string", sink, check, extract).awaitTermination()
    assert sorted((r.chunk_id, r.error) for r in stored_records(spark, sink).collect()) == [(1, None), (2, "bad")]
    spark.createDataFrame([(i, "t") for i in (1, 2, 3)], "chunk_id long, content string").write.mode("append").parquet(src)
    seen = []
    extract_new(spark, src, "chunk_id long, content string", sink, check, lambda df: seen.append(sorted(r.chunk_id for r in df.collect())) or df.withColumn("error", F.lit(None).cast("string")), retry_failed=True).awaitTermination()
    assert seen == [[2, 3]]
    assert sorted((r.chunk_id, r.error) for r in stored_records(spark, sink).collect()) == [(1, None), (2, None), (3, None)]
