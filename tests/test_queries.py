"""Every registered query of the library against its SQL on the smallest tables, and small fixtures."""

import random

import pytest
from oracle import compare

import kgraph.plans.queries as Q
from kgraph.operators import entities as E
from kgraph.operators import graph as G

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    compare(spark, DIR, name, Q.queries()[name], Q.oracle_sql().get(name))


def test_shortest_path_equals_breadth_first_search(spark):
    rng = random.Random(4)
    pairs = [(str(rng.randint(0, 30)), "R", str(rng.randint(0, 30))) for _ in range(35)]
    edges = spark.createDataFrame(pairs, "source string, relation string, target string")
    near = {}
    for a, _, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in (("1", "2"), ("3", "17"), ("5", "5"), ("1", "none")):
        dist, front = {a: 0}, [a]
        while front:
            x = front.pop(0)
            for y in near.get(x, ()):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    front.append(y)
        path = G.shortest_path(edges, a, b)
        assert len(path) == dist.get(b, 0)
        for (_, _, to, _), (frm, _, _, _) in zip(path, path[1:], strict=False):
            assert to == frm


def test_leaders_follow_the_sequential_rule(spark):
    rng = random.Random(9)
    for _ in range(3):
        ids = [f"n{i:02}" for i in range(25)]
        pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(25)})
        near = {frozenset(p) for p in pairs}
        want = {}
        for i in ids:
            if i not in want:
                want[i] = i
                for j in ids:
                    if j > i and j not in want and frozenset((i, j)) in near:
                        want[j] = i
        got = E.leaders(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([(i,) for i in ids], "id string"))
        assert {r.id: r.leader for r in got.collect()} == want


def test_incremental_stream(spark, tmp_path):
    from kgraph.streaming.incremental import extract_new

    src, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([(i, "t") for i in ids], "chunk_id long, text string").write.mode("append").parquet(src)
        extract_new(spark, src, "chunk_id long, text string", sink, f"{tmp_path}/c", lambda df: df).awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_answer(spark):
    from kgraph.operators.retrieval import answer
    from kgraph.sources.views import edges, nodes

    chunks = Q._chunks(spark, DIR)
    assert "-[LOCATED_IN]->" in answer(spark, nodes(spark, DIR), edges(spark, DIR), chunks, "the license", "NATION_3")
    assert answer(spark, nodes(spark, DIR), edges(spark, DIR), chunks.limit(0), "zz", "nobody at all").startswith("There is not enough")


def test_equal_and_short_names_have_pairs_and_leaders(spark):
    rows = [("1", "Dr. Jane Smith", "P"), ("2", "Jane Smith", "P"), ("3", "Smith, Jane", "P"), ("4", "anna", "P"), ("5", "anxna", "P"), ("6", "Anna", "P"), ("7", "Jane Smith", "Q"), ("8", "", "P"), ("9", "!", "P"), ("a", "jane smith of york", "P")]
    df = spark.createDataFrame(rows, "id string, name string, type string")
    got = {(r.a, r.b): r.score for r in E.fuzzy_pairs(df, 0.88).collect()}
    assert got[("1", "2")] == got[("4", "6")] == 1.0 and got[("4", "5")] == 0.889
    lead = {r.id: r.leader for r in E.resolve(df).collect()}
    assert lead == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5", "6": "4", "7": "7", "8": "8", "9": "9", "a": "a"}


def test_nearest_in_blocks(spark):
    from kgraph.operators.retrieval import nearest

    v = spark.read.parquet(f"{DIR}/embeddings.parquet")
    few = v.where("vec_id % 20 = 0")
    assert sorted(nearest(v, few, 3, max_queries=7).collect()) == sorted(nearest(v, few, 3).collect())
