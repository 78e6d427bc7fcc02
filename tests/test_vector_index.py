"""The inverted-file vector index against the exhaustive search."""

import numpy as np

from kgraph.operators import retrieval as R
from kgraph.operators import vector_index as V
from kgraph.operators.retrieval import nearest


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_recall_and_share_on_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.15 * rng.normal(size=16)).tolist(), i % 3) for i in range(1500)]
    # a third of all rows is one vector
    rows += [(2000 + i, centres[0].tolist(), 9) for i in range(700)] + [(5000, None, 0), (5001, [0.0] * 16, 0)]
    v = _vectors(spark, rows)
    queries = v.where("vec_id % 20 = 0 AND vec_id < 5000")
    unit = _vectors(spark, [(i, (np.array(e) / np.linalg.norm(e)).tolist(), x) for i, e, x in rows if i < 5000])
    index = V.build_index(unit)
    exact = nearest(unit, unit.where("vec_id % 20 = 0"), 10)
    found = V.search_index(index, unit.where("vec_id % 20 = 0"), 10)
    got = V.recall(found, exact).first()
    assert got.recall >= 0.9 and got.pairs == 10 * queries.count()
    assert V.share_read(index, unit.where("vec_id % 20 = 0 AND vec_id < 1500")).first().share < 0.5
    assert index.rows.count() == 2200
    # all cells: the exhaustive result itself, in one block and in several
    cells = len(index.centroids)
    want = sorted(map(tuple, exact.collect()))
    assert sorted(map(tuple, V.search_index(index, unit.where("vec_id % 20 = 0"), 10, cells).collect())) == want
    assert sorted(map(tuple, V.search_index(index, unit.where("vec_id % 20 = 0"), 10, cells, max_queries=40).collect())) == want


def test_odd_tables(spark):
    none = V.build_index(_vectors(spark, [(1, None, 0), (2, [0.0, 0.0], 0)]))
    assert none.probes == 0 and V.search_index(none, _vectors(spark, [(1, [1.0, 0.0], 0)]), 3).collect() == []
    one = V.build_index(_vectors(spark, [(1, [2.0, 0.0], 0)]))
    assert [tuple(r) for r in V.search_index(one, _vectors(spark, [(7, [1.0, 0.0], 0)]), 3).collect()] == [(7, 1, 2.0, 1)]


def test_recall_on_the_given_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = v.where("vec_id % 20 = 0")
    assert V.recall(V.search_index(V.build_index(v), queries, 10), nearest(v, queries, 10)).first().recall >= 0.9


def test_matrices_rank_as_pairs_do(spark):
    """Ties at six places, copies in mass, odd vectors and odd queries, ids that are strings: as if pair by pair."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(f"v{i:04d}", (base[i % 40] * (1 + 1e-7 * (i % 3))).tolist(), 0) for i in range(900)] + [(f"c{i:04d}", base[0].tolist(), 0) for i in range(600)]
    rows += [("none", None, 0), ("short", [1.0], 0), ("hole", [None] + [1.0] * 7, 0), ("far", [float("inf")] + [0.0] * 7, 0), ("nan", [float("nan")] * 8, 0), ("large", (1e6 * base[1]).tolist(), 0)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int").repartition(3)
    queries = v.where("vec_id LIKE '%0' OR vec_id IN ('none', 'short', 'hole', 'large')")
    got = sorted(map(str, R.nearest(v, queries, 7, max_queries=60).collect()))
    asked = queries.selectExpr("vec_id AS query_id", "embedding AS query")
    assert got == sorted(map(str, R.ranked(R._pairs(v, asked), 7).collect()))
    # a block's products are of matrices, not an expression a pair
    plan = R.scored_by(v.where(R.regular("embedding", 8)), asked.where(R.regular("query", 8)).toArrow(), "string", 7)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
