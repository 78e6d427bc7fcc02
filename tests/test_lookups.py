"""Lookups of few nodes read the tables alone; a layout takes repeated edges in one shuffle a direction."""

from pyspark.sql import functions as F

import kgraph.plans.queries as Q
from kgraph.operators import graph as G
from kgraph.operators import paths as W
from kgraph.sources.adjacency import laid_out, lay_out, looked_up
from kgraph.sources.views import edge_rows, nodes, raw_edges

DATA = "/root/testdata/sf0.001"
LOOKUPS = ["one_hop_neighbors", "two_hop_expand", "context_lines", "relation_lookup", "entity_paths", "role_targets", "question_seeds"]


def test_lookups_lay_nothing_out(spark, tmp_path):
    """Over a folder of its own, whose graph no other test has laid out."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    for name in LOOKUPS:
        assert Q.queries()[name](spark, str(tmp_path)).count() >= 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_looked_up_and_laid_out_agree(spark):
    n, e = nodes(spark, DATA), raw_edges(spark, DATA)
    e = e.unionByName(e.where("source = 'customer:1'"))  # repeated
    a, b = looked_up(n, e), laid_out(spark, lay_out(n, e, rows=edge_rows(spark, DATA)))
    seeds = spark.createDataFrame([("customer:1",), ("supplier:3",), ("nation:5",)], "id string")
    pairs = seeds.select(F.col("id").alias("start")).crossJoin(seeds.select(F.col("id").alias("end")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(b.edges.by_source) == rows(e.distinct()) == rows(b.edges.by_target.select("source", "relation", "target"))
    for what in (lambda g: G.neighbours(g.edges, g.nodes, seeds), lambda g: G.expand(g.edges, seeds, 2), lambda g: W.pair_paths(g.edges, pairs)):
        assert rows(what(a)) == rows(what(b))


def test_rows_known_beforehand_are_not_counted(spark):
    assert edge_rows(spark, DATA) >= raw_edges(spark, DATA).where("relation <> 'PART_OF' AND relation <> 'RELATED_TO'").count()
