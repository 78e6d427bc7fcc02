"""A graph laid out for traversal: nodes by id, edges once by source and once by target, in buckets.

The layout is written once, in the folder that driver and executors share, and read by any number of queries. A join
of edges with a frontier shuffles the frontier alone, as the edges lie in buckets of their own already; few ids are
given to the scan, which then opens their buckets alone.

A layout costs a shuffle of all edges for each direction. A query that looks up few nodes once is better
served by ``looked_up``: the same operators filter the tables that edges are made of.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_folder

#: Ids of a frontier that become a filter of the scan, and those that are broadcast.
LITERALS, BROADCAST = 200, 400_000
#: Edges in a bucket, repetitions included.
BUCKET_EDGES = 1_000_000


@dataclass
class Adjacency:
    """Edges by source and by target. Made of one plain DataFrame, it works without a layout. ``repeated``: edges may
    repeat, and those looked up are made distinct."""

    by_source: DataFrame
    by_target: DataFrame
    repeated: bool = False

    def where(self, condition) -> Adjacency:
        return Adjacency(self.by_source.where(condition), self.by_target.where(condition), self.repeated)

    def leaving(self, front: Front) -> DataFrame:
        return self._once(front.of(self.by_source, "source"))

    def entering(self, front: Front) -> DataFrame:
        return self._once(front.of(self.by_target, "target"))

    def _once(self, rows: DataFrame) -> DataFrame:
        return rows.distinct() if self.repeated else rows

    def touching(self, front: Front) -> DataFrame:
        """Edges with an end in the frontier, each once."""
        return self.leaving(front).unionByName(front.without(self.entering(front), "source"))


class Front:
    """Distinct ids of a frontier: a filter of the scan where they are few, else a side to join, broadcast up to a
    checked size."""

    def __init__(self, ids: DataFrame):
        self.ids = cut(ids.select("id").distinct())
        self.n = self.ids.count()
        self.few = [r.id for r in self.ids.collect()] if self.n <= LITERALS else None

    def _joined(self, df: DataFrame, column: str, how: str) -> DataFrame:
        ids = self.ids.select(F.col("id").alias(column))
        return df.join(F.broadcast(ids) if self.n <= BROADCAST else ids, column, how).select(*df.columns)

    def of(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isin(self.few)) if self.few is not None else self._joined(df, column, "left_semi")

    def without(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(~F.col(column).isin(self.few)) if self.few is not None else self._joined(df, column, "left_anti")


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    return edges if isinstance(edges, Adjacency) else Adjacency(edges, edges)


@dataclass
class Graph:
    nodes: DataFrame
    edges: Adjacency


def looked_up(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph for looking up few nodes: ``edges`` may repeat, and nothing is written."""
    return Graph(nodes, Adjacency(edges, edges, True))


def _buckets(spark: SparkSession, rows: int) -> int:
    """By the number of edges: an estimate of Catalyst's multiplies the sides of a join."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, min(1 << 16, -(-rows // BUCKET_EDGES)))


def _laid(df: DataFrame, name: str, path: str, key: str, buckets: int, once: bool = False) -> None:
    # dealt by the key as the buckets are, so each task writes one file, and all copies of an edge meet there
    dealt = df.repartition(buckets, key)
    dealt = dealt.distinct() if once else dealt
    dealt.write.bucketBy(buckets, key).option("path", f"{path}/{name}").format("parquet").saveAsTable(name)


def lay_out(nodes: DataFrame, edges: DataFrame, name: str | None = None, rows: int | None = None) -> str:
    """Writes nodes(id, name, type) and the distinct edges(source, relation, target); returns the layout's name. ``rows``:
    about how many edges there are, repetitions included, where that is known without making them."""
    spark = nodes.sparkSession
    name = name or f"graph_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/graphs/{name}-{uuid.uuid4().hex}"
    buckets = _buckets(spark, edges.count() if rows is None else rows)
    _laid(nodes.select("id", "name", "type"), f"{name}_nodes", path, "id", buckets)
    _laid(edges.select("source", "relation", "target"), f"{name}_out", path, "source", buckets, True)
    _laid(spark.table(f"{name}_out"), f"{name}_in", path, "target", buckets)
    return name


def laid_out(spark: SparkSession, name: str) -> Graph:
    return Graph(spark.table(f"{name}_nodes"), Adjacency(spark.table(f"{name}_out"), spark.table(f"{name}_in")))


def graph_of(spark: SparkSession, source: str, nodes, edges, rows=None) -> Graph:
    """The layout of the graph that ``nodes()`` and ``edges()`` give for a source, laid out at its first use in a session.
    ``rows()``: see ``lay_out``."""
    name = "graph_" + hashlib.sha256(source.encode()).hexdigest()[:24]
    if not spark.catalog.tableExists(f"{name}_in"):
        for part in ("nodes", "out"):  # of a layout that wasn't finished
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
        lay_out(nodes(), edges(), name, rows() if rows else None)
    return laid_out(spark, name)
