"""Graph and document views over the driver's tables, as Spark DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(t: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    return t.select(F.concat(F.lit(f"{kind.lower()}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type of regions, nations, customers, suppliers, and parts but every seventh, so that
    some edges dangle."""
    parts = [("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name")]
    out = _nodes(read(spark, sf_dir, "part").where("p_partkey % 7 <> 0"), "Part", "p_partkey", "p_name")
    for table, kind, key, name in parts:
        out = out.unionByName(_nodes(read(spark, sf_dir, table), kind, key, name))
    return out


def _edges(t: DataFrame, source: str, a: str, relation: str, target: str, b: str) -> DataFrame:
    return t.select(F.concat(F.lit(f"{source}:"), F.col(a).cast("string")).alias("source"), F.lit(relation).alias("relation"), F.concat(F.lit(f"{target}:"), F.col(b).cast("string")).alias("target"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, relation, target with repetitions, dangling ends and some self-loops."""
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    bought = line.join(orders, line.l_orderkey == orders.o_orderkey)
    return (
        _edges(bought, "customer", "o_custkey", "BOUGHT", "part", "l_partkey")
        .unionByName(_edges(line, "supplier", "l_suppkey", "SUPPLIES", "part", "l_partkey"))
        .unionByName(_edges(read(spark, sf_dir, "customer"), "customer", "c_custkey", "LOCATED_IN", "nation", "c_nationkey"))
        .unionByName(_edges(read(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "LOCATED_IN", "nation", "s_nationkey"))
        .unionByName(_edges(read(spark, sf_dir, "nation"), "nation", "n_nationkey", "PART_OF", "region", "n_regionkey"))
        .unionByName(_edges(read(spark, sf_dir, "part").where("p_partkey % 50 = 0"), "part", "p_partkey", "RELATED_TO", "part", "p_partkey"))
    )


def edge_rows(spark: SparkSession, sf_dir: str) -> int:
    """About how many rows ``raw_edges`` has, by the rows of the tables alone."""
    count = lambda t: read(spark, sf_dir, t).count()
    return 2 * count("lineitem") + count("customer") + count("supplier") + count("part")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(spark, sf_dir).distinct()


#: The same views for SQL.
NODES = """nodes AS (SELECT 'part:' || p_partkey AS id, p_name AS name, 'Part' AS type FROM part WHERE p_partkey % 7 <> 0
 UNION ALL SELECT 'region:' || r_regionkey, r_name, 'Region' FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation' FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier' FROM supplier)"""
RAW_EDGES = """raw_edges AS (SELECT 'customer:' || o_custkey AS source, 'BOUGHT' AS relation, 'part:' || l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey FROM lineitem UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey FROM nation
 UNION ALL SELECT 'part:' || p_partkey, 'RELATED_TO', 'part:' || p_partkey FROM part WHERE p_partkey % 50 = 0)"""
GRAPH = f"WITH {NODES}, {RAW_EDGES}, edges AS (SELECT DISTINCT * FROM raw_edges)"
