"""Connected components of a graph of links, in DataFrame operations alone.

Alternating large and small stars (Kiveris et al., 2014): every step links a vertex's neighbours to the
least one, by an aggregation and a join. A vertex with a large share of all links is a hub, as the least
vertex of a large component is in the end: the join takes hubs, few as they must be, by broadcast
(``joined_by``), so no vertex's neighbours meet in one task. The number of steps grows with the logarithm
of the graph. Each step is checkpointed; nothing reaches the driver but a count and a sum that tell
whether the step changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, swept

#: A key is a hub if it has more than this share of the rows, so there are fewer hubs than its inverse.
SHARE = 1000


def joined_by(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, least: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. ``sizes``: key, n, the rows of each in ``left``,
    checkpointed. Keys with over ``least`` rows and 1 / SHARE of all are broadcast, fewer than SHARE rows."""
    total = sizes.agg(F.sum("n"), F.max("n")).first()
    bound = max(least, (total[0] or 0) // SHARE)
    if (total[1] or 0) <= bound:
        return left.join(right, key)
    hubs = F.broadcast(sizes.where(F.col("n") > bound).select(key))
    some = left.join(F.broadcast(right.join(hubs, key, "left_semi")), key)
    return some.unionByName(left.join(hubs, key, "left_anti").join(right.join(hubs, key, "left_anti"), key).select(*some.columns))


def _mark(edges: DataFrame) -> tuple:
    # both columns in one hash; summed as decimals, so no order and no overflow matters
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _lows(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))


#: Rows from which on a step's files get another partition.
ROWS = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each end of a link, label the least id of its component. ``edges``: a, b, longs.
    Links from an id to itself and repeated ones do no harm; without links there are no rows."""
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    spark = edges.sparkSession
    while True:
        # steps of a small graph are kept in few files
        few = max(1, min(partitions(spark), -(-2 * mark[0] // ROWS)))
        edges = edges.coalesce(few)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a task holds that many rows anyway: without a second partition there are no hubs to part
        low = cut(_lows(both).coalesce(few)) if few > 1 else _lows(both)
        lows = low.select("a", F.least("a", "low").alias("low"))
        large = joined_by(both, lows, "a", low.select("a", "n")) if few > 1 else both.join(lows, "a")
        large = cut(large.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct().coalesce(few))
        low = cut(_lows(large).coalesce(few)) if few > 1 else _lows(large)
        lows = low.select("a", "low")
        small = (joined_by(large, lows, "a", low.select("a", "n")) if few > 1 else large.join(lows, "a")).where(F.col("b") != F.col("low"))
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        edges = cut(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(few))
        now = _mark(edges)
        swept(spark)
        if now == mark:
            break
        mark = now
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
