"""A breadth-first crawl over a table of links: a queue first in, first out, a visited set and a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ordering import numbered
from ..sources.shared import cut


def crawl(links: DataFrame, seeds: list[str], budget: int = 500, blocked: DataFrame | None = None) -> DataFrame:
    """url, depth, visit: the pages that a crawl of at most ``budget`` visits comes to, by links(url, link).

    A queue is worked off first in, first out: what a page links to joins it in order of its text (sets have none),
    and a page visited or queued already isn't queued again. So all of one depth come before the next, in order of the
    visit that queued them, then by text; each round takes a whole depth and is checkpointed. ``blocked`` (url)
    counts as visited, and its links aren't followed."""
    spark = links.sparkSession
    links = cut(links.select("url", "link").where("link IS NOT NULL"))  # every round reads them
    first = [(u, 0, i) for i, u in enumerate(list(dict.fromkeys(seeds))[:budget], 1)]
    front = seen = spark.createDataFrame(first, "url string, depth int, visit long")
    depth, n = 0, len(first)
    while n < budget:
        depth += 1
        open_ = front.join(blocked.select("url"), "url", "left_anti") if blocked is not None else front
        queued = links.join(open_.select("url", "visit"), "url").groupBy(F.col("link").alias("url")).agg(F.min("visit").alias("by"))
        queued = queued.join(seen.select("url"), "url", "left_anti")
        front = numbered(queued, "visit", "by", "url").where(F.col("visit") <= budget - n)
        front = cut(front.select("url", F.lit(depth).alias("depth"), (F.col("visit") + n).alias("visit")))
        new = front.count()
        if not new:
            break
        n += new
        seen = seen.unionByName(front)
    return seen
