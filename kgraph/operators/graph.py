"""Graph operators: upserts, traversal, paths, scoring and audits over nodes(id, name, type) and edges(source, relation, target).

Node tables may be as large as edge tables, so nothing is broadcast by hand but frontiers of a checked size.
Traversals take edges as a DataFrame or as an ``Adjacency``, whose layout spares them the shuffle of all edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, content_tokens, plain
from ..sources.adjacency import Adjacency, Front, adjacency
from ..sources.shared import cut


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key, the last by ``order``, as an upsert in that order leaves it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def valid_relation(c: Column, strict: bool = False) -> Column:
    """The upper-cased label; where it is none, null, or with ``strict`` an error that ends the job."""
    label = F.upper(F.trim(c))
    ok = F.when(label.rlike("^[A-Z][A-Z0-9_]*$"), label)
    return ok.otherwise(F.raise_error(F.concat(F.lit("no relation type: "), F.coalesce(c, F.lit("null"))))) if strict else ok


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist, each once."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi").dropDuplicates(["source", "relation", "target"])


def described(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with names and types of both ends; dangling ones drop out."""
    a = nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    b = nodes.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return edges.join(a, "source").join(b, "target")


def named(ids: DataFrame, nodes: DataFrame, column: str = "id") -> DataFrame:
    """Rows with name and type of the node in ``column``; those without a node drop out."""
    return ids.join(nodes.select(F.col("id").alias(column), "name", "type"), column)


def neighbours(edges: DataFrame | Adjacency, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, direction, relation, id, name, type of all nodes one edge away."""
    edges, front = adjacency(edges), Front(seeds)
    out = edges.leaving(front).select(F.col("source").alias("seed"), F.lit("out").alias("direction"), "relation", F.col("target").alias("id"))
    into = edges.entering(front).select(F.col("target").alias("seed"), F.lit("in").alias("direction"), "relation", F.col("source").alias("id"))
    return named(out.unionByName(into), nodes).select("seed", "direction", "relation", "id", "name", "type")


def fetched(edges: DataFrame | Adjacency, nodes: DataFrame, seeds: DataFrame, relations: list[str] | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
    """Described edges at the seeds, of the relations given, the first ``limit`` by source, relation and target."""
    edges, front = adjacency(edges), Front(seeds)
    if relations:
        edges = edges.where(F.col("relation").isin(relations))
    found = edges.touching(front) if direction == "both" else edges.leaving(front) if direction == "out" else edges.entering(front)
    rows = described(found, nodes)
    return rows.orderBy("source", "relation", "target").limit(limit) if limit else rows


def expand(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """source, relation, target, hop: each edge at the first hop that meets it. The first hop follows
    ``direction``; later ones leave nodes only. Self-loops are left out. An edge met again leaves a node that an
    earlier hop has left, and so is not met again; but one that entered a seed may leave the node it came from."""
    edges = adjacency(edges).where("source <> target")
    if relations:
        edges = edges.where(F.col("relation").isin(relations))
    front = Front(seeds)
    seen, found, met = front.ids, None, None
    for hop in range(1, hops + 1):
        if hop == 1:
            step = edges.touching(front) if direction == "both" else edges.entering(front) if direction == "in" else edges.leaving(front)
        else:
            step = edges.leaving(front)
            if hop == 2 and direction != "out":  # those that entered a seed in the first hop
                step = seeds_left.without(step, "target")
        step = step.dropDuplicates(["source", "relation", "target"]).withColumn("hop", F.lit(hop))
        step = cut(step) if hops > 1 else step
        found = step if found is None else found.unionByName(step)
        if hop < hops:
            seeds_left = front if hop == 1 else None
            ends = step.select(F.col("source").alias("id")).unionByName(step.select(F.col("target").alias("id"))).distinct()
            front = Front(ends.join(seen, "id", "left_anti"))
            seen = seen.unionByName(front.ids)
    return found


def distances(edges: DataFrame | Adjacency, start: DataFrame, hops: int) -> DataFrame:
    """id, hops: the least number of edges, whatever their direction, from the start nodes, to ``hops``."""
    edges, front = adjacency(edges), Front(start)
    seen = front.ids.withColumn("hops", F.lit(0))
    for h in range(1, hops + 1):
        step = edges.leaving(front).select(F.col("target").alias("id")).unionByName(edges.entering(front).select(F.col("source").alias("id"))).distinct()
        front = Front(step.join(seen, "id", "left_anti"))
        if not front.n:
            break
        seen = seen.unionByName(front.ids.withColumn("hops", F.lit(h)))
    return seen


def shortest_path(edges: DataFrame | Adjacency, start: str, end: str, most: int | None = None) -> list[tuple[str, str, str, bool]]:
    """Steps (from, relation, to, forward) of a shortest path, the least predecessor first; [] for the
    same node and where there is none; with ``most``, of so many steps at most. Levels are checkpointed, so the
    plan doesn't grow, and the search ends where a level reaches no new node."""
    edges = adjacency(edges)
    spark = edges.by_source.sparkSession
    front = Front(spark.createDataFrame([(start,)], "id string"))
    seen, steps = front.ids, []
    while start != end and (most is None or len(steps) < most):
        out = edges.leaving(front).select(F.col("target").alias("id"), F.struct("source", "relation", F.lit(True).alias("forward")).alias("via"))
        into = edges.entering(front).select(F.col("source").alias("id"), F.struct(F.col("target").alias("source"), "relation", F.lit(False).alias("forward")).alias("via"))
        step = out.unionByName(into).join(seen, "id", "left_anti").groupBy("id").agg(F.min("via").alias("via"))
        step = cut(step)
        front = Front(step)
        if not front.n:
            return []
        steps.append(step)
        if not step.where(F.col("id") == end).isEmpty():
            path, at = [], end
            for s in reversed(steps):
                via = s.where(F.col("id") == at).first()["via"]
                path.append((via["source"], via["relation"], at, via["forward"]))
                at = via["source"]
            return path[::-1]
        seen = seen.unionByName(front.ids)
    return []


def edge_scores(rows: DataFrame, seeds: DataFrame, targets: list[str], question: list[str], hints: list[str]) -> DataFrame:
    """Adds score and strong to described edges with a hop. ``seeds``: id, score."""
    a = seeds.select(F.col("id").alias("source"), F.col("score").alias("a"))
    b = seeds.select(F.col("id").alias("target"), F.col("score").alias("b"))
    rows = rows.join(a, "source", "left").join(b, "target", "left")
    typed = F.when(F.col("relation").isin(targets), 1.0).otherwise(0.2) if targets else F.lit(0.5)
    other = F.when(F.col("a").isNotNull(), F.col("target_name")).otherwise(F.col("source_name"))
    kind = plain(F.when(F.col("a").isNotNull(), F.col("target_type")).otherwise(F.col("source_type")))
    overlap = F.size(F.array_intersect(F.array(*map(F.lit, question)).cast("array<string>"), content_tokens(other)))
    score = typed + F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))) / 200 - 0.15 * (F.col("hop") - 1) + F.least(F.lit(0.9), 0.3 * overlap) + F.when(contains_any(kind, hints), 0.3).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 3)).withColumn("strong", F.col("relation").isin(targets) if targets else F.lit(False)).drop("a", "b")


def capped(rows: DataFrame, group: str, cap: int, most: int, order: list[Column]) -> DataFrame:
    """The best ``cap`` rows of each group, of those the best ``most``: two bounded top-k steps."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_n", rank).where(F.col("_n") <= cap).drop("_n").orderBy(*order).limit(most)


def degrees(edges: DataFrame | Adjacency) -> DataFrame:
    """id, degree: edges out and in; a self-loop counts twice. Of a layout each side is counted in its own buckets."""
    edges = adjacency(edges)
    out = edges.by_source.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    into = edges.by_target.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return out.unionByName(into).groupBy("id").agg(F.sum("n").alias("degree"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def violations(rows: DataFrame, rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Described edges whose end types their relation's rule doesn't allow; relations without a rule pass."""
    wrong = F.lit(False)
    for relation, (sources, targets) in rules.items():
        wrong = wrong | ((F.col("relation") == relation) & ~(F.col("source_type").isin(sources) & F.col("target_type").isin(targets)))
    return rows.where(wrong)


def wrong_targets(rows: DataFrame, relation: str, kinds: list[str]) -> DataFrame:
    """Described edges of a relation whose target is of none of the types."""
    return rows.where((F.col("relation") == relation) & ~F.coalesce(F.col("target_type"), F.lit("")).isin(kinds))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between new ids (mapping: id, new_id), without dangling ends, self-loops and repetitions."""
    a, b = mapping.select(F.col("id").alias("source"), F.col("new_id").alias("s")), mapping.select(F.col("id").alias("target"), F.col("new_id").alias("t"))
    out = edges.join(a, "source").join(b, "target").where("s <> t")
    return out.select(F.col("s").alias("source"), "relation", F.col("t").alias("target")).distinct()
