"""Cleaning extracted records and canonicalising the graph made of them. Word lists and rules are the caller's."""

from __future__ import annotations

import uuid
from itertools import chain

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import casefold, collapse, match_key, tokens
from ..sources.shared import shared_folder
from .entities import dedup_mentions, resolve_endpoints


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The stripped value, or what the table has for it."""
    c = F.trim(c)
    return F.coalesce(F.create_map(*map(F.lit, chain(*table.items())))[c], c) if table else c


def changes(values: DataFrame, column: str, table: dict[str, str]) -> DataFrame:
    """old, new, n for each value that the table changes."""
    old = F.trim(column)
    return values.select(old.alias("old"), mapped(F.col(column), table).alias("new")).where(F.col("old").isin(list(table))).groupBy("old", "new").agg(F.count("*").alias("n"))


def display_name(name: Column, aliases: dict[str, str]) -> Column:
    """The name to show: that of the alias table by match key, else the collapsed name."""
    shown = F.create_map(*map(F.lit, chain(*aliases.items())))[match_key(name)] if aliases else F.lit(None).cast("string")
    return F.coalesce(shown, collapse(name))


def valid_ends(r: DataFrame) -> Column:
    """Whether source, relation and target are all there and not empty."""
    return F.forall(F.array("source", "relation", "target"), lambda x: F.coalesce(x, F.lit("")) != "")


def validity(relationships: DataFrame) -> DataFrame:
    """valid, n."""
    return relationships.groupBy(valid_ends(relationships).alias("valid")).agg(F.count("*").alias("n"))


def first_edges(relationships: DataFrame, relation_table: dict[str, str]) -> DataFrame:
    """Valid relationships(source, relation, target, ord), one an edge by match keys and mapped relation: the
    names of the first one are kept as they were written."""
    r = relationships.where(valid_ends(relationships)).withColumn("relation", mapped(F.col("relation"), relation_table))
    r = r.withColumn("s", match_key(F.col("source"))).withColumn("t", match_key(F.col("target")))
    first = F.min_by(F.struct(collapse("source").alias("source_name"), collapse("target").alias("target_name")), "ord")
    return r.groupBy("s", "relation", "t").agg(first.alias("f"), F.count("*").alias("n")).select(F.col("s").alias("source"), "relation", F.col("t").alias("target"), "f.source_name", "f.target_name", "n")


def reconcile_unknown(entities: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """(id, new_id) for each of entities(id, key, type, ord): one of unknown type is the earliest entity of
    another type with its key, where there is one."""
    known = entities.where(F.col("type") != unknown).groupBy("key").agg(F.min_by("id", F.struct("ord", "id")).alias("typed"))
    new = F.when(F.col("type") == unknown, F.coalesce("typed", "id")).otherwise(F.col("id"))
    return entities.join(known, "key", "left").select("id", new.alias("new_id"))


def comparison_text(name: Column, rewrites: dict[str, str], dropped: list[str]) -> Column:
    """A name for comparison alone: case-folded, punctuation to spaces, whole words inside it rewritten (not at
    its ends, where no space stands on both sides), words dropped, white space collapsed."""
    out = F.regexp_replace(casefold(name), r"[.,;:()\-–—/&]", " ")
    for old, new in rewrites.items():
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} " if new else " "))
    for word in dropped:
        out = F.regexp_replace(out, rf"\b{word}\b", " ")
    return collapse(out)


def canonical_key(kind: Column, text: Column, rules: list[tuple[str, list[str], str]], stripped: dict[str, str]) -> Column:
    """What nodes of one type are merged by: the key of the first rule (type, words all of which the text contains,
    key), else the text without the ``stripped`` pattern of its type."""
    out = text
    for t, pattern in stripped.items():
        out = F.when(kind == t, collapse(F.regexp_replace(text, pattern, " "))).otherwise(out)
    for t, words, key in reversed(rules):
        hit = kind == t
        for w in words:
            hit = hit & F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def similarity_tier(a: Column, b: Column) -> Column:
    """0 where either is empty, 1 equal, 0.98 equal token sets, 0.94 one contains the other; null where a
    ratio has to decide (``entities.resolve``). For normalised names."""
    x, y = F.array_sort(tokens(a)), F.array_sort(tokens(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(x == y, 0.98).when(F.contains(a, b) | F.contains(b, a), 0.94)


def merged_rows(nodes: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """One row a new id: the canonical node's own name, every other column its first value that isn't empty, in
    ``order``. Nodes that the mapping lacks keep their id."""
    rest = [c for c in nodes.columns if c not in ("id", "name", order)]
    n = nodes.join(mapping.select("id", "new_id"), "id", "left").withColumn("new_id", F.coalesce("new_id", "id"))

    def filled(c: str) -> Column:
        there = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.min_by(c, F.when(there, F.struct(order, "id"))).alias(c)

    own = F.col("id") == F.col("new_id")
    name = F.coalesce(F.min_by("name", F.when(own, F.col(order))), F.min_by("name", F.struct(order, "id"))).alias("name")
    return n.groupBy(F.col("new_id").alias("id")).agg(name, *[filled(c) for c in rest], F.count("*").alias("members"))


def remap_all(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between new ids; an end that the mapping lacks stays. No self-loops, each edge once."""
    a, b = mapping.select(F.col("id").alias("source"), F.col("new_id").alias("s")), mapping.select(F.col("id").alias("target"), F.col("new_id").alias("t"))
    out = edges.join(a, "source", "left").join(b, "target", "left")
    out = out.select(F.coalesce("s", "source").alias("source"), "relation", F.coalesce("t", "target").alias("target"))
    return out.where("source <> target").distinct()


RECORD = "entities array<struct<name:string,type:string>>, relationships array<struct<source:string,relation:string,target:string>>"


def valid_record(raw: Column) -> Column:
    """Whether an extraction answer is an object with both lists, every entity with name and type, every
    relationship with its three members."""
    r = F.from_json(raw, RECORD)
    whole = lambda x, names: F.forall(F.array(*[x[n] for n in names]), lambda v: F.coalesce(v, F.lit("")) != "")
    ok = F.forall(r["entities"], lambda e: whole(e, ("name", "type"))) & F.forall(r["relationships"], lambda e: whole(e, ("source", "relation", "target")))
    return F.coalesce(r["entities"].isNotNull() & r["relationships"].isNotNull() & ok, F.lit(False))


def limit_error(message: Column) -> Column:
    """{limit, requested} from an error of a model's token limit, null for other errors."""
    part = lambda word: F.regexp_extract(message, rf"(?i){word}:?\s*(\d+)", 1).try_cast("long")
    return F.when(part("limit").isNotNull() & part("requested").isNotNull(), F.struct(part("limit").alias("limit"), part("requested").alias("requested")))


def chunk_number(chunk_id: Column, fallback: Column) -> Column:
    """The digits at the end of an id, else the fallback."""
    return F.coalesce(F.regexp_extract(chunk_id, r"(\d+)$", 1).try_cast("long"), fallback)


def prompt(template: str, kinds: list[str], relations: list[str], content: Column) -> Column:
    """``template`` has three places: types of entities, types of relations, the chunk."""
    return F.format_string(template, F.lit(", ".join(kinds)), F.lit(", ".join(relations)), content)


@dataclass
class CleanGraph:
    nodes: DataFrame  # key, type, name, inferred
    edges: DataFrame  # source, source_type, relation, target, target_type, source_name, target_name, n
    report: DataFrame  # metric, value


def _written(df: DataFrame, folder: str, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """Writes a table and gives it back with metrics of it, counted as it was written."""
    seen = Observation(name)
    df.observe(seen, *[F.coalesce(c.cast("long"), F.lit(0)).alias(k) for k, c in metrics.items()]).write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"), seen.get


def clean_graph(mentions: DataFrame, relationships: DataFrame, expected: dict[tuple[str, str], str], type_table: dict[str, str], relation_table: dict[str, str]) -> CleanGraph:
    """Typed nodes and edges of mentions(name, type, ord) and relationships(source, relation, target, ord), and a report of
    what was found and changed: its counts are taken while the tables are written, so nothing is read for them.

    ``expected``: the type of a relation's source and target. Names that no mention has become nodes, of the type that
    their first reference expects, else Unknown."""
    spark = mentions.sparkSession
    folder = f"{shared_folder(spark)}/tables/clean-{uuid.uuid4().hex}"
    count, changed = F.count(F.lit(1)), lambda c, table: F.sum(F.trim(c).isin(list(table)).cast("int"))
    there = (F.coalesce(F.col("name"), F.lit("")) != "") & (F.coalesce(F.col("type"), F.lit("")) != "")
    m, told = _written(mentions.where(there).select("name", "type", "ord"), folder, "mentions", raw_mentions=count, type_changes=changed(F.col("type"), type_table))
    entities = dedup_mentions(m.withColumn("type", mapped(F.col("type"), type_table)))
    entities, more = _written(entities.select("key", "type", "name", "ord"), folder, "entities", mentioned_nodes=count)
    told |= more
    r = relationships.select("source", "relation", "target", "ord", valid_ends(relationships).alias("valid"))
    r, more = _written(r, folder, "relationships", raw_relationships=count, invalid_relationships=F.sum((~F.col("valid")).cast("int")), relation_changes=changed(F.when(F.col("valid"), F.col("relation")), relation_table))
    told |= more
    r = r.where("valid").withColumn("relation", mapped(F.col("relation"), relation_table))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("named"), F.lit(i).alias("i")) for i, s in enumerate(("source", "target"))]))
    ends = r.select("ord", "relation", sides.alias("e")).select((2 * F.col("ord") + F.col("e.i")).alias("ord"), "relation", "e.side", match_key(F.col("e.named")).alias("key"), collapse(F.col("e.named")).alias("name"))
    ends, _ = _written(resolve_endpoints(entities, ends, expected).select("ord", "side", "key", "type", "name"), folder, "ends", ends=count)
    made = ends.join(entities.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min_by("type", "ord").alias("type"), F.min_by("name", "ord").alias("name"))
    nodes = entities.select("key", "type", "name", F.lit(False).alias("inferred")).unionByName(made.select("key", "type", "name", F.lit(True).alias("inferred")))
    unknown = F.col("type") == "Unknown"
    nodes, more = _written(nodes, folder, "nodes", unique_nodes=count, inferred_nodes=F.sum((F.col("inferred") & ~unknown).cast("int")), unknown_nodes=F.sum(unknown.cast("int")))
    told |= more
    half = lambda side, i: ends.where(F.col("side") == side).select(((F.col("ord") - i) / 2).cast("long").alias("ord"), F.col("key").alias(side), F.col("type").alias(f"{side}_type"), F.col("name").alias(f"{side}_name"))
    edges = r.select(F.col("ord").cast("long").alias("ord"), "relation").join(half("source", 0), "ord").join(half("target", 1), "ord")
    first = F.min_by(F.struct("source_name", "target_name"), "ord")
    edges = edges.groupBy("source", "source_type", "relation", "target", "target_type").agg(first.alias("f"), count.alias("n")).select("source", "source_type", "relation", "target", "target_type", "f.source_name", "f.target_name", "n")
    edges, more = _written(edges, folder, "edges", unique_edges=count, used_relationships=F.sum("n"))
    told |= more
    told["duplicate_mentions"] = told["raw_mentions"] - told["mentioned_nodes"]
    told["duplicate_relationships"] = told["used_relationships"] - told["unique_edges"]
    return CleanGraph(nodes, edges, spark.createDataFrame(sorted(told.items()), "metric string, value long"))


def raw_lookup(mentions: DataFrame, relationships: DataFrame, names: list[str]) -> DataFrame:
    """name, found, n: how often each name stands, once trimmed, as an entity, a source or a target; those that stand nowhere
    are told as NOT FOUND."""
    spark = mentions.sparkSession
    places = mentions.select(F.trim("name").alias("name"), F.lit("entity").alias("found"))
    for side in ("source", "target"):
        places = places.unionByName(relationships.select(F.trim(side).alias("name"), F.lit(side).alias("found")))
    hits = places.where(F.col("name").isin(names)).groupBy("name", "found").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    return wanted.join(hits, "name", "left").select("name", F.coalesce("found", F.lit("NOT FOUND")).alias("found"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
