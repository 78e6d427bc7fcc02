"""Names of one type that are alike, as classes: a similarity join that returns what connects, not all pairs.

Names meet by the rarest of their letter runs. A ratio of ``least`` bounds how many letters two names leave unmatched, and
so how many runs of two or three letters they share at least; of a name's runs, ordered by how many names have them, only
the first so many need be keys that one shared run must be among them. Runs of one type that very many names have are dealt
into blocks, and each two blocks are a tile of their own. In a tile letter counts bound the ratio from above for a name
with all others at once, and the ratio itself is taken only of names that links don't join yet.
"""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity_name, strip_titles
from ..sources.shared import cut
from .entities import ratio

#: Names up to so many letters meet by runs of two, those of at least so many by runs of three.
SHORT, LONG = 15, 12
#: Names of one run on a tile's side, and names of a part that are handled at once.
BLOCK, PART = 1000, 50_000


def shared_runs(n: int, k: int, least: float) -> int:
    """The fewest runs of k letters that a name of n letters shares with one whose ratio is ``least`` or more. With p and q
    letters unmatched on its own and the other side there are p + q + 1 matching blocks at most, and (2 - least) p +
    least q <= 2 (1 - least) n."""
    room, worst = 2 * (1 - least) * n + 1e-9, n
    for p in range(int(room / (2 - least)) + 1):
        q = int((room - (2 - least) * p) / least)
        worst = min(worst, n - p - (k - 1) * (p + q + 1))
    return worst


def _keys(least: float, longest: int) -> Column:
    """How many of a name's runs are keys, by its length: for runs of two, then of three."""
    def first(n: int, k: int) -> int:
        return max(0, n - k + 1 - max(0, shared_runs(n, k, least) - 1))

    table = {k: F.array(*[F.lit(first(n, k)) for n in range(longest + 1)]) for k in (2, 3)}
    return F.when(F.col("k") == 2, F.element_at(table[2], F.col("size") + 1)).otherwise(F.coalesce(F.try_element_at(table[3], F.col("size") + 1), F.col("size")))


def _linked(ids: list[str], norms: list[str], label: np.ndarray, sides: np.ndarray | None, least: float) -> list[tuple[str, str, float]]:
    """Links between names (in order of id) that join all alike ones of different labels; with ``sides`` of different
    sides alone."""
    label = np.unique(label, return_inverse=True)[1]
    if not label.any():  # one label
        return []
    letters = sorted(set("".join(norms)))
    place = {c: i for i, c in enumerate(letters)}
    counts = np.zeros((len(norms), len(letters)), np.int16)
    for i, t in enumerate(norms):
        for c, n in Counter(t).items():
            counts[i, place[c]] = min(n, 32767)
    size, out = np.array([len(t) for t in norms]), []
    for i in range(len(norms) - 1):
        later = np.arange(i + 1, len(norms))
        later = later[(label[later] != label[i]) & (2 * np.minimum(size[later], size[i]) >= least * (size[later] + size[i]))]
        if sides is not None:
            later = later[sides[later] != sides[i]]
        if not len(later):
            continue
        both = np.minimum(counts[i], counts[later]).sum(1)
        match = difflib.SequenceMatcher(None)
        for j in later[2 * both >= least * (size[later] + size[i])].tolist():
            if label[j] == label[i]:
                continue
            match.set_seqs(norms[i], norms[j])
            if (score := match.ratio()) >= least:
                out.append((ids[i], ids[j], round(score, 3)))
                label[label == label[j]] = label[i]
    return out


def classes_of(names: DataFrame, norm: Column) -> DataFrame:
    """id, type, norm, rep: rows with a norm, each with the least id of those of its type and norm. A null type is empty."""
    n = names.select("id", F.coalesce("type", F.lit("")).alias("type"), norm.alias("norm")).where("id IS NOT NULL AND norm IS NOT NULL AND norm != ''")
    return n.join(n.groupBy("type", "norm").agg(F.min("id").alias("rep")), ["type", "norm"])


def one_letter_apart(reps: DataFrame, least: float) -> DataFrame:
    """a, b, score: names with the same text once one letter is masked, each with the least id of those, where that alone
    makes them alike. No pair of a large group is made but with its first."""
    long = reps.where(F.length("norm") * (1 - least) >= 1)
    mask = F.transform(F.sequence(F.lit(1), F.length("norm")), lambda i: F.concat(F.substring(F.col("norm"), F.lit(1), i - 1), F.lit("\0"), F.substring(F.col("norm"), i + 1, F.length("norm"))))
    masked = long.select("id", "type", F.explode(mask).alias("masked"))
    lead = masked.groupBy("type", "masked").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    near = masked.join(lead, ["type", "masked"]).where("a != id").select("a", F.col("id").alias("b")).distinct()
    near = near.join(reps.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
    # pairs are few bytes and much work: they are dealt by number, which is not merged by size into one task
    near = near.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return cut(near.select("a", "b", F.round(ratio("x", "y"), 3).alias("score"))).where(F.col("score") >= least)


def similar_links(reps: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b, score: links between reps(id, type, norm), distinct norms of a type, that connect all those whose ratio, taken
    in order of id, is ``least`` or more. From 0.88 on, no link is lost."""
    if least < 0.88:
        raise ValueError("names under 0.88 need not share a run of letters")
    spark = reps.sparkSession
    reps = cut(reps.where(F.length("norm") >= 4).select("id", F.coalesce("type", F.lit("")).alias("type"), "norm", F.length("norm").alias("size")))
    sure = cut(one_letter_apart(reps, least))
    # what these links join needn't be compared any more
    reps = reps.join(least_labels(sure), "id", "left").withColumn("label", F.coalesce("label", "id"))
    # nor need a type whose names are all joined be taken apart
    apart = reps.groupBy("type").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    reps = cut(reps.join(apart, "type", "left_semi"))
    kinds = F.when(F.col("size") < LONG, F.array(F.lit(2))).when(F.col("size") <= SHORT, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))
    runs = reps.select("id", "type", "norm", "size", F.explode(kinds).alias("k"))
    at = F.transform(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1), lambda i: F.substring(F.col("norm"), i, F.col("k")))
    runs = runs.select("id", "type", "size", "k", F.explode(at).alias("run"))
    # the second "an" of "banana" is another key than the first
    runs = runs.groupBy("id", "type", "size", "k", "run").agg(F.count("*").alias("times")).select("id", "type", "size", "k", "run", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    runs = cut(runs)
    often = runs.groupBy("type", "k", "run", "nth").agg(F.count("*").alias("n"))
    rare = runs.join(often, ["type", "k", "run", "nth"])
    ordered = F.array_sort(F.collect_list(F.struct("n", "run", "nth")))
    first = rare.groupBy("id", "type", "size", "k").agg(ordered.alias("runs")).select("id", "type", "k", F.explode(F.slice("runs", F.lit(1), F.least(_keys(least, 400), F.size("runs")))).alias("r"))
    met = cut(first.select("id", "type", "k", "r.run", "r.nth"))
    # a run whose names are all joined already has nothing to compare
    many = met.join(reps.select("id", "label"), "id").groupBy("type", "k", "run", "nth").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    many = many.where("low != high").drop("low", "high")
    met = met.join(many, ["type", "k", "run", "nth"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))
    dealt = met.select(F.xxhash64("type", "k", "run", "nth").alias("key"), "id", F.explode(tiles).alias("tile"), own.alias("side"), (F.col("blocks") > 1).alias("large"))
    dealt = dealt.join(reps.select("id", "type", "norm", "label"), "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reps.count() // PART)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", "tile"), F.lit(parts)).cast("int"))

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("type", "ascending"), ("key", "ascending"), ("tile", "ascending"), ("id", "ascending")])
        kind, key, tile, side, large = (np.array(rows.column(c).to_pylist()) for c in ("type", "key", "tile", "side", "large"))
        ids, norms, label, out = rows.column("id").to_pylist(), rows.column("norm").to_pylist(), np.array(rows.column("label").to_pylist()), []
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
            if y - x > 1:
                two = large[x] and len(set(side[x:y].tolist())) > 1
                out += _linked(ids[x:y], norms[x:y], label[x:y], side[x:y] if two else None, least)
        out = list(dict.fromkeys(out))
        return pa.table({"a": pa.array([r[0] for r in out], pa.string()), "b": pa.array([r[1] for r in out], pa.string()), "score": pa.array([r[2] for r in out], pa.float64())})

    return sure.unionByName(dealt.repartition(parts, "part").groupBy("part").applyInArrow(verify, "a string, b string, score double")).distinct()


def least_labels(links: DataFrame) -> DataFrame:
    """id, label: for each end of links(a, b) the least id of its component. Every round gives a node the least label around
    it and that label's own; labels are checkpointed, and rounds grow with the logarithm of the longest way."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).select(F.col("a").alias("id"), "label"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("low"))
        # the label's own label, as it was before this round
        far = hop.join(labels.select(F.col("id").alias("low"), F.col("label").alias("far")), "low", "left")
        new = cut(far.select("id", F.least("low", F.coalesce("far", "low")).alias("next"), "label"))
        if new.where("next != label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", F.col("next").alias("label"))


def similar_names(names: DataFrame, least: float = 0.88, block: int = BLOCK) -> DataFrame:
    """id, type, class_id, members: every one of names(id, name, type) that has a name, with the least id of those of its
    type that alike names lead to. Names equal once normalised are alike."""
    every = cut(classes_of(names, similarity_name(strip_titles(F.col("name")))))
    reps = every.where("id = rep").select("id", "type", "norm")
    labels = least_labels(similar_links(reps, least, block))
    named = every.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "type", F.coalesce("label", "rep").alias("class_id"))
    return named.join(named.groupBy("class_id").agg(F.count("*").alias("members")), "class_id").select("id", "type", "class_id", "members")
