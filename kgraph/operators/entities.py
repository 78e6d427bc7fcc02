"""Entity operators: dedup of mentions, endpoint resolution, canonical names, name search and fuzzy matching."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import casefold, collapse, content_tokens, jaccard, match_key, plain, similarity_name, strip_titles, tokens
from ..sources.shared import cut


def dedup_mentions(mentions: DataFrame) -> DataFrame:
    """key, type, name, ord, n from mentions(name, type, ord): the first mention of a key and type names it."""
    m = mentions.where(F.coalesce(collapse("name"), F.lit("")) != "").withColumn("key", match_key(F.col("name")))
    return m.groupBy("key", "type").agg(F.min_by(collapse("name"), "ord").alias("name"), F.min("ord").alias("ord"), F.count("*").alias("n"))


def resolve_endpoints(entities: DataFrame, ends: DataFrame, expected: dict[tuple[str, str], str]) -> DataFrame:
    """Adds node (key and type) to references(ord, relation, side, key): the entity of the expected type,
    else the earliest entity of that key, else a new one, typed by the key's first reference."""
    kind = F.lit(None).cast("string")
    for (relation, side), t in expected.items():
        kind = F.when((F.col("relation") == relation) & (F.col("side") == side), F.lit(t)).otherwise(kind)
    ends = ends.withColumn("expected", kind)
    typed = entities.select("key", F.col("type").alias("expected"), F.col("type").alias("typed"))
    first = entities.groupBy("key").agg(F.min_by("type", F.struct("ord", "type")).alias("earliest"))
    made = ends.groupBy("key").agg(F.coalesce(F.min_by(F.coalesce("expected", F.lit("Unknown")), "ord"), F.lit("Unknown")).alias("made"))
    return ends.join(typed, ["key", "expected"], "left").join(first, "key", "left").join(made, "key").withColumn("type", F.coalesce("typed", "earliest", "made")).drop("typed", "earliest", "made", "expected")


def merge_shortest(nodes: DataFrame, key: Column) -> DataFrame:
    """key, type, name (the shortest, then least), members, ids."""
    return nodes.withColumn("key", key).groupBy("type", "key").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count("*").alias("members"), F.min("id").alias("new_id"))


def merge_longest(nodes: DataFrame, key: Column) -> DataFrame:
    """type, key, name: most tokens, then longest, then earliest id."""
    size = F.size(tokens(plain(F.col("name"))))
    ranked = nodes.withColumn("key", key).withColumn("_r", F.row_number().over(Window.partitionBy("type", "key").orderBy(size.desc(), F.length("name").desc(), "id")))
    return ranked.where("_r = 1").select("type", "key", "id", "name")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings; the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def fuzzy_pairs(names: DataFrame, least: float, gram: int = 3) -> DataFrame:
    """a, b, name_a, name_b, score for pairs of names(id, name, type) of one type whose normalised names
    are alike. Names meet by a common trigram and by size. For ``least`` of 0.88 or more that loses none:
    n letters with e edits, e <= 0.12 n, keep a run of (n - e) / (e + 1) >= 3 letters from n = 5 on.
    A lower ``least`` is refused. Four letters against five meet by two letters. Distinct normalised names are compared, not rows: the
    least id of equal ones stands for its class, and each other id of the class has a pair with it, of score 1."""
    if least < 0.88:
        raise ValueError("names under 0.88 need not share a trigram")
    n = names.withColumn("norm", similarity_name(strip_titles(F.col("name")))).where("norm IS NOT NULL")
    distinct = n.groupBy("type", "norm").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"))

    def runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("norm") - k + 1), lambda i: F.substring(F.col("norm"), i, F.lit(k)))

    grams = F.when(F.length("norm") > 5, runs(gram)).otherwise(F.concat(runs(gram), runs(gram - 1)))
    keyed = distinct.where(F.length("norm") >= 4).withColumn("g", F.explode(F.array_distinct(grams)))
    p, q = keyed.alias("p"), keyed.alias("q")
    small, large = F.least(F.length("p.norm"), F.length("q.norm")), F.greatest(F.length("p.norm"), F.length("q.norm"))
    near = p.join(q, (F.col("p.type") == F.col("q.type")) & (F.col("p.g") == F.col("q.g")) & (F.col("p.id") < F.col("q.id")) & (2 * small >= least * (small + large)))
    near = near.select(F.col("p.type").alias("type"), F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.name").alias("name_a"), F.col("q.name").alias("name_b"), F.col("p.norm").alias("x"), F.col("q.norm").alias("y")).distinct()
    near = near.withColumn("score", F.round(ratio("x", "y"), 3)).where(F.col("score") >= least).drop("x", "y")
    own = distinct.select("type", "norm", F.col("id").alias("a"), F.col("name").alias("name_a")).join(n.select("type", "norm", F.col("id").alias("b"), F.col("name").alias("name_b")), ["type", "norm"]).where("a != b")
    return near.unionByName(own.select("type", "a", "b", "name_a", "name_b", F.lit(1.0).alias("score")))


def resolve(names: DataFrame, least: float = 0.96, gram: int = 3) -> DataFrame:
    """id, leader for all of names(id, name, type): leaders by a similarity of normalised names of one type.
    Equal names have 1, equal token sets 0.98, a name that contains the other 0.94, an empty one 0; others
    the greater of ratio and token Jaccard. Equal names are one class from there on, named by its least id:
    they are alike to the same names, so whoever leads one leads all. For ``least`` of 0.96 or more names
    that differ meet by a common trigram, or, where Jaccard can decide (25 tokens), by their first tokens by hash."""
    norm = F.trim(F.regexp_replace(casefold(strip_titles(F.col("name"))), "[^a-z0-9&]+", " "))
    n = names.select("id", "type", F.coalesce(norm, F.lit("")).alias("norm"))
    reps = n.where("norm != ''").groupBy("type", "norm").agg(F.min("id").alias("rep")).withColumn("t", F.array_sort(tokens(F.col("norm"))))
    size = F.size("t")
    grams = F.when(F.length("norm") >= gram, F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm") - gram + 1, F.lit(1))), lambda i: F.substring(F.col("norm"), i, F.lit(gram)))).otherwise(F.array().cast("array<string>"))
    hashed = F.transform(F.array_sort(F.transform("t", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: F.concat(F.lit("token "), s["x"]))
    first = F.when(size >= 24, F.slice(hashed, F.lit(1), (size - F.ceil(least * size) + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(grams, first, F.array(F.concat(F.lit("set "), F.array_join("t", " ")))))
    keyed = reps.withColumn("g", F.explode(keys))
    p, q = keyed.alias("p"), keyed.alias("q")
    small, large = F.least(F.length("p.norm"), F.length("q.norm")), F.greatest(F.length("p.norm"), F.length("q.norm"))
    same = F.col("p.t") == F.col("q.t")
    fits = same | (2 * small >= least * (small + large)) | (F.greatest(F.size("p.t"), F.size("q.t")) >= 25)
    near = p.join(q, (F.col("p.type") == F.col("q.type")) & (F.col("p.g") == F.col("q.g")) & (F.col("p.rep") < F.col("q.rep")) & fits)
    near = near.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), F.col("p.norm").alias("x"), F.col("q.norm").alias("y"), same.alias("same"), jaccard(F.col("p.t"), F.col("q.t")).alias("shared")).distinct()
    sure = near.where("same").select("a", "b") if least <= 0.98 else near.limit(0).select("a", "b")
    rest = near.where(~F.col("same") & ~F.contains("x", F.col("y")) & ~F.contains("y", F.col("x")))
    rest = rest.where(F.greatest(ratio("x", "y"), F.col("shared")) >= least).select("a", "b")
    led = leaders(cut(sure.unionByName(rest)), reps.select(F.col("rep").alias("id"))).select(F.col("id").alias("rep"), "leader")
    members = n.join(reps.select("type", "norm", "rep"), ["type", "norm"], "left").select("id", "rep")
    return members.join(led, "rep", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def leaders(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, leader: in order of id each node that no earlier leader took becomes one and takes its unused
    partners. Rounds settle all nodes whose earlier partners are settled; pairs are few by then."""
    both = pairs.select(F.col("a").alias("first"), F.col("b").alias("id"))
    state = nodes.select("id").join(both.select("id").distinct(), "id", "left_semi").withColumn("leader", F.lit(None).cast("string"))
    own = nodes.select("id", F.col("id").alias("leader")).join(state, "id", "left_anti")
    settled = own.join(both.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    done, open_ = settled, cut(state.select("id"))
    while not open_.isEmpty():
        seen = both.join(open_, "id").join(done.select(F.col("id").alias("first"), "leader"), "first", "left")
        least = seen.groupBy("id").agg(F.min(F.when(F.col("leader") == F.col("first"), F.col("first"))).alias("lead"), F.min(F.when(F.col("leader").isNull(), F.col("first"))).alias("wait"))
        ready = least.where("wait IS NULL OR lead < wait").select("id", F.coalesce("lead", "id").alias("leader"))
        ready = cut(ready)
        done = cut(done.unionByName(ready))
        open_ = cut(open_.join(ready, "id", "left_anti"))
    return own.join(done, "id", "left_anti").unionByName(done)


def search_tiers(nodes: DataFrame, query: str) -> DataFrame:
    """Exact matches, else names that contain the query: only the first tier that has any."""
    q = plain(F.lit(query))
    tier = F.when(plain(F.col("name")) == q, 1).when(F.contains(plain(F.col("name")), q), 2)
    hits = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")  # one row


def search_overlap(nodes: DataFrame, query: str) -> DataFrame:
    """100 exact, 60 name holds query, 50 query holds name, and 10 for each shared word; above 0."""
    n, q = F.lower(collapse("name")), F.lower(collapse(F.lit(query)))
    base = F.when(n == q, 100).when(F.contains(n, q), 60).when(F.contains(q, n), 50).otherwise(0)
    return nodes.withColumn("score", base + 10 * F.size(F.array_intersect(tokens(n), tokens(q)))).where("score > 0")


def search_max(nodes: DataFrame, query: str) -> DataFrame:
    """The greatest of 100 exact, 80 name holds query, 70 query holds name, 40 + 30 * share of words."""
    n, q = F.lower(collapse("name")), plain(F.lit(query))
    shared, size = F.size(F.array_intersect(tokens(n), tokens(q))), F.size(tokens(q))
    score = F.greatest(F.when(n == q, 100.0).otherwise(0.0), F.when(F.contains(n, q), 80.0).otherwise(0.0), F.when(F.contains(q, n), 70.0).otherwise(0.0), F.when(shared > 0, 40 + 30 * shared / size).otherwise(0.0))
    return nodes.withColumn("score", F.round(score, 4)).where("score > 0")


def name_score(name: Column, query: str) -> Column:
    """100 as written, 95 normalised, 75 less 6 a word over, at least 45, where all words of the query
    are there, 55 where all of two or more words of the name are in the query, 10 for substrings."""
    n, q = plain(name), plain(F.lit(query))
    nt, qt = tokens(n), tokens(q)
    words = F.size(F.split(n, " "))
    return (
        F.when((n == "") | (q == ""), 0).when(F.lower(F.trim(name)) == query.strip().lower(), 100).when(n == q, 95)
        .when(F.size(F.array_except(qt, nt)) == 0, F.greatest(F.lit(45), 75 - 6 * (words - F.size(qt))))
        .when((words >= 2) & (F.size(F.array_except(nt, qt)) == 0), 55)
        .when(F.contains(n, q) | ((F.length(n) >= 4) & F.contains(q, n)), 10).otherwise(0)
    )


def seeds(nodes: DataFrame, query: str, keep: int = 2, floor: int = 40) -> DataFrame:
    """The best ``keep`` names within 12 of the best score and not under ``floor``."""
    scored = nodes.withColumn("score", name_score(F.col("name"), query)).where(F.col("score") >= floor)
    top = scored.orderBy(F.desc("score"), F.length("name"), "id").limit(25)
    best = F.max("score").over(Window.partitionBy())  # over 25 rows at most
    return top.withColumn("best", best).where(F.col("score") >= F.col("best") - 12).orderBy(F.desc("score"), F.length("name"), "id").limit(keep).drop("best")


def alias_names(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """term, alias: the other names in the groups(group_id, name) that a term (terms: term) is in, all normalised."""
    g = groups.select("group_id", plain(F.col("name")).alias("alias")).where("alias != ''").distinct()
    own = terms.select("term", plain(F.col("term")).alias("alias")).join(g, "alias").select("term", F.col("alias").alias("self"), "group_id")
    return own.join(g, "group_id").where("alias != self").select("term", "alias").distinct()


def search_cascade(nodes: DataFrame, query: str, aliases: dict[str, str] | None = None, kind: str | None = None, least: float = 0.65) -> DataFrame:
    """id, name, tier, score: alias, else exact, else substring, else alike names; only the first tier that has any.
    The last tier compares only where no node is in an earlier one, and only names whose length can reach ``least``."""
    q = similarity_name(strip_titles(F.lit(query)))
    name = similarity_name(strip_titles(F.col("name")))
    rows = nodes.where(F.lower("type") == kind.lower()) if kind else nodes
    rows = rows.withColumn("_n", name).withColumn("_q", q)
    alias = {k.lower(): v for k, v in (aliases or {}).items()}.get(query.strip().lower())
    first = F.lit(False) if alias is None else F.col("name") == alias
    hits = rows.withColumn("tier", F.when(first, 1).when(F.col("_n") == F.col("_q"), 2).when(F.contains("_n", F.col("_q")), 3)).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("best"))  # one row
    sure = hits.join(F.broadcast(best), F.col("tier") == F.col("best")).select("id", "name", "tier", F.lit(1.0).alias("score"))
    small, large = F.least(F.length("_n"), F.length("_q")), F.greatest(F.length("_n"), F.length("_q"))
    rest = rows.join(F.broadcast(best.where("best IS NULL")), F.lit(True)).where(2 * small >= least * (small + large))
    rest = rest.withColumn("score", ratio("_q", "_n")).where(F.col("score") >= least)
    return sure.unionByName(rest.select("id", "name", F.lit(4).alias("tier"), "score"))


#: Letters with marks and those they stand for, where a decomposition has the plain letter first.
ACCENTS = ("àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz")


def search_accents(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """id, name, score: 1 equal, 0.9 the name holds the query, 0.85 the query the name, else the share of common
    tokens; case, accents and punctuation don't count."""
    def norm(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.translate(casefold(c), *ACCENTS), "[^a-z0-9]+", " "))

    n, q = norm(F.col("name")), norm(F.lit(query))
    score = F.when(n == q, 1.0).when(F.contains(n, q), 0.9).when(F.contains(q, n), 0.85).otherwise(jaccard(tokens(n), tokens(q)))
    return nodes.select("id", "name", F.round(score, 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def fallback_terms(question: Column, generic: list[str], most: int = 4) -> Column:
    """The first content tokens of a question that aren't generic."""
    return F.slice(F.filter(content_tokens(question), lambda t: ~t.isin(generic)), 1, most)


def resolve_terms(nodes: DataFrame, terms: list[str], default: str | None = None, keep: int = 2) -> DataFrame:
    """ord, term, id, name, score: the seeds of each term, each entity under the first term that has it; those of
    ``default`` if no term has any. As many small searches as there are terms of one question."""
    found = None
    for i, term in enumerate([*dict.fromkeys(terms), *([default] if default else [])]):
        part = seeds(nodes, term, keep).select(F.lit(i).alias("ord"), F.lit(term).alias("term"), "id", "name", "score")
        found = part if found is None else found.unionByName(part)
    own = found.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_r = 1").drop("_r")
    if default:
        some = own.agg(F.min("ord").alias("low"))  # one row
        own = own.join(F.broadcast(some), (F.col("ord") < len(set(terms))) | (F.col("low") == len(set(terms)))).drop("low")
    return own
