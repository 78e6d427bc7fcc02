"""Chunk retrieval: lexical and vector search, question analysis, reranking, selection, context."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import EXHAUSTIVE_PATTERN, EXHAUSTIVE_PHRASES, QUESTION_RULES
from ..sources.adjacency import Adjacency, Front, adjacency
from ..sources.shared import cut, shared_folder
from ..functions.text import contains_any, content_tokens, cosine, first_rule, plain, tokens
from ..llm.common import stored, swept

#: Slots by whose frequencies tokens are put in order; pairs of sets that a bin compares.
COMMON, PAIRS = 1 << 20, 10_000
#: A column that says which vectors are ``regular``.
WHOLE = "_whole"


def classify(question: Column) -> Column:
    return first_rule(F.lower(question), QUESTION_RULES, "general_information")


def exhaustive(question: Column) -> Column:
    q = F.lower(F.trim(question))
    return contains_any(q, EXHAUSTIVE_PHRASES) | q.rlike(EXHAUSTIVE_PATTERN)


def lexical(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Distinct words shared with the query, and 5 more for the whole phrase; the best k of those over 0."""
    q, text = plain(F.lit(query)), plain(F.col("content"))
    shared = F.size(F.array_intersect(tokens(text), tokens(q)))
    return chunks.withColumn("score", F.when(shared > 0, shared + F.when(F.contains(text, q), 5).otherwise(0)).otherwise(0)).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = 1000) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of all vectors by cosine, for each query vector.
    Queries are broadcast in blocks by a hash of the id, of about ``max_queries`` each, one block at a time."""
    blocks = -(-queries.count() // max_queries)
    if blocks > 1:
        # which vectors are regular is worked out once, not for each block
        dims = queries.select(F.max(F.size("embedding"))).first()[0]
        vectors = cut(vectors.select("vec_id", "embedding", regular("embedding", dims or 0).alias(WHOLE)))
        parts = [cut(nearest_block(vectors, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k)) for i in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    return nearest_block(vectors, queries, k)


def nearest_block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``nearest`` for queries few enough to broadcast. Vectors of numbers, as many as the queries have, are scored as
    matrices, a batch against the block; all others pair by pair."""
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    dims = queries.select(F.max(F.size("embedding"))).first()[0]
    if not dims or dims < 1:
        return ranked(_pairs(vectors, asked), k)
    whole = asked.where(regular("query", dims)).toArrow()  # ``max_queries`` rows at most
    odd = asked.where(~regular("query", dims))
    own = regular("embedding", dims)
    if WHOLE in vectors.columns:  # by the longest of all queries; those of a block may be shorter
        own = (F.col(WHOLE) & (F.size("embedding") == dims)) | (~F.col(WHOLE) & own)
    plain_rows = vectors.where(own)
    scored = scored_by(plain_rows, whole, dict(asked.dtypes)["query_id"], k).unionByName(_pairs(vectors.where(~own), asked)).unionByName(_pairs(plain_rows, odd))
    return ranked(scored, k)


def _pairs(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, vec_id, score of all pairs."""
    return vectors.crossJoin(F.broadcast(asked)).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score to six places, rank: the first k of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def regular(column: str, dims: int) -> Column:
    """Whether a vector has ``dims`` elements, all finite numbers."""
    finite = F.forall(F.col(column), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(column) == dims) & finite, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_rows(ids: pa.Array, rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of rows, and their scores: all that may be among a query's k best at six places, ties by id.
    Products of matrices choose, what they choose is summed as ``cosine`` sums it. ``floor``: for each query what k rows
    have reached already; raised by these."""
    order = pc.sort_indices(ids).to_numpy()
    # of equal vectors the first k ids alone
    group = np.unique(np.ascontiguousarray(rows[order]).view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1]
    by = np.argsort(group, kind="stable")
    size = np.bincount(group)
    order = order[np.sort(by[np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size) < k])]
    rows = rows[order]
    long = np.linalg.norm(rows, axis=1).max(initial=0.0)
    out = []
    step = max(1, (4 << 20) // max(1, len(rows)))
    for a in range(0, len(queries), step):
        some = queries[a : a + step]
        score = some @ rows.T
        # where fewer than k rows reach the floor, the k-th of these doesn't raise it
        high = np.flatnonzero((score > floor[a : a + step, None]).sum(1) >= k)
        if len(high):
            floor[a + high] = np.partition(score[high], len(rows) - k, axis=1)[:, len(rows) - k]
        slack = 1.01e-6 + 1e-12 * long * np.linalg.norm(some, axis=1)
        q, r = np.nonzero(score >= (floor[a : a + step] - slack)[:, None])
        for c in range(0, len(q), 1 << 17):
            x, y = rows[r[c : c + (1 << 17)]], some[q[c : c + (1 << 17)]]
            total = np.zeros(len(x))
            for d in range(rows.shape[1]):
                total += x[:, d] * y[:, d]
            out.append((q[c : c + (1 << 17)] + a, order[r[c : c + (1 << 17)]], total))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def scored_by(vectors: DataFrame, asked: pa.Table, of: str, k: int) -> DataFrame:
    """query_id, vec_id, score: of each partition of regular ``vectors`` what may be among the k best of a query of
    ``asked`` (query_id, query), whose ids are of the type ``of``."""
    names, held = asked.column("query_id").combine_chunks(), matrix(asked.column("query")) if len(asked) else None

    def score(batches):
        floor = np.full(len(names), -np.inf)
        for b in batches:
            if not b.num_rows or held is None:
                continue
            q, r, total = best_rows(b.column(0), matrix(b.column(1)), held, floor, k)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(0).take(pa.array(r)), pa.array(total)], names=["query_id", "vec_id", "score"])

    kind = vectors.select("vec_id").schema[0].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(score, f"query_id {of}, vec_id {kind}, score double")


def rerank_scores(chunks: DataFrame, question: str, entities: list[str], intent: list[str], conflicts: list[str]) -> DataFrame:
    """Adds the parts of relevance, each a column: vector, entity, keyword, intent, metadata, conflict; and
    relevance, topic_match. ``chunks``: content, page_title, section, score."""
    text = F.concat_ws(" ", plain(F.col("content")), plain(F.col("page_title")), plain(F.col("section")))
    own, asked = tokens(text), F.array_distinct(content_tokens(F.lit(question)))
    phrases = sum((F.contains(text, plain(F.lit(e))).cast("int") for e in entities), F.lit(0))
    out = chunks.select(
        "*", F.col("score").cast("double").alias("vector"), (phrases / max(1, len(entities))).alias("entity"),
        (F.size(F.array_intersect(asked, own)) / F.greatest(F.size(asked), F.lit(1))).alias("keyword"),
        F.least(F.lit(1.0), F.size(F.array_intersect(F.array(*map(F.lit, intent)), own)) / 4.0).alias("intent"),
        (F.when(plain(F.col("page_title")) != "", 0.025).otherwise(0.0) + F.when(plain(F.col("section")) != "", 0.025).otherwise(0.0)).alias("metadata"),
        F.least(F.lit(0.30), 0.055 * F.size(F.array_intersect(F.array(*map(F.lit, conflicts)), own))).alias("conflict"),
        own.alias("own"),
    )
    relevance = 0.38 * F.col("vector") + 0.12 * F.col("entity") + 0.10 * F.col("keyword") + 0.13 * F.col("intent") + F.col("metadata") - F.col("conflict")
    return out.withColumn("relevance", F.round(relevance, 4)).withColumn("topic_match", F.col("intent"))


def select_chunks(scored: DataFrame, by: str, keep: int, per_page: int, fetch: int = 40) -> DataFrame:
    """Gates, a cap a page, and near duplicates (0.8) of chunks already kept, in order of relevance. The
    greedy part sees ``fetch`` rows a question at most."""
    # the rank first, as it lets each task drop all but ``fetch`` rows before they meet; the best is among those
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("relevance"), "chunk_id"))
    best = F.max("relevance").over(Window.partitionBy(by))
    gated = scored.withColumn("_r", rank).where(F.col("_r") <= fetch).withColumn("_b", best).where((F.col("relevance") >= F.greatest(F.lit(0.30), 0.58 * F.col("_b"))) & ~((F.col("vector") < 0.2) & (F.col("relevance") < 0.3)))
    gated = gated.select(by, "chunk_id", "page_title", "relevance", "own", "_r")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        kept, pages = [], {}
        for r in rows.sort_values("_r").itertuples():
            own = set(r.own)
            if pages.get(r.page_title, 0) >= per_page or any(own and o and len(own & o) / len(own | o) >= 0.8 for _, o in kept):
                continue
            pages[r.page_title] = pages.get(r.page_title, 0) + 1
            kept.append((r.Index, own))
            if len(kept) == keep:
                break
        out = rows.loc[[i for i, _ in kept], [by, "chunk_id", "page_title", "relevance"]]
        return out.assign(strong=out["relevance"] >= 0.55)

    kinds = {f.name: f.dataType.simpleString() for f in gated.schema}
    return gated.groupBy(by).applyInPandas(greedy, f"{by} {kinds[by]}, chunk_id {kinds['chunk_id']}, page_title string, relevance double, strong boolean")


def near_duplicates(chunks: DataFrame, least: float) -> DataFrame:
    """a, b, score of chunks in one bucket (column ``bucket``) whose token sets reach ``least``. Token sets, equal ones
    as one, meet through their rarest tokens: a pair at t shares one of the first (1 - t) * n + 1 tokens in any fixed
    order, and what may follow that token has to suffice for the rest. Pairs that met are compared in bins, to each of
    which a set travels once, however many of its pairs are there: first bitmaps of the sets, which bound what they
    share from above, then the tokens of what is left."""
    spark = chunks.sparkSession
    path = f"{shared_folder(spark)}/sets/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{path}/{name}")
        swept(spark)
        return spark.read.parquet(f"{path}/{name}")

    sets = chunks.where("chunk_id IS NOT NULL").select("bucket", F.col("chunk_id").alias("id"), F.array_sort(tokens(plain(F.col("content")))).alias("t")).where(F.size("t") > 0)
    # tokens have no blanks in them
    sets = sets.select("bucket", "id", F.array_join("t", " ").alias("t")).withColumn("key", F.sha2("t", 256))
    classes = kept(sets.groupBy("bucket", "key").agg(F.first("t").alias("t")).withColumn("node", F.monotonically_increasing_id()), "classes")
    members = kept(sets.select("bucket", "key", "id").join(classes.select("bucket", "key", "node"), ["bucket", "key"]).select("node", "id"), "members")
    # how many sets have a token, or one of its slot: frequent tokens come last
    held = classes.select(F.explode(F.split("t", " ")).alias("k")).groupBy(_slot(F.col("k")).alias("slot")).agg(F.count("*").alias("n")).toArrow()  # COMMON rows at most
    often = np.zeros(COMMON, np.int64)
    often[held.column("slot").to_numpy()] = held.column("n").to_numpy()

    def prefixes(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i, (t, slots) in enumerate(zip(batch.column("t").to_pylist(), batch.column("slots"), strict=True)):
                words, n, places = t.split(" "), len(slots), slots.values.to_numpy()
                bits = np.zeros(64 << max(0, n.bit_length() - 5), np.uint8)
                bits[places % len(bits)] = 1
                for at, (_, k) in enumerate(sorted(zip(often[places].tolist(), words, strict=True))[: n - math.ceil(least * n - 1e-9) + 1]):
                    for column, value in zip(out, (i, n, at, k, None if at else np.packbits(bits, bitorder="little").tobytes()), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("bucket").take(at), batch.column("node").take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], names=["bucket", "node", "n", "at", "k", "bits"])

    kinds = dict(classes.dtypes)
    told = classes.select("bucket", "node", "t", F.transform(F.split("t", " "), _slot).alias("slots"))
    keyed = kept(told.mapInArrow(prefixes, f"bucket {kinds['bucket']}, node long, n int, at int, k string, bits binary"), "prefixes")
    p, q = keyed.alias("p"), keyed.alias("q")
    near = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.k") == F.col("q.k")) & (F.col("p.node") < F.col("q.node")) & (F.least("p.n", "q.n") >= least * F.greatest("p.n", "q.n") - 1e-9)
                  & (F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at")) >= least / (1 + least) * (F.col("p.n") + F.col("q.n")) - 1e-6))
    near = kept(near.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), "near")
    near = kept(_binned(near, keyed.where("bits IS NOT NULL").select("node", "n", F.col("bits").alias("held")), 10 * PAIRS, _mapped, _bound, least).select("a", "b"), "bounded")
    alike = kept(_binned(near, classes.select("node", F.lit(0).alias("n"), F.col("t").cast("binary").alias("held")), PAIRS, _split, _shared, least), "alike")
    m, n = (members.select(F.col("node").alias(end), F.col("id").alias(f"id_{end}")) for end in "ab")
    between = alike.join(m, "a").join(n, "b").where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "score")
    equal = m.join(n, (F.col("a") == F.col("b")) & (F.col("id_a") < F.col("id_b"))).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("score"))
    return between.unionByName(equal).select("a", "b", F.round("score", 6).alias("score"))


def _slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(COMMON)).cast("int")


def _mapped(n: int, held: bytes) -> tuple[int, int, int]:
    return n, 8 * len(held), int.from_bytes(held, "little")


def _bound(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int]:
    """How many tokens two sets share at most, and how many there are in both sets, by sizes and bitmaps."""
    (n, wide, a), (m, narrow, b) = (x, y) if x[1] >= y[1] else (y, x)
    while wide > narrow:  # a place in half as many is that of either half
        wide //= 2
        a = (a >> wide) | (a & ((1 << wide) - 1))
    both = (a & b).bit_count()
    most = min(n - a.bit_count() + both, m - b.bit_count() + both)
    return most, n + m


def _split(n: int, held: bytes) -> set[bytes]:
    return set(held.split(b" "))


def _shared(x: set[bytes], y: set[bytes]) -> tuple[int, int]:
    return len(x & y), len(x) + len(y)


def _binned(near: DataFrame, sets: DataFrame, most: int, read: Callable, shared: Callable, least: float) -> DataFrame:
    """The pairs (a, b) of ``near`` that reach ``least``, with their score, by ``shared`` of what ``read`` makes of
    ``sets`` (node, n, held). Bins have about ``most`` pairs."""
    bins = max(1, -(-near.count() // most))
    # pairs of a group go to the bin of its first set; of a large one its halves, thirds and so on, each with each
    first = near.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("root"))
    pairs = near.join(first, "a", "left").withColumn("root", F.coalesce("root", "a"))
    many = pairs.groupBy("root").agg(F.ceil(F.sqrt(F.count("*") / most)).cast("int").alias("many"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("many"))
    # a checkpoint's rows are not compressed
    pairs = stored(pairs.join(many, "root").select("a", "b", F.pmod(F.xxhash64("root", side("a"), side("b")), F.lit(bins)).cast("int").alias("bin")), "pair-bins")
    asked = pairs.select("bin", F.explode(F.array("a", "b")).alias("node")).groupBy("bin", "node").agg(F.lit(0).alias("_"))
    told = asked.join(sets, "node").select(F.col("bin").alias("of"), "node", "n", "held")

    def compare(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {k: read(n, x) for k, n, x in zip(*(sets.column(c).to_pylist() for c in ("node", "n", "held")), strict=True)}
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            both, all_ = shared(held[a], held[b])
            score = both / (all_ - both)
            if score >= least:
                out.append((a, b, score))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "score"])

    return pairs.groupBy("bin").cogroup(told.groupBy("of")).applyInArrow(compare, "a long, b long, score double")


def sources(chunks: DataFrame, k: int) -> DataFrame:
    """url, title, relevance: distinct urls by their best chunk."""
    return chunks.groupBy("url").agg(F.max_by("title", F.struct("relevance", "title")).alias("title"), F.max("relevance").alias("relevance")).orderBy(F.desc("relevance"), "url").limit(k)


def render_groups(edges: DataFrame) -> DataFrame:
    """source_name, relation, line: one line a group, the names in order."""
    return edges.groupBy("source_name", "relation").agg(F.array_sort(F.collect_set("target_name")).alias("names")).select("source_name", "relation", F.concat(F.col("source_name"), F.lit(" -["), F.col("relation"), F.lit("]-> "), F.array_join("names", ", ")).alias("line"), F.size("names").cast("long").alias("n"))


def answer(spark, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, question: str, term: str, generate=None) -> str:
    """The retrieved evidence as one text, or what ``generate`` (a language model's callable) makes of it.
    Only bounded, already selected rows reach the driver."""
    from .entities import seeds
    from .graph import capped, described, edge_scores, expand

    start = seeds(nodes, term).select("id", "score")
    found = edge_scores(described(expand(edges, start, 1), nodes), start, [], [], [])
    facts = render_groups(capped(found, "relation", 6, 18, [F.desc("score"), F.col("source"), F.col("target")])).orderBy("line").limit(18).collect()
    texts = lexical(chunks, question, 5).select("chunk_id", F.substring("content", 1, 2200).alias("content")).collect()
    if not facts and not texts:
        return "There is not enough evidence to answer that."
    context = "\n".join([r["line"] for r in facts] + [r["content"] for r in texts])
    return generate(question, context) if generate else context


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))


def scope_of(question: Column, scopes: dict[str, list[str]], default: str) -> Column:
    """The first scope one of whose terms the question contains."""
    return first_rule(plain(question), [(k, v) for k, v in scopes.items() if k != default], default)


def full_rerank(chunks: DataFrame, question: str, kind: str, entities: list[str], graph_names: list[str], profile: dict) -> DataFrame:
    """Adds every part of relevance as a column, relevance and topic_match. ``chunks``: content, page_title,
    section, source_url, score. ``profile`` has the caller's tables, all optional: intent, conflicts, headings
    (words of titles and their bonus), places (words and location bonus), site, scopes and default_scope."""
    content, head, section = plain(F.col("content")), plain(F.col("page_title")), plain(F.col("section"))
    out = chunks.select("*", head.alias("_h"), section.alias("_s"), F.concat_ws(" ", content, head, section).alias("_t")).withColumn("own", tokens(F.col("_t")))
    asked = F.array_distinct(content_tokens(F.lit(question)))
    lit = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    phrases = [plain(F.lit(e)) for e in entities]
    entity = reduce(lambda a, b: a + b, [F.contains("_t", p).cast("int") for p in phrases], F.lit(0)) / max(1, len(phrases))
    names = reduce(lambda a, b: a + b, [F.when(F.length(plain(F.lit(g))) >= 4, F.contains("_t", plain(F.lit(g))).cast("int")).otherwise(0) for g in graph_names], F.lit(0))
    words, bonus = profile.get("headings", ([], 0.0))
    titled = F.when(hits(F.col("_h"), words) + hits(F.col("_s"), words) > 0, bonus).otherwise(0.0)
    scopes, default = profile.get("scopes", {}), profile.get("default_scope")
    scope, wrong = F.lit(0.0), F.lit(0.0)
    if scopes:
        mine = next((k for k, terms in scopes.items() if k != default and any(t in question.lower() for t in terms)), default)
        own = hits(F.col("_t"), scopes[mine])
        scope = F.least(F.lit(0.42), 0.07 * own)
        others = reduce(lambda a, b: a + b, [F.when(hits(F.col("_t"), scopes[k]) > 0, w).otherwise(0.0) for k, w in profile.get("penalties", {}).items() if k in scopes], F.lit(0.0))
        wrong = F.when(own > 0, 0.0).otherwise(others if mine == default else F.lit(0.40))
    place = F.least(F.lit(0.32), 0.055 * F.size(F.array_intersect(lit(profile.get("places", [])), "own")))
    site = F.when(F.contains(F.lower(F.coalesce("source_url", F.lit(""))), F.lit(profile["site"])), 0.08).otherwise(0.0) if profile.get("site") else F.lit(0.0)
    out = out.select(
        "*", F.col("score").cast("double").alias("vector"), entity.alias("entity"), (F.size(F.array_intersect(asked, "own")) / F.greatest(F.size(asked), F.lit(1))).alias("keyword"),
        F.least(F.lit(1.0), F.size(F.array_intersect(lit(profile.get("intent", [])), "own")) / 4.0).alias("intent"), titled.alias("titled"),
        (site + F.when(F.col("_h") != "", 0.025).otherwise(0.0) + F.when(F.col("_s") != "", 0.025).otherwise(0.0)).alias("metadata"),
        F.least(F.lit(0.12), 0.04 * names).alias("graph"), place.alias("place"), scope.alias("scope"), wrong.alias("wrong"),
        F.least(F.lit(0.30), 0.055 * F.size(F.array_intersect(lit(profile.get("conflicts", [])), "own"))).alias("conflict"),
    )
    c = F.col
    relevance = 0.38 * c("vector") + 0.12 * c("entity") + 0.10 * c("keyword") + 0.13 * c("intent") + c("titled") + c("metadata") + c("graph") + c("place") + c("scope") - c("conflict") - c("wrong")
    return out.withColumn("relevance", F.round(relevance, 4)).withColumn("topic_match", F.least(F.lit(1.0), c("intent") + c("scope") + 0.7 * c("titled"))).drop("_h", "_s", "_t")


def topical(scored: DataFrame, scoped: bool) -> DataFrame:
    """Chunks on the topic asked for: with scopes those in scope and relevant, else those that match it, or
    those that the vector alone makes certain."""
    if scoped:
        return scored.where((F.col("scope") > 0) & ((F.col("relevance") >= 0.32) | (F.col("vector") >= 0.72)))
    return scored.where((F.col("topic_match") >= 0.12) | (F.col("vector") >= 0.82))


def expanded_query(question: Column, kind: Column, hints: dict[str, str], seed: Column) -> Column:
    """The question, the hint of its kind, and the first seed's name unless it is there or has 80 characters."""
    hint = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv])[kind]
    text = F.concat_ws(" ", question, hint)
    return F.when(F.contains(plain(text), plain(seed)) | (F.length(seed) >= 80) | seed.isNull(), text).otherwise(F.concat_ws(" ", text, seed))


def analysed(questions: DataFrame, generic: list[str]) -> DataFrame:
    """Adds kind, terms and exhaustive: what an analyser without a language model makes of a question."""
    from .entities import fallback_terms

    q = F.col("question")
    return questions.select("*", classify(q).alias("kind"), fallback_terms(q, generic).alias("terms"), exhaustive(q).alias("exhaustive"))


def hashed_vectors(texts: DataFrame, dims: int = 64) -> DataFrame:
    """id, vector: unit vectors of signed token counts by hash, a stand-in for a language model's encoder. Where all
    signed counts cancel, the counts without signs stand for them: every text with a token has a direction.
    Each row of texts(id, content) is a text of its own and no row meets another."""
    # as tokens(plain(content)), whose blanks are all else than letters and digits
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce("content", F.lit(""))), "[^a-z0-9]+")), "")
    rows = texts.select("id", F.transform(words, lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") > 0)

    def encode(batches):
        for b in batches:
            sizes, h = pc.list_value_length(b.column(1)).to_numpy(), b.column(1).flatten().to_numpy()
            place = np.repeat(np.arange(len(sizes)), sizes) * dims + h % dims
            bare = np.bincount(place, minlength=len(sizes) * dims).reshape(-1, dims)
            signed = bare - 2 * np.bincount(place[h < 0], minlength=len(sizes) * dims).reshape(-1, dims)
            counts = np.where(signed.any(1)[:, None], signed, bare)
            vectors = (counts / np.sqrt((counts * counts).sum(1))[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dims), pa.int32()), pa.array(vectors.ravel()))], names=["id", "vector"])

    return rows.mapInArrow(encode, f"id {dict(texts.dtypes)['id']}, vector array<float>")


def vector_index(chunks: DataFrame, encode=None, dims: int = 64) -> DataFrame:
    """chunk_id, vector and the chunk's other columns, of chunks whose content isn't blank. ``encode``: DataFrame
    (id, content) to (id, vector); each distinct content is encoded once."""
    rows = chunks.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("_k", F.xxhash64("content"))
    distinct = rows.groupBy("_k").agg(F.first("content").alias("content")).select(F.col("_k").alias("id"), "content")
    vectors = (encode or (lambda df: hashed_vectors(df, dims)))(distinct).select(F.col("id").alias("_k"), "vector")
    return rows.join(vectors, "_k").drop("_k")


def hybrid(nodes: DataFrame, edges: DataFrame | Adjacency, chunks: DataFrame, query: str, priority: dict[str, int], k: int = 5, relations: int = 30) -> dict[str, DataFrame]:
    """entities, relationships and chunks for a query: the graph's best names, their edges by priority, and lexical chunks."""
    from .entities import search_max
    from .graph import described

    best = search_max(nodes, query).orderBy(F.desc("score"), "id").limit(k)
    mine = adjacency(edges).touching(Front(best)).distinct()
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("relation")], F.lit(0)) if priority else F.lit(0)
    facts = described(mine, nodes).withColumn("priority", rank).orderBy(F.desc("priority"), "source", "relation", "target").limit(relations)
    return {"entities": best, "relationships": facts, "chunks": lexical(chunks, query, k)}


def rag_edges(nodes: DataFrame, edges: DataFrame | Adjacency, query: str, k: int = 5, hops: int = 1) -> DataFrame:
    """Edges within ``hops`` of the best names by word overlap, each once, with names."""
    from .entities import search_overlap
    from .graph import described, expand

    best = search_overlap(nodes, query).orderBy(F.desc("score"), "id").limit(k)
    return described(expand(edges, best.select("id"), hops), nodes)
