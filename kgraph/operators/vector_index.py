"""An inverted-file index of vectors: cells by k-means, rows stored by cell, searches that read the nearest cells.

Centroids are fitted on a bounded sample, every row is indexed. How many cells a search reads is chosen on the same
sample, as the fewest that find ``target`` of its exact neighbours; scores are exact, so what is found is ranked as
the exhaustive search ranks it. A cell with a large share of all rows lies in as many files as any such number of
rows, and queries, not cells, are what is broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_folder
from .retrieval import best_rows, matrix, ranked, regular

#: Rows that centroids are fitted on, cells at most, and sample rows that stand for queries when probes are chosen.
SAMPLE, MOST_CELLS, TRIALS = 20_000, 4096, 500


@dataclass
class CellIndex:
    rows: DataFrame | None  # vec_id, embedding and what else the vectors had, by cell
    centroids: np.ndarray
    probes: int


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest cells in which ``target`` of the sample's own k nearest rows lie."""
    cell = (sample @ centroids.T).argmax(1)
    queries = sample[: min(TRIALS, len(sample))]
    exact = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, cell[exact], axis=1).ravel())  # the how-manyth cell each lies in
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


def build_index(vectors: DataFrame, cells: int | None = None, k: int = 10, target: float = 0.95, sample: int = SAMPLE, seed: int = 7) -> CellIndex:
    """An index of vectors(vec_id, embedding, ...), written to the shared folder. Rows without a vector, or with the
    zero vector, have no direction and are left out. ``cells``: the square root of the number of rows unless given."""
    spark = vectors.sparkSession
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors = vectors.where(F.col("embedding").isNotNull() & (size > 0))
    rows = vectors.count()
    if not rows:
        return CellIndex(vectors.withColumn("cell", F.lit(0)), np.zeros((0, 1), np.float32), 0)
    cells = min(cells or max(1, round(rows**0.5)), MOST_CELLS, rows)
    # a sample by hash: the same rows whenever a task runs again
    step = -(-rows // sample)
    some = cut(vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).select("embedding").limit(sample))
    dims = some.select(F.max(F.size("embedding"))).first()[0]
    held = _matrix(some.toArrow().column("embedding"), dims)  # ``sample`` rows at most
    if cells > 1:
        column = some.select(array_to_vector("embedding").alias("features"))
        centroids = np.array(KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(column).clusterCenters(), np.float32)
    else:
        centroids = held[:1]
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-30)
    probes = _probes(held, centroids, k, target)

    def assign(batches):
        for b in batches:
            cell = (_matrix(b.column(b.schema.names.index("embedding")), dims) @ centroids.T).argmax(1)
            yield b.append_column("cell", pa.array(cell.astype(np.int32)))

    path = f"{shared_folder(spark)}/vectors/{uuid.uuid4().hex}"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    celled = vectors.mapInArrow(assign, f"{kinds}, cell int")
    celled.repartitionByRange("cell", "vec_id").write.partitionBy("cell").parquet(path)
    return CellIndex(spark.read.parquet(path), centroids, probes)


def _nearest_cells(queries: np.ndarray, index: CellIndex, probes: int | None) -> np.ndarray:
    """The cells that each of the queries reads, nearest first."""
    return np.argsort(-(queries @ index.centroids.T), axis=1, kind="stable")[:, : min(probes or index.probes, len(index.centroids))]


def probed(index: CellIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """query_id, query, cell: the cells that each of queries(vec_id, embedding) reads."""
    bare = CellIndex(None, index.centroids, index.probes)
    n = min(probes or index.probes, len(index.centroids))

    def near(batches):
        for b in batches:
            cell = _nearest_cells(_matrix(b.column(1), bare.centroids.shape[1]), bare, probes)
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.ravel().astype(np.int32))], names=["query_id", "query", "cell"])

    kind, vector = (f.dataType.simpleString() for f in queries.select("vec_id", "embedding").schema)
    return queries.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInArrow(near, f"query_id {kind}, query {vector}, cell int")


def search_index(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, max_queries: int = 1000) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest rows of the cells that a query reads. Queries go out in blocks of
    about ``max_queries``; a block's scan opens its own cells alone and scores each cell as a matrix."""
    nothing = index.rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    if not len(index.centroids):
        return nothing
    dims = index.centroids.shape[1]
    kind, of = (dict(df.dtypes)["vec_id"] for df in (index.rows, queries))
    queries = queries.where(regular("embedding", dims))
    blocks = max(1, -(-queries.count() // max_queries))
    out = None
    for i in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        asked = mine.select("vec_id", "embedding").toArrow()  # about ``max_queries`` rows
        if not len(asked):
            continue
        names, held = asked.column("vec_id").combine_chunks(), matrix(asked.column("embedding"))
        near = _nearest_cells(_matrix(asked.column("embedding"), dims), index, probes)
        which = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}

        def score(batches, names=names, held=held, which=which):
            floor = np.full(len(names), -np.inf)
            for b in batches:
                cell = b.column(2).to_numpy()
                rows = matrix(b.column(1))
                order = np.argsort(cell, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                    of_cell = which[int(cell[some[0]])]
                    least, ids = floor[of_cell], b.column(0).take(pa.array(some))
                    q, r, total = best_rows(ids, rows[some], held[of_cell], least, k)
                    floor[of_cell] = least
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of_cell[q])), ids.take(pa.array(r)), pa.array(total)], names=["query_id", "vec_id", "score"])

        read = index.rows.where(F.col("cell").isin(list(which))).select("vec_id", "embedding", "cell")
        part = ranked(read.mapInArrow(score, f"query_id {of}, vec_id {kind}, score double"), k)
        part = cut(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out if out is not None else nothing


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of the exact pairs (query_id, vec_id) how many were found (recall), and how many there are."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg((F.count("hit") / F.count("*")).alias("recall"), F.count("*").alias("pairs"))


def share_read(index: CellIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """One row: the mean share of all rows that a query reads."""
    sizes = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    read = probed(index, queries, probes).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n"))
    return read.agg(F.avg("n").alias("n")).crossJoin(total).select((F.col("n") / F.col("total")).alias("share"))  # one row each
