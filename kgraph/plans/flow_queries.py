"""Registered queries on extraction runs, stored records and the vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import extraction as X
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..sources.shared import cut, shared_folder
from ..sources.views import read
from ..streaming.records import merge_records, stored_records
from .queries import query


def stub(chunk_id: int, content: str, completion: int, attempt: int) -> str:
    """A model that fails by rule: rates, a limit of 5,000 tokens, and errors of its own."""
    if chunk_id % 11 == 0 or (chunk_id % 7 == 0 and attempt <= 2):
        raise RuntimeError("Error 429: Too Many Requests")
    if chunk_id % 13 == 0:
        raise RuntimeError("the model broke")
    used = 900 + len(content) // 4 + completion
    if used > 5000 and chunk_id % 7:
        raise RuntimeError(f"Request too large: Limit 5000, Requested {used}")
    return '```json\n{"entities": []}\n```'


@query("""WITH d AS (SELECT doc_id, least(length(coalesce(text, '')), 23600) AS n FROM documents), c AS (SELECT *, greatest(800, least(6000, 6700 - greatest(1, n // 4))) AS room FROM d),
 u AS (SELECT *, 900 + n // 4 + room - 5000 + 400 AS over, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS plain FROM c),
 a AS (SELECT doc_id, k AS attempt, CASE WHEN k < 5 THEN 'rate_limited' ELSE 'failed' END AS status, n AS characters, room AS completion FROM u, (SELECT unnest(range(1, 6)) AS k) WHERE doc_id % 11 = 0
 UNION ALL SELECT doc_id, k, CASE WHEN k < 3 THEN 'rate_limited' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'ok' END, n, room FROM u, (SELECT unnest(range(1, 4)) AS k) WHERE doc_id % 11 <> 0 AND doc_id % 7 = 0
 UNION ALL SELECT doc_id, 1, 'failed', n, room FROM u WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 = 0
 UNION ALL SELECT doc_id, 1, CASE WHEN over <= 400 THEN 'ok' WHEN room - over >= 800 OR n > 4 * over + 500 THEN 'too_long' ELSE 'failed' END, n, room FROM u WHERE plain
 UNION ALL SELECT doc_id, 2, 'ok', CASE WHEN room - over >= 800 THEN n ELSE n - 4 * over END, CASE WHEN room - over >= 800 THEN room - over ELSE 800 END FROM u WHERE plain AND over > 400 AND (room - over >= 800 OR n > 4 * over + 500))
 SELECT doc_id AS chunk_id, attempt::INTEGER AS attempt, status, characters::BIGINT AS characters, completion::BIGINT AS completion FROM a""")
def extraction_attempts(spark, d):
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return X.attempts(chunks, stub, sleep=lambda seconds: None).select("chunk_id", "attempt", "status", "characters", "completion")


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN 'again' END AS error, length(text)::BIGINT AS characters FROM documents WHERE doc_id % 3 <> 0")
def extraction_store(spark, d):
    path = f"{shared_folder(spark)}/records/{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").cast("long").alias("characters"))
    known = docs.where("chunk_id % 3 <> 0")
    merge_records(path, docs.withColumn("error", F.when(F.col("chunk_id") % 5 == 0, "first")), 0, known)
    failed = cut(stored_records(spark, path).where("error IS NOT NULL").select("chunk_id", "characters"))  # the files are about to be replaced
    for _ in range(2):  # as after a failure that came behind the write
        merge_records(path, failed.withColumn("error", F.when(F.col("chunk_id") % 10 == 0, "again")), 1, known)
    return stored_records(spark, path).select("chunk_id", "error", "characters")


#: Answers of a model about each document, some cut off, some without a member that the table lacks.
_RAW = """raw AS (SELECT doc_id, source, lang, n_chars, n_chars % 7 <> 0 AS whole, n_chars % 5 <> 0 AS linked FROM documents)"""


@query(f"WITH {_RAW} SELECT doc_id, whole AND coalesce(source, '') <> '' AND coalesce(lang, '') <> '' AS valid FROM raw")
def record_validity(spark, d):
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    link = F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit('{"source":'), quoted("source"), F.lit(',"relation":"IN","target":'), quoted("lang"), F.lit("}"))).otherwise("")
    raw = F.concat(F.lit('{"entities":[{"name":'), quoted("source"), F.lit(',"type":'), quoted("lang"), F.lit('}],"relationships":['), link, F.when(F.col("n_chars") % 7 != 0, "]}").otherwise(""))
    return read(spark, d, "documents").select("doc_id", C.valid_record(raw).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 8000 END::BIGINT AS token_limit, CASE WHEN doc_id % 4 <> 0 THEN n_chars // 4 END::BIGINT AS requested FROM documents")
def model_errors(spark, d):
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("429 after "), F.col("n_chars").cast("string"), F.lit(" letters"))).otherwise(F.concat(F.lit("Request of "), "source", F.lit(" too large: Limit 8000, Requested "), F.floor(F.col("n_chars") / 4).cast("string")))
    error = C.limit_error(said)
    return read(spark, d, "documents").select("doc_id", error["limit"].alias("token_limit"), error["requested"].alias("requested"))


@query()
def vector_topk_cells(spark, d):
    v = read(spark, d, "embeddings")
    return V.search_index(V.build_index(v), v.where("vec_id % 20 = 0"), 10)


@query()
def vector_recall(spark, d):
    v = read(spark, d, "embeddings")
    queries, index = v.where("vec_id % 20 = 0"), V.build_index(v)
    got = V.recall(V.search_index(index, queries, 10), R.nearest(v, queries, 10))
    return got.crossJoin(V.share_read(index, queries)).withColumn("cells", F.lit(len(index.centroids))).withColumn("probes", F.lit(index.probes))  # one row each
