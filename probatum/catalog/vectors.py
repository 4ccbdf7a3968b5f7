"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector_index as stored
from ..operators import vectors as ops
from ..session import scratch_path
from . import derived as d
from .registry import query

_SCORE = "round(list_cosine_similarity(c.embedding, q.query_vector), 6)"
_BASE = "chunk_vectors query_vectors"
MODES = ["arquitecto", "abogado", "profundo"]
EPOCH_MS = 1704067200000


def topk_sql(where: str, k: int) -> str:
    return f"""
SELECT query_id, chunk_id, similarity, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT q.query_id, c.chunk_id, {_SCORE} AS similarity FROM query_vectors q, chunk_vectors c WHERE {where})
QUALIFY rank <= {k}"""


@query("vector_topk", d.with_(_BASE, topk_sql("true", 10)))
def vector_topk(t):
    return ops.vector_topk(d.chunk_vectors(t), d.query_vectors(t), 10)


_TYPES = {0: ["LGUC", "OGUC", "DDU"], 1: ["LEY", "DFL", "DL", "DS"], 2: ["CGR", "DDU_ESPECIFICA", "DDU"]}


def typed_queries(t):
    kinds = [F.array(*[F.lit(v) for v in values]) for values in _TYPES.values()]
    return d.query_vectors(t).withColumn(
        "types", F.element_at(F.array(*kinds), (F.col("query_id") % 3 + 1).cast("int")))


@query("vector_topk_filtered", d.with_(_BASE, topk_sql(
    "c.vigente AND list_contains(CASE q.query_id % 3 "
    + " ".join(f"WHEN {i} THEN {d.sql_list(v)}" for i, v in _TYPES.items()) + " END, c.tipo)", 10)))
def vector_topk_filtered(t):
    return ops.vector_topk(d.chunk_vectors(t).where("vigente"), typed_queries(t), 10, type_col="tipo")


@query("hyde_combine", d.with_(_BASE, """
SELECT query_id, chunk_id, round(list_extract(v, 1) / n, 6) AS first_cell, round(list_extract(v, -1) / n, 6) AS last_cell,
       len(v) AS width
FROM (SELECT query_id, chunk_id, v, sqrt(list_inner_product(v, v)) AS n FROM (
  SELECT q.query_id, c.chunk_id, list_transform(list_zip(q.query_vector, c.embedding), lambda p: (p[1] + p[2]) / 2) AS v
  FROM chunk_vectors c JOIN query_vectors q ON q.query_id = c.label))"""))
def hyde_combine(t):
    hypothetical = d.chunk_vectors(t).select(
        "chunk_id", F.col("label").cast("long").alias("query_id"), F.col("embedding").alias("hyde_vector"))
    mixed = ops.hyde_combine(d.query_vectors(t).join(hypothetical, "query_id"))
    v = F.col("query_vector")
    return mixed.select(
        "query_id", "chunk_id",
        F.round(F.element_at(v, 1), 6).alias("first_cell"),
        F.round(F.element_at(v, -1), 6).alias("last_cell"),
        F.size(v).cast("long").alias("width"))


def cache(t):
    """Cached answers: one per vector, an hour apart."""
    return t.embeddings.select(
        F.col("vec_id").alias("cache_id"), "embedding", d.pick(MODES, F.col("vec_id")).alias("mode"),
        (F.lit(EPOCH_MS) + F.col("vec_id") * 3_600_000).alias("created_ms"),
        (F.col("vec_id") % 5).alias("hits"))


def cache_queries(t):
    return d.query_vectors(t).select(
        "query_id", "query_vector", d.pick(MODES, F.col("query_id")).alias("mode"),
        (F.lit(EPOCH_MS) + (F.col("query_id") + 2) * 40 * 3_600_000).alias("query_ms"))


_CACHE = {
    "cache": f"""
SELECT vec_id AS cache_id, CAST(embedding AS DOUBLE[]) AS embedding, {d.sql_pick(MODES, 'vec_id')} AS mode,
       {EPOCH_MS} + vec_id * 3600000 AS created_ms, vec_id % 5 AS hits FROM embeddings""",
    "asked": f"""
SELECT query_id, query_vector, {d.sql_pick(MODES, 'query_id')} AS mode,
       {EPOCH_MS} + (query_id + 2) * 40 * 3600000 AS query_ms FROM query_vectors""",
    "served": """
SELECT query_id, cache_id, similarity, query_ms FROM (
  SELECT a.query_id, c.cache_id, a.query_ms, round(list_cosine_similarity(c.embedding, a.query_vector), 6) AS similarity
  FROM asked a JOIN cache c ON c.mode = a.mode AND c.created_ms <= a.query_ms
   AND a.query_ms - c.created_ms < 168 * 3600000) WHERE similarity >= 0.2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cache_id) = 1""",
}


@query("semantic_cache_lookup", d.with_("query_vectors", "SELECT query_id, cache_id, similarity FROM served", _CACHE))
def semantic_cache_lookup(t):
    return ops.semantic_cache_lookup(cache(t), cache_queries(t), min_similarity=0.2)


@query("cache_hit_update", d.with_("query_vectors", """
SELECT c.cache_id, c.mode, c.hits + coalesce(s.n, 0) AS hits, s.last AS last_hit_ms
FROM cache c LEFT JOIN (SELECT cache_id, count(*) AS n, max(query_ms) AS last FROM served GROUP BY cache_id) s
ON s.cache_id = c.cache_id""", _CACHE))
def cache_hit_update(t):
    asked = cache_queries(t)
    served = ops.semantic_cache_lookup(cache(t), asked, min_similarity=0.2).join(
        asked.select("query_id", "query_ms"), "query_id")
    stored = cache(t).select("cache_id", "mode", "hits", F.lit(None).cast("long").alias("last_hit_ms"))
    return ops.cache_hit_update(stored, served)


@query("cache_ttl_evict", d.with_("query_vectors", """
SELECT cache_id, mode, created_ms FROM cache
WHERE created_ms > (SELECT max(created_ms) FROM cache) - 168 * 3600000""", {"cache": _CACHE["cache"]}))
def cache_ttl_evict(t):
    rows = cache(t).select("cache_id", "mode", "created_ms")
    return ops.cache_ttl_evict(rows, rows.select(F.max("created_ms")).scalar())


@query("vector_ann_lsh")
def vector_ann_lsh(t):
    return ops.vector_ann_lsh(d.chunk_vectors(t), d.query_vectors(t))


def built_index(t):
    return stored.build_index(d.chunk_vectors(t), scratch_path(t.spark, "vector-index"))


@query("vector_index_search")
def vector_index_search(t):
    return stored.search_index(built_index(t), d.query_vectors(t))


@query("vector_index_exact", d.with_(_BASE, topk_sql("true", 10)))
def vector_index_exact(t):
    return stored.search_exact(built_index(t), d.query_vectors(t))


# One query per hundredth vector; the check states the recall to be reached.
@query("vector_index_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(t):
    index = built_index(t)
    asked = t.embeddings.where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    exact = ops.vector_topk(d.chunk_vectors(t), asked, 10)
    return stored.index_recall(stored.search_index(index, asked, 10), exact).agg(
        F.count("*").alias("queries"), (F.sum("found") >= 0.9 * F.sum("expected")).alias("enough"))


@query("embed_batch")
def embed_batch(t):
    v = ops.embed_text(d.plain_texts(t))
    return v.select(
        "chunk_id", F.size("embedding").alias("width"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("filled"))
