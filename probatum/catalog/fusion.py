"""Fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lookups.norms import HIERARCHY, HIGH_TYPES
from ..operators import fulltext, fusion as ops, vectors
from ..session import materialise
from . import derived as d
from .registry import query
from .search import INDEX, SEARCH, index_of, ranked, sql_tokens

FRAMES = "chunk_vectors query_vectors chunk_texts"


def item_vectors(t):
    """Searches with a text and a vector: every benchmark item with the mean vector of a label."""
    items = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("label"))
    means = d.query_vectors(t).withColumnRenamed("query_id", "label")
    return items.join(means, "label").drop("label")


def vector_list(t, k):
    return vectors.vector_topk(d.chunk_vectors(t), item_vectors(t), k)


def text_list(t, k):
    return fulltext.fts_search(index_of(t), d.text_queries(t), k)


def word_list(t, k):
    return fulltext.fts_search(index_of(t), d.word_queries(t), k)


def _vec_sql(k: int) -> str:
    return f"""
SELECT query_id, chunk_id, similarity, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT b.item_id AS query_id, c.chunk_id, round(list_cosine_similarity(c.embedding, q.query_vector), 6) AS similarity
      FROM benchmark b JOIN query_vectors q ON q.query_id = b.item_id % 10, chunk_vectors c)
QUALIFY rank <= {k}"""


def steps(kv: int, kf: int, search: dict[str, str] = INDEX, **more: str) -> dict[str, str]:
    return {**search, "vec": _vec_sql(kv), "fts": ranked(kf), **more}


_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank"
_RRF = """
SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.chunk_id, f.chunk_id) AS chunk_id,
       round({w} / (60 + coalesce(v.rank, 100)) + {u} / (60 + coalesce(f.rank, 100)), 9) AS similarity
FROM vec v FULL OUTER JOIN fts f ON f.query_id = v.query_id AND f.chunk_id = v.chunk_id"""
_WEIGHTED = """
SELECT coalesce(v.query_id, f.query_id) AS query_id, coalesce(v.chunk_id, f.chunk_id) AS chunk_id,
       round(coalesce(v.similarity, 0) * {w} + coalesce(f.score / (f.score + 1), 0) * (1 - {w}), 6) AS similarity
FROM vec v FULL OUTER JOIN fts f ON f.query_id = v.query_id AND f.chunk_id = v.chunk_id"""


@query("hybrid_rrf", d.with_(FRAMES, f"SELECT query_id, chunk_id, similarity, {_RANK} FROM mixed QUALIFY rank <= 16",
                             steps(40, 40, mixed=_RRF.format(w="0.7::DOUBLE", u="(1 - 0.7::DOUBLE)"))))
def hybrid_rrf(t):
    return ops.hybrid_rrf(vector_list(t, 40), word_list(t, 40))


@query("hybrid_weighted", d.with_(FRAMES, f"SELECT query_id, chunk_id, similarity, {_RANK} FROM mixed QUALIFY rank <= 10",
                                  steps(30, 30, mixed=_WEIGHTED.format(w="0.7::DOUBLE"))))
def hybrid_weighted(t):
    return ops.hybrid_weighted(vector_list(t, 30), word_list(t, 30))


@query("hybrid_or_vector", d.with_(FRAMES, """
SELECT query_id, chunk_id, similarity, rank, 'hybrid' AS source FROM hybrid WHERE query_id % 3 <> 0
UNION ALL SELECT query_id, chunk_id, similarity, rank, 'vector' FROM vec10
WHERE query_id NOT IN (SELECT query_id FROM hybrid WHERE query_id % 3 <> 0)""", steps(
    30, 30, SEARCH, mixed=_WEIGHTED.format(w="0.6::DOUBLE"),
    hybrid=f"SELECT query_id, chunk_id, similarity, {_RANK} FROM mixed QUALIFY rank <= 10",
    vec10="SELECT * FROM vec WHERE rank <= 10")))
def hybrid_or_vector(t):
    wide = vector_list(t, 30)
    hybrid = ops.hybrid_weighted(wide, text_list(t, 30), 10, weight=0.6)
    asked = t.benchmark.select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("artículo "), "item_id")).otherwise("concepto").alias("texto"))
    exact = asked.select("query_id", fulltext.has_exact_terms(F.col("texto")).alias("exact"))
    return ops.hybrid_or_vector(hybrid, wide.where("rank <= 10"), exact)


@query("rrf_fusion", d.with_(FRAMES, """
SELECT query_id, chunk_id, first_list, round(raw, 3) AS similarity,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 12) AS raw, min(list_no) AS first_list FROM (
        SELECT 1 AS list_no, query_id, chunk_id, rank FROM vec UNION ALL SELECT 2, query_id, chunk_id, rank FROM fts)
      GROUP BY query_id, chunk_id) QUALIFY rank <= 20""", steps(25, 25, SEARCH)))
def rrf_fusion(t):
    lists = vector_list(t, 25).select("query_id", "chunk_id", "rank", F.lit(1).alias("list_no")).unionByName(
        text_list(t, 25).select("query_id", "chunk_id", "rank", F.lit(2).alias("list_no")))
    return ops.rrf_fusion(lists, 20)


def variants(t):
    """Other wordings of each label query: benchmark texts, with the mean vector of another label."""
    return t.benchmark.select(
        (F.col("item_id") % 10).alias("query_id"), F.col("item_id").alias("variant_no"),
        F.col("text").alias("variant_text"), ((F.col("item_id") * 7 + 3) % 10).alias("label"))


_VARIANTS = {
    "used": """
SELECT item_id % 10 AS query_id, (item_id * 7 + 3) % 10 AS label,
       CAST(row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) AS INTEGER) AS list_no
FROM benchmark WHERE length(trim(text)) BETWEEN 11 AND 499 QUALIFY list_no <= 3""",
    "searches": """
SELECT query_id, 0 AS list_no, query_vector FROM query_vectors
UNION ALL SELECT u.query_id, u.list_no, q.query_vector FROM used u JOIN query_vectors q ON q.query_id = u.label""",
    "counted": "SELECT *, count(*) OVER (PARTITION BY query_id) AS lists FROM searches",
    "lists": """
SELECT query_id, list_no, chunk_id, rank FROM (
  SELECT s.query_id, s.list_no, s.lists, c.chunk_id, row_number() OVER (PARTITION BY s.query_id, s.list_no
         ORDER BY round(list_cosine_similarity(c.embedding, s.query_vector), 6) DESC, c.chunk_id) AS rank
  FROM counted s, chunk_vectors c) WHERE rank <= greatest(ceil(20 / lists) + 5, 10)""",
    "multi": """
SELECT query_id, chunk_id, first_list, round(raw, 3) AS similarity,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 12) AS raw, min(list_no) AS first_list
      FROM lists GROUP BY query_id, chunk_id) QUALIFY rank <= 20""",
}


def multi_query_hits(t):
    means = d.query_vectors(t)
    used = ops.usable_variants(variants(t)).join(means.withColumnRenamed("query_id", "label"), "label")
    searches = means.select("query_id", F.lit(0).alias("list_no"), "query_vector").unionByName(
        used.select("query_id", "list_no", "query_vector"))
    counts = searches.groupBy("query_id").agg(F.count("*").alias("lists"))
    keyed = searches.withColumn("search_id", F.col("query_id") * 10 + F.col("list_no"))
    hits = vectors.vector_topk(
        d.chunk_vectors(t), keyed.select(F.col("search_id").alias("query_id"), "query_vector"), 25)
    return hits.select(
        F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("list_no"),
        "chunk_id", "rank").join(counts, "query_id")


@query("multi_query", d.with_(FRAMES, "SELECT * FROM multi", _VARIANTS))
def multi_query(t):
    return ops.multi_query(multi_query_hits(t), 20)


_PLAN_TYPES = ["OGUC", "DDU", "DDU_ESPECIFICA", "LGUC", "DS"]
_LAYER = """
SELECT query_id, chunk_id, similarity, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY similarity DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(c.embedding, q.query_vector), 6) AS similarity
      FROM query_vectors q, chunk_vectors c WHERE c.vigente AND upper(c.tipo) IN ({types})) QUALIFY rank <= {k}"""
_LAYERS = {
    **_VARIANTS,
    "layer1": _LAYER.format(types=str([x.upper() for x in HIGH_TYPES])[1:-1], k=15),
    "layer2": _LAYER.format(types=str(_PLAN_TYPES)[1:-1], k=25),
    "stacked": """
SELECT 1 AS layer, query_id, chunk_id, similarity, rank FROM layer1
UNION ALL SELECT 2, query_id, chunk_id, similarity, rank FROM layer2
UNION ALL SELECT 3, query_id, chunk_id, similarity, rank FROM multi""",
    "layered": """
SELECT query_id, chunk_id, similarity, layer, layer_rank,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY layer, layer_rank, chunk_id) AS INTEGER) AS rank
FROM (SELECT query_id, chunk_id, similarity, layer, rank AS layer_rank FROM stacked
      QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY layer, rank) = 1) QUALIFY rank <= 50""",
}


def layers(t):
    valid = d.chunk_vectors(t).where("vigente").withColumn("tipo", F.upper("tipo"))
    high = [x.upper() for x in HIGH_TYPES]
    asked = d.query_vectors(t)
    first = vectors.vector_topk(valid.where(F.col("tipo").isin(high)), asked, 15)
    second = vectors.vector_topk(valid.where(F.col("tipo").isin(_PLAN_TYPES)), asked, 25)
    return ops.layered_candidates([first, second, ops.multi_query(multi_query_hits(t), 20)])


@query("layered_candidates", d.with_(FRAMES, "SELECT * FROM layered", _LAYERS))
def layered_candidates(t):
    return layers(t)


@query("rerank_scores", d.with_(FRAMES, """
SELECT query_id, chunk_id, round(score, 3) AS similarity,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT v.query_id, v.chunk_id, f.score FROM vec v JOIN found f ON f.query_id = v.query_id AND f.chunk_id = v.chunk_id)
QUALIFY rank <= 18""", steps(40, 40, SEARCH)))
def rerank_scores(t):
    scores = fulltext.fts_search(index_of(t), d.text_queries(t), None).withColumnRenamed("score", "relevance")
    return ops.rerank_scores(vector_list(t, 40), scores)


_HIER = "CASE c.jerarquia_norm " + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(HIERARCHY)) + " ELSE 5 END"


@query("rerank_hierarchy", d.with_(FRAMES, f"""
SELECT query_id, chunk_id, similarity, jerarquia_norm, hierarchy, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY hierarchy, similarity DESC, chunk_id) AS INTEGER) AS rank
FROM (SELECT l.query_id, l.chunk_id, l.similarity, c.jerarquia_norm, {_HIER} AS hierarchy
      FROM vec l JOIN chunk_vectors c ON c.chunk_id = l.chunk_id) QUALIFY rank <= 18""", {"vec": _vec_sql(50)}))
def rerank_hierarchy(t):
    rank_of = d.chunk_vectors(t).select("chunk_id", "jerarquia_norm")
    return ops.rerank_hierarchy(vector_list(t, 50).join(rank_of, "chunk_id"))


@query("gap_expand", d.with_(FRAMES, f"""
SELECT query_id, chunk_id, gap_no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY gap_no, r, chunk_id) AS INTEGER) AS rank
FROM (
  SELECT query_id, chunk_id, 0 AS gap_no, rank AS r FROM round1
  UNION ALL
  SELECT query_id, chunk_id, gap_no, r FROM (
    SELECT g.query_id, g.chunk_id, g.gap_no, g.rank AS r FROM gap_hits g
    JOIN (SELECT query_id FROM round1 GROUP BY query_id HAVING count(*) >= 3) b ON b.query_id = g.query_id
    WHERE NOT EXISTS (SELECT 1 FROM round1 x WHERE x.query_id = g.query_id AND x.chunk_id = g.chunk_id)
    QUALIFY row_number() OVER (PARTITION BY g.query_id, g.chunk_id ORDER BY g.gap_no, g.rank) = 1))
QUALIFY rank <= 20 OR query_id NOT IN (
  SELECT g.query_id FROM gap_hits g JOIN (SELECT query_id FROM round1 GROUP BY query_id HAVING count(*) >= 3) b
  ON b.query_id = g.query_id)""", {
    **{k: INDEX[k] for k in ("words", "postings", "stats", "spread")},
    "round1": _vec_sql(18),
    "query_words": f"SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark",
    "gaps": """
SELECT query_id, term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY term) AS INTEGER) AS gap_no FROM (
  SELECT w.query_id, w.term FROM query_words w WHERE NOT EXISTS (
    SELECT 1 FROM round1 r JOIN postings p ON p.chunk_id = r.chunk_id
    WHERE r.query_id = w.query_id AND p.term = w.term)) QUALIFY gap_no <= 3""",
    "gap_hits": """
SELECT query_id, gap_no, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, gap_no ORDER BY score DESC, chunk_id)
       AS INTEGER) AS rank
FROM (SELECT g.query_id, g.gap_no, p.chunk_id, round(ln(1 + (s.chunks - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * p.chunk_terms / s.mean_terms)), 6) AS score
      FROM gaps g JOIN postings p ON p.term = g.term JOIN spread f ON f.term = g.term, stats s) QUALIFY rank <= 10""",
}))
def gap_expand(t):
    index, first = index_of(t), materialise(vector_list(t, 18), "gap-first")
    words = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.explode(fulltext.tokens(F.col("text"))).alias("term"))
    present = ops.present_terms(first, index.chunks)
    gaps = materialise(ops.missing_terms(words, present), "gap-terms")
    searches = gaps.select((F.col("query_id") * 10 + F.col("gap_no")).alias("query_id"), F.col("term").alias("query_text"))
    hits = fulltext.fts_search(index, searches, 10).select(
        F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("gap_no"),
        "chunk_id", "rank")
    return ops.gap_expand(first, materialise(hits, "gap-hits"))


_KEYS = ["DDU-161", "LGUC", "OGUC", "LEY-17288", "CGR-108", "DFL-105", "DL-106"]
_FORCED = {
    "keys": f"""
SELECT DISTINCT query_id, {d.sql_pick(_KEYS, 'conv_id')} AS norm_key FROM questions
UNION SELECT query_id, {d.sql_pick(_KEYS, 'query_id')} FROM questions""",
    "chosen": """
SELECT k.norm_key, min(n.doc_id) AS doc_id FROM (SELECT DISTINCT norm_key FROM keys) k
JOIN norms n ON n.tipo = split_part(k.norm_key, '-', 1)
 AND (k.norm_key NOT LIKE '%-%' OR n.numero = substr(k.norm_key, instr(k.norm_key, '-') + 1)) GROUP BY k.norm_key""",
    "opening": """
SELECT doc_id, chunk_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY orden, chunk_id) AS INTEGER) AS place
FROM passages QUALIFY place <= 3""",
    "forced": """
SELECT k.query_id, k.norm_key, c.doc_id, o.chunk_id, o.place, CAST(1 AS DOUBLE) AS similarity
FROM keys k JOIN chosen c ON c.norm_key = k.norm_key JOIN opening o ON o.doc_id = c.doc_id""",
    "retrieved": """
SELECT q.query_id, p.chunk_id, p.orden + 1 AS rank, CAST(0.5 AS DOUBLE) AS similarity
FROM questions q JOIN passages p ON p.doc_id = q.conv_id""",
}


def forced(t):
    q = d.questions(t)
    keys = q.select("query_id", d.pick(_KEYS, F.col("conv_id")).alias("norm_key")).union(
        q.select("query_id", d.pick(_KEYS, F.col("query_id")).alias("norm_key"))).distinct()
    return ops.forced_chunks(keys, d.norms(t), d.passages(t))


@query("forced_chunks", d.with_("questions passages norms", "SELECT * FROM forced", _FORCED))
def forced_chunks(t):
    return forced(t)


@query("merge_forced_first", d.with_("questions passages norms", """
SELECT query_id, chunk_id, similarity, part = 0 AS forced, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY part, norm_key, pos, chunk_id) AS INTEGER) AS rank
FROM (
  SELECT query_id, chunk_id, similarity, 0 AS part, norm_key, place AS pos FROM forced
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY norm_key, place) = 1
  UNION ALL
  SELECT query_id, chunk_id, similarity, 1, '', rank FROM retrieved r
  WHERE NOT EXISTS (SELECT 1 FROM forced f WHERE f.query_id = r.query_id AND f.chunk_id = r.chunk_id))""", _FORCED))
def merge_forced_first(t):
    q = d.questions(t).select("query_id", F.col("conv_id").alias("doc_id"))
    retrieved = q.join(d.passages(t), "doc_id").select(
        "query_id", "chunk_id", (F.col("orden") + 1).alias("rank"), F.lit(0.5).alias("similarity"))
    return ops.merge_forced_first(forced(t), retrieved)
