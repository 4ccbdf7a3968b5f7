"""Whole jobs: incremental ingest and evidence retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lookups.norms import HIERARCHY, HIGH_TYPES
from ..operators import segmentation
from ..plans import answering, ingest as ingesting
from ..session import scratch_path
from . import derived as d
from .chunking import _DOC_STEPS, MAX, OVERLAP
from .gating import RULES
from .registry import query

@query("ingest_corpus", d.with_("statutes_code norms", """
SELECT doc_id, orden, texto FROM (
  SELECT doc_id, orden, '[' || tipo || ' ' || numero || coalesce(' › ' || jerarquia, '') || ' – Art. ' || articulo
    || CASE WHEN parts > 1 THEN ' (parte ' || part || '/' || parts || ')' ELSE '' END || ']' || chr(10) || texto AS texto FROM chunks)""",
    {**_DOC_STEPS, "lines": _DOC_STEPS["lines"].replace("FROM statutes_code", "FROM revised")}, recursive=True, early={"revised": """
SELECT doc_id, texto || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Artículo 9000.- Texto agregado en la segunda lectura' ELSE '' END AS texto
FROM statutes_code"""}))
def ingest_corpus(t):
    """Two runs: the second brings a changed text for every other document; only those are cut again."""
    docs = d.numbered_statutes(t, "code").select(
        F.col("doc_id").cast("string").alias("key"), "tipo", "numero", F.lit("https://docs.example/").alias("url"), F.col("texto").alias("text"))
    more = F.when(F.col("key").cast("long") % 2 == 0, F.lit("\nArtículo 9000.- Texto agregado en la segunda lectura")).otherwise("")
    corpus = ingesting.Corpus(t.spark, scratch_path(t.spark, "corpus"))
    cut = lambda text: segmentation.sections_of(text, segmentation.CODE)
    options = {"max_tokens": MAX, "overlap": OVERLAP, "paragraph": "\n", "sections": cut}
    ingesting.ingest(corpus, docs, 1, **options)
    ingesting.ingest(corpus, docs.withColumn("text", F.concat("text", more)), 2, **options)
    return corpus.chunks().select(F.col("doc_key").cast("long").alias("doc_id"), "orden", "texto")


def question_corpus(t):
    """Questions with the mean vector of a label, and documents as chunks of themselves."""
    n = d.norms(t)
    chunks = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("orden"), F.col("text").alias("texto"),
        F.lit("1").alias("articulo"), "embedding")
    i = F.col("query_id")
    means = d.query_vectors(t).withColumnRenamed("query_id", "label")
    asked = d.questions(t).withColumn("label", i % 10).join(means, "label").select(
        "query_id", "texto", "query_vector", F.array(d.pick(d.DOMAINS, i)).alias("dominios"))
    return asked, answering.Corpus(n, chunks)


_HIGH = str([x.upper() for x in HIGH_TYPES])[1:-1]
_PICK = "CASE n.jerarquia_norm " + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(HIERARCHY)) + " ELSE 5 END"


def _routing_sql() -> str:
    from ..lookups.norms import ROUTING

    cases = " ".join(f"WHEN '{k}' THEN {d.sql_list([x.upper() for x in v])}" for k, v in ROUTING.items())
    return f"CASE {d.sql_pick(d.DOMAINS, 'q.query_id')} {cases} END"


def _layer_sql(where: str, k: int) -> str:
    return f"""
SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
  SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(c.embedding, v.query_vector), 6) AS similarity
  FROM questions q JOIN query_vectors v ON v.query_id = q.query_id % 10, chunk_vectors c WHERE c.vigente AND c.chunk_id IN (SELECT doc_id FROM documents)
  AND {where}) QUALIFY rank <= {k}"""


@query("retrieve_evidence", d.with_("questions query_vectors chunk_vectors norms", """
SELECT m.query_id, m.chunk_id, m.similarity, m.forced, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY NOT m.forced, m.norm_key, m.pos, m.chunk_id) AS INTEGER) AS rank,
  n.tipo || ' ' || n.numero AS norma
FROM (SELECT query_id, chunk_id, 1.0::DOUBLE AS similarity, true AS forced, norm_key, 1 AS pos FROM forced
      UNION ALL SELECT query_id, chunk_id, similarity, false, '', rank FROM best b
      WHERE NOT EXISTS (SELECT 1 FROM forced f WHERE f.query_id = b.query_id AND f.chunk_id = b.chunk_id)) m
JOIN norms n ON n.doc_id = m.chunk_id""", {
    **RULES,
    "layer1": _layer_sql(f"upper(c.tipo) IN ({_HIGH})", 15),
    "layer2": _layer_sql(f"list_contains({_routing_sql()}, upper(c.tipo))", 25),
    "candidates": """
SELECT query_id, chunk_id, similarity FROM (SELECT 1 AS layer, * FROM layer1 UNION ALL SELECT 2, * FROM layer2)
QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY layer, rank) = 1""",
    "best": f"""
SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY h, similarity DESC, chunk_id) AS rank FROM (
  SELECT c.*, {_PICK} AS h FROM candidates c JOIN norms n ON n.doc_id = c.chunk_id) QUALIFY rank <= 18""",
    "wanted": "SELECT DISTINCT query_id, unnest(forced) AS norm_key FROM gate",
    "chosen": """
SELECT k.norm_key, min(n.doc_id) AS doc_id FROM (SELECT DISTINCT norm_key FROM wanted) k
JOIN norms n ON n.tipo = split_part(k.norm_key, '-', 1)
 AND (k.norm_key NOT LIKE '%-%' OR n.numero = substr(k.norm_key, instr(k.norm_key, '-') + 1)) GROUP BY k.norm_key""",
    "forced": """
SELECT query_id, chunk_id, min(norm_key) AS norm_key FROM (
  SELECT w.query_id, c.doc_id AS chunk_id, w.norm_key FROM wanted w JOIN chosen c ON c.norm_key = w.norm_key) GROUP BY query_id, chunk_id"""}))
def retrieve_evidence(t):
    asked, corpus = question_corpus(t)
    found = answering.retrieve(asked, corpus)
    return found.select("query_id", "chunk_id", "similarity", "forced", "rank", "norma")
