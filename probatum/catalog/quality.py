"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as ops
from . import derived as d
from .registry import query


@query("verify_corpus", d.with_("norms", """
SELECT n.numero AS key, n.tipo, CASE WHEN n.doc_id % 10 = 3 THEN 'missing' WHEN n.doc_id % 10 = 4 THEN 'hash_mismatch'
  WHEN length(t.text) < CASE n.tipo WHEN 'LGUC' THEN 50000 WHEN 'OGUC' THEN 100000 ELSE 500 END THEN 'too_short' ELSE 'ok' END AS estado,
  CASE WHEN n.doc_id % 10 <> 3 THEN CAST(length(t.text) AS INTEGER) END AS chars FROM norms n JOIN documents t ON t.doc_id = n.doc_id"""))
def verify_corpus(t):
    i = F.col("doc_id")
    key = (i + 100).cast("string").alias("key")
    hashes = t.documents.select(key, F.sha2(F.when(i % 10 == 4, F.lit("old")).otherwise(F.col("text")), 256).alias("hash"))
    manifest = d.norms(t).select(F.col("numero").alias("key"), "tipo").join(hashes, "key")
    return ops.verify_corpus(manifest, t.documents.where(i % 10 != 3).select(key, "text"))


@query("duplicate_files", """
SELECT * FROM (SELECT md5, archivo, count(*) OVER (PARTITION BY md5) AS copias, min(archivo) OVER (PARTITION BY md5) AS primero FROM (
  SELECT md5(text) AS md5, 'f' || doc_id || '.pdf' AS archivo FROM documents)) WHERE copias > 1""")
def duplicate_files(t):
    return ops.copies_of(t.documents.select(
        F.md5("text").alias("md5"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("archivo")))


def variants(t):
    """Parts as documents whose keys come in several spellings."""
    i = F.col("p_partkey")
    number = F.concat((F.floor(i / 3) + 100).cast("string"), F.when(i % 3 == 1, F.lit("-2006")).otherwise(""))
    return t.part.select(i.alias("doc_id"), F.when(i % 3 == 2, F.lit("Ley")).otherwise("LEY").alias("tipo"), number.alias("numero"),
                         F.col("p_size").alias("chunks"))


@query("duplicate_documents", d.with_("", """
SELECT doc_id, clave, keep_id FROM (SELECT doc_id, clave, first_value(doc_id) OVER (PARTITION BY clave ORDER BY chunks DESC, doc_id) AS keep_id FROM keyed)
WHERE doc_id <> keep_id""", {"keyed": """
SELECT p_partkey AS doc_id, 'LEY-' || (p_partkey // 3 + 100) AS clave, p_size AS chunks FROM part"""}))
def duplicate_documents(t):
    return ops.duplicate_documents(variants(t))


@query("missing_ranges", """
SELECT l_suppkey AS grupo, n + 1 AS desde, nxt - 1 AS hasta, nxt - n - 1 AS faltan FROM (
  SELECT l_suppkey, n, lead(n) OVER (PARTITION BY l_suppkey ORDER BY n) AS nxt FROM (SELECT DISTINCT l_suppkey, l_orderkey AS n FROM lineitem))
WHERE nxt > n + 1""")
def missing_ranges(t):
    return ops.missing_ranges(t.lineitem.select(F.col("l_suppkey").alias("grupo"), F.col("l_orderkey").alias("n")))


@query("inventory_reconcile", """
SELECT coalesce(o.numero, w.numero, r.numero) AS numero, o.numero IS NOT NULL AS en_indice, coalesce(r.estado, w.estado, 'missing') AS estado
FROM (SELECT c_custkey AS numero FROM customer WHERE c_custkey % 10 <> 0) o
FULL OUTER JOIN (SELECT c_custkey AS numero, CASE WHEN c_acctbal > 0 THEN 'ok' ELSE 'alerta' END AS estado FROM customer WHERE c_custkey % 4 <> 1) w ON w.numero = o.numero
FULL OUTER JOIN (SELECT o_custkey AS numero, max_by(CASE o_orderstatus WHEN 'F' THEN 'ok' ELSE 'alerta' END, o_orderkey) AS estado FROM orders
  WHERE o_orderstatus <> 'P' GROUP BY o_custkey) r ON r.numero = coalesce(o.numero, w.numero)""")
def inventory_reconcile(t):
    i = F.col("c_custkey")
    official = t.customer.where(i % 10 != 0).select(i.alias("numero"))
    downloads = t.customer.where(i % 4 != 1).select(i.alias("numero"), F.when(F.col("c_acctbal") > 0, "ok").otherwise("alerta").alias("estado"))
    retries = t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("numero"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("alerta").alias("estado"),
        F.col("o_orderkey").alias("intento"))
    return ops.inventory_reconcile(official, downloads, retries)


@query("parse_size", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size * 1024 + 512.0::DOUBLE END AS kb FROM part""")
def parse_size(t):
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(i % 3 == 0, F.concat(size, F.lit("Kb"))).when(i % 3 == 1, F.concat(size, F.lit(",5 MB"))).otherwise("sin dato")
    return t.part.select("p_partkey", ops.parse_size(text).alias("kb"))


@query("inventory_counts", d.with_("norms", """
SELECT coalesce(categoria, '*') AS categoria, coalesce(tipo_norma, '*') AS tipo_norma, coalesce(estado, '*') AS estado, count(*) AS n FROM (
  SELECT dominio AS categoria, tipo AS tipo_norma, CASE WHEN vigente THEN 'vigente' ELSE 'derogada' END AS estado FROM norms)
GROUP BY CUBE (categoria, tipo_norma, estado)"""))
def inventory_counts(t):
    return ops.inventory_counts(d.norms(t).select(
        F.col("dominio").alias("categoria"), F.col("tipo").alias("tipo_norma"),
        F.when(F.col("vigente"), "vigente").otherwise("derogada").alias("estado")))


@query("too_few_chunks", d.with_("doc_lines", """
SELECT doc_id, chunks, chars FROM (SELECT doc_id, count(*) AS chunks, CAST(sum(length(line)) AS BIGINT) AS chars FROM doc_lines GROUP BY doc_id)
WHERE chunks < 5 AND chars >= 1000"""))
def too_few_chunks(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    docs = lines.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("line")).alias("chars"))
    return ops.too_few_chunks(docs, 5, 1000)
