"""Reference graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lookups.norms import REF_TYPES
from ..lookups.patterns import REF_LAW, REF_NORM
from ..operators import graph as ops
from ..plans.graph import reference_graph
from . import derived as d
from .registry import query

_NUM = "CASE WHEN regexp_replace(replace({x}, '.', ''), '^0+', '') = '' THEN {x} ELSE regexp_replace(replace({x}, '.', ''), '^0+', '') END"
REFS = {
    "refs": f"""
SELECT DISTINCT chunk_id, doc_id, articulo, tipo, {_NUM.format(x='n')} AS numero FROM (
  SELECT chunk_id, doc_id, articulo, upper(unnest(regexp_extract_all(texto, '(?i){REF_NORM}', 1))) AS tipo,
         unnest(regexp_extract_all(texto, '(?i){REF_NORM}', 2)) AS n FROM passages
  UNION ALL SELECT chunk_id, doc_id, articulo, 'LEY', unnest(regexp_extract_all(texto, '(?i){REF_LAW}', 1)) FROM passages)
WHERE tipo IN ({str(REF_TYPES)[1:-1]})""",
    "resolved": """
SELECT tipo, numero, target_id, CAST(tier AS INTEGER) AS tier FROM (
  SELECT r.tipo, r.numero, n.doc_id AS target_id, 1 AS tier, n.doc_id AS o1, '' AS o0 FROM (SELECT DISTINCT tipo, numero FROM refs) r
    JOIN norms n ON n.tipo = r.tipo AND n.numero = r.numero
  UNION ALL SELECT r.tipo, r.numero, n.doc_id, 2, n.doc_id, n.numero FROM (SELECT DISTINCT tipo, numero FROM refs) r
    JOIN norms n ON n.tipo = r.tipo WHERE r.tipo IN ('LGUC', 'OGUC')
  UNION ALL SELECT r.tipo, r.numero, n.doc_id, 3, n.doc_id, n.numero FROM (SELECT DISTINCT tipo, numero FROM refs) r
    JOIN norms n ON n.tipo = r.tipo AND contains(n.numero, r.numero) WHERE r.tipo NOT IN ('LGUC', 'OGUC'))
QUALIFY row_number() OVER (PARTITION BY tipo, numero ORDER BY tier, o0, o1) = 1""",
    "hits": "SELECT r.*, s.target_id FROM refs r JOIN resolved s ON s.tipo = r.tipo AND s.numero = r.numero WHERE r.doc_id <> s.target_id",
    "edges": """
SELECT doc_id AS origen, target_id AS destino, 'remite_a' AS tipo_relacion, articulo FROM hits
QUALIFY row_number() OVER (PARTITION BY doc_id, target_id ORDER BY chunk_id, tipo, numero) = 1""",
}


def refs(t):
    return ops.extract_references(d.passages(t))


def edges(t):
    return reference_graph(d.passages(t), d.norms(t))[2]


@query("extract_references", d.with_("passages", "SELECT * FROM refs", {"refs": REFS["refs"]}))
def extract_references(t):
    return refs(t)


@query("resolve_references", d.with_("passages norms", "SELECT * FROM resolved", {k: REFS[k] for k in ("refs", "resolved")}))
def resolve_references(t):
    return ops.resolve_references(refs(t), d.norms(t))


@query("build_edges", d.with_("passages norms", """
SELECT origen, destino, tipo_relacion, coalesce(articulo, '') AS articulos, false AS verificado FROM edges""", REFS))
def build_edges(t):
    return edges(t).withColumn("articulos", F.array_join("articulos", ","))


@query("edge_stats", d.with_("passages norms", """
SELECT (SELECT count(*) FROM passages) AS chunks, (SELECT count(*) FROM refs) AS referencias, (SELECT count(*) FROM edges) AS insertadas,
  (SELECT count(*) FROM hits) - (SELECT count(*) FROM edges) AS ya_existian,
  (SELECT count(*) FROM refs r WHERE NOT EXISTS (SELECT 1 FROM resolved s WHERE s.tipo = r.tipo AND s.numero = r.numero)) AS sin_destino""", REFS))
def edge_stats(t):
    found, resolved, _ = reference_graph(d.passages(t), d.norms(t))
    return ops.edge_stats(d.passages(t), found, resolved)


ENRICHED = {
    **REFS,
    "verified": "SELECT * FROM edges WHERE (origen + destino) % 2 = 0",
    "present": """
SELECT DISTINCT e.query_id, n.doc_id FROM (SELECT DISTINCT query_id, numero FROM evidence) e JOIN norms n ON n.numero = e.numero
WHERE EXISTS (SELECT 1 FROM evidence x WHERE x.query_id = e.query_id AND x.tipo = n.tipo)""",
    "enriched": """
SELECT t.query_id, t.rank, o.tipo || ' ' || o.numero AS norma_origen, x.tipo || ' ' || x.numero AS norma_destino,
       x.titulo AS titulo_destino, t.tipo_relacion, coalesce(t.articulo, '') AS articulos
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY origen, destino) AS INTEGER) AS rank FROM (
        SELECT DISTINCT p.query_id, v.* FROM present p JOIN verified v ON p.doc_id = v.origen OR p.doc_id = v.destino) QUALIFY rank <= 20) t
JOIN norms o ON o.doc_id = t.origen JOIN norms x ON x.doc_id = t.destino""",
}


def verified_edges(t):
    return edges(t).withColumn("verificado", (F.col("origen") + F.col("destino")) % 2 == 0)


def enriched(t):
    return ops.graph_enrich(d.evidence(t), d.norms(t), verified_edges(t))


@query("graph_enrich", d.with_("evidence", "SELECT * FROM enriched", ENRICHED))
def graph_enrich(t):
    return enriched(t).withColumn("articulos", F.array_join("articulos", ","))


@query("graph_degree", d.with_("passages norms", """
SELECT doc_id, tipo_relacion, CAST(sum(o) AS BIGINT) AS salientes, CAST(sum(i) AS BIGINT) AS entrantes FROM (
  SELECT origen AS doc_id, tipo_relacion, 1 AS o, 0 AS i FROM edges UNION ALL SELECT destino, tipo_relacion, 0, 1 FROM edges)
GROUP BY doc_id, tipo_relacion""", REFS))
def graph_degree(t):
    return ops.graph_degree(edges(t))


@query("dependency_list", d.with_("norms", """
SELECT DISTINCT s.doc_id AS origen, n.doc_id AS destino, n.numero FROM (
  SELECT doc_id, unnest([CAST(doc_id // 2 + 100 AS VARCHAR), CAST(doc_id * 3 + 100 AS VARCHAR), CAST(doc_id + 101 AS VARCHAR)]) AS numero
  FROM norms) s JOIN norms n ON n.numero = s.numero"""))
def dependency_list(t):
    i = F.col("doc_id")
    declared = F.array(*[x.cast("string") for x in (F.floor(i / 2) + 100, i * 3 + 100, i + 101)])
    return ops.dependency_list(d.norms(t).withColumn("dependencias", declared))


@query("seed_relations", d.with_("norms", """
SELECT s.origen, s.destino, s.tipo_relacion, min(s.descripcion) AS descripcion, min(s.articulos) AS articulos, true AS verificado FROM seeds s
WHERE EXISTS (SELECT 1 FROM norms n WHERE n.doc_id = s.origen) AND EXISTS (SELECT 1 FROM norms n WHERE n.doc_id = s.destino)
  AND NOT (s.tipo_relacion = 'reglamento_de' AND s.origen % 4 = 0 AND s.destino = s.origen * 2) GROUP BY ALL""", {
    "seeds": """
SELECT doc_id AS origen, doc_id * 2 AS destino, 'reglamento_de' AS tipo_relacion, 'semilla ' || doc_id AS descripcion,
  '1,' || (doc_id % 9) AS articulos FROM norms
UNION ALL SELECT doc_id, 1, 'remite_a', 'por tipo', '3' FROM norms WHERE tipo = 'LEY'"""}))
def seed_relations(t):
    n, i = d.norms(t), F.col("doc_id")
    seeds = n.select(
        F.concat(F.lit("numero:"), (i + 100).cast("string")).alias("origen_sel"),
        F.concat(F.lit("numero:"), (i * 2 + 100).cast("string")).alias("destino_sel"), F.lit("reglamento_de").alias("tipo_relacion"),
        F.concat(F.lit("semilla "), i.cast("string")).alias("descripcion"), F.array(F.lit("1"), (i % 9).cast("string")).alias("articulos"))
    by_type = n.where(i == 1).select(
        F.lit("tipo:LEY").alias("origen_sel"), F.lit("numero:101").alias("destino_sel"), F.lit("remite_a").alias("tipo_relacion"),
        F.lit("por tipo").alias("descripcion"), F.array(F.lit("3")).alias("articulos"))
    existing = n.where(i % 4 == 0).select(i.alias("origen"), (i * 2).alias("destino"), F.lit("reglamento_de").alias("tipo_relacion"))
    return ops.seed_relations(seeds.unionByName(by_type), n, existing).withColumn("articulos", F.array_join("articulos", ","))


@query("normalize_ref", d.with_("passages", f"""
SELECT chunk_id, pos, CASE WHEN upper(t) IN ({str(REF_TYPES)[1:-1]}) THEN upper(t) END AS tipo, {_NUM.format(x='n')} AS numero FROM (
  SELECT chunk_id, unnest(ts) AS t, unnest(ns) AS n, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos FROM (
    SELECT chunk_id, regexp_extract_all(texto, '([A-Za-z]+) N° ([0-9.]+)', 1) AS ts, regexp_extract_all(texto, '([A-Za-z]+) N° ([0-9.]+)', 2) AS ns
    FROM passages))"""))
def normalize_ref(t):
    rx = F.lit("([A-Za-z]+) N° ([0-9.]+)")
    raw = F.arrays_zip(F.regexp_extract_all("texto", rx, F.lit(1)).alias("t"), F.regexp_extract_all("texto", rx, F.lit(2)).alias("n"))
    return d.passages(t).select("chunk_id", F.posexplode(raw).alias("pos", "r")).select(
        "chunk_id", "pos", ops.normalise_type(F.col("r.t")).alias("tipo"), ops.normalise_number(F.col("r.n")).alias("numero"))
