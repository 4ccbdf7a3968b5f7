"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import chunking as ops, segmentation
from . import derived as d
from .cleaning import sql_strip
from .registry import query
from .segmentation import _lines

MAX, OVERLAP = 60, 15


@query("estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4) AS INTEGER) AS tokens FROM documents")
def tokens(t):
    return t.documents.select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


def sql_pack_sentences(p: str, limit: int) -> str:
    sentences = (f"list_transform(string_split(regexp_replace({p}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
                 "lambda q: struct_pack(packs := []::VARCHAR[], cur := q))")
    return f"""list_filter(list_transform(list_transform([list_reduce({sentences}, lambda s, x:
      CASE WHEN s.cur = '' THEN struct_pack(packs := s.packs, cur := x.cur)
           WHEN ceil(length(s.cur || ' ' || x.cur) / 4) > {limit} THEN struct_pack(packs := list_append(s.packs, {sql_strip('s.cur')}), cur := x.cur)
           ELSE struct_pack(packs := s.packs, cur := s.cur || ' ' || x.cur) END,
      struct_pack(packs := []::VARCHAR[], cur := ''))], lambda s: list_append(s.packs, s.cur))[1], lambda v: {sql_strip('v')}), lambda v: v <> '')"""


def sql_paragraphs(text: str, limit: int) -> str:
    whole = f"list_filter(list_transform(string_split({text}, chr(10)), lambda a: {sql_strip('a')}), lambda a: a <> '')"
    return (f"flatten(list_transform({whole}, lambda p: CASE WHEN ceil(length(p) / 4) <= {limit} THEN [p] "
            f"ELSE {sql_pack_sentences('p', limit)} END))")


@query("split_paragraphs", d.with_("", f"""
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS paragraph
FROM (SELECT doc_id, {sql_paragraphs('text', MAX)} AS p FROM documents)"""))
def split_paragraphs(t):
    return t.documents.select("doc_id", F.posexplode(ops.paragraphs_of(F.col("text"), MAX, "\n")).alias("pos", "paragraph"))


def window_steps(source: str, key: str) -> dict[str, str]:
    """Recursive window search over ``source (key, p)``: one row per window."""
    return {
        "sized": f"""
SELECT {key}, p, len(p) AS n, list_prepend(0::BIGINT, list_transform(range(1, len(p) + 1), lambda k:
  CAST(list_sum(list_transform(p[1:k], lambda x: ceil(length(x) / 4))) AS BIGINT))) AS ps FROM {source} WHERE len(p) > 0""",
        "windows": f"""
SELECT {key}, 0::BIGINT AS a, coalesce(list_min(list_filter(range(1, n), lambda i: ps[i + 2] - ps[1] > {MAX})), n) AS b FROM sized
UNION ALL
SELECT {key}, s, coalesce(list_min(list_filter(range(s + 1, n), lambda i: ps[i + 2] - ps[s + 1] > {MAX})), n) FROM (
  SELECT z.{key}, z.n, z.ps, CASE WHEN w.b = w.a + 1 THEN w.b ELSE
    coalesce(list_max(list_filter(range(w.a + 1, w.b), lambda r: z.ps[w.b + 1] - z.ps[r + 1] >= {OVERLAP})), w.a + 1) END AS s
  FROM windows w JOIN sized z ON z.{key} = w.{key} WHERE w.b < z.n)""",
        "cut": f"""
SELECT z.{key}, w.a, array_to_string(z.p[w.a + 1:w.b], chr(10) || chr(10)) AS texto FROM windows w JOIN sized z ON z.{key} = w.{key}
WHERE ceil(length(array_to_string(z.p, chr(10) || chr(10))) / 4) > {MAX}
UNION ALL SELECT {key}, 0, array_to_string(p, chr(10) || chr(10)) FROM sized
WHERE ceil(length(array_to_string(p, chr(10) || chr(10))) / 4) <= {MAX}""",
    }


@query("chunk_overlap", d.with_("", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS orden, texto,
       CAST(ceil(length(texto) / 4) AS INTEGER) AS tokens FROM cut""", {
    "parted": f"SELECT doc_id, {sql_paragraphs('text', MAX)} AS p FROM documents", **window_steps("parted", "doc_id")}, recursive=True))
def chunk_overlap(t):
    return ops.chunk_overlap(t.documents, "text", MAX, OVERLAP, "\n")


_CHUNKS = """
SELECT f.doc_id, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY f.seg, c.a) - 1 AS INTEGER) AS orden, f.numero AS articulo,
  nullif(concat_ws(' › ', f.titulo, f.capitulo), '') AS jerarquia, f.vigencia AS vigencia_desde, n.tipo, n.numero,
  c.texto, row_number() OVER (PARTITION BY f.doc_id, f.seg ORDER BY c.a) AS part, count(*) OVER (PARTITION BY f.doc_id, f.seg) AS parts
FROM keyed f JOIN cut c ON c.sec = f.sec JOIN norms n ON n.doc_id = f.doc_id"""
_DOC_STEPS = {
    **_lines("code", 20, True),
    "keyed": """SELECT *, doc_id * 1000000 + seg AS sec,
  strftime(strptime(list_extract(regexp_extract_all(texto, 'D\\.O\\.\\s+(\\d{2}\\.\\d{2}\\.\\d{4})', 1), -1), '%d.%m.%Y'), '%Y-%m-%d') AS vigencia FROM found""",
    "parted": f"SELECT sec, {sql_paragraphs('texto', MAX)} AS p FROM keyed",
    **window_steps("parted", "sec"),
    "chunks": _CHUNKS,
}


def norm_docs(t):
    url = F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string"))
    return d.numbered_statutes(t, "code").withColumn("url", url)


def code_sections():
    found = segmentation.sections_of(F.col("texto"), segmentation.CODE)
    return F.transform(found, lambda s: s.withField("vigencia_desde", segmentation.last_gazette_date(s["texto"])))


@query("chunk_documents", d.with_("statutes_code norms", """
SELECT doc_id, orden, texto, CAST(ceil(length(texto) / 4) AS INTEGER) AS tokens, articulo, jerarquia, vigencia_desde,
       'https://docs.example/' || doc_id AS fuente FROM (
  SELECT doc_id, orden, articulo, jerarquia, vigencia_desde, '[' || tipo || ' ' || numero || coalesce(' › ' || jerarquia, '') || ' – Art. '
         || articulo || CASE WHEN parts > 1 THEN ' (parte ' || part || '/' || parts || ')' ELSE '' END || ']' || chr(10) || texto AS texto
  FROM chunks)""", _DOC_STEPS, recursive=True))
def chunk_documents(t):
    chunks = ops.chunk_documents(norm_docs(t), code_sections(), MAX, OVERLAP, "\n")
    return chunks.select(
        "doc_id", "orden", "texto", "tokens", "metadatos.articulo", "metadatos.jerarquia",
        F.col("fecha_vigencia_desde").alias("vigencia_desde"), "fuente")


@query("chunk_chars", d.with_("", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS orden, c AS texto FROM (
  SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (
    SELECT doc_id, list_transform([list_reduce(list_transform(p, lambda x: struct_pack(parts := []::VARCHAR[], buf := x)), lambda s, x:
      CASE WHEN s.buf = '' THEN struct_pack(parts := s.parts, buf := x.buf)
           WHEN length(s.buf) + length(x.buf) + 1 > 600 THEN struct_pack(parts := list_append(s.parts, {sql_strip('s.buf')}),
                buf := array_to_string(list_reverse(list_reverse(string_split(s.buf, ' '))[1:13]), ' ') || chr(10) || x.buf)
           ELSE struct_pack(parts := s.parts, buf := s.buf || chr(10) || x.buf) END,
      struct_pack(parts := []::VARCHAR[], buf := ''))], lambda s: list_append(s.parts, {sql_strip('s.buf')}))[1] AS cs
    FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda a: {sql_strip('a')}), lambda a: a <> '') AS p
          FROM documents))) WHERE length(c) > 20"""))
def chunk_chars(t):
    return ops.chunk_chars(t.documents, "text", separator="\n")


@query("ingest_outcomes", d.with_("statutes_code norms", """
SELECT status, count(*) AS documents, CAST(sum(CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END) AS BIGINT) AS chunks,
       bool_or(status = 'error') AS failed FROM (
  SELECT s.doc_id, c.n, CASE WHEN s.doc_id % 11 = 5 THEN 'error' WHEN s.doc_id % 11 = 7 THEN 'no_text'
    WHEN s.doc_id % 3 = 0 THEN 'unchanged' WHEN coalesce(x.k, 0) = 0 THEN 'parser_empty' ELSE 'ok' END AS status
  FROM statutes_code s LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c ON c.doc_id = s.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS k FROM found GROUP BY doc_id) x ON x.doc_id = s.doc_id)
GROUP BY status""", _DOC_STEPS, recursive=True))
def ingest_outcomes(t):
    i = F.col("doc_id")
    docs = norm_docs(t)
    sections = docs.select("doc_id", "texto", F.size(code_sections()).alias("sections"))
    counts = ops.chunk_documents(docs, code_sections(), MAX, OVERLAP, "\n").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    text = F.when(i % 11 == 7, F.lit(" ")).otherwise(F.col("texto"))
    rows = sections.join(counts, "doc_id", "left").select(
        "doc_id", text.alias("text"), F.sha2("texto", 256).alias("hash"),
        F.when(i % 3 == 0, F.sha2("texto", 256)).when(i % 3 == 1, F.lit("old")).alias("old_hash"), "sections",
        F.coalesce("chunks", F.lit(0)).alias("chunks"), F.when(i % 11 == 5, F.lit("timeout")).alias("error"))
    return ops.ingest_outcomes(rows)
