"""Segmentation queries. The check SQL works line by line with windows; the jobs work inside the row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segmentation as ops
from . import derived as d
from .cleaning import sql_strip
from .registry import query

_PATTERNS = {
    "code": (ops.CODE_TITLE, ops.CODE_CHAPTER, None, ops.CODE_ARTICLE),
    "dotted": (ops.DOTTED_TITLE, ops.DOTTED_CHAPTER, None, ops.DOTTED_ARTICLE),
    "law": (ops.LAW_TITLE, ops.LAW_CHAPTER, ops.LAW_PART, ops.LAW_ARTICLE),
}


def rx(pattern: str) -> str:
    """The same pattern for the other regex engine: no horizontal-blank class, no Unicode flag."""
    return pattern.replace("(?iu)", "(?i)").replace("(?imu)", "(?im)").replace("[°\\h]", "[° \\t]").replace("\\h", "[ \\t]")


def _lines(style: str, min_chars: int, reset: bool) -> dict[str, str]:
    title, chapter, part, article = _PATTERNS[style]
    kinds = [("T", title), ("C", chapter), ("P", part), ("A", article)]
    kind = "CASE " + " ".join(f"WHEN regexp_matches(line, '{rx(p)}') THEN '{k}'" for k, p in kinds if p) + " ELSE '' END"
    label = "CASE kind " + " ".join(
        f"WHEN '{k}' THEN '{prefix}' || {sql_strip(f'regexp_extract(line, {chr(39)}{rx(p)}{chr(39)}, 1)')}"
        for (k, p), prefix in zip(kinds[:3], ["TÍTULO ", "CAPÍTULO ", "PÁRRAFO "]) if p) + " END"
    by_title = "doc_id, tg" if reset else "doc_id"
    return {
        "lines": f"""SELECT doc_id, i, line, {kind} AS kind FROM (
  SELECT doc_id, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) AS i
  FROM statutes_{style})""",
        "marked": f"""SELECT *, {label} AS label, count(*) FILTER (kind <> '') OVER w AS seg, count(*) FILTER (kind = 'T') OVER w AS tg,
  count(*) FILTER (kind IN ('T', 'C')) OVER w AS cg FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)""",
        "inherited": f"""SELECT *,
  last_value(CASE WHEN kind = 'T' THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS titulo,
  last_value(CASE WHEN kind = 'C' THEN label END IGNORE NULLS) OVER (PARTITION BY {by_title} ORDER BY i) AS capitulo,
  last_value(CASE WHEN kind = 'P' THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id, cg ORDER BY i) AS parrafo FROM marked""",
        "found": f"""
SELECT doc_id, seg, any_value(titulo) AS titulo, any_value(capitulo) AS capitulo, any_value(parrafo) AS parrafo,
  {sql_strip("string_agg(line, chr(10) ORDER BY i)")} AS texto,
  max(CASE WHEN kind = 'A' THEN regexp_replace({sql_strip(f"regexp_extract(line, {chr(39)}{rx(article)}{chr(39)}, 1)")}, '\\s+', ' ', 'g') END) AS numero
FROM inherited GROUP BY doc_id, seg HAVING count(*) FILTER (kind = 'A') > 0 AND length({sql_strip("string_agg(line, chr(10) ORDER BY i)")}) >= {min_chars}""",
    }


def sql_gazette(x: str) -> str:
    last = f"list_extract(regexp_extract_all({x}, 'D\\.O\\.\\s+(\\d{{2}}\\.\\d{{2}}\\.\\d{{4}})', 1), -1)"
    return f"strftime(strptime({last}, '%d.%m.%Y'), '%Y-%m-%d')"


_ORDER = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS INTEGER) AS orden"
_SECTIONS = f"SELECT doc_id, {_ORDER}, titulo, capitulo, numero, texto, {sql_gazette('texto')} AS vigencia_desde FROM found"


@query("segment_articles", d.with_("statutes_code", _SECTIONS, _lines("code", 20, True)))
def segment_articles(t):
    return ops.segment(d.statutes(t, "code"), ops.CODE)


@query("segment_dotted_articles", d.with_("statutes_dotted", _SECTIONS, _lines("dotted", 20, False)))
def segment_dotted_articles(t):
    return ops.segment(d.statutes(t, "dotted"), ops.DOTTED)


_LAW = _lines("law", 15, True)


def law_texts(t):
    """Laws; every seventh one has lost its article headings."""
    bare = F.regexp_replace("texto", "ARTÍCULO", "ITEM")
    return d.statutes(t, "law").withColumn("texto", F.when(F.col("doc_id") % 7 == 0, bare).otherwise(F.col("texto")))


_LAW["lines"] = _LAW["lines"].replace("FROM statutes_law", "FROM laws")


@query("segment_law", d.with_("statutes_law", f"""
SELECT doc_id, {_ORDER}, titulo, coalesce(capitulo, parrafo) AS capitulo, numero, texto FROM found
UNION ALL
SELECT doc_id, CAST(n - 1 AS INTEGER), NULL, NULL, 'p' || n, p FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
    SELECT doc_id, {sql_strip('unnest(string_split(texto, chr(10)))')} AS p,
           generate_subscripts(string_split(texto, chr(10)), 1) AS i FROM laws
    WHERE doc_id NOT IN (SELECT doc_id FROM found)) WHERE length(p) > 100)""", {
    "laws": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(texto, 'ARTÍCULO', 'ITEM') ELSE texto END AS texto
FROM statutes_law""", **_LAW}))
def segment_law(t):
    return ops.segment_law(law_texts(t), paragraph="\n")


def sql_pack_tokens(parts: str, max_tokens: int, joiner: str) -> str:
    """Greedy blocks as a list, by a fold."""
    return f"""list_transform([list_reduce({parts}, lambda s, p:
      CASE WHEN s.cur = '' THEN struct_pack(blocks := s.blocks, cur := p.cur, n := p.n, blk := false)
           WHEN s.n + p.n > {max_tokens}
           THEN struct_pack(blocks := list_append(s.blocks, s.cur), cur := p.cur, n := p.n, blk := false)
           ELSE struct_pack(blocks := s.blocks, cur := s.cur || {joiner} || p.cur, n := s.n + p.n, blk := false) END,
      struct_pack(blocks := []::VARCHAR[], cur := '', n := 0::BIGINT, blk := false))],
      lambda s: CASE WHEN s.cur = '' THEN s.blocks ELSE list_append(s.blocks, s.cur) END)[1]"""


def sql_parts(paragraphs: str, least: int) -> str:
    return (f"list_transform(list_filter(list_transform({paragraphs}, lambda p: {sql_strip('p')}), lambda p: length(p) > {least}), "
            "lambda p: struct_pack(blocks := []::VARCHAR[], cur := p, n := CAST(ceil(length(p) / 4) AS BIGINT), blk := false))")


_BLOCKS = f"""
SELECT doc_id, unnest(b) AS texto, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS orden FROM (
  SELECT doc_id, {sql_pack_tokens(sql_parts("string_split(text, chr(10))", 20), 150, 'chr(10) || chr(10)')} AS b FROM documents)"""


@query("segment_blocks", d.with_("", _BLOCKS))
def segment_blocks(t):
    return ops.segment_blocks(t.documents, "text", 150, paragraph="\n")


def _circular_pieces(heading: str, title: bool) -> str:
    seg = f"count(*) FILTER (regexp_matches(line, '{rx(heading)}')) OVER (PARTITION BY doc_id ORDER BY i)"
    head = f"max(CASE WHEN regexp_matches(line, '{rx(heading)}') THEN regexp_extract(line, '{rx(heading)}', GROUPNO) END)"
    return f"""
SELECT doc_id, seg, {head.replace('GROUPNO', '1')} AS numero, {sql_strip(head.replace('GROUPNO', '2')) if title else 'CAST(NULL AS VARCHAR)'} AS titulo,
  {sql_strip("string_agg(line, chr(10) ORDER BY i)")} AS texto FROM (SELECT *, {seg} AS seg FROM lines)
WHERE seg > 0 GROUP BY doc_id, seg HAVING length({sql_strip("string_agg(line, chr(10) ORDER BY i)")}) >= 30"""


@query("segment_numbered", d.with_("statutes_circular", f"""
SELECT p.doc_id, {_ORDER.replace('doc_id', 'p.doc_id').replace('seg', 'p.seg')}, p.numero, p.titulo, p.texto,
  coalesce({sql_gazette('p.texto')}, {sql_gazette('s.texto')}) AS vigencia_desde
FROM chosen p JOIN statutes_circular s ON s.doc_id = p.doc_id""", {
    "lines": """SELECT doc_id, unnest(string_split(texto, chr(10))) AS line, generate_subscripts(string_split(texto, chr(10)), 1) AS i
FROM statutes_circular""",
    "by_section": _circular_pieces(ops.CIRCULAR_SECTION, True),
    "by_article": _circular_pieces(ops.CIRCULAR_ARTICLE, False),
    "use_sections": f"""
SELECT doc_id FROM lines GROUP BY doc_id HAVING count(*) FILTER (regexp_matches(line, '{rx(ops.CIRCULAR_NUMBERED)}')) >= 3
INTERSECT SELECT doc_id FROM by_section GROUP BY doc_id HAVING count(*) >= 2""",
    "blocks": f"""
SELECT doc_id, unnest(b) AS texto, generate_subscripts(b, 1) AS seg FROM (
  SELECT doc_id, {sql_pack_tokens(sql_parts("string_split(texto, chr(10))", 20), 150, 'chr(10) || chr(10)')} AS b FROM statutes_circular)""",
    "chosen": """
SELECT * FROM by_section WHERE doc_id IN (SELECT doc_id FROM use_sections)
UNION ALL SELECT * FROM by_article WHERE doc_id NOT IN (SELECT doc_id FROM use_sections)
UNION ALL SELECT doc_id, seg, 'bloque-' || seg, NULL, texto FROM blocks
WHERE doc_id NOT IN (SELECT doc_id FROM use_sections) AND doc_id NOT IN (SELECT doc_id FROM by_article)"""}))
def segment_numbered(t):
    return ops.segment_numbered(d.statutes(t, "circular"), max_tokens=150, paragraph="\n")


def sql_pack_chars(parts: str, target: int, joiner: str) -> str:
    """Greedy character blocks with a sentence pass for very long parts; every element is an accumulator record."""
    add = """CASE WHEN s.cur <> '' AND length(s.cur) + length(p.cur) < {t}
           THEN struct_pack(blocks := s.blocks, cur := s.cur || {j} || p.cur)
           WHEN s.cur = '' THEN struct_pack(blocks := s.blocks, cur := p.cur)
           ELSE struct_pack(blocks := list_append(s.blocks, s.cur), cur := p.cur) END"""
    outer = add.format(t=target, j=joiner)
    inner = add.format(t=target, j="' '").replace("s.", "v.").replace("p.", "x.")
    sentences = ("list_transform(string_split(regexp_replace(p.cur, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
                 "lambda q: struct_pack(blocks := []::VARCHAR[], cur := q))")
    return f"""list_transform([list_reduce({parts}, lambda s, p:
      CASE WHEN NOT (length(s.cur) + length(p.cur) < {target}) AND length(p.cur) > {target} * 1.5
      THEN list_reduce({sentences}, lambda v, x: {inner},
             struct_pack(blocks := CASE WHEN s.cur = '' THEN s.blocks ELSE list_append(s.blocks, s.cur) END, cur := ''))
      ELSE {outer} END, struct_pack(blocks := []::VARCHAR[], cur := ''))],
      lambda s: CASE WHEN s.cur = '' THEN s.blocks ELSE list_append(s.blocks, s.cur) END)[1]"""


_PART_SQL = "[" + ", ".join(
    f"struct_pack(start_at := CASE WHEN regexp_matches(texto, '{rx(p)}') THEN length(regexp_extract(texto, '(?s)^(.*?)' || '{rx(p)}', 1)) + 1 ELSE 0 END, name := '{n}')"
    for n, p in ops.RULING_PARTS) + "]"
_RULING_PARAGRAPHS = ("list_transform(list_filter(list_transform(string_split_regex(body, '\\n\\n+'), lambda p: " + sql_strip("p")
                      + "), lambda p: p <> ''), lambda p: struct_pack(blocks := []::VARCHAR[], cur := p))")


@query("segment_ruling", d.with_("statutes_ruling", """
SELECT doc_id, CAST(o - 1 AS INTEGER) AS orden, number || coalesce('-' || replace(lower(name), ' ', '-'), '') || '-' || o AS numero,
  name AS titulo, CASE WHEN o = 1 AND title IS NOT NULL THEN '[Dictamen CGR N° ' || number || ': ' || title || ']' || chr(10) || chr(10) || b
                  ELSE b END AS texto
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, bi) AS o FROM blocks WHERE length(b) >= 80)""", {
    "starts": f"""
SELECT doc_id, texto, start_at, name, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, name) AS part,
  lead(start_at) OVER (PARTITION BY doc_id ORDER BY start_at, name) AS until FROM (
  SELECT doc_id, texto, unnest({_PART_SQL}, recursive := true) FROM statutes_ruling) WHERE start_at > 0""",
    "parts": f"""
SELECT doc_id, part, name, body FROM (
  SELECT doc_id, part, name, {sql_strip("substr(texto, start_at, coalesce(until, length(texto) + 1) - start_at)")} AS body FROM starts)
WHERE length(body) > 50 QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2""",
    "bodies": """
SELECT * FROM parts UNION ALL SELECT doc_id, 1, NULL, texto FROM statutes_ruling
WHERE doc_id NOT IN (SELECT doc_id FROM parts)""",
    "blocks": f"""
SELECT doc_id, part, name, {sql_strip('unnest(bs)')} AS b, generate_subscripts(bs, 1) AS bi, CAST(doc_id AS VARCHAR) || '-2006' AS number,
  CASE WHEN doc_id % 2 = 0 THEN 'Materia ' || doc_id END AS title
FROM (SELECT doc_id, part, name, {sql_pack_chars(_RULING_PARAGRAPHS, 300, 'chr(10) || chr(10)')} AS bs FROM bodies)"""}))
def segment_ruling(t):
    i = F.col("doc_id").cast("string")
    rulings = d.statutes(t, "ruling").select(
        "doc_id", "texto", F.concat(i, F.lit("-2006")).alias("number"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Materia "), i)).alias("title"))
    return ops.segment_ruling(rulings, target=300)


@query("title_prefix", d.with_("", """
SELECT doc_id, pos, CASE WHEN pos = 0 AND doc_id % 2 = 0
  THEN '[Dictamen CGR N° ' || doc_id || '-2006: Materia ' || doc_id || ']' || chr(10) || chr(10) || line ELSE line END AS texto
FROM doc_lines""", {"doc_lines": d.CTES["doc_lines"]}))
def title_prefix(t):
    i = F.col("doc_id").cast("string")
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Materia "), i))
    return lines.select("doc_id", "pos", ops.title_prefix(
        F.col("pos"), F.concat(i, F.lit("-2006")), title, F.col("line")).alias("texto"))


@query("last_gazette_date", d.with_("statutes_code", f"SELECT doc_id, {sql_gazette('texto')} AS fecha FROM statutes_code"))
def last_gazette_date(t):
    return d.statutes(t, "code").select("doc_id", ops.last_gazette_date(F.col("texto")).alias("fecha"))


@query("hierarchy_label", d.with_("statutes_law", f"""
SELECT doc_id, {_ORDER}, nullif(concat_ws(' › ', titulo, capitulo, parrafo), '') AS jerarquia FROM found""", _lines("law", 15, True)))
def hierarchy_label(t):
    rows = d.statutes(t, "law").select(
        "doc_id", F.posexplode(ops.sections_of(F.col("texto"), ops.LAW)).alias("orden", "s"))
    return rows.select("doc_id", "orden", ops.hierarchy_label(
        F.col("s.titulo"), F.col("s.capitulo"), F.col("s.parrafo")).alias("jerarquia"))
