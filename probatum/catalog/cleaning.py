"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ENTITIES, html_to_text
from ..lookups import norms as N
from ..operators import cleaning as ops
from . import derived as d
from .registry import query

_BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {_BLANK})"


def sql_replace(x: str, *pairs: tuple[str, str]) -> str:
    for pattern, new in pairs:
        p = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{p}', {new}, 'g')"
    return x


NL, E = "chr(10)", "''"
_RAW_SQL = ("'Ley Chile cabecera' || chr(13) || chr(10) || replace(replace(text, chr(10), chr(13) || chr(10) || '    12  ' "
            "|| chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10)), ', ', ',' || chr(9) || '     ')")


def raw_texts(t):
    """Documents with scraped-text dirt: carriage returns, page numbers, tabs, a running header."""
    dirty = F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n    12  \r\n\n\n\n\n")), F.lit(", "), F.lit(",\t     "))
    return t.documents.select("doc_id", F.concat(F.lit("Ley Chile cabecera\r\n"), dirty).alias("raw"))


_RAW = {"raw_texts": f"SELECT doc_id, {_RAW_SQL} AS raw FROM documents"}
_COMMON = (("\\r\\n", NL), ("\\t", "' '"), (" {3,}", "'  '"))


@query("clean_text", d.with_("", f"""
SELECT doc_id, {sql_strip(sql_replace('raw', *_COMMON, (chr(92) + 'n{4,}', 'chr(10) || chr(10) || chr(10)')))} AS as_circular,
  {sql_strip(sql_replace('raw', (N.LAW_PAGE_HEADER, E), *_COMMON, (ops.LINE_NUMBER, E), (chr(92) + 'n{4,}', 'chr(10) || chr(10) || chr(10)')))} AS as_law
FROM raw_texts""", _RAW))
def clean_text(t):
    raw = F.col("raw")
    return raw_texts(t).select(
        "doc_id", ops.clean_text(raw, "circular").alias("as_circular"), ops.clean_text(raw, "law").alias("as_law"))


_RULING = {"rulings": """
SELECT doc_id, 'República de Chile' || chr(10) || replace(text, chr(10), chr(10) || '- ' || (doc_id % 90) || ' -' || chr(10)) ||
       CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Saluda a Ud., Contralor General' || chr(10) || 'fin' ELSE '' END AS raw
FROM documents""", "cleaned": f"""
SELECT doc_id, {sql_strip(sql_replace('raw', (N.RULING_PAGE_HEADER, E), (ops.DASHED_NUMBER, E), _COMMON[0], (chr(92) + 'r', NL), (chr(92) + 'n{4,}', 'chr(10) || chr(10) || chr(10)')))} AS b
FROM rulings"""}


@query("clean_ruling_text", d.with_("", f"""
SELECT doc_id, {sql_strip("regexp_replace(b, '(?s)" + N.RULING_SIGNATURE + ".*', '')")} AS body FROM cleaned""", _RULING))
def clean_ruling_text(t):
    mark = F.concat(F.lit("\n- "), (F.col("doc_id") % 90).cast("string"), F.lit(" -\n"))
    raw = F.concat(
        F.lit("República de Chile\n"), F.replace("text", F.lit("\n"), mark),
        F.when(F.col("doc_id") % 2 == 0, F.lit("\nSaluda a Ud., Contralor General\nfin")).otherwise(""))
    return t.documents.select("doc_id", ops.clean_ruling_text(raw).alias("body"))


@query("decode_json_text", d.with_("", """
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN raw
  WHEN NOT contains(raw, chr(92) || 'n') THEN raw
  WHEN json_valid(raw) THEN json_extract_string(raw, '$')
  ELSE replace(replace(replace(replace(substr(raw, 2, length(raw) - 2), chr(92) || 'n', chr(10)), chr(92) || 't', chr(9)),
               chr(92) || 'r', ''), chr(92) || '"', '"') END AS decoded FROM stored""", {
    "stored": """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '"' || replace(text, chr(10), chr(92) || 'n') || '"' ELSE text END AS raw
FROM documents"""}))
def decode_json_text(t):
    stored = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit('"')))
    return t.documents.select("doc_id", ops.decode_json_text(stored.otherwise(F.col("text"))).alias("decoded"))


_NAV = d.sql_list(["", *N.NAV_WORDS])


@query("strip_nav_header", d.with_("", f"""
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS body FROM lines l
JOIN (SELECT doc_id, min(CASE WHEN i > 25 OR NOT list_contains({_NAV}, {sql_strip('line')}) THEN i END) AS first
      FROM lines GROUP BY doc_id) f USING (doc_id) WHERE i >= first GROUP BY doc_id""", {
    "headed": "SELECT doc_id, 'Inicio' || chr(10) || ' ' || chr(10) || repeat('Texto ' || chr(10), doc_id % 30) || text AS t FROM documents",
    "lines": """SELECT doc_id, unnest(string_split(t, chr(10))) AS line,
       generate_subscripts(string_split(t, chr(10)), 1) AS i FROM headed"""}))
def strip_nav_header(t):
    headed = F.concat(F.lit("Inicio\n \n"), F.repeat(F.lit("Texto \n"), (F.col("doc_id") % 30).cast("int")), "text")
    return t.documents.select("doc_id", ops.strip_nav_header(headed).alias("body"))


def sql_html_to_text(x: str) -> str:
    x = sql_replace(x, ("(?is)<script.*?</script>", E), ("(?is)<style.*?</style>", E), ("(?i)<br\\s*/?>", NL),
                    ("(?i)</p>", "chr(10) || chr(10)"), ("(?i)</div>", NL), ("<[^>]+>", "' '"))
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql_strip(sql_replace(x, ("\\s{4,}", "chr(10) || chr(10)"), ("[ \\t]{3,}", "' '")))


@query("html_to_text", f"SELECT page_id, {sql_html_to_text('html')} AS body FROM pages")
def clean_html(t):
    return t.pages.select("page_id", html_to_text(F.col("html")).alias("body"))


_HOST = "minvu.gob.cl"
_LINK_REWRITES = [
    (r'<a href="/([a-eA-E][^"]*)">([^<]*)</a>', r'<a class="x" href="https://www.minvu.gob.cl/\1/DDU-{n}.pdf"><b>\2</b></a>'),
    (r'<a href="/([f-pF-P][^"]*)">([^<]*)</a>', r'<a href="https://www.minvu.gob.cl/\1.pdf">\2 DDU {m}</a>'),
    (r'<a href="/([q-sQ-S][^"]*)">([^<]*)</a>', r'<a href="https://elsewhere.example/\1/DDU-9.pdf">\2</a>'),
    (r'<a href="/([t-zT-Z][^"]*)">([^<]*)</a>', r'<a href="https://www.minvu.gob.cl/\1.pdf">\2 DDU-ESP {m}-07</a>'),
]


def linked_pages(t):
    """Pages whose navigation links point to numbered documents."""
    n, m = (F.col("page_id") % 40 + 1).cast("string"), (F.col("page_id") % 300 + 1).cast("string")
    html = F.col("html")
    for pattern, new in _LINK_REWRITES:
        html = F.regexp_replace(html, pattern, new.replace("\\1", "$1").replace("\\2", "$2"))
    return t.pages.select("page_id", F.replace(F.replace(html, F.lit("{n}"), n), F.lit("{m}"), m).alias("html"))


def _linked_sql() -> str:
    html = "html"
    for pattern, new in _LINK_REWRITES:
        html = f"regexp_replace({html}, '{pattern}', '{new}', 'g')"
    return (f"SELECT page_id, replace(replace({html}, '{{n}}', CAST(page_id % 40 + 1 AS VARCHAR)), "
            "'{m}', CAST(page_id % 300 + 1 AS VARCHAR)) AS html FROM pages")


_ANCHOR = '(?is)<a\\b[^>]*?href="([^"]*\\.pdf)"[^>]*>(.*?)</a>'
_LINKS = {
    "linked": _linked_sql(),
    "anchors": f"""
SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS url, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS raw,
       generate_subscripts(regexp_extract_all(html, '{_ANCHOR}', 1), 1) AS pos FROM linked""",
    "labelled": f"SELECT *, {sql_strip(sql_replace('raw', ('<[^>]+>', E)))} AS label FROM anchors WHERE contains(url, '{_HOST}')",
    "plain": """
SELECT *, CASE WHEN regexp_matches(label, '(?i)DDU\\s+\\d+') THEN regexp_extract(label, '(?i)DDU\\s+(\\d+)', 1)
          ELSE regexp_extract(url, '(?i)DDU-?(\\d+)\\.pdf', 1) END AS n, '' AS y, 'DDU-' AS prefix FROM labelled""",
    "special": """
SELECT *, regexp_extract(label, '(?i)DDU[- ]ESP[- ]?(\\d+)[- ](\\d+)', 1) AS n,
       '-' || regexp_extract(label, '(?i)DDU[- ]ESP[- ]?(\\d+)[- ](\\d+)', 2) AS y, 'DDU-ESP-' AS prefix FROM labelled""",
}


@query("extract_links", d.with_("", """
SELECT page_id, prefix || numero AS key, numero, label AS titulo, url FROM (
  SELECT page_id, prefix, CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END || y AS numero, left(label, 150) AS label, url, pos
  FROM (SELECT * FROM plain UNION ALL SELECT * FROM special) WHERE n <> '')
QUALIFY row_number() OVER (PARTITION BY page_id, prefix || numero ORDER BY pos) = 1""", _LINKS))
def extract_links(t):
    pages = linked_pages(t)
    return ops.extract_links(pages, _HOST).unionByName(ops.extract_links(pages, _HOST, special=True))


@query("extract_version_date", """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '20' || (10 + page_id % 15) || '-0' || (1 + page_id % 9) || '-15' END AS any_date,
       CASE WHEN page_id % 3 = 1 THEN '20' || (10 + page_id % 15) || '-0' || (1 + page_id % 9) || '-15' END AS own_date FROM pages""")
def extract_version_date(t):
    i = F.col("page_id")
    date = F.concat(F.lit("20"), (10 + i % 15).cast("string"), F.lit("-0"), (1 + i % 9).cast("string"), F.lit("-15"))
    link = F.concat(F.lit('<a href="/x?hddResultadoExportar='), (i + F.when(i % 3 == 1, 0).otherwise(1)).cast("string"),
                    F.lit("."), date, F.lit('">'))
    html = F.concat("html", F.when(i % 3 != 0, link).otherwise(""))
    return t.pages.select(
        "page_id", ops.extract_version_date(html).alias("any_date"),
        ops.extract_version_date(html, i.cast("string")).alias("own_date"))


@query("pick_best_text_field", d.with_("", """
SELECT page_id, CASE WHEN contains(best, number) OR contains(lower(best), 'dictamen') THEN best
       ELSE 'DICTAMEN N° ' || number || ' - 2006' || chr(10) || chr(10) || best END AS body FROM picked""", {
    "picked": f"""
SELECT page_id, CAST(page_id + 70000 AS VARCHAR) AS number,
  CASE WHEN page_id % 2 = 0 AND length({sql_html_to_text('html')}) >= 200 THEN {sql_html_to_text('html')}
       WHEN length({sql_html_to_text("url || ' ' || html || CASE WHEN page_id % 5 = 1 THEN ' Dictamen' ELSE '' END")}) >= 200
       THEN {sql_html_to_text("url || ' ' || html || CASE WHEN page_id % 5 = 1 THEN ' Dictamen' ELSE '' END")} END AS best
FROM pages"""}))
def pick_best_text_field(t):
    i = F.col("page_id")
    first = F.when(i % 2 == 0, F.col("html"))
    second = F.concat("url", F.lit(" "), "html", F.when(i % 5 == 1, F.lit(" Dictamen")).otherwise(""))
    best = ops.pick_best_text_field([first, second, F.col("url")], (i + 70000).cast("string"), F.lit("2006"))
    return t.pages.select("page_id", best.alias("body"))


@query("match_search_hit", d.with_("", """
SELECT search_id, hit_id, tier FROM (
  SELECT h.search_id, h.hit_id, h.pos, CASE
    WHEN ends_with(h.hit_id, 'N' || right(s.year, 2)) AND ltrim(regexp_replace(h.hit_id, 'N[0-9]+$', ''), '0') = ltrim(s.number, '0') THEN 1
    WHEN starts_with(h.hit_date, s.year) THEN 2 END AS tier FROM hits h JOIN searches s USING (search_id))
WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY tier, pos) = 1""", {
    "hits": """
SELECT o_custkey AS search_id, o_orderkey AS pos, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || 'N' || strftime(o_orderdate, '%y') AS hit_id,
       strftime(o_orderdate, '%Y-%m-%d') AS hit_date FROM orders""",
    "searches": """
SELECT o_custkey AS search_id, '0' || (max(o_orderkey) + o_custkey % 2) AS number,
       strftime(max_by(o_orderdate, o_orderkey), '%Y') AS year FROM orders GROUP BY o_custkey"""}))
def match_search_hit(t):
    o = t.orders
    hits = o.select(
        F.col("o_custkey").alias("search_id"), F.col("o_orderkey").alias("pos"),
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("N"), F.date_format("o_orderdate", "yy")).alias("hit_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("hit_date"))
    searches = o.groupBy(F.col("o_custkey").alias("search_id")).agg(
        F.concat(F.lit("0"), (F.max("o_orderkey") + F.first("o_custkey") % 2).cast("string")).alias("number"),
        F.date_format(F.max_by("o_orderdate", "o_orderkey"), "yyyy").alias("year"))
    return ops.match_search_hit(searches, hits)


_FILE_MARKS = ["BCN_", "MOP_", "x_orig_", "OCR_", "Modificacion_BCN_", "DO_", "", "copia_", "MMA_"]


@query("pick_best_file", d.with_("", """
SELECT brand, size, name FROM ranked WHERE keep OR NOT any_keep
QUALIFY row_number() OVER (PARTITION BY brand, size ORDER BY priority, name) = 1""", {
    "files": f"""
SELECT p_brand AS brand, p_size AS size, {d.sql_pick(_FILE_MARKS, 'p_partkey')} || p_name || '-' || p_partkey || '.pdf' AS name FROM part""",
    "ranked": """
SELECT *, bool_or(keep) OVER (PARTITION BY brand, size) AS any_keep FROM (
  SELECT *, NOT regexp_matches(name, 'orig|Modificacion|Reemplaza|modifica') AS keep,
    CASE WHEN contains(upper(name), 'OCR') THEN 0 WHEN contains(name, 'BCN') THEN 1 WHEN contains(name, 'FAOLEX') THEN 2
         WHEN contains(name, 'MMA') THEN 3 WHEN contains(name, 'MOP') THEN 4 WHEN contains(name, 'MINSAL') THEN 5
         WHEN contains(name, 'DO') THEN 6 ELSE 7 END AS priority FROM files)"""}))
def pick_best_file(t):
    name = F.concat(d.pick(_FILE_MARKS, F.col("p_partkey")), "p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    files = t.part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), name.alias("name"))
    return ops.pick_best_file(files, ["brand", "size"])
