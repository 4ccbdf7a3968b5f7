"""Full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN
from ..operators import fulltext as ops
from ..session import scratch_path
from . import derived as d
from .registry import query


def sql_fold(col: str) -> str:
    return f"translate(lower({col}), '{ACCENTED}', '{PLAIN}')"


def sql_tokens(col: str) -> str:
    return f"list_filter(string_split_regex({sql_fold(col)}, '[^a-z0-9]+'), lambda w: w <> '')"


INDEX = {
    "words": f"""
SELECT chunk_id, len(w) AS chunk_terms, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos
FROM (SELECT chunk_id, {sql_tokens('texto')} AS w FROM chunk_texts)""",
    "postings": """
SELECT term, chunk_id, count(*) AS tf, max(chunk_terms) AS chunk_terms, list(pos ORDER BY pos) AS positions
FROM words GROUP BY term, chunk_id""",
    "text_queries": """
SELECT item_id AS query_id, CASE item_id % 4 WHEN 1 THEN '"' || text || '"' WHEN 2 THEN text || ' -avec'
       WHEN 3 THEN replace(text, ' ', ' or ') ELSE text END AS query_text, item_id % 4 AS shape, text FROM benchmark""",
    # one row per searched word; alternatives of shape 3 count as one slot
    "parts": """
SELECT query_id, shape, word, i FROM (
  SELECT query_id, shape, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT query_id, shape, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM text_queries))""",
    "lines_of": """
SELECT query_id, i, sum(starts) OVER (PARTITION BY query_id ORDER BY i) AS grp FROM (
  SELECT query_id, i, 1 AS starts FROM parts WHERE shape <> 3
  UNION ALL SELECT query_id, i, CASE WHEN i = 1 THEN 1 ELSE 0 END FROM parts WHERE shape = 3)""",
    "alternatives": f"""
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l) AS VARCHAR) AS no, unnest({sql_tokens('l')}) AS term
FROM (SELECT query_id, unnest(string_split_regex(text, '[^\\S ]+')) AS l, text FROM text_queries WHERE shape = 3)""",
    "asked": f"""
SELECT DISTINCT query_id, CASE WHEN shape = 1 THEN 'p' ELSE 't:' || term END AS slot, term, false AS excluded FROM (
  SELECT query_id, shape, unnest({sql_tokens('text')}) AS term FROM text_queries WHERE shape <> 3)
UNION ALL SELECT query_id, 'a:' || no, term, false FROM (SELECT DISTINCT query_id, no, term FROM alternatives)
UNION ALL SELECT query_id, 'n', 'avec', true FROM text_queries WHERE shape = 2""",
    "stats": """
SELECT count(*) AS chunks, avg(n) AS mean_terms FROM (SELECT chunk_id, max(chunk_terms) AS n FROM postings GROUP BY chunk_id)""",
    "spread": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "hits": """
SELECT a.query_id, p.chunk_id, a.slot, a.term, a.excluded,
       ln(1 + (s.chunks - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
       / (p.tf + 1.2 * (0.25 + 0.75 * p.chunk_terms / s.mean_terms)) AS gain
FROM asked a JOIN postings p ON p.term = a.term JOIN spread f ON f.term = a.term, stats s""",
    "phrase_ok": f"""
SELECT DISTINCT q.query_id, c.chunk_id FROM text_queries q JOIN chunk_texts c
ON contains(' ' || array_to_string({sql_tokens('c.texto')}, ' ') || ' ', ' ' || array_to_string({sql_tokens('q.text')}, ' ') || ' ')
WHERE q.shape = 1""",
    "needed": "SELECT query_id, count(DISTINCT slot) AS slots FROM asked WHERE NOT excluded GROUP BY query_id",
    "found": """
SELECT h.query_id, h.chunk_id, round(g.score, 6) AS score FROM (
  SELECT query_id, chunk_id, count(DISTINCT slot) FILTER (NOT excluded) AS matched, bool_or(excluded) AS bad
  FROM hits GROUP BY query_id, chunk_id) h
JOIN (SELECT query_id, chunk_id, sum(gain) AS score FROM (
        SELECT DISTINCT query_id, chunk_id, term, gain FROM hits WHERE NOT excluded) GROUP BY query_id, chunk_id) g
  ON g.query_id = h.query_id AND g.chunk_id = h.chunk_id
JOIN needed n ON n.query_id = h.query_id AND n.slots = h.matched
JOIN text_queries q ON q.query_id = h.query_id
WHERE NOT h.bad AND (q.shape <> 1 OR EXISTS (
  SELECT 1 FROM phrase_ok p WHERE p.query_id = h.query_id AND p.chunk_id = h.chunk_id))""",
}
INDEX.pop("parts"), INDEX.pop("lines_of")

# The search texts read part by part: an "or" between two parts joins them in one slot, any other is a word, and "-" excludes.
_READ = {
    "parts": r"""
SELECT query_id, unnest(p) AS part, generate_subscripts(p, 1) AS i, len(p) AS n FROM (
  SELECT query_id, regexp_extract_all(query_text, '\S+') AS p FROM text_queries WHERE shape <> 1)""",
    "runs": """
SELECT *, lower(part) = 'or' AS is_or, max(CASE WHEN lower(part) <> 'or' THEN i END) OVER (PARTITION BY query_id ORDER BY i) AS other FROM parts""",
    "joined": """
SELECT *, lag(op, 1, false) OVER (PARTITION BY query_id ORDER BY i) AS after_or, lead(op, 1, false) OVER (PARTITION BY query_id ORDER BY i) AS before_or
FROM (SELECT query_id, part, i, is_or AND i < n AND (i - coalesce(other, 0)) % 2 = CASE WHEN other IS NULL THEN 0 ELSE 1 END AS op FROM runs)""",
    "units": f"""
SELECT query_id, i, after_or, before_or, part LIKE '-_%' AS excluded, unnest(w) AS term, generate_subscripts(w, 1) AS j
FROM (SELECT *, {sql_tokens('part')} AS w FROM joined WHERE NOT op)""",
    "numbered": """
SELECT query_id, term, sum(starts) OVER (PARTITION BY query_id ORDER BY i, j) AS no FROM (
  SELECT *, CASE WHEN after_or AND i > min(i) OVER (PARTITION BY query_id) THEN 0 WHEN j = 1 OR NOT before_or THEN 1 ELSE 0 END AS starts
  FROM units WHERE NOT excluded)""",
    # slots of the same words are one
    "slots": """
SELECT DISTINCT query_id, 's:' || array_to_string(terms, '|') AS slot, unnest(terms) AS term FROM (
  SELECT query_id, no, list(DISTINCT term ORDER BY term) AS terms FROM numbered GROUP BY query_id, no)""",
    "asked": f"""
SELECT DISTINCT query_id, 'p' AS slot, term, false AS excluded FROM (SELECT query_id, unnest({sql_tokens('text')}) AS term FROM text_queries WHERE shape = 1)
UNION ALL SELECT query_id, slot, term, false FROM slots
UNION ALL SELECT DISTINCT query_id, 'n', term, true FROM units WHERE excluded""",
}
_HEAD = ("words", "postings", "text_queries")
SEARCH = {**{k: INDEX[k] for k in _HEAD}, **_READ, **{k: v for k, v in INDEX.items() if k not in (*_HEAD, "alternatives", "asked")}}


def ranked(k: int) -> str:
    return f"""
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER)
       AS rank FROM found QUALIFY rank <= {k}"""


_STORED: dict[tuple[str, str], ops.Index] = {}


def index_of(t):
    """The index as ingest would store it: written once per application and table folder, then read."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORED:
        _STORED[key] = ops.build_index(d.plain_texts(t)).write(scratch_path(t.spark, "index"))
    return _STORED[key]


@query("fts_index", d.with_("chunk_texts", """
SELECT term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS occurrences, min(chunk_id) AS first_chunk,
       CAST(sum(list_sum(positions)) AS BIGINT) AS position_sum
FROM postings GROUP BY term""", {k: INDEX[k] for k in ("words", "postings")}))
def fts_index(t):
    index = ops.build_index(d.plain_texts(t))
    counted = index.positions.groupBy("term").agg(
        F.count("*").alias("occurrences"), F.min("chunk_id").alias("first_chunk"), F.sum("pos").alias("position_sum"))
    return counted.join(index.vocabulary.withColumnRenamed("df", "chunks"), "term")


@query("fts_search", d.with_("chunk_texts", ranked(20), SEARCH))
def fts_search(t):
    return ops.fts_search(index_of(t), d.text_queries(t), 20)


_PHRASE = {**INDEX, "text_queries": """
SELECT item_id AS query_id, '"' || text || '"' AS query_text, 1 AS shape, text FROM benchmark"""}


@query("fts_phrase", d.with_("chunk_texts", "SELECT query_id, chunk_id, score FROM found", _PHRASE))
def fts_phrase(t):
    quoted = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.concat(F.lit('"'), "text", F.lit('"')).alias("query_text"))
    return ops.fts_search(index_of(t), quoted, None)


@query("fts_fallback", d.with_("chunk_texts", f"""
SELECT query_id, chunk_id, rank, CAST(0.5 AS DOUBLE) AS similarity FROM ({ranked(18)})""", SEARCH))
def fts_fallback(t):
    return ops.fts_fallback(index_of(t), d.text_queries(t))


def _padded(words: str) -> str:
    return f"' ' || array_to_string({words}, ' ') || ' '"


@query("fts_grammar", d.with_("chunk_texts", """
SELECT query_id, chunk_id FROM w, held WHERE CASE shape
  WHEN 0 THEN contains(held.t, ' ' || a || ' ') AND NOT contains(held.t, ' ' || b || ' ' || c || ' ')
  WHEN 1 THEN contains(held.t, ' ' || a || ' ' || b || ' ') OR contains(held.t, ' ' || c || ' ')
  WHEN 2 THEN NOT contains(held.t, ' ' || a || ' ')
  ELSE contains(held.t, ' ' || a || ' ') AND contains(held.t, ' ' || b || ' ') END""", {
    "w": f"""
SELECT item_id AS query_id, item_id % 4 AS shape, w[1] AS a, w[2] AS b, w[3] AS c FROM (
  SELECT item_id, {sql_tokens('text')} AS w FROM benchmark) WHERE len(w) > 2""",
    "held": f"SELECT chunk_id, {_padded('x')} AS t FROM (SELECT chunk_id, {sql_tokens('texto')} AS x FROM chunk_texts) WHERE len(x) > 0"}))
def fts_grammar(t):
    """Excluded phrases, a phrase or a word, exclusions only, and a literal bar, from the first words of each passage."""
    w = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4).alias("shape"), ops.tokens(F.col("text")).alias("w"))
    a, b, c = (F.get("w", i) for i in range(3))
    text = (F.when(F.col("shape") == 0, F.concat(a, F.lit(' -"'), b, F.lit(" "), c, F.lit('"')))
            .when(F.col("shape") == 1, F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('" or '), c))
            .when(F.col("shape") == 2, F.concat(F.lit("-"), a)).otherwise(F.concat(a, F.lit("|"), b)))
    asked = w.where("size(w) > 2").select("query_id", text.alias("query_text"))
    return ops.fts_search(index_of(t), asked, None).select("query_id", "chunk_id")


@query("ilike_search", d.with_("norms", """
SELECT doc_id, tipo, numero, titulo FROM norms
WHERE (lower(numero) LIKE '%tion%' OR lower(titulo) LIKE '%tion%' OR lower(tipo) LIKE '%tion%' OR lower(dominio) LIKE '%tion%'
       OR lower(organo_emisor) LIKE '%tion%') AND tipo IN ('LGUC', 'OGUC', 'LEY') AND vigente
ORDER BY tipo, numero, doc_id LIMIT 50 OFFSET 50"""))
def ilike_search(t):
    found = ops.ilike_search(
        d.norms(t), F.lit("TION"), ["numero", "titulo", "tipo", "dominio", "organo_emisor"],
        [F.asc("tipo"), F.asc("numero"), F.asc("doc_id")], types=["LGUC", "OGUC", "LEY"], valid=True, page=2)
    return found.select("doc_id", "tipo", "numero", "titulo")


@query("exact_term_detector", d.with_("questions", f"""
SELECT query_id, regexp_matches(texto, '(?i)art[íi]culo[s]?\\s+\\d+') OR regexp_matches(texto, '(?i)\\bart\\.\\s*\\d+')
  OR regexp_matches(texto, '(?i)\\b(DDU|LGUC|OGUC|DS|DFL|DL|Ley|Circular|Resolución|Res|Decreto)\\s*[-–]?\\s*\\d+')
  OR regexp_matches(texto, '(?i)\\bN[°º]\\s*\\d+') AS exact FROM questions"""))
def exact_term_detector(t):
    return d.questions(t).select("query_id", ops.has_exact_terms(F.col("texto")).alias("exact"))
