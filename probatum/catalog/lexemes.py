"""Queries by stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming as st
from ..operators import lexemes as ops
from . import derived as d
from .registry import query

_V, _C = f"[{st.VOWELS}]", f"[^{st.VOWELS}]"


def _region(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(w, '{pattern}') THEN length(regexp_extract(w, '{pattern}')) ELSE length(w) END"


def _end(word: str, suffixes: str) -> str:
    return f"regexp_extract({word}, '({suffixes})$', 1)"


def _cut(word: str, tail: str) -> str:
    return f"left({word}, length({word}) - length({tail}))"


def _drop(word: str, suffixes: str, region: str = "r2") -> str:
    tail = _end(word, suffixes)
    return f"CASE WHEN length({tail}) > 0 AND length({word}) - length({tail}) >= {region} THEN {_cut(word, tail)} ELSE {word} END"


_PLAIN = f"translate({{}}, '{st.ACUTE}', '{st.PLAIN}')"
_VERB, _CUT = _end("base", st.any_of(st.BEFORE_PRONOUN)), _cut("base", _end("base", st.any_of(st.BEFORE_PRONOUN)))
_RULES = dict(st.STANDARD)
_SHORT = ", ".join(f"'{s}'" for s in st.SHORT_VERBS.split())
#: The rules as steps over ``terms (term)``; the last is ``stems (term, stem)``.
STEMS = {
    "s0": f"""
SELECT term, w, {_region(f'^{_C}*{_V}+{_C}')} AS r1, {_region(f'^{_C}*{_V}+{_C}+{_V}+{_C}')} AS r2,
       CASE WHEN regexp_matches(w, '^.{_C}') THEN {_region(f'^.{_C}+{_V}')} WHEN regexp_matches(w, '^{_V}{_V}') THEN {_region(f'^{_V}{_V}+{_C}')}
            ELSE least(3, length(w)) END AS rv FROM (SELECT term, lower(term) AS w FROM terms)""",
    "s1": f"SELECT *, {_cut('w', 'p')} AS base FROM (SELECT *, {_end('w', st.any_of(st.PRONOUNS))} AS p FROM s0)",
    "s2": f"""
SELECT term, r1, r2, rv, CASE WHEN p <> '' AND {_VERB} <> '' AND length({_CUT}) >= rv THEN {_CUT} || {_PLAIN.format(_VERB)}
       WHEN p <> '' AND base LIKE '%uyendo' AND length(base) - 5 >= rv THEN base ELSE w END AS w FROM s1""",
    "s3": f"SELECT *, {_cut('w', 't')} AS rest FROM (SELECT *, {_end('w', '|'.join(_RULES.values()))} AS t FROM s2)",
    "s4": f"""
SELECT *, CASE WHEN t = '' THEN NULL
  WHEN t = 'amente' AND length(rest) >= r1 THEN CASE WHEN rest LIKE '%iv' AND length(rest) - 2 >= r2 THEN {_drop("left(rest, length(rest) - 2)", 'at')}
                                                ELSE {_drop('rest', 'os|ic|ad')} END
  WHEN t = 'amente' OR length(rest) < r2 THEN NULL
  {' '.join(f"WHEN regexp_full_match(t, '{_RULES[k]}') THEN {v}" for k, v in (
      ('plain', 'rest'), ('agent', _drop('rest', 'ic')), ('logia', "rest || 'log'"), ('ucion', "rest || 'u'"), ('encia', "rest || 'ente'"),
      ('mente', _drop('rest', 'ante|able|ible')), ('idad', _drop('rest', 'abil|ic|iv'))))}
  ELSE {_drop('rest', 'at')} END AS standard FROM s3""",
    "s5": f"""
SELECT *, {_end('substr(w, rv + 1)', st.any_of(st.Y_VERBS))} AS y, {_end('substr(w, rv + 1)', st.any_of(st.SHORT_VERBS + ' ' + st.VERBS))} AS v FROM s4""",
    "s6": f"""
SELECT term, rv, coalesce(standard, CASE WHEN y <> '' AND {_cut('w', 'y')} LIKE '%u' THEN {_cut('w', 'y')}
       WHEN v IN ({_SHORT}) AND {_cut('w', 'v')} LIKE '%gu' THEN left(w, length(w) - length(v) - 1) ELSE {_cut('w', 'v')} END) AS w FROM s5""",
    "stems": f"""
SELECT term, {_PLAIN.format("CASE WHEN t IN ('e', 'é') AND rest LIKE '%gu' AND length(rest) - 1 >= rv THEN left(rest, length(rest) - 1) ELSE rest END")} AS stem
FROM (SELECT *, {_cut('w', 't')} AS rest FROM (SELECT *, {_end('substr(w, rv + 1)', 'os|a|o|á|í|ó|e|é')} AS t FROM s6))""",
}


def _words(col: str) -> str:
    return rf"list_filter(string_split_regex(lower({col}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


PLACES = {
    "places": f"""
SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT chunk_id, {_words('texto')} AS w FROM chunk_texts)""",
    "three": f"""
SELECT item_id AS query_id, item_id % 4 AS shape, w[1] AS a, w[2] AS b, w[3] AS c FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 2""",
    "terms": "SELECT DISTINCT term FROM places UNION SELECT unnest([a, b, c]) FROM three",
    **STEMS,
    "held": "SELECT chunk_id, stem, pos FROM places JOIN stems USING (term)",
    "wanted": """
SELECT query_id, shape, x.stem AS a, y.stem AS b, z.stem AS c FROM three JOIN stems x ON x.term = a JOIN stems y ON y.term = b JOIN stems z ON z.term = c""",
    # occurrences of each slot: shape 0 asks for a and b, 1 for "a b" and c, 2 for a or b, 3 for a without c
    "hits": """
SELECT DISTINCT query_id, chunk_id, 1 AS slot, pos AS s, pos AS e FROM wanted JOIN held ON stem = a WHERE shape IN (0, 3)
UNION SELECT query_id, chunk_id, 2, pos, pos FROM wanted JOIN held ON stem = b WHERE shape = 0
UNION SELECT query_id, h.chunk_id, 1, h.pos, g.pos FROM wanted JOIN held h ON h.stem = a JOIN held g ON g.stem = b AND g.chunk_id = h.chunk_id AND g.pos = h.pos + 1 WHERE shape = 1
UNION SELECT query_id, chunk_id, 2, pos, pos FROM wanted JOIN held ON stem = c WHERE shape = 1
UNION SELECT query_id, chunk_id, 1, pos, pos FROM wanted JOIN held ON stem IN (a, b) WHERE shape = 2""",
    "entries": """
SELECT DISTINCT query_id, chunk_id, pos FROM wanted JOIN held ON stem = a OR (stem = b AND shape < 3) OR (stem = c AND shape = 1)""",
    "reach": """
SELECT query_id, chunk_id, e, min(s) AS s FROM (
  SELECT x.query_id, x.chunk_id, x.e, y.slot, max(y.s) AS s FROM (SELECT DISTINCT query_id, chunk_id, e FROM hits) x
  JOIN hits y ON y.query_id = x.query_id AND y.chunk_id = x.chunk_id AND y.e <= x.e GROUP BY ALL)
GROUP BY query_id, chunk_id, e HAVING count(*) = CASE WHEN query_id % 4 < 2 THEN 2 ELSE 1 END""",
    "covers": "SELECT query_id, chunk_id, s, min(e) AS e FROM reach GROUP BY query_id, chunk_id, s",
    "dense": """
SELECT query_id, chunk_id, round(round(sum(CAST(0.1 AS DOUBLE) / (1 + noise)), 12), 6) AS score FROM (
  SELECT c.query_id, c.chunk_id, c.s, c.e - c.s - (count(*) - 1) AS noise FROM covers c
  JOIN entries n ON n.query_id = c.query_id AND n.chunk_id = c.chunk_id AND n.pos BETWEEN c.s AND c.e GROUP BY c.query_id, c.chunk_id, c.s, c.e)
GROUP BY query_id, chunk_id""",
    "left_out": "SELECT query_id, chunk_id FROM wanted JOIN held ON stem = c WHERE shape = 3",
}

_STORED: dict = {}


def stemmed_index(t):
    """The index as ingest would store it: written once per application and table folder, then read."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORED:
        _STORED[key] = ops.build_stemmed(d.plain_texts(t))
    return _STORED[key]


def three_words(t):
    """Searches from the first words of each passage: both, a phrase and a word, either, one without another."""
    i = F.col("item_id")
    w = t.benchmark.select(i.alias("query_id"), (i % 4).alias("shape"), ops.written_words(F.col("text")).alias("w")).where("size(w) > 2")
    a, b, c = (F.get("w", n) for n in range(3))
    text = (F.when(F.col("shape") == 0, F.concat_ws(" ", a, b)).when(F.col("shape") == 1, F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('" '), c))
            .when(F.col("shape") == 2, F.concat(a, F.lit(" or "), b)).otherwise(F.concat(a, F.lit(" -"), c)))
    return w.select("query_id", text.alias("query_text"))


@query("stem_vocabulary", d.with_("chunk_texts", """
SELECT s.term, s.stem, count(DISTINCT p.chunk_id) AS df FROM places p JOIN stems s ON s.term = p.term GROUP BY s.term, s.stem""",
    {k: PLACES[k] for k in ("places", "three", "terms", *STEMS)}))
def stem_vocabulary(t):
    """Each distinct word of the corpus with its stem and in how many chunks it stands."""
    return stemmed_index(t).vocabulary.select("term", "stem", "df")


@query("fts_search_cover", d.with_("chunk_texts", """
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
FROM dense WHERE NOT EXISTS (SELECT 1 FROM left_out o WHERE o.query_id = dense.query_id AND o.chunk_id = dense.chunk_id) QUALIFY rank <= 20""", PLACES))
def fts_search_cover(t):
    """The best 20 chunks of each search by stems and closeness of the words."""
    return ops.stem_search(stemmed_index(t), three_words(t), 20)


@query("fts_stem_phrase", d.with_("chunk_texts", """
SELECT query_id, chunk_id, round(sum(CAST(0.1 AS DOUBLE)), 6) AS score FROM (
  SELECT query_id, h.chunk_id, h.pos FROM wanted JOIN held h ON h.stem = a JOIN held g ON g.stem = b AND g.chunk_id = h.chunk_id AND g.pos = h.pos + 1
  JOIN held f ON f.stem = c AND f.chunk_id = h.chunk_id AND f.pos = h.pos + 2)
GROUP BY query_id, chunk_id""", {k: v for k, v in PLACES.items() if k not in ("hits", "entries", "reach", "covers", "dense", "left_out")}))
def fts_stem_phrase(t):
    """All chunks that hold the first three words of a passage next to each other, in any form."""
    w = t.benchmark.select(F.col("item_id").alias("query_id"), ops.written_words(F.col("text")).alias("w")).where("size(w) > 2")
    quoted = w.select("query_id", F.concat(F.lit('"'), F.array_join(F.slice("w", 1, 3), " "), F.lit('"')).alias("query_text"))
    return ops.stem_search(stemmed_index(t), quoted, None)
