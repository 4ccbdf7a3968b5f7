"""The registered queries of the training-data operators, one per operator, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatum.llm.common import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_length(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


@register("op4_suffix_array_dedup")
def op4(spark, sf_dir):
    from probatum.llm.suffix_index import dedup_suffixes
    return dedup_suffixes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", span_length("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@register("op6_substring_dedup")
def op6(spark, sf_dir):
    from probatum.llm.lempel_ziv import dedup_substrings
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", span_length("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    from probatum.llm.positional import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op2_quality_classifier")
def op2(spark, sf_dir):
    from probatum.llm.nbsvm import judge
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@register("op5_url_filters")
def op5(spark, sf_dir):
    from probatum.llm.url_rules import judge_urls
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
             length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper FROM w),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
c AS (SELECT doc_id, sum(least(coalesce(nxt - i, 8), 8)) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r WHERE n > 1) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))
            OR (n_lines > 1 AND 100 * n_dup_lines > 50 * n_lines) OR (n_letters > 0 AND 100 * n_upper > 60 * n_letters)
            OR 10 * n_marks > 5 * n_words OR 100 * n_letters < 40 * word_chars) AS kept
FROM f"""


@register("op7_quality_rules", OP7_SQL)
def op7(spark, sf_dir):
    from probatum.llm.rule_ledger import apply_policy, ledger, mask_of
    book = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed").bitwiseAND(F.lit(mask_of("base"))) != 0).alias("base_failed"), "kept")



@register("op9_mixing_sources")
def op9(spark, sf_dir):
    from probatum.llm.mixing import plan_mixture
    return plan_mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op10_html_extraction")
def op10(spark, sf_dir):
    from probatum.llm.template import extract_articles
    return extract_articles(table(spark, sf_dir, "pages"))


@register("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    from probatum.llm.ngram_join import join_documents
    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op3_lm_scoring")
def op3(spark, sf_dir):
    from probatum.llm.lm_scoring import score_texts
    return score_texts(table(spark, sf_dir, "documents"))


@register("op11_token_alignment")
def op11(spark, sf_dir):
    from probatum.llm.token_alignment import align_documents
    return align_documents(table(spark, sf_dir, "documents"))[0]


@register("op12_minhash_near_dedup")
def op12(spark, sf_dir):
    from probatum.llm.minhash_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.a = s.a WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@register("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    from probatum.llm.hard_negatives import mine_negatives, shifted_labels
    return mine_negatives(shifted_labels(table(spark, sf_dir, "embeddings")))
