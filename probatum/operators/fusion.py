"""Fusion of ranked lists, layered candidates, rerank, forced chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups.norms import HIERARCHY
from .ranking import top_per

RRF_OFFSET = 60
ABSENT_RANK = 100
MAX_CHUNKS = 18
MAX_CANDIDATES = 50


def hybrid_rrf(vector_hits: DataFrame, text_hits: DataFrame, k: int = 16, weight: float = 0.7) -> DataFrame:
    """Weighted reciprocal ranks of two top-40 lists; a chunk missing from one list counts as rank 100 there."""
    both = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("rv")).join(
        text_hits.select("query_id", "chunk_id", F.col("rank").alias("rf")), ["query_id", "chunk_id"], "full_outer")

    def part(share: float, rank: str) -> Column:
        return F.lit(share) / (RRF_OFFSET + F.coalesce(F.col(rank), F.lit(ABSENT_RANK)))

    scored = both.withColumn("similarity", F.round(part(weight, "rv") + part(1 - weight, "rf"), 9))
    return top_per(scored.drop("rv", "rf"), ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def hybrid_weighted(vector_hits: DataFrame, text_hits: DataFrame, k: int = 10, weight: float = 0.7) -> DataFrame:
    """Weighted sum of similarity and text score (squashed into 0..1); a missing side counts as 0.

    Give lists of 3k rows per query. The sum is rounded as SQL rounds a double, by its multiple of a million: a similarity of six
    places times a weight often ends in 5, and rounding its decimal digits instead parts from that.
    """
    squashed = F.col("score") / (F.col("score") + 1)
    both = vector_hits.select("query_id", "chunk_id", F.col("similarity").alias("vs")).join(
        text_hits.select("query_id", "chunk_id", squashed.alias("fs")), ["query_id", "chunk_id"], "full_outer")
    total = F.coalesce("vs", F.lit(0.0)) * weight + F.coalesce("fs", F.lit(0.0)) * (1 - weight)
    scored = both.withColumn("similarity", F.round(total * 1_000_000) / 1_000_000).drop("vs", "fs")
    return top_per(scored, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def hybrid_or_vector(hybrid_hits: DataFrame, vector_hits: DataFrame, exact: DataFrame) -> DataFrame:
    """Hybrid rows for queries with exact terms that have any; pure vector rows for all other queries.

    exact ``(query_id, exact boolean)``; both hit frames ``(query_id, chunk_id, similarity, rank)``.
    """
    columns = ["query_id", "chunk_id", "similarity", "rank"]
    chosen = hybrid_hits.join(exact.where("exact"), "query_id", "left_semi").select(*columns)
    rest = vector_hits.join(chosen.select("query_id").distinct(), "query_id", "left_anti").select(*columns)
    return chosen.withColumn("source", F.lit("hybrid")).unionByName(rest.withColumn("source", F.lit("vector")))


def rrf_fusion(lists: DataFrame, k: int | Column) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, list_no, chunk_id, rank from 1)`` with optional ``similarity``.

    The first list that holds a chunk supplies its payload (``first_list``). Sorted on the unrounded score.
    """
    scored = lists.groupBy("query_id", "chunk_id").agg(
        F.sum(1 / (RRF_OFFSET + F.col("rank"))).alias("raw"), F.min("list_no").alias("first_list"))
    steady = scored.withColumn("raw", F.round("raw", 12))
    top = top_per(steady, ["query_id"], [F.desc("raw"), F.asc("chunk_id")], k)
    return top.withColumn("similarity", F.round("raw", 3)).drop("raw")


def multi_query(variant_hits: DataFrame, k: int = 20) -> DataFrame:
    """Fuse the searches of a query and its variants.

    variant_hits ``(query_id, list_no, chunk_id, rank, lists)`` with ``lists`` the number of searches of the
    query; each contributes its first ``max(ceil(k / lists) + 5, 10)`` rows.
    """
    share = F.greatest(F.ceil(F.lit(k) / F.col("lists")) + 5, F.lit(10))
    return rrf_fusion(variant_hits.where(F.col("rank") <= share), k)


def usable_variants(variants: DataFrame, limit: int = 3) -> DataFrame:
    """Variants of a length between 11 and 499, at most three per query in order."""
    fit = variants.where(F.length(F.trim("variant_text")).between(11, 499))
    return top_per(fit, ["query_id"], [F.asc("variant_no")], limit, "list_no")


def layered_candidates(layers: Sequence[DataFrame], cap: int = MAX_CANDIDATES) -> DataFrame:
    """Concatenate ranked layers, keep the first occurrence of a chunk, cut at ``cap`` per query."""
    stacked = reduce(DataFrame.unionByName, [
        layer.select("query_id", "chunk_id", "similarity", "rank", F.lit(no).alias("layer"))
        for no, layer in enumerate(layers, start=1)])
    place = F.struct("layer", "rank")
    first = stacked.groupBy("query_id", "chunk_id").agg(
        F.min(place).alias("place"), F.min_by("similarity", place).alias("similarity"))
    flat = first.select("query_id", "chunk_id", "similarity", "place.layer", F.col("place.rank").alias("layer_rank"))
    return top_per(flat, ["query_id"], [F.asc("layer"), F.asc("layer_rank"), F.asc("chunk_id")], cap)


def rerank_scores(candidates: DataFrame, scores: DataFrame, k: int = MAX_CHUNKS) -> DataFrame:
    """Replace the similarity by an external relevance score (3 decimals) and keep the best."""
    scored = candidates.drop("rank", "similarity").join(scores, ["query_id", "chunk_id"])
    top = top_per(scored, ["query_id"], [F.desc("relevance"), F.asc("chunk_id")], k)
    return top.withColumn("similarity", F.round("relevance", 3)).drop("relevance")


def hierarchy_index(col: Column) -> Column:
    """Place in the hierarchy from 0; unknown or missing counts as the last."""
    place = F.array_position(F.array(*[F.lit(h) for h in HIERARCHY]), col)
    return F.when(place > 0, place - 1).otherwise(len(HIERARCHY) - 1).cast("int")


def rerank_hierarchy(candidates: DataFrame, k: int = MAX_CHUNKS) -> DataFrame:
    """Order without a relevance model: hierarchy first, then similarity."""
    placed = candidates.drop("rank").withColumn("hierarchy", hierarchy_index(F.col("jerarquia_norm")))
    return top_per(placed, ["query_id"], [F.asc("hierarchy"), F.desc("similarity"), F.asc("chunk_id")], k)


def present_terms(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words of the chunks that each query met, ``chunks (chunk_id, words)``: only those chunks are taken apart."""
    met = hits.select("query_id", "chunk_id").join(chunks, "chunk_id")
    return met.select("query_id", F.explode(F.array_distinct("words")).alias("term")).where("term <> ''").distinct()


def missing_terms(query_words: DataFrame, chunk_words: DataFrame, limit: int = 3) -> DataFrame:
    """Query terms found in none of the query's chunks, as gap searches ``(query_id, gap_no, term)``."""
    gaps = query_words.select("query_id", "term").distinct().join(chunk_words, ["query_id", "term"], "left_anti")
    return top_per(gaps, ["query_id"], [F.asc("term")], limit, "gap_no")


def gap_expand(first_round: DataFrame, gap_hits: DataFrame, cap: int = 20, least: int = 3) -> DataFrame:
    """Add chunks found for the gaps after those of the first round, up to ``cap``.

    Queries with fewer than ``least`` rows, or without gap rows, keep their first round as it is.
    """
    sizes = first_round.groupBy("query_id").agg(F.count("*").alias("n"))
    widened = sizes.where(F.col("n") >= least).join(gap_hits.select("query_id").distinct(), "query_id", "left_semi")
    base = first_round.select("query_id", "chunk_id", F.lit(0).alias("gap_no"), F.col("rank").alias("r"))
    extra = (
        gap_hits.join(widened.select("query_id"), "query_id", "left_semi")
        .join(first_round.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        .groupBy("query_id", "chunk_id").agg(F.min(F.struct("gap_no", "rank")).alias("place"))
        .select("query_id", "chunk_id", "place.gap_no", F.col("place.rank").alias("r"))
    )
    limit = F.when(F.col("cut"), F.lit(cap)).otherwise(F.lit(2**31 - 1))
    marked = base.unionByName(extra).join(widened.select("query_id", F.lit(True).alias("cut")), "query_id", "left")
    return top_per(marked.withColumn("cut", F.coalesce("cut", F.lit(False))), ["query_id"],
                   [F.asc("gap_no"), F.asc("r"), F.asc("chunk_id")], limit).drop("cut", "r")


def forced_chunks(keys: DataFrame, norms: DataFrame, chunks: DataFrame, per_norm: int = 3) -> DataFrame:
    """First chunks of the documents that active rules demand: keys ``(query_id, norm_key)``.

    ``TYPE-NUMBER`` names one document, a bare ``TYPE`` the first document of that type.
    """
    wanted = keys.select("norm_key").distinct().select(
        "norm_key", F.split("norm_key", "-", 2)[0].alias("tipo"),
        F.try_element_at(F.split("norm_key", "-", 2), F.lit(2)).alias("wanted_number"))
    # the first document of each number and of each type is taken before any key meets it: a type has few rows then
    by_number = norms.groupBy("tipo", F.col("numero").alias("wanted_number")).agg(F.min("doc_id").alias("doc_id")).join(
        wanted.where("wanted_number IS NOT NULL"), ["tipo", "wanted_number"]).select("norm_key", "doc_id")
    by_type = norms.groupBy("tipo").agg(F.min("doc_id").alias("doc_id")).join(
        wanted.where("wanted_number IS NULL"), "tipo").select("norm_key", "doc_id")
    chosen = by_number.unionByName(by_type)
    opening = chunks.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    first = top_per(opening, ["doc_id"], [F.asc("orden"), F.asc("chunk_id")], per_norm, "place")
    return (
        keys.join(chosen, "norm_key").join(first.select("doc_id", "chunk_id", "place"), "doc_id")
        .select("query_id", "norm_key", "doc_id", "chunk_id", "place", F.lit(1.0).alias("similarity"))
    )


def merge_forced_first(forced: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Forced chunks ahead of the retrieved ones, without repeats and without a new cut."""
    head = forced.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct("norm_key", "place")).alias("p"), F.max("similarity").alias("similarity")
    ).select("query_id", "chunk_id", "similarity", F.lit(0).alias("part"), "p.norm_key", F.col("p.place").alias("pos"))
    rest = retrieved.join(head, ["query_id", "chunk_id"], "left_anti").select(
        "query_id", "chunk_id", "similarity", F.lit(1).alias("part"), F.lit("").alias("norm_key"),
        F.col("rank").alias("pos"))
    both = head.unionByName(rest)
    return top_per(both, ["query_id"], [F.asc("part"), F.asc("norm_key"), F.asc("pos"), F.asc("chunk_id")],
                   2**31 - 1).select("query_id", "chunk_id", "similarity", (F.col("part") == 0).alias("forced"), "rank")
