"""References between documents: extraction, resolution, edges, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import literal_array
from ..lookups.norms import REF_TYPES, TYPES_WITHOUT_NUMBER
from ..lookups.patterns import REF_LAW, REF_NORM
from .ranking import top_per


def normalise_type(raw: Column) -> Column:
    """Known document type in capitals, else null."""
    upper = F.upper(F.trim(raw))
    return F.when(F.array_contains(literal_array(REF_TYPES), upper), upper)


def normalise_number(raw: Column) -> Column:
    """Number without dots and leading zeros; unchanged if nothing would be left."""
    bare = F.regexp_replace(F.replace(raw, F.lit(".")), "^0+", "")
    return F.when(bare == "", raw).otherwise(bare)


def references_in(text: Column) -> Column:
    """Distinct ``(tipo, numero)`` named in a text."""
    named = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + REF_NORM), F.lit(0)), lambda hit: F.struct(
        F.regexp_extract(hit, "(?i)" + REF_NORM, 1).alias("t"), F.regexp_extract(hit, "(?i)" + REF_NORM, 2).alias("n")))
    laws = F.regexp_extract_all(text, F.lit("(?i)" + REF_LAW), F.lit(1))
    found = F.concat(
        F.transform(named, lambda r: F.struct(normalise_type(r["t"]).alias("tipo"), normalise_number(r["n"]).alias("numero"))),
        F.transform(laws, lambda n: F.struct(F.lit("LEY").alias("tipo"), normalise_number(n).alias("numero"))))
    return F.array_distinct(F.filter(found, lambda r: r["tipo"].isNotNull()))


def extract_references(chunks: DataFrame) -> DataFrame:
    """One row per chunk and reference; keeps the chunk's document and article."""
    return chunks.select("chunk_id", "doc_id", "articulo", F.explode(references_in(F.col("texto"))).alias("r")).select(
        "chunk_id", "doc_id", "articulo", "r.tipo", "r.numero")


def resolve_references(refs: DataFrame, norms: DataFrame) -> DataFrame:
    """Document each distinct reference means: ``(tipo, numero, target_id, tier)``.

    Exact type and number first; a type that needs no number then takes its first document; else a
    document of the type whose number contains the reference's. Containment is an equi-join on the
    substrings of the (short) numbers, not a comparison of all pairs.
    """
    asked = refs.select("tipo", "numero").distinct()
    place = F.struct("numero", "doc_id")
    exact = norms.groupBy("tipo", "numero").agg(F.min("doc_id").alias("exact_id"))
    by_type = norms.where(F.col("tipo").isin(*TYPES_WITHOUT_NUMBER)).groupBy("tipo").agg(F.min(place).alias("p")).select(
        "tipo", F.col("p.doc_id").alias("type_id"))
    size = F.length("numero")
    substrings = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda a: F.transform(
        F.sequence(F.lit(1), size - a + 1), lambda n: F.substring(F.lower("numero"), a, n))))
    inside = (
        norms.where((size > 0) & ~F.col("tipo").isin(*TYPES_WITHOUT_NUMBER))
        .select("tipo", "numero", "doc_id", F.explode(F.array_distinct(substrings)).alias("part"))
        .groupBy("tipo", "part").agg(F.min(place).alias("p"))
        .select("tipo", F.col("part").alias("key"), F.col("p.doc_id").alias("part_id")))
    tried = (
        asked.join(exact, ["tipo", "numero"], "left").join(by_type, "tipo", "left")
        .withColumn("key", F.lower("numero")).join(inside, ["tipo", "key"], "left"))
    tier = F.when(F.col("exact_id").isNotNull(), 1).when(F.col("type_id").isNotNull(), 2).when(F.col("part_id").isNotNull(), 3)
    return tried.select("tipo", "numero", F.coalesce("exact_id", "type_id", "part_id").alias("target_id"), tier.alias("tier")).where(
        "tier IS NOT NULL")


def build_edges(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Unverified ``remite_a`` edges, one per pair of documents; the first chunk gives the article."""
    hits = refs.join(resolved.select("tipo", "numero", "target_id"), ["tipo", "numero"]).where("doc_id <> target_id")
    first = hits.groupBy("doc_id", "target_id").agg(
        F.min_by("articulo", F.struct("chunk_id", "tipo", "numero")).alias("articulo"))
    return first.select(
        F.col("doc_id").alias("origen"), F.col("target_id").alias("destino"), F.lit("remite_a").alias("tipo_relacion"),
        F.when(F.col("articulo").isNotNull(), F.array("articulo")).otherwise(F.array().cast("array<string>")).alias("articulos"),
        F.lit(False).alias("verificado"))


def edge_stats(chunks: DataFrame, refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Counters of an edge build, as one row."""
    hits = refs.join(resolved.select("tipo", "numero", "target_id"), ["tipo", "numero"], "left")
    per_pair = hits.groupBy("doc_id", "target_id").agg(F.count("*").alias("n"))
    edge = F.col("target_id").isNotNull() & (F.col("doc_id") != F.col("target_id"))
    counted = per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("referencias"), F.count_if(edge).alias("insertadas"),
        F.coalesce(F.sum(F.when(edge, F.col("n") - 1)), F.lit(0)).alias("ya_existian"),
        F.coalesce(F.sum(F.when(F.col("target_id").isNull(), F.col("n"))), F.lit(0)).alias("sin_destino"))
    return counted.withColumn("chunks", chunks.select(F.count("*")).scalar())


def graph_enrich(
    evidence: DataFrame, norms: DataFrame, edges: DataFrame, limit: int = 20, verified_only: bool = True
) -> DataFrame:
    """Relations of the documents present in each query's evidence, with both endpoints.

    A document is present if its type and its number occur in the evidence (not necessarily together).
    Edges are found by two equi-joins, one per endpoint. As the order of relations is the same for all queries, each endpoint keeps
    its first ``limit`` edges before it meets them: a document that everything cites brings ``limit`` rows, not all.
    """
    numbers = evidence.select("query_id", "numero").distinct()
    types = evidence.select("query_id", "tipo").distinct()
    present = numbers.join(norms.select("doc_id", "tipo", "numero"), "numero").join(
        types, ["query_id", "tipo"], "left_semi").select("query_id", "doc_id").distinct()
    usable = edges.where("verificado") if verified_only else edges
    order = [F.asc("origen"), F.asc("destino"), F.asc("tipo_relacion")]
    slim = usable.select("origen", "destino", "tipo_relacion", "articulos").dropDuplicates(["origen", "destino", "tipo_relacion"])

    def first_of(end: str) -> DataFrame:
        return top_per(slim.withColumn("doc_id", F.col(end)), ["doc_id"], order, limit).drop("rank")

    touched = present.join(first_of("origen").unionByName(first_of("destino")), "doc_id").drop("doc_id").dropDuplicates(
        ["query_id", "origen", "destino", "tipo_relacion"])
    top = top_per(touched, ["query_id"], order, limit)
    source = norms.select(F.col("doc_id").alias("origen"), F.concat_ws(" ", "tipo", "numero").alias("norma_origen"))
    target = norms.select(F.col("doc_id").alias("destino"), F.concat_ws(" ", "tipo", "numero").alias("norma_destino"),
                          F.col("titulo").alias("titulo_destino"))
    return top.join(source, "origen").join(target, "destino").select(
        "query_id", "rank", "norma_origen", "norma_destino", "titulo_destino", "tipo_relacion", "articulos")


def graph_degree(edges: DataFrame) -> DataFrame:
    """Edges out of and into each document by relation type."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("origen").alias("doc_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("destino").alias("doc_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"), "tipo_relacion")
    return ends.groupBy("e.doc_id", "tipo_relacion").agg(F.sum("e.o").alias("salientes"), F.sum("e.i").alias("entrantes"))


def dependency_list(norms: DataFrame) -> DataFrame:
    """Edges from the declared dependencies (document numbers) of each document."""
    declared = norms.select(F.col("doc_id").alias("origen"), F.explode("dependencias").alias("numero"))
    targets = norms.select(F.col("doc_id").alias("destino"), "numero")
    return declared.join(targets, "numero").select("origen", "destino", "numero").distinct()


def seed_relations(seeds: DataFrame, norms: DataFrame, existing: DataFrame) -> DataFrame:
    """Verified edges between documents picked by selectors, without those that exist.

    seeds ``(origen_sel, destino_sel, tipo_relacion, descripcion, articulos array)``; a selector is ``tipo:X`` or ``numero:X``, and two
    ``tipo:`` selectors relate all pairs of their documents by design. Of several seeds for one edge the least description counts.
    """
    picked = norms.select("doc_id", F.explode(F.array(
        F.concat(F.lit("tipo:"), "tipo"), F.concat(F.lit("numero:"), "numero"))).alias("sel"))
    pairs = (
        seeds.join(picked.select(F.col("doc_id").alias("origen"), F.col("sel").alias("origen_sel")), "origen_sel")
        .join(picked.select(F.col("doc_id").alias("destino"), F.col("sel").alias("destino_sel")), "destino_sel"))
    key = ["origen", "destino", "tipo_relacion"]
    edges = pairs.groupBy(*key).agg(F.min(F.struct("descripcion", "articulos")).alias("e")).select(*key, "e.*", F.lit(True).alias("verificado"))
    return edges.join(existing.select(*key), key, "left_anti")
