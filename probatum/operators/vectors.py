"""Vector search: exact cosine top-k, semantic cache, hashed-bucket candidates, text vectors.

Frames: chunks ``(chunk_id, embedding array<float>)``, queries ``(query_id, query_vector array<double>)``; ids are numbers or
strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import tokens
from ..session import materialise
from .ranking import top_per

BLOCK_BYTES = 32 << 20
"""Query vectors that go to every task at once."""

HELD_BYTES = 96 << 20
"""Best rows that a task holds for the queries of a block."""

QUERY_SLICE = 256


class Best:
    """The best k rows of each query so far, higher scores first and ties by id, with further columns if given.

    Rows lie in plain arrays per slice of queries, and a slice is cut back to k rows per query once it holds twice as many:
    the whole stays within twice the rows to be returned.
    """

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(0, queries, QUERY_SLICE)]
        self.floor = np.full(queries, -np.inf)

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        """Rows for queries of one slice, by their numbers."""
        if len(query):
            no = int(query[0]) // QUERY_SLICE
            self.rows[no].append((query.astype(np.int32), ids, score, *more))
            if sum(len(r[0]) for r in self.rows[no]) > 2 * self.k * QUERY_SLICE:
                self._cut(no)

    def _cut(self, no: int) -> None:
        columns = [np.concatenate(c) for c in zip(*self.rows[no])]
        order = np.lexsort((columns[1], -columns[2], columns[0]))
        query = columns[0][order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.rows[no] = [tuple(c[order[place < self.k]] for c in columns)]
        last = place == self.k - 1
        self.floor[query[last]] = columns[2][order[last]]

    def found(self) -> Iterator[tuple[np.ndarray, ...]]:
        for no, rows in enumerate(self.rows):
            if rows:
                self._cut(no)
                yield self.rows[no][0]


@dataclass
class QueryBlock:
    """A bounded set of query vectors with their optional restrictions, as arrays."""

    ids: np.ndarray
    unit: np.ndarray
    types: list | None = None
    times: np.ndarray | None = None
    k: int = 10
    min_similarity: float | None = None
    max_age_ms: int | None = None
    best: Best | None = field(default=None)

    @classmethod
    def build(cls, pdf: pd.DataFrame, **settings) -> QueryBlock:
        widths = {len(v) for v in pdf["query_vector"]}
        if len(widths) > 1:
            raise ValueError(f"query vectors of different widths: {sorted(widths)}")
        matrix = np.array(pdf["query_vector"].tolist(), dtype=np.float64)
        unit, ok = _unit_rows(matrix)
        same: dict[frozenset, frozenset] = {}
        return cls(
            ids=pdf["query_id"].to_numpy()[ok],
            unit=unit[ok],
            types=[same.setdefault(t, t) for t in map(frozenset, pdf["types"][ok])] if "types" in pdf else None,
            times=pdf["query_ms"].to_numpy()[ok] if "query_ms" in pdf else None,
            **settings,
        )

    def offer(self, ids: np.ndarray, unit: np.ndarray, types=None, times=None) -> None:
        """Score a batch of chunks and keep, per query, the best k seen so far (ties by id)."""
        if self.best is None:
            self.best = Best(len(self.ids), self.k)
        for lo in range(0, len(self.ids), QUERY_SLICE):
            part = slice(lo, lo + QUERY_SLICE)
            scores = np.round(self.unit[part] @ unit.T, 6)
            if self.types is not None:
                names, codes = np.unique(np.asarray(types, dtype=str), return_inverse=True)
                allowed = np.array([[name in wanted for name in names] for wanted in self.types[part]])
                scores[~allowed[:, codes]] = -np.inf
            if self.times is not None:
                age = self.times[part][:, None] - times[None, :]
                scores[(age < 0) | (age >= self.max_age_ms)] = -np.inf
            if self.min_similarity is not None:
                scores[scores < self.min_similarity] = -np.inf
            floor = self.best.floor[part]
            if scores.shape[1] > self.k and not np.isfinite(floor).all():
                floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
            q, c = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
            self.best.offer(q + lo, ids[c], scores[q, c])


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    ok = length > 0
    return matrix / np.where(ok, length, 1.0)[:, None], ok


def vector_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    type_col: str | None = None,
    chunk_ms: str | None = None,
    max_age_ms: int | None = None,
    min_similarity: float | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact cosine top-k of every query: ``(query_id, chunk_id, similarity, rank)``.

    With ``type_col`` a query only sees chunks whose type is in its ``types`` array; with ``chunk_ms``
    only chunks younger than ``max_age_ms`` at its ``query_ms``. Chunks without a vector are skipped.

    Queries are taken in blocks of at most ``block_bytes`` and of at most ``HELD_BYTES`` of rows to be kept, and every block scans the chunks in place, without a
    shuffle: each task emits at most k rows per query of the block. One block or many is the same plan, once per
    block. Chunks whose vectors are not as wide as the queries' stop the job with an error.
    """
    columns = [F.col("chunk_id"), F.transform("embedding", lambda x: x.cast("float")).alias("embedding")]
    if type_col:
        columns.append(F.col(type_col).alias("type"))
    if chunk_ms:
        columns.append(F.col(chunk_ms).alias("ms"))
    pool = chunks.where("embedding IS NOT NULL").select(*columns)
    settings = {"k": k, "min_similarity": min_similarity, "max_age_ms": max_age_ms}
    wanted = [c for c in ("query_id", "query_vector", "types", "query_ms") if c in queries.columns]
    asked = queries.select(*wanted).where("query_vector IS NOT NULL")

    schema = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {dict(pool.dtypes)['chunk_id']}, similarity double"
    parts = _parts(asked, k, block_bytes)
    if parts > 1:
        # read once per block: neither is worked out again for each
        pool, asked = materialise(pool, "vector-pool"), materialise(asked, "vector-queries")
    hits = None
    for block in _blocks(asked, parts):
        found = pool.mapInArrow(_scan_with(QueryBlock.build(block, **settings) if len(block) else None), schema)
        hits = found if hits is None else hits.unionByName(found)
    return top_per(hits, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def _parts(asked: DataFrame, k: int, block_bytes: int) -> int:
    """Blocks so that neither the query vectors nor the rows kept for them outgrow a task."""
    rows, width = asked.agg(F.count("*"), F.max(F.size("query_vector"))).first()
    return max(1, -(-rows * 8 * (width or 1) // block_bytes), -(-rows * 24 * k // HELD_BYTES))


def _blocks(asked: DataFrame, parts: int) -> Iterator[pd.DataFrame]:
    """The queries, a block of bounded size at a time."""
    for i in range(parts):
        yield asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toPandas()


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
    return np.array(ids.tolist()) if ids.dtype == object else ids


def _offer_table(block: QueryBlock, batch) -> None:
    ids = _ids(batch)
    cells = batch.column("embedding")
    wide = np.unique(cells.value_lengths().to_numpy(zero_copy_only=False))
    if (wide != block.unit.shape[1]).any():
        raise ValueError(f"chunk vectors of width {wide.tolist()} meet query vectors of width {block.unit.shape[1]}")
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    unit, ok = _unit_rows(flat.reshape(len(ids), -1))
    names = batch.schema.names
    types = batch.column("type").fill_null("").to_numpy(zero_copy_only=False)[ok] if "type" in names else None
    times = batch.column("ms").to_numpy(zero_copy_only=False)[ok] if "ms" in names else None
    block.offer(ids[ok], unit[ok], types, times)


def _scan_with(asked: QueryBlock | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None if asked is None else replace(asked, best=None)
        for batch in batches:
            if block is not None and batch.num_rows:
                _offer_table(block, batch)
        if block is not None and block.best is not None:
            for query, ids, score in block.best.found():
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(block.ids[query]), "chunk_id": pa.array(ids), "similarity": pa.array(score)})

    return scan


def hyde_combine(pairs: DataFrame) -> DataFrame:
    """Query vector and hypothetical-answer vector to one unit vector."""
    return pairs.withColumn("query_vector", V.blend(F.col("query_vector"), F.col("hyde_vector"))).drop("hyde_vector")


def semantic_cache_lookup(
    cache: DataFrame, queries: DataFrame, min_similarity: float = 0.97, max_age_hours: int = 168
) -> DataFrame:
    """Best cached answer of the same mode that is young and close enough, at most one per query.

    cache ``(cache_id, mode, embedding, created_ms)``, queries ``(query_id, mode, query_vector, query_ms)``.
    """
    hits = vector_topk(
        cache.withColumnRenamed("cache_id", "chunk_id"),
        queries.withColumn("types", F.array("mode")),
        k=1,
        type_col="mode",
        chunk_ms="created_ms",
        max_age_ms=max_age_hours * 3_600_000,
        min_similarity=min_similarity,
    )
    return hits.select("query_id", F.col("chunk_id").alias("cache_id"), "similarity")


def cache_hit_update(cache: DataFrame, served: DataFrame) -> DataFrame:
    """Cache rows with the hits of this batch added: served ``(cache_id, query_ms)``."""
    counts = served.groupBy("cache_id").agg(F.count("*").alias("new_hits"), F.max("query_ms").alias("new_last"))
    return (
        cache.join(counts, "cache_id", "left")
        .withColumn("hits", F.col("hits") + F.coalesce("new_hits", F.lit(0)))
        .withColumn("last_hit_ms", F.greatest("last_hit_ms", "new_last"))
        .drop("new_hits", "new_last")
    )


def cache_admission(answered: DataFrame, min_chars: int = 100, max_query_chars: int = 500) -> DataFrame:
    """Answers fit for the cache: long enough, first turn of a chat, no active gate rule.

    answered ``(query_id, query_text, answer, single_turn boolean, rule_active boolean)``.
    """
    fit = (F.length("answer") > min_chars) & F.col("single_turn") & ~F.col("rule_active")
    return answered.where(fit).select(
        "query_id", F.substring("query_text", 1, max_query_chars).alias("cached_query"), "answer")


def cache_ttl_evict(cache: DataFrame, as_of_ms, max_age_hours: int = 168) -> DataFrame:
    """Cache rows still visible at a moment."""
    return cache.where(F.col("created_ms") > as_of_ms - max_age_hours * 3_600_000)


def vector_ann_lsh(
    chunks: DataFrame, queries: DataFrame, k: int = 10, tables: int = 8, bucket_length: float = 0.6, seed: int = 7
) -> DataFrame:
    """Approximate top-k: chunks that share a projection bucket with the query, scored exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(df: DataFrame, key: str, source: str) -> DataFrame:
        return df.where(F.col(source).isNotNull()).select(
            key, array_to_vector(V.scale_to_unit(F.col(source))).alias("unit"))

    left, right = unit(queries, "query_id", "query_vector"), unit(chunks, "chunk_id", "embedding")
    model = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=bucket_length, seed=seed
    ).fit(right)

    def buckets(df: DataFrame, key: str) -> DataFrame:
        hashed = model.transform(df).select(key, F.posexplode("hashes").alias("table", "h"))
        return hashed.select(key, "table", vector_to_array("h")[0].cast("long").alias("bucket"))

    pairs = buckets(left, "query_id").join(buckets(right, "chunk_id"), ["table", "bucket"])
    candidates = pairs.select("query_id", "chunk_id").distinct()
    scored = (
        candidates.join(left.select("query_id", vector_to_array("unit").alias("q")), "query_id")
        .join(right.select("chunk_id", vector_to_array("unit").alias("c")), "chunk_id")
        .select("query_id", "chunk_id", F.round(V.dot(F.col("q"), F.col("c")), 6).alias("similarity"))
    )
    return top_per(scored, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def embed_text(chunks: DataFrame, width: int = 1024, text_col: str = "texto") -> DataFrame:
    """Hashed term weights of each chunk as a unit vector ``embedding`` of fixed width."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = chunks.withColumn("words", tokens(F.col(text_col)))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=width).transform(words)
    weighted = IDF(inputCol="tf", outputCol="weighted").fit(counted).transform(counted)
    unit = Normalizer(inputCol="weighted", outputCol="unit").transform(weighted)
    return unit.withColumn("embedding", vector_to_array("unit")).drop("words", "tf", "weighted", "unit")


def embed_with(chunks: DataFrame, model, batch_size: int = 128, text_col: str = "texto") -> DataFrame:
    """Vectors from a user's model: ``model(list of texts) -> list of vectors``, called per batch in each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors: list = []
            for lo in range(0, len(pdf), batch_size):
                vectors.extend(list(map(float, v)) for v in model(pdf[text_col].iloc[lo:lo + batch_size].tolist()))
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": vectors})

    return chunks.select("chunk_id", text_col).mapInPandas(run, "chunk_id long, embedding array<double>")
