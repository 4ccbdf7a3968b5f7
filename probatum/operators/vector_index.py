"""Stored approximate vector index: k-means cells, product codes of the residuals, exact scores for the best.

An index is a folder of Parquet tables. ``rows`` holds every vector under the cell of its nearest centre, with a
code of one byte per few numbers; ``centres``, ``codebook`` and ``settings`` are small and of bounded size. A search
reads the codes of the probed cells only, then the vectors of the best candidates, whose similarities are exact.

Null vectors, vectors without length and vectors with parts that are not numbers are left out, as in ``vector_topk``;
vectors of different widths stop the job. An index of no vectors answers no query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import top_per
from .vectors import BLOCK_BYTES, QUERY_SLICE, Best, _blocks, _ids, _parts, _unit_rows, vector_topk

MAX_CELLS = 4096
"""Most cells of an index. Centres go to every task, so their number is bounded; cells grow instead."""

SAMPLE_ROWS = 20_000
"""Rows that centres, codebook and the number of probes are fitted on. All rows are indexed."""

FILE_ROWS = 500_000
"""Rows of one file of a cell: a cell with more is written by several tasks."""

WORDS = 256
PART_WIDTH = 4
ASKED_SAMPLE = 256
ROUNDING = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """An index as stored at ``path``, with its small tables in memory."""

    spark: SparkSession
    path: str
    id_type: str
    centres: np.ndarray
    codebook: list[np.ndarray]
    probes: int

    @property
    def rows(self) -> DataFrame:
        schema = f"chunk_id {self.id_type}, code binary, near double, embedding array<float>, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")


def build_index(
    chunks: DataFrame, path: str, k: int = 10, *, cells: int | None = None, target_recall: float = 0.95,
    sample_rows: int = SAMPLE_ROWS, part_width: int = PART_WIDTH, seed: int = 7,
) -> VectorIndex:
    """Fit an index for top-k searches and store all chunks ``(chunk_id, embedding)`` in it.

    Centres and codes are fitted on the ``sample_rows`` rows that are first by a hash of their id. ``cells`` is the
    square root of the number of rows unless given, at most ``MAX_CELLS``. The number of cells that a search probes is the
    smallest that finds ``target_recall`` of the sample's own neighbours. Rows of any number are then placed and coded
    where they are, and written once, large cells by several tasks.
    """
    spark = chunks.sparkSession
    pool = _vectors(chunks)
    id_type = dict(pool.dtypes)["chunk_id"]
    sample = materialise(pool.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows), "index-sample")
    total = pool.count()
    wanted = cells or math.isqrt(total)
    centres = _fit_centres(sample, max(1, min(wanted, MAX_CELLS)), seed)
    codebook = _fit_codebook(sample, centres, part_width, seed)
    probes = _fit_probes(sample, centres, k, target_recall)
    _store(spark, path, centres, codebook, probes, id_type)
    index = VectorIndex(spark, path, id_type, centres, codebook, probes)
    _write(index, pool, "overwrite")
    return index


def add_to_index(index: VectorIndex, chunks: DataFrame) -> None:
    """Place further chunks, with ids that the index does not hold yet, in the cells there are."""
    if not len(index.centres):
        raise ValueError("an index of no vectors has no cells: build it anew")
    _write(index, _vectors(chunks), "append")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index stored earlier."""
    settings = spark.read.parquet(f"{path}/settings").first()
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()
    words = spark.read.parquet(f"{path}/codebook").orderBy("part", "code").toPandas()
    codebook = [np.array(g["word"].tolist(), dtype=np.float32) for _, g in words.groupby("part")]
    held = np.array(centres["centre"].tolist(), dtype=np.float64) if len(centres) else np.empty((0, 0))
    return VectorIndex(spark, path, settings.id_type, held, codebook, settings.probes)


def search_index(
    index: VectorIndex, queries: DataFrame, k: int = 10, *, probes: int | None = None, candidates: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Approximate cosine top-k of every query: ``(query_id, chunk_id, similarity, rank)``, similarities exact.

    Queries go to the tasks in blocks of bounded size. A block reads the codes of the cells its queries probe, a task
    emits at most ``candidates`` (20 k) rows per query, and the vectors of the best of them are read and scored.
    """
    asked = _asked(queries)
    schema = f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {index.id_type}, similarity double"
    kept = candidates or 20 * k
    hits = index.spark.createDataFrame([], schema)
    # a task holds up to twice the candidates of a block's queries, each with its cell
    for block in _blocks(asked, _parts(asked, 2 * kept, block_bytes)) if len(index.centres) else ():
        ids, unit = _query_units(block, index.centres.shape[1])
        if not len(ids):
            continue
        probed = _probed(unit, index.centres, probes or index.probes)
        cells = np.flatnonzero(probed.any(axis=0)).tolist()
        rows = index.rows.where(F.col("cell").isin(cells))
        scan = _scan_codes(ids, unit, probed, index.centres, index.codebook, kept)
        rough = rows.select("chunk_id", "cell", "code").mapInArrow(scan, schema + ", cell int")
        best = top_per(rough, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], kept)
        chosen = materialise(best.select("query_id", "chunk_id", "cell"), "index-candidates")
        met = chosen.join(rows.select("chunk_id", "cell", "embedding"), ["cell", "chunk_id"])
        hits = hits.unionByName(met.select("query_id", "chunk_id", "embedding").mapInArrow(_score(ids, unit), schema))
    return top_per(hits, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def search_exact(index: VectorIndex, queries: DataFrame, k: int = 10, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact cosine top-k: the rows of ``vector_topk``, without the cells that cannot hold any of them.

    The approximate answer gives each query a kth similarity to beat. A cell is read if, for some query, the angle to its
    centre less the widest angle of its rows leaves room for that similarity; the cells left out hold no row of any answer.
    """
    if not len(index.centres):
        return search_index(index, queries, k, block_bytes=block_bytes)
    asked = _asked(queries)
    first = materialise(search_index(index, asked, k, block_bytes=block_bytes), "index-first")
    floors = first.groupBy("query_id").agg(F.min("similarity").alias("floor"), F.count("*").alias("n"))
    near = index.rows.groupBy("cell").agg(F.min("near").alias("near")).toPandas()
    reach = np.full(len(index.centres), -np.inf)
    reach[near["cell"].to_numpy(dtype=int)] = np.arccos(np.clip(near["near"].to_numpy(dtype=float), -1, 1))
    floored = asked.join(floors, "query_id", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0))
    needed = floored.select("query_id", "query_vector", "floor").mapInArrow(_cells_within(index.centres, reach), "cell int").distinct()
    cells = [r.cell for r in needed.collect()]
    return vector_topk(index.rows.where(F.col("cell").isin(cells)), asked, k, block_bytes=block_bytes)


def index_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact answers that were found: ``(query_id, expected, found, recall)``.

    An answer as similar as the last exact one counts, as ties may be told apart by rounding only.
    """
    last = exact.groupBy("query_id").agg(F.count("*").alias("expected"), F.min("similarity").alias("floor"))
    met = found.join(last, "query_id").where(F.col("similarity") >= F.col("floor")).groupBy("query_id").agg(F.count("*").alias("n"))
    return last.join(met, "query_id", "left").select(
        "query_id", "expected", F.least(F.coalesce("n", F.lit(0)), "expected").alias("found")).withColumn(
        "recall", F.col("found") / F.col("expected"))


# --- fitting ---------------------------------------------------------------------------------------

def _vectors(chunks: DataFrame) -> DataFrame:
    cells = F.transform("embedding", lambda x: x.cast("float"))
    usable = F.exists(cells, lambda x: x != 0) & F.forall(
        cells, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return chunks.select("chunk_id", cells.alias("embedding")).where(F.col("embedding").isNotNull() & usable)


def _fit_centres(sample: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Unit centres by k-means over the sample; fewer where the sample holds fewer different vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if sample.isEmpty():
        return np.empty((0, 0))
    points = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if cells == 1 or points.limit(2).count() < 2:
        mean, _ = _unit_rows(np.array([np.mean(_unit_rows(np.array([r.features for r in points.limit(1).collect()]))[0], axis=0)]))
        return mean
    model = KMeans(k=cells, seed=seed, maxIter=12, distanceMeasure="cosine").fit(points)
    unit, ok = _unit_rows(np.array(model.clusterCenters(), dtype=np.float64))
    return unit[ok]


def _fit_codebook(sample: DataFrame, centres: np.ndarray, part_width: int, seed: int) -> list[np.ndarray]:
    """Up to 256 words for each part of a residual, one task per part over the bounded sample."""
    if not len(centres):
        return []
    cuts = _cuts(centres.shape[1], part_width)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, cell = _placed(batch, centres)
                rest = unit - centres[cell]
                for no, (lo, hi) in enumerate(cuts):
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": np.int32(no), "x": list(rest[:, lo:hi])}), preserve_index=False)

    def words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _kmeans(np.array(pdf["x"].tolist(), dtype=np.float64), WORDS, seed)
        return pd.DataFrame({"part": np.int32(key[0]), "code": np.arange(len(found), dtype=np.int32), "word": list(found)})

    split = sample.mapInArrow(parts, "part int, x array<double>")
    found = split.groupBy("part").applyInPandas(words, "part int, code int, word array<double>").orderBy("part", "code").toPandas()
    return [np.array(g["word"].tolist(), dtype=np.float32) for _, g in found.groupby("part")]


def _kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Plain k-means on a bounded set of short vectors; starts from rows in their own order, so reruns agree."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(rounds if len(points) > k else 0):
        near = _nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = np.einsum("ij,ij->i", centres, centres) / 2
    return np.concatenate([np.argmax(points[i:i + 8192] @ centres.T - half, axis=1) for i in range(0, len(points), 8192)])


def _fit_probes(sample: DataFrame, centres: np.ndarray, k: int, target: float) -> int:
    """Cells to probe so that the sample's vectors find this share of their neighbours in the sample.

    The sample is thinner than the whole, so its neighbours lie further away and in more cells: the count errs to
    more probes.
    """
    if len(centres) < 2:
        return 1
    asked = sample.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(ASKED_SAMPLE).select(
        F.col("chunk_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    asked = materialise(asked, "index-asked")
    hits = vector_topk(sample, asked, k + 1).where("query_id <> chunk_id").select("query_id", "chunk_id")
    pairs = hits.join(asked, "query_id").join(sample, "chunk_id").select("query_vector", "embedding")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cell = _placed(batch, centres)
                near = _unit_rows(_matrix(batch.column("query_vector")))[0] @ centres.T
                place = (near > near[np.arange(len(cell)), cell][:, None]).sum(axis=1) + 1
                yield pa.RecordBatch.from_pydict({"place": pa.array(place.astype(np.int32))})

    counts = pairs.mapInArrow(places, "place int").groupBy("place").count().orderBy("place").toPandas()
    if counts.empty:
        return 1
    share = counts["count"].cumsum() / counts["count"].sum()
    return int(counts["place"][share >= target - 1e-9].iloc[0])


def _store(spark, path: str, centres: np.ndarray, codebook: list[np.ndarray], probes: int, id_type: str) -> None:
    def write(rows: list, schema: str, name: str) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    write([(i, v.tolist()) for i, v in enumerate(centres)], "cell int, centre array<double>", "centres")
    write([(p, i, v.tolist()) for p, part in enumerate(codebook) for i, v in enumerate(part)],
          "part int, code int, word array<float>", "codebook")
    write([(probes, id_type)], "probes int, id_type string", "settings")


def _write(index: VectorIndex, pool: DataFrame, mode: str) -> None:
    centres, codebook = index.centres, index.codebook

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                unit, cell = _placed(batch, centres)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), pa.array(_encode(unit - centres[cell], codebook), pa.binary()),
                     pa.array(np.einsum("ij,ij->i", unit, centres[cell])), batch.column("embedding"), pa.array(cell.astype(np.int32))],
                    ["chunk_id", "code", "near", "embedding", "cell"])

    schema = f"chunk_id {index.id_type}, code binary, near double, embedding array<float>, cell int"
    placed = materialise(pool.mapInArrow(place, schema), "index-placed")
    files = placed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
    spread = placed.join(F.broadcast(files), "cell").withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.col("files")))
    spread.repartition("cell", "slot").drop("files", "slot").select("chunk_id", "code", "near", "embedding", "cell").write.mode(
        mode).option("partitionOverwriteMode", "static").partitionBy("cell").parquet(f"{index.path}/rows")


# --- arrays in tasks -------------------------------------------------------------------------------

def _cuts(width: int, part_width: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + part_width, width)) for lo in range(0, width, part_width)]


def _matrix(cells: pa.Array) -> np.ndarray:
    wide = np.unique(cells.value_lengths().to_numpy(zero_copy_only=False))
    if len(wide) > 1:
        raise ValueError(f"vectors of different widths: {wide.tolist()}")
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1)


def _placed(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a batch and the cell of each: that of the most similar centre."""
    vectors = _matrix(batch.column("embedding"))
    if vectors.shape[1] != centres.shape[1]:
        raise ValueError(f"vectors of width {vectors.shape[1]} meet centres of width {centres.shape[1]}")
    unit, _ = _unit_rows(vectors)
    return unit, np.concatenate([np.argmax(unit[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(unit), 4096)])


def _encode(rest: np.ndarray, codebook: list[np.ndarray]) -> list[bytes]:
    codes, lo = np.empty((len(rest), len(codebook)), dtype=np.uint8), 0
    for no, words in enumerate(codebook):
        codes[:, no] = _nearest(rest[:, lo:lo + words.shape[1]], words.astype(np.float64))
        lo += words.shape[1]
    return [row.tobytes() for row in codes]


def _decode(codes: pa.Array, codebook: list[np.ndarray]) -> np.ndarray:
    held = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(codes), len(codebook))
    return np.concatenate([words[held[:, no]] for no, words in enumerate(codebook)], axis=1)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query_vector").where("query_vector IS NOT NULL")


def _query_units(block: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    wide = {len(v) for v in block["query_vector"]}
    if wide - {width}:
        raise ValueError(f"query vectors of width {sorted(wide)} meet an index of width {width}")
    unit, ok = _unit_rows(np.array(block["query_vector"].tolist(), dtype=np.float64).reshape(len(block), width))
    return block["query_id"].to_numpy()[ok], unit[ok]


def _probed(unit: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Which query probes which cell."""
    near = unit @ centres.T
    count = min(probes, len(centres))
    chosen = np.argpartition(-near, count - 1, axis=1)[:, :count]
    probed = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(probed, chosen, True, axis=1)
    return probed


def _scan_codes(ids, unit, probed, centres, codebook, kept: int):
    narrow = unit.astype(np.float32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), kept)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, chunk_ids = batch.column("cell").to_numpy(), _ids(batch)
            rest = _decode(batch.column("code"), codebook)
            for cell in np.unique(cells):
                at, wanted = np.flatnonzero(cells == cell), np.flatnonzero(probed[:, cell])
                for part in np.split(wanted, np.flatnonzero(np.diff(wanted // QUERY_SLICE)) + 1):
                    scores = (narrow[part] @ rest[at].T).astype(np.float64) + (unit[part] @ centres[cell])[:, None]
                    scores = np.round(scores, 6)
                    floor = best.floor[part]
                    if len(at) > kept:
                        floor = np.maximum(floor, np.partition(scores, -kept, axis=1)[:, -kept])
                    q, c = np.nonzero(scores >= floor[:, None])
                    best.offer(part[q], chunk_ids[at][c], scores[q, c], np.full(len(q), cell, np.int32))
        for query, found, score, cell in best.found():
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(ids[query]), "chunk_id": pa.array(found), "similarity": pa.array(score), "cell": pa.array(cell)})

    return scan


def _score(ids, unit):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {key: i for i, key in enumerate(ids.tolist())}
        for batch in batches:
            if batch.num_rows:
                asked = unit[[place[key] for key in batch.column("query_id").to_pylist()]]
                rows, _ = _unit_rows(_matrix(batch.column("embedding")))
                scores = pa.array(np.round(np.einsum("ij,ij->i", asked, rows), 6))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("chunk_id"), scores], ["query_id", "chunk_id", "similarity"])

    return score


def _cells_within(centres: np.ndarray, reach: np.ndarray):
    """Cells that may hold a row at least as similar as a query's floor; ``reach`` is each cell's widest angle."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = np.zeros(len(centres), dtype=bool)
        for batch in batches:
            if batch.num_rows:
                unit, ok = _unit_rows(_matrix(batch.column("query_vector")))
                angle = np.arccos(np.clip(unit @ centres.T, -1, 1)) - reach
                best = np.cos(np.clip(angle, 0, np.pi)) + ROUNDING
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                needed |= ((best >= floor[:, None]) & np.isfinite(reach) & ok[:, None]).any(axis=0)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.flatnonzero(needed).astype(np.int32))})

    return cells
