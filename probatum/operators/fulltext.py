"""Full-text search over a stored index, many queries at once.

The index has one row per chunk, its folded words in order, beside ``vocabulary (term, df)`` and one row of ``stats``.
Queries go to the tasks in blocks of bounded size, and each block scans the rows in place: a task finds the rarest slot of a
query among its chunks, intersects the others, tests phrases on the words themselves, and emits at most k complete
matches per query. Nothing else is shuffled, and a word that every chunk holds costs no more than its scan. Ranking is
BM25 in closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import any_match
from ..functions.text import tokens
from ..lookups.patterns import EXACT_TERMS
from .ranking import top_per

K1, B = 1.2, 0.75
BLOCK_BYTES = 16 << 20
"""Query text that goes to every task at once."""

PAGE_WORDS = 1 << 18
"""Words that a task lays out at once: a batch of long chunks is read in several pages."""


@dataclass
class Index:
    """Words of a set of chunks ``(chunk_id, words array)``, with the number of chunks per term and in all.

    A stop word leaves an empty place, so that phrases keep their distances.
    """

    chunks: DataFrame
    vocabulary: DataFrame
    stats: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame) -> Index:
        stats = chunks.agg(F.count("*").alias("chunks"), F.avg(F.size("words")).alias("mean_terms"))
        return cls(chunks, cls._terms(chunks).groupBy("term").agg(F.count("*").alias("df")), stats)

    @staticmethod
    def _terms(chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", F.explode(F.array_distinct("words")).alias("term")).where("term <> ''")

    @property
    def terms(self) -> DataFrame:
        """Every term of every chunk once: ``(chunk_id, term)``."""
        return self._terms(self.chunks)

    @property
    def positions(self) -> DataFrame:
        """Every word where it stands: ``(chunk_id, term, pos)``."""
        return self.chunks.select("chunk_id", F.posexplode("words").alias("pos", "term")).where("term <> ''")

    def write(self, path: str) -> Index:
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        stored = Index.of(spark.read.parquet(f"{path}/chunks"))
        stored.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        stored.stats.write.mode("overwrite").parquet(f"{path}/stats")
        return Index.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vocabulary", "stats")])


def build_index(chunks: DataFrame, text_col: str = "texto", stop_words: Sequence[str] = ()) -> Index:
    """Index of chunks ``(chunk_id, text)``, worked out where they lie. Chunks without words are not in it."""
    words = tokens(F.col(text_col))
    if stop_words:
        words = F.transform(words, lambda w: F.when(w.isin(*stop_words), F.lit("")).otherwise(w))
    return Index.of(chunks.select("chunk_id", words.alias("words")).where("size(words) > 0"))


Unit = tuple[tuple[int, str], ...]
"""A word or a phrase: its terms with their distances from the first."""


@dataclass
class Query:
    """What a search text asks for: every slot by one of its units, and none of ``without``."""

    query_id: object
    slots: list[list[Unit]] = field(default_factory=list)
    without: list[Unit] = field(default_factory=list)
    types: set | None = None

    @property
    def terms(self) -> list[str]:
        """The terms that score, each once."""
        return list(dict.fromkeys(term for slot in self.slots for unit in slot for _, term in unit))


def _is_or(parts: Sequence[str], i: int) -> bool:
    """Whether a part that follows another stands between two."""
    return i + 1 < len(parts) and parts[i].lower() == "or"


def read_query(query_id, parts: Sequence[str], folded: Sequence[Sequence[str]], stop_words: Sequence[str] = (), types=None) -> Query:
    """A search text, already cut into its parts with the folded words of each, in one pass.

    Words are required; ``"a b"`` is a phrase whose words must be adjacent; ``a or b`` asks for either side, words and
    phrases alike, and binds tighter than the blank; ``-`` before a word or phrase excludes it. An ``or`` without a part on
    its left or right is a word. A text of exclusions only finds everything else.
    """
    query, either, left = Query(query_id, types=types), False, False
    for i, (part, found) in enumerate(zip(parts, folded)):
        if left and _is_or(parts, i):
            either, left = bool(query.slots), False
            continue
        left = True
        negated = part.startswith("-") and len(part) > 1
        quoted = part.lstrip("-").startswith('"') and part.endswith('"')
        terms = [(j, term) for j, term in enumerate(found) if term not in stop_words]
        units: list[Unit] = [tuple(terms)] if quoted and terms else [((0, term),) for _, term in terms]
        if units and negated:
            query.without += units
        elif units and either:
            query.slots[-1] += units
        elif units and _is_or(parts, i + 1):
            query.slots.append(units)
        else:
            query.slots += [[unit] for unit in units]
        either = False
    return query


def _blocks(queries: DataFrame, stop_words: Sequence[str], block_bytes: int, words: Callable[[Column], Column] = tokens) -> Iterator[list[Query]]:
    """The queries, read, a block of bounded size at a time; ``words`` cuts their parts as the index was cut."""
    parts = max(1, -(-(queries.agg(F.sum(F.octet_length("query_text"))).first()[0] or 0) // block_bytes))
    cut = F.regexp_extract_all("query_text", F.lit(r'(-?"[^"]*"|\S+)'), F.lit(1))
    columns = ["query_id", cut.alias("parts"), F.transform(cut, words).alias("folded")] + (["types"] if "types" in queries.columns else [])
    for i in range(parts):
        rows = queries.where(F.col("query_text").isNotNull() & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).select(*columns).collect()
        found = [read_query(r.query_id, r.parts, r.folded, stop_words, set(r.types) if "types" in queries.columns else None) for r in rows]
        yield [q for q in found if q.slots or q.without]


class Page:
    """The words of a batch of chunks, with the places of each term that some query asks for."""

    def __init__(self, batch: pa.RecordBatch, asked: pa.Array):
        self.ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
        if self.ids.dtype == object:
            self.ids = np.array(self.ids.tolist())
        lists = batch.column("words")
        self.sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.chunk_of = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.codes = pc.fill_null(pc.index_in(lists.flatten(), asked), -1).to_numpy(zero_copy_only=False)
        order = np.argsort(self.codes, kind="stable")
        cut = np.searchsorted(self.codes[order], np.arange(len(asked) + 1))
        self.places = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.types = batch.column("type").to_pylist() if "type" in batch.schema.names else None
        self.known: dict = {}

    def holders(self, unit: tuple[tuple[int, int], ...]) -> np.ndarray:
        """Chunks that hold a unit, ascending."""
        if unit not in self.known:
            first, code = min(unit, key=lambda u: len(self.places[u[1]]))
            start = self.places[code] - first
            start = start[(start >= 0) & (start + unit[-1][0] < len(self.codes))]
            for j, other in unit:
                start = start[self.codes[start + j] == other]
            self.known[unit] = np.unique(self.chunk_of[start][self.chunk_of[start] == self.chunk_of[start + unit[-1][0]]])
        return self.known[unit]

    def counts(self, code: int, rows: np.ndarray) -> np.ndarray:
        """How often each of some chunks holds a term."""
        if code not in self.known:
            self.known[code] = np.unique(self.chunk_of[self.places[code]], return_counts=True)
        held, times = self.known[code]
        if not len(held):
            return np.zeros(len(rows), np.int64)
        at = np.minimum(np.searchsorted(held, rows), len(held) - 1)
        return np.where(held[at] == rows, times[at], 0)


def pages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded words, of one chunk at least."""
    ends = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAGE_WORDS, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Search:
    """A block of queries over the pages of one task: the best k matches of each so far."""

    def __init__(self, queries: list[Query], weights: dict[str, float], mean: float, k: int | None):
        self.queries, self.mean, self.k = queries, mean, k
        terms = list(dict.fromkeys(t for q in queries for unit in [*(u for s in q.slots for u in s), *q.without] for _, t in unit))
        self.asked, code = pa.array(terms, pa.string()), {t: i for i, t in enumerate(terms)}
        coded = lambda unit: tuple((j, code[t]) for j, t in unit)
        self.plans = [([[coded(u) for u in s] for s in q.slots], [coded(u) for u in q.without], [(code[t], weights.get(t, 0.0)) for t in q.terms])
                      for q in queries]
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)

    def read(self, page: Page) -> None:
        for i, (query, (slots, without, terms)) in enumerate(zip(self.queries, self.plans)):
            rows = np.arange(len(page.ids))
            if query.types is not None:
                rows = np.array([r for r in rows.tolist() if page.types[r] in query.types], np.int64)
            for slot in sorted(slots, key=lambda s: sum(min(len(page.places[c]) for _, c in u) for u in s)):
                found = [page.holders(u) for u in slot]
                rows = np.intersect1d(rows, found[0] if len(found) == 1 else np.unique(np.concatenate(found)), assume_unique=True)
                if not len(rows):
                    break
            for unit in without:
                rows = np.setdiff1d(rows, page.holders(unit), assume_unique=True)
            if len(rows):
                score = np.zeros(len(rows))
                for code, weight in terms:
                    tf = page.counts(code, rows)
                    score += weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * page.sizes[rows] / self.mean))
                self._keep(i, page.ids[rows], np.round(score, 6))

    def _keep(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        if self.best[i] is not None:
            ids, score = np.concatenate([self.best[i][0], ids]), np.concatenate([self.best[i][1], score])
        if self.k is not None and len(ids) > self.k:
            first = np.lexsort((ids, -score))[: self.k]
            ids, score = ids[first], score[first]
        self.best[i] = ids, score

    def found(self) -> Iterator[pd.DataFrame]:
        for query, best in zip(self.queries, self.best):
            if best is not None:
                yield pd.DataFrame({"query_id": query.query_id, "chunk_id": best[0], "score": best[1]})


def fts_search(
    index: Index, queries: DataFrame, k: int | None = 20, *, stop_words: Sequence[str] = (), within: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Chunks matching every slot of a query, with BM25 ``score`` (and ``rank`` when ``k`` is given).

    ``within`` restricts the search to some chunks ``(chunk_id)``; with a column ``type`` there, a query with an array
    ``types`` sees only chunks of those types.
    """
    pool = index.chunks if within is None else index.chunks.join(within, "chunk_id")
    kinds = {name: dict(df.dtypes)[name] for df, name in ((queries, "query_id"), (index.chunks, "chunk_id"))}
    total, mean = index.stats.select("chunks", "mean_terms").first()
    out = None
    for block in _blocks(queries if within is not None else queries.drop("types"), stop_words, block_bytes):
        found = pool.mapInArrow(_scan_with(block, _weights(index, block, total), mean or 1.0, k), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
        out = found if out is None else out.unionByName(found)
    if k is None:
        return out
    return top_per(out, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _weights(index: Index, block: list[Query], total: int) -> dict[str, float]:
    """The rarity of the block's terms."""
    terms = sorted({t for q in block for t in q.terms})
    if not terms:
        return {}
    asked = index.vocabulary.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return {r.term: float(np.log(1 + (total - r.df + 0.5) / (r.df + 0.5))) for r in index.vocabulary.join(asked, "term").collect()}


def _scan_with(block: list[Query], weights: dict[str, float], mean: float, k: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(block, weights, mean, k)
        for batch in batches:
            for page in pages(batch) if block else ():
                search.read(Page(page, search.asked))
                if k is None:
                    for frame in search.found():
                        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
                    search.best = [None] * len(block)
        if k is not None:
            for frame in search.found():
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return scan


def fts_fallback(index: Index, queries: DataFrame, k: int = 18) -> DataFrame:
    """Search used when no vectors are at hand: same matches in rank order, a constant similarity of 0.5."""
    return fts_search(index, queries, k).withColumn("similarity", F.lit(0.5)).drop("score")


def ilike_search(
    rows: DataFrame, needle: Column, columns: Sequence[str], order: Sequence[Column], *, types: Sequence[str] | None = None,
    valid: bool | None = None, page: int | None = None, page_size: int = 50,
) -> DataFrame:
    """Rows in which any of the columns holds the needle, ignoring case; optionally one page of them."""
    wanted = F.lower(needle)
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), wanted)
    found = rows.where(hit)
    if types is not None:
        found = found.where(F.col("tipo").isin(*types))
    if valid is not None:
        found = found.where(F.col("vigente") == valid)
    if page is not None:
        found = found.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return found


def has_exact_terms(text: Column) -> Column:
    """True if the text names an article, a numbered norm or a number."""
    return any_match(text, EXACT_TERMS)
