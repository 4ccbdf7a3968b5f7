"""Search by stems, ranked by how close the words of the query stand.

The index keeps the words of a chunk as written, in lower case, beside ``vocabulary (term, stem, df)``: each distinct term is stemmed once. A
query is stemmed the same way, and its stems are joined with the vocabulary, so that it asks for every form of each; the chunks themselves
are neither stemmed nor moved. Queries travel and are scanned as in :mod:`.fulltext`.

Ranking is cover density: a cover is an interval of a chunk that satisfies every slot of the query and holds no smaller one; each adds
``weight / (1 + noise)``, noise being the words of the cover that the query does not ask for. A chunk with more covers, and tighter ones, is
first. The covers of all chunks of a page come from one sweep over the ends of the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stem_terms
from ..session import materialise
from .fulltext import BLOCK_BYTES, Index, Page, Query, Search, _blocks, pages
from .ranking import top_per

WEIGHT = 0.1


def written_words(col: Column) -> Column:
    """Lower-case words in text order, letters as written."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def build_stemmed(chunks: DataFrame, text_col: str = "texto", stop_words: Sequence[str] = ()) -> Index:
    """Index of chunks ``(chunk_id, text)`` whose vocabulary has the stem of each term. Words and vocabulary are written, so that a text is cut
    once and searches do not stem again."""
    words = written_words(F.col(text_col))
    if stop_words:
        words = F.transform(words, lambda w: F.when(w.isin(*stop_words), F.lit("")).otherwise(w))
    plain = Index.of(materialise(chunks.select("chunk_id", words.alias("words")).where("size(words) > 0"), "stem-chunks"))
    return Index(plain.chunks, materialise(stem_terms(plain.vocabulary), "stems"), plain.stats)


def write_stemmed(index: Index, path: str) -> Index:
    """The index, stored at a place of its own."""
    for name in ("chunks", "vocabulary", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return Index.read(index.chunks.sparkSession, path)


class CoverSearch(Search):
    """A block of queries, their terms being stems, over the pages of one task."""

    def __init__(self, queries: list[Query], forms: dict[str, list[str]], k: int | None):
        super().__init__(queries, {}, 1.0, k)
        stems = self.asked.to_pylist()
        self.stems = len(stems)
        self.forms = pa.array([f for s in stems for f in forms.get(s, ())], pa.string())
        self.stem_of = np.array([i for i, s in enumerate(stems) for _ in forms.get(s, ())] + [-1], np.int64)

    def page(self, batch: pa.RecordBatch) -> Page:
        """The batch with the places of each asked stem, whatever its form."""
        page = Page(batch, self.forms)
        page.codes = self.stem_of[page.codes]
        order = np.argsort(page.codes, kind="stable")
        cut = np.searchsorted(page.codes[order], np.arange(self.stems + 1))
        page.places = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        page.known = {}
        return page

    def read(self, page: Page) -> None:
        for i, (query, (slots, without, _)) in enumerate(zip(self.queries, self.plans)):
            rows = np.arange(len(page.ids))
            if query.types is not None:
                rows = np.array([r for r in rows.tolist() if page.types[r] in query.types], np.int64)
            for slot in slots:
                rows = np.intersect1d(rows, np.unique(np.concatenate([page.holders(u) for u in slot])), assume_unique=True)
                if not len(rows):
                    break
            for unit in without:
                rows = np.setdiff1d(rows, page.holders(unit), assume_unique=True)
            if len(rows):
                self._keep(i, page.ids[rows], half_up(cover_density(page, slots)[rows]))


def occurrences(page: Page, unit: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(first place, last place) of each occurrence of a word or phrase."""
    first, code = min(unit, key=lambda u: len(page.places[u[1]]))
    last = unit[-1][0]
    start = page.places[code] - first
    start = start[(start >= 0) & (start + last < len(page.codes))]
    for j, other in unit:
        start = start[page.codes[start + j] == other]
    start = start[page.chunk_of[start] == page.chunk_of[start + last]]
    return start + unit[0][0], start + last


def half_up(score: np.ndarray) -> np.ndarray:
    """Six decimals, halves up as in Spark and SQL; sums are steadied first, so that their order does not tell halves apart."""
    return np.floor(np.round(score, 12) * 1e6 + 0.5) / 1e6


def cover_density(page: Page, slots: list[list[tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """The rank of every chunk of the page; zero where a slot is not met.

    For each place where an occurrence ends, the latest start per slot among the occurrences ended by then gives the interval's start; of the
    intervals with one start the first to end is a cover.
    """
    rank = np.zeros(len(page.ids))
    if not slots:
        return rank
    found = [[np.concatenate(x) for x in zip(*(occurrences(page, u) for u in slot))] for slot in slots]
    ends = np.unique(np.concatenate([end for _, end in found]))
    begin = np.full(len(ends), np.iinfo(np.int64).max)
    for start, end in found:
        order = np.argsort(end, kind="stable")
        latest = np.maximum.accumulate(start[order]) if len(start) else start
        at = np.searchsorted(end[order], ends, "right") - 1
        begin = np.minimum(begin, np.where(at >= 0, latest[np.maximum(at, 0)], -1) if len(start) else -1)
    whole = begin >= 0
    begin, ends = begin[whole], ends[whole]
    same = page.chunk_of[begin] == page.chunk_of[ends]
    begin, ends = begin[same], ends[same]
    tight = np.concatenate([[True], begin[1:] != begin[:-1]]) if len(begin) else np.empty(0, bool)
    begin, ends = begin[tight], ends[tight]
    codes = sorted({c for slot in slots for unit in slot for _, c in unit})
    entries = np.concatenate([[0], np.cumsum(np.isin(page.codes, codes))])
    noise = (ends - begin) - (entries[ends + 1] - entries[begin] - 1)
    return rank + np.bincount(page.chunk_of[begin], WEIGHT / (1 + noise), minlength=len(rank))


def _stemmed(spark: SparkSession, block: list[Query], vocabulary: DataFrame) -> dict[str, list[str]]:
    """Replace the terms of the block's queries by their stems; the forms of each stem in the vocabulary."""
    units = lambda q: [u for s in q.slots for u in s] + q.without
    terms = sorted({t for q in block for unit in units(q) for _, t in unit})
    if not terms:
        return {}
    stems = {r.term: r.stem for r in stem_terms(spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    for q in block:
        q.slots = [[tuple((j, stems[t]) for j, t in unit) for unit in slot] for slot in q.slots]
        q.without = [tuple((j, stems[t]) for j, t in unit) for unit in q.without]
    asked = spark.createDataFrame([(s,) for s in sorted(set(stems.values()))], "stem string")
    forms: dict[str, list[str]] = {}
    for r in vocabulary.join(F.broadcast(asked), "stem").select("stem", "term").collect():
        forms.setdefault(r.stem, []).append(r.term)
    return forms


def stem_search(index: Index, queries: DataFrame, k: int | None = 20, *, stop_words: Sequence[str] = (), within: DataFrame | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Chunks that hold, in any form, every slot of a query, with their cover density as ``score`` (and ``rank`` when ``k`` is given).

    ``queries``, ``within`` and ``types`` are as in :func:`.fulltext.fts_search`. A query of exclusions only finds everything else, with score 0.
    """
    spark = index.chunks.sparkSession
    pool = index.chunks if within is None else index.chunks.join(within, "chunk_id")
    kinds = {name: dict(df.dtypes)[name] for df, name in ((queries, "query_id"), (index.chunks, "chunk_id"))}
    out = None
    for block in _blocks(queries if within is not None else queries.drop("types"), stop_words, block_bytes, written_words):
        forms = _stemmed(spark, block, index.vocabulary)
        found = pool.mapInArrow(_scan_with(block, forms, k), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
        out = found if out is None else out.unionByName(found)
    return out if k is None else top_per(out, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _scan_with(block: list[Query], forms: dict[str, list[str]], k: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = CoverSearch(block, forms, k)

        def frames() -> Iterator[pd.DataFrame]:
            yield from search.found()
            search.best = [None] * len(block)

        for batch in batches:
            for page in pages(batch) if block else ():
                search.read(search.page(page))
                if k is None:
                    yield from (pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames())
        yield from (pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames())

    return scan
