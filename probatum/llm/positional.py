"""Benchmark decontamination with a distributed positional inverted index of the training tokens.

:func:`build_index` stores the index as a table: one row per shard of about ``shard_words`` words, holding the sorted terms
of the shard and, term by term, the positions at which they stand. Shards are what tasks read, so the index grows with the
corpus and is never moved. :func:`phrase_matches` and :func:`proximity_matches` answer many queries at once: a query takes the posting list of
its rarest term in the shard, shifted by the term's offset, and intersects it with the lists of its other terms from rare to
common; a term that the shard lacks ends it at once. Queries travel to the shards in blocks of at most ``block_bytes``.

:func:`decontaminate` cuts benchmark items into windows and reports what they cover of each document.

Terms are 64-bit hashes of words. A missing or empty text has no words: such documents are in the result with zeros, such
items match nothing. Rows that repeat a doc_id are separate documents; rows that repeat an item_id add up to one item; an
item without an id goes by the empty string.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import durable, id_of, key_of, numbered, text_bytes, text_mark, windows

# Bytes of words: a-z, 0-9 and everything beyond ASCII; A-Z are lower-cased, the rest separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard string, keys binary, marks binary, begins binary, terms binary, lists binary, positions binary"
ROOM = np.uint64(32)
BLOCK_BYTES = 8 << 20
SLICE_ROWS = 256


def term_hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """A hash of each term of each text, in order. Terms are cut by Arrow, and each distinct one is hashed once."""
    sizes, word, found = numbered([(t or "").encode().translate(LETTERS).decode() for t in texts])
    return np.split(pd.util.hash_array(found, categorize=False)[word], np.cumsum(sizes)[:-1])


def build_index(docs: DataFrame, shard_words: int = 1 << 20) -> DataFrame:
    """The index as a frame of shards; write it where it is to be kept."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), itertools.count()

        def shard(keys, marks, found):
            begins = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            flat = np.concatenate(found)
            positions = np.argsort(flat, kind="stable")
            flat = flat[positions]
            new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
            lists = np.append(new, len(flat)).astype(np.int64)
            return pd.DataFrame([(f"{task}-{next(made)}", np.array(keys, np.int64).tobytes(), np.array(marks, np.int64).tobytes(), begins.tobytes(), flat[new].tobytes(), lists.tobytes(),
                                  positions.astype(np.uint32).tobytes())], columns=["shard", "keys", "marks", "begins", "terms", "lists", "positions"])

        keys, marks, found, size = [], [], [], 0
        for rows in (frame.iloc[at:at + SLICE_ROWS] for frame in frames for at in range(0, len(frame), SLICE_ROWS)):
            for key, mark, terms in zip(rows["key"].tolist(), rows["mark"].tolist(), term_hashes(rows["text"])):
                keys.append(key)
                marks.append(mark)
                found.append(terms)
                size += len(terms)
                if size >= shard_words:
                    yield shard(keys, marks, found)
                    keys, marks, found, size = [], [], [], 0
        if keys:
            yield shard(keys, marks, found)

    return docs.select(key_of().alias("key"), text_mark().alias("mark"), "text").mapInPandas(build, INDEX)


class Shard:
    """One row of the index, read for searching."""

    def __init__(self, row):
        self.name = row.shard
        self.keys, self.marks, self.begins = (np.frombuffer(x, np.int64) for x in (row.keys, row.marks, row.begins))
        self.terms, self.lists = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.lists, np.int64)
        self.positions = np.frombuffer(row.positions, np.uint32).astype(np.uint64)
        rank = np.repeat(np.arange(len(self.terms), dtype=np.uint64), np.diff(self.lists))
        self.all = (rank << ROOM) | self.positions  # every posting, by term and position

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the shard, -1 where it lacks them."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        want = (rank.astype(np.uint64) << ROOM) | position.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.all, want), len(self.all) - 1)
        return self.all[at] == want

    def following(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first place at or after each position where each term stands, or -1."""
        want = (rank.astype(np.uint64) << ROOM) | position.astype(np.uint64)
        at = np.searchsorted(self.all, want)
        inside = at < self.lists[rank + 1]
        return np.where(inside, self.positions[np.minimum(at, len(self.positions) - 1)].astype(np.int64), -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, "right") - 1

    def _postings(self, query: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) for every posting of each query's term."""
        size = self.lists[rank + 1] - self.lists[rank]
        who = np.repeat(query, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.lists[rank], size)
        return who, self.positions[at].astype(np.int64)

    def phrases(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, start) of every exact occurrence; ``queries``: rows of terms, all of one length."""
        width = queries.shape[1]
        rank = self.ranks(queries)
        alive = np.flatnonzero((rank >= 0).all(axis=1))
        rank = rank[alive]
        size = self.lists[rank + 1] - self.lists[rank]
        order = np.argsort(size, axis=1, kind="stable")
        row = np.arange(len(alive))
        who, start = self._postings(row, rank[row, order[:, 0]])
        start = start - order[who, 0]
        fits = start >= 0
        fits &= start + width <= self.begins[-1]
        fits[fits] = self.document(start[fits]) == self.document(start[fits] + width - 1)
        who, start = who[fits], start[fits]
        for i in range(1, width):
            offset = order[who, i]
            there = self.holds(rank[who, offset], start + offset)
            who, start = who[there], start[there]
        return alive[who], start

    def near(self, queries: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, start, end) where the terms follow each other in order within ``slop`` words more than the query has."""
        width = queries.shape[1]
        rank = self.ranks(queries)
        alive = np.flatnonzero((rank >= 0).all(axis=1))
        rank = rank[alive]
        size = self.lists[rank + 1] - self.lists[rank]
        rarest = np.argmin(size, axis=1) if len(alive) else np.empty(0, np.int64)
        who, start = self._postings(np.arange(len(alive)), rank[:, 0])
        some = self.following(rank[who, rarest[who]], start)
        close = (some >= 0) & (some < start + width + slop)
        who, start = who[close], start[close]
        end = start.copy()
        for i in range(1, width):
            end = self.following(rank[who, i], end + 1)
            close = (end >= 0) & (end < start + width + slop)
            who, start, end = who[close], start[close], end[close]
        same = self.document(start) == self.document(end)
        return alive[who[same]], start[same], end[same] + 1


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[pd.DataFrame]:
    """The items, a block of bounded size at a time."""
    parts = -(-max(text_bytes(items), 1) // block_bytes)
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    for i in range(parts):
        yield named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).toPandas()


def _cut(block: pd.DataFrame, size: int | None) -> list[tuple[np.ndarray, list[list[str]]]]:
    """Distinct queries of a block by length: (rows of terms, the items of each row). ``size``: cut into windows of so many words."""
    by_length = {}
    for item, h in zip(block["item_id"], term_hashes(block["text"]) if len(block) else ()):
        if not len(h):
            continue
        width = len(h) if size is None else min(size, len(h))
        rows = np.lib.stride_tricks.sliding_window_view(h, width)
        known = by_length.setdefault(width, {})
        for mark, row in zip(windows(h, width).tolist(), rows):
            known.setdefault(mark, (row, set()))[1].add(item)
    return [(np.array([row for row, _ in known.values()]), [sorted(names) for _, names in known.values()]) for known in by_length.values()]


def _search(index: DataFrame, items: DataFrame, size: int | None, slop: int | None, block_bytes: int) -> DataFrame:
    """Per document of the index and block of items: covered spans and the items found."""
    schema = "shard string, place long, key long, mark long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    out = None
    for block in _blocks(items, block_bytes):
        queries = _cut(block, size)

        def search(frames, queries=queries):
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield _found(Shard(row), queries, slop)

        found = index.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _found(shard: Shard, queries, slop: int | None) -> pd.DataFrame:
    total = int(shard.begins[-1])
    cover = np.zeros(total + 1, np.int64)
    names: dict[int, set[str]] = {}
    for rows, items in queries:
        if slop is None:
            who, start = shard.phrases(rows)
            end = start + rows.shape[1]
        else:
            who, start, end = shard.near(rows, slop)
        np.add.at(cover, start, 1)
        np.add.at(cover, end, -1)
        pairs = np.unique(np.stack([shard.document(start), who]), axis=1) if len(start) else np.empty((2, 0), np.int64)
        for doc, query in zip(*pairs.tolist()):
            names.setdefault(doc, set()).update(items[query])
    hit = np.cumsum(cover[:-1]) > 0
    hit_at = np.concatenate([[0], np.cumsum(hit)])
    out = []
    for place, (key, mark) in enumerate(zip(shard.keys.tolist(), shard.marks.tolist())):
        a, b = int(shard.begins[place]), int(shard.begins[place + 1])
        spans = []
        if hit_at[b] > hit_at[a]:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))).tolist()
            spans = list(zip(edge[::2], edge[1::2]))
        out.append((shard.name, place, key, mark, b - a, spans, sorted(names.get(place, ()))))
    return pd.DataFrame(out, columns=["shard", "place", "key", "mark", "n_words", "spans", "items"])


def _merged(found: DataFrame) -> DataFrame:
    """One row per document over all blocks of items, with the number of words covered."""
    whole = found.groupBy("shard", "place").agg(
        F.first("key").alias("key"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    nothing = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate("spans", nothing, lambda x, s: F.struct(
        (x["hit"] + F.greatest(s["end"] - F.greatest(s["start"], x["end"]), F.lit(0))).alias("hit"),
        F.greatest(x["end"], s["end"]).alias("end")), lambda x: x["hit"])
    return whole.select(id_of().alias("doc_id"), "mark", "n_words", hit.alias("n_hit"), "spans", "items")


def phrase_matches(index: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole items found word for word: (doc_id, mark, n_words, n_hit, spans, items) per document."""
    return _merged(_search(index, items, None, None, block_bytes))


def proximity_matches(index: DataFrame, items: DataFrame, slop: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Items whose words follow each other in order with at most ``slop`` other words between them, in all."""
    return _merged(_search(index, items, None, slop, block_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES,
                  shard_words: int = 1 << 20) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, spans, items, contaminated) per document, by windows of ``size`` words of the benchmark.

    A document is contaminated if at least one in ``share`` of its words is covered. The index is kept in the shared
    folder, and each block of the benchmark reads it once.
    """
    index = durable(build_index(docs, shard_words), "positional-index")
    found = _merged(_search(index, benchmark, size, None, block_bytes))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
