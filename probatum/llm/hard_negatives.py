"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Vectors are stored in blocks; a block holds, for each dimension, its rows in order of that component. An anchor reads the lists from the end
that its own component's sign makes the better one, some rows of every list at a time, and scores rows that it meets for the first time at random
access, in integers. The anchor's components times the last ones read bound the score of every row not yet met. Reading stops once that bound is
strictly below what can still change a result: the kth best score so far, or the lower end of the window. Since ties go to the smaller id, a
bound that equals the kth score does not stop it. Bests go along from block to block within a task, so later blocks stop earlier.

First each anchor finds its positives, the best other rows of its label; then, for the window of scores that each positive sets, the best
rows of other labels. Anchors travel to the blocks in groups of at most ``anchor_bytes``; a task sends back k rows for each anchor and window.

A row with a null label, a null vector, or a null, infinite or NaN component takes no part. Vectors of unequal length are compared as if the
shorter ended in zeros. Rows that repeat a vec_id are separate rows; a row without vec_id is no anchor, and comes last among ties.
Components times 256 are 64-bit integers; scores that do not fit in 64 bits are not supported.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import LAST, durable, id_of, key_of

BLOCK_ROWS = 8192
BLOCK_BYTES = 4 << 20
ANCHOR_BYTES = 4 << 20
INDEX = "rows binary, keys binary, labels binary, width int, vectors binary, lists binary"
EXACT = 1 << 53


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(key, label, q) of the rows that take part: q the components times ``scale``, rounded down."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        key_of("vec_id").alias("key"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"))


def build_lists(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows (key, label, q) with a sorted list of places per dimension."""
    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = itertools.count(TaskContext.get().partitionId() << 40)
        held, size = [], 0

        def block() -> pd.DataFrame:
            width = max(len(q) for _, _, q in held)
            vectors = np.zeros((len(held), width), np.int64)
            for i, (_, _, q) in enumerate(held):
                vectors[i, :len(q)] = q
            lists = np.argsort(vectors, axis=0, kind="stable").T.astype(np.uint32)
            ids = np.fromiter(itertools.islice(first, len(held)), np.int64, len(held))
            return pd.DataFrame([(ids.tobytes(), np.array([k for k, _, _ in held], np.int64).tobytes(), np.array([x for _, x, _ in held], np.int64).tobytes(), width,
                                  vectors.tobytes(), lists.tobytes())], columns=[c.split()[0] for c in INDEX.split(", ")])

        for frame in frames:
            for row in zip(frame["key"].tolist(), frame["label"].tolist(), frame["q"]):
                held.append(row)
                size += 8 * len(row[2])
                if len(held) >= block_rows or size >= BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return rows.mapInPandas(build, INDEX)


class Anchors:
    """Some anchors: row ids, labels, vectors, and the windows of scores (lowest, highest) that their positives set."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]):
        self.rows, self.labels, self.vectors = rows, labels, vectors
        self.windows: list[list[tuple[int, int]]] = [[] for _ in rows]


class Lists:
    """A block, read for sorted and random access."""

    def __init__(self, rows, keys, labels, width, vectors, lists):
        self.rows, self.keys, self.labels = (np.frombuffer(x, np.int64) for x in (rows, keys, labels))
        self.vectors = np.frombuffer(vectors, np.int64).reshape(len(self.keys), width)
        self.lists = np.frombuffer(lists, np.uint32).reshape(width, len(self.keys))
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.fast = self.vectors.astype(np.float64)

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products; through doubles where no sum can leave their integers."""
        if self.largest * int(np.abs(anchor).sum()) < EXACT:
            return (self.fast[places] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[places] @ anchor

    def access(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(places met for the first time, their scores, bound of all others); the bound is None once no row is left."""
        n, width = len(self.keys), self.vectors.shape[1]
        anchor = np.concatenate([anchor[:width], np.zeros(max(width - len(anchor), 0), np.int64)])
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, at, step = np.zeros(n, bool), 0, max(n // 64, 16)
        while True:
            to = min(at + step, n) if len(up) + len(down) else n
            fresh = np.zeros(n, bool)
            if to == n:
                fresh[:] = True
            else:
                fresh[self.lists[up, n - to:n - at]] = True
                fresh[self.lists[down, at:to]] = True
            fresh &= ~met
            met |= fresh
            places = np.flatnonzero(fresh)
            if to == n or met.all():
                yield places, self.scores(places, anchor), None
                return
            last = sum(int(anchor[d]) * int(self.vectors[self.lists[d, n - to], d]) for d in up.tolist())
            last += sum(int(anchor[d]) * int(self.vectors[self.lists[d, to - 1], d]) for d in down.tolist())
            yield places, self.scores(places, anchor), last
            at, step = to, 2 * step


class Best:
    """The k best (score, key) so far: higher scores first, then smaller keys."""

    def __init__(self, k: int):
        self.k, self.score, self.key = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, key: np.ndarray) -> None:
        if len(self.score) == self.k:
            close = score >= self.score[-1]
            score, key = score[close], key[close]
        if len(score):
            score, key = np.concatenate([self.score, score]), np.concatenate([self.key, key])
            order = np.lexsort((key, -score))[:self.k]
            self.score, self.key = score[order], key[order]

    def settled(self, bound: int) -> bool:
        """Whether rows of at most ``bound`` cannot enter."""
        return len(self.score) == self.k and bound < int(self.score[-1])


def same_label(block: Lists, anchors: Anchors, i: int, best: list[Best]) -> None:
    """Positives of an anchor: the best other rows of its label."""
    for places, scores, bound in block.access(anchors.vectors[i]):
        fits = (block.labels[places] == anchors.labels[i]) & (block.rows[places] != anchors.rows[i])
        best[0].add(scores[fits], block.keys[places[fits]])
        if bound is None or best[0].settled(bound):
            return


def in_windows(block: Lists, anchors: Anchors, i: int, best: list[Best]) -> None:
    """Negatives of an anchor: for each window the best rows of other labels within it."""
    left = [w for w, (low, high) in enumerate(anchors.windows[i]) if low <= high]
    if not left:
        return
    for places, scores, bound in block.access(anchors.vectors[i]):
        other = block.labels[places] != anchors.labels[i]
        scores, keys = scores[other], block.keys[places[other]]
        for w in left:
            low, high = anchors.windows[i][w]
            inside = (scores >= low) & (scores <= high)
            best[w].add(scores[inside], keys[inside])
        if bound is None:
            return
        left = [w for w in left if bound >= anchors.windows[i][w][0] and not best[w].settled(bound)]
        if not left:
            return


def _search(index: DataFrame, held, search, k: int) -> DataFrame:
    """(anchor, window, score, key): the k best per anchor and window of every task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = held.value
        best = [[Best(k) for _ in range(max(len(w), 1))] for w in anchors.windows]
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = Lists(*row)
                for i in range(len(anchors.rows)):
                    search(block, anchors, i, best[i])
        for i, own in zip(anchors.rows.tolist(), best):
            if any(len(b.key) for b in own):
                yield pd.DataFrame({"anchor": i, "window": np.repeat(np.arange(len(own)), [len(b.key) for b in own]),
                                    "score": np.concatenate([b.score for b in own]), "key": np.concatenate([b.key for b in own])})

    return index.mapInPandas(run, "anchor long, window int, score long, key long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks as (anchor, window, rank, score, key); a task sends k rows of each at most."""
    turn = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "key"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def _anchor_groups(index: DataFrame, every: int, size: int) -> Iterator[tuple[Anchors, np.ndarray]]:
    """The rows whose id is divisible by ``every``, with their ids, a group of at most about ``size`` bytes at a time."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = Lists(*row)
                at = np.flatnonzero((block.keys % every == 0) & (block.keys != LAST))
                if len(at):
                    yield pd.DataFrame({"row": block.rows[at], "label": block.labels[at], "key": block.keys[at], "q": list(block.vectors[at])})

    anchors = durable(index.mapInPandas(read, "row long, label long, key long, q array<long>"), "anchors")
    total = anchors.agg(F.coalesce(F.sum(8 * F.size("q") + 16), F.lit(0))).first()[0]
    parts = -(-total // size)
    for i in range(parts):
        part = anchors.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == i).toPandas().sort_values("row")
        yield Anchors(part["row"].to_numpy(np.int64), part["label"].to_numpy(np.int64), [np.asarray(q, np.int64) for q in part["q"]]), part["key"].to_numpy(np.int64)


def mine_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   block_rows: int = BLOCK_ROWS, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, embedding, label).

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    index = durable(build_lists(usable(vectors), block_rows), "sorted-lists")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for anchors, keys in _anchor_groups(index, every, anchor_bytes):
        place = {row: i for i, row in enumerate(anchors.rows.tolist())}
        chosen = _first(_search(index, spark.sparkContext.broadcast(anchors), same_label, positives), positives).toPandas().sort_values(["anchor", "rank"])
        for row, score in zip(chosen["anchor"].tolist(), chosen["score"].tolist()):
            # low * p <= 100 * s <= high * p, for integers s
            anchors.windows[place[row]].append((-(-low * score // 100), high * score // 100))
        found = _first(_search(index, spark.sparkContext.broadcast(anchors), in_windows, negatives), negatives)
        named = chosen.assign(window=chosen["rank"] - 1, anchor_id=keys[[place[r] for r in chosen["anchor"].tolist()]])[["anchor", "window", "anchor_id", "key", "score"]]
        asked = spark.createDataFrame(named, "anchor long, window int, anchor_id long, positive long, positive_score long")
        out = out.unionByName(found.join(asked, ["anchor", "window"]).select(
            "anchor_id", id_of("positive").alias("positive_id"), "rank", id_of().alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """Labels moved by one, modulo ten, where the id is divisible by seven."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))
