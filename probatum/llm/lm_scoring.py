"""LM scoring: a causal self-attention model over subword ids, and counts over all training words.

A text's tokens are its lower-cased words and one end. The model's probability of a word is that of its class given what stands before it, from
the attention model, times that of the word within its class, from counts. A class gathers words by their first
subword id, so the count part multiplies out to the word's subwords given the class. The attention model reads the first and last subword
id of each word in overlapping windows, each word predicted once (:mod:`probatum.llm.attention`).

Fitting: counts and co-occurrence of the subword ids of all training documents set the classes. A warm-up on at most ``warm_docs`` training
documents on the driver gives the parameters a start. Then every batch of documents improves all parameters, embeddings too, on all windows of
its training documents. Batches take turns in ``rounds`` rounds; after each, results are written and averaged, an embedding's row by the words
that used it, other parameters by all words, and the next round starts from the average. Counts of words cover all training documents:
batches send each distinct word once to the word's part, and get its total count back. How documents are dealt to batches follows from
their bytes alone, so the fit does not depend on the session's settings.

Training documents are those whose id has a crc32 that is not 0 modulo ``folds``; a missing id is held out. A missing text is empty: it has
the end alone. Rows that repeat a doc_id are scored separately.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.attention import CLASSES, GROUPS, ROWS, START, WIDTH, Fit, Model, windows_of
from probatum.llm.common import LAST, batched, durable, edges, id_of, in_order, numbered, shares, text_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that splits text before the merges of that vocabulary: a fixed value of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = xxhash.xxh64_intdigest(b"")
IDS = 1 << 16
BATCH_BYTES, PART_BYTES = 6 << 20, 16 << 20
STEP_WINDOWS, RATE = 256, 2e-3
REMEMBERED = 1 << 18  # words
MARKS = 16  # width of the vectors that stand for co-occurrence
PIECES = 64
FINE = 1 << 16  # fixed point of sums, which so do not depend on their order


@cache
def subwords(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}


@cache
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=subwords(path), special_tokens={})


@cache
def remembered(path: str) -> dict[bytes, int]:
    """The two ids of words as one number: of words of a-z that are one subword, which the pattern never cuts, and of words met before."""
    return {word: i << 16 | i for word, i in subwords(path).items() if word.isalpha() and word.islower()}


def end_ids(found: list[bytes], path: str, often: np.ndarray | None = None) -> np.ndarray:
    """(first, last) subword id of each word. Words marked in ``often`` are remembered by the process, up to a fixed number."""
    coder, memory = encoding(path), remembered(path)
    known = np.fromiter((memory.get(w, -1) for w in found), np.int64, len(found))
    out = np.stack([known >> 16, known & 0xFFFF], axis=1).astype(np.uint16)
    rest = np.flatnonzero(known < 0)
    if not len(rest):
        return out
    cut = [found[i] for i in rest.tolist()]
    newline = coder.encode_ordinary("\n")[0]
    ids = np.array(coder.encode_ordinary(b"\n".join(cut).decode() + "\n"), np.int64)
    at = np.flatnonzero(ids == newline)
    if len(at) != len(cut) or (np.diff(np.concatenate([[-1], at])) < 2).any():  # a word whose white space joined the newline
        pairs = [coder.encode_ordinary(w.decode()) for w in cut]
        out[rest] = np.array([(p[0], p[-1]) for p in pairs], np.uint16)
    else:
        out[rest] = np.stack([ids[np.concatenate([[0], at[:-1] + 1])], ids[at - 1]], axis=1)
    if often is not None:
        new = rest[often[rest]][:max(REMEMBERED - len(memory), 0)]
        memory.update(zip([found[i] for i in new.tolist()], (out[new, 0].astype(np.int64) << 16 | out[new, 1]).tolist()))
    return out


def in_training(key: int, folds: int) -> bool:
    return key != LAST and zlib.crc32(str(key).encode()) % folds != 0


class Batch:
    """The tokens of a batch: each distinct one once, with where it stands."""

    def __init__(self, pdf: pd.DataFrame, folds: int):
        rows = in_order(pdf)
        self.keys = rows["key"].tolist()
        self.sizes, flat, found = numbered(rows["text"].tolist())
        self.train = np.array([in_training(k, folds) for k in self.keys], bool)
        h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
        self.distinct, first, where = np.unique(h, return_index=True, return_inverse=True)
        self.found, self.where = found[first], where[flat]
        self.counts = np.bincount(self.where[np.repeat(self.train, self.sizes)], minlength=len(self.distinct))

    def ids(self, path: str) -> np.ndarray:
        return end_ids(self.found.tolist(), path, np.bincount(self.where, minlength=len(self.found)) > 1)

    def targets(self, class_of: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Classes of all tokens in order, the end's (0) after each text."""
        out = np.zeros(len(first) + len(self.sizes), np.int16)
        out[np.arange(len(first)) + np.repeat(np.arange(len(self.sizes)), self.sizes)] = class_of[first]
        return out


@cache
def id_marks() -> np.ndarray:
    """A vector of random signs for each subword id."""
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (MARKS, IDS))


def co_occurrence(sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, and per id: its count, the weight of all that stands in texts with it, and the weighted sum of that by its marks.

    The sums of marks are the table of all pairs of ids, projected to ``MARKS`` columns: they add up over texts.
    """
    pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * IDS + first, return_counts=True)
    text, ids = pair // IDS, pair % IDS
    used, where = np.unique(ids, return_inverse=True)
    if not len(used):
        return used.astype(np.uint16), np.empty((0, MARKS + 2), np.float32)
    weight = np.sqrt(times / sizes[text])
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(text))))

    def others(x: np.ndarray) -> np.ndarray:
        return np.bincount(where, weight * (np.add.reduceat(x, begin)[row] - x))

    return used.astype(np.uint16), np.stack([np.bincount(where, times), others(weight), *(others(weight * m[ids]) for m in id_marks())],
                                            axis=1).astype(np.float32)


def choose_classes(table: np.ndarray, seed: int = 0) -> np.ndarray:
    """The class of each subword id, from a row of :func:`co_occurrence` sums per id.

    Ids that stand with the same ids share a group, ids of a group are cut by frequency into classes of like mass.
    """
    class_of = np.arange(IDS) % (CLASSES - 1) + 1
    count, near, marks = table[:, 0], table[:, 1], table[:, 2:]
    known = np.argsort(-count, kind="stable")[:np.count_nonzero(count)]
    if len(known) < GROUPS or not near.any():
        return class_of.astype(np.int16)
    lean = marks[known] / np.maximum(near[known], 1e-9)[:, None] - marks.sum(axis=0) / near.sum()  # against what stands with any id
    lean /= np.maximum(np.linalg.norm(lean, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(count[known])[:, None]
    rng = np.random.default_rng(seed)
    centres = lean[rng.choice(len(known), GROUPS, replace=False, p=weight[:, 0] / weight.sum())]
    for _ in range(30):
        group = (lean @ centres.T).argmax(axis=1)
        for g in range(GROUPS):
            if (group == g).any():
                centres[g] = (weight * lean)[group == g].sum(axis=0)
                centres[g] /= max(np.linalg.norm(centres[g]), 1e-9)
    for g in range(GROUPS):
        own = known[group == g]
        mass = np.cumsum(count[own]) - count[own] / 2
        class_of[own] = np.maximum(g * GROUPS + np.minimum(mass * GROUPS // max(count[own].sum(), 1), GROUPS - 1), 1)
    return class_of.astype(np.int16)


def warm_up(pdf: pd.DataFrame, class_of: np.ndarray, path: str, folds: int, epochs: int = 8) -> Model:
    """A model to start from, fitted on a few documents."""
    batch, model = Batch(pdf, folds), Model()
    if len(batch.sizes):
        ids = batch.ids(path).astype(np.int64)[batch.where] if len(batch.where) else np.empty((0, 2), np.int64)
        data = windows_of(batch.sizes, ids[:, 0], ids[:, 1], batch.targets(class_of, ids[:, 0]))[:4]
        fit, rng = Fit(model, 3e-3), np.random.default_rng(0)
        for epoch in range(epochs):
            order = rng.permutation(len(data[0]))
            for i in range(0, len(order), STEP_WINDOWS):
                some = order[i:i + STEP_WINDOWS]
                fit.learn(*(x[some] for x in data), rate=3e-3 * (1 - epoch / epochs))
    return model


def improve(sizes: np.ndarray, first: np.ndarray, last: np.ndarray, class_of: np.ndarray, model: Model, rate: float = RATE) -> np.ndarray:
    """One pass of ``model`` over a batch's training texts; how many of their tokens used each row of the two embedding tables."""
    targets = np.zeros(len(first) + len(sizes), np.int16)
    targets[np.arange(len(first)) + np.repeat(np.arange(len(sizes)), sizes)] = class_of[first]
    data = windows_of(sizes, first, last, targets)[:4]
    fit, order = Fit(model, rate), np.random.default_rng(len(data[0])).permutation(len(data[0]))
    for i in range(0, len(order), STEP_WINDOWS):
        some = order[i:i + STEP_WINDOWS]
        fit.learn(*(x[some] for x in data), rate=rate * (1 - 0.9 * i / len(order)))
    uses = np.stack([np.bincount(x % ROWS, minlength=ROWS + 2) for x in (first, last)])
    uses[:, START] = len(sizes)
    return uses.astype(np.int32)


def totals(rows: DataFrame, numbers: Callable, length: int) -> np.ndarray:
    """The sum of the integer vectors that ``numbers`` makes of each row: within tasks, then piece by piece, exact in any order."""
    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length, np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                total += numbers(row)
        if total.any():
            yield pd.DataFrame({"piece": np.arange(PIECES), "sums": [x.tobytes() for x in np.array_split(total, PIECES)]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low = 0, 0
        for raw in pdf["sums"]:
            x = np.frombuffer(raw, np.int64)
            high, low = high + (x >> 24), low + (x & 0xFFFFFF)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "sums": [(high * float(1 << 24) + low).tobytes()]})

    pieces = dict(rows.mapInPandas(within, "piece int, sums binary").groupBy("piece").applyInPandas(across, "piece int, sums binary").collect())
    sums = [np.frombuffer(pieces[i], np.float64) for i in sorted(pieces)]
    return np.concatenate(sums) if sums else np.zeros(length)


def averaged(results: DataFrame, start: Model) -> Model:
    """The mean of the batches' parameters, an embedding's row by the tokens that used it, the others by all tokens. What none used stays."""
    vector = start.vector()
    fixed = len(vector) - 2 * (ROWS + 2) * WIDTH

    def numbers(row) -> np.ndarray:
        weight = np.concatenate([np.full(fixed, row.tokens), np.repeat(np.frombuffer(row.uses, np.int32), WIDTH)]).astype(np.int64)
        return np.concatenate([np.round(np.frombuffer(row.vector, np.float32) * FINE).astype(np.int64) * weight, weight])

    value, weight = np.split(totals(results.select("vector", "uses", "tokens"), numbers, 2 * len(vector)), 2)
    model = Model()
    model.load(np.where(weight > 0, value / np.maximum(weight, 1) / FINE, vector))
    return model


def score_texts(docs: DataFrame, folds: int = 10, warm_docs: int = 300, tokenizer: str = TOKENIZER,
                batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES, rounds: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    ``tokenizer`` is a path that executors can read.
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    batches, parts = max(-(-size // batch_bytes), 1), shares(spark, size, part_bytes)
    dealt = batched(docs, batches)
    train = dealt.where((F.col("key") != LAST) & (F.crc32(F.col("key").cast("string")) % folds != 0))

    def send(pdf):
        """Rows of part -2: sums for the classes; -1: the training texts as ids; others: the part's distinct words."""
        batch = Batch(pdf, folds)
        ids = batch.ids(tokenizer)
        number, rows = int(pdf["batch"].iloc[0]), []
        if batch.train.any():
            sizes, own = batch.sizes[batch.train], ids[batch.where[np.repeat(batch.train, batch.sizes)]]
            used, table = co_occurrence(sizes, own[:, 0].astype(np.int64))
            rows = [(number, -2, used.tobytes(), table.tobytes(), b"", 0),
                    (number, -1, *(zlib.compress(x.tobytes(), 1) for x in (sizes, own[:, 0], own[:, 1])), len(own) + len(sizes))]
        cut = edges(batch.distinct, parts)
        counts = batch.counts.astype(np.int32)
        rows += [(number, i, batch.distinct[a:b].tobytes(), counts[a:b].tobytes(), ids[a:b].tobytes(), 0)
                 for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pd.DataFrame(rows, columns=["batch", "part", "hashes", "counts", "ids", "tokens"])

    def for_classes(row):
        sums = np.zeros((IDS, MARKS + 2), np.int64)
        sums[np.frombuffer(row.hashes, np.uint16)] = np.round(np.frombuffer(row.counts, np.float32).reshape(-1, MARKS + 2).astype(np.float64) * FINE)
        return sums.ravel()

    sent = durable(dealt.groupBy("batch").applyInPandas(
        send, "batch int, part int, hashes binary, counts binary, ids binary, tokens long"), "lm-words")
    class_of = choose_classes(totals(sent.where("part = -2").select("hashes", "counts"), for_classes, IDS * (MARKS + 2)).reshape(IDS, -1) / FINE)
    mark = F.xxhash64("key", "text").alias("mark")
    chosen = train.select("key", mark).orderBy("mark", "key").limit(warm_docs)  # narrow rows; their texts follow by a join
    few = train.select("*", mark).join(F.broadcast(chosen.distinct()), ["key", "mark"]).groupBy("key", "mark").agg(
        F.min("text").alias("text"), F.lit(0).alias("batch"), F.lit("").alias("rest")).toPandas()
    model = warm_up(few, class_of, tokenizer, folds)
    for number in range(min(rounds, batches)):
        held = spark.sparkContext.broadcast((class_of, model))

        def learn(frames, held=held):
            for frame in frames:
                for row in frame.itertuples(index=False):
                    classes, start = held.value
                    learner = Model()
                    learner.load(start.vector())
                    sizes, first, last = (np.frombuffer(zlib.decompress(x), kind).astype(np.int64)
                                          for x, kind in ((row.hashes, np.int64), (row.counts, np.uint16), (row.ids, np.uint16)))
                    uses = improve(sizes, first, last, classes, learner)
                    yield pd.DataFrame([(learner.vector().tobytes(), uses.tobytes(), row.tokens)], columns=["vector", "uses", "tokens"])

        turn = sent.where((F.col("part") == -1) & (F.col("batch") % rounds == number)).select("hashes", "counts", "ids", "tokens")
        model = averaged(durable(turn.mapInPandas(learn, "vector binary, uses binary, tokens long"), f"lm-round-{number}"), model)
    held = spark.sparkContext.broadcast(class_of)

    def count(pdf):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]])
        first = np.concatenate([np.frombuffer(x, np.uint16)[::2] for x in pdf["ids"]])
        _, one, where = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(where, n).astype(np.int64)
        classes = held.value[first[one]]
        sums, kinds = np.bincount(classes, total, CLASSES), np.bincount(classes, total > 0, CLASSES)
        rows = [(-1, c, b"", b"", int(sums[c]), int(kinds[c])) for c in np.flatnonzero(sums).tolist()]
        at = 0
        for batch, part, x, ids in zip(pdf["batch"], pdf["part"], pdf["hashes"], pdf["ids"]):
            own = total[where[at:at + len(x) // 8]]
            at += len(x) // 8
            rows.append((batch, part, own.tobytes(), ids, 0, 0))
        return pd.DataFrame(rows, columns=["batch", "part", "counts", "ids", "total", "kinds"])

    answers = durable(sent.where("part >= 0").groupBy("part").applyInPandas(
        count, "batch int, part int, counts binary, ids binary, total long, kinds long"), "lm-counts")
    sums, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, total, kind in answers.where("batch < 0").groupBy("part").agg(F.sum("total"), F.sum("kinds")).collect():  # a row per class
        sums[c], kinds[c] = total, kind
    ends = train.count()
    sums[0], kinds[0] = ends, int(ends > 0)  # class 0 is the end's alone
    held_too = spark.sparkContext.broadcast((class_of, model, sums, kinds))

    def score(pdf, known):
        if not len(pdf):
            return pd.DataFrame(columns=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])
        batch, (classes, model, sums, kinds) = Batch(pdf, folds), held_too.value
        all_sum, all_kinds = sums.sum(), kinds.sum()
        cut = edges(batch.distinct, parts)
        count, ids = np.zeros(len(batch.distinct), np.int64), np.zeros((len(batch.distinct), 2), np.uint16)
        for part, raw, own in zip(known["part"], known["counts"], known["ids"]):
            count[cut[part]:cut[part + 1]] = np.frombuffer(raw, np.int64)
            ids[cut[part]:cut[part + 1]] = np.frombuffer(own, np.uint16).reshape(-1, 2)
        base = np.log10((count + 0.1) / (all_sum + 0.1 * (all_kinds + 1)))
        its = classes[ids[:, 0]]
        within = np.log10((count + 0.1) / (sums[its] + 0.1 * (kinds[its] + 1)))
        base_end = np.log10((sums[0] + 0.1) / (all_sum + 0.1 * (all_kinds + 1)))
        within_end = np.log10((sums[0] + 0.1) / (sums[0] + 0.1 * (kinds[0] + 1)))
        own = ids.astype(np.int64)[batch.where] if len(batch.where) else np.empty((0, 2), np.int64)
        first, last, target, valid, _, _ = windows_of(batch.sizes, own[:, 0], own[:, 1], batch.targets(classes, own[:, 0]))
        said = np.concatenate([model.log10(first[i:i + STEP_WINDOWS], last[i:i + STEP_WINDOWS], target[i:i + STEP_WINDOWS])
                               for i in range(0, len(first), STEP_WINDOWS)])[valid]
        begin = np.cumsum(batch.sizes + 1) - batch.sizes - 1
        text = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
        n = len(batch.sizes)
        by_class = np.add.reduceat(said.astype(np.float64), begin)
        return pd.DataFrame({
            "key": batch.keys, "held_out": ~batch.train, "n_tokens": batch.sizes + 1,
            "n_known": np.bincount(text, count[batch.where] > 0, n).astype(np.int64) + int(sums[0] > 0),
            "base_score": np.bincount(text, base[batch.where], n) + base_end,
            "score": by_class + np.bincount(text, within[batch.where], n) + within_end})

    done = dealt.groupBy("batch").cogroup(answers.where("batch >= 0").select("batch", "part", "counts", "ids").groupBy("batch")).applyInPandas(
        score, "key long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(id_of().alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(sums.sum())).cast("long").alias("train_tokens"),
                       "base_score", "score")

