"""N-gram Jaccard join by rare-first prefix filtering.

Documents are sets of word shingles; two link when their Jaccard similarity is at least ``percent`` in a hundred. Shingles
are ordered rare first, by document counts over all documents in 2**20 hashed cells (a table of fixed size; any common order gives the same
links, the counts only keep prefixes rare). Similar sets share a shingle within their first ``n - ceil(percent * n / 100) + 1``
shingles, so only those are posted. Postings of copies fold into one per distinct set, and a shingle posted by one set only goes no
further. Posted shingles of crowded cells are dealt by shingle and set, so that none fills one task.

Pairs of distinct sets then pass a length filter and a positional filter as they meet, and a count filter: what two sets share beyond
the shorter reaching prefix is bounded by what lies there, so the prefixes must share the rest. Each pair left is verified once, after a suffix
filter. To lose no link and yet not list all pairs of a group of near copies, sets meet in two steps: first each set meets the most
central set of its shingles and length band; then, with the components this gives, every pair of sets that share a posted shingle and lie in
different components meets. Pairs inside a component cannot change it.

Lower-casing touches A-Z only. Fewer words than ``size`` make one shingle; null, empty or blank texts have none and link with
nothing. Rows that repeat a doc_id are judged by their own texts; a missing doc_id counts as the largest. Shingles and sets are known by 56- and
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import durable, edges, id_of, key_of, mix, numbered, shares, text_bytes, text_mark, windows
from probatum.llm.components import components

CELLS = 20  # bits of the count table
BLOCKS = 64
LOW = np.uint64((1 << 56) - 1)
EIGHT = np.uint64(8)
PART_BYTES = 12 << 20
SLICE_ROWS = 256


def shingle_sets(texts: Sequence[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each text has, and the shingles of all texts one after another, ascending within each."""
    sizes, word, found = numbered([t or "" for t in texts])
    h = pd.util.hash_array(found, categorize=False)[word]
    count = np.where(sizes < size, np.minimum(sizes, 1), sizes - size + 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    start, at = np.cumsum(sizes) - sizes, np.cumsum(count) - count
    low = np.empty(len(owner), np.uint64)
    whole = sizes[owner] >= size
    low[whole] = windows(h, size)[(start - at)[owner[whole]] + np.flatnonzero(whole)]
    for i in np.flatnonzero((sizes > 0) & (sizes < size)).tolist():
        low[at[i]] = windows(h[start[i]:start[i] + sizes[i]], sizes[i])[0]
    low &= LOW
    sort_within(low, count)
    once = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])[:len(low)]
    return np.bincount(owner[once], minlength=len(sizes)), low[once]


def sort_within(values: np.ndarray, count: np.ndarray) -> None:
    """Sort each run of values, ``count`` of them one after another, in place."""
    end = np.cumsum(count)
    for a, b in zip((end - count).tolist(), end.tolist()):
        values[a:b].sort()


def each_set(texts: Sequence[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending. A text that follows itself is cut once."""
    texts = list(texts)
    changed = np.array([i == 0 or t != texts[i - 1] for i, t in enumerate(texts)], bool)
    n, low = shingle_sets([t for t, c in zip(texts, changed) if c], size)
    found = np.split(low, np.cumsum(n)[:-1])
    return [found[i] for i in (np.cumsum(changed) - 1).tolist()]


def set_marks(n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A hash of each set of shingles, 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(low.copy()))])
    end = np.cumsum(n)
    return (total[end] - total[end - n]).view(np.int64)


def slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows, a few at a time: what is worked out for each word of a slice stays small."""
    for at in range(0, len(frame), SLICE_ROWS):
        yield frame.iloc[at:at + SLICE_ROWS]


def first_met(marks: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the marks were not seen before; now they are."""
    return np.array([m not in seen and not seen.add(m) for m in marks.tolist()], bool)


def cell_of(low: np.ndarray) -> np.ndarray:
    return (low >> np.uint64(56 - CELLS)).astype(np.int64)


def needed(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m with the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def far_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """Suffix filter: whether two ordered sets surely differ in more than ``most`` elements."""
    def bound(x, y, depth):
        gap = abs(len(x) - len(y))
        if depth == 0 or not len(x) or not len(y) or gap > most:
            return gap
        middle = len(y) // 2
        at = int(np.searchsorted(x, y[middle]))
        same = at < len(x) and x[at] == y[middle]
        left = bound(x[:at], y[:middle], depth - 1)
        if left > most:
            return left
        return left + bound(x[at + same:], y[middle + 1:], depth - 1) + (not same)

    return bound(x, y, depth) > most


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, in rare-first order, reach the similarity."""
    need = needed(len(x), len(y), percent)
    if need > min(len(x), len(y)) or far_apart(x, y, len(x) + len(y) - 2 * need):
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1])) >= need


class Order:
    """The rare-first order: counts of cells in eighths of a power of two stand before the shingle's hash."""

    def __init__(self, counts: np.ndarray):
        self.level = np.floor(8 * np.log2(1 + counts)).clip(0, 254).astype(np.uint64) << np.uint64(56)
        crowded = counts > 16 * max(counts.mean(), 1) + 4096
        self.crowded = np.flatnonzero(crowded)

    def keys(self, low: np.ndarray) -> np.ndarray:
        """The shingles of a set in order."""
        keys = self.level[cell_of(low)] | low
        keys.sort()
        return keys

    def first_keys(self, low: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The first shingles in order of each of several sets, ``n`` shingles long and one after another."""
        keys = self.level[cell_of(low)] | low
        sort_within(keys, n)
        return keys[np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(first, n)]


def describe(docs: DataFrame, size: int) -> DataFrame:
    """Per row (key, text_mark, n, mark of the set), and per task the counts of its cells in blocks of a fixed size (block, counts)."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << CELLS, np.int32)
        for frame in frames:
            seen: set[int] = set()
            for rows in slices(frame):
                n, low = shingle_sets(rows["text"], size)
                marks = set_marks(n, low)
                np.add.at(counts, cell_of(low[np.repeat(first_met(marks, seen), n)]), np.int32(1))  # a plain 1 is far slower
                yield pd.DataFrame({"key": rows["key"], "text_mark": rows["text_mark"], "n": n, "mark": marks, "block": -1, "counts": b""})
        for i, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                yield pd.DataFrame([(0, 0, 0, 0, i, part.tobytes())], columns=["key", "text_mark", "n", "mark", "block", "counts"])

    return docs.select(key_of().alias("key"), text_mark().alias("text_mark"), "text").mapInPandas(
        read, "key long, text_mark long, n long, mark long, block int, counts binary")


def rare_first(described: DataFrame) -> Order:
    """The order by the summed counts: 2**20 numbers, whatever the input."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame([(pdf["block"].iloc[0], total.tobytes())], columns=["block", "counts"])

    counts = np.zeros((BLOCKS, (1 << CELLS) // BLOCKS), np.int64)
    for block, raw in described.where("block >= 0").groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        counts[block] = np.frombuffer(raw, np.int64)
    return Order(counts.ravel())


def shared_postings(docs: DataFrame, order: Order, size: int, percent: int, parts: int) -> DataFrame:
    """(shingle, mark, n, place, sets): prefix postings of shingles that more than one set posts."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = held.value
        for frame in frames:
            marks, sizes, keys, seen = [], [], [], {0}
            for rows in slices(frame):
                n, low = shingle_sets(rows["text"], size)
                mark = set_marks(n, low)
                fresh = first_met(mark, seen)
                marks.append(mark[fresh])
                sizes.append(n[fresh])
                keys.append(ranks.first_keys(low[np.repeat(fresh, n)], n[fresh], prefix_length(n[fresh], percent)))
            marks, sizes, key = np.concatenate(marks), np.concatenate(sizes), np.concatenate(keys)
            if not len(key):
                continue
            count = prefix_length(sizes, percent)
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), count)
            place = (np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint32)
            dealt = (key & LOW) << EIGHT
            hot = np.isin(cell_of(key & LOW), ranks.crowded)
            if hot.any():
                dealt[hot] = mix(dealt[hot] ^ marks[owner[hot]].view(np.uint64))
            by = np.argsort(dealt)
            cut = edges(dealt[by], parts)
            key, owner, place = key[by], owner[by], place[by]
            yield pd.DataFrame([(i, key[a:b].tobytes(), owner[a:b].tobytes(), place[a:b].tobytes(), marks[(u := np.flatnonzero(np.bincount(owner[a:b])))].tobytes(),
                                 sizes[u].tobytes(), u.astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a],
                               columns=["part", "keys", "owners", "places", "marks", "sizes", "which"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        place = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["places"]])
        mark, n = [], []
        for owners, marks, sizes, which in zip(pdf["owners"], pdf["marks"], pdf["sizes"], pdf["which"]):
            at = np.searchsorted(np.frombuffer(which, np.uint32), np.frombuffer(owners, np.uint32))
            mark.append(np.frombuffer(marks, np.int64)[at])
            n.append(np.frombuffer(sizes, np.int64)[at])
        mark, n = np.concatenate(mark), np.concatenate(n)
        by = np.lexsort((mark, key))
        key, place, mark, n = key[by], place[by], mark[by], n[by]
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
        key, place, mark, n = key[once], place[once], mark[once], n[once]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sets = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        stay = (sets > 1) | np.isin(cell_of(key & LOW), held.value.crowded)
        return pd.DataFrame({"shingle": key[stay].view(np.int64), "mark": mark[stay], "n": n[stay], "place": place[stay].astype(np.int64), "sets": sets[stay]})

    blocks = docs.select("text").mapInPandas(
        post, "part int, keys binary, owners binary, places binary, marks binary, sizes binary, which binary")
    return blocks.groupBy("part").applyInPandas(gather, "shingle long, mark long, n long, place long, sets long")


def needed_in_prefixes(n, m, percent: int):
    """How many shingles the prefixes of sets of n and m must share: the least intersection, less the most that lies beyond a prefix."""
    least = F.ceil(percent * (n + m) / (100 + percent))
    return least - F.greatest(F.ceil(percent * n / 100), F.ceil(percent * m / 100)) + 1


def met(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): pairs of postings (mark, n, place, posted; mark2, ...) of one shingle that pass the length and positional
    filters, each pair of sets once, with the number of such shingles. ``posted``: how many shingles a set shares with any other."""
    n, m = F.col("n"), F.col("n2")
    alike = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    reach = F.least("place", "place2") + F.least(n - F.col("place"), m - F.col("place2"))
    need = needed_in_prefixes(n, m, percent)
    close = pairs.where(alike & ((100 + percent) * reach >= percent * (n + m)) & (F.least("posted", "posted2") >= need))
    return close.where("mark <> mark2").groupBy(F.least("mark", "mark2").alias("a"), F.greatest("mark", "mark2").alias("b")).agg(
        F.count("*").alias("shared"))


def weighed(postings: DataFrame) -> DataFrame:
    """Postings with their set's number of shared shingles, how many sets these are shared with in all, and their turn among them."""
    own = Window.partitionBy("mark")
    return postings.select("shingle", "mark", "n", "place", F.count("*").over(own).alias("posted"), F.sum("sets").over(own).alias("weight"),
                           (F.row_number().over(own.orderBy("place")) - 1).alias("turn"))


def second(rows: DataFrame) -> DataFrame:
    """The same columns under the names of a pair's other side."""
    return rows.select("shingle", *[F.col(c).alias(f"{c}2") for c in rows.columns if c != "shingle"])


def to_centres(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the most central set of its shingles and length band; central: with the largest part of its prefix, then most sets, in common."""
    rows = postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))))
    # a set near the middle of a group has hardly a shingle of its own in its prefix
    common = F.col("posted") / (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    centre = rows.groupBy("shingle", "band").agg(
        F.max_by(F.struct("mark", "n", "place", "posted"), F.struct(common, "weight", "mark")).alias("c"))
    found = met(rows.join(centre.select("shingle", "band", *[F.col(f"c.{c}").alias(f"{c}2") for c in ("mark", "n", "place", "posted")]),
                          ["shingle", "band"]), percent)
    best = found.select("shared", F.explode(F.array(F.struct(F.col("a").alias("mark"), F.col("b").alias("other")),
                                                    F.struct(F.col("b").alias("mark"), F.col("a").alias("other")))).alias("p"))
    # a set is paired with the centre of most of its shingles
    chosen = best.groupBy("p.mark").agg(F.max_by("p.other", F.struct("shared", "p.other")).alias("other"))
    return chosen.select(F.least("mark", "other").alias("a"), F.greatest("mark", "other").alias("b")).distinct()


def across(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of sets in different components whose prefixes may share enough.

    Within a shingle, the sets outside its largest component meet all sets; those within it are not paired. Sets whose prefixes
    share k shingles share one that is not among the last k - 1 shared ones of either: only there they need to meet, and a shingle
    that thousands of otherwise different sets end with pairs none of them.
    """
    rows = postings.drop("weight").join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    by_label = rows.groupBy("shingle", "label").agg(F.count("*").alias("members"))
    mixed = by_label.groupBy("shingle").agg(F.max_by("label", F.struct("members", "label")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = rows.join(mixed.select("shingle", "major"), "shingle")
    minor = rows.where("label <> major").drop("major")
    pairs = minor.join(second(rows), "shingle").where((F.col("label") != F.col("label2")) & (
        (F.col("label2") == F.col("major2")) | (F.col("mark") < F.col("mark2"))))
    need = F.greatest(needed_in_prefixes(F.col("n"), F.col("n2"), percent), F.lit(1))
    early = (F.col("turn") <= F.col("posted") - need) & (F.col("turn2") <= F.col("posted2") - need)
    return met(pairs.where(early), percent).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. ``sets``: (mark, least key of a row that has it)."""
    held = pairs.sparkSession.sparkContext.broadcast(order)

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, last, kept = held.value, None, None
        for frame in frames:
            ok = []
            for rows in slices(frame):
                for b, x, y in zip(rows["b"].tolist(), each_set(rows["text_a"], size), each_set(rows["text_b"], size)):
                    if b != last:
                        last, kept = b, ranks.keys(y)
                    ok.append(similar(ranks.keys(x), kept, percent))
            yield frame.loc[ok, ["a", "b"]]

    marks = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    wanted = durable(marks.join(sets, "mark").select(F.col("least").alias("key")).distinct(), "wanted")
    texts = durable(texts_of(docs, wanted, size), "wanted-texts")
    one = pairs.join(texts.select(F.col("mark").alias("a"), F.col("text").alias("text_a")), "a")
    return one.join(texts.select(F.col("mark").alias("b"), F.col("text").alias("text_b")), "b").select(
        "a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def join_documents(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_mark, group) per row: the set's size, the least doc_id reachable by links, and a name of
    the group that is the same for all its rows, null without shingles."""
    spark = docs.sparkSession
    parts = shares(spark, text_bytes(docs), PART_BYTES)
    described = durable(describe(docs, size), "shingle-sets")
    order = rare_first(described)
    rows = described.where("block < 0")
    sets = rows.where("n > 0").groupBy("mark").agg(F.min("key").alias("least"))
    postings = durable(weighed(durable(shared_postings(docs, order, size, percent, parts), "shared-postings")), "weighed-postings")

    central = durable(to_centres(postings, percent), "central-pairs")
    links = durable(verified(central, docs, sets, order, size, percent), "central-links")
    rest = durable(across(postings, components(links), percent).join(central, ["a", "b"], "left_anti"), "other-pairs")
    links = links.unionByName(durable(verified(rest, docs, sets, order, size, percent), "other-links"))

    labels = components(links)
    named = sets.join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    of_set = named.join(least, "label").select("mark", "component", F.col("label").alias("group"))
    return same_ids(rows, of_set)


def texts_of(docs: DataFrame, wanted: DataFrame, size: int, few: int = 500_000) -> DataFrame:
    """(mark, text), one text per set, of the rows whose key is wanted.

    Up to ``few`` keys, eight bytes each, are broadcast so that the texts stay where they lie; more are joined by a shuffle.
    """
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in slices(frame):
                yield pd.DataFrame({"mark": set_marks(*shingle_sets(rows["text"], size)), "text": rows["text"]})

    return (docs.select(key_of().alias("key"), "text").join(F.broadcast(wanted) if wanted.count() <= few else wanted, "key", "left_semi").select("text")
            .mapInPandas(read, "mark long, text string").groupBy("mark").agg(F.min("text").alias("text")))


def same_ids(rows: DataFrame, of_set: DataFrame) -> DataFrame:
    """Rows with their component; a document without shingles is its own."""
    found = rows.withColumn("set", F.when(F.col("n") > 0, F.col("mark"))).join(of_set.withColumnRenamed("mark", "set"), "set", "left")
    return found.select(id_of().alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "key"), F.lit((1 << 63) - 1)).alias("component_id"), "text_mark", "group")
