"""Suffix-array dedup with a logarithmic family of index levels.

A string of ``length`` bytes that occurs twice holds, at the same place in both occurrences, the same *start*: the position
whose ``lead`` following bytes have the least fingerprint among those the string covers. Only the suffixes at such starts are indexed, about one per
hundred bytes, which loses no match of ``length`` bytes. Batches of documents make sparse suffix arrays; these are cut into ranges by
fingerprint of the leading bytes, and each range is an index family of its own: an arriving array is merge-scanned against the
levels that exist, matches are noted on both sides, and levels of equal size merge, so that a range with n arrays holds log n levels.

A start whose whole surroundings (all bytes of every string that may belong to it) occur again is settled by that. Where
the surroundings differ (the ends of a shared passage), each string of ``length`` bytes is looked up by its own fingerprint, sent once per
batch. Only those travel. Bytes covered by any repeated string are removed; strings are judged on the input.

Fingerprints are 64 bits wide. A missing text is empty; matches never cross rows. Rows with equal ids are separate places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import BITS, M1, STEP, batched, durable, edges, id_of, in_order, mix, shares, text_bytes

BATCH_BYTES = 12 << 20
ONCE, WHOLE, PARTLY, PARTNER = 0, 1, 2, 3
BASE = np.uint64(0xD6E8FEB86659FD93)
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * M1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Text:
    """Fingerprints of the substrings of one text, the same wherever a substring stands."""

    KEPT = 1 << 17
    UP, DOWN = _powers(int(BASE), KEPT), _powers(pow(int(BASE), -1, 1 << 64), KEPT)

    def __init__(self, raw: bytes):
        own = TABLE[np.frombuffer(raw, np.uint8)]
        n = len(own)
        up, self.down = (Text.UP, Text.DOWN) if n < Text.KEPT else (_powers(int(BASE), n + 1), _powers(pow(int(BASE), -1, 1 << 64), n + 1))
        own *= up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own, out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of each substring of ``size`` bytes."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.down[:len(out)]
        return mix(out)

    def each(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the substrings [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least one, the last of equals."""
    low_bits = np.uint64((1 << 20) - 1)
    step = (1 << 20) - width
    out = []
    for at in range(0, len(h) - width + 1, step):
        low = h[at:at + step + width - 1] & ~low_bits
        low |= low_bits - np.arange(len(low), dtype=np.uint64)
        n, span = len(low) - width + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:n], low[width - span:])
        out.append((low_bits - (low & low_bits)).astype(np.int64) + at)
    return np.concatenate(out)


class Batch:
    """The sparse suffix array of a batch: its starts, by fingerprint of the leading bytes and of the surroundings."""

    def __init__(self, pdf: pd.DataFrame, length: int, lead: int):
        self.rows, self.length, width = in_order(pdf), length, length - lead + 1
        self.raw = [t.encode() for t in self.rows["text"]]
        self.starts: list[tuple[int, np.ndarray]] = []  # row, first string of each start (and the end of the last)
        heads, around = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for row, raw in enumerate(self.raw):
            if len(raw) < length:
                continue
            text = Text(raw)
            keys = text.every(lead)
            where = least_in_windows(keys, width)
            turn = np.flatnonzero(where[1:] != where[:-1]) + 1
            turn = np.concatenate([[0], turn, [len(where)]])
            at = where[turn[:-1]]
            left = np.maximum(at - width + 1, 0)
            heads.append(mix(keys[at] + STEP))  # the least of many fingerprints: spread them again over the whole range
            around.append(text.each(left, np.minimum(at + length, len(raw))) + (at - left).astype(np.uint64) * STEP)
            self.starts.append((row, turn))
        head, pair = np.concatenate(heads), np.concatenate(around)
        pair = mix(pair + head * STEP)
        _, first, self.entry, count = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        head, pair, many = head[first], pair[first], count > 1
        order = np.argsort(head, kind="stable")
        self.level = Level(head[order], pair[order], many[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[self.entry] if len(order) else self.entry

    def states(self, parts: int, answer: pd.DataFrame) -> np.ndarray:
        """What the index says of each start."""
        state = np.zeros(len(self.level.head), np.uint8)
        cut = edges(self.level.head, parts)
        for part, raw in zip(answer["part"], answer["bits"]):
            state[cut[part]:cut[part + 1]] = np.frombuffer(raw, np.uint8)
        return state[self.entry] if len(state) else np.empty(0, np.uint8)

    def by_row(self, state: np.ndarray):
        """(row, state of every string of it) for each text long enough."""
        done = 0
        for row, turn in self.starts:
            n = len(turn) - 1
            yield row, np.repeat(state[done:done + n], np.diff(turn))
            done += n


class Strings:
    """The strings that a batch looks up one by one, each distinct one once."""

    def __init__(self, batch: Batch, state: np.ndarray):
        self.wanted = []  # row, first byte and fingerprint of each string
        for row, kind in batch.by_row(state):
            begin = np.flatnonzero(kind >= PARTLY).astype(np.int32)
            if len(begin):
                self.wanted.append((row, begin, Text(batch.raw[row]).each(begin, begin + batch.length)))
        every = np.concatenate([np.empty(0, np.uint64), *(h for _, _, h in self.wanted)])
        every.sort()
        again = np.concatenate([[False], every[1:] == every[:-1], [False]])  # whether the string before is the same
        first = ~again[:-1][:len(every)]
        self.distinct, self.many = every[first], again[1:][:len(every)][first]

    def repeated(self, known: np.ndarray) -> dict[int, np.ndarray]:
        """Where the strings of each row begin that are known (one flag per distinct string) to repeat."""
        hits = self.distinct[known]
        if not len(hits):
            return {}
        return {row: begin[hits[np.minimum(np.searchsorted(hits, h), len(hits) - 1)] == h] for row, begin, h in self.wanted}


class Level:
    """A sorted run of suffix entries: leading bytes, the same with surroundings, and whether that was seen twice."""

    def __init__(self, head: np.ndarray, pair: np.ndarray, many: np.ndarray, shared: np.ndarray | None = None):
        self.head, self.pair, self.many = head, pair, many
        self.shared = np.zeros(len(head), bool) if shared is None else shared

    def __len__(self):
        return len(self.head)

    def scan(self, other: Level) -> None:
        """Merge-scan two sorted runs and note on both sides the entries whose leading bytes the other has."""
        for a, b in ((self, other), (other, self)):
            at = np.searchsorted(b.head, a.head)
            a.shared |= b.head[np.minimum(at, len(b) - 1)] == a.head

    def merge(self, other: Level) -> Level:
        head, pair = np.concatenate([self.head, other.head]), np.concatenate([self.pair, other.pair])
        many, shared = np.concatenate([self.many, other.many]), np.concatenate([self.shared, other.shared])
        order = np.lexsort((pair, head))
        head, pair = head[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (head[1:] != head[:-1])]))
        many = np.logical_or.reduceat(many[order], new) | (np.diff(np.append(new, len(head))) > 1)
        return Level(head[new], pair[new], many, np.logical_or.reduceat(shared[order], new))


class Family:
    """Index levels of geometrically falling size."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, new: Level) -> None:
        for level in self.levels:
            level.scan(new)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            new = self.levels.pop()
            self.levels.append(self.levels.pop().merge(new))

    def states(self) -> Level:
        """All levels as one; ``shared`` then holds the state of each entry."""
        whole = self.levels[-1]
        for level in self.levels[-2::-1]:
            whole = level.merge(whole)
        new = np.concatenate([[True], whole.head[1:] != whole.head[:-1]])
        run = np.cumsum(new) - 1
        alone = np.bincount(run)[run] == 1  # one kind of surroundings only
        state = np.where(alone, np.where(whole.many, WHOLE, ONCE), np.where(whole.many, PARTNER, PARTLY))
        order = np.argsort(whole.pair)
        return Level(whole.head[order], whole.pair[order], whole.many[order], state.astype(np.uint8)[order])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def dedup_suffixes(docs: DataFrame, length: int = 400, lead: int = 100, batch_bytes: int = BATCH_BYTES, carried: list[str] | tuple = (),
                   whole_characters: bool = False, part_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans of removed bytes, kept bytes, rest) per row; ``rest``: the columns ``carried``, as JSON.

    ``whole_characters`` drops what is left of a character cut in two, so that the kept bytes are a text. A batch holds about
    ``batch_bytes`` of text, a range of fingerprints what ``part_bytes`` of text (as many, if not given) send to it.
    """
    spark = docs.sparkSession
    size = text_bytes(docs)
    parts = shares(spark, size, part_bytes or batch_bytes)
    dealt = batched(docs, shares(spark, size, batch_bytes), carried)

    def send(pdf):
        level = Batch(pdf, length, lead).level
        cut = edges(level.head, parts)
        rows = [(int(pdf["batch"].iloc[0]), i, level.head[a:b].tobytes(), level.pair[a:b].tobytes(), np.packbits(level.many[a:b]).tobytes())
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pd.DataFrame(rows, columns=["batch", "part", "heads", "pairs", "many"])

    def index(pdf):
        family, runs = Family(), []
        pdf = pdf.sort_values("batch")
        for heads, pairs, many in zip(pdf["heads"], pdf["pairs"], pdf["many"]):
            head, pair = np.frombuffer(heads, np.uint64), np.frombuffer(pairs, np.uint64)
            runs.append(pair)
            family.add(Level(head, pair, np.unpackbits(np.frombuffer(many, np.uint8))[:len(head)].astype(bool)))
        known = family.states()
        rows = []
        for batch, part, pair in zip(pdf["batch"], pdf["part"], runs):
            state = known.shared[np.searchsorted(known.pair, pair)]
            if state.any():
                rows.append((batch, part, "start", state.tobytes()))
        return pd.DataFrame(rows, columns=["batch", "part", "kind", "bits"])

    def send_strings(pdf, states):
        if not len(pdf):
            return pd.DataFrame(columns=["batch", "part", "hashes", "many"])
        batch = Batch(pdf, length, lead)
        found = Strings(batch, batch.states(parts, states))
        cut = edges(found.distinct, parts)
        rows = [(int(pdf["batch"].iloc[0]), i, found.distinct[a:b].tobytes(), np.packbits(found.many[a:b]).tobytes())
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pd.DataFrame(rows, columns=["batch", "part", "hashes", "many"])

    def match_strings(pdf):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        many = [np.unpackbits(np.frombuffer(m, np.uint8))[:len(x) // 8].astype(bool) for m, x in zip(pdf["many"], pdf["hashes"])]
        h.sort()
        twice = h[1:][h[1:] == h[:-1]]  # of more than one batch
        rows = []
        for batch, part, x, hit in zip(pdf["batch"], pdf["part"], pdf["hashes"], many):
            own = np.frombuffer(x, np.uint64)
            if len(twice):
                hit |= twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
            if hit.any():
                rows.append((batch, part, "string", np.packbits(hit).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "part", "kind", "bits"])

    def cut_out(pdf, answers):
        if not len(pdf):
            return pd.DataFrame(columns=["key", "n_bytes", "spans", "kept", "rest"])
        batch = Batch(pdf, length, lead)
        state = batch.states(parts, answers[answers["kind"] == "start"])
        found = Strings(batch, state)
        known = np.zeros(len(found.distinct), bool)
        cut = edges(found.distinct, parts)
        for part, raw in answers.loc[answers["kind"] == "string", ["part", "bits"]].itertuples(index=False):
            known[cut[part]:cut[part + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8))[:cut[part + 1] - cut[part]]
        single = found.repeated(known)
        hits = {}
        for row, kind in batch.by_row(state):
            repeated = (kind == WHOLE) | (kind == PARTNER)
            if row in single:
                repeated[single[row]] = True
            if repeated.any():
                hits[row] = repeated
        out = []
        for row, (key, rest, raw) in enumerate(zip(batch.rows["key"], batch.rows["rest"], batch.raw)):
            spans, kept = [], raw
            if row in hits:
                start, stop = _runs(hits[row])
                covered = np.zeros(len(raw) + 1, np.int32)
                np.add.at(covered, start, 1)
                np.add.at(covered, stop - 1 + length, -1)
                covered = np.cumsum(covered[:-1]) > 0
                spans = list(zip(*(x.tolist() for x in _runs(covered))))
                kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                if whole_characters:
                    kept = kept.decode("utf-8", "ignore").encode()
            out.append((key, len(raw), spans, kept, rest))
        return pd.DataFrame(out, columns=["key", "n_bytes", "spans", "kept", "rest"])

    arrays = dealt.groupBy("batch").applyInPandas(send, "batch int, part int, heads binary, pairs binary, many binary")
    states = durable(arrays.groupBy("part").applyInPandas(index, BITS), "suffix-states")
    strings = dealt.groupBy("batch").cogroup(states.groupBy("batch")).applyInPandas(
        send_strings, "batch int, part int, hashes binary, many binary")
    answers = states.unionByName(strings.groupBy("part").applyInPandas(match_strings, BITS))
    done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        cut_out, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, rest string")
    return done.select(id_of().alias("doc_id"), "n_bytes", "spans", "kept", "rest")
