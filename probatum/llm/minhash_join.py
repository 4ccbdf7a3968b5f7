"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A document is the set of its word shingles. Its signature has ``chunks`` times ``width`` places of ``BITS`` bits, each the mixed minimum of
one hash function over the set, and the distance of two signatures is the number of places that differ. By the pigeonhole principle two signatures
that differ in at most ``chunks * (errors + 1) - 1`` places have a chunk with at most ``errors`` differing places. So each signature
posts, for every chunk and every choice of ``errors`` places to leave out, the rest of the chunk; signatures within the distance post
something alike, whatever their number. With 16 chunks of 5 places and one error the distance is 31 of 80; a pair at similarity 0.8 goes beyond it
about three times in 100,000, at 0.85 less than once in ten million. That is the only approximation: every pair within the distance is found, and links
count only after both full sets have been compared.

Copies fold into sets before anything is posted, and a probe that one set alone posts goes no further. Not all pairs of a group are listed.
Each set first meets the heaviest set it shares a probe with within the distance (one that shares most probes in all stands in the middle of its
group). In some turns each probe then draws one set of its largest component, and every set outside meets the most alike of those drawn for it; one link
settles it with all the others there. With the components that these links give, every pair within the distance whose sets share a probe and lie
in different components is compared; pairs inside a component cannot change it. Two tests inside the join keep it from listing pairs that cannot link: the distance on
four bits a place, which never exceeds the full distance, and parity maps, in which each shingle turns one of ``64 * MAP`` bits: the
bits that differ between two maps never outnumber the shingles that differ between the sets. They tell variants of one text that are less
alike than asked apart from those that are, for sets of up to some thousand shingles; above that the maps fill up and only the distance counts. A pair with chunks alike as a whole is listed once for each of
these, not for all probes that it shares.

Lower-casing touches A-Z only. Fewer words than ``size`` make one shingle; null, empty or blank texts have none and link with nothing. Rows
that repeat a doc_id are judged by their own texts; a missing doc_id counts as the largest. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import LAST, M1, STEP, Hashes, durable, id_of, key_of, mix, shingle_hashes, text_mark
from probatum.llm.components import components

BITS = 16
STRIDE = 1 << 15  # shingles hashed at a time, so that they stay in cache
NIBBLES = 0x1111111111111111
MAP = 16


def distinct_shingles(text: str | None, hashes: Hashes, size: int) -> np.ndarray:
    h = shingle_hashes(text, hashes, size)
    return np.unique(h) if len(h) else h


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """A row of ``places`` 16-bit values for each non-empty set."""
    out = np.empty((places, len(sets)), np.uint64)
    seeds = mix(np.arange(1, places + 1, dtype=np.uint64) * STEP) | np.uint64(1)
    sizes = np.array([len(s) for s in sets])
    group = (np.cumsum(sizes) - sizes) // STRIDE
    edge = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        h = np.concatenate(sets[a:b])
        starts = np.cumsum(sizes[a:b]) - sizes[a:b]
        x = np.empty_like(h)
        for j, seed in enumerate(seeds):
            np.multiply(h, seed, out=x)
            out[j, a:b] = np.minimum.reduceat(x, starts)
    return (mix(out) >> np.uint64(64 - BITS)).astype(np.uint16).T


def probes(signature: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """For each signature the chunks with every choice of ``errors`` places left out, as 64-bit values."""
    parts, found = signature.reshape(len(signature), chunks, width).astype(np.uint64), []
    which = np.arange(1, chunks + 1, dtype=np.uint64) * M1
    choices = list(itertools.combinations(range(width), width - errors))
    turns = np.arange(len(choices), dtype=np.uint64) * STEP
    for i, kept in enumerate(choices):
        h = np.broadcast_to(mix(which + turns[i]), parts.shape[:2]).copy()
        for place in kept:
            h *= STEP
            h += parts[:, :, place] + np.uint64(1)
            h = mix(h)
        found.append(h)
    return np.concatenate(found, axis=1).view(np.int64)


def whole_chunks(signature: np.ndarray, chunks: int, width: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole chunks with their number, and of what the first choice leaves out of each chunk."""
    parts = signature.reshape(len(signature), chunks, width).astype(np.uint64)

    def hashed(places: range) -> np.ndarray:
        h = np.broadcast_to(np.arange(chunks, dtype=np.uint64), parts.shape[:2]).copy()
        for place in places:
            h = mix(h * STEP + parts[:, :, place] + np.uint64(1))
        return h.view(np.int64)

    return hashed(range(width)), hashed(range(width - errors, width))


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each place, 16 places to a 64-bit value."""
    places = -(-signature.shape[1] // 16) * 16
    low = np.zeros((len(signature), places), np.uint64)
    low[:, :signature.shape[1]] = signature & np.uint16(15)
    shift = (4 * np.arange(16)).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(signature), -1, 16) << shift, axis=2).view(np.int64)


def parity(found: np.ndarray) -> np.ndarray:
    """``64 * MAP`` bits, each telling whether an odd number of shingles of the set belong to it."""
    odd = np.bincount((found >> np.uint64(32)).astype(np.int64) % (64 * MAP), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame, size: int, places: int) -> DataFrame:
    """(key, text_mark, n, mark, signature, map) per row; no signature and no map without shingles."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for frame in frames:
            sets = [distinct_shingles(t, hashes, size) for t in frame["text"]]
            filled = [s for s in sets if len(s)]
            rows = iter(signatures(filled, places)) if filled else iter(())
            marks = [int(np.add.reduce(mix(s.copy())).view(np.int64)) if len(s) else 0 for s in sets]
            yield pd.DataFrame({"key": frame["key"], "text_mark": frame["text_mark"], "n": [len(s) for s in sets], "mark": marks,
                                "signature": [next(rows).tobytes() if len(s) else None for s in sets],
                                "map": [parity(s).tobytes() if len(s) else None for s in sets]})

    return docs.select(key_of().alias("key"), text_mark().alias("text_mark"), "text").mapInPandas(
        read, "key long, text_mark long, n long, mark long, signature binary, map binary")


def posted(sets: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(mark, n, sketch, map, whole, left, probes) per set."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                signature = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(len(frame), -1)
                whole, left = whole_chunks(signature, chunks, width, errors)
                yield pd.DataFrame({"mark": frame["mark"], "n": frame["n"], "whole": list(whole), "left": list(left), "sketch": list(sketches(signature)),
                                    "map": list(np.frombuffer(b"".join(frame["map"]), np.int64).reshape(len(frame), -1)), "probes": list(probes(signature, chunks, width, errors))})

    return sets.select("mark", "n", "signature", "map").mapInPandas(
        read, "mark long, n long, whole array<long>, left array<long>, sketch array<long>, map array<long>, probes array<long>")


def distance(one: list, other: list):
    """How many places of two sketches differ: at most the distance of the signatures."""
    def differing(a, b):
        x = F.col(a).bitwiseXOR(F.col(b))
        some = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        return F.bit_count(some.bitwiseAND(F.lit(NIBBLES)))
    return reduce(lambda a, b: a + b, [differing(a, b) for a, b in zip(one, other)])


def near(percent: int, most: int, longs: int):
    """Whether a pair of postings may be linked, by their sizes and sketches; the other side's columns end in 2."""
    alike = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    names = [f"s{i}_" for i in range(longs)]
    return (F.col("mark") != F.col("mark2")) & alike & (distance(names, [f"{x}2" for x in names]) <= most)


def differing_bits():
    """How many bits differ between the parity maps of a pair: at most the shingles that differ between the sets."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"p{i}_").bitwiseXOR(F.col(f"p{i}_2"))) for i in range(MAP)])


def differ_little(percent: int):
    """Whether the parity maps leave it possible that the sets reach the similarity."""
    both = F.col("n") + F.col("n2")
    return differing_bits() <= both - 2 * F.ceil(percent * both / (100 + percent))


def in_one_place():
    """Whether a pair that shares several probes is to be listed by this one: by the first probe of each chunk that is alike as a whole, or, if no
    chunk is, by every one."""
    return F.coalesce(F.col("left") == F.col("left2"), F.lit(False)) | ~F.arrays_overlap("whole", "whole2")


def second(rows: DataFrame) -> DataFrame:
    """The same columns under the names of a pair's other side."""
    return rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns])


def to_heaviest(shared: DataFrame, facts: DataFrame, percent: int, most: int, longs: int) -> DataFrame:
    """(a, b): each set with the heaviest set among the heaviest of its probes that lies within the distance."""
    names = ["n", "weight", *[f"s{i}_" for i in range(longs)]]
    rows = shared.select("probe", "mark").join(facts.select("mark", *names), "mark")
    heaviest = rows.groupBy("probe").agg(F.max_by(F.struct("mark", *names), F.struct("weight", "mark")).alias("c")).select("probe", "c.*")
    pairs = rows.join(second(heaviest), (F.col("probe") == F.col("probe2")) & near(percent, most, longs))
    chosen = pairs.groupBy("mark").agg(F.max_by("mark2", F.struct("weight2", "mark2")).alias("other"))
    return chosen.select(F.least("mark", "other").alias("a"), F.greatest("mark", "other").alias("b")).distinct()


def mixed_probes(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(probe, mark, left, label, major): the postings of probes whose sets lie in different components, ``major`` being the largest of these."""
    rows = shared.select("probe", "mark", "left").join(labels.withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    by_label = rows.groupBy("probe", "label").agg(F.count("*").alias("members"))
    mixed = by_label.groupBy("probe").agg(F.max_by("label", F.struct("members", "label")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1")
    return rows.join(mixed.select("probe", "major"), "probe")


def to_drawn(rows: DataFrame, facts: DataFrame, turn: int, percent: int, most: int, longs: int) -> DataFrame:
    """(a, b): each set outside the largest component of a probe with the most alike, per component, of the sets drawn for its probes.

    A probe draws one set of its largest component, another each ``turn``; so a set meets no more sets than it has probes.
    """
    drawn = rows.where("label = major").groupBy("probe").agg(F.max_by("mark", F.xxhash64("mark", "probe", F.lit(turn))).alias("mark2"))
    met = rows.where("label <> major").join(drawn, "probe").select("mark", "mark2", F.col("major").alias("label2")).distinct()
    facts = facts.drop("weight", "whole")
    pairs = met.join(facts, "mark").join(second(facts), "mark2").where(near(percent, most, longs) & differ_little(percent))
    chosen = pairs.groupBy("mark", "label2").agg(F.min_by("mark2", F.struct(differing_bits() / (F.col("n") + F.col("n2")), "mark2")).alias("other"))
    return chosen.select(F.least("mark", "other").alias("a"), F.greatest("mark", "other").alias("b")).distinct()


def across(rows: DataFrame, facts: DataFrame, percent: int, most: int, longs: int) -> DataFrame:
    """(a, b): all pairs that may be linked, share a probe and lie in different components. ``rows``: as :func:`mixed_probes` gives them.

    Within a probe, the sets outside its largest component meet all sets; those within it are not paired.
    """
    facts = facts.drop("weight")
    minor, every = rows.where("label <> major").join(facts, "mark"), second(rows.join(facts, "mark"))
    once = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("major2")) | (F.col("mark") < F.col("mark2")))
    pairs = minor.join(every, (F.col("probe") == F.col("probe2")) & once & near(percent, most, longs) & differ_little(percent) & in_one_place())
    return pairs.select(F.least("mark", "mark2").alias("a"), F.greatest("mark", "mark2").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int, few: int = 500_000) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity. ``sets``: (mark, key and text_mark of a row that has it).

    Up to ``few`` names of rows, some 30 bytes each, are broadcast so that the texts stay where they lie; more are joined by a shuffle.
    """
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, kept = Hashes(), None, None
        for frame in frames:
            ok = []
            for b, x, y in zip(frame["b"].tolist(), frame["text_a"], frame["text_b"]):
                if b != last:
                    last, kept = b, distinct_shingles(y, hashes, size)
                own = distinct_shingles(x, hashes, size)
                both = len(np.intersect1d(own, kept, assume_unique=True))
                ok.append(100 * both >= percent * (len(own) + len(kept) - both))
            yield frame.loc[ok, ["a", "b"]]

    marks = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    wanted = durable(marks.join(sets, "mark").select("mark", "key", "text_mark"), "wanted-sets")
    named = docs.select(key_of().alias("key"), text_mark().alias("text_mark"), "text")
    found = named.join(F.broadcast(wanted) if wanted.count() <= few else wanted, ["key", "text_mark"])
    texts = durable(found.groupBy("mark").agg(F.min("text").alias("text")), "texts-of-sets")
    one = pairs.join(texts.select(F.col("mark").alias("a"), F.col("text").alias("text_a")), "a")
    return one.join(texts.select(F.col("mark").alias("b"), F.col("text").alias("text_b")), "b").select(
        "a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, chunks: int = 16, width: int = 5, errors: int = 1,
                    turns: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group) per row: the set's size, the least doc_id reachable by links, whether the row has it, and a
    name of its group, null without shingles."""
    most, longs = chunks * (errors + 1) - 1, -(-chunks * width // 16)
    rows = durable(describe(docs, size, chunks * width), "signatures")
    sets = rows.where("n > 0").groupBy("mark").agg(F.min(F.struct("key", "text_mark")).alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("map").alias("map"))
    sets = durable(sets.select("mark", "n", "signature", "map", "least.*"), "distinct-sets")
    book = durable(posted(sets, chunks, width, errors), "probes")
    # the first probes of a set, one a chunk, leave the same places out
    postings = book.select("mark", "left", F.posexplode("probes").alias("pos", "probe")).select("mark", "probe", F.get("left", "pos").alias("left"))
    counts = postings.groupBy("probe").agg(F.count("*").alias("members")).where("members > 1")
    shared = durable(postings.join(counts, "probe"), "shared-probes")
    weights = shared.groupBy("mark").agg(F.sum("members").alias("weight"))
    facts = durable(weights.join(book.select("mark", "n", "whole", *[F.col("sketch")[i].alias(f"s{i}_") for i in range(longs)], *[F.col("map")[i].alias(f"p{i}_") for i in range(MAP)]),
                                 "mark"), "posted-sets")

    central = durable(to_heaviest(shared, facts, percent, most, longs), "central-pairs")
    links = durable(verified(central, docs, sets, size, percent), "central-links")
    mixed, tested = durable(mixed_probes(shared, components(links)), "mixed-probes"), central
    for turn in range(turns):
        drawn = durable(to_drawn(mixed, facts, turn, percent, most, longs).join(tested, ["a", "b"], "left_anti"), "drawn-pairs")
        links = links.unionByName(durable(verified(drawn, docs, sets, size, percent), "drawn-links"))
        mixed, tested = durable(mixed_probes(mixed, components(links)), "mixed-probes"), tested.unionByName(drawn)
    rest = durable(across(mixed, facts, percent, most, longs), "open-pairs").join(tested, ["a", "b"], "left_anti")
    links = links.unionByName(durable(verified(rest, docs, sets, size, percent), "other-links"))

    named = sets.select("mark", "key").join(components(links).withColumnRenamed("node", "mark"), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
    least = named.groupBy("label").agg(F.min("key").alias("component"))
    of_set = named.join(least, "label").select(F.col("mark").alias("set"), "component", F.col("label").alias("group"))
    found = rows.withColumn("set", F.when(F.col("n") > 0, F.col("mark"))).join(of_set, "set", "left").withColumn("component", F.coalesce("component", "key"))
    return found.select(id_of().alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(LAST)).alias("component_id"),
                        (F.col("key") == F.col("component")).alias("kept"), "group")
