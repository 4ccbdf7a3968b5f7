"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The word windows of all documents form the reference. It is indexed in blocks, one per range of window fingerprints, and
each block keeps the smallest document per window. Batches of documents send each of their distinct windows to its block
once, so copies are folded before anything moves, and get one bit back: some earlier document holds it. With these bits a
document is parsed greedily from left to right into literals and factors. A factor is copied from the reference and grows while the
window that ends at its next word is in it too; where it stops, the windows across the boundary are checked one by one. Factors of
``size`` words or more are duplicate spans.

Fingerprints are 64 bits wide. A missing text is empty. A missing doc_id counts as the largest. Rows that repeat a doc_id are
judged separately and are not earlier than each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import BITS, Hashes, batched, edges, id_of, in_order, shares, text_bytes, windows, words

BATCH_BYTES, BLOCK_BYTES = 6 << 20, 16 << 20  # text whose windows a batch sends, and a reference block holds


class Batch:
    """The windows of a batch of documents, each distinct one once, with the first document that holds it."""

    def __init__(self, pdf: pd.DataFrame, size: int):
        self.rows = in_order(pdf)
        hashes = Hashes()
        self.words = [words(t) for t in self.rows["text"]]
        found = [windows(hashes.of(w), size) for w in self.words]
        self.counts = np.array([len(w) for w in found], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(found)), self.counts)
        flat = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.distinct, first, self.where = np.unique(flat, return_index=True, return_inverse=True)
        self.keys = self.rows["key"].to_numpy(np.int64)
        self.first = self.keys[self.owner[first]] if len(first) else np.empty(0, np.int64)

    def earlier(self, known: np.ndarray) -> list[np.ndarray]:
        """Per document, which of its windows start in an earlier document; ``known``: those found in other batches."""
        seen = known[self.where] | (self.keys[self.owner] > self.first[self.where]) if len(self.where) else np.empty(0, bool)
        return np.split(seen, np.cumsum(self.counts)[:-1]) if len(self.counts) else []


def parse(hits: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Greedy factors (start, end in words) of a text whose windows ``hits`` are in the reference."""
    if not hits.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
    factors: list[tuple[int, int]] = []
    for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
        end = stop - 1 + size
        if factors and start <= factors[-1][1]:  # windows on both sides of the boundary are in the reference: one span
            factors[-1] = (factors[-1][0], end)
        else:
            factors.append((start, end))
    return factors


def by_owner(owner: np.ndarray, owners: int) -> np.ndarray:
    """The order that puts the windows of one document next to each other."""
    return np.argsort(owner.astype(np.uint16) if owners <= 1 << 16 else owner, kind="stable")


def dedup_substrings(docs: DataFrame, size: int = 13, batch_bytes: int = BATCH_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans of removed words, kept text) per row; kept words are joined by one space."""
    spark, total = docs.sparkSession, text_bytes(docs)
    parts = shares(spark, total, block_bytes)
    dealt = batched(docs, shares(spark, total, batch_bytes))

    def pieces(batch):
        """(block, from, to, order, owners' places) of the batch's distinct windows."""
        cut = edges(batch.distinct, parts)
        who, local = np.unique(batch.first, return_inverse=True)
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if b > a:
                yield i, a, b, by_owner(local[a:b], len(who)), who, local[a:b]

    def send(pdf):
        batch, number, rows = Batch(pdf, size), int(pdf["batch"].iloc[0]), []
        for i, a, b, order, who, local in pieces(batch):
            count = np.bincount(local, minlength=len(who))
            some = np.flatnonzero(count)
            rows.append((number, i, batch.distinct[a:b][order].tobytes(), who[some].tobytes(), count[some].astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "part", "hashes", "who", "counts"])

    def look_up(pdf):
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        owner = np.concatenate([np.repeat(np.frombuffer(w, np.int64), np.frombuffer(n, np.uint32)) for w, n in zip(pdf["who"], pdf["counts"])])
        order = np.lexsort((owner, h))
        h, owner_sorted = h[order], owner[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        least = owner_sorted[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.empty(len(h), bool)
        hit[order] = owner_sorted > least
        at, rows = 0, []
        for batch, part, x in zip(pdf["batch"], pdf["part"], pdf["hashes"]):
            n = len(x) // 8
            if (own := hit[at:at + n]).any():
                rows.append((batch, part, "first", np.packbits(own).tobytes()))
            at += n
        return pd.DataFrame(rows, columns=["batch", "part", "kind", "bits"])

    def rebuild(pdf, bits):
        if not len(pdf):
            return pd.DataFrame(columns=["key", "n_words", "spans", "kept"])
        batch = Batch(pdf, size)
        known, answer = np.zeros(len(batch.distinct), bool), dict(zip(bits["part"], bits["bits"]))
        for i, a, b, order, _, _ in pieces(batch):
            if i in answer:
                known[a + order] = np.unpackbits(np.frombuffer(answer[i], np.uint8))[:b - a]
        out = []
        for key, own, hits in zip(batch.keys, batch.words, batch.earlier(known)):
            spans = parse(hits, size)
            kept, at = [], 0
            for a, b in spans:
                kept += own[at:a]
                at = b
            out.append((key, len(own), spans, b" ".join(kept + own[at:])))
        return pd.DataFrame(out, columns=["key", "n_words", "spans", "kept"])

    blocks = dealt.groupBy("batch").applyInPandas(send, "batch int, part int, hashes binary, who binary, counts binary")
    answers = blocks.groupBy("part").applyInPandas(look_up, BITS)
    done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(
        rebuild, "key long, n_words long, spans array<struct<start:long,end:long>>, kept binary")
    return done.select(id_of().alias("doc_id"), "n_words", "spans", F.decode("kept", "UTF-8").alias("kept"))
