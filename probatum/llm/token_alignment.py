"""Cross-tokenizer alignment: which tokens of two tokenizers share the bytes of a text, and in how many documents.

A text is encoded by a byte-level BPE (A) and a piece model (B). Byte offsets at which tokens of both end cut it into groups; the tokens of
a group are linked, each with each. Most groups hold one A token and one B token of the same bytes. For these an identity map (A id to the
B id of the same bytes) is worked out once, and documents that hold such a pair are counted in a vector as long as A's vocabulary, one per
task. Only pairs that the map does not hold enter a shuffle, folded to one row per block of documents and pair.

The texts are read and encoded once. A block of about ``block_bytes`` keeps what its documents need for their sums: the A ids of the mapped
pairs and, for the rest, places in the block's list of distinct pairs. Totals come back to the blocks by a join; the vectors of mapped totals and of
the highest count of each A id are broadcast, their size being that of the vocabulary.

A document without tokens (null or empty text, or one that a tokenizer does not give back byte by byte) has zeros and an empty string of
groups. Rows that repeat a doc_id are separate documents; a missing doc_id stays missing. Long groups are linked by their distinct ids
with multiplicities, never occurrence by occurrence.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import durable, id_of, key_of

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
STEP_BYTES = 2 << 20
SLICES = 16
LONG = 1 << 12
#: Fixed value: how byte-level BPE cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = "block string, kind string, slice int, numbers binary, hashes binary, direct binary, codes binary, entries binary"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the map of A ids to B ids of the same bytes."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        said = json.loads(byte_bpe)
        if said["model"]["type"] != "BPE" or said["normalizer"] or said["pre_tokenizer"]["type"] != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        letters, special = byte_letters(), {x["content"] for x in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in said["model"]["vocab"].items() if word not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.a_bytes[i] = word
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(pieces, single)]
        self.a_length, self.b_length = (np.array([len(x) for x in words], np.int64) for words in (self.a_bytes, self.b_bytes))
        by_bytes = {x: i for i, (x, one) in enumerate(zip(self.b_bytes, single)) if not one and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        names_a, names_b = ([str(i) for i in range(len(words))] for words in (self.a_bytes, self.b_bytes))
        self.names = [n + end for names, end in ((names_a, ","), (names_a, "|"), (names_b, ","), (names_b, ";")) for n in names]

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """(place, A ids, B ids) of the texts that both tokenizers give back byte by byte."""
        filled = [i for i, t in enumerate(texts) if t]
        places, a_ids, b_ids = [], [], []
        for i, b in zip(filled, self.b.encode([texts[i] for i in filled], num_threads=1)):
            whole = " " + texts[i]
            a, raw = self.a.encode_ordinary(whole), whole.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                places.append(i)
                a_ids.append(np.array(a, np.int64))
                b_ids.append(np.array(b, np.int64))
        return places, a_ids, b_ids


def repeated_ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of several ranges, one after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


class Aligned:
    """The groups of some documents, numbered through all of them, and their links."""

    def __init__(self, tokenizers: Tokenizers, a_ids: list[np.ndarray], b_ids: list[np.ndarray]):
        t, self.a, self.b = tokenizers, np.concatenate(a_ids), np.concatenate(b_ids)
        a_end, b_end = np.cumsum(t.a_length[self.a]) - 1, np.cumsum(t.b_length[self.b]) - 1
        mark = np.zeros(int(a_end[-1]) + 1, np.uint8)
        mark[a_end] = 1
        mark[b_end] |= 2
        groups = np.cumsum(mark == 3) - (mark == 3)
        self.group_a, self.group_b = groups[a_end], groups[b_end]
        self.n_a, self.n_b = np.bincount(self.group_a), np.bincount(self.group_b)
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        # documents end where tokens of both end, so that no group crosses one
        self.last_a, self.last_b = np.cumsum([len(x) for x in a_ids]), np.cumsum([len(x) for x in b_ids])
        self.document = np.searchsorted(self.last_a, self.first_a, "right")
        lone = (self.n_a == 1) & (self.n_b == 1)
        self.mapped = lone & (t.same[self.a[self.first_a]] == self.b[self.first_b])

    def numbers(self) -> np.ndarray:
        """Per document: A tokens, B tokens, groups, links."""
        n = len(self.last_a)
        links = np.zeros(n, np.int64)
        np.add.at(links, self.document, self.n_a * self.n_b)
        return np.stack([np.diff(self.last_a, prepend=0), np.diff(self.last_b, prepend=0), np.bincount(self.document, minlength=n), links], axis=1)

    def written(self, names: list[str], size_a: int, size_b: int) -> Iterator[str]:
        """The groups of each document as text."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        ends_a, ends_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        ends_a[self.first_a + self.n_a - 1] = ends_b[self.first_b + self.n_b - 1] = True
        out[np.arange(len(self.a)) + self.first_b[self.group_a]] = self.a + size_a * ends_a
        out[np.arange(len(self.b)) + (self.first_a + self.n_a)[self.group_b]] = self.b + 2 * size_a + size_b * ends_b
        at = 0
        for end in (self.last_a + self.last_b).tolist():
            yield "".join(map(names.__getitem__, out[at:end].tolist()))[:-1]
            at = end

    def direct(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, A id) of every mapped pair that is a group."""
        return self.document[self.mapped], self.a[self.first_a[self.mapped]]

    def rest(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair code, times) of the links of all other groups, each pair of a document once."""
        every = self.n_a * self.n_b
        short = np.flatnonzero(~self.mapped & (every <= LONG))
        a_at = repeated_ranges(self.first_a[short], self.n_a[short])
        group = np.repeat(short, self.n_a[short])
        times = self.n_b[group]
        code = np.repeat(self.a[a_at], times) * size_b + self.b[repeated_ranges(self.first_b[group], times)]
        found = [(np.repeat(self.document[group], times), code, np.ones(len(code), np.int64))]
        for g in np.flatnonzero(~self.mapped & (every > LONG)):
            a, a_times = np.unique(self.a[self.first_a[g]:self.first_a[g] + self.n_a[g]], return_counts=True)
            b, b_times = np.unique(self.b[self.first_b[g]:self.first_b[g] + self.n_b[g]], return_counts=True)
            code = (a[:, None] * size_b + b).ravel()
            found.append((np.full(len(code), self.document[g]), code, (a_times[:, None] * b_times).ravel()))
        document, code, times = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((code, document))
        document, code, times = document[order], code[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (document[1:] != document[:-1])])) if len(code) else np.empty(0, np.int64)
        return document[new], code[new], np.add.reduceat(times, new) if len(new) else times


class Block:
    """What is kept of the documents of a block."""

    def __init__(self):
        self.size, self.numbers, self.hashes, self.direct, self.rest, self.documents = 0, [], [], [], [], 0

    def add(self, numbers, hashes, direct, rest, size: int) -> None:
        self.numbers.append(numbers)
        self.hashes += hashes
        self.direct.append((direct[0] + self.documents, direct[1]))
        self.rest.append((rest[0] + self.documents, rest[1], rest[2]))
        self.documents += len(hashes)
        self.size += size

    def row(self, same: np.ndarray, size_b: int) -> pd.DataFrame:
        pack = zstandard.ZstdCompressor(level=1).compress
        direct = np.concatenate([x for _, x in self.direct])
        document, code, times = (np.concatenate(x) for x in zip(*self.rest))
        distinct, where, held = np.unique(code, return_inverse=True, return_counts=True)
        shuffled = same[distinct // size_b] != distinct % size_b
        numbers = np.concatenate([np.concatenate(self.numbers), np.bincount(np.concatenate([d for d, _ in self.direct]), minlength=self.documents)[:, None],
                                  np.bincount(document, minlength=self.documents)[:, None]], axis=1).astype(np.int64)
        entries = np.stack([where.astype(np.int64), times])
        codes = np.stack([distinct, np.where(shuffled, held, 0)])
        return pd.DataFrame([(uuid.uuid4().hex, "block", 0, pack(numbers.tobytes()), b"".join(self.hashes), pack(direct.astype(np.uint32).tobytes()),
                              pack(codes.tobytes()), pack(entries.tobytes()))], columns=[c.split()[0] for c in BLOCK.split(", ")])


def _unpack(raw: bytes, kind, rows: int = 0) -> np.ndarray:
    found = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)
    return found.reshape(rows, -1) if rows else found


def encode_blocks(docs: DataFrame, tokenizers, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents, and per task the counts of mapped pairs in ``SLICES`` slices."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Tokenizers(*tokenizers.value)
        size_a, size_b = len(t.a_bytes), len(t.b_bytes)
        counts, block = np.zeros(size_a, np.int64), Block()
        for frame in frames:
            keys, texts = frame["key"].to_numpy(np.int64), frame["text"].tolist()
            big = np.cumsum([len(x) if x else 0 for x in texts]) // STEP_BYTES
            for _, step in itertools.groupby(range(len(texts)), big.tolist().__getitem__):
                step = list(step)
                places, a_ids, b_ids = t.encode([texts[i] for i in step])
                numbers = np.zeros((len(step), 5), np.int64)
                numbers[:, 0] = keys[step]
                hashes, direct, rest = [b"\0" * 32] * len(step), (np.empty(0, np.int64),) * 2, (np.empty(0, np.int64),) * 3
                if places:
                    found, where = Aligned(t, a_ids, b_ids), np.array(places)
                    numbers[where, 1:] = found.numbers()
                    for i, text in zip(places, found.written(t.names, size_a, size_b)):
                        hashes[i] = hashlib.sha256(text.encode()).digest()
                    direct, rest = found.direct(), found.rest(size_b)
                    direct, rest = (where[direct[0]], direct[1]), (where[rest[0]], *rest[1:])
                    own = rest[1] // size_b
                    inside = t.same[own] == rest[1] % size_b
                    once = np.unique(np.concatenate([direct[0] * size_a + direct[1], rest[0][inside] * size_a + own[inside]]))
                    counts += np.bincount(once % size_a, minlength=size_a)
                block.add(numbers, hashes, direct, rest, sum(len(texts[i] or "") for i in step))
                if block.size >= block_bytes:
                    yield block.row(t.same, size_b)
                    block = Block()
        if block.documents:
            yield block.row(t.same, size_b)
        for i, part in enumerate(np.array_split(counts, SLICES)):
            if part.any():
                yield pd.DataFrame([("", "counts", i, part.tobytes(), b"", b"", b"", b"")], columns=[c.split()[0] for c in BLOCK.split(", ")])

    return docs.select(key_of().alias("key"), "text").mapInPandas(read, BLOCK)


def mapped_counts(blocks: DataFrame, size_a: int) -> np.ndarray:
    """In how many documents each A id stands with its mapped B id: a vector as long as the vocabulary."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["numbers"]], axis=0)
        return pd.DataFrame([(pdf["slice"].iloc[0], total.tobytes())], columns=["slice", "numbers"])

    slices = np.array_split(np.zeros(size_a, np.int64), SLICES)
    for i, raw in blocks.where("kind = 'counts'").groupBy("slice").applyInPandas(add, "slice int, numbers binary").collect():
        slices[i] = np.frombuffer(raw, np.int64)
    return np.concatenate(slices)


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, place, code, documents) of each pair of a block that the identity map does not hold."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, raw in zip(frame["block"], frame["codes"]):
                codes, held = _unpack(raw, np.int64, 2)
                place = np.flatnonzero(held)
                yield pd.DataFrame({"block": block, "place": place.astype(np.int32), "code": codes[place], "documents": held[place]})

    return blocks.where("kind = 'block'").select("block", "codes").mapInPandas(read, "block string, place int, code long, documents long")


def align_documents(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); and the table of pairs (a, b, documents).

    The tokenizers' files are read here and sent to the tasks.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (byte_bpe, piece_bpe)))
    t = Tokenizers(*held.value)
    size_a, size_b, same = len(t.a_bytes), len(t.b_bytes), t.same
    blocks = durable(encode_blocks(docs, held, block_bytes), "aligned-blocks")
    counts = mapped_counts(blocks, size_a)
    places = pair_rows(blocks)
    totals = durable(places.groupBy("code").agg(F.sum("documents").alias("total")), "pair-totals")
    best = counts.copy()
    for a, most in totals.groupBy(F.floor(F.col("code") / size_b).alias("a")).agg(F.max("total")).collect():  # as many rows as A has ids at most
        best[a] = max(best[a], most)
    vectors = spark.sparkContext.broadcast((counts, best))

    # fewer rows than a block has distinct pairs; a pair of many blocks is split by Spark's skew join
    back = places.select("block", "place", "code").join(totals, "code").groupBy("block").agg(F.collect_list(F.struct("place", "total")).alias("found"))
    joined = blocks.where("kind = 'block'").select("block", "numbers", "hashes", "direct", "codes", "entries").join(back, "block", "left").select(
        "numbers", "hashes", "direct", "codes", "entries", F.col("found.place").alias("places"), F.col("found.total").alias("totals"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best = vectors.value
        for frame in frames:
            for numbers, hashes, direct, codes, entries, at, total in frame.itertuples(index=False):
                numbers, direct = _unpack(numbers, np.int64).reshape(-1, 7), _unpack(direct, np.uint32)
                codes, where = _unpack(codes, np.int64, 2)[0], _unpack(entries, np.int64, 2)
                a, value = codes // size_b, np.zeros(len(codes), np.int64)
                own = same[a] == codes % size_b
                value[own] = counts[a[own]]
                if at is not None:
                    value[np.asarray(at, np.int64)] = np.asarray(total, np.int64)
                document = np.repeat(np.arange(len(numbers)), numbers[:, 5])
                other = np.repeat(np.arange(len(numbers)), numbers[:, 6])
                sums, tops = np.zeros((2, len(numbers)), np.int64)
                np.add.at(sums, document, counts[direct])
                np.add.at(tops, document, counts[direct] == best[direct])
                np.add.at(sums, other, value[where[0]] * where[1])
                np.add.at(tops, other, (value == best[a])[where[0]] * where[1])
                yield pd.DataFrame({"key": numbers[:, 0], **{c: numbers[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"), 1)}, "n_best": tops, "count_sum": sums,
                                    "groups_sha256": [hashes[i:i + 32].hex() if n else "" for i, n in zip(range(0, len(hashes), 32), numbers[:, 1].tolist())]})

    done = joined.mapInPandas(finish, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    ids = np.flatnonzero(counts)
    mapped = spark.createDataFrame(pd.DataFrame({"a": ids, "b": same[ids], "documents": counts[ids]}), "a long, b long, documents long")
    pairs = totals.select(F.floor(F.col("code") / size_b).alias("a"), F.pmod("code", F.lit(size_b)).alias("b"), F.col("total").alias("documents")).unionByName(mapped)
    return done.select(id_of().alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs
