"""Token alignment, the signature join and hard negatives against plain versions, on awkward rows."""

import bisect
import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from probatum.llm import minhash_join
from probatum.llm import token_alignment as alignment
from probatum.llm.common import Hashes, mix
from probatum.llm.hard_negatives import Best, Lists, build_lists, mine_negatives, shifted_labels, usable
from probatum.llm.minhash_join import distinct_shingles, near_duplicates, parity, probes, signatures, sketches
from probatum.llm.token_alignment import BYTE_BPE, PIECE_BPE, Aligned, Tokenizers, align_documents

DOCS = "doc_id long, text string, key long, block string, mark long, label int, signature string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in texts], DOCS).repartition(5)


# token alignment

@pytest.fixture(scope="module")
def tokenizers():
    return Tokenizers(open(BYTE_BPE, "rb").read(), open(PIECE_BPE, "rb").read())


def awkward_texts():
    rng = random.Random(5)
    letters = [*range(32, 127), *range(160, 0x250), 0x4E2D, 0x6587, 0x1F389, 10, 9, 32, 32, 32]
    out = [None, "", " ", "a", "<|endoftext|> x <s> </s> <0x41>", "a\0b", "▁x", "é" * 5, " \n\t x", "a" * 3000, "日本語 テスト 🎉🎉", "﻿z", "x" * 50 + "é" * 400]
    out += ["".join(chr(rng.choice(letters)) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    return out + ["the same words over and over again"] * 3 + ["The committee's internationalization of pseudorandomness, reconsidered."]


def plain_alignment(texts, t):
    whole = Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    found = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        if not text or b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
            found.append(None)
            continue
        ends = [list(itertools.accumulate(len(table[i]) for i in ids)) for table, ids in ((t.a_bytes, a), (t.b_bytes, b))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, end in zip(ids, ends[side]):
                groups[bisect.bisect_left(cuts, end)][side].append(i)
        found.append((a, b, groups, [(x, y) for xs, ys in groups for x in xs for y in ys]))
    counts = collections.Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest()))
    return out, counts


def test_tokenizer_from_ranks_equals_the_file(tokenizers):
    whole = Tokenizer.from_file(BYTE_BPE)
    whole.encode_special_tokens = True
    for text in awkward_texts():
        if text:
            assert tokenizers.a.encode_ordinary(" " + text) == whole.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("block_bytes", [300, 8 << 20])
def test_alignment_equals_plain_version(spark, tokenizers, block_bytes):
    texts = awkward_texts()
    want, counts = plain_alignment(texts, tokenizers)
    got, pairs = align_documents(frame(spark, enumerate(texts)), block_bytes=block_bytes)
    rows = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == want
    assert {(r.a, r.b): r.documents for r in pairs.collect()} == dict(counts)


def test_alignment_of_repeated_missing_ids_and_nothing(spark):
    got, _ = align_documents(frame(spark, [(1, "some words"), (1, "some words"), (None, "other"), (None, None)]))
    assert sorted((r.doc_id is None, r.n_links > 0) for r in got.collect()) == [(False, True), (False, True), (True, False), (True, True)]
    assert align_documents(frame(spark, []))[0].collect() == []


def test_long_groups_are_linked_by_distinct_ids():
    class Two:
        a_length, b_length, same = np.array([2, 4]), np.array([1, 3]), np.full(2, -1)

    # one A token of 2 bytes, then 4 bytes each; B: 3 bytes each, then 1 byte: ends agree every 12 bytes, or at the end only
    a, b = np.array([0] + [1] * 299), np.array([1] * 399 + [0])
    Two.b_length = np.array([1, 3])
    assert Two.a_length[a].sum() == Two.b_length[b].sum()
    found = Aligned(Two(), [a], [b])
    assert (found.n_a * found.n_b).sum() == found.numbers()[0, 3]
    whole = Aligned(Two(), [a[:1].repeat(200)], [np.array([0] + [1] * 133)])
    for one in (found, whole):
        plain = collections.Counter()
        for g in np.flatnonzero(~one.mapped):
            for x in one.a[one.first_a[g]:one.first_a[g] + one.n_a[g]].tolist():
                for y in one.b[one.first_b[g]:one.first_b[g] + one.n_b[g]].tolist():
                    plain[2 * x + y] += 1
        limit = alignment.LONG
        try:
            alignment.LONG = 3
            long = one.rest(2)
        finally:
            alignment.LONG = limit
        assert dict(zip(one.rest(2)[1].tolist(), one.rest(2)[2].tolist())) == dict(plain) == dict(zip(long[1].tolist(), long[2].tolist()))


# signature join

def plain_components(texts, percent=80, size=2):
    sets = []
    for _, text in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append(frozenset(tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset())
    keys = [(1 << 63) - 1 if i is None else i for i, _ in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        least[root(i)] = min(least.get(root(i), 1 << 63), k)
    out = []
    for i, k in enumerate(keys):
        c = least[root(i)]
        out.append((texts[i][0], len(sets[i]), None if c == (1 << 63) - 1 else c, c == k))
    return sorted(out, key=repr)


def near_texts():
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    out = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, " \t"), (6, "one"), (7, "ONE"), (8, "one two"), (9, "one  two"), (None, " ".join(base)), (None, None),
           (9, "one two three"), (9, "one two"), (-4, "one two three")]
    for i in range(150):  # variants of one text, more and less alike
        words = list(base)
        for _ in range(rng.randrange(1, 12)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        out.append((100 + i, " ".join(words)))
    shared = " ".join(f"s{rng.randrange(300)}" for _ in range(60))
    out += [(400 + i, f"{shared} " + " ".join(f"t{rng.randrange(500)}" for _ in range(rng.randrange(4, 40)))) for i in range(60)]
    chain = [f"c{i}" for i in range(100)]
    out += [(600 + i, " ".join(chain[i:i + 60])) for i in range(40)]
    return out + [(900, " ".join(f"x{rng.randrange(5000)}" for _ in range(30_000)))]


def test_near_duplicates_equal_plain_version(spark):
    texts = near_texts()
    got = near_duplicates(frame(spark, texts)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == plain_components(texts)
    assert near_duplicates(frame(spark, [])).collect() == []


def test_variants_meet_few_sets_of_each_other_component(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(200):  # about half of all pairs link, and a set that misses the centre has a hundred others to link with
        words = [f"w{j}" for j in range(300)]
        for j in rng.sample(range(300), rng.randint(8, 10)):
            words[j] = f"x{i}.{j}"
        rows.append((i, " ".join(words)))
    compared, whole = [], minhash_join.verified
    monkeypatch.setattr(minhash_join, "verified", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == plain_components(rows)
    assert sum(compared) < 1500


def test_signatures_within_the_distance_share_a_probe():
    rng = np.random.default_rng(2)
    chunks, width, errors = 16, 5, 1
    base = rng.integers(0, 1 << 16, (400, chunks * width)).astype(np.uint16)
    other = base.copy()
    for row in other:  # as many differences as are allowed, spread as badly as they can be
        at = np.concatenate([rng.permutation(width)[:2] + width * c for c in range(chunks)])[:-1] if rng.random() < 0.5 else rng.permutation(chunks * width)[:31]
        row[at] += np.uint16(1)
    assert ((base != other).sum(1) <= 31).all()
    a, b = probes(base, chunks, width, errors), probes(other, chunks, width, errors)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    x = sketches(base) ^ sketches(other)
    close = sum(((x[:, i:i + 1] >> np.arange(0, 64, 4)) & 15 != 0).sum(1) for i in range(x.shape[1]))
    assert (close <= (base != other).sum(1)).all()


def test_parity_maps_never_tell_more_than_the_sets():
    rng = np.random.default_rng(6)
    for n in (1, 5, 150, 3000):
        u = mix(rng.integers(1, 1 << 63, n + n // 4, dtype=np.uint64))
        a, b = u[:n], u[n // 4:]
        assert np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum() <= 2 * (n // 4)


def test_places_differ_as_often_as_sets_do():
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(400):
        u = mix(rng.integers(1, 1 << 63, 100).astype(np.uint64))
        pairs += [u[:90], u[10:]]
    s = signatures(pairs, 80)
    far = (s[::2] != s[1::2]).sum(1)
    assert abs(far.mean() - 16) < 0.6 and far.max() <= 31
    assert len(distinct_shingles("a b a b a", Hashes(), 2)) == 2


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, key long, q string, score int"


def plain_negatives(rows, every=100, k=5):
    def usable_row(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if usable_row(v, label)]
    last = (1 << 63) - 1
    out = []
    for n, (anchor, q, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, other)), last if i is None else i, other_label == label) for m, (i, other, other_label) in enumerate(rows) if m != n))
        for minus, positive, _ in [s for s in scored if s[2]][:k]:
            inside = [(-s, i) for s, i, same in scored if not same and 80 * -minus <= 100 * -s <= 100 * -minus]
            out += [(anchor, None if positive == last else positive, r, None if i == last else i, -minus, s) for r, (s, i) in enumerate(inside[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed, n=260, width=6):
    rng = random.Random(seed)
    rows = [(i * 20, [round(rng.gauss(0, 0.4), 2) for _ in range(width)], rng.randrange(3)) for i in range(n)]
    rows += [(100, None, 1), (200, [float("nan")] * width, 1), (300, [None] * width, 1), (400, [float("inf")] * width, 2), (500, [0.1] * width, None), (600, [], 1),
             (700, [0.25] * width, 1), (700, [0.25] * width, 1), (705, [0.25] * width, 1), (706, [0.25] * width, 2), (707, [0.25] * width, 2), (None, [0.25] * width, 1), (None, [0.25] * width, 2),
             (800, [0.5, 0.5], 1), (900, [0.0] * width, 0), (1000, [1.0] * (width + 2), 2), (-100, [0.3] * width, 1)]
    return rows


@pytest.mark.parametrize("seed,block_rows,anchor_bytes", [(1, 8192, 4 << 20), (2, 7, 300), (3, 64, 2000)])
def test_negatives_equal_plain_version(spark, seed, block_rows, anchor_bytes):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], VECTORS).repartition(3)
    got = mine_negatives(df, block_rows=block_rows, anchor_bytes=anchor_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_negatives(rows)


def test_no_vectors_and_shifted_labels(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mine_negatives(none).collect() == []
    rows = [(r.vec_id, r.label) for r in shifted_labels(spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (None, [1.0], 4)], "vec_id long, embedding array<float>, label int")).collect()]
    assert rows == [(7, 0), (8, 9), (None, 4)]


def test_sorted_access_stops_early_and_bounds_what_is_left(spark):
    rng = np.random.default_rng(1)
    found = rng.normal(0, 0.1, (4000, 4))
    found[:40] += 3
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(found)], "vec_id long, embedding array<float>, label int").coalesce(1)
    block = Lists(*build_lists(usable(df)).first())
    anchor, met, best = np.array([256, 128, 64, 32]), 0, Best(5)
    every = block.scores(np.arange(len(block.keys)), anchor)
    seen = np.zeros(len(block.keys), bool)
    for places, scores, bound in block.access(anchor):
        met += len(places)
        seen[places] = True
        best.add(scores, block.keys[places])
        if bound is None:
            break
        assert every[~seen].max() <= bound
        if best.settled(bound):
            break
    assert met < len(block.keys) / 4
    assert best.key.tolist() == block.keys[np.lexsort((block.keys, -every))[:5]].tolist()
