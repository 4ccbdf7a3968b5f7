"""Each training-data operator against a plain version, on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import collections
import hashlib
import html
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from probatum.llm import attention, suffix_index
from probatum.llm.common import words
from probatum.llm.components import components
from probatum.llm.lempel_ziv import dedup_substrings
from probatum.llm.lm_scoring import IDS, MARKS, TOKENIZER, Batch, averaged, choose_classes, co_occurrence, encoding, end_ids, improve, numbered, remembered, score_texts
from probatum.llm.mixing import mixture, plan_mixture
from probatum.llm.nbsvm import judge
from probatum.llm.ngram_join import far_apart, join_documents
from probatum.llm.positional import build_index, decontaminate, phrase_matches, proximity_matches
from probatum.llm.rule_ledger import ablation, apply_policy, ledger
from probatum.llm.suffix_index import Family, Level, dedup_suffixes, least_in_windows
from probatum.llm.template import Reader, extract_articles
from probatum.llm.url_rules import judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, part string, score double"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=3):
    """(doc_id, text): copies, near copies, shared passages, a hot passage, nulls, blanks, accents, a very long text, repeated rows."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    shared, hot = prose(rng, 90), prose(rng, 70)
    out = [(1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "one  two"),
           (10, prose(rng, 30) + "\n" + shared + " tail"), (11, "Über ño " + shared + " ende é"), (12, shared[3:] + prose(rng, 40)),
           (13, prose(rng, 20_000)), (14, "ab" * 900), (15, "x" + "ab" * 700), (16, "é" * 450 + "z"), (17, "\xa0 " + "ñ é " * 200)]
    out += [(100 + i, f"{prose(rng, 15)} {hot} {prose(rng, 15)}") for i in range(30)]
    out += [(200, base), (200, base), (200, shared), (None, base), (None, None), (-5, shared + " " + hot)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{i % 4}" if i % 7 else None, 1, 0, "p", 0.5) for i, (d, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_sorted(rows):
    return sorted(rows, key=repr)


def test_join_finds_all_links(docs, none):
    found = join_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    rows = corpus()
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    key = lambda d: (d is None, d or 0)
    want = [(d, len(s), min((rows[j][0] for j in range(len(rows)) if group[j] == group[i]), key=key)) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    assert as_sorted(map(tuple, found)) == as_sorted(want)
    assert join_documents(none).collect() == []


def test_join_links_a_large_group_of_near_copies(spark):
    """A chain of texts each like the next: one component, found without listing its pairs."""
    rng = random.Random(1)
    words = prose(rng, 60).split()
    texts = []
    for i in range(80):
        words[rng.randrange(60)] = f"n{i}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in texts]
    label = list(range(80))
    for i in range(80):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = {i: min(j for j in range(80) if label[j] == label[i]) for i in range(80)}
    assert {r.doc_id: r.component_id for r in join_documents(df).collect()} == want


def test_suffix_filter_never_overestimates():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(2))
        apart = len(np.setxor1d(x, y))
        assert not far_apart(x, y, apart)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (7, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_suffix_dedup(docs, none):
    rows = corpus()
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(raw[i:i + 400] for raw in raws for i in range(len(raw) - 399))
    want = []
    for (d, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 399):
            if seen[raw[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want.append((d, len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    for size in (12 << 20, 2000):
        got = [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in dedup_suffixes(docs, batch_bytes=size).collect()]
        assert as_sorted(got) == as_sorted(want)
    assert dedup_suffixes(none).collect() == []


def test_suffix_dedup_with_other_ranges_than_batches(docs):
    def rows(**sizes):
        return as_sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in dedup_suffixes(docs, **sizes).collect())
    assert rows(batch_bytes=1000, part_bytes=4000) == rows(batch_bytes=4000, part_bytes=1000) == rows()


def test_strings_looked_up_one_by_one_need_little_memory():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 1000)) for _ in range(100)]
    batch = suffix_index.Batch(pd.DataFrame({"key": range(100), "text": texts}), 400, 100)
    state = np.full(len(batch.level), suffix_index.PARTLY, np.uint8)[batch.entry]
    strings = sum(max(len(raw) - 399, 0) for raw in batch.raw)
    tracemalloc.start()
    found = suffix_index.Strings(batch, state)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.distinct) == strings
    assert most < 40 * strings, most / strings


def test_suffix_dedup_carries_columns(docs):
    got = dedup_suffixes(docs, carried=["lang", "source"], whole_characters=True).collect()
    assert all('"lang":"en"' in r.rest and bytes(r.kept).decode() is not None for r in got)


def test_index_family_has_few_levels():
    rng = np.random.default_rng(0)
    family, seen = Family(), collections.Counter()
    for _ in range(40):
        head = np.unique(rng.integers(0, 500, 50).astype(np.uint64))
        seen.update(head.tolist())
        family.add(Level(head, head * np.uint64(7), np.zeros(len(head), bool)))
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 8
    whole = family.states()
    assert {h: bool(s) for h, s in zip(whole.head.tolist(), whole.shared.tolist())} == {h: n > 1 for h, n in seen.items()}


def test_least_in_windows():
    rng = np.random.default_rng(0)
    h = (rng.integers(0, 6, 500).astype(np.uint64) << np.uint64(20)) + np.uint64(5)
    for width in (1, 2, 7, 33):
        want = [i + width - 1 - int(np.argmin((h[i:i + width] >> np.uint64(20))[::-1])) for i in range(len(h) - width + 1)]
        assert least_in_windows(h, width).tolist() == want


def test_substring_dedup(docs, none):
    rows = corpus()
    ids = [math.inf if d is None else d for d, _ in rows]
    texts = [(t or "").encode().split() for _, t in rows]
    first = {}
    for d, w in zip(ids, texts):
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            first[k] = min(first.get(k, math.inf), d)
    want = []
    for (d, _), own, w in zip(rows, ids, texts):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < own:
                gone[i:i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    for size in (6 << 20, 1000):
        got = [(r.doc_id, r.n_words, sum(b - a for a, b in r.spans), r.kept) for r in dedup_substrings(docs, batch_bytes=size, block_bytes=size).collect()]
        assert as_sorted(got) == as_sorted(want)
    assert dedup_substrings(none).collect() == []


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def test_decontamination(spark, docs, none):
    rows = corpus()
    items = [(1, rows[9][1]), (2, "one, two!"), (2, rows[0][1]), (3, None), (4, " -- "), (5, rows[0][1]), (10, "ño über"), (None, rows[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if w else ():
            wanted[tuple(w[i:i + k])].add("" if item is None else str(item))
    want = []
    for d, text in rows:
        w, found = words_of(text), set()
        hit = [False] * len(w)
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wanted:
                    hit[i:i + k] = [True] * k
                    found |= wanted[tuple(w[i:i + k])]
        want.append((d, len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    for size in (8 << 20, 300):  # one block of items, and several
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(docs, bench, block_bytes=size).collect()]
        assert as_sorted(got) == as_sorted(want)
    assert decontaminate(none, bench).collect() == []
    assert {r.n_hit for r in decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect()} == {0}


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a x b y c"), (3, "c b a"), (4, "a b"), (5, "c d")], "doc_id long, text string")
    index = build_index(docs, shard_words=6)
    items = spark.createDataFrame([(1, "a b c"), (2, "b c")], "item_id long, text string")
    found = lambda df: {r.doc_id: r["items"] for r in df.collect() if r["items"]}
    assert found(phrase_matches(index, items)) == {1: ["1", "2"]}
    assert found(proximity_matches(index, items, 0)) == {1: ["1", "2"]}
    assert found(proximity_matches(index, items, 1)) == {1: ["1", "2"], 2: ["2"]}
    assert found(proximity_matches(index, items, 2)) == {1: ["1", "2"], 2: ["1", "2"]}


def test_classifier_tells_classes_apart(spark, docs, none):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40) if i % 3 else " | ".join(prose(rng, 30).split())) for i in range(400)]
    table = spark.createDataFrame(rows + [(None, "x"), (1000, None), (1001, ""), (7, rows[7][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(5, None), (None, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    got = judge(table, labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in test) >= 0.95 * len(test)
    blank = {r.doc_id: r.score for r in got if r.doc_id in (1000, 1001)}
    assert blank[1000] == blank[1001]
    assert judge(none.select("doc_id", "text"), labels).collect() == []
    nothing = judge(table, labels.limit(0)).collect()
    assert len(nothing) == 404 and len({r.score for r in nothing}) == 1


def test_lm_scores(spark, docs, none):
    got = score_texts(docs, batch_bytes=20_000).collect()
    rows = corpus()
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    train = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    count = collections.Counter(w for t, own in zip(tokens, train) if own for w in t)
    n, v = sum(count.values()), len(count)
    want = [(d, not own, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))
            for (d, _), own, t in zip(rows, train, tokens)]
    assert as_sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == as_sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(none).collect() == []


def test_lm_fit_does_not_depend_on_settings(spark, docs):
    found, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(as_sorted((r.doc_id, r.n_tokens, round(r.score, 4)) for r in score_texts(docs, batch_bytes=40_000).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1]


def test_lm_classes_of_rare_ids():
    rng = np.random.default_rng(2)
    halves = rng.permutation(6000).reshape(2, 3000)  # two languages of 3,000 ids each, 30 of them common
    table = np.zeros((IDS, MARKS + 2))
    for i in range(1200):
        own = halves[i % 2]
        used, sums = co_occurrence(np.array([80]), np.concatenate([rng.choice(own[:30], 50), rng.choice(own, 30)]))
        table[used] += sums
    group = choose_classes(table) // attention.GROUPS
    counts = [np.bincount(group[half], minlength=attention.GROUPS) for half in halves]
    assert (table[:, 0] > 0).sum() > 5900 and np.minimum(*counts).sum() < 0.1 * 6000  # hardly a group holds ids of both


def test_lm_embeddings_are_trained_and_averaged_by_use(spark):
    start, rows = attention.Model(), []
    for ids, n in ((np.array([5, 6, 5, 5]), 4), (np.array([5, 7]), 2)):
        model = attention.Model()
        uses = improve(np.array([n]), ids, ids, np.zeros(IDS, np.int16), model)
        assert (model.first[ids] != start.first[ids]).any() and np.array_equal(model.first[9], start.first[9])
        rows.append((model, uses, n + 1))
    got = averaged(spark.createDataFrame([(m.vector().tobytes(), u.tobytes(), t) for m, u, t in rows], "vector binary, uses binary, tokens long"), start)
    (a, _, _), (b, _, _) = rows
    assert np.allclose(got.first[5], (3 * a.first[5] + b.first[5]) / 4, atol=1e-4)
    assert np.allclose(got.last[6], a.last[6], atol=1e-4) and np.allclose(got.first[7], b.first[7], atol=1e-4)
    assert np.allclose(got.out, (5 * a.out + 3 * b.out) / 8, atol=1e-4) and np.array_equal(got.first[9], start.first[9])


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(0)
    model, sizes = attention.Model(), np.array([50, 0, 7])
    first, last = rng.integers(0, 900, (2, 57))
    target = rng.integers(0, attention.CLASSES, 60).astype(np.int16)
    a, b, wanted, valid, _, _ = attention.windows_of(sizes, first, last, target)
    assert valid.sum() == 60 and np.array_equal(wanted[valid], target)  # every token once, in order
    total = sum(10 ** model.log10(a, b, np.full_like(wanted, c)) for c in range(attention.CLASSES))
    assert np.allclose(total[valid], 1, atol=1e-4)
    before = model.log10(a, b, wanted)[valid]
    later = first.copy()
    later[30:50] = 5
    a, b, wanted, valid, _, _ = attention.windows_of(sizes, later, last, target)
    assert np.allclose(model.log10(a, b, wanted)[valid][:31], before[:31], atol=1e-5)


def test_attention_gradients():
    rng = np.random.default_rng(1)
    model = attention.Model()
    data = attention.windows_of(np.array([5, 40]), rng.integers(0, 50, 45), rng.integers(0, 50, 45), rng.integers(0, 64, 47))[:4]
    grads, _ = model.gradients(*data, True)
    for name, g in grads.items():
        p = getattr(model, {"e_first": "first", "e_last": "last"}.get(name, name))
        at = np.unravel_index(np.argmax(np.abs(g)), p.shape)
        old, loss = p[at], []
        for step in (1e-2, -1e-2):
            p[at] = old + step
            loss.append(model.gradients(*data, False)[1])
        p[at] = old
        assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=0.05)


def test_lm_batch_hashes_each_distinct_word_once(monkeypatch):
    calls, real = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda word: calls.append(1) or real(word))
    many = " ".join(f"w{i}" for i in range(140_000))  # more than the remembered hashes of op1
    batch = Batch(pd.DataFrame({"key": [2, 1], "text": [many, many + " W7"], "batch": 0, "rest": ""}), 10)
    assert len(calls) == 140_000 and batch.sizes.tolist() == [140_001, 140_000]
    assert len(batch.distinct) == 140_000 and batch.distinct[batch.where[140_000]] == real(b"w7") and batch.found[batch.where[140_001]] == b"w0"


def test_lm_words_are_those_of_the_other_operators():
    rng = random.Random(5)
    texts = ["", " \t", "Ab aB", "\x1c x\x85y\xa0z\u2028 \x0b\x0cÑ É\x00"] + ["".join(rng.choices(" \t\n\x0b\x0c\r\x1cAbÑ\u3000\x00\U0001f600", k=30)) for _ in range(300)]
    for some in (texts, texts[:2], []):
        sizes, flat, found = numbered(some)
        assert [len(words(t, True)) for t in some] == sizes.tolist() and len(set(found)) == len(found)
        assert [w for t in some for w in words(t, True)] == [found[i] for i in flat]


def test_subword_ends():
    found = [b"hello", b"x", "ñandú".encode(), "a\xa0".encode(), b"!!", "\u2028".encode()]
    whole = end_ids(found, TOKENIZER)
    assert np.array_equal(whole, np.concatenate([end_ids([w], TOKENIZER) for w in found]))


def test_subword_ends_of_words_met_twice_are_remembered():
    found, often = [b"hello", b"qzxqzx", "zürück!".encode(), b"once9"], np.array([False, True, True, False])
    plain = np.array([(x[0], x[-1]) for x in (encoding(TOKENIZER).encode_ordinary(w.decode()) for w in found)])
    for marks in (None, often, None):
        assert np.array_equal(end_ids(found, TOKENIZER, marks), plain)
    memory = remembered(TOKENIZER)
    assert b"qzxqzx" in memory and found[2] in memory and b"once9" not in memory
    assert all(encoding(TOKENIZER).encode_ordinary(w.decode()) == [n >> 16] for w, n in memory.items() if n >> 16 == n & 0xFFFF)


def test_a_learning_step_asks_for_no_loss(monkeypatch):
    rng, model, asked = np.random.default_rng(1), attention.Model(), []
    data = attention.windows_of(np.array([5, 40]), rng.integers(0, 50, 45), rng.integers(0, 50, 45), rng.integers(0, 64, 47))[:4]
    real = attention.Model.gradients
    monkeypatch.setattr(attention.Model, "gradients", lambda *a, **k: asked.append(real(*a, **k)[1]) or real(*a, **k))
    attention.Fit(model, 1e-2).learn(*data)
    assert asked == [None]


def test_ledger(spark, docs, none):
    lines = "Same line of words here.\n"
    rows = [(i, t) for i, t in enumerate([*(t for _, t in corpus()), lines * 12, "# $ % words | & <b>" * 9, "a b c d e f g h " * 3, "LOUD WORDS " * 20])]
    book = ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in apply_policy(book).collect()}
    for i, text in rows:
        text = text or ""
        w = text.encode().split()
        runs = collections.defaultdict(list)
        for j in range(len(w) - 7):
            runs[tuple(w[j:j + 8])].append(j)
        again = {k for at in runs.values() if len(at) > 1 for j in at for k in range(j, j + 8)}
        own = [x for x in text.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert bool(r.failed & 3) == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and r.kept == (r.failed == 0)
    table = ablation(book).collect()
    for r in table:
        assert r["docs"] == len(rows) and r.kept <= r.kept_without == r.kept + r.alone <= r["docs"]
    assert ledger(none).collect() == []


def test_url_rules(spark):
    urls = [(i, f"https://{'www.' if i % 2 else ''}site{i % 5}.example.com/{'de' if i % 3 else 'en'}/{i}") for i in range(60)]
    urls += [(100, None), (101, "no scheme"), (102, "http://NET/x"), (103, "http://a.net"), (104, "x://example.net/en/?q"), (105, "x://example.net/en"),
             (106, "x://b.org/fr/1"), (107, "x://norg/fr/"), (108, "a://b://c/d"), (109, "x://example.com/de/#"), (109, "x://example.com/de/#"), (None, "x://y#z/")]
    got = judge_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()
    assert len(got) == len(urls)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[100] == by[101] == ("", "", None, "allow")
    assert by[102][:3] == ("net", "/x", "net/") and by[103][1:] == ("", None, by[103][3])
    assert by[104] == ("example.net", "/en/", "example.net/en/", "allow") and by[105][2:] == ("net/", "block")
    assert by[106][2:] == ("org/fr/", "allow") and by[107][2] is None and by[108][:2] == ("b:", "//c/d") and by[109][2:] == ("example.com/de/", "block")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_rules_read_whole_urls_and_single_hosts(spark):
    rules = [("block", "bad.org/"), ("allow", "good.org/")]
    urls = [f"http://bad.org/en/2024/casino/{i}" for i in range(40)] + [f"http://good.org/en/2024/news/{i}" for i in range(4000)]
    urls += ["http://x.net/en/2024/casino/a", "http://x.net/en/2024/news/a", "http://x.net/en/2024/casino/" + "/".join(f"s{i}" for i in range(30))]
    urls += ["http://good.org/" + "/".join(f"d{i}" for i in range(40))] * 25  # one deep url, often: its tokens are one item
    rows = [(i, u) for i, u in enumerate(urls)]
    got = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert [got[u].verdict for u in urls[4040:4043]] == ["block", "allow", "block"]
    assert got[urls[4040]].mined.endswith("-> block") and len(got) == 4044
    only = [(i, f"http://bad.org/en/{i}") for i in range(50)] + [(99, "http://x.net/en/1")]  # all labels are alike: no rule can lift
    assert {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(only, "page_id long, url string"), rules).collect()}[99] == "block"


def test_mixture(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(200), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)] + [(5, "w w", "a")] * 3 + [(None, None, "z")]
    plan = plan_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8)
    got = plan.collect()
    assert as_sorted(map(tuple, got)) == as_sorted(map(tuple, plan_mixture(
        spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7), shards=8).collect()))
    total, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and len(r.shards) * r.size == r.taken and all(0 <= s < 8 for s in r.shards)
    names = ["a", "b", "c", "d", "z", None]
    weight = dict(zip(names, (5, 2, 1, 5, 2, 1)))
    free, want, rest = set(names), {}, float(sum(total.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            want[s] = 3 * total[s]
            rest -= want[s]
        free -= over
    want |= share
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 100
        assert all(r.source_size == total[s] for r in got if r.source == s)
    assert mixture(plan).count() == sum(len(r.shards) for r in got)
    assert plan_mixture(none).collect() == []
    assert {r.taken for r in plan_mixture(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div>{open}<h1>{t}</h1><p>First &amp; {t} para<b>graph</b>.<br>Line two<p>Shared words of every page.</p>
<div class="comments"><p>Reader says hi</p></div><form><p>Subscribe</p></form><aside>See also</aside><blockquote>Quote {t}</blockquote>{close}
<div id="sidebar"><p>Links</p></div><footer>&copy; Site</footer>"""


@pytest.mark.parametrize("marks", [("<article>", "</article>"), ("<main role=main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>")])
def test_articles(spark, marks):
    pages = [(i, f"https://h{i % 2}.org/{i}", PAGE.format(t=f"Title {i}", open=marks[0], close=marks[1])) for i in range(12)]
    got = {r.page_id: r for r in extract_articles(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    marked = marks[0] != "<div>"
    for i in range(12):
        want = [f"Title {i}", f"First & Title {i} paragraph. Line two", *(["Shared words of every page."] if marked else []), f"Quote Title {i}"]
        assert got[i].text.split("\n\n") == want
        assert got[i].n_chars == len(got[i].text)


def test_articles_of_awkward_pages(spark):
    pages = [(1, None, None), (2, "", ""), (3, "x", "plain &lt;text&gt;"), (4, "x", "<p>a<p>b"), (5, "x", "<article>un<i>clos"), (6, "x", "<nav>menu<article>in menu"),
             (7, "x", "<form id=all><main><p>whole page form</p></main></form>"), (8, "x", "<div hidden>no</div><p>yes</p>"), (9, "x", "a < b & c > d"),
             (10, "x", "<article>" + "<p>word </p>" * 20_000), (4, "x", "<p>a<p>b")]
    got = extract_articles(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(pages)
    assert [by[i] for i in range(1, 10)] == ["", "", "plain <text>", "a\n\nb", "unclos", "in menu", "whole page form", "yes", "a < b & c > d"]
    assert by[10].count("word") == 20_000
    assert extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_articles_keep_text_whose_names_only_resemble_page_parts(spark):
    kept = ["Search", "Related work", "Deadline {i}", "Discussion", "Section text {i}", "Nausea {i}", "Token {i}", "Unmarked {i}"]
    inner = ("<h2 id=search>Search</h2><h2 id=related-work>Related work</h2><p class=notice-period>Deadline {i}</p>"
             "<section id=discussion><h2>Discussion</h2><p>Section text {i}</p></section><div class=side-effects>Nausea {i}</div>"
             "<pre><span class='token comment'>Token {i}</span></pre><div class='share-this'>Tell a friend</div><div class=comments-area><h3>Comments</h3>Hi</div>"
             "<section id=comments><h2>Comments</h2>Reader {i}</section><div class=ad>Buy</div><div id=discussion>Reader {i}</div><p class=x>Unmarked {i}</p>")
    pages = [(i, f"https://h.org/{i}", f"<body><div class=menu>Menu</div><article class='post ad-free'>{inner.format(i=i)}</article></body>") for i in range(6)]
    pages += [(9, "https://alone.org/", f"<body><div class=menu>Menu</div><div>{inner.split('<section')[0].format(i=9)}</div></body>")]
    got = {r.page_id: r.text.split("\n\n") for r in extract_articles(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == [k.format(i=i) for k in kept]
    assert got[9] == ["Search", "Related work", "Deadline 9"]


def test_reader_decodes_once():
    blocks, _ = Reader().read("<p>&amp;lt; &eacute; &#8212;</p>")
    assert blocks[0].text == html.unescape("&amp;lt; &eacute; &#8212;")


def test_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_shingle_sets_of_a_slice_are_those_of_its_texts():
    from probatum.llm.common import words
    from probatum.llm.ngram_join import each_set, first_met, set_marks, shingle_sets

    texts = ["a b c", "A  b\tC", None, "", " \n", "x y z x y z x y z", "one", "c b a", "\x0bé É z\x0c", "x y z x y z x y z", "one two"]
    n, low = shingle_sets(texts, 3)
    runs = [{tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))} if (w := words(t, True)) else set() for t in texts]
    ends = np.cumsum(n)
    each = [low[b - m:b].tolist() for m, b in zip(n.tolist(), ends.tolist())]
    assert n.tolist() == [len(r) for r in runs] and all(e == sorted(set(e)) for e in each)
    for a, x in zip(runs, each):
        for b, y in zip(runs, each):
            assert len(a & b) == len(set(x) & set(y))
    alone = [shingle_sets([t], 3) for t in texts]
    assert [x.tolist() for _, x in alone] == each and [x.tolist() for x in each_set(texts, 3)] == each
    marks = set_marks(n, low)
    assert marks.tolist() == [int(set_marks(*x)[0]) for x in alone]
    assert [[a == b for a in runs] for b in runs] == [[a == b for a in marks] for b in marks] and marks[2] == 0
    assert first_met(marks, {0}).tolist() == [True, False, False, False, False, True, True, True, True, False, True]


def test_first_keys_are_the_first_of_each_set():
    from probatum.llm.ngram_join import CELLS, Order, cell_of

    rng = np.random.default_rng(3)
    order = Order(rng.integers(0, 50, 1 << CELLS))
    n = np.array([7, 0, 1, 30])
    sets = [np.sort(rng.integers(0, 1 << 56, m).astype(np.uint64)) for m in n]
    first = np.array([3, 0, 1, 12])
    want = [order.keys(s)[:k].tolist() for s, k in zip(sets, first)]
    assert order.first_keys(np.concatenate(sets), n, first).tolist() == sum(want, [])
    assert all((np.diff(order.level[cell_of(order.keys(s) & np.uint64((1 << 56) - 1))].astype(np.int64) >> 56) >= 0).all() for s in sets)


def test_benchmark_terms_are_the_words_of_each_text():
    from probatum.llm.positional import term_hashes

    texts = ["The red, RED stone-1", None, "", "...", "é\x0bred x", "stone the"]
    found = term_hashes(texts)
    assert [len(f) for f in found] == [5, 0, 0, 0, 3, 2]
    the, red, again, stone, _ = found[0].tolist()
    assert red == again == found[4][1] and found[5].tolist() == [stone, the] and all(f.dtype == np.uint64 for f in found)
    assert [f.tolist() for f in found] == [term_hashes([t])[0].tolist() for t in texts]
