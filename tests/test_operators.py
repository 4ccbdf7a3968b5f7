"""Operators against brute force on small inputs, and the known unit cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probatum.operators import chunking, evidence, fulltext, fusion, segmentation, stateful, tagging, vectors

EXACT = [
    "¿Qué dice el artículo 116?", "Art. 116 de la ley", "Artículo 5.1.1", "artículo 3°", "art. 28", "DDU 541", "DDU-527", "circular DDU N° 535",
    "DS-47", "DS 61", "DFL-458", "DFL 382", "DL 3.516", "Ley 21.442", "Ley N° 19.300", "N° 10", "Nº 3", "Resolución 1234", "Circular 5"]
VAGUE = [
    "¿Qué es un permiso de edificación?", "requisitos de accesibilidad", "qué dice la LGUC", "la OGUC y los planos", "el artículo sobre antejardines",
    "normas DDU generales", "altura máxima", ""]


def test_exact_terms(rows):
    df = rows([(x,) for x in EXACT + VAGUE], "t string").select("t", fulltext.has_exact_terms(F.col("t")).alias("e"))
    assert {r.t: r.e for r in df.collect()} == {**{x: True for x in EXACT}, **{x: False for x in VAGUE}}


@pytest.mark.parametrize("keywords,text,want", [
    (["Art. 9999"], "", "Art. 9999"), (["Artículo 10000"], "", "Art. 10000"), (["DDU 999"], "", "DDU 999"), (["DDU-700"], "", "DDU 700"),
    ([], "qué dice la DDU 800", "DDU 800"), (["Art. 116"], "", None), (["DDU 541"], "", None), ([], "el artículo 350 de la LGUC", "Art. 350 LGUC"),
    (["Art. 350"], "", None), (["Art. 9999", "DDU 700"], "", "DDU 700")])
def test_suspicious(rows, keywords, text, want):
    df = rows([(1, text, keywords)], "query_id long, texto string, keywords array<string>")
    got = tagging.named_suspicious(tagging.suspicious_refs(df)).collect()
    assert (got[0].referencia if got else None) == want


LONG = "x" * 60
NOTICE = " Aviso legal: orientativo."


@pytest.mark.parametrize("answer,reason", [
    ("", "Respuesta demasiado corta"), ("   \n ", "Respuesta demasiado corta"), ("corta Aviso legal", "Respuesta demasiado corta"),
    (LONG, "Falta disclaimer legal"), (LONG + NOTICE, None), (LONG + " asesoría jurídica", None), (LONG + " profesional habilitado", None)])
def test_answer_valid(rows, answer, reason):
    assert evidence.answer_valid(rows([(1, answer)], "query_id long, respuesta string")).first().motivo == reason


@pytest.mark.parametrize("cited,held,want", [
    ("Art. 116", ["116"], []), ("Art. 999", ["116"], ["999"]), ("artículo 5.3.1 y Art. 7", ["5.3.1"], ["7"]), ("Art. 3°", ["3º"], []),
    ("Art. 8, Art. 8 y artículo 8", ["1"], ["8"]), ("Art. 9", [None], ["9"]), ("según el Art. 116.", ["116"], [])])
def test_uncited(rows, cited, held, want):
    answers = rows([(1, LONG + NOTICE + " " + cited)], "query_id long, respuesta string")
    found = rows([(1, h) for h in held], "query_id long, articulo string")
    assert sorted(r.articulo for r in evidence.uncited_articles(answers, found).collect()) == want


@pytest.mark.parametrize("text,label,word", [
    ("La obra no podrá subdividirse", "restrictivo", "no podrá"), ("No podrán hacerlo", "general", None),
    ("Salvo en los casos en que exista permiso", "excepcion", None), ("salvo que", "excepcion", None),
    ("queda DEROGADA la norma, excepto", "restrictivo", "DEROGADA"), ("texto común", "general", None)])
def test_restriction(rows, text, label, word):
    r = tagging.restriction_tagger(rows([(1, text)], "chunk_id long, texto string")).first()
    assert (r.etiqueta, r.patron) == (label, word)


# --- chunk windows ---------------------------------------------------------------------------------

def windows(tokens, limit, overlap, tail):
    """Direct statement of the window rule."""
    out, start, n = [], 0, len(tokens)
    while start < n:
        end, held = start, 0
        while end < n and not (held + tokens[end] > limit and end > start):
            held += tokens[end]
            end += 1
        out.append((start, end))
        if end == n and not tail:
            break
        back, seen = end, 0
        while back > start + 1:
            back -= 1
            seen += tokens[back]
            if seen >= overlap:
                break
        start = back if back < end else end
    return out


def test_windows(rows):
    rng = random.Random(3)
    data = [(i, [rng.randint(1, 60 if i % 3 else 200) for _ in range(rng.randint(0, 25))]) for i in range(150)]
    df = rows(data, "i int, t array<int>")
    for tail in (False, True):
        got = {r.i: [tuple(w) for w in r.w] for r in df.select("i", chunking.windows_of(F.col("t"), 120, 40, tail).alias("w")).collect()}
        assert got == {i: windows(t, 120, 40, tail) for i, t in data}


def test_chunks_cover_all_paragraphs(rows):
    text = "\n\n".join(f"Párrafo {i} " + "palabra " * (i % 9 * 10) for i in range(60))
    got = chunking.chunk_overlap(rows([(1, text)], "doc_id long, texto string"), max_tokens=100, overlap=20).orderBy("orden").collect()
    assert len(got) > 3
    assert {f"Párrafo {i} " for i in range(60)} <= {f"Párrafo {w.split()[1]} " for r in got for w in r.texto.split("\n\n")}


def test_fixed_slices_cover_text(rows):
    text = "abcdefghij" * 170
    got = rows([(text,)], "t string").select(chunking.fixed_slices(F.col("t")).alias("s")).first().s
    assert [len(x) for x in got] == [600, 600, 600, 140]
    assert got[0][520:] == got[1][:80]


def test_headings_are_inherited(rows):
    text = ("TÍTULO I Uno\nCAPÍTULO II Dos\nArtículo 1.- " + "a" * 30 + "\nTÍTULO II Otro\nArtículo 2 bis.- " + "b" * 30 + " D.O. 01.02.2003\nArtículo 3.- corto")
    got = segmentation.segment(rows([(1, text)], "doc_id long, texto string"), segmentation.CODE).orderBy("orden").collect()
    assert [(r.titulo, r.capitulo, r.numero, r.vigencia_desde) for r in got] == [
        ("TÍTULO I Uno", "CAPÍTULO II Dos", "1", None), ("TÍTULO II Otro", None, "2 bis", "2003-02-01")]


def test_chapter_outlives_title_in_dotted_layout(rows):
    text = "CAPÍTULO 2\nTÍTULO 1\nArtículo 1.2.3. " + "a" * 30 + "\nTÍTULO 2\nArtículo 2.2.3. " + "b" * 30
    got = segmentation.segment(rows([(1, text)], "doc_id long, texto string"), segmentation.DOTTED).orderBy("orden").collect()
    assert [(r.titulo, r.capitulo) for r in got] == [("TÍTULO 1", "CAPÍTULO 2"), ("TÍTULO 2", "CAPÍTULO 2")]


# --- vectors ---------------------------------------------------------------------------------------

def test_topk_scan_and_grid_agree_with_brute_force(rows):
    rng = np.random.default_rng(1)
    chunks, asked = rng.normal(size=(300, 8)).astype(np.float32), rng.normal(size=(20, 8))
    chunks[17] = chunks[3]
    kinds = ["a", "b", "c"]
    c = rows([(i, [float(x) for x in v], kinds[i % 3]) for i, v in enumerate(chunks)] + [(900, None, "a"), (901, [0.0] * 8, "a")],
             "chunk_id long, embedding array<float>, tipo string")
    q = rows([(i, [float(x) for x in v], ["a", "b"][: 1 + i % 2]) for i, v in enumerate(asked)],
             "query_id long, query_vector array<double>, types array<string>")
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    scores = np.round(unit(asked) @ unit(chunks.astype(float)).T, 6)
    want = {i: [int(j) for j in sorted((j for j in range(300) if kinds[j % 3] in ["a", "b"][: 1 + i % 2]), key=lambda j: (-scores[i, j], j))[:5]]
            for i in range(20)}
    for block_bytes in (1 << 20, 7 * 8 * 8):  # one block, and three
        hits = vectors.vector_topk(c, q, 5, type_col="tipo", block_bytes=block_bytes)
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_topk_with_string_ids(rows):
    c = rows([(f"c{i}", [float(i), 1.0]) for i in range(30)], "chunk_id string, embedding array<float>")
    q = rows([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0]), ("q3", [1.0, 1.0])], "query_id string, query_vector array<double>")
    for block_bytes in (1 << 20, 2 * 8):
        got = {(r.query_id, r["rank"]): r.chunk_id for r in vectors.vector_topk(c, q, 2, block_bytes=block_bytes).collect()}
        assert got[("q1", 1)] == "c29" and got[("q2", 1)] == "c0" and got[("q3", 1)] == "c1" and len(got) == 6


def test_topk_refuses_vectors_of_other_widths(rows):
    q = rows([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    ragged = rows([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, [1.0, 2.0])], "chunk_id long, embedding array<float>")
    with pytest.raises(Exception, match="width"):
        vectors.vector_topk(ragged, q, 1).collect()


def test_bucket_candidates_find_most_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in base[i] + rng.normal(size=16) * 0.05]) for i in range(20)],
                              "query_id long, query_vector array<double>")
    got = {r.query_id: r.chunk_id for r in vectors.vector_ann_lsh(c, q, 1).collect()}
    assert sum(got.get(i) == i for i in range(20)) >= 18


def test_blend_of_opposite_vectors_is_not_a_division_by_zero(rows):
    df = rows([(1, [1.0, 0.0], [-1.0, 0.0]), (2, [1.0, 2.0], None)], "query_id long, query_vector array<double>, hyde_vector array<double>")
    assert {r.query_id: r.query_vector for r in vectors.hyde_combine(df).collect()} == {1: [0.0, 0.0], 2: [1.0, 2.0]}


def test_embed_with_user_model(rows):
    df = rows([(i, "x" * i) for i in range(5)], "chunk_id long, texto string")
    got = {r.chunk_id: r.embedding for r in vectors.embed_with(df, lambda texts: [[len(t), 1] for t in texts], 2).collect()}
    assert got == {i: [float(i), 1.0] for i in range(5)}


# --- full text -------------------------------------------------------------------------------------

def test_search_syntax(rows):
    chunks = rows([(1, "La obra nueva exige permiso"), (2, "permiso de obra menor"), (3, "una obra sin nada"), (4, "menor permiso, Obra nueva!")],
                  "chunk_id long, texto string")
    index = fulltext.build_index(chunks)
    cases = {1: ("obra permiso", {1, 2, 4}), 2: ('"obra nueva"', {1, 4}), 3: ("obra -permiso", {3}), 4: ("nueva or menor", {1, 2, 4}),
             5: ('permiso "obra menor" or nada', None), 6: ("inexistente obra", set()), 7: ('"obra nueva exige" permiso', {1}), 8: ("OBRA sin or menor", {2, 3, 4})}
    asked = rows([(k, v[0]) for k, v in cases.items()], "query_id long, query_text string")
    got = {}
    for r in fulltext.fts_search(index, asked, None).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    for k, (_, want) in cases.items():
        if want is not None:
            assert got.get(k, set()) == want, k


@pytest.mark.parametrize("text,want", [
    ("Or obra", {2, 3}), ("or or obra", {1, 2, 3, 4, 5}), ("nada or", {4}), ("nada or or", {1, 2, 3, 4}), ("permiso or or or nada", {1, 2, 3, 4, 5}),
    ("Or -obra", {1, 4}), ("nada or obra permiso", {5}), ("or", {1, 2, 3, 4})])
def test_or_without_a_left_or_a_right_side_is_a_word(rows, text, want):
    chunks = rows([(1, "or a"), (2, "or obra"), (3, "obra, or"), (4, "nada or"), (5, "permiso obra")], "chunk_id long, texto string")
    got = fulltext.fts_search(fulltext.build_index(chunks), rows([(1, text)], "query_id long, query_text string"), None).collect()
    assert {r.chunk_id for r in got} == want


def test_search_sql_reads_queries_as_the_search_does(rows):
    """The check SQL's slots, found again by the search's own reading."""
    import duckdb

    from probatum.catalog.search import SEARCH
    texts = ["or uno dos", "uno or or dos or", "uno-dos or tres", "uno tres-dos\nOr or dos", "Or or uno.\nDos or", "-or uno or -dos tres", "uno — or dos", "uno uno or dos uno"]
    steps = {k: SEARCH[k] for k in ("text_queries", "parts", "runs", "joined", "units", "numbered", "slots", "asked")}
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(4 * i + shape, t) for i, t in enumerate(texts) for shape in (0, 2, 3)])
    head = ", ".join(f"{k} AS ({v})" for k, v in steps.items())
    slots, without = {}, {}
    for i, slot, term, excluded in con.execute(f"WITH {head} SELECT query_id, slot, term, excluded FROM asked").fetchall():
        without.setdefault(i, set()).add(term) if excluded else slots.setdefault(i, {}).setdefault(slot, set()).add(term)
    asked = rows(con.execute(f"WITH {head} SELECT query_id, query_text FROM text_queries").fetchall(), "query_id long, query_text string")
    for block in fulltext._blocks(asked, (), 1 << 20):
        for q in block:
            assert {frozenset(t for u in s for _, t in u) for s in q.slots} == {frozenset(s) for s in slots[q.query_id].values()}, q
            assert {t for u in q.without for _, t in u} == without.get(q.query_id, set()), q


def test_many_alternatives_use_several_masks(rows):
    text = "\n".join(f"w{i} or v{i}" for i in range(130))
    chunks = rows([(1, " ".join(f"w{i}" for i in range(130))), (2, " ".join(f"v{i}" for i in range(129)))], "chunk_id long, texto string")
    got = fulltext.fts_search(fulltext.build_index(chunks), rows([(1, text)], "query_id long, query_text string"), None).collect()
    assert [r.chunk_id for r in got] == [1]


def test_stored_index_equals_fresh_one(rows, tmp_path):
    chunks = rows([(i, f"obra {i % 3} permiso {i}") for i in range(30)], "chunk_id long, texto string")
    asked = rows([(1, "obra permiso"), (2, '"permiso 7"')], "query_id long, query_text string")
    index = fulltext.build_index(chunks)
    fresh = {tuple(r) for r in fulltext.fts_search(index, asked, 50).collect()}
    stored = {tuple(r) for r in fulltext.fts_search(index.write(str(tmp_path)), asked, 50).collect()}
    assert fresh == stored and len(fresh) == 31


# --- fusion ----------------------------------------------------------------------------------------

def test_rrf_does_not_depend_on_partitions(rows):
    rng = random.Random(2)
    data = [(1, n, c, r) for n in range(4) for r, c in enumerate(rng.sample(range(30), 12), start=1)]
    want = {}
    for _, _, c, r in data:
        want[c] = want.get(c, 0) + 1 / (60 + r)
    best = sorted(want, key=lambda c: (-round(want[c], 12), c))[:10]
    for n in (1, 7):
        df = rows(data, "query_id long, list_no int, chunk_id long, rank int").repartition(n)
        assert [r.chunk_id for r in fusion.rrf_fusion(df, 10).orderBy("rank").collect()] == best


# --- rate limiter ----------------------------------------------------------------------------------

def brute(requests, limit, window):
    held, out = {}, {}
    for client, event, ts in sorted(requests, key=lambda r: (r[0], r[2], r[1])):
        kept = [t for t in held.get(client, []) if t > ts - window]
        if len(kept) >= limit:
            out[event] = (False, 0, kept[0] + window - ts)
        else:
            kept.append(ts)
            out[event] = (True, limit - len(kept), 0)
        held[client] = kept
    return out


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.sampled_from([10, 60, 400]))
def test_rate_limit(spark, seed, limit, gap):
    rng = random.Random(seed)
    data, now = [], 0
    for event in range(300):
        now += rng.choice([0, 1, rng.randint(0, gap)])
        data.append((rng.choice(["hot", "hot", "hot", "b", "c"]), event, now))
    df = spark.createDataFrame(data, "client string, event_id long, ts_ms long")
    got = {r.event_id: (r.allowed, r.remaining, r.reset_ms) for r in stateful.rate_limit(df, limit, 100).collect()}
    assert got == brute(data, limit, 100)


def test_rate_limit_never_accepts_more_than_the_limit(rows):
    data = [("a", i, i * 7) for i in range(500)]
    ok = sorted(r.event_id * 7 for r in stateful.rate_limit(rows(data, "client string, event_id long, ts_ms long"), 20, 1000).collect() if r.allowed)
    assert all(sum(t - 1000 < u <= t for u in ok) <= 20 for t in ok)


def test_bm25_is_finite_for_a_term_in_every_chunk(rows):
    chunks = rows([(i, "siempre") for i in range(5)], "chunk_id long, texto string")
    got = fulltext.fts_search(fulltext.build_index(chunks), rows([(1, "siempre")], "query_id long, query_text string"), 3).collect()
    assert len(got) == 3 and all(math.isfinite(r.score) for r in got)


# --- patterns --------------------------------------------------------------------------------------

@pytest.mark.parametrize("regex, literals", [
    (r"\bno\s+podr[aá]\b", ["podr"]), (r"residuo(s)? (peligros|tóxic)", ["residuo"]), (r"impuesto|tributari|sri", ["impuesto", "tributari", "sri"]),
    (r"\bN[°º]\s*\d+", None), (r"a(b|c(d)?)e?", None), (r"aguas?x{0,3}", ["agua"]), (r"obra.{0,40}permiso(?:nes)?", ["permiso"])])
def test_literals_that_every_match_needs(regex, literals):
    from probatum.functions.patterns import needed_literals
    assert needed_literals(regex) == literals


def test_first_hit_equals_trying_every_pattern(spark):
    from probatum.functions.patterns import UNICODE, first_hit
    from probatum.lookups.patterns import CROSSING_AREAS, EXCEPTIONS, RESTRICTIVE
    texts = ["No\n podrá acogerse", "SE EXCLUYE y no procede", "se prohıbıcıón", "ſalvo lo que diga", "DEROGADO", "İMPROCEDENTE", "", None, "nada",
             "RESIDUOS PELIGROSOS", "aguas servidas", "Álveo", "alveo del río", "humedales", "paneles fotovoltaicos"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for regexes in [RESTRICTIVE, EXCEPTIONS] + [area[3] for area in CROSSING_AREAS]:
        hits = [F.regexp_extract("t", UNICODE + r, 0) for r in regexes]
        plain = F.coalesce(*[F.when(h != "", h) for h in hits])
        assert not frame.where(~first_hit(F.col("t"), regexes).eqNullSafe(plain)).collect()


def test_out_of_domain_tells_marked_letters_apart(rows):
    """The job and its check SQL: words as written, ends of words as in Unicode, any case."""
    import duckdb

    from probatum.catalog import tagging as catalog
    from probatum.lookups import patterns
    texts = ["asíí óes", "EL SII", "sueldó", "Sueldo.", "ésueldo", "codigo civil", "CÓDIGO CIVIL", "un sueldo_x", "sueldo", "ſii", "sıi", "salario2", "el salario"]
    df = rows([(t,) for t in texts], "texto string").select("texto", tagging.out_of_domain(F.col("texto")).alias("fuera"))
    con = duckdb.connect()
    con.execute("CREATE TABLE x (texto VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?)", [(t,) for t in texts])
    want = dict(con.execute(f"SELECT texto, {catalog.sql_any_written(patterns.OUT_OF_DOMAIN, 'texto')} FROM x").fetchall())
    assert {r.texto: r.fuera for r in df.collect()} == want
    assert want["EL SII"] and want["Sueldo."] and not want["asíí óes"] and not want["codigo civil"] and not want["ésueldo"]


def test_rows_held_for_queries_stay_within_twice_those_returned():
    rng, best, seen = np.random.default_rng(1), vectors.Best(600, 5), []
    for _ in range(30):
        for lo in range(0, 600, vectors.QUERY_SLICE):
            q = np.repeat(np.arange(lo, min(lo + vectors.QUERY_SLICE, 600)), 7)
            ids, score = rng.integers(0, 10**6, len(q)), np.round(rng.random(len(q)), 2)
            best.offer(q, ids, score)
            seen += zip(q.tolist(), (-score).tolist(), ids.tolist())
        assert all(sum(len(r[0]) for r in rows) <= 2 * 5 * vectors.QUERY_SLICE for rows in best.rows)
    want = {i: [] for i in range(600)}
    for q, score, i in sorted(seen):
        want[q] = (want[q] + [(i, -score)])[:5]
    got = {i: [] for i in range(600)}
    for query, ids, score in best.found():
        for q, i, x in zip(query.tolist(), ids.tolist(), score.tolist()):
            got[q].append((i, x))
    assert got == want


def test_blocks_count_the_rows_kept_for_their_queries(rows):
    asked = rows([(i, [1.0, 0.0]) for i in range(1000)], "query_id long, query_vector array<double>")
    assert vectors._parts(asked, 1, 1 << 20) == 1
    assert vectors._parts(asked, 1, 4000) == 4
    assert vectors._parts(asked, vectors.HELD_BYTES // 24 // 250, 1 << 20) == 4
    chunks = rows([(f"c{i}", [float(i % 7), 1.0]) for i in range(50)], "chunk_id string, embedding array<float>")
    one = sorted(tuple(r) for r in vectors.vector_topk(chunks, asked.limit(40), 3).collect())
    assert one == sorted(tuple(r) for r in vectors.vector_topk(chunks, asked.limit(40), 3, block_bytes=128).collect()) and len(one) == 120


def test_long_batches_are_laid_out_in_pages():
    import pyarrow as pa
    words = [["a"] * 3, ["b"], ["a", "b"], ["c"] * (fulltext.PAGE_WORDS + 1), ["a"] * (fulltext.PAGE_WORDS - 1), ["b", "a"]]
    batch = pa.RecordBatch.from_pydict({"chunk_id": pa.array(range(6), pa.int64()), "words": pa.array(words)})
    cut = list(fulltext.pages(batch))
    assert [p.column("chunk_id").to_pylist() for p in cut] == [[0, 1, 2], [3], [4], [5]]
    page = fulltext.Page(cut[0], pa.array(["b", "a", "z"]))
    assert page.counts(1, np.array([0, 1, 2])).tolist() == [3, 0, 1] and page.counts(2, np.array([0, 2])).tolist() == [0, 0]
    # what is kept for a term grows with its places, not with all chunks
    assert page.known[1][0].tolist() == [0, 2]


def test_chunks_are_met_before_their_words_are_taken_apart(rows):
    hits = rows([(1, 1, 1), (1, 2, 2), (2, 9, 1)], "query_id long, chunk_id long, rank int")
    chunks = rows([(1, ["a", "b", "a", ""]), (2, ["b", "c"]), (3, ["d"])], "chunk_id long, words array<string>")
    got = fusion.present_terms(hits, chunks)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (1, "c")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")


@pytest.mark.parametrize("with_index", [False, True])
def test_questions_of_one_vector_are_searched_once(rows, monkeypatch, with_index):
    from probatum.plans import answering

    norms = rows([(i, "DDU" if i % 2 else "LGUC", str(i), "ley", i % 5 > 0) for i in range(12)],
                 "doc_id long, tipo string, numero string, jerarquia_norm string, vigente boolean")
    chunks = rows([(i, i, 0, f"piedra {i % 3} del permiso", "1", [1.0, float(i), float(i % 4)]) for i in range(12)],
                  "chunk_id long, doc_id long, orden int, texto string, articulo string, embedding array<float>")
    asked = [(1, "permiso 1", [1.0, 2.0, 0.0], ["urbanismo"]), (2, "permiso 2", [1.0, 2.0, 0.0], ["urbanismo"]), (3, "art. 1 permiso", [1.0, 2.0, 0.0], ["urbanismo"]),
             (4, "permiso", [1.0, 2.0, 0.0], ["salud"]), (5, "permiso", None, ["urbanismo"]), (6, "permiso", [0.0, 1.0, 1.0], ["urbanismo"])]
    schema = "query_id long, texto string, query_vector array<double>, dominios array<string>"
    index = fulltext.build_index(chunks) if with_index else None
    counts, search = [], vectors.vector_topk

    def counted(pool, queries, *args, **kwargs):
        counts.append(queries.count())
        return search(pool, queries, *args, **kwargs)

    def found(data):
        got = answering.retrieve(rows(data, schema), answering.Corpus(norms, chunks), index=index)
        return sorted(map(tuple, got.select("query_id", "rank", "chunk_id", "similarity", "forced", "norma").collect()))

    monkeypatch.setattr(vectors, "vector_topk", counted)
    every = found(asked)
    assert counts == [3, 3]
    assert [r for r in every if r[0] == 3] == found(asked[2:3])
    assert {r[0] for r in every} == {1, 2, 3, 4, 6}
