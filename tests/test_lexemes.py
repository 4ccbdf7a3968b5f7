"""Spanish stems, search by stems, and cover density against plain versions."""

import itertools
import random
import re

import pytest

from probatum.functions.stemming import stem_terms
from probatum.operators.lexemes import build_stemmed, stem_search, write_stemmed

# Words and stems of the published rules for Spanish.
STEMS = dict(p.split(":") for p in """
chicharrones:chicharron chicana:chican chicha:chich chico:chic chicos:chic chiquita:chiquit toreado:tor toreándolo:tor torear:tor torero:torer torneo:torne
torneos:torne tornillo:tornill torres:torr che:che cheque:chequ cheques:chequ chequeo:cheque chichimecas:chichimec torpedeando:torped tóxico:toxic
tóxicas:toxic trabajaba:trabaj permisos:permis permiso:permis edificaciones:edif edificación:edif construcciones:construccion urbanización:urbaniz
rápidamente:rapid nacionalidades:nacional biología:biolog solución:solucion existencia:existent diciéndoselo:dic haciéndola:hac pague:pag lleguen:lleg
constituyendo:constitu administrativa:administr administrativamente:administr posibilidad:posibil probablemente:probabl norma:norm normas:norm
artículos:articul ordenanzas:orden ayuntamientos:ayunt a:a el:el y:y EDIFICACIÓN:edif 2024:2024 über:über""".split())

CHUNKS = [(1, "Los permisos de edificación"), (2, "el permiso municipal para la obra; otro permiso"), (3, "edificaciones sin permiso"), (4, None), (5, " ; "),
          (6, "permisos permisos edificación"), (7, "obra obra obra permiso")]


def test_stems_of_known_words(spark):
    rows = stem_terms(spark.createDataFrame([(w, 1) for w in STEMS], "term string, word_count int")).collect()
    assert {r.term: r.stem for r in rows} == STEMS
    assert [r.stem for r in stem_terms(spark.createDataFrame([(None,), ("",)], "term string")).collect()] == [None, ""]


def test_stems_need_no_shuffle_and_no_python(spark):
    plan = stem_terms(spark.createDataFrame([("a",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def index(spark):
    return build_stemmed(spark.createDataFrame(CHUNKS, "chunk_id long, texto string"))


def found(spark, index, text, k=None, **more):
    queries = spark.createDataFrame([(1, text)], "query_id long, query_text string")
    return {r.chunk_id: r.score for r in stem_search(index, queries, k, **more).collect()}


def test_inflected_forms_are_found(spark, index):
    assert set(found(spark, index, "permisos")) == {1, 2, 3, 6, 7}
    assert set(found(spark, index, "edificaciones permiso")) == {1, 3, 6}
    assert set(found(spark, index, '"permiso de edificaciones"')) == {1}
    assert set(found(spark, index, "permiso -obra")) == {1, 3, 6}
    assert set(found(spark, index, "-permisos")) == set()
    assert found(spark, index, "nada") == {} and found(spark, index, "") == {}


def test_closer_words_come_first(spark, index):
    got = found(spark, index, "permiso edificación")
    # one word between, one word between, next to each other
    assert got == {1: 0.05, 3: 0.05, 6: 0.1}
    assert found(spark, index, "obra") == {2: 0.1, 7: 0.3}
    rows = stem_search(index, spark.createDataFrame([(1, "permiso")], "query_id long, query_text string"), 2).collect()
    assert [(r.rank, r.chunk_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 2, 0.2), (2, 6, 0.2)]


def test_stored_index_and_chunks_within(spark, index, tmp_path):
    stored = write_stemmed(index, str(tmp_path / "stems"))
    assert set(found(spark, stored, "permisos")) == {1, 2, 3, 6, 7}
    assert {r.term: r.stem for r in stored.vocabulary.collect()}["permisos"] == "permis"
    within = spark.createDataFrame([(1, "LEY"), (2, "DDU")], "chunk_id long, type string")
    assert set(found(spark, stored, "permisos", within=within.drop("type"))) == {1, 2}
    typed = spark.createDataFrame([(1, "permisos", ["DDU"])], "query_id long, query_text string, types array<string>")
    assert [r.chunk_id for r in stem_search(stored, typed, 5, within=within).collect()] == [2]


def test_stop_words_leave_their_place(spark):
    chunks = spark.createDataFrame([(1, "permiso de obra"), (2, "permiso obra")], "chunk_id long, texto string")
    index = build_stemmed(chunks, stop_words=["de"])
    assert set(found(spark, index, '"permiso de obra"', stop_words=["de"])) == {1}
    assert found(spark, index, "permiso obra", stop_words=["de"]) == {1: 0.05, 2: 0.1}


def plain_rank(words, slots):
    """All minimal intervals, by trying every one. ``slots``: alternatives, each a tuple of adjacent words."""
    def meets(p, q):
        return all(any(tuple(words[i:i + len(u)]) == u for u in slot for i in range(p, q - len(u) + 2)) for slot in slots)

    asked = {w for slot in slots for u in slot for w in u}
    spans = [(p, q) for p, q in itertools.combinations_with_replacement(range(len(words)), 2) if meets(p, q)]
    least = [s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)]
    return round(sum(0.1 / (1 + (q - p) - (sum(w in asked for w in words[p:q + 1]) - 1)) for p, q in least), 6)


@pytest.mark.parametrize("text,slots", [
    ("x1 x2", [[("x1",)], [("x2",)]]), ("x1 or x2", [[("x1",), ("x2",)]]), ('"x1 x2" x3', [[("x1", "x2")], [("x3",)]]), ("x1 x2 x3", [[("x1",)], [("x2",)], [("x3",)]]),
    ('"x1 x1" or x2 x3', [[("x1", "x1"), ("x2",)], [("x3",)]]), ("x1 x1", [[("x1",)], [("x1",)]])])
def test_cover_density_equals_all_minimal_intervals(spark, text, slots):
    rng = random.Random(len(text))
    chunks = [(i, " ".join(f"x{rng.randrange(1, 7)}" for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    want = {i: plain_rank(re.split(" ", t), slots) for i, t in chunks}
    index = build_stemmed(spark.createDataFrame(chunks, "chunk_id long, texto string").repartition(3))
    assert found(spark, index, text) == {i: r for i, r in want.items() if r}


def test_search_in_blocks_equals_one_block(spark, index):
    queries = spark.createDataFrame([(i, w) for i, w in enumerate(["permiso", "obra", "edificar", "permiso obra"])], "query_id long, query_text string")
    rows = lambda n: sorted(tuple(r) for r in stem_search(index, queries, None, block_bytes=n).collect())
    assert rows(5) == rows(1 << 20)
    assert stem_search(build_stemmed(spark.createDataFrame([], "chunk_id long, texto string")), queries, 3).collect() == []


def test_halves_are_rounded_up_and_or_may_be_a_word(spark):
    chunks = [(1, "alfa " + "x " * 63 + "beta"), (2, "or beta"), (3, "beta")]
    index = build_stemmed(spark.createDataFrame(chunks, "chunk_id long, texto string"))
    # 63 words in between: 0.1 / 64 = 0.0015625
    assert found(spark, index, "alfa beta") == {1: 0.001563}
    assert set(found(spark, index, "or -alfa")) == {2} and set(found(spark, index, "or beta")) == {2}


def test_texts_are_indexed_where_they_lie(spark, index):
    """The texts of an index enter no join, and its words are read back, not cut again."""
    from probatum.catalog import derived
    from probatum.catalog.registry import Tables

    plan = derived.plain_texts(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan
    for table in (index.chunks, index.stats):
        assert "split(" not in table._jdf.queryExecution().optimizedPlan().toString()
    same = lambda name: sorted(map(str, getattr(derived, name)(Tables(spark, "/root/testdata/sf0.001")).select("chunk_id", "texto").collect()))
    assert same("plain_texts") == same("chunk_texts")
