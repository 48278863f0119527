import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language as lang
from palimpsest.llm.pii import Finder, Lexicon, _made_up, find_pii, mask_pii, train

SENTENCES = {
    "en": ["the answer came too late so we went on with the plan", "each report should be checked by someone who was there", "they have been using it since spring and are quite happy with it"],
    "de": ["die antwort kam zu spät und wir machten ohne den plan weiter", "jeder bericht muss von jemandem geprüft werden der dabei war", "sie nutzen es seit dem frühling und sind damit sehr zufrieden"],
    "fr": ["la réponse est arrivée trop tard et nous avons continué sans le projet", "chaque rapport doit être relu par quelqu'un qui était là", "ils l'utilisent depuis le printemps et en sont très contents"],
    "es": ["la respuesta llegó demasiado tarde y seguimos adelante sin el proyecto", "cada informe tiene que ser revisado por alguien que estaba allí", "lo usan desde la primavera y están muy contentos con ello"],
    "pt": ["a resposta chegou tarde demais e nós continuamos sem o projeto", "cada relatório tem de ser revisto por alguém que lá estava", "eles usam isso desde a primavera e estão muito contentes com isso"],
    "nl": ["het antwoord kwam te laat dus zijn we zonder het plan verder gegaan", "elk verslag moet worden bekeken door iemand die erbij was", "zij gebruiken het sinds het voorjaar en zijn er erg blij mee"],
}
DOC = "doc_id bigint, text string, lang string, para_no string"


def text(rng, code, n):
    return ". ".join(s.capitalize() for s in (rng.choice(SENTENCES[code]) for _ in range(n))) + "."


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    rows = [(i, text(rng, c, 6), c if i % 9 else "xx", "") for i, c in enumerate(k for k in SENTENCES for _ in range(15))]
    return lang.fit(spark.createDataFrame(rows, DOC))


def test_forward_sums_agree(model):
    s = lang.Scorer(*model)
    for w in ("straße", "a", "geprüft", "quelqu", "x" * 40):
        alone = np.log(s.forward(w, s.lattice(w))[-1] + 1e-300)
        assert np.allclose(np.clip(alone - alone.mean(), -lang.CLIP, lang.CLIP), s.score([w])[0])


def test_held_out_documents(spark, model):
    rng = random.Random(1)
    rows = [(i, text(rng, c, 2), None, "") for i, c in enumerate(list(SENTENCES) * 5)]
    got = {r["doc_id"]: r["lang_found"] for r in lang.language_parts(spark.createDataFrame(rows, DOC), model).collect()}
    assert np.mean([got[i] == c for i, c in enumerate(list(SENTENCES) * 5)]) > 0.95


def test_mixed_headings_and_labels(spark, model):
    rng = random.Random(2)
    mixed = f"# Plan 2025-01\n\nUser: {text(rng, 'en', 2)}\n\n{text(rng, 'de', 2)} {text(rng, 'fr', 1)}"
    rows = [(1, mixed, "en", ""), (2, text(rng, "en", 2), "en_US", ""), (3, text(rng, "en", 2), "German", ""), (4, text(rng, "nl", 2), "dut", ""), (5, None, "en", ""), (6, "", None, ""), (7, "123 !", None, ""), (8, text(rng, "pt", 400), "und", "")]
    got = {tuple(r)[:3] for r in lang.mislabelled(spark.createDataFrame(rows, DOC), model).collect()}
    assert got == {(1, 2, "en"), (1, 3, "de"), (1, 3, "fr"), (3, 1, "en"), (8, 1, "pt")}
    assert lang.mislabelled(spark.createDataFrame([], DOC), model).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("en-GB",), ("es_MX",), ("Portuguese",), ("dut",), ("xx",), ("",), (None,), ("english language",)], "lang string")
    assert [r[0] for r in df.select(lang.label_language("lang")).collect()] == ["en", "en", "es", "pt", "nl", None, None, None, None]


@pytest.fixture(scope="module")
def finder():
    from palimpsest.llm import pii

    return Finder(train(), Lexicon([f"{g} {f}".lower() for f in pii._FAMILY for g in pii._GIVEN[:12]]))


def test_made_up_texts_held_out(finder):
    rng = random.Random(99)
    hit = miss = extra = 0
    for _ in range(400):
        t, segs = _made_up(rng, finder.lex)
        got = set(finder.find(t))
        hit += len(got & segs)
        miss += len(segs - got)
        extra += len(got - segs)
    assert hit / (hit + miss) > 0.93 and hit / (hit + extra) > 0.93


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call me on +33 1 99 00 70 42 after the call", [("phone", "+33 1 99 00 70 42")]), ("the parcel 3256 3 3256 never came, order 18-14-18 neither", []), ("write to a.b at host-x dot test please", [("email", "a.b at host-x dot test")]),
        ("ship it to 31 Old Mulero Court, Flat A before Sunday", [("address", "31 Old Mulero Court, Flat A")]), ("she lives at PO Box 1309, near it", [("address", "PO Box 1309")]), ("the party is at Delafustraße 74, not here", [("address", "Delafustraße 74")]),
        ("they asked again: ssn 000-12-3456. why", [("id_number", "000-12-3456")]), ("my passport is X33328143, keep it", [("id_number", "X33328143")]), ("clone git@host:core/x and @me can look", []), ("ask Arden Ashley; they know", [("name", "Arden Ashley")]), ("", []), (None, []),
    ],
)
def test_single_texts(finder, text, want):
    assert [(k, text[a:b]) for a, b, k in finder.find(text)] == want


def test_tables_and_masks(spark, finder):
    m = spark.createDataFrame([(1, "call me on +1 782 555 0179 now", "k"), (1, "call me on +1 782 555 0179 now", "k"), (2, None, ""), (3, "", ""), (4, "x " * 60_000, "")], "id bigint, content string, kind string")
    p = spark.createDataFrame([("arden ashley",), (None,)], "entity string")
    assert [tuple(r)[:3] for r in find_pii(m, p, finder.field).collect()] == [(1, "phone", "+1 782 555 0179")]
    masked = {r["id"]: r["content"] for r in mask_pii(m, p, field=finder.field).collect()}
    assert masked[1] == "call me on [PHONE] now" and masked[2] is None and masked[4] == "x " * 60_000
    assert find_pii(m.limit(0), p, finder.field).count() == 0 and find_pii(m, p.limit(0), finder.field).where(F.col("kind") == "name").count() == 0


def test_names_beyond_the_lexicon(finder):
    for text, name in (("please ask Fenna Zuvorak about it.", "Fenna Zuvorak"), ("I met Dr. Karel Zuvorak at the fair.", "Karel Zuvorak"), ("so Mr. K. Zuvorak said so.", "K. Zuvorak")):
        assert [(text[a:b], k) for a, b, k in finder.find(text)] == [(name, "name")]
    for text in ("we use Apache Zuvorak for it.", "the Mikado Zuvorak board met.", "flight to Novi Zuvorak is late."):
        assert finder.find(text) == []


def test_neighbouring_types_weigh(finder):
    from palimpsest.llm.pii import Field

    cands = [(0, 4, "name", ["a"]), (5, 9, "phone", ["b"])]
    assert Field({"a": 1.0, "b": 1.0}, {}).best(cands) == [(0, 4, "name"), (5, 9, "phone")]
    assert Field({"a": 1.0, "b": 1.0}, {("name", "phone"): -3.0}).best(cands) == [(0, 4, "name")]
    assert finder.field.steps and all(np.isfinite(list(finder.field.steps.values())))


@pytest.mark.parametrize("name", ["Wolfgang Schneider", "Maria Gonzalez", "John Smith"])
def test_names_of_no_list(finder, name):
    for before, after in (("please ask ", " about it."), ("I met Dr. ", " called."), ("Regards, ", "")):
        text = before + name + after
        assert [text[a:b] for a, b, k in finder.find(text) if k == "name"] == [name]


def test_streets_with_particles(finder):
    text = "ship it to 12 allée des Tilleuls before Monday"
    assert [(k, text[a:b]) for a, b, k in finder.find(text)] == [("address", "12 allée des Tilleuls")]


def test_words_of_any_length(model):
    s = lang.Scorer(*model)
    assert np.isfinite(s.score(["straße" * 3_000])).all()


def test_likely_names_at_any_size_of_the_lexicon():
    letters = "abcdefghijklmnopqrstuvwxyz"
    heads, tails = [f"h{a}{b}" for a in letters for b in letters], [f"{a}{b}q" for a in letters for b in letters]
    lex = Lexicon([f"ann {h}{tails[(k + d) % len(tails)]}" for k, h in enumerate(heads) for d in range(4)])
    assert lex.known(heads[0] + tails[300]) and not lex.known("zzz" + tails[300])
