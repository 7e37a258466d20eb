"""Golden cases of the reading-stream operators."""

import pytest
from pyspark.sql import functions as F

from pagetide.functions import geometry, notation, pacing, text
from pagetide.operators import sequence, speech, tokenize


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r)


@pytest.mark.parametrize(
    "value,wpm,mode,paragraph,ms",
    [("lecture", 300, "normal", False, 200), ("abcdefghij", 300, "normal", False, 275), ("a" * 15, 300, "normal", False, 400), ("a" * 20, 300, "normal", False, 525), ("straightforwardly", 300, "normal", False, 450),
     ("straightforwardly", 300, "strong", False, 600), ("straightforwardly", 600, "strong", False, 500), ("mot,", 300, "normal", False, 300), ("mot.", 300, "normal", False, 500), ("2026", 300, "normal", False, 230), ("QFT", 300, "normal", False, 230),
     ("fin.", 600, "normal", False, 400), ("fin.", 300, "normal", True, 1100), ("fin.", 600, "normal", True, 1000), ("extraordinairementlongue.", 300, "off", False, 200)],
)
def test_reading_delay(spark, value, wpm, mode, paragraph, ms):
    assert one(spark, pacing.reading_delay(F.lit(value), float(wpm), mode, None, F.lit(paragraph))) == [ms]


def test_parentheses_and_equations(spark):
    d = lambda v, m="normal": pacing.reading_delay(F.lit(v), 300.0, m)
    plain, left, both, far, off = one(spark, d("hypothèse"), d("(hypothèse"), d("(hypothèse)"), d("(hypothèse", "extreme") - d("hypothèse", "extreme"), d("(hypothèse)", "off") - d("hypothèse", "off"))
    assert (left - plain, both - plain, far, off) == (150, 300, 320, 0)
    assert one(spark, pacing.reading_delay(F.lit("E=mc²"), 300.0, "normal", F.lit("equation")))[0] >= 1200


def test_labels_and_equations(spark):
    for v in ("(1)", "(2.4)", "(2.4a)", "(A.3)", "(A3)", "(IV.2)", "[4.2]"):
        assert one(spark, notation.equation_label(F.lit(v))) == [v] and tokenize.label_of(v) == v
    assert one(spark, notation.equation_label(F.lit("4.2")), notation.equation_label(F.lit("4.2"), True), notation.equation_label(F.lit("Eq. (4.2)"))) == [None, "4.2", None]
    assert one(spark, *(notation.is_equation_like(F.lit(v)) for v in ("E = mc²", "∫ f(x) dx = F(x) + C", "Le résultat est important."))) == [True, True, False]


def test_tokenize_selection():
    got = lambda t, p=False: [(v, k) for v, k, _ in tokenize.selection_items(t, p)]
    assert got("Le résultat est important.") == [(w, "word") for w in "Le résultat est important.".split()]
    assert [v for v, _ in got("the Lagrange equa-\ntions are useful")] == ["the", "Lagrange", "equations", "are", "useful"]
    assert ("ϕ(x)", "equation") in got("a scalar field ϕ(x) is considered")
    assert ("=", "word") in got("The operator = value remains useful.")
    assert ("= ∂2 t − c2∇2", "equation") in got("The D’Alembertian operator = ∂2 t − c2∇2 ensures invariance.")
    assert all(k == "word" for _, k in got("Applying eqs (4.99) to the field, by eq. (4.95)", True))
    assert any(k == "equation" for _, k in got("the relation ϕ(x) = 0 remains", True))
    assert ("E = mc²", "equation", "(A.3a)") in tokenize.selection_items("The result is E = mc² ( A . 3a ) Therefore it holds.")
    eqs = [x for x in tokenize.selection_items("The action with respect to the field gives the equation: (i ∂t − m2c4 − 2c2∇2)ψ(t,x) = 0. (1.5)") if x[1] == "equation"]
    assert [e[2] for e in eqs] == ["(1.5)"]
    assert tokenize.selection_items(None) == []


def test_predicates_agree(spark):
    """The Column predicates and those of the Arrow path, over hostile tokens."""
    import random

    rng = random.Random(3)
    alphabet = list("aAzZéſK0129=<>+−–-*/^_()[]{}.,;:∑∂□ψΩϕ²₃\\（）\u00a0\ufeff\x1c\x85I V")
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(3000)] + ["(1)", "(ſ.1)", "(K.1)", "[ 4.2 ]", "（IV.2）.", "\\frac{a}", "sin", "ab12", "a" * 200 + "="]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t string")
    t = F.col("t")
    for r in rows.select("i", text.nfc(t).alias("t")).select("i", "t", notation.equation_label(t).alias("label"), notation.is_equation_like(t).alias("like"), notation.is_glyph_token(t).alias("glyph"), notation.is_dense_token(t).alias("dense")).collect():
        k = tokenize.kind(r.t)
        assert (tokenize.label_of(r.t), k.like, k.glyph, k.dense) == (r.label, r.like, r.glyph, r.dense), r.t


def test_tokenize_plain_and_notation_rows(spark):
    rows = [(1, "plain words only, well-\nknown equa-\ntions"), (2, "E = mc² (1.2) e\u0301"), (3, None), (4, ""), (5, "a\u2003b")]
    got = {}
    for r in tokenize.tokenize_selection(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "item_idx").collect():
        got.setdefault(r.doc_id, []).append((r.value, r.kind, r.label))
    assert got == {i: x for i, t in rows if (x := tokenize.selection_items(t))}


def test_speech_chunks_cut(spark):
    """Every chunk within the limit, all words once and in order, against a plain walk."""
    import random

    rng = random.Random(5)
    for most in (12, 40):
        values = [rng.choice(["a", "bc", "well-", "equa-", "known", "tions.", "longerword", "", " ", "Co"]) for _ in range(120)]
        items = [{"value": v, "kind": "equation" if rng.random() < 0.05 else "word", "paragraph_end": rng.random() < 0.1} for v in values]
        at = 0
        while at < len(items):
            c = tokenize.speech_chunk(items, at, most)
            shown = [c["text"][a:b] for _, a, b in c["entries"]]
            assert " ".join(shown) == c["text"] and (len(c["text"]) <= most or len(shown) == 1)
            nxt = next((i for i in range(c["end_idx"] + 1, len(items)) if items[i]["value"].strip() or items[i]["kind"] == "equation"), None)
            if c["entries"] and nxt is not None and items[nxt]["kind"] != "equation" and not items[c["end_idx"]]["paragraph_end"]:
                assert len(c["text"]) + 1 + len(items[nxt]["value"].strip()) > most or c["text"].endswith("-")
            at = max(at, c["end_idx"]) + 1


def test_line_repair(spark):
    t = lambda v: one(spark, text.clean_text(F.lit(v)))[0]
    assert t("reconnais-\nsance") == "reconnaissance" and t("well-\nknown") == "well-known" and t("value-\n42") == "value-\n42"
    assert one(spark, text.join_hyphenated(F.lit("equa-"), F.lit("tions.")), text.join_hyphenated(F.lit("second-"), F.lit("order")), text.join_hyphenated(F.lit("value-"), F.lit("42"))) == ["equations.", "second-order", None]
    assert one(spark, F.size(text.sentences(F.lit("Le chat avance. Puis il dort !")))) == [2]
    assert one(spark, *(text.is_math_token(F.lit(v)) for v in ("x=2", "∑", "pose"))) == [True, True, False]
    assert one(spark, text.orp_index(F.lit("a")), text.orp_index(F.lit("lecture"))) == [0, 2]


def items(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, item_idx long, value string, kind string, paragraph_end boolean")


def test_sentences_and_context(spark):
    x = items(spark, [("where", "word", None), ("used", "word", None), ("E", "equation", None), ("at", "word", None), ("the", "word", None), ("boundary.", "word", None)])
    got = {r.item_idx: r for r in sequence.with_context(x, 3).collect()}
    assert got[1].after == ["at", "the", "boundary."] and got[5].before == ["used", "at", "the"]
    assert all(r.before == [] for r in sequence.with_context(x, 0).collect())
    s = items(spark, [(w, "word", None) for w in "A b. C d e f. G h".split()])
    r = {r.item_idx: r for r in sequence.with_replay(s).collect()}
    assert (r[4].start_idx, r[4].end_idx, r[6].start_idx, r[6].end_idx) == (2, 5, 6, 7) and (r[4].replay_idx, r[2].replay_idx) == (2, 0)
    t = items(spark, [("therefore.", "word", True), ("E", "equation", None)])
    assert sequence.with_timeline(t).orderBy("item_idx").first().delay_ms == one(spark, pacing.reading_delay(F.lit("therefore"), 300.0))[0]


def test_speech(spark):
    assert one(spark, *(pacing.speech_rate(F.lit(float(v))) for v in (80, 200, 300, 800, -1))) == [0.4, 1.0, 1.5, 4.0, 1.0]
    w = lambda *v: [{"value": x, "kind": "equation" if x == "EQ" else "word"} for x in v]
    c = tokenize.speech_chunk(w("The", "system", "EQ", "continues"), 0)
    assert (c["text"], c["entries"], c["end_idx"]) == ("The system", [(0, 0, 3), (1, 4, 10)], 1)
    c = tokenize.speech_chunk(w("Lagrange", "equa-", "tions.", "continue"), 0)
    assert (c["text"], c["entries"], c["end_idx"]) == ("Lagrange equations. continue", [(0, 0, 8), (1, 9, 19), (3, 20, 28)], 3)
    assert one(spark, speech.speech_locale(F.lit("The system is in the field"), "fr"), speech.speech_locale(F.lit("Le système est dans le champ"), "en"), speech.speech_locale(F.lit("Hamiltonian"), "en")) == ["en-US", "fr-FR", "en-US"]
    e = spark.createDataFrame([(1, 0, 0), (1, 1, 6), (1, 2, 11)], "chunk_id long, item_idx long, start long")
    v = spark.createDataFrame([(1, 10, 0), (1, 11, 6), (1, 12, 11), (1, 13, None)], "chunk_id long, event_id long, position long")
    assert {r.event_id: r.item_idx for r in speech.boundary_items(e, v).collect()} == {10: 0, 11: 1, 12: 2, 13: 0}


def test_geometry(spark):
    data = F.array(*(F.lit(float(x)) for x in (100, 300, 50, 150, 40, 80, 20, 30, 0.9, 0.1, 0.2, 0.95)))
    (got,) = one(spark, geometry.decode_regions(F.array(F.lit(1), F.lit(6), F.lit(2)), data, F.lit(1.0)))
    assert sorted((r.kind, r.x, r.y, r.width, r.height) for r in got) == [("display", 260.0, 135.0, 80.0, 30.0), ("inline", 80.0, 40.0, 40.0, 20.0)]
    assert one(spark, geometry.model_geometry(F.lit(1190.0), F.lit(1684.0)))[0][1:] == (768, 1088, 1087)
    box = lambda x, y, w, h, k, c: F.struct(*(F.lit(v).alias(n) for v, n in zip((float(x), float(y), float(w), float(h), k, c), ("x", "y", "width", "height", "kind", "confidence"))))
    kept = one(spark, geometry.non_max_suppression(F.array(box(0, 0, 100, 40, "display", 0.8), box(1, 1, 100, 40, "display", 0.95), box(0, 0, 100, 40, "inline", 0.85))))[0]
    assert [(r.kind, r.confidence) for r in kept] == [("display", 0.95), ("inline", 0.85)]
    assert one(spark, geometry.region_for_label(F.array(box(100, 200, 400, 45, "display", 0.9), box(0, 220, 10, 10, "inline", 0.9)), F.lit(225.0)))[0].x == 100
    assert one(spark, geometry.region_for_rect(F.array(box(120, 195, 80, 20, "inline", 0.9), box(120, 200, 80, 20, "inline", 0.8)), box(120, 195, 110, 30, "x", 1.0))) == [None]
    assert tuple(one(spark, geometry.crop_bounds(box(10.5, 20.5, 100, 50, "x", 1.0), F.lit(500), F.lit(400), 8, 2))[0]) == (5, 25, 232, 132)


def test_layout(spark):
    n = lambda *v: [F.lit(None if x is None else float(x)).cast("double") for x in v]
    lay = lambda *v: tuple(one(spark, geometry.window_layout(*n(*v)))[0].asDict()[k] for k in ("width", "height", "left", "top"))
    assert lay(1400, 900, 100, 50, None, None) == (1000, 620, 300, 190)
    assert lay(800, 600, 20, 10, 1600, 1200) == (760, 560, 40, 30)
    assert one(spark, *(geometry.content_scale(c) for c in n(255, 380, 900))) == [1.0, 1.25, 1.6]
    assert one(spark, geometry.snapshot_width(*n(240, 1.25, 1)), geometry.snapshot_width(*n(480, 1, 2))) == [313, 250]
    assert one(spark, *(geometry.image_size(F.lit(v)) for v in ("140", "53", "187", "x"))) == [140, 60, 180, 100]
    assert one(spark, *(geometry.context_lane(*n(768, k)) for k in (0, 1, 3, 5)), geometry.context_lane(*n(600, 12)), geometry.context_lane(*n(1200, 12))) == [0, 134, 188, 242, 228, 300]
    assert [round(v, 6) for v in one(spark, *(geometry.pixel_ratio(*n(a, b)) for a, b in ((1200, 1600), (4000, 3000), (5000, 4000))))] == [2.0, round((16 / 12) ** 0.5, 6), 1.0]


def test_urls(spark):
    assert one(spark, text.resolve_pdf_url(F.lit("extension://x/viewer.html?file=file%3A%2F%2F%2FC%3A%2FDocuments%2Fphysics.pdf"))) == ["file:///C:/Documents/physics.pdf"]
    assert one(spark, text.page_hint(F.lit("https://a/b.pdf#page=12")), text.document_name(F.lit("https://a/b/c%20d.pdf?x"))) == [12, "c d.pdf"]


def test_chunks_of_many_rows_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    words = [f"word{i}" for i in range(300)]
    n = 1000
    values, kinds = pa.array([words] * n + [None]), pa.array([["word"] * 300] * n + [None])
    ends = pa.array([[i == 299 for i in range(300)]] * n + [None])
    want = tokenize._all_chunks(words, ["word"] * 300, [i == 299 for i in range(300)], 1000)
    tracemalloc.start()
    got = tokenize.chunk_arrays(values, kinds, ends, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and len(got) == n + 1 and got[n].as_py() == []
    assert [(c["text"], c["start_idx"], c["end_idx"], [tuple(e.values()) for e in c["entries"]]) for c in got[n - 1].as_py()] == [(c["text"], c["start_idx"], c["end_idx"], c["entries"]) for c in want]


def test_nothing_buffers_rows_that_carry_their_sentence(spark):
    from pagetide.plans import pages

    plan = pages.equation_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert "AS sentence#" in windows[0] or "collect_list" in windows[0] and "sentence_id" in windows[0], windows
