"""Passage location, regions, labels, segments and reading items."""

import pytest
from pyspark.sql import functions as F

from pagetide.functions import layout
from pagetide.operators import assemble, locate

VIEW = (1.0, 1, 0, 0, -1, 0, 600)


def item(s, x, width, y=500.0, height=10.0, font=None, eol=None):
    return (s, float(x), float(y), float(width), float(height), font, "ltr", eol)


def box(x, y, w, h, kind, c):
    return (float(x), float(y), float(w), float(h), kind, float(c))


def page(spark, items, regions, match=None):
    m = match or (0, len(items) - 1, 0, len(items[-1][0]))
    schema = f"selection_id int, page_no int, items array<{layout.ITEM}>, regions array<struct<x:double,y:double,width:double,height:double,kind:string,confidence:double>>, match struct<start:int,end:int,start_char:int,end_char:int>"
    return spark.createDataFrame([(1, 4, items, regions, m)], schema).withColumn("viewport", layout.viewport(*VIEW))


def told(df):
    return [(s.kind, s.value, s.label, s.paragraph_end) for s in df.first().segments]


def test_exact_place():
    split = ["F", "1", "(q)", " ˙", "q = dI(q)/dt", " with ", "I(q) = ∫ F", "1", "(q)"]
    hit = locate.locate(split, "F1(q)q = dI(q)/dt with I(q) = ∫F1(q)")
    assert (hit["start"], hit["end"], hit["exact"]) == (0, 8, True)
    assert locate.locate(["one two, one two"], "one two") is None
    hit = locate.locate(["say (Été là) now"], "(ete LA)")
    assert (hit["start_char"], hit["end_char"]) == (4, 12)
    assert locate.locate([], "abc") is None and locate.locate(["abc", None], "a") is None


def test_leading_equation_recovered(spark):
    values = ["H ≡ π(x) φ(x) − L(φ, π)", "(2.48)", "is the Hamiltonian density. The Hamiltonian is a local functional of the fields.", "Given two functionals:", "A[π, φ] = d3x a(π, φ)", "In particular the final conclusion follows from this definition."]
    copied = " ".join(["H≡π(x) φ(x)−L(φ,π) (2.48)", values[2], values[3], "A[π,φ] = a(π,φ) d3x", values[5]])
    hit = locate.locate(values, copied)
    assert (hit["start"], hit["start_char"], hit["exact"]) == (0, 0, False)
    items = [item(v, x, w, y) for v, (x, w, y) in zip(values, [(100, 170, 520), (430, 35, 520), (10, 390, 490), (10, 120, 470), (120, 170, 450), (10, 310, 430)])]
    got = assemble.page_segments(page(spark, items, [box(95, 65, 185, 30, "display", 0.92)], tuple(hit[k] for k in ("start", "end", "start_char", "end_char"))))
    assert told(got)[0][0] == "math"


def test_fuzzy_places():
    values = ["The field is described by", "an unrelated discussion from another chapter", "and this proves the result"]
    assert locate.locate(values, "The field is described by the Hamiltonian and its spectrum in the selected section and this proves the result") is None
    prose = [
        "In the Lagrangian description of field theory, the coordinates are treated equally.", "The Hamiltonian approach singles out the time coordinate among spacetime coordinates.",
        "This formalism is based on a choice of time slicing and a Lagrangian density.", "The canonically conjugated momentum is naturally defined by", "pi(x) = dL / d phi(x)",
        "which extends the ordinary derivative to a functional derivative.", "The relation is inverted at each point to express the field in terms of momentum.", "phi(x) maps to phi(pi(x), phi(x))",
        "The Hamiltonian is defined in analogy with mechanics by a Legendre transform:", "H(pi, phi) = integral d3x (pi(x) phi(x) - L(phi, pi))", "(2.47)", "where:",
    ]
    hit = locate.locate(prose, " ".join(prose[:9] + ["where:"]))
    assert (hit["start"], hit["end"], hit["method"]) == (0, 11, "aligned") and hit["coverage"] > 0.8
    unspaced = [v.replace(" ", "") for v in prose]
    hit = locate.locate(prose, "".join(unspaced[:9] + ["where:"]))
    assert (hit["start"], hit["method"]) == (0, "characters") and hit["coverage"] > 0.64


def test_common_pairs_against_the_plain_table():
    import random

    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        pairs = locate.common_pairs(a, b)
        assert len(pairs) == t[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_choice_of_page(spark):
    rows = [
        (1, 7, False, 0.62, 0.7, None), (1, 9, False, 0.91, 0.9, None), (2, 3, False, 0.84, 0.9, None), (2, 73, False, 0.81, 0.9, None), (3, 3, False, 0.84, 0.9, 73), (3, 73, False, 0.81, 0.9, 73),
        (4, 12, True, 1.0, 1.0, None), (4, 73, False, 0.94, 0.9, None), (5, 12, True, 1.0, 1.0, 73), (5, 73, False, 0.94, 0.9, 73), (6, 1, True, 1.0, 1.0, None), (6, 2, True, 1.0, 1.0, None), (7, 1, False, 0.5, 0.9, None),
    ]
    d = spark.createDataFrame(rows, "selection_id int, page_no int, exact boolean, score double, coverage double, hint int")
    assert {r.selection_id: r.page_no for r in locate.choose_page(d).collect()} == {1: 9, 3: 73, 5: 73}


def test_passages_by_document(spark):
    s = spark.createDataFrame([(1, 10, "the quick brown"), (2, 10, "nowhere at all"), (3, 11, None)], "selection_id int, doc_id int, text string")
    p = spark.createDataFrame([(10, 1, ["see the quick", "brown fox"]), (10, 2, ["no"]), (11, 1, ["x"])], "doc_id int, page_no int, values array<string>")
    got = locate.locate_passages(s, p).collect()
    assert [(r.selection_id, r.page_no, r.start, r.end, r.start_char, r.end_char) for r in got] == [(1, 1, 0, 1, 4, 5)]
    for shortest in ("ab", "a needle of a good many words that is quite long"):
        n = spark.createDataFrame([(1, shortest), (2, "something else entirely, not found")], "item_id int, key string").select("item_id", locate.comparable_text("key").alias("key"))
        t = spark.createDataFrame([(5, f"x {shortest} y"), (6, f"{shortest} and {shortest}"), (7, None)], "doc_id int, page string").select("doc_id", locate.comparable_text("page").alias("page"))
        assert [(r.item_id, r.doc_id, r["at"]) for r in locate.exact_passages(n, t).collect()] == [(1, 5, 2)]


def test_formula_ranges():
    glyphs = list("xy=∂2t−c2∇2ab")
    assert locate.math_range(glyphs, "= ∂2 t − c2∇2") == (2, 10)
    assert locate.math_range(["E", "=", "2", "k", "2", "⇒", "E", "=", "2", "k", "2"], "E=2k2") is None
    assert locate.math_range(["E", "=", "2", "k", "2", "w", "E", "=", "2", "k", "2"], "E=2k2", (6, 10)) == (6, 10)
    assert locate.math_range(["E", "=", "2", "x", "k", "2", "2", "m"], "E=2k22m") is None  # prose in between
    assert locate.math_range(["E", "=", "2", "+", "k", "2", "2", "m"], "E=2k22m") == (0, 7)
    assert locate.context_range(["the energy of", "the field", "E", "=", "mc", "is shown here"], "energy of the field", "is shown here") == (2, 4)
    assert locate.label_items(["eq", "(", "2.1", ")"], [10.0, 10.0, 10.2, 10.0], "(2.1)") == [3] and locate.label_items(["see (2.1)", "x"], [1.0, 2.0], "( 2.1 )") == [0]


def test_labels_on_equations(spark):
    whole = [item("E = mc2", 100, 80), item("(", 430, 4), item("A", 434, 6), item(".", 440, 3), item("3a", 443, 10), item(")", 453, 4)]
    assert told(assemble.page_segments(page(spark, whole, [box(95, 86, 90, 20, "display", 0.94)]))) == [("math", None, "(A.3a)", False)]
    bare = [item("F(x) = 0", 100, 80), item("4.2", 430, 18), item("A prose reference [7] remains here.", 10, 180, 475)]
    got = told(assemble.page_segments(page(spark, bare, [box(95, 86, 90, 20, "display", 0.94)])))
    assert got[0] == ("math", None, "4.2", False) and got[1][1] == "A prose reference [7] remains here."


@pytest.mark.parametrize("items,value,ends", [
    ([item("First paragraph.", 10, 100, 500, eol=True), item("Second one.", 10, 100, 470)], ["First paragraph.", "Second one."], [True, False]),
    ([item("one line", 10, 100, 500, eol=True), item("and the next", 10, 100, 488)], ["one line and the next"], [False]),
    ([item("the Lagrange equa-", 10, 100, 500, eol=True), item("tions hold", 10, 100, 488)], ["the Lagrange equations hold"], [False]),
    ([item("a second-", 10, 100, 500, eol=True), item("order term", 10, 100, 488)], ["a second-order term"], [False]),
    ([item("f(", 10, 20), item("x", 30, 5), item(")", 35, 5), item(", y", 40, 9)], ["f(x), y"], [False]),
])
def test_text_runs(spark, items, value, ends):
    got = told(assemble.page_segments(page(spark, items, [])))
    assert [(v, e) for _, v, _, e in got] == list(zip(value, ends))


def test_visual_items(spark):
    items = [item("We have", 10, 60, 500), item("E=mc2", 100, 60, 500), item("and ϕ(x) = 0 holds.", 10, 100, 485, eol=True), item("Next.", 10, 40, 455)]
    p = assemble.page_segments(page(spark, items, [box(98, 90, 64, 14, "inline", 0.9)]))
    got = assemble.visual_items(p).orderBy("item_idx").collect()
    assert [(r.value, r.kind, r.equation_id, r.unresolved) for r in got][:3] == [("We", "word", None, False), ("have", "word", None, False), ("mathNotation", "equation", "vision-4-0", False)]
    assert any(r.equation_id == "unresolved-4-0" and r.unresolved for r in got) and got[-1].value == "Next."
    assert [r.value for r in got if r.paragraph_end] == ["holds."] and [r.item_idx for r in got] == list(range(len(got)))


def arrays(spark, items, regions):
    return page(spark, items, regions)


def test_raised_letters(spark):
    fonts = [item("R", 100, 7, font="math"), item("n", 107.5, 4, 504, 7, "small"), item("and", 130, 20, font="body"), item("S", 160, 6, font="math"), item("n", 166.2, 4, 504, 7, "small")]
    d = arrays(spark, fonts, [])
    (r,) = d.select(layout.supplement_scripts(F.col("items"), F.col("viewport"), F.col("regions"))).first()
    assert [(x.inferred_text, x.source, x.kind, x.confidence, x.source_items) for x in r] == [("Rn", "script-layout", "inline", 0.81, [0, 1]), ("Sn", "script-layout", "inline", 0.81, [3, 4])]
    low = [item("R", 100, 7, font="math"), item("n", 107.5, 4, 498, 7, "small")]
    same = [item("R", 100, 7, font="math"), item("n", 107.5, 4, 504, 7, "math")]
    for some in (low, same):
        assert arrays(spark, some, []).select(layout.supplement_scripts(F.col("items"), F.col("viewport"), F.col("regions"))).first()[0] == []
    both, part = box(98, 80, 20, 30, "inline", 0.9), box(99, 85, 8, 20, "inline", 0.92)
    (r,) = arrays(spark, fonts[:2], [both]).select(layout.supplement_scripts(F.col("items"), F.col("viewport"), F.col("regions"))).first()
    assert len(r) == 1 and r[0].source is None
    (r,) = arrays(spark, fonts[:2], [part]).select(layout.supplement_scripts(F.col("items"), F.col("viewport"), F.col("regions"))).first()
    assert [(x.inferred_text, x.confidence) for x in r] == [("Rn", 0.92)]


def test_weak_regions(spark):
    body = [item("some ordinary body text here", 10, 200, 520, font="body"), item("more of the same text", 10, 200, 480, font="body")]
    formula = [*body, item("q", 100, 6, 500, font="math"), item("i", 106, 3, 497, 7, "small")]
    word = [*body, item("italicised", 100, 50, 500, font="italic")]
    weak = box(98, 88, 14, 18, "inline", 0.5)
    kept = lambda items, regions: arrays(spark, items, regions).select(layout.confirm_weak(F.col("items"), F.col("viewport"), F.col("regions"))).first()[0]
    assert len(kept(formula, [weak])) == 1 and kept(word, [box(98, 88, 54, 18, "inline", 0.5)]) == []
    nested = [box(90, 80, 200, 40, "inline", 0.82), box(95, 85, 20, 20, "inline", 0.9), box(150, 85, 20, 20, "inline", 0.95)]
    assert [r.confidence for r in kept(formula, nested)] == [0.9, 0.95]


def test_fonts_and_boxes(spark):
    items = [item("abcd", 0, 10, 500, 8, "b"), item("efgh", 0, 10, 490, 12, "a"), item("ab", 0, 4, 480, 30, "c"), item("", 0, 0, 0, 0)]
    d = arrays(spark, items, [])
    i, v = F.col("items"), F.col("viewport")
    r = d.select(layout.dominant_font(i).alias("f"), layout.body_height(i).alias("h"), layout.combined_rect(F.slice(i, 1, 2), v).alias("c"), layout.text_items_rect(i, v).alias("t"), layout.text_items_rect(F.slice(i, 4, 1), v).alias("n")).first()
    assert (r.f, r.h, r.n) == ("b", 12.0, None)
    assert (r.c.x, r.c.width, r.c.baseline) == (0.0, 10.0, 105.0) and r.t.width == 10.0
    inc = lambda *a: spark.range(1).select(layout.includes_item(*(F.lit(x) for x in a))).first()[0]
    assert [inc(1, 3, 4, 0, 1, 4), inc(1, 3, 0, 0, 3, 4), inc(1, 3, 0, 2, 2, 4), inc(None, None, None, None, 9, 1)] == [False, False, True, True]
