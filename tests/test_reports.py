"""Reports, reader scalars, page text and lines: golden cases."""

import pytest
from pyspark.sql import functions as F

from pagetide.functions import layout, reader, report
from pagetide.operators import assemble, pages, sequence
from pagetide.plans.pages import WORDS
from pagetide.sources.html import visible


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def built(description="It broke", image=None, with_image=False, excerpt="some text", with_excerpt=True):
    t = lambda v: F.lit(v).cast("string")
    n = lambda v: F.lit(v).cast("int")
    return report.build_report(t(description), t("odd"), t("en"), t("report-1"), t("now"), t(None), t("b"), n(3), n(4), n(9), n(None), n(None), t("https://x.org/a/paper%20one.pdf"), t(excerpt), F.lit(with_excerpt), t(image), F.lit(with_image))


def test_reports(spark):
    png = "data:image/png;base64,AAAA"
    r, none, private = one(spark, built(image=png, with_image=True), built("  "), built(image=png, with_excerpt=False))
    assert none is None and (r.category, r.locale, r.diagnostics.reading_position, r.diagnostics.extension_version, r.diagnostics.document_name) == ("other", "en", 5, "unknown", "paper one.pdf")
    assert (r.page_image, r.selection_excerpt, private.page_image, private.selection_excerpt) == (png, "some text", None, None)
    text, body, why, bad = one(spark, report.format_report(built(), WORDS), report.issue_body(built("a ``` b"), F.lit("https://img")), report.invalid(built()), report.invalid(built(image="data:image/gif;base64,AA", with_image=True)))
    assert text.startswith("# Report: other\n\nIt broke\n\n## Diagnostics\n- Version: unknown\n- Page: 3\n- Position: 5 / 9\n- Equations: unknown (unknown unresolved)") and text.endswith("## Excerpt\nsome text\n\nPage image: no")
    assert "``​` b" in body and body.endswith("## Private page capture\nhttps://img") and why is None and bad == "not a PNG image"
    assert one(spark, *(report.private_endpoint_allowed(F.lit(u)) for u in ("https://a/b", "http://localhost:8787/x", "http://[::1]/", "http://a/b", "no"))) == [True, True, True, False, False]
    assert one(spark, *(report.public_endpoint_allowed(F.lit(u)) for u in ("https://github.com/a/b/issues/new", "https://github.com/a/issues/new", "http://github.com/a/b/issues/new"))) == [True, False, False]
    (url,) = one(spark, report.public_issue_url(built("x " * 80, image=png, with_image=True), F.lit("https://github.com/a/b/issues/new"), WORDS))
    assert url.startswith("https://github.com/a/b/issues/new?title=%5BFeedback+other%5D+x+x") and "Page+image%3A+no" in url


@pytest.mark.parametrize("value,tex", [("E = mc2 ", "E = mc^{2}"), ("∂2 t − c2∇2", "\\partial ^{2}_{t} - c^{2}\\nabla ^{2}"), ("x² ≤ y₁₂", "x^{2} \\leq  y_{12}"), ("10⁻³", "10^{-3}"), (None, "")])
def test_latex(spark, value, tex):
    assert one(spark, reader.math_to_latex(F.lit(value).cast("string"))) == [tex]


def test_reader_scalars(spark):
    n = lambda v: F.lit(v).cast("double")
    assert one(spark, reader.format_time(n(65.4)), reader.format_time(n(-3)), reader.progress_percent(F.lit(0), F.lit(1)), reader.loading_progress(n(130), F.lit(False)), reader.loading_progress(n(float("nan")), F.lit(False))) == ["1:05", "0:00", 0, 100, None]
    assert one(spark, reader.ui_language(F.lit("odd"), F.lit("en-GB")), reader.ui_language(F.lit("fr"), F.lit("en")), reader.ui_language(F.lit(None).cast("string"), F.lit("de"))) == ["en", "fr", "fr"]
    assert one(spark, reader.equation_scale(n(1.6), F.lit("180")), reader.equation_scale(n(None), F.lit("x")), reader.has_reader_tab(F.array(F.lit("a"), F.lit("b")), F.lit("b")), reader.png_data_url(F.lit("x")) if hasattr(reader, "png_data_url") else report.png_data_url(F.lit("data:image/png;base64,x"))) == [2.4, 1.0, True, True]


def test_visible_text():
    page = "<html><head><title>t</title><style>a{}</style></head><body><nav>menu</nav><h1>Big  title</h1><p>One &amp; two<br>three</p><div>four<script>x()</script></div><footer>end</footer><svg><g>no</g></svg>five"
    assert visible(page) == "Big title\n\nOne & two\nthree\n\nfour\nfive" and visible(None) == "" == visible("<form>a<p>b</form>")


def test_lines_and_documents(spark):
    rows = [(1, 0, "Hello", 10.0, 700.0, 30.0, 10.0), (1, 1, "world", 45.0, 700.4, 30.0, 10.0), (1, 2, "!", 80.0, 699.9, 3.0, 10.0), (1, 3, " ", 0.0, 600.0, 3.0, 10.0), (1, 4, "self-", 10.0, 680.0, 20.0, 10.0), (1, 5, "made", 60.0, 680.0, 20.0, 10.0)]
    items = spark.createDataFrame(rows, "page_id int, item_idx int, str string, x double, y double, width double, height double")
    assert [r.text for r in pages.page_lines(items).collect()] == ["Hello world!\nself-made"]
    two = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id int, page_no int, text string")
    assert [tuple(r) for r in pages.document_text(two).collect()] == [(1, "a\n\nb", 2)]
    (t,) = one(spark, pages.interpolate(F.lit("{a} of {b} {c} {"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("9"))))
    assert t == "{b} of 9 {c} {"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id int, item_idx int, str string, x double, y double, width double, height double, font_name string, dir string, has_eol boolean, is_label boolean")
    assert pages.page_lines(none).count() == pages.page_fonts(none).count() == pages.equation_cluster(none).count() == pages.numbered_equation_items(none).count() == 0
    empty = spark.createDataFrame([], f"selection_id int, page_no int, items array<{layout.ITEM}>, regions array<struct<x:double,y:double,width:double,height:double,kind:string,confidence:double>>, match struct<start:int,end:int,start_char:int,end_char:int>")
    assert assemble.visual_items(assemble.page_segments(empty.withColumn("viewport", layout.viewport()))).count() == 0
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sequence.reading_items(d).count() == 0
