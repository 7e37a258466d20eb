"""Queries of the page, passage, report and reader operators over the driver's tables, with their SQL.

Order lines stand for text items: an order is a page, a line an item whose text, place and font come from its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.functions import geometry, layout, notation, pacing, reader, report, text
from pagetide.operators import assemble, locate, pages, sequence, speech, tokenize
from pagetide.sources.html import visible_text
from pagetide.streaming import latest

STRINGS = ("Alpha", "be", "(x)", "gamma.", ", end", "delta-", "E = mc2", " ", "Omega rho", "(2.4)", "and so we see that it holds", "4.7")
_VIEW = (2.0, 1.0, 0.0, 0.0, -1.0, 0.0, 600.0)
WORDS = {
    "feedbackTitle": "Report: {category}", "unknown": "unknown", "diagnostics": "Diagnostics", "version": "Version", "pdfPage": "Page", "position": "Position", "equations": "Equations", "unresolved": "unresolved",
    "document": "Document", "notProvided": "not provided", "browser": "Browser", "selectedExcerpt": "Excerpt", "pageImageAttached": "Page image", "yes": "yes", "no": "no",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir):
    """Items of all pages: page_id, item_idx, str, x, y, width, height, font_name, dir, has_eol."""
    names = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", *names)
    idx = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*names)) - 1
    word = F.element_at(F.array(*map(F.lit, STRINGS)), (F.col("l_partkey") % len(STRINGS) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("page_id"), idx.alias("item_idx"), word.alias("str"), (F.col("l_suppkey") % 20 * 30).cast("double").alias("x"), (F.col("l_partkey") % 40 * 2.5).cast("double").alias("y"),
        F.col("l_quantity").cast("double").alias("width"), (F.col("l_partkey") % 7 + 6).cast("double").alias("height"), F.col("l_returnflag").alias("font_name"), F.lit("ltr").alias("dir"), (F.col("l_linestatus") == "O").alias("has_eol"),
    )


def _arrays(spark, sf_dir):
    """One row a page: items, and regions made of every third item."""
    names = ("str", "x", "y", "width", "height", "font_name", "dir", "has_eol")
    x = _lines(spark, sf_dir)
    i = F.array_sort(F.collect_list(F.struct("item_idx", F.struct(*names).alias("i"))))
    region = F.struct((F.col("x") - 4).alias("x"), (600 - F.col("y") - 20).alias("y"), (F.col("width") + 30).alias("width"), F.lit(30.0).alias("height"), F.when(F.col("item_idx") % 2 == 0, "display").otherwise("inline").alias("kind"), (0.5 + F.col("item_idx") / 20.0).alias("confidence"))
    r = F.array_sort(F.collect_list(F.when(F.col("item_idx") % 3 == 0, F.struct("item_idx", region.alias("r")))))
    p = x.groupBy("page_id").agg(i.alias("i"), r.alias("r"))
    return p.select("page_id", F.transform("i", lambda s: s["i"]).alias("items"), F.transform("r", lambda s: s["r"]).alias("regions"), layout.viewport(*_VIEW).alias("viewport"))


def page_lines(spark, sf_dir):
    return pages.page_lines(_lines(spark, sf_dir))


def page_fonts(spark, sf_dir):
    return pages.page_fonts(_lines(spark, sf_dir))


def paragraph_gaps(spark, sf_dir):
    return pages.paragraph_ends(_lines(spark, sf_dir), F.lit(12.0)).groupBy("page_id").agg(F.count_if("gap_before").alias("gaps"), F.sum(F.when(F.col("gap_before"), F.col("item_idx")).otherwise(0)).cast("long").alias("places"))


def _labelled(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("is_label", F.col("item_idx") == 1)


def equation_clusters(spark, sf_dir):
    return pages.equation_cluster(_labelled(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("items"), F.sum("item_idx").cast("long").alias("places"))


def numbered_equations(spark, sf_dir):
    return pages.numbered_equation_items(_labelled(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("items"), F.sum("item_idx").cast("long").alias("places"))


def item_boxes(spark, sf_dir):
    p = _arrays(spark, sf_dir)
    i, v = F.col("items"), F.col("viewport")
    c, t = layout.combined_rect(i, v), layout.text_items_rect(i, v)
    inside = lambda k: layout.includes_item(F.lit(1), F.lit(3), F.lit(2), F.lit(0), F.lit(k), F.length(F.get(i, F.lit(k))["str"]))
    taken = F.size(F.filter(F.array(*(F.when(F.size(i) > k, inside(k)) for k in range(5))), lambda b: F.coalesce(b, F.lit(False))))
    return p.select("page_id", c["x"].alias("x"), c["y"].alias("y"), c["width"].alias("width"), c["height"].alias("height"), t["x"].alias("tx"), t["y"].alias("ty"), t["width"].alias("tw"), t["height"].alias("th"), taken.cast("long").alias("selected"))


def character_regions(spark, sf_dir):
    p = _arrays(spark, sf_dir)
    found = F.flatten(assemble.character_regions(F.col("items"), F.col("viewport"), F.col("regions")))
    inside = F.filter(found, lambda k: k.isNotNull())
    return p.select("page_id", F.size(found).cast("long").alias("characters"), F.size(inside).cast("long").alias("inside"), F.aggregate(inside, F.lit(0), lambda a, k: a + k).cast("long").alias("regions"))


def page_reading_items(spark, sf_dir):
    """Every page from items and regions to reading items: labels, segments, tokens, ids."""
    p = _arrays(spark, sf_dir).select(F.col("page_id").alias("selection_id"), F.lit(1).alias("page_no"), "items", "regions", "viewport")
    last = F.size("items") - 1
    p = p.withColumn("match", F.struct(F.lit(0).alias("start"), last.alias("end"), F.lit(0).alias("start_char"), F.length(F.get("items", last)["str"]).alias("end_char")))
    x = assemble.visual_items(assemble.page_segments(p))
    return x.groupBy("selection_id").agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "equation").alias("equations"), F.count_if("unresolved").alias("unresolved"), F.count("label").alias("labels"), F.count_if("paragraph_end").alias("paragraphs"))


def page_choice(spark, sf_dir):
    c = _lines(spark, sf_dir).select(F.col("page_id").alias("selection_id"), F.col("item_idx").alias("page_no"), (F.col("font_name") == "R").alias("exact"), ((F.col("x") * 7 + F.col("y") * 3) % 101 / 100).alias("score"), ((F.col("width") * 13) % 101 / 100).alias("coverage"), F.when(F.col("page_id") % 3 == 0, 1).alias("hint"))
    return locate.choose_page(c.withColumn("score", F.when(F.col("exact"), 1.0).otherwise(F.col("score"))).withColumn("coverage", F.when(F.col("exact"), 1.0).otherwise(F.col("coverage"))))


def passage_exact(spark, sf_dir):
    needles = _read(spark, sf_dir, "benchmark").select("item_id", locate.comparable_text(F.coalesce("text", F.lit(""))).alias("key"))
    return locate.exact_passages(needles, _read(spark, sf_dir, "documents").select("doc_id", locate.comparable_text(F.coalesce("text", F.lit(""))).alias("page"))).withColumnRenamed("at", "place")


def passage_places(spark, sf_dir):
    """The place of each benchmark passage in the lines of the documents that hold it just once."""
    found = passage_exact(spark, sf_dir).select("item_id", "doc_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), F.split(F.coalesce("text", F.lit("")), "\n").alias("values"))
    wanted = found.join(_read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id").select(F.struct("item_id", "doc_id").alias("selection_id"), "doc_id", "text")
    return locate.locate_passages(wanted, docs).select("selection_id.item_id", "selection_id.doc_id", F.col("start").alias("first_line"), F.col("end").alias("last_line"), "start_char", "end_char", "exact")


def _with_equations(spark, sf_dir):
    x = sequence.reading_items(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    eq = F.col("item_idx") % 11 == 5
    return x.withColumn("kind", F.when(eq, "equation").otherwise("word")).withColumn("unresolved", eq & (F.col("item_idx") % 2 == 0))


def equation_context(spark, sf_dir):
    """Items of which every eleventh is an equation: counts, side and sentence context, what follows, and the timeline."""
    # a sentence goes with each of its items, so nothing may sort or buffer rows after it
    x = sequence.sentence_context(sequence.with_sentences(sequence.with_next_equation(sequence.with_context(_with_equations(spark, sf_dir), 2))))
    chars = lambda c: F.sum(F.length(F.array_join(c, " "))).cast("long")
    return x.groupBy("doc_id").agg(F.count_if(F.col("kind") == "equation").alias("equations"), chars("before").alias("before_chars"), chars("after").alias("after_chars"), F.sum(F.size("sentence")).cast("long").alias("sentence_words"), F.count_if("equation_next").alias("before_equations"))


def equation_timeline(spark, sf_dir):
    x = sequence.with_timeline(_with_equations(spark, sf_dir))
    t = x.groupBy("doc_id").agg(F.max("start_ms").alias("last_start_ms"), F.sum("delay_ms").alias("total_ms"))
    return t.join(sequence.equation_counts(_with_equations(spark, sf_dir)), "doc_id")


def edited_items(spark, sf_dir):
    x = sequence.reading_items(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    added = x.where("item_idx % 7 = 3").withColumn("replace", F.col("item_idx") % 2 == 0).withColumn("value", F.lit("equation")).withColumn("kind", F.lit("equation"))
    y = sequence.insert_items(x, added)
    return y.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum(F.when(F.col("kind") == "equation", F.col("item_idx")).otherwise(0)).cast("long").alias("equation_places"))


def feedback_reports(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    t, n = F.col("text"), F.col("conv_id")
    k = lambda m: (n % m).cast("int")
    r = report.build_report(t, F.element_at(F.array(*map(F.lit, ("equation", "selection", "odd"))), k(3) + 1), F.when(k(2) == 0, "en"), F.concat(F.lit("report-"), n), F.lit("2024-01-01"), F.lit("1.2"), F.col("role"), k(9), F.col("turn").cast("int"), k(50), F.when(k(4) > 0, k(4)), F.lit(None).cast("int"), F.concat(F.lit("https://x.org/papers/p"), n, F.lit(".pdf")), t, k(3) == 0, F.when(k(5) == 0, "data:image/png;base64,AAAA"), k(2) == 0)
    c = c.select("conv_id", "turn", r.alias("r"))
    md = lambda v: F.md5(v.cast("binary"))
    bare = report.received(F.col("r"), F.lit("fresh-id-0000"))
    url = report.public_issue_url(F.col("r"), F.lit("https://github.com/a/b/issues/new"), WORDS)
    return c.select("conv_id", "turn", md(report.format_report(F.col("r"), WORDS)).alias("formatted"), md(report.issue_body(F.col("r"), F.when(F.col("conv_id") % 7 == 0, "https://img/1.png"))).alias("issue"), report.invalid(F.col("r")).alias("invalid"), bare["report_id"].alias("received_id"), F.length(bare["description"]).cast("long").alias("chars"), F.col("r.category").alias("category"), F.col("r.diagnostics.reading_position").cast("long").alias("position"), F.length("r.selection_excerpt").cast("long").alias("excerpt"), F.col("r.diagnostics.document_name").alias("document"), F.length(url).isNotNull().alias("public"))


def report_policies(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    u = F.col("url")
    gh = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://github.com/a/b/issues/new"), F.when(F.col("page_id") % 3 == 0, "/").otherwise(""))).otherwise(u)
    return p.select("page_id", report.private_endpoint_allowed(u).alias("private"), report.public_endpoint_allowed(gh).alias("public"), report.allowed_origin(F.when(F.col("page_id") % 3 == 0, "https://a").otherwise("https://c"), F.when(F.col("page_id") % 4 > 0, " https://a , https://b")).alias("origin"), F.length(report.safe_code_block(F.concat(F.lit("x```y"), u))).cast("long").alias("safe_chars"), F.length(report.cut_text(u, 12)).cast("long").alias("cut_chars"))


def reader_scalars(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stages = F.array(*map(F.lit, ("preparing", "queued", "model-download", "model-ready", "inference", "postprocess")))
    n = (k % 500).cast("double")
    return o.select(
        "o_orderkey", reader.format_time(reader.estimated_seconds(k % 5000, F.lit(300.0))).alias("time"), reader.progress_percent(k % 40, F.lit(40)).alias("percent"), reader.loading_progress(n / 3, k % 7 == 0).alias("loading"),
        reader.stage_progress(F.element_at(stages, (k % 6 + 1).cast("int")), n, F.when(k % 4 > 0, F.lit(400.0))).alias("stage"), reader.megabytes(c * 12345).alias("mb"), geometry.search_progress(n, F.lit(300.0)).alias("search"),
        reader.ui_language(F.when(k % 3 == 0, "en").when(k % 3 == 1, "xx"), F.when(c % 2 == 0, "EN-us").otherwise("de")).alias("language"), reader.equation_scale(n / 100, (c % 300).cast("string")).alias("equation_scale"),
        geometry.snapshot_width(n, n / 200, F.lit(2.0)).cast("long").alias("snapshot"), geometry.model_geometry(n + 100, F.col("o_custkey") % 900 + 50.0)["target_height"].cast("long").alias("padded"), text.reader_font(F.element_at(F.array(F.lit("lexend"), F.lit("serif")), (k % 2 + 1).cast("int"))).alias("font"),
        text.overview_mode(F.when(k % 2 == 0, "previews")).alias("overview"), text.reader_theme(F.when(k % 2 == 0, "eliot").otherwise("no")).alias("theme"), text.feedback_mode(F.when(k % 4 == 0, " Private ").when(k % 4 == 1, "odd"), F.when(k % 3 == 0, "FALSE")).alias("feedback"),
        pacing.playback_action(k % 3, F.when(c % 2 == 0, "equation").otherwise("word"), k % 4, c % 5 == 0, F.when(c % 3 == 0, "manual").otherwise("timed")).alias("action"), reader.natural_voice(F.when(k % 2 == 0, "Microsoft Aria Online (Natural) - x").otherwise("Other"), F.when(c % 2 == 0, "en-US").otherwise("fr")).alias("natural"),
        reader.speech_event(F.when(k % 2 == 0, "web").otherwise("own"), F.element_at(F.array(*map(F.lit, ("start", "boundary", "end", "pause"))), (c % 4 + 1).cast("int")), F.when(k % 3 == 0, "word").when(k % 3 == 1, "sentence")).alias("event"),
    )


def token_details(spark, sf_dir):
    v = F.col("value")
    t = _read(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("value")).groupBy("value").count()
    o = text.orp_split(v)
    return t.select("value", o["before"].alias("before"), o["focus"].alias("focus"), F.left(o["after"], F.lit(1)).alias("after"), text.clipped(v, 5).alias("clipped"), notation.is_recoverable_glyph(v).alias("glyph"), text.image_bytes(F.concat(F.lit("d,"), v)).cast("long").alias("bytes"))


def hyphen_joins(spark, sf_dir):
    """Each word and the next of a document as fragments of one, the first with a hyphen."""
    x = sequence.reading_items(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    x = x.select("doc_id", F.regexp_replace("value", "[^\\p{L}]", "").alias("a"), F.lead("value").over(W.partitionBy("doc_id").orderBy("item_idx")).alias("b")).where("b is not null").groupBy("a", "b").count()
    return x.select("a", "b", text.join_hyphenated(F.concat("a", F.lit("-")), F.col("b")).alias("joined"))


def translations(spark, sf_dir):
    messages = spark.createDataFrame([("fr", "pos", "{current} sur {total}"), ("en", "pos", "{current} of {total} {x}"), ("fr", "title", "Bonjour")], "lang string, key string, template string")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "en").when(F.col("o_orderkey") % 5 == 0, "de").otherwise("fr").alias("lang"), F.element_at(F.array(*map(F.lit, ("pos", "title", "none"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("key"), F.create_map(F.lit("current"), F.col("o_custkey").cast("string"), F.lit("total"), F.lit("9")).alias("values"))
    return pages.translate(o, messages).select("o_orderkey", "label")


def equation_images(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("equation_id"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("m"), "o_orderkey")).alias("manual_image"))
    images = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("equation_id")).agg(F.concat(F.lit("d"), F.max("l_partkey")).alias("image"), F.max("l_quantity").alias("ratio"))
    return pages.equation_images(o, images).drop("manual_image")


def playback_commands(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    command = F.element_at(F.array(*map(F.lit, ("next", "previous", "play", "toggle", "pause", "next", "clear"))), (F.col("event_id") % 7 + 1).cast("int"))
    return latest.playback_states(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), command.alias("command"), F.lit(4).alias("n_items")))


def voices(spark, sf_dir):
    c = lambda df, key, name, engine: df.select(F.concat(F.lit(" Voice "), F.col(key) % 37).alias("voice_name"), F.when(F.col(key) % 2 == 0, "en-US").otherwise("FR-fr").alias("lang"), F.lit(engine).alias("engine"), F.col(key).alias("nth"))
    return speech.unique_voices(c(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "web"), c(_read(spark, sf_dir, "customer"), "c_custkey", "c_name", "own")).select("voice_name", "lang", "engine", "nth")


def page_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", visible_text("html").alias("text"))


def prose_items(spark, sf_dir):
    x = tokenize.tokenize_selection(_read(spark, sf_dir, "documents"), detected_prose=True)
    return x.groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "equation").alias("equations"))


QUERIES = {
    f.__name__: f
    for f in (
        page_lines, page_fonts, paragraph_gaps, equation_clusters, numbered_equations, item_boxes, character_regions, page_reading_items, page_choice, passage_exact, passage_places, equation_context, equation_timeline,
        edited_items, feedback_reports, report_policies, reader_scalars, token_details, hyphen_joins, translations, equation_images, playback_commands, voices, page_text, prose_items,
    )
}

_STR = "[" + ", ".join(f"'{s}'" for s in STRINGS) + "]"
_ITEMS = f"""items AS (SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS INTEGER) AS item_idx,
  ({_STR})[l_partkey % {len(STRINGS)} + 1] AS str, CAST(l_suppkey % 20 * 30 AS DOUBLE) AS x, CAST(l_partkey % 40 AS DOUBLE) * CAST(2.5 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS width, CAST(l_partkey % 7 + 6 AS DOUBLE) AS height, l_returnflag AS font, l_linestatus = 'O' AS eol FROM lineitem)"""
_D = lambda v: f"CAST({v} AS DOUBLE)"
_CLUSTER = f"""hs AS (SELECT page_id, list_sort(list(height) FILTER (height > 0)) AS h FROM content GROUP BY 1),
c1 AS (SELECT c.*, 2 * h[CAST(floor(len(h) / 2) AS INTEGER) + 1] AS most, max(x + width) OVER (PARTITION BY c.page_id ORDER BY x, item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM content c JOIN hs ON c.page_id = hs.page_id),
c2 AS (SELECT *, sum(CASE WHEN x - reach > most THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x, item_idx) AS c FROM c1),
c3 AS (SELECT page_id, c, sum(len(regexp_extract_all(str, '{notation.SIGNAL}'))) * 100 + max(x + width) - min(x) AS score FROM c2 GROUP BY 1, 2),
c4 AS (SELECT page_id, c FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, c) AS r FROM c3) WHERE r = 1),
picked AS (SELECT page_id, item_idx FROM c2 JOIN c4 USING (page_id, c) UNION ALL SELECT page_id, item_idx FROM items WHERE item_idx = 1)
SELECT page_id, count(*) AS items, CAST(sum(item_idx) AS BIGINT) AS places FROM picked GROUP BY 1"""
_RECT = "least(x, x + width) AS rx, greatest(x, x + width) AS rr, 600 - y AS base, greatest(CAST(4 AS DOUBLE), height * 2) AS h"
_MD = lambda parts: "md5(" + " || ".join(parts) + ")"
_WSC = "[\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WSC}+|{_WSC}+$', '', 'g')"

ORACLE = {
    "page_lines": f"""WITH {_ITEMS}, n AS (SELECT *, floor(y / 3 + {_D(0.5)}) * 3 AS line FROM items WHERE trim(str) <> ''),
p AS (SELECT *, x - lag(x + width) OVER w AS gap, lag(str) OVER w AS before FROM n WINDOW w AS (PARTITION BY page_id, line ORDER BY x, item_idx)),
q AS (SELECT *, CASE WHEN gap > greatest({_D(1.5)}, height * {_D(0.12)}) AND NOT regexp_matches(before, '[-(/]$') AND NOT regexp_matches(str, '^[,.;:!?)]') THEN ' ' ELSE '' END || str AS piece FROM p),
l AS (SELECT page_id, line, trim(string_agg(piece, '' ORDER BY x, item_idx)) AS t FROM q GROUP BY 1, 2) SELECT page_id, string_agg(t, chr(10) ORDER BY line DESC) AS text FROM l WHERE t <> '' GROUP BY 1""",
    "page_fonts": f"""WITH {_ITEMS}, n AS (SELECT *, len(regexp_extract_all(str, '\\p{{L}}')) AS n FROM items), b AS (SELECT page_id, font, sum(n) AS n, min(item_idx) AS first FROM n WHERE n >= 4 GROUP BY 1, 2),
f AS (SELECT page_id, font FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first) AS r FROM b) WHERE r = 1),
h AS (SELECT page_id, list_sort(list(height)) AS hs FROM n WHERE n >= 4 GROUP BY 1)
SELECT p.page_id, font, coalesce(hs[CAST(floor(len(hs) / 2) AS INTEGER) + 1], {_D(10)}) AS body_height FROM (SELECT DISTINCT page_id FROM items) p LEFT JOIN f ON p.page_id = f.page_id LEFT JOIN h ON p.page_id = h.page_id""",
    "paragraph_gaps": f"""WITH {_ITEMS}, g AS (SELECT page_id, item_idx, coalesce((lag(eol) OVER w OR x < lag(x) OVER w - 12) AND lag(y) OVER w - y > 12 * {_D(1.55)}, false) AS gap FROM items WINDOW w AS (PARTITION BY page_id ORDER BY item_idx))
SELECT page_id, count(*) FILTER (gap) AS gaps, CAST(sum(CASE WHEN gap THEN item_idx ELSE 0 END) AS BIGINT) AS places FROM g GROUP BY 1""",
    "equation_clusters": f"WITH {_ITEMS}, content AS (SELECT * FROM items WHERE item_idx <> 1), {_CLUSTER}",
    "numbered_equations": f"""WITH {_ITEMS}, prose AS (SELECT *, len(list_filter(regexp_split_to_array(lower(str), '\\s+'), lambda w: len(regexp_replace(w, '[^a-z0-9]+', '', 'g')) >= 2)) >= 5 AS prose FROM items WHERE page_id IN (SELECT page_id FROM items WHERE item_idx = 1)),
nb AS (SELECT page_id, max(CASE WHEN prose AND item_idx < 1 THEN item_idx END) AS bi, arg_max(y, item_idx) FILTER (prose AND item_idx < 1) AS byy, min(CASE WHEN prose AND item_idx > 1 THEN item_idx END) AS ei, arg_min(y, item_idx) FILTER (prose AND item_idx > 1) AS ey FROM prose GROUP BY 1),
content AS (SELECT p.* FROM prose p JOIN nb ON p.page_id = nb.page_id WHERE item_idx <> 1 AND trim(str) <> '' AND (bi IS NULL OR (item_idx > bi AND y < byy)) AND (ei IS NULL OR (item_idx < ei AND y > ey))), {_CLUSTER}""",
    "item_boxes": f"""WITH {_ITEMS}, r AS (SELECT page_id, item_idx, str, x AS px, width AS pw, height AS ph, {_RECT} FROM items),
t AS (SELECT page_id, min(px) AS tx, min(base - greatest({_D(8)}, ph * 2) * {_D(1.3)}) AS ty, max(px + pw * 2) AS tr, max(base + greatest({_D(8)}, ph * 2) * {_D(0.35)}) AS tb FROM r WHERE trim(str) <> '' GROUP BY 1),
s AS (SELECT page_id, count(*) FILTER (item_idx BETWEEN 1 AND 3 AND NOT (item_idx = 1 AND 2 >= length(str)) AND NOT (item_idx = 3)) AS selected, min(rx) AS x, min(base - h * {_D(1.2)}) AS y, max(rx + (rr - rx)) AS r, max(base - h * {_D(1.2)} + h * {_D(1.5)}) AS b FROM r GROUP BY 1)
SELECT s.page_id, x, y, r - x AS width, b - y AS height, tx, ty, tr - tx AS tw, tb - ty AS th, selected FROM s LEFT JOIN t ON s.page_id = t.page_id""",
    "character_regions": f"""WITH {_ITEMS}, g AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY item_idx) - 1 AS k, x - 4 AS gx, 600 - y - 20 AS gy, width + 30 AS gw, {_D(30)} AS gh, CASE WHEN item_idx % 2 = 0 THEN 1 ELSE 0 END AS d, {_D(0.5)} + item_idx / {_D(20)} AS conf FROM items WHERE item_idx % 3 = 0),
r AS (SELECT page_id, item_idx, str, {_RECT} FROM items), ch AS (SELECT *, unnest(range(length(str))) AS o FROM r), cx AS (SELECT *, rx + (rr - rx) * ((o + {_D(0.5)}) / length(str)) AS cx, base - h * {_D(1.2)} AS ry, h * {_D(1.5)} AS rh FROM ch),
hit AS (SELECT c.page_id, c.item_idx, c.o, k, row_number() OVER (PARTITION BY c.page_id, c.item_idx, c.o ORDER BY d DESC, conf DESC, k) AS n FROM cx c JOIN g ON c.page_id = g.page_id
  AND cx BETWEEN gx - least({_D(4)}, greatest({_D(1)}, gh * {_D(0.15)})) AND gx + gw + least({_D(4)}, greatest({_D(1)}, gh * {_D(0.15)})) AND base BETWEEN gy - gh * {_D(0.35)} AND gy + gh * {_D(1.35)}
  AND greatest({_D(0)}, least(ry + rh, gy + gh) - greatest(ry, gy)) >= least(rh, gh) * {_D(0.1)}), one AS (SELECT page_id, count(*) AS inside, CAST(sum(k) AS BIGINT) AS regions FROM hit WHERE n = 1 GROUP BY 1)
SELECT a.page_id, characters, coalesce(inside, 0) AS inside, coalesce(regions, 0) AS regions FROM (SELECT page_id, CAST(sum(length(str)) AS BIGINT) AS characters FROM items GROUP BY 1) a LEFT JOIN one ON a.page_id = one.page_id""",
    "page_choice": f"""WITH {_ITEMS}, c AS (SELECT page_id, item_idx AS page_no, font = 'R' AS exact, CASE WHEN font = 'R' THEN {_D(1)} ELSE (x * 7 + y * 3) % 101 / 100 END AS score, CASE WHEN font = 'R' THEN {_D(1)} ELSE (width * 13) % 101 / 100 END AS coverage, CASE WHEN page_id % 3 = 0 THEN 1 END AS hint FROM items),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, page_no) AS r FROM c),
g AS (SELECT page_id, min(page_no) FILTER (page_no = hint AND (exact OR (score >= {_D(0.58)} AND coverage >= {_D(0.45)}))) AS hinted, count(*) FILTER (exact) AS exacts, min(page_no) FILTER (exact) AS sure, max(score) FILTER (NOT exact) AS rival,
  max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2, max(coverage) FILTER (r = 1) AS c1, max(page_no) FILTER (r = 1) AS p1 FROM n GROUP BY 1),
o AS (SELECT page_id AS selection_id, CASE WHEN hinted IS NOT NULL THEN hinted WHEN exacts > 0 THEN CASE WHEN exacts = 1 AND coalesce(rival, 0) <= {_D(0.9)} THEN sure END WHEN s1 >= {_D(0.58)} AND c1 >= {_D(0.45)} AND (s2 IS NULL OR s1 - s2 >= {_D(0.1)}) THEN p1 END AS page_no FROM g)
SELECT * FROM o WHERE page_no IS NOT NULL""",
    "passage_exact": r"""WITH d AS (SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents), b AS (SELECT item_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}]', '', 'g') AS k FROM benchmark),
h AS (SELECT item_id, doc_id, instr(t, k) AS p, t, k FROM d JOIN b ON length(k) >= 2 AND contains(t, k)) SELECT item_id, doc_id, CAST(p AS INTEGER) AS place FROM h WHERE NOT contains(substr(t, p + 1), k)""",
    "translations": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'en' WHEN o_orderkey % 5 = 0 THEN 'de' ELSE 'fr' END AS lang, o_orderkey % 3 AS k, o_custkey AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN c || CASE WHEN lang = 'en' THEN ' of 9 {x}' ELSE ' sur 9' END WHEN 1 THEN 'Bonjour' ELSE 'none' END AS label FROM o""",
    "equation_images": """WITH d AS (SELECT l_orderkey AS k, 'd' || max(l_partkey) AS image, max(l_quantity) AS ratio FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k FROM orders)
SELECT o.k AS equation_id, CASE WHEN o.k % 4 = 0 THEN 'm' || o.k ELSE image END AS image, CASE WHEN o.k % 4 = 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(ratio, CAST(1 AS DOUBLE)) END AS pixel_ratio FROM o LEFT JOIN d ON o.k = d.k""",
    "playback_commands": """WITH RECURSIVE e AS (SELECT user_id AS session_id, event_id AS seq, ['next', 'previous', 'play', 'toggle', 'pause', 'next', 'clear'][event_id % 7 + 1] AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 0 AS i, false AS p FROM (SELECT DISTINCT session_id FROM e)
 UNION ALL SELECT e.session_id, e.n, e.seq, greatest(0, least(3, s.i + CASE e.c WHEN 'next' THEN 1 WHEN 'previous' THEN -1 ELSE 0 END)), CASE e.c WHEN 'play' THEN true WHEN 'pause' THEN false WHEN 'toggle' THEN NOT s.p WHEN 'clear' THEN false ELSE s.p END FROM s JOIN e ON e.session_id = s.session_id AND e.n = s.n + 1)
SELECT session_id, seq, i AS index, p AS playing FROM s WHERE seq IS NOT NULL""",
    "voices": """WITH v AS (SELECT ' Voice ' || (s_suppkey % 37) AS voice_name, CASE WHEN s_suppkey % 2 = 0 THEN 'en-US' ELSE 'FR-fr' END AS lang, 'web' AS engine, s_suppkey AS nth, 0 AS o FROM supplier UNION ALL SELECT ' Voice ' || (c_custkey % 37), CASE WHEN c_custkey % 2 = 0 THEN 'en-US' ELSE 'FR-fr' END, 'own', c_custkey, 1 FROM customer)
SELECT voice_name, lang, engine, nth FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(voice_name)), lower(lang) ORDER BY o, nth) AS r FROM v) WHERE r = 1""",
    "token_details": f"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WSC}+'), lambda w: w <> '')) AS value FROM documents), p AS (SELECT value, greatest(0, least(CASE WHEN length(value) <= 1 THEN 0 WHEN length(value) <= 5 THEN 1 WHEN length(value) <= 9 THEN 2 WHEN length(value) <= 13 THEN 3 ELSE 4 END, length(value) - 1)) AS f FROM w)
SELECT value, left(value, f) AS before, substr(value, f + 1, 1) AS focus, substr(value, f + 2, 1) AS after, CASE WHEN length(value) <= 5 THEN value ELSE left(value, 4) || '…' END AS clipped, regexp_matches(value, '{notation.SIGNAL}') AS glyph, CAST(floor(length(split_part(value, ',', 1)) * 3 / 4) AS BIGINT) AS bytes FROM p""",
    "report_policies": r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'https://github.com/a/b/issues/new' || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END ELSE url END AS gh, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', ['s', 'h']) AS u FROM pages)
SELECT page_id, coalesce(u.s = 'https' OR (u.s = 'http' AND u.h IN ('localhost', '127.0.0.1', '[::1]')), false) AS private, coalesce(regexp_matches(gh, '^https://github\.com/[^/]+/[^/]+/issues/new/?$'), false) AS public,
 CASE WHEN page_id % 4 = 0 THEN '*' WHEN page_id % 3 = 0 THEN 'https://a' END AS origin, length('x```y' || url) + 1 AS safe_chars, length(left(coalesce(url, ''), 12)) AS cut_chars FROM p""",
}
_KNOWN = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'unknown')"
ORACLE["feedback_reports"] = f"""WITH c AS (SELECT conv_id, turn, role, {_TRIM("coalesce(text, '')")} AS t, ['equation', 'selection', 'other'][conv_id % 3 + 1] AS cat, CAST(conv_id % 9 AS VARCHAR) AS page, CAST(turn + 1 AS VARCHAR) AS pos, CAST(conv_id % 50 AS VARCHAR) AS items, CASE WHEN conv_id % 4 > 0 THEN CAST(conv_id % 4 AS VARCHAR) END AS eqs, 'p' || conv_id || '.pdf' AS doc FROM conversations),
d AS (SELECT *, CASE WHEN length(t) <= 1500 THEN t ELSE left(t, 1499) || '…' END AS descr, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN length(t) <= 2500 THEN t ELSE left(t, 2499) || '…' END END AS ex, conv_id % 10 = 0 AS img FROM c),
o AS (SELECT *, chr(10) AS nl, {_KNOWN('eqs')} AS eq FROM d)
SELECT conv_id, turn, CASE WHEN descr <> '' THEN md5('# Report: ' || cat || nl || nl || descr || nl || nl || '## Diagnostics' || nl || '- Version: 1.2' || nl || '- Page: ' || page || nl || '- Position: ' || pos || ' / ' || items || nl || '- Equations: ' || eq || ' (unknown unresolved)' || nl || '- Document: ' || doc || nl || '- Browser: ' || role
  || CASE WHEN coalesce(ex, '') <> '' THEN nl || nl || '## Excerpt' || nl || ex ELSE '' END || nl || nl || 'Page image: ' || CASE WHEN img THEN 'yes' ELSE 'no' END) END AS formatted,
 CASE WHEN descr <> '' THEN md5('**Report ID:** `report-' || conv_id || '`' || nl || '**Created:** 2024-01-01' || nl || '**Extension:** 1.2' || nl || '**PDF page:** ' || page || nl || '**Reading position:** ' || pos || ' / ' || items || nl || '**Equations:** ' || eq || ' (unknown unresolved)' || nl || '**Document:** ' || doc || nl || '**Browser:** ' || role || nl || nl || '## Description' || nl || replace(descr, '```', '``' || chr(8203) || '`')
  || CASE WHEN coalesce(ex, '') <> '' THEN nl || nl || '## Selected excerpt' || nl || '```text' || nl || replace(ex, '```', '``' || chr(8203) || '`') || nl || '```' ELSE '' END || CASE WHEN conv_id % 7 = 0 THEN nl || nl || '## Private page capture' || nl || 'https://img/1.png' ELSE '' END) END AS issue,
 CASE WHEN descr = '' THEN 'no report' END AS invalid, CASE WHEN length('report-' || conv_id) >= 8 AND descr <> '' THEN 'report-' || conv_id ELSE 'fresh-id-0000' END AS received_id, length(descr) AS chars, CASE WHEN descr <> '' THEN cat END AS category, CASE WHEN descr <> '' THEN CAST(turn + 1 AS BIGINT) END AS position,
 CASE WHEN descr <> '' THEN length(ex) END AS excerpt, CASE WHEN descr <> '' THEN doc END AS document, descr <> '' AS public FROM o"""
_D5 = _D(0.5)
ORACLE["reader_scalars"] = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderkey % 500 AS DOUBLE) AS n FROM orders), s AS (SELECT *, CAST(floor((k % 5000) / {_D(300)} * 60 + {_D5}) AS BIGINT) AS sec FROM o)
SELECT k AS o_orderkey, (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS time, CAST(floor((k % 40) / {_D(39)} * 100 + {_D5}) AS BIGINT) AS percent,
 CASE WHEN k % 7 <> 0 THEN CAST(greatest(0, least(100, floor(n / 3 + {_D5}))) AS BIGINT) END AS loading,
 CASE k % 6 WHEN 0 THEN {_D(76)} WHEN 1 THEN {_D(77)} WHEN 2 THEN CASE WHEN k % 4 > 0 THEN 77 + greatest({_D(0)}, least({_D(1)}, n / 400)) * 11 END WHEN 3 THEN {_D(91)} WHEN 5 THEN {_D(95)} END AS stage,
 CAST(floor(c * 12345 / {_D(1048576)} + {_D5}) AS BIGINT) AS mb, 8 + greatest({_D(0)}, least({_D(300)}, n)) / 300 * 62 AS search, CASE WHEN k % 3 = 0 THEN 'en' WHEN c % 2 = 0 THEN 'en' ELSE 'fr' END AS language,
 floor(least({_D(2.4)}, greatest({_D(0.6)}, greatest({_D(1)}, n / 100) * least(180, greatest(60, floor(CAST(c % 300 AS DOUBLE) / 10 + {_D5}) * 10)) / 100)) * 100 + {_D5}) / 100 AS equation_scale,
 CASE WHEN n > 0 THEN CAST(floor((n / 2 + 10) * least({_D(2.4)}, greatest({_D(0.6)}, n / 200)) + {_D5}) AS BIGINT) END AS snapshot, CAST(ceil(floor((c % 900 + {_D(50)}) * ({_D(768)} / (n + 100)) + {_D5}) / 32) * 32 AS BIGINT) AS padded,
 CASE WHEN k % 2 = 0 THEN 'lexend' ELSE 'system' END AS font, CASE WHEN k % 2 = 0 THEN 'previews' ELSE 'labels' END AS overview, CASE WHEN k % 2 = 0 THEN 'eliot' ELSE 'classic' END AS theme,
 CASE WHEN k % 4 = 0 THEN 'private' WHEN k % 4 = 1 OR k % 3 = 0 THEN 'disabled' ELSE 'public' END AS feedback,
 CASE WHEN k % 3 = 0 THEN 'none' WHEN c % 2 = 0 AND c % 3 = 0 THEN CASE WHEN k % 4 >= k % 3 - 1 THEN 'finish-equation' ELSE 'continue-equation' END WHEN c % 5 = 0 THEN 'pause' ELSE 'play' END AS action,
 k % 2 = 0 AND c % 2 = 0 AS natural, CASE WHEN k % 2 = 1 THEN ['start', 'boundary', 'end', 'pause'][c % 4 + 1] WHEN c % 4 = 1 AND k % 3 <> 1 THEN 'word' WHEN c % 4 IN (0, 2) THEN ['start', 'boundary', 'end'][c % 4 + 1] END AS event FROM s"""
