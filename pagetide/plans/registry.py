"""Queries of the reading-stream operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import geometry, notation, pacing, text
from pagetide.operators import sequence, speech, tokenize
from pagetide.plans import pages
from pagetide.streaming import latest


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(text.words(F.col("text"))).alias("value"))


def pacing_by_document(spark, sf_dir):
    """Reading time, words and sentence ends of each document: tokens are rows, so delays are generated code, and a document's rows meet before the shuffle."""
    v = F.col("value")
    t = _docs(spark, sf_dir).select("doc_id", F.explode_outer(text.words(F.col("text"))).alias("value"))
    ms = F.sum(F.when(v.isNotNull(), pacing.reading_delay(v, 300.0)).otherwise(0.0))
    return t.groupBy("doc_id").agg(F.count("value").alias("words"), ms.alias("reading_ms"), F.count_if(v.rlike(pacing.SENTENCE)).alias("sentence_ends"))


def pacing_by_mode(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.agg(*(F.sum(pacing.reading_delay(F.col("value"), 300.0, m)).alias(f"{m}_ms") for m in pacing.PROFILES))


def basic_delay(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("m", text.is_math_token(F.col("value")))
    return t.groupBy("doc_id").agg(F.sum(pacing.basic_delay(F.col("value"), 300, F.col("m"))).cast("double").alias("delay_ms"), F.count_if("m").alias("math_tokens"))


def speech_locale(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", speech.speech_locale(F.col("text")).alias("locale"))


def orp_histogram(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy(text.orp_index(F.col("value")).cast("long").alias("orp")).agg(F.count("*").alias("n"))


def equation_like_tokens(spark, sf_dir):
    t = _tokens(spark, sf_dir).groupBy("value").count()
    v = F.col("value")
    return t.where(notation.is_equation_like(v) | notation.equation_label(v, bare=True).isNotNull()).select("value", F.col("count").alias("n"), notation.is_equation_like(v).alias("equation"), notation.equation_label(v, bare=True).alias("label"))


def token_scalars(spark, sf_dir):
    v = F.col("value")
    return _tokens(spark, sf_dir).agg(
        F.sum(text.readable_count(v)).cast("long").alias("readable"), F.count_if(text.is_acronym(v)).alias("acronyms"), F.sum(text.parenthesis_count(v)).cast("long").alias("parentheses"),
        F.count_if(notation.is_glyph_token(v)).alias("glyph_tokens"), F.sum(notation.signal_count(v)).cast("long").alias("signals"),
    )


def line_repair(spark, sf_dir):
    c = text.clean_text(text.nfc(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(c.cast("binary")).alias("cleaned_md5"), F.size(text.sentences(c)).cast("long").alias("sentences"))


def sentence_bounds(spark, sf_dir):
    x = sequence.with_replay(sequence.reading_items(_docs(spark, sf_dir)))
    return x.groupBy("doc_id").agg(F.countDistinct("sentence_id").alias("sentences"), F.sum("start_idx").cast("long").alias("starts"), F.sum("end_idx").cast("long").alias("ends"), F.sum("replay_idx").cast("long").alias("replays"))


def side_context(spark, sf_dir):
    x = sequence.with_context(sequence.reading_items(_docs(spark, sf_dir)), 3)
    return x.groupBy("doc_id").agg(F.sum(F.length(F.array_join("before", " "))).cast("long").alias("before_chars"), F.sum(F.length(F.array_join("after", " "))).cast("long").alias("after_chars"))


def timeline(spark, sf_dir):
    x = sequence.with_timeline(sequence.reading_items(_docs(spark, sf_dir)))
    return x.groupBy("doc_id").agg(F.max("start_ms").alias("last_start_ms"), F.sum("delay_ms").alias("total_ms"), F.sum("start_ms").alias("sum_start_ms"))


def tokenize_selection(spark, sf_dir):
    x = tokenize.tokenize_selection(_docs(spark, sf_dir))
    return x.groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "equation").alias("equations"), F.count("label").alias("labels"))


def speech_chunks(spark, sf_dir):
    x = tokenize.speech_chunks(_docs(spark, sf_dir).select("doc_id", sequence.item_array(F.col("text")).alias("items")))
    return x.select("doc_id", "chunk_id", F.length("text").alias("chars"), "start_idx", "end_idx", F.size("entries").alias("entries"))


def boundary_asof(spark, sf_dir):
    """Events by user as positions among the same user's page views: the last view at or before each."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.expr("timestampdiff(SECOND, timestamp_ntz'2001-09-09 01:46:40', ts)"))
    entries = e.where("event_id % 5 = 0").groupBy(F.col("user_id").alias("chunk_id"), F.col("at").alias("start")).agg(F.max("event_id").alias("item_idx"))
    return speech.boundary_items(entries, e.where("event_id % 5 <> 0").select(F.col("user_id").alias("chunk_id"), "event_id", F.col("at").alias("position")))


def latest_event_per_user(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return latest.latest_stream(e.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_id", "event_type")


def voice_choice(spark, sf_dir):
    voices = [
        {"voice_name": "Remote English", "lang": "en-US", "remote": True, "event_types": ["word"]},
        {"voice_name": "Local English", "lang": "en-US", "remote": False, "event_types": []},
        {"voice_name": "Local English Events", "lang": "en-US", "remote": False, "event_types": ["word"]},
        {"voice_name": "Local French", "lang": "fr-FR", "remote": False, "event_types": ["word"]},
    ]
    d = _docs(spark, sf_dir).withColumn("preferred", F.when(F.col("doc_id") % 7 == 0, "Remote English").otherwise("auto"))
    return d.select("doc_id", speech.choose_voice(voices, F.col("preferred"), speech.speech_locale(F.col("text"))).alias("voice"))


def url_fields(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.page_hint(F.col("url")).alias("page_hint"), text.document_name(F.col("url")).alias("document_name"))


def nms(spark, sf_dir):
    """Suppression over boxes made from order lines: one page an order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    box = lambda s, i: F.struct(
        (s["l_partkey"] % 40).cast("double").alias("x"), (s["l_suppkey"] % 20).cast("double").alias("y"), F.lit(30.0).alias("width"), F.lit(20.0).alias("height"),
        F.when(s["l_returnflag"] == "N", "display").otherwise("inline").alias("kind"), (1 - i / 100.0).alias("confidence"),
    )
    pages = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), box).alias("regions"))
    kept = geometry.non_max_suppression(F.col("regions"))
    return pages.select("l_orderkey", F.size("regions").alias("regions"), F.size(kept).alias("kept"), F.aggregate(kept, F.lit(0.0), lambda a, r: a + r["x"]).alias("kept_x"))


def layout_scalars(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w, h = (F.col("o_orderkey") % 2000).cast("double"), (F.col("o_custkey") % 1200).cast("double")
    return o.select("o_orderkey", geometry.content_scale(h).alias("content_scale"), geometry.context_lane(w, F.col("o_orderkey") % 9).cast("long").alias("lane"), geometry.pixel_ratio(w * 4, h * 4).alias("pixel_ratio"), pacing.speech_rate(w).alias("speech_rate"))


flagship = pacing_by_document
QUERIES = {
    f.__name__: f
    for f in (
        pacing_by_document, pacing_by_mode, basic_delay, speech_locale, orp_histogram, equation_like_tokens, token_scalars, line_repair, sentence_bounds, side_context,
        timeline, tokenize_selection, speech_chunks, boundary_asof, latest_event_per_user, voice_choice, url_fields, nms, layout_scalars,
    )
}

_WS = "[\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_TOKENS = f"tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '')) AS value FROM documents)"
_ENDS = "regexp_matches(value, '[.!?…]+[”’\\x22\\x27»)\\]]*$')"
_ACRONYM = "(length(regexp_replace(value, '[^\\p{L}]', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(value, '[^\\p{L}]', '', 'g'), '[^\\p{Lu}]'))"


def _delay(mode: str, paragraph: str = "false") -> str:
    step, most, num, acr, clause, paren, sent, para, factor = pacing.PROFILES[mode]
    d = lambda v: f"CAST({v} AS DOUBLE)"
    bonus = f"(CASE WHEN regexp_matches(value, '\\p{{N}}') THEN {d(num)} ELSE 0 END + CASE WHEN {_ACRONYM} THEN {d(acr)} ELSE 0 END + CASE WHEN NOT {_ENDS} AND regexp_matches(value, '[,;:]+[”’\\x22\\x27»)\\]]*$') THEN {d(clause)} ELSE 0 END)"
    length = f"least({d(most)}, greatest(0, len(regexp_extract_all(value, '[\\p{{L}}\\p{{N}}]')) - 7) * {d(step)})"
    pause = f"CASE WHEN {_ENDS} THEN {d(sent)} ELSE 0 END + (regexp_matches(value, '[(（]')::INT + regexp_matches(value, '[)）]')::INT) * {d(paren)} + CASE WHEN {paragraph} THEN {d(para)} ELSE 0 END"
    return f"floor({d(200)} * least({d(factor)}, 1 + {bonus}) + {length} + {pause} + {d(0.5)})"


_ITEMS = f"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS l FROM documents),
parts AS (SELECT doc_id, l, list_filter(regexp_split_to_array(line, '{_WS}+'), lambda w: w <> '') AS ws FROM lines),
each AS (SELECT doc_id, l, unnest(ws) AS value, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM parts),
items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l, i) - 1 AS item_idx, value, i = n AS paragraph_end FROM each)"""
_SENTENCES = f"""
s AS (SELECT *, coalesce(sum((paragraph_end OR {_ENDS})::INT) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM items),
b AS (SELECT *, min(item_idx) OVER (PARTITION BY doc_id, sid) AS st, max(item_idx) OVER (PARTITION BY doc_id, sid) AS en FROM s)"""
_FR = ", ".join(f"'{w}'" for w in speech.FRENCH)
_EN = ", ".join(f"'{w}'" for w in speech.ENGLISH)
_LOCALE = f"""loc AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), lambda w: w IN ({_FR}))) + CASE WHEN regexp_matches(lower(coalesce(text, '')), '[àâçéèêëîïôùûüÿœ]') THEN 2 ELSE 0 END AS fr,
  len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), lambda w: w IN ({_EN}))) AS en FROM documents),
locale AS (SELECT doc_id, CASE WHEN en > fr THEN 'en-US' ELSE 'fr-FR' END AS locale FROM loc)"""

ORACLE = {
    "pacing_by_document": f"""WITH {_TOKENS}, t AS (SELECT doc_id, count(*) AS words, sum({_delay('normal')}) AS reading_ms, count(*) FILTER ({_ENDS}) AS sentence_ends FROM tokens GROUP BY doc_id)
SELECT d.doc_id, coalesce(words, 0) AS words, coalesce(reading_ms, CAST(0 AS DOUBLE)) AS reading_ms, coalesce(sentence_ends, 0) AS sentence_ends FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "pacing_by_mode": f"WITH {_TOKENS} SELECT " + ", ".join(f"sum({_delay(m)}) AS {m}_ms" for m in pacing.PROFILES) + " FROM tokens",
    "basic_delay": f"""WITH {_TOKENS}, m AS (SELECT *, regexp_matches(value, '\\\\(?:frac|sqrt|sum|int|lim|alpha|beta|gamma|theta|lambda|mu|sigma|omega)\\b|[∑∫√∞≈≠≤≥±×÷∂∇]|[A-Za-z]{_WS}*[=<>]{_WS}*[^,.;:!?]+')
  OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[=+*/^_()\\[\\]{{}}]')) AS math FROM tokens)
SELECT doc_id, sum(floor(CAST(200 AS DOUBLE) * (CAST(1 AS DOUBLE) + CASE WHEN regexp_matches(value, '[.!?][”’\\x22\\x27]?$') THEN CAST(1.4 AS DOUBLE) WHEN regexp_matches(value, '[,;:][”’\\x22\\x27]?$') THEN CAST(0.65 AS DOUBLE) ELSE 0 END
  + CASE WHEN length(value) >= 12 THEN least(CAST(0.8 AS DOUBLE), (length(value) - 11) * CAST(0.08 AS DOUBLE)) ELSE 0 END + CASE WHEN math THEN CAST(1.25 AS DOUBLE) ELSE 0 END) + CAST(0.5 AS DOUBLE))) AS delay_ms, count(*) FILTER (math) AS math_tokens FROM m GROUP BY doc_id""",
    "speech_locale": f"WITH {_LOCALE} SELECT doc_id, locale FROM locale",
    "orp_histogram": f"WITH {_TOKENS} SELECT CAST(CASE WHEN length(value) <= 1 THEN 0 WHEN length(value) <= 5 THEN 1 WHEN length(value) <= 9 THEN 2 WHEN length(value) <= 13 THEN 3 ELSE 4 END AS BIGINT) AS orp, count(*) AS n FROM tokens GROUP BY 1",
    "token_scalars": f"""WITH {_TOKENS} SELECT CAST(sum(len(regexp_extract_all(value, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS readable, count(*) FILTER ({_ACRONYM}) AS acronyms,
  CAST(sum(regexp_matches(value, '[(（]')::INT + regexp_matches(value, '[)）]')::INT) AS BIGINT) AS parentheses,
  count(*) FILTER (regexp_matches(value, '^[0-9A-Za-zΑ-ωℏħψφχρμνλσπτδεγ∂∇□=≡+−–*/^_<>≈≠≤≥±×÷∝→↦⇒∑∫∏√∞{{}}\\[\\](),.;:{notation.SCRIPTS}]+$') AND (length(value) <= 3 OR regexp_matches(value, '[0-9]') OR regexp_matches(value, '{notation.SIGN_OR_BOX}'))) AS glyph_tokens,
  CAST(sum(len(regexp_extract_all(value, '{notation.SIGNAL}'))) AS BIGINT) AS signals FROM tokens""",
    "sentence_bounds": f"""WITH {_ITEMS}, {_SENTENCES}, r AS (SELECT *, CASE WHEN item_idx > st THEN st ELSE coalesce(lag(st) OVER (PARTITION BY doc_id ORDER BY item_idx), st) END AS rp FROM b)
SELECT doc_id, count(DISTINCT sid) AS sentences, CAST(sum(st) AS BIGINT) AS starts, CAST(sum(en) AS BIGINT) AS ends, CAST(sum(rp) AS BIGINT) AS replays FROM r GROUP BY doc_id""",
    "side_context": f"""WITH {_ITEMS}, c AS (SELECT doc_id, string_agg(value, ' ') OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, string_agg(value, ' ') OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM items)
SELECT doc_id, CAST(sum(length(coalesce(b, ''))) AS BIGINT) AS before_chars, CAST(sum(length(coalesce(a, ''))) AS BIGINT) AS after_chars FROM c GROUP BY doc_id""",
    "timeline": f"""WITH {_ITEMS}, d AS (SELECT doc_id, item_idx, {_delay('normal', 'paragraph_end')} AS ms FROM items), t AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS pos FROM d)
SELECT doc_id, max(pos) AS last_start_ms, sum(ms) AS total_ms, sum(pos) AS sum_start_ms FROM t GROUP BY doc_id""",
    "boundary_asof": """WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) - 1000000000 AS pos FROM events),
n AS (SELECT user_id, pos, max(event_id) AS item_idx FROM e WHERE event_id % 5 = 0 GROUP BY 1, 2), f AS (SELECT user_id, min_by(item_idx, pos) AS first FROM n GROUP BY 1),
v AS (SELECT user_id, event_id, greatest(0, pos) AS pos FROM e WHERE event_id % 5 <> 0)
SELECT v.user_id AS chunk_id, v.event_id, coalesce(n.item_idx, f.first) AS item_idx FROM v ASOF LEFT JOIN n ON v.user_id = n.user_id AND v.pos >= n.pos LEFT JOIN f ON v.user_id = f.user_id""",
    "latest_event_per_user": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "voice_choice": f"WITH {_LOCALE} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Remote English' WHEN locale = 'en-US' THEN 'Local English Events' ELSE 'Local French' END AS voice FROM locale",
    "url_fields": r"""WITH p AS (SELECT page_id, url, CAST(nullif(regexp_extract(url, '(?i)(?:[#?&]page=|/page/)([0-9]+)', 1), '') AS BIGINT) AS page_hint, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, page_hint, CASE WHEN len(parts) > 0 AND NOT regexp_matches(parts[-1], '(?i)^(?:index|edge_pdf)\.html?$') THEN parts[-1] END AS document_name FROM p""",
    "layout_scalars": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 2000 AS DOUBLE) AS w, CAST(o_custkey % 1200 AS DOUBLE) AS h, o_orderkey % 9 AS c FROM orders)
SELECT o_orderkey, floor(least(CAST(1.6 AS DOUBLE), 1 + greatest(CAST(0 AS DOUBLE), h - 255) / 500) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS content_scale,
  CAST(CASE WHEN w > 0 AND c > 0 THEN floor(least(least(CAST(300 AS DOUBLE), greatest(CAST(0 AS DOUBLE), w / 2 - 72)), greatest(CASE WHEN c = 1 THEN CAST(72 AS DOUBLE) ELSE CAST(96 AS DOUBLE) END, w * least(CAST(0.38 AS DOUBLE), CAST(0.14 AS DOUBLE) + least(7, c) * CAST(0.035 AS DOUBLE)))) + CAST(0.5 AS DOUBLE)) ELSE 0 END AS BIGINT) AS lane,
  CASE WHEN w * h > 0 THEN greatest(CAST(1 AS DOUBLE), least(CAST(2 AS DOUBLE), sqrt(CAST(16000000 AS DOUBLE) / (w * 4 * (h * 4))))) ELSE CAST(1 AS DOUBLE) END AS pixel_ratio,
  CASE WHEN w > 0 THEN floor(least(CAST(4 AS DOUBLE), greatest(CAST(0.4 AS DOUBLE), w / 200)) * 100 + CAST(0.5 AS DOUBLE)) / 100 ELSE CAST(1 AS DOUBLE) END AS speech_rate FROM o""",
}

QUERIES |= pages.QUERIES
ORACLE |= pages.ORACLE

_LABEL_SQL = f"""CASE WHEN regexp_matches(t, '(?i)^\\({_WS}*{notation.LABEL}{_WS}*\\)$') THEN '(' || regexp_extract(t, '(?i)^\\({_WS}*({notation.LABEL}){_WS}*\\)$', 1) || ')'
  WHEN regexp_matches(t, '(?i)^\\[{_WS}*{notation.LABEL}{_WS}*\\]$') THEN '[' || regexp_extract(t, '(?i)^\\[{_WS}*({notation.LABEL}){_WS}*\\]$', 1) || ']' END"""
_RE2 = lambda p: p.replace("\\A", "^").replace("\\z", "$").replace("\\u0370", "\\x{370}").replace("\\u03ff", "\\x{3ff}")
ORACLE["equation_like_tokens"] = f"""WITH {_TOKENS}, n AS (SELECT value, count(*) AS n FROM tokens GROUP BY 1),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(value, '^（', '('), '）[.,;:]?$', ')'), '([)\\]])[.,;:]$', '\\1') AS t FROM n), l AS (SELECT *, {_LABEL_SQL} AS wrapped FROM t),
e AS (SELECT *, coalesce(wrapped, CASE WHEN regexp_matches(t, '(?i)^{notation.LABEL}$') THEN t END) AS label, len(regexp_extract_all(value, '{notation.SIGN}')) AS signs, CASE WHEN regexp_matches(value, '{_RE2(notation.PROSE_WORD)}') THEN 1 ELSE 0 END AS prose FROM l),
f AS (SELECT *, length(value) <= 160 AND NOT regexp_matches(value, '{_RE2(notation.OPERATOR)}') AND wrapped IS NULL AND (regexp_matches(value, '{notation.TEX}') OR regexp_matches(value, '{_RE2(notation.DISPLAY)}') OR (regexp_matches(value, '{notation.RELATION}') AND signs >= 1) OR (signs >= 3 AND prose <= 2)) AS equation FROM e)
SELECT value, n, equation, label FROM f WHERE equation OR label IS NOT NULL"""
# the driver's documents hold no word broken at a line's end and no text in need of composition, which is all that this SQL leaves out
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '{_WS}*\\n{_WS}*', chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"
ORACLE["line_repair"] = f"""WITH c AS (SELECT doc_id, text, {_CLEAN} AS c FROM documents), s AS (SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(p, '[^.!?]+[.!?]+|[^.!?]+$'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')) AS n FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS p FROM c)),
t AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY 1) SELECT c.doc_id, CASE WHEN text IS NOT NULL THEN md5(c) END AS cleaned_md5, CASE WHEN text IS NOT NULL THEN CAST(coalesce(n, 0) AS BIGINT) END AS sentences FROM c LEFT JOIN t ON c.doc_id = t.doc_id"""
ORACLE["nms"] = """WITH RECURSIVE b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 20 AS DOUBLE) AS y, l_returnflag = 'N' AS d FROM lineitem),
r AS (SELECT k, CAST(1 AS BIGINT) AS n, [{'x': x, 'y': y, 'd': d}] AS kept FROM b WHERE n = 1
 UNION ALL SELECT b.k, b.n, CASE WHEN len(list_filter(r.kept, lambda q: q.d = b.d AND greatest(0, 30 - abs(q.x - b.x)) * greatest(0, 20 - abs(q.y - b.y)) / (1200 - greatest(0, 30 - abs(q.x - b.x)) * greatest(0, 20 - abs(q.y - b.y))) > CAST(0.45 AS DOUBLE))) > 0 THEN r.kept ELSE list_append(r.kept, {'x': b.x, 'y': b.y, 'd': b.d}) END FROM r JOIN b ON b.k = r.k AND b.n = r.n + 1)
SELECT k AS l_orderkey, CAST(n AS INTEGER) AS regions, CAST(len(kept) AS INTEGER) AS kept, list_sum(list_transform(kept, lambda q: q.x)) AS kept_x FROM r WHERE n = (SELECT max(n) FROM b WHERE b.k = r.k)"""
_EQ = "eq AS (SELECT *, item_idx % 11 = 5 AS e FROM items)"
ORACLE["equation_context"] = f"""WITH {_ITEMS}, {_EQ}, sent AS (SELECT *, coalesce(sum((paragraph_end OR {_ENDS})::INT) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid, lead(e) OVER (PARTITION BY doc_id ORDER BY item_idx) AS ne, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY item_idx) AS pn FROM eq),
sc AS (SELECT doc_id, sid, count(*) FILTER (NOT e) AS w FROM sent GROUP BY 1, 2), pr AS (SELECT doc_id, pn, length(value) AS len FROM sent WHERE NOT e),
x AS (SELECT s.doc_id, s.item_idx, s.e, s.ne, sc.w, (SELECT coalesce(sum(len) + count(*) - 1, 0) FROM pr WHERE pr.doc_id = s.doc_id AND pr.pn BETWEEN s.pn - (CASE WHEN s.e THEN 1 ELSE 2 END) AND s.pn - (CASE WHEN s.e THEN 0 ELSE 1 END)) AS b, (SELECT coalesce(sum(len) + count(*) - 1, 0) FROM pr WHERE pr.doc_id = s.doc_id AND pr.pn BETWEEN s.pn + 1 AND s.pn + 2) AS a FROM sent s JOIN sc ON s.doc_id = sc.doc_id AND s.sid = sc.sid)
SELECT doc_id, count(*) FILTER (e) AS equations, CAST(sum(greatest(b, 0)) AS BIGINT) AS before_chars, CAST(sum(greatest(a, 0)) AS BIGINT) AS after_chars, CAST(sum(w) AS BIGINT) AS sentence_words, count(*) FILTER (ne) AS before_equations FROM x GROUP BY 1"""
ORACLE["equation_timeline"] = f"""WITH {_ITEMS}, {_EQ}, nx AS (SELECT doc_id, item_idx, e, coalesce(lead(e) OVER (PARTITION BY doc_id ORDER BY item_idx), false) AND NOT e AS q, value AS whole, paragraph_end AS whole_end FROM eq),
cut AS (SELECT doc_id, item_idx, e, CASE WHEN q THEN regexp_replace(whole, '[.!?,;:…”’\\x22\\x27»)\\]]+$', '') ELSE whole END AS value, whole_end AND NOT q AS paragraph_end FROM nx),
d AS (SELECT doc_id, item_idx, e, CASE WHEN e THEN CAST(1200 AS DOUBLE) ELSE {_delay('normal', 'paragraph_end')} END AS ms FROM cut), t AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS pos FROM d)
SELECT doc_id, max(pos) AS last_start_ms, sum(ms) AS total_ms, count(*) FILTER (e) AS equations, count(*) FILTER (e AND item_idx % 2 = 0) AS unresolved FROM t GROUP BY 1"""
ORACLE["edited_items"] = f"""WITH {_ITEMS}, u AS (SELECT doc_id, item_idx, 1 AS o, false AS eq FROM items WHERE NOT (item_idx % 7 = 3 AND item_idx % 2 = 0) UNION ALL SELECT doc_id, item_idx, 0, true FROM items WHERE item_idx % 7 = 3),
n AS (SELECT doc_id, eq, row_number() OVER (PARTITION BY doc_id ORDER BY item_idx, o) - 1 AS k FROM u) SELECT doc_id, count(*) AS items, CAST(sum(CASE WHEN eq THEN k ELSE 0 END) AS BIGINT) AS equation_places FROM n GROUP BY 1"""
_KEEP = ", ".join(f"'{w}'" for w in text.COMPOUND)
ORACLE["hyphen_joins"] = f"""WITH {_ITEMS}, p AS (SELECT DISTINCT regexp_replace(value, '[^\\p{{L}}]', '', 'g') AS a, lead(value) OVER (PARTITION BY doc_id ORDER BY item_idx) AS b FROM items)
SELECT a, b, CASE WHEN a <> '' AND regexp_matches(b, '^\\p{{Ll}}') THEN CASE WHEN lower(a) IN ({_KEEP}) THEN a || '-' || b ELSE a || b END END AS joined FROM p WHERE b IS NOT NULL"""
