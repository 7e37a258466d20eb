"""Text scalars as Column expressions: line repair, focus letters, labels of records, URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as ECMAScript has it, for character classes.
SPACE = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Compound prefixes that keep their hyphen at a line break.
COMPOUND = (
    "all", "cross", "data", "double", "energy", "field", "first", "full", "gauge", "half", "high", "long", "low", "mass", "mean", "model",
    "momentum", "one", "open", "order", "real", "second", "self", "short", "space", "state", "third", "time", "two", "user", "well",
)
_ANY = f"[{SPACE}]*"
_PREFIX = "(?i:" + "|".join(COMPOUND) + ")"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def words(c: Column) -> Column:
    """Array of the runs between white space; null counts as empty."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def repair_line_hyphenation(c: Column) -> Column:
    """Joins words broken over lines. A compound's ASCII hyphen is kept, any other is dropped."""
    kept = F.regexp_replace(c, f"(?<![\\p{{L}}\\p{{M}}])({_PREFIX}-){_ANY}\\n{_ANY}(?=\\p{{Ll}})", "$1")
    return F.regexp_replace(kept, f"(?<=[\\p{{L}}\\p{{M}}])[-\\u00ad\\u2010]{_ANY}\\n{_ANY}(?=\\p{{Ll}})", "")


def join_hyphenated(left: Column, right: Column) -> Column:
    """The two fragments of a broken word in one, or null where they are not one."""
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    broken = left.rlike("[\\p{L}\\p{M}][-\\u00ad\\u2010]\\z") & right.rlike("\\A\\p{Ll}")
    compound = left.rlike(f"(?<![\\p{{L}}\\p{{M}}]){_PREFIX}-\\z")
    return F.when(broken & compound, F.concat(left, right)).when(broken, F.concat(F.left(left, F.length(left) - 1), right))


def clean_text(c: Column) -> Column:
    """Line repair, single blanks, no blank lines. c should be composed (nfc) first."""
    one = F.regexp_replace(repair_line_hyphenation(c), "[ \\t]+", " ")
    return trim(F.regexp_replace(one, f"{_ANY}\\n{_ANY}", "\n"))


def sentences(cleaned: Column) -> Column:
    """Array of sentences, paragraph by paragraph: runs up to full stops, exclamation or question marks."""
    split = F.transform(F.filter(F.split(cleaned, "\\n+"), lambda p: p != ""), lambda p: F.regexp_extract_all(p, F.lit("[^.!?]+[.!?]+|[^.!?]+\\z"), F.lit(0)))
    return F.filter(F.transform(F.flatten(split), trim), lambda s: s != "")


def is_math_token(w: Column) -> Column:
    tex = "\\\\(?:frac|sqrt|sum|int|lim|alpha|beta|gamma|theta|lambda|mu|sigma|omega)\\b"
    return w.rlike(f"{tex}|[∑∫√∞≈≠≤≥±×÷∂∇]|[A-Za-z][{SPACE}]*[=<>][{SPACE}]*[^,.;:!?]+") | (w.rlike("[0-9]") & w.rlike("[=+*/^_()\\[\\]{}]"))


def orp_index(w: Column) -> Column:
    """Place of the focus letter, by length in code points."""
    n = F.length(w)
    return F.when(n <= 1, 0).when(n <= 5, 1).when(n <= 9, 2).when(n <= 13, 3).otherwise(4)


def orp_split(w: Column) -> Column:
    """Struct of the text before the focus letter, the letter, and the rest."""
    at = F.greatest(F.least(orp_index(w), F.length(w) - 1), F.lit(0))
    return F.struct(F.left(w, at).alias("before"), F.substring(w, at + 1, F.lit(1)).alias("focus"), F.substring(w, at + 2, F.greatest(F.length(w), F.lit(1))).alias("after"))


def readable_count(w: Column) -> Column:
    return F.regexp_count(F.coalesce(w, F.lit("")), F.lit("[\\p{L}\\p{N}]"))


def is_acronym(w: Column) -> Column:
    """Two letters or more, all upper case and cased."""
    letters = F.regexp_replace(F.coalesce(w, F.lit("")), "[^\\p{L}]", "")
    cased = F.forall(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: (c == F.upper(c)) & (c != F.lower(c)))
    return (F.length(letters) >= 2) & cased


def parenthesis_count(w: Column) -> Column:
    w = F.coalesce(w, F.lit(""))
    return w.rlike("[(（]").cast("int") + w.rlike("[)）]").cast("int")


def clipped(c: Column, most: int) -> Column:
    t = trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit("…")))


def image_bytes(data_url: Column) -> Column:
    code = F.coalesce(F.get(F.split(data_url, ","), F.lit(1)), F.lit(""))
    return F.floor(F.length(code) * 3 / 4)


def one_of(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def pacing_mode(c: Column) -> Column:
    return one_of(c, ("off", "light", "normal", "strong", "extreme"), "normal")


def overview_mode(c: Column) -> Column:
    return one_of(c, ("labels", "previews"), "labels")


def reader_font(c: Column) -> Column:
    return one_of(c, ("system", "atkinson", "opendyslexic", "lexend", "latex"), "system")


def reader_theme(c: Column) -> Column:
    return one_of(c, ("classic", "minimal", "eliot"), "classic")


def feedback_mode(mode: Column, legacy_enabled: Column) -> Column:
    m, old = F.lower(trim(F.coalesce(mode, F.lit("")))), F.lower(trim(F.coalesce(legacy_enabled, F.lit(""))))
    return F.when(m.isin("public", "private", "disabled"), m).when((m != "") | (old == "false"), "disabled").otherwise("public")


def locale_prefix(c: Column) -> Column:
    return F.get(F.split(F.lower(F.coalesce(c, F.lit(""))), "-"), F.lit(0))


def normalized_locale(c: Column) -> Column:
    return F.when(locale_prefix(c) == "en", "en-US").otherwise("fr-FR")


def decode_repeatedly(c: Column) -> Column:
    """Percent-decodes up to three times; what cannot be decoded stays."""
    for _ in range(3):
        c = F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return c


def resolve_pdf_url(*urls: Column) -> Column:
    """The first PDF address in the given URLs, direct or in a file, url or src parameter."""
    found = []
    for u in urls:
        direct = F.nullif(F.regexp_extract(decode_repeatedly(u), "(?i)(?:file|https?)://[^?#\\x22\\x27]+\\.pdf(?:[?#][^\\x22\\x27]*)?", 0), F.lit(""))
        given = [F.try_url_decode(F.nullif(F.regexp_extract(u, f"[?&]{k}=([^&#]*)", 1), F.lit(""))) for k in ("file", "url", "src")]
        found += [direct, *(F.when(g.rlike("(?i)\\.pdf(?:\\z|[?#])"), decode_repeatedly(g)) for g in given)]
    return F.coalesce(*found)


def page_hint(*urls: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(decode_repeatedly(u), "(?i)(?:[#?&]page=|/page/)([0-9]+)", 1), F.lit("")) for u in urls)).cast("long")


def document_name(url: Column) -> Column:
    """Last part of a URL's path, unless that is an index page."""
    path = F.regexp_extract(url, "\\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.try_url_decode(F.replace(F.element_at(F.filter(F.split(path, "/"), lambda p: p != ""), -1), F.lit("+"), F.lit("%2B")))
    return F.when(~name.rlike("(?i)\\A(?:index|edge_pdf)\\.html?\\z"), name)
