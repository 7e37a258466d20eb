"""Predicates that tell notation from prose. Character classes are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.text import SPACE, trim, words

#: Character classes and patterns of notation.
SCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
SIGNS = "=≡+−–*/^_<>≈≠≤≥±×÷∝→↦∑∫∏√∞∂∇{}\\[\\]()"
OPERATOR = "\\A(?:=|≡|≈|≠|≤|≥|<|>|±|∝|→|↦)\\z"
ATOM = "\\A(?:(?:[A-Za-zΑ-ω]{1,3}|[A-Za-zΑ-ω]+[₀-₉ₐ-ₜ⁰¹²³⁴⁵⁶⁷⁸⁹0-9]+)|[+−-]?(?:[0-9]+(?:[.,][0-9]+)?|∞)(?:[²³⁰¹⁴⁵⁶⁷⁸⁹])?|[∑∫∏√∞∂∇□][^" + SPACE + "]*)[.,;:]?\\z"
GLYPHS = "\\A[0-9A-Za-zΑ-ωℏħψφχρμνλσπτδεγ∂∇□=≡+−–*/^_<>≈≠≤≥±×÷∝→↦⇒∑∫∏√∞{}\\[\\](),.;:" + SCRIPTS + "]+\\z"
TEX = "\\\\(?:frac|sqrt|sum|int|prod|lim|begin|end|alpha|beta|gamma|theta|lambda|sigma|omega)\\b"
LABEL = "(?:[0-9]+(?:[.:-][0-9]+)*(?:[a-z])?|(?:[A-Z]|[IVXLCDM]{2,})(?:[.:-]?[0-9]+)+(?:[a-z])?)"
GREEK = "\\u0370-\\u03ffℏħ"
STRONG = "[=≡+−–*/^_<>≈≠≤≥±×÷∝→↦∑∫∏√∞∂∇□" + GREEK + "]"
SIGNAL = "[0-9□ℏħΑ-ω∂∇≡≈≠≤≥±×÷∝→↦⇒∑∫∏√∞+−*/^_<>()\\[\\]{}]"
PROSE_WORD = "\\A[A-Za-zÀ-ÿ]{3,}\\z"
RELATION = "[=≈≠≤≥<>∝]"
DISPLAY = f"[{GREEK}∂∇∑∫∏√∞]"
FUNCTION = "\\A(?i:sin|cos|tan|log|ln|lim|exp|max|min)\\z"
PLAIN_TOKEN = "\\A(?:[A-Za-z][0-9]*[.,;:]?|[+−-]?[0-9]+(?:[.,][0-9]+)?[.,;:]?)\\z"
LONE_MARK = "\\A[()\\[\\]{}.,;:]\\z"
GREEK_LETTER = "[Α-ωℏħ]"
LONG_RUN = "[A-Za-z]{4}"
MOST_LIKE = 160
SIGN = f"[{SIGNS}{SCRIPTS}]"
SIGN_OR_BOX = f"[□{SIGNS}{SCRIPTS}]"


def equation_label(c: Column, bare: bool = False) -> Column:
    """(1), [4.2], (A.3) and the like in plain form, or null. c should be composed first."""
    t = F.regexp_replace(trim(F.coalesce(c, F.lit(""))), "\\A（", "(")
    t = F.regexp_replace(F.regexp_replace(t, "）[.,;:]?\\z", ")"), "([)\\]])[.,;:]\\z", "$1")
    ws = f"[{SPACE}]*"
    got = [F.when(t.rlike(p), F.concat(F.lit(a), F.regexp_extract(t, p, 1), F.lit(b))) for a, b, p in (("(", ")", f"(?i)\\A\\({ws}({LABEL}){ws}\\)\\z"), ("[", "]", f"(?i)\\A\\[{ws}({LABEL}){ws}\\]\\z"))]
    return F.coalesce(*got, *([F.when(t.rlike(f"(?i)\\A{LABEL}\\z"), t)] if bare else []))


def is_equation_like(c: Column) -> Column:
    t = trim(F.coalesce(c, F.lit("")))
    signs = F.regexp_count(t, F.lit(SIGN))
    prose = F.size(F.filter(words(t), lambda w: w.rlike(PROSE_WORD)))
    never = (t == "") | (F.length(t) > MOST_LIKE) | t.rlike(OPERATOR) | equation_label(t).isNotNull()
    always = t.rlike(TEX) | t.rlike(DISPLAY)
    return ~never & (always | (t.rlike(RELATION) & (signs >= 1) & (prose <= 3)) | ((signs >= 3) & (prose <= 2)))


def is_glyph_token(w: Column) -> Column:
    return w.rlike(GLYPHS) & ((F.length(w) <= 3) | w.rlike("[0-9]") | w.rlike(SIGN_OR_BOX))


def is_dense_token(w: Column) -> Column:
    """Tokens a numbered equation may hold, walking back from its label."""
    compact = F.regexp_replace(w, "[.,;:]\\z", "")
    numbered = compact.rlike(GLYPHS) & compact.rlike("[0-9]") & ~compact.rlike(LONG_RUN)
    some = w.rlike(LONE_MARK) | w.rlike(SIGN_OR_BOX) | w.rlike(GREEK_LETTER) | numbered | w.rlike(PLAIN_TOKEN)
    return F.coalesce((w != "") & equation_label(w).isNull() & some, F.lit(False))


def signal_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(SIGNAL))


def is_recoverable_glyph(c: Column) -> Column:
    return c.rlike(SIGNAL)


def has_strong_signal(c: Column) -> Column:
    return c.rlike(STRONG)
