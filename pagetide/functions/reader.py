"""Small scalars of the reader: times, progress, languages, TeX text, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.geometry import image_size
from pagetide.functions.pacing import rounded
from pagetide.functions.text import one_of, trim

#: Raised and lowered digits, and signs with their TeX names.
RAISED, RAISED_PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"
LOWERED, LOWERED_PLAIN = "₀₁₂₃₄₅₆₇₈₉", "0123456789"
TEX = {
    "×": "times", "÷": "div", "≈": "approx", "≠": "neq", "≤": "leq", "≥": "geq", "≡": "equiv", "±": "pm", "∞": "infty", "∑": "sum", "∏": "prod", "∫": "int", "∂": "partial", "∇": "nabla",
    "→": "to", "↦": "mapsto", "⇒": "Rightarrow", "∝": "propto", "ℏ": "hbar", "ħ": "hbar", "ψ": "psi", "φ": "phi", "χ": "chi", "ρ": "rho", "μ": "mu", "ν": "nu", "λ": "lambda", "σ": "sigma",
    "π": "pi", "τ": "tau", "δ": "delta", "□": "Box",
}


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def math_to_latex(c: Column) -> Column:
    """Notation in Unicode as TeX: powers that lost their height, runs of raised and lowered digits, signs by name."""
    t = trim(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, "∂\\s*2\\s*([A-Za-z])", "∂^{2}_{$1}"), "∇\\s*2", "∇^{2}")
    t = F.regexp_replace(t, "([ℏħcm])\\s*([24])(?=[A-Za-zΑ-ω∂∇]|\\s|[+−=),.]|\\z)", "$1^{$2}")
    t = F.regexp_replace(F.regexp_replace(t, f"([{RAISED}]+)", "^{$1}"), f"([{LOWERED}]+)", "_{$1}")
    t = F.translate(t, RAISED + LOWERED + "−", RAISED_PLAIN + LOWERED_PLAIN + "-")
    for sign, name in TEX.items():
        t = F.replace(t, F.lit(sign), F.lit(f"\\{name} "))
    return F.replace(t, F.lit("√"), F.lit("\\sqrt{}"))


def estimated_seconds(count: Column, wpm: Column) -> Column:
    return count / wpm * 60


def format_time(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), rounded(seconds)).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def progress_percent(index: Column, total: Column) -> Column:
    return F.when(total <= 1, 0).otherwise(rounded(index / F.nullif(total - 1, F.lit(0)) * 100)).cast("long")


def loading_progress(value: Column, indeterminate: Column) -> Column:
    """Percent from 0 to 100, or null while it cannot be told."""
    return F.when(~F.coalesce(indeterminate, F.lit(False)) & _finite(value), F.greatest(F.lit(0), F.least(F.lit(100), rounded(value)))).cast("long")


def stage_progress(stage: Column, loaded: Column, total: Column) -> Column:
    """Percent of a detection stage, or null while it cannot be told."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(loaded, F.lit(0.0))) / F.nullif(total, F.lit(0.0))))
    download = F.when(_finite(total) & (total > 0), 77 + share * 11)
    fixed = {"preparing": 76.0, "queued": 77.0, "model-ready": 91.0, "postprocess": 95.0}
    out = F.when(stage == "model-download", download)
    for name, value in fixed.items():
        out = out.when(stage == name, value)
    return out


def megabytes(c: Column) -> Column:
    return F.greatest(F.lit(0), rounded(F.coalesce(c, F.lit(0)) / 1048576)).cast("long")


def ui_language_preference(c: Column) -> Column:
    return one_of(c, ("auto", "fr", "en"), "auto")


def ui_language(preference: Column, locale: Column) -> Column:
    p = ui_language_preference(preference)
    return F.when(p != "auto", p).when(F.startswith(F.lower(F.coalesce(locale, F.lit("fr"))), F.lit("en")), "en").otherwise("fr")


def equation_scale(reader_scale: Column, size: Column, least: float = 0.6, most: float = 2.4) -> Column:
    scale = F.when(_finite(reader_scale), F.greatest(F.lit(1.0), reader_scale)).otherwise(1.0) * image_size(size) / 100
    return rounded(F.least(F.lit(most), F.greatest(F.lit(least), scale)) * 100) / 100


def window_size(width: Column, height: Column) -> Column:
    return F.when(_finite(width) & _finite(height), F.struct(rounded(width).alias("width"), rounded(height).alias("height")))


def has_reader_tab(tab_urls: Column, url: Column) -> Column:
    return F.coalesce(F.exists(tab_urls, lambda u: u == url), F.lit(False))


def natural_voice(name: Column, lang: Column) -> Column:
    """The one remote voice that is preferred for English."""
    return F.coalesce(name.rlike("(?i)\\AMicrosoft Aria Online \\(Natural\\)") & (F.lower(lang) == "en-us"), F.lit(False))


def speech_event(engine: Column, event: Column, name: Column) -> Column:
    """The browser engine's events under the other's names; its boundaries that are not words, and all else, are null."""
    word = (event == "boundary") & F.coalesce(name, F.lit("")).isin("", "word")
    return F.when(engine != "web", event).when(word, "word").when(event.isin("start", "end", "error"), event)
