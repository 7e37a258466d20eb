"""How long an item is shown, as Column arithmetic over fixed profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.text import is_acronym, pacing_mode, parenthesis_count, readable_count

#: Fixed values by mode: length step and most (ms), number, acronym and clause bonus, pause at parentheses, sentences and paragraphs (ms), largest factor.
PROFILES = {
    "off": (0, 0, 0.0, 0.0, 0.0, 0, 0, 0, 1.0),
    "light": (14, 210, 0.08, 0.08, 0.3, 90, 200, 400, 2.2),
    "normal": (25, 375, 0.15, 0.15, 0.5, 150, 300, 600, 2.8),
    "strong": (40, 600, 0.25, 0.2, 0.7, 220, 400, 800, 3.4),
    "extreme": (60, 900, 0.4, 0.3, 1.0, 320, 600, 1200, 4.5),
}
CLOSERS = "[”’\\x22\\x27»)\\]]*"
SENTENCE = "[.!?…]+" + CLOSERS + "\\z"
CLAUSE = "[,;:]+" + CLOSERS + "\\z"


def rounded(c: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(c + 0.5)


def _of(mode: Column, i: int) -> Column:
    m = pacing_mode(mode)
    out = F.lit(float(PROFILES["normal"][i]))
    for name, p in PROFILES.items():
        if name != "normal":
            out = F.when(m == name, F.lit(float(p[i]))).otherwise(out)
    return out


def reading_delay(value: Column, wpm: Column | float, mode: Column | str = "normal", kind: Column | None = None, paragraph_end: Column | None = None) -> Column:
    """Milliseconds an item is shown. Equations get five beats, 1200 ms at least."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    value = F.coalesce(value, F.lit(""))
    base = F.lit(60000.0) / F.greatest(F.lit(60.0), F.lit(wpm) if not isinstance(wpm, Column) else wpm)
    ends = value.rlike(SENTENCE)
    bonus = F.when(value.rlike("\\p{N}"), _of(mode, 2)).otherwise(0.0) + F.when(is_acronym(value), _of(mode, 3)).otherwise(0.0) + F.when(~ends & value.rlike(CLAUSE), _of(mode, 4)).otherwise(0.0)
    length = F.least(_of(mode, 1), F.greatest(F.lit(0), readable_count(value) - 7) * _of(mode, 0))
    pause = F.when(ends, _of(mode, 6)).otherwise(0.0) + parenthesis_count(value) * _of(mode, 5)
    if paragraph_end is not None:
        pause = pause + F.when(F.coalesce(paragraph_end, F.lit(False)), _of(mode, 7)).otherwise(0.0)
    word = rounded(base * F.least(_of(mode, 8), 1 + bonus) + length + pause).cast("double")
    return word if kind is None else F.when(kind == "equation", F.greatest(F.lit(1200.0), base * 5)).otherwise(word)


def before_equation(value: Column) -> Column:
    """The value a word is timed by when an equation follows: without its closing punctuation."""
    return F.regexp_replace(value, "[.!?,;:…”’\\x22\\x27»)\\]]+\\z", "")


def basic_delay(value: Column, wpm: float, is_math: Column) -> Column:
    """The plain engine's delay: factors for sentence and clause ends, long words and notation. Length in UTF-16 units."""
    n = F.length(value) + F.regexp_count(value, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    end = F.when(value.rlike("[.!?][”’\\x22\\x27]?\\z"), 1.4).when(value.rlike("[,;:][”’\\x22\\x27]?\\z"), 0.65).otherwise(0.0)
    factor = 1.0 + end + F.when(n >= 12, F.least(F.lit(0.8), (n - 11) * 0.08)).otherwise(0.0) + F.when(is_math, 1.25).otherwise(0.0)
    return rounded(F.lit(60000.0 / max(50, wpm)) * factor)


def ends_sentence(value: Column, paragraph_end: Column) -> Column:
    return F.coalesce(paragraph_end, F.lit(False)) | F.coalesce(value, F.lit("")).rlike(SENTENCE)


def playback_action(n_items: Column, kind: Column, index: Column, playing: Column, equation_mode: Column) -> Column:
    manual = (kind == "equation") & (equation_mode == "manual")
    return F.when(F.coalesce(n_items, F.lit(0)) == 0, "none").when(manual & (index >= n_items - 1), "finish-equation").when(manual, "continue-equation").when(playing, "pause").otherwise("play")


def speech_rate(wpm: Column) -> Column:
    ok = wpm.isNotNull() & ~F.isnan(wpm) & (wpm > 0) & (wpm < float("inf"))
    return F.when(ok, rounded(F.least(F.lit(4.0), F.greatest(F.lit(0.4), wpm / 200)) * 100) / 100).otherwise(1.0)
