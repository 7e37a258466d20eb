"""Where a selected passage stands in a page's text items, and which page it is.

Selections meet the pages of their own document by an equality join; matching one selection with one
page is bounded work and runs in Arrow batches: an exact place first, then word anchors, aligned words and
aligned characters. Offsets are in code points. The choice among pages is an aggregate a selection.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from pagetide.functions import notation as nt

#: Lengths and shares a match must reach.
ANCHORED = {"words": 4, "coverage": 0.45, "score": 0.55, "margin": 0.08}
ALIGNED = {"words": 12, "long": 40, "coverage": (0.70, 0.62), "end": 0.82, "similar": 0.45, "weights": (0.80, 0.15, 0.05)}
CHARACTERS = {"chars": 80, "long": 400, "coverage": (0.72, 0.64), "end": 0.84, "similar": 0.42, "weights": (0.82, 0.13, 0.05), "anchors": (48, 36, 28)}
PAGE = {"score": 0.58, "coverage": 0.45, "margin": 0.1, "rival": 0.9}

_MARKS = re.compile("[̀-ͯ]")
MATCH = "start int, end int, start_char int, end_char int, exact boolean, score double, coverage double, method string"


def plain(text: str) -> str:
    """Decomposed, without the common combining marks, in lower case."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text)).lower()


def _readable(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


@dataclass
class Stream:
    """Units (characters or words) of several values in order, each with the value it stands in and its place there."""

    units: list[str] = field(default_factory=list)
    item: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    def add(self, unit: str, item: int, a: int, b: int) -> None:
        self.units.append(unit)
        self.item.append(item)
        self.first.append(a)
        self.last.append(b)

    def __len__(self) -> int:
        return len(self.units)


def comparable(values: list[str]) -> Stream:
    """Letters and digits of the values, compared without case and marks; places are those in the values."""
    out = Stream()
    for item, value in enumerate(values):
        for at, c in enumerate(value or ""):
            for unit in plain(c):
                if _readable(unit):
                    out.add(unit, item, at, at + 1)
    return out


def word_stream(values: list[str], least: int = 1) -> Stream:
    """Runs of letters and digits of the values; places are those in the decomposed value, without its marks."""
    out = Stream()
    for item, value in enumerate(values):
        for m in re.finditer(r"[^\W_]+", plain(value or "")):
            if len(m[0]) >= least:
                out.add(m[0], item, m.start(), m.end())
    return out


def occurrences(units: list[str], needle: list[str]) -> list[int]:
    """All places where needle stands in units."""
    n = len(needle)
    return [i for i, u in enumerate(units[: len(units) - n + 1]) if u == needle[0] and units[i : i + n] == needle] if n else []


def _places(text: str, needle: str) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def common_pairs(first: list[str], second: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; going back from the ends, first is stepped where both ways are as long."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(u, len(codes)) for u in x], np.int32) for x in (first, second))
    if not len(a) or not len(b):
        return []
    # a row is its predecessor, one more where the units are equal, and never falls along the row
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, u in enumerate(a):
        np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (b == u)), out=table[i + 1, 1:])
    i, j, pairs = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


@dataclass
class Found:
    """A stretch of the page's stream that may be the selection, with the part of the selection it answers."""

    start: int
    stop: int
    score: float
    coverage: float
    anchor: int
    told: tuple[int, int]

    def match(self, page: Stream, selected: Stream, method: str) -> dict:
        a, b = self.told
        place = {"start": page.item[self.start], "end": page.item[self.stop], "start_char": page.first[self.start], "end_char": page.last[self.stop]}
        return {**place, "exact": False, "score": self.score, "coverage": self.coverage, "method": method, "told": (selected.first[a], selected.last[b])}


def _alike(a: int, b: int) -> float:
    return min(a, b) / max(a, b)


def _clear(found: list[Found], order, overlapping: bool) -> Found | None:
    """The best; none if another is nearly as good, unless (where allowed) both are much the same stretch."""
    ranked = sorted(found, key=order)
    if len(ranked) > 1 and ranked[0].score - ranked[1].score < ANCHORED["margin"]:
        x, y = ranked[:2]
        shared = max(0, min(x.stop, y.stop) - max(x.start, y.start) + 1)
        if not overlapping or shared / (1 + min(x.stop - x.start, y.stop - y.start)) < 0.8:
            return None
    return ranked[0] if ranked else None


def exact_match(values: list[str], text: str) -> dict | None:
    """The only place where all the selection's letters and digits stand; punctuation at its edges is taken in where it stands there too."""
    selected, page = comparable([text]), comparable(values)
    needle = "".join(selected.units)
    hits = _places("".join(page.units), needle) if len(needle) > 1 else iter(())
    at = next(hits, None)
    if at is None or next(hits, None) is not None:
        return None
    z = at + len(needle) - 1
    before, behind = text[: selected.first[0]], text[selected.last[-1] :]
    a, b = page.first[at], page.last[z]
    a -= len(before) if values[page.item[at]][:a].endswith(before) else 0
    b += len(behind) if values[page.item[z]][b:].startswith(behind) else 0
    return {"start": page.item[at], "end": page.item[z], "start_char": a, "end_char": b, "exact": True, "score": 1.0, "coverage": 1.0, "method": "exact"}


def _ordered_share(span: list[str], told: list[str]) -> float:
    """Share of the selection's n-grams that stand in span one after another, each looked for behind the one before."""
    n = 3 if len(told) >= 8 else 2
    grams, at, hit = list(zip(*(span[k:] for k in range(n)))), 0, 0
    total = len(told) - n + 1
    for i in range(total):
        try:
            at = grams.index(tuple(told[i : i + n]), at) + 1
            hit += 1
        except ValueError:
            continue
    return hit / total if total > 0 else 0.0


def anchored_match(page: Stream, selected: Stream) -> dict | None:
    """Between the selection's first and last words, wherever both stand."""
    told = selected.units
    if len(told) < ANCHORED["words"]:
        return None
    best: dict[tuple[int, int], Found] = {}
    for size in range(min(5, len(told) // 2), 1, -1):
        tails = occurrences(page.units, told[-size:])
        for start in occurrences(page.units, told[:size]):
            for stop in (t + size - 1 for t in tails if t >= start + size):
                if (start, stop) not in best:  # a longer anchor has told it already
                    span = page.units[start : stop + 1]
                    share = _ordered_share(span, told)
                    best[start, stop] = Found(start, stop, 0.85 * share + 0.15 * _alike(len(told), len(span)), share, size, (0, len(told) - 1))
    good = [f for f in best.values() if f.coverage >= ANCHORED["coverage"] and f.score >= ANCHORED["score"]]
    hit = _clear(good, lambda f: (-f.score, -f.anchor), False)
    return hit and hit.match(page, selected, "anchored")


def _weighed(pairs: list[tuple[int, int]], total: int, compared: int, anchor: float, rule: dict) -> tuple[float, float] | None:
    """(score, coverage) of aligned pairs, or None where they are too few, end too early or are spread too far."""
    coverage, span = len(pairs) / total, pairs[-1][1] - pairs[0][1] + 1
    similar = _alike(compared, span)
    if coverage < rule["coverage"][total >= rule["long"]] or (pairs[-1][0] + 1) / total < rule["end"] or similar < rule["similar"]:
        return None
    return sum(w * v for w, v in zip(rule["weights"], (coverage, similar, anchor))), coverage


def aligned_match(page: Stream, selected: Stream) -> dict | None:
    """From a few words near the selection's start, the rest aligned word by word."""
    told, n = selected.units, len(selected)
    if n < ALIGNED["words"]:
        return None
    best: dict[tuple[int, int], Found] = {}
    for size in (5, 4, 3):
        for lead in range(min(12, n * 12 // 100, n - 3) + 1):
            if lead + size > n:
                continue
            for start in occurrences(page.units, told[lead : lead + size]):
                reach = min(len(page), start - (-n * 5 // 2) + 30)
                tail = common_pairs(told[lead + size :], page.units[start + size : reach])
                pairs = [*((lead + k, start + k) for k in range(size)), *((lead + size + i, start + size + j) for i, j in tail)]
                got = _weighed(pairs, n, n - lead, size / 5, ALIGNED)
                key = (start, pairs[-1][1])
                if got and (key not in best or got[0] > best[key].score):
                    best[key] = Found(*key, *got, size, (lead, pairs[-1][0]))
    hit = _clear(list(best.values()), lambda f: (-f.score, -f.coverage, -f.anchor), True)
    return hit and hit.match(page, selected, "aligned")


def _character_anchor(text: str, told: str) -> tuple[int, int, list[int]] | None:
    """(place in the selection, size, places in the page) of the first stretch that the page has."""
    for lead in range(0, min(160, len(told) * 14 // 100) + 1, 8):
        for size in CHARACTERS["anchors"]:
            if lead + size <= len(told) and (hits := list(_places(text, told[lead : lead + size]))):
                return lead, size, hits
    return None


def character_match(values: list[str], text: str) -> dict | None:
    """The same with characters, for text that has lost its spaces."""
    selected = comparable([text])
    n = len(selected)
    if n < CHARACTERS["chars"]:
        return None
    page = comparable(values)
    anchor = _character_anchor("".join(page.units), "".join(selected.units))
    found = []
    for start in anchor[2] if anchor else ():
        lead, size, _ = anchor
        low = max(0, start + (-lead * 5 // 2) - 80)
        tail = n - lead - size
        reach = min(len(page), start + size - (-tail * 5 // 2) + 120)
        head = common_pairs(selected.units[:lead], page.units[low:start])
        rest = common_pairs(selected.units[lead + size :], page.units[start + size : reach])
        pairs = [*((i, low + j) for i, j in head), *((lead + k, start + k) for k in range(size)), *((lead + size + i, start + size + j) for i, j in rest)]
        if got := _weighed(pairs, n, n, size / 48, CHARACTERS):
            found.append(Found(pairs[0][1], pairs[-1][1], *got, size, (pairs[0][0], pairs[-1][0])))
    hit = _clear(found, lambda f: -f.score, True)
    return hit and hit.match(page, selected, "characters")


def widened(values: list[str], text: str, match: dict) -> dict:
    """match, with what the selection holds before and behind the matched part where the page has just that."""
    a, b = match.pop("told")
    page = comparable(values)
    before = lambda item, char: next((k for k in range(len(page)) if (page.item[k], page.first[k]) >= (item, char)), None)
    head, tail = comparable([text[:a]]).units, comparable([text[b:]]).units
    at = before(match["start"], match["start_char"])
    # without any character behind the boundary there is no place to count back from
    if len(head) > 1 and at is not None and at >= len(head) and page.units[at - len(head) : at] == head:
        match |= {"start": page.item[at - len(head)], "start_char": page.first[at - len(head)]}
    at = before(match["end"], match["end_char"])
    if len(tail) > 1 and at is not None and page.units[at : at + len(tail)] == tail:
        match |= {"end": page.item[at + len(tail) - 1], "end_char": page.last[at + len(tail) - 1]}
    return match


def locate(values: list[str], text: str) -> dict | None:
    """The selection's place in a page's values: exact, else by anchors, aligned words or aligned characters, else None."""
    values = [v or "" for v in values]
    if hit := exact_match(values, text):
        return hit
    page, selected = word_stream(values, 2), word_stream([text], 2)
    hit = anchored_match(page, selected) or aligned_match(page, selected) or character_match(values, text)
    return hit and widened(values, text, hit)


def _located(batches):
    names = [x.split()[0] for x in MATCH.split(", ")]
    types = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    for batch in batches:
        hits = [locate(v or [], t or "") or {} for t, v in zip(batch.column("text").to_pylist(), batch.column("values").to_pylist())]
        own = [pa.array([h.get(n) for h in hits], types[x.split()[1]]) for n, x in zip(names, MATCH.split(", "))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own], ["selection_id", "page_no", *names])


def locate_passages(selections: DataFrame, pages: DataFrame) -> DataFrame:
    """(selection_id, page_no, match columns) wherever a selection (selection_id, doc_id, text) is found on a page (doc_id, page_no, values) of its document."""
    met = selections.join(pages, "doc_id").select("selection_id", "page_no", "text", "values")
    kind = lambda c: met.schema[c].dataType.simpleString()
    return met.mapInArrow(_located, f"selection_id {kind('selection_id')}, page_no {kind('page_no')}, {MATCH}").where("start is not null")


@F.pandas_udf(StringType())
def comparable_text(s):
    """The letters and digits that passages are compared by."""
    return s.map(lambda t: None if t is None else "".join(c for c in plain(t) if _readable(c)))


@F.pandas_udf(ArrayType(StringType()))
def word_values(s):
    """Words as they are compared (see word_stream)."""
    return s.map(lambda t: word_stream([t or ""]).units)


def once(page: Column, needle: Column) -> Column:
    """Where needle stands in page (from 1) if it stands there just once, overlaps counted, else null. Both as comparable_text."""
    at = F.instr(page, needle)
    return F.when((F.length(needle) >= 2) & (at > 0) & (F.instr(F.substring(page, at + 1, F.length(page)), needle) == 0), at)


@F.pandas_udf(ArrayType(LongType()))
def _prints(s, size, window):
    """Fingerprints by winnowing: the least gram hash of every window of grams. Whatever is as long as a window of grams shares one with any text that holds it."""
    size, window, out = int(size.iloc[0]) if len(size) else 1, int(window.iloc[0]) if len(window) else 1, []
    for t in s:
        codes = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(codes) - size + 1
        if n < 1:
            out.append([])
            continue
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = (h + codes[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        least = np.lib.stride_tricks.sliding_window_view(h, min(window, n)).min(axis=1)
        out.append(np.unique(least).view(np.int64))
    return pd.Series(out)


def exact_passages(needles: DataFrame, texts: DataFrame, most_gram: int = 12, most_window: int = 48) -> DataFrame:
    """(item_id, doc_id, at) where the comparable text of a needle (item_id, key) stands just once in that of a text (doc_id, page).

    Candidates come from an equality join on fingerprints, about two a window of grams; grams and windows are as long as the
    shortest needle allows, so none is missed."""
    needles = needles.where(F.length("key") >= 2)
    shortest = needles.agg(F.min(F.length("key"))).first()[0] or 2
    size = min(most_gram, shortest)
    window = min(most_window, shortest - size + 1)
    told = lambda df, c, k: df.select(k, F.explode(_prints(F.col(c), F.lit(size), F.lit(window))).alias("print"))
    found = told(texts, "page", "doc_id").join(told(needles, "key", "item_id"), "print").select("doc_id", "item_id").distinct()
    return found.join(texts, "doc_id").join(needles, "item_id").select("item_id", "doc_id", once(F.col("page"), F.col("key")).alias("at")).where("at is not null")


def choose_page(candidates: DataFrame) -> DataFrame:
    """(selection_id, page_no): the page a selection is on; no row where that stays open. candidates: selection_id, page_no, exact, score, coverage, hint.

    A hinted page wins if it is exact or good enough. Else one exact page wins, unless another is nearly exact; else the best, if good
    enough and clear of the second. One aggregate a selection, over the pages of one document."""
    good = (F.col("score") >= PAGE["score"]) & (F.col("coverage") >= PAGE["coverage"])
    best = F.struct("score", (-F.col("page_no")).alias("last"), "page_no", "coverage")
    hinted = F.min(F.when((F.col("page_no") == F.col("hint")) & (F.col("exact") | good), F.col("page_no")))
    loose = F.when(~F.col("exact"), F.col("score"))
    g = candidates.groupBy("selection_id").agg(
        hinted.alias("hinted"), F.count_if("exact").alias("exacts"), F.min(F.when(F.col("exact"), F.col("page_no"))).alias("sure"),
        F.max(loose).alias("rival"), F.max(best).alias("top"), F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("two"),
    )
    clear = (F.size("two") < 2) | (F.get("two", F.lit(0)) - F.get("two", F.lit(1)) >= PAGE["margin"])
    enough = (F.col("top.score") >= PAGE["score"]) & (F.col("top.coverage") >= PAGE["coverage"]) & clear
    one_exact = (F.col("exacts") == 1) & (F.coalesce("rival", F.lit(0.0)) <= PAGE["rival"])
    page = F.when(F.col("hinted").isNotNull(), F.col("hinted")).when(F.col("exacts") > 0, F.when(one_exact, F.col("sure"))).when(enough, F.col("top.page_no"))
    return g.select("selection_id", page.alias("page_no")).where("page_no is not null")


def glyph_stream(values: list[str]) -> Stream:
    """Characters of notation: composed, without white space, one minus sign for hyphens and dashes, a box for U+0003."""
    out = Stream()
    for item, value in enumerate(values):
        for at, c in enumerate(unicodedata.normalize("NFC", value or "")):
            if not c.isspace():
                out.add({"\x03": "□", "-": "−", "–": "−"}.get(c, c), item, at, at + 1)
    return out


_GLYPH = re.compile(nt.SIGNAL)


def _fuzzy(stream: list[str], needle: list[str]) -> tuple[int, int] | None:
    """The only stretch with the fewest other glyphs (a quarter of the needle, 2 to 6 of them) between the needle's characters in order."""
    spare = min(6, max(2, -(-len(needle) // 4)))
    ends = defaultdict(list)
    for start in (i for i, c in enumerate(stream) if c == needle[0]):
        at, skipped = start, 0
        for want in needle[1:]:
            nxt = next((k for k in range(at + 1, min(len(stream), at + 2 + spare - skipped)) if stream[k] == want), None)
            if nxt is None or not all(_GLYPH.match(c) for c in stream[at + 1 : nxt]):
                break
            skipped += nxt - at - 1
            at = nxt
        else:
            ends[skipped].append((start, at))
    least = ends[min(ends)] if ends else []
    return least[0] if len(least) == 1 else None


def math_range(values: list[str], expression: str, within: tuple[int, int] | None = None) -> tuple[int, int] | None:
    """Items (first, last) of a formula's only place, up to three glyphs before it taken in; None where it is open."""
    needle, page = glyph_stream([expression]).units, glyph_stream(values)
    keep = [k for k, i in enumerate(page.item) if within is None or within[0] <= i <= within[1]]
    units, item = [page.units[k] for k in keep], [page.item[k] for k in keep]
    hits = occurrences(units, needle) if len(needle) > 1 else []
    span = (hits[0], hits[0] + len(needle) - 1) if len(hits) == 1 else _fuzzy(units, needle) if len(needle) > 1 and not hits else None
    if span is None:
        return None
    start = span[0]
    while start > max(0, span[0] - 3) and _GLYPH.match(units[start - 1]) and item[start] - item[start - 1] <= 2:
        start -= 1
    return item[start], item[span[1]]


def ascii_words(text: str) -> list[str]:
    """Words of two ASCII letters and digits or more, without case, marks and all else."""
    return [w for w in (re.sub("[^a-z0-9]+", "", plain(x)) for x in re.split(r"[\s\ufeff]+", text or "")) if len(w) > 1]


def context_range(values: list[str], before: str, after: str, most: int = 60) -> tuple[int, int] | None:
    """Items between the words before and the words after a formula, the longest anchors (4 to 2 words) first."""
    told = [(w, i) for i, v in enumerate(values) for w in ascii_words(v)]
    units, head, tail = [w for w, _ in told], ascii_words(before), ascii_words(after)
    for a in range(min(4, len(head)), 1, -1):
        for b in range(min(4, len(tail)), 1, -1):
            tails = occurrences(units, tail[:b])
            for at in occurrences(units, head[-a:]):
                nxt = next((t for t in tails if t >= at + a), None)
                inside = [] if nxt is None else [i for i in range(told[at + a - 1][1] + 1, told[nxt][1]) if (values[i] or "").strip()]
                if inside and inside[-1] - inside[0] <= most:
                    return inside[0], inside[-1]
    return None


def label_items(values: list[str], ys: list[float], label: str) -> list[int]:
    """Items that hold a label, or the last items of the lines (heights to the nearest 3) that hold it."""
    bare = lambda t: re.sub(r"[\s\ufeff]", "", t or "")
    want = bare(label)
    lines: dict[float, list[int]] = defaultdict(list)
    for i, y in enumerate(ys):
        lines[np.floor(y / 3 + 0.5) * 3].append(i)
    return [i for i, v in enumerate(values) if want in bare(v)] or [x[-1] for x in lines.values() if want in bare("".join(values[i] or "" for i in x))]
