"""Selection text to words and equations, and items to speech chunks.

Texts without a sign, bracket or letter of notation are plain words and never leave the JVM. The others
go through Arrow: each distinct word is classified once, classes become flag arrays, and formulas
are intervals found on them: runs of formula words, triples around an operator, and stretches before a label.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagetide.functions import notation as nt
from pagetide.functions.text import COMPOUND, SPACE, repair_line_hyphenation, words


def _py(pattern: str) -> re.Pattern:
    """A pattern of the Column functions for Python; letters' cases match in ASCII alone, as in Java."""
    return re.compile(re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace("\\z", "\\Z"), re.ASCII if "(?i" in pattern else 0)


_BLANK, _WS = _py(f"[{SPACE}]+"), f"[{SPACE}]*"
_OPERATOR, _ATOM, _GLYPHS, _TEX, _DISPLAY, _PROSE, _RELATION = map(_py, (nt.OPERATOR, nt.ATOM, nt.GLYPHS, nt.TEX, nt.DISPLAY, nt.PROSE_WORD, nt.RELATION))
_SIGN, _SIGN_OR_BOX, _STRONG, _FUNCTION = map(_py, (nt.SIGN, nt.SIGN_OR_BOX, nt.STRONG, nt.FUNCTION))
_DENSE = [_py(x) for x in (nt.LONE_MARK, nt.SIGN_OR_BOX, nt.GREEK_LETTER, nt.PLAIN_TOKEN)]
_LONG_RUN, _DIGIT = _py(nt.LONG_RUN), re.compile("[0-9]")
_LABELS = {"(": _py(f"(?i)\\A\\({_WS}({nt.LABEL}){_WS}\\)\\z"), "[": _py(f"(?i)\\A\\[{_WS}({nt.LABEL}){_WS}\\]\\z")}
_CLOSE = {"(": ")", "[": "]"}


def _trim(t: str) -> str:
    return re.sub(f"\\A[{SPACE}]+|[{SPACE}]+\\Z", "", t)


def label_of(text: str) -> str | None:
    """A label in brackets, in plain form. Whatever does not start with a bracket is none."""
    t = _trim(unicodedata.normalize("NFC", text))
    if t[:1] not in ("(", "[", "（"):
        return None
    t = "(" + t[1:] if t[0] == "（" else t
    t = re.sub("([)\\]])[.,;:]\\Z", r"\1", re.sub("）[.,;:]?\\Z", ")", t))
    m = _LABELS[t[0]].match(t)
    return t[0] + m[1] + _CLOSE[t[0]] if m else None


def equation_like(text: str) -> bool:
    t = _trim(text)
    if not 0 < len(t) <= nt.MOST_LIKE or _OPERATOR.match(t) or label_of(t) is not None:
        return False
    if _TEX.search(t) or _DISPLAY.search(t):
        return True
    signs = len(_SIGN.findall(t))
    if not signs:
        return False
    prose = sum(_PROSE.match(w) is not None for w in _BLANK.split(t))
    return (prose <= 3 and _RELATION.search(t) is not None) or (prose <= 2 and signs >= 3)


class Kind(NamedTuple):
    """What one word can be in a formula."""

    glyph: bool
    sign: bool
    operator: bool
    signed: bool
    part: bool
    atom: bool
    dense: bool
    like: bool
    mark: bool
    bracket: bool


@lru_cache(maxsize=1 << 16)
def kind(w: str) -> Kind:
    glyph_only = _GLYPHS.match(w) is not None
    signed = _SIGN_OR_BOX.search(w) is not None
    glyph = glyph_only and (len(w) <= 3 or signed or _DIGIT.search(w) is not None)
    operator = _OPERATOR.match(w) is not None
    compact = w[:-1] if w[-1:] in ".,;:" else w
    numbered = _GLYPHS.match(compact) is not None and _DIGIT.search(compact) is not None and _LONG_RUN.search(compact) is None
    dense = label_of(w) is None and (numbered or any(p.search(w) for p in _DENSE))
    return Kind(glyph, operator or _SIGN.search(w) is not None, operator, signed, glyph or _FUNCTION.match(w) is not None, _ATOM.match(w) is not None, dense, equation_like(w), w in (",", ".", ";", ":"), w[0] in "([（")


Item = tuple[str, str, str | None]


def _formulas(some: list[str], flags: np.ndarray) -> list[Item]:
    """Items of a run of words without labels. flags: one row a word, one column a field of Kind."""
    n = len(some)
    out: list[Item] = []
    if not n:
        return out
    glyph, sign, operator, signed, part, atom, _, like, mark, _ = flags.T
    after = lambda a, k: np.concatenate((a[k:], np.zeros(min(k, n), bool)))
    ahead = np.minimum(np.arange(n) + 8, n)
    count = lambda a: np.concatenate(([0], np.cumsum(a)))
    within = lambda a: count(a)[ahead] - count(a)[:-1]
    stop = np.append(np.flatnonzero(~part), n)
    run = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n)
    headless = operator & after(glyph, 1) & after(signed, 1)
    dense = (within(glyph) >= 3) & (within(sign) >= 1)
    runs = (dense | headless) & ~mark & (run >= np.where(headless, 2, 3))
    triples = atom & after(operator, 1) & after(atom, 2)
    free = 0
    word = lambda a, b: out.extend((some[i], "equation" if like[i] else "word", None) for i in range(a, b))
    for i in np.flatnonzero(runs | triples).tolist():
        if i < free:
            continue
        word(free, i)
        free = i + (int(run[i]) if runs[i] else 3)
        whole = " ".join(some[i:free])
        tail = whole[-1] if not runs[i] and whole[-1] in ".,;:" else ""
        out.append((whole[: len(whole) - len(tail)], "equation", None))
        if tail:
            out.append((tail, "word", None))
    word(free, n)
    return out


def _labelled(some: list[str], flags: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(start, label's first word, end, label) of numbered equations, those that overlap an earlier one left out."""
    dense, bracket = flags[:, 6], flags[:, 9]
    bar = np.flatnonzero(~dense)
    found, free = [], 0
    for at in np.flatnonzero(bracket).tolist():
        hits = ((n, label_of("".join(some[at : at + n]))) for n in range(min(5, len(some) - at), 0, -1))
        n, label = next(((n, x) for n, x in hits if x), (0, None))
        if not n:
            continue
        k = int(np.searchsorted(bar, at))
        start = int(bar[k - 1]) + 1 if k else 0  # all words from here to the label are dense
        start += start < len(some) and some[start] == ":"
        if start >= free and (at - start >= 4 or equation_like(" ".join(some[start:at]))):
            found.append((start, at, at + n, label))
            free = at + n
    return found


_BROKEN = re.compile(f"([^\\W\\d_]+)([-\u00ad\u2010]){_WS}\n{_WS}(?=([^\\W\\d_]))")


def _joined(left: str, hyphen: str) -> str:
    return left + "-" if hyphen == "-" and left.lower() in COMPOUND else left


def repair(text: str) -> str:
    return _BROKEN.sub(lambda m: _joined(m[1], m[2]) if unicodedata.category(m[3]) == "Ll" else m[0], text) if "\n" in text else text


def selection_items(text: str | None, detected_prose: bool = False) -> list[Item]:
    """(value, kind, label) items of a selection. With detected_prose, equations without a strong sign are words again."""
    some = [w for w in _BLANK.split(repair(unicodedata.normalize("NFC", text or "")).replace("\x03", "□")) if w]
    flags = np.array([kind(w) for w in some], bool).reshape(len(some), len(Kind._fields))
    out: list[Item] = []
    free = 0
    for start, at, end, label in _labelled(some, flags):
        out += [*_formulas(some[free:start], flags[free:start]), (" ".join(some[start:at]), "equation", label)]
        free = end
    out += _formulas(some[free:], flags[free:])
    if not detected_prose:
        return out
    weak = lambda x: x[1] == "equation" and not _STRONG.search(x[0])
    return [y for x in out for y in ([(w, "word", None) for w in x[0].split(" ")] if weak(x) else [x])]


_ITEMS = ArrayType(StructType([StructField(k, StringType()) for k in ("value", "kind", "label")]))


def _nested(rows: list[list[tuple]], names: tuple[str, ...], types: tuple) -> pa.Array:
    flat = [x for r in rows for x in r]
    off = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate(types)], list(names)))


def _selected(detected_prose: bool):
    @F.arrow_udf(_ITEMS)
    def run(column: pa.Array) -> pa.Array:
        return _nested([selection_items(t, detected_prose) for t in column.to_pylist()], ("value", "kind", "label"), (pa.string(),) * 3)

    return run


#: Any character that notation, a label or a text in need of composition has.
_MAYBE = f"[^\\x{{0}}-\\x{{2ff}}\\x{{2010}}-\\x{{2027}}]|[{nt.SIGNS}{nt.SCRIPTS}\\x03\\\\]"


def tokenize_selection(docs: DataFrame, key: str = "doc_id", text_col: str = "text", detected_prose: bool = False) -> DataFrame:
    """(doc_id, item_idx, value, kind, label) of whole texts."""
    may = F.coalesce(F.col(text_col).rlike(_MAYBE), F.lit(False))
    plain = docs.where(~may).select(key, F.posexplode(words(repair_line_hyphenation(F.col(text_col)))).alias("item_idx", "value"))
    rest = docs.where(may).select(key, F.posexplode(_selected(detected_prose)(F.col(text_col))).alias("item_idx", "w")).select(key, "item_idx", "w.*")
    return plain.select(key, "item_idx", "value", F.lit("word").alias("kind"), F.lit(None).cast("string").alias("label")).union(rest)


class Unit(NamedTuple):
    """A spoken word: after each fragment, the item that gave it and the length of the word so far; and the whole word."""

    items: list[int]
    lengths: list[int]
    text: str


def _units(values: list[str], first: int, stop: int) -> list[Unit]:
    """The words of items first..stop-1, fragments broken at a hyphen joined; blank items give none."""
    out: list[Unit] = []
    for i in range(first, stop):
        value = _trim(values[i] or "")
        m = re.search("([^\\W\\d_]+)([-\u00ad\u2010])\\Z", out[-1].text) if out and value else None
        if m and unicodedata.category(value[0]) == "Ll":
            last = out.pop()
            whole = last.text[: m.start()] + _joined(m[1], m[2]) + value
            out.append(Unit([*last.items, i], [*last.lengths, len(whole)], whole))
        elif value:
            out.append(Unit([i], [len(value)], value))
    return out


def speech_chunk(items: list[dict], start: int, most: int = 1000) -> dict:
    """Text from item start on, with each item's place in it; stops at equations, paragraph ends and most characters."""
    if not items:
        return {"text": "", "entries": [], "start_idx": 0, "end_idx": -1}
    start = max(0, min(len(items) - 1, start))
    return _chunk([x.get("value") for x in items], [i for i, x in enumerate(items) if x.get("kind") == "equation"], [i for i, x in enumerate(items) if x.get("paragraph_end")], start, most)


def _chunk(values: list[str], equations: list[int], ends: list[int], start: int, most: int) -> dict:
    """One chunk. equations, ends: ascending places of equations and of items that end a paragraph."""
    k = bisect_left(equations, start)
    stop = equations[k] if k < len(equations) else len(values)
    k = bisect_left(ends, start)
    while k < len(ends) and ends[k] < stop and not _trim(values[ends[k]] or ""):
        k += 1  # blank items end nothing
    stop = min(stop, ends[k] + 1) if k < len(ends) else stop
    pieces, entries, size, last = [], [], 0, start - 1
    reach = min(stop, start + most + 1)  # a chunk holds no more words than characters, but for blank items
    while reach < stop and sum(1 for v in values[start:reach] if _trim(v or "")) <= most:
        reach = min(stop, reach + most)
    for unit in _units(values, start, reach):
        at = size + (1 if pieces else 0)
        fits = bisect_right(unit.lengths, most - at)
        fits = max(fits, 0 if pieces else 1)
        if not fits:
            break
        whole = unit.text
        if fits < len(unit.items):  # the rest of a broken word opens the next chunk
            whole = _units(values, unit.items[0], unit.items[fits - 1] + 1)[0].text
        pieces.append(whole)
        entries.append((unit.items[0], at, at + len(whole)))
        size, last = at + len(whole), unit.items[fits - 1]
        if fits < len(unit.items):
            break
    return {"text": " ".join(pieces), "entries": entries, "start_idx": entries[0][0] if entries else start, "end_idx": last}


_CHUNKS = ArrayType(StructType([StructField("text", StringType()), StructField("start_idx", IntegerType()), StructField("end_idx", IntegerType()), StructField("entries", ArrayType(StructType([StructField(n, IntegerType()) for n in ("item_idx", "start", "end")])))]))


def _all_chunks(values: list[str], kinds: list[str], ends: list[bool], most: int) -> list[dict]:
    equations, stops = [i for i, k in enumerate(kinds) if k == "equation"], [i for i, e in enumerate(ends) if e]
    out, at = [], 0
    while at < len(values):
        c = _chunk(values, equations, stops, at, most)
        if c["entries"]:
            out.append(c)
        at = max(at, c["end_idx"]) + 1
    return out


_CHUNK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("start_idx", pa.int32()), ("end_idx", pa.int32()), ("entries", pa.list_(pa.struct([(n, pa.int32()) for n in ("item_idx", "start", "end")])))]))


def chunk_arrays(values: pa.Array, kinds: pa.Array, ends: pa.Array, most: int, rows: int = 32) -> pa.Array:
    """All chunks of each row; Python objects are made of some rows at a time."""
    told = lambda c: {**c, "entries": [{"item_idx": i, "start": a, "end": b} for i, a, b in c["entries"]]}
    out = [pa.array([], _CHUNK_TYPE)]
    for at in range(0, len(values), rows):
        some = zip(*(x.slice(at, rows).to_pylist() for x in (values, kinds, ends)))
        out.append(pa.array([[told(c) for c in _all_chunks(v, k, e, most)] if v is not None else [] for v, k, e in some], _CHUNK_TYPE))
    return pa.concat_arrays(out)


def chunks_of(items: Column, most: int = 1000) -> Column:
    """Array of all chunks of an array of items (value, kind, paragraph_end), chunk after chunk, within the row."""

    @F.arrow_udf(_CHUNKS)
    def run(values: pa.Array, kinds: pa.Array, ends: pa.Array) -> pa.Array:
        return chunk_arrays(values, kinds, ends, most)

    field = lambda n: F.transform(items, lambda x: x[n])
    return run(field("value"), field("kind"), field("paragraph_end"))


def speech_chunks(items: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, chunk_id, text, start_idx, end_idx, entries, equation_next) from rows of doc_id and items, an array of (value, kind, paragraph_end)."""
    got = items.select("doc_id", "items", F.posexplode(chunks_of(F.col("items"), most)).alias("chunk_id", "c"))
    follows = F.coalesce(F.get("items", F.col("c.end_idx") + 1)["kind"] == "equation", F.lit(False))
    return got.select("doc_id", "chunk_id", "c.*", follows.alias("equation_next"))
