"""From a page's items, regions and a selection to reading items: segments of text and notation, in reading order.

What belongs to what (characters to regions, labels to equations, paragraph gaps) is Column arithmetic
within a page's row; the walk over characters that joins text runs is a fold in Arrow batches; the reading items are rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from pagetide.functions import layout
from pagetide.functions.text import COMPOUND
from pagetide.operators.tokenize import selection_items

_kinds = lambda **f: ArrayType(StructType([StructField(n, t) for n, t in f.items()]))
SEGMENTS = _kinds(kind=StringType(), value=StringType(), paragraph_end=BooleanType(), region=IntegerType(), label=StringType())
_TOKENS = _kinds(value=StringType(), kind=StringType(), label=StringType())


def character_regions(items: Column, v: Column, regions: Column) -> Column:
    """For each item, the region index of each of its characters (null: none)."""

    def of(i: Column) -> Column:
        rect, n = layout.text_item_rect(i, v), F.length(i["str"])
        share = lambda k: (k + 0.5) / n
        x = lambda k: F.when(i["dir"] == "rtl", rect["x"] + rect["width"] * (1 - share(k))).otherwise(rect["x"] + rect["width"] * share(k))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: layout.region_for_character(regions, rect, x(k)))).otherwise(F.array().cast("array<int>"))

    return F.transform(items, of)


def _hyphen_join(left: str, right: str) -> str | None:
    m = re.search("([^\\W\\d_]+)([-­‐])\\Z", left)
    if not m or not right or unicodedata.category(right[0]) != "Ll":
        return None
    return left[:-1] + ("-" if m[2] == "-" and m[1].lower() in COMPOUND else "") + right


class _Text:
    """A growing run of text."""

    def __init__(self, value: str, item: int):
        self.value, self.item, self.closed = value, item, False

    def add(self, value: str, item: int, line_break: bool) -> None:
        joined = _hyphen_join(self.value, value) if item != self.item and line_break else None
        if joined is None:
            apart = item != self.item and not self.value[-1:].isspace() and not value[:1].isspace() and value[:1] not in ",.;:!?)}]" and self.value[-1:] not in "({["
            joined = self.value + " " * apart + value
        self.value, self.item = joined, item


def segments(values: list[str], eols: list[bool], gaps: list[bool], regions: list[list[int | None]], labels: dict[int, str], label_items: set[int], start: int, end: int, start_char: int, end_char: int) -> list[dict]:
    """Text and notation in order; each region once, where it is met first. gaps[i]: a paragraph ends before item i."""
    out: list[_Text | int] = []
    met: set[int] = set()
    before = None
    for i in range(start, end + 1):
        value = values[i] or ""
        if not value:
            continue
        if gaps[i] and out and isinstance(out[-1], _Text):
            out[-1].closed = True
        last, before = before, i
        if i in label_items:
            continue
        for k in range(start_char if i == start else 0, min(len(value), end_char) if i == end else len(value)):
            r = regions[i][k]
            if r is not None:
                if r not in met:
                    met.add(r)
                    out.append(r)
            elif out and isinstance(out[-1], _Text) and not out[-1].closed:
                out[-1].add(value[k], i, last is not None and bool(eols[last]))
            else:
                out.append(_Text(value[k], i))
    told = []
    for x in out:
        if isinstance(x, _Text):
            value = " ".join(re.split(r"[\s﻿]+", x.value)).strip(" ")
            if value:
                told.append({"kind": "text", "value": value, "paragraph_end": x.closed, "region": None, "label": None})
        else:
            told.append({"kind": "math", "value": None, "paragraph_end": False, "region": x, "label": labels.get(x)})
    return told


_PARTS = ("__values", "__eols", "__gaps", "__regions", "labels", "match")


def _segmented(batches):
    kind = to_arrow_type(SEGMENTS)
    for batch in batches:
        told = []
        for values, eols, gaps, regions, labels, m in zip(*(batch.column(n).to_pylist() for n in _PARTS)):
            held = {i for x in labels or () for i in range(x["start"], x["end"] + 1)}
            known = m is not None and m["start"] is not None and values is not None
            told.append(segments(values, eols, gaps, regions, {x["region"]: x["label"] for x in labels or ()}, held, m["start"], m["end"], m["start_char"], m["end_char"]) if known else [])
        names = [n for n in batch.schema.names if n not in _PARTS[:4]]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(told, kind)], [*names, "segments"])


def page_segments(pages: DataFrame) -> DataFrame:
    """pages (items, regions, viewport, match with start, end, start_char, end_char) with segments and labels."""
    i, v, r, m = F.col("items"), F.col("viewport"), F.col("regions"), F.col("match")
    pages = pages.withColumn("labels", layout.associate_labels(layout.label_candidates(i, v, m["start"], m["end"]), r))
    chosen = F.slice(i, m["start"] + 1, F.greatest(m["end"] - m["start"] + 1, F.lit(0)))
    pages = pages.withColumn("__h", layout.body_height(chosen))
    # the item before: the nearest one with text
    earlier = lambda k: F.array_max(F.filter(F.sequence(m["start"], k), lambda j: (j < k) & (F.coalesce(F.get(i, j)["str"], F.lit("")) != "")))
    gap = lambda x, k: F.when((k > m["start"]) & (k <= m["end"]), layout.paragraph_gap(F.get(i, earlier(k)), x, F.col("__h"))).otherwise(False)
    parts = [F.transform(i, lambda x: x["str"]), F.transform(i, lambda x: F.coalesce(x["has_eol"], F.lit(False))), F.transform(i, gap), character_regions(i, v, r)]
    whole = pages.select("*", *(c.alias(n) for c, n in zip(parts, _PARTS))).drop("__h")
    out = StructType([f for f in whole.schema.fields if f.name not in _PARTS[:4]] + [StructField("segments", SEGMENTS)])
    return whole.mapInArrow(_segmented, out)


@F.pandas_udf(_TOKENS)
def _tokens(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [dict(zip(("value", "kind", "label"), x)) for x in selection_items(t, True)] if t else [])


def visual_items(pages: DataFrame, key: str = "selection_id", page: str = "page_no") -> DataFrame:
    """Reading items (key, item_idx, value, kind, paragraph_end, equation_id, label, math_kind, confidence, unresolved) of pages with segments and regions.

    A region becomes an equation under its own id; a formula left in the text becomes an unresolved one, numbered on its page."""
    s = pages.select(key, page, "regions", F.posexplode("segments").alias("seg", "s"))
    s = s.select(key, page, "seg", "s.*", F.get("regions", F.col("s.region")).alias("r"))
    math = F.array(F.struct(F.when(F.col("r.kind") == "display", "equation").otherwise("mathNotation").alias("value"), F.lit("equation").alias("kind"), F.col("label").alias("label")))
    s = s.withColumn("tokens", F.when(F.col("kind") == "math", math).otherwise(_tokens(F.when(F.col("kind") == "text", F.col("value")))))
    t = s.select(key, page, "seg", F.col("kind").alias("from"), "paragraph_end", "region", "r", F.size("tokens").alias("n"), F.posexplode("tokens").alias("tok", "t"))
    open_ = (F.col("from") == "text") & (F.col("t.kind") == "equation")
    row = F.struct(
        "seg", "tok", F.when(open_, "mathNotation").otherwise(F.col("t.value")).alias("value"), F.col("t.kind").alias("kind"), (F.col("paragraph_end") & (F.col("tok") == F.col("n") - 1)).alias("paragraph_end"),
        F.when(F.col("from") == "math", F.col("region")).alias("region"), F.when(F.col("from") == "math", F.col("t.label")).alias("label"), F.col("r.kind").alias("math_kind"), F.col("r.confidence").alias("confidence"), open_.alias("unresolved"),
    )
    each = t.groupBy(key, page).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # one page's items
    x = each.select(key, page, "rows", F.posexplode("rows").alias("item_idx", "i"))
    nth = F.size(F.filter(F.slice("rows", 1, F.col("item_idx")), lambda o: o["unresolved"]))
    ident = F.when(F.col("i.region").isNotNull(), F.concat_ws("-", F.lit("vision"), F.col(page), F.col("i.region"))).when(F.col("i.unresolved"), F.concat_ws("-", F.lit("unresolved"), F.col(page), nth))
    return x.select(key, "item_idx", "i.value", "i.kind", "i.paragraph_end", ident.alias("equation_id"), "i.label", "i.math_kind", "i.confidence", "i.unresolved")
