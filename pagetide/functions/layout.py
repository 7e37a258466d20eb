"""Text items of a page as boxes, fonts and labels, in Columns.

An item is a struct (str, x, y, width, height, font_name, dir, has_eol), a viewport a struct (scale, m0..m5)
that takes (x, y) to (m0 x + m2 y + m4, m1 x + m3 y + m5). Arrays hold one page's items or regions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.geometry import intersection_area, vertical_overlap
from pagetide.functions.notation import equation_label
from pagetide.functions.text import trim

ITEM = "struct<str:string,x:double,y:double,width:double,height:double,font_name:string,dir:string,has_eol:boolean>"
VIEWPORT = "struct<scale:double,m0:double,m1:double,m2:double,m3:double,m4:double,m5:double>"
REGION = "struct<x:double,y:double,width:double,height:double,kind:string,confidence:double,source:string,inferred_text:string,source_items:array<int>>"
#: Fixed value: characters that make a text item notation beyond doubt.
EXPLICIT = "[\\x{2c6}\\x{300}-\\x{36f}\\x{370}-\\x{3ff}\\x{210f}\\x{2202}\\x{2207}\\x{2211}\\x{2212}\\x{221a}\\x{221e}\\x{222b}\\x{2248}\\x{2260}\\x{2261}\\x{2264}\\x{2265}\\x{b1}\\x{d7}\\x{2192}\\x{21d2}=+*/^_<>\\[\\]{}]"
#: Bounds of a raised letter, as shares of the base letter's height.
SCRIPT = {"ratio": (0.58, 0.78), "rise": (0.22, 0.58), "gap": (-0.08, 0.16), "covered": 0.35, "confidence": 0.81}


def letters(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("\\p{L}"))


def viewport(scale: float = 1.0, *m: float) -> Column:
    named = zip(("scale", *(f"m{i}" for i in range(6))), (scale, *(m or (1.0, 0.0, 0.0, -1.0, 0.0, 0.0))))
    return F.struct(*(F.lit(float(v)).alias(n) for n, v in named))


def _rect(x: Column, y: Column, right: Column, bottom: Column, baseline: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"), baseline.alias("baseline"))


def _placed(i: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    """Left, right, baseline and height on the page."""
    at = lambda x: v["m0"] * x + v["m2"] * i["y"] + v["m4"]
    a, b = at(i["x"]), at(i["x"] + F.coalesce(i["width"], F.lit(0.0)))
    base = v["m1"] * i["x"] + v["m3"] * i["y"] + v["m5"]
    return F.least(a, b), F.greatest(a, b), base, F.greatest(F.lit(4.0), F.abs(F.coalesce(i["height"], F.lit(0.0)) * v["scale"]))


def text_item_rect(i: Column, v: Column) -> Column:
    """An item's box: half as high again as its letters, with its baseline."""
    left, right, base, h = _placed(i, v)
    return F.struct(left.alias("x"), (base - h * 1.2).alias("y"), (right - left).alias("width"), (h * 1.5).alias("height"), base.alias("baseline"))


def script_pair_rect(base: Column, raised: Column, v: Column) -> Column:
    """The tight box of a letter with a raised one."""
    (la, ra, ya, ha), (lb, rb, yb, hb) = _placed(base, v), _placed(raised, v)
    return _rect(F.least(la, lb), F.least(ya - ha * 1.05, yb - hb * 1.05), F.greatest(ra, rb), F.greatest(ya + ha * 0.08, yb + hb * 0.24), ya)


def combined_rect(items: Column, v: Column) -> Column:
    """The box around all items, with their mean baseline."""
    r = F.transform(items, lambda i: text_item_rect(i, v))
    mean = F.aggregate(r, F.lit(0.0), lambda a, b: a + b["baseline"]) / F.size(r)
    return _rect(F.array_min(F.transform(r, lambda b: b["x"])), F.array_min(F.transform(r, lambda b: b["y"])), F.array_max(F.transform(r, lambda b: b["x"] + b["width"])), F.array_max(F.transform(r, lambda b: b["y"] + b["height"])), mean)


def text_items_rect(items: Column, v: Column) -> Column:
    """The plain engine's box around items with text; widths scale with the viewport, heights are 8 at least. Null without any."""
    seen = F.filter(items, lambda i: trim(F.coalesce(i["str"], F.lit(""))) != "")
    place = lambda i: (v["m0"] * i["x"] + v["m2"] * i["y"] + v["m4"], v["m1"] * i["x"] + v["m3"] * i["y"] + v["m5"], F.greatest(F.lit(8.0), i["height"] * v["scale"]))
    low = lambda f: F.array_min(F.transform(seen, lambda i: f(*place(i), i)))
    high = lambda f: F.array_max(F.transform(seen, lambda i: f(*place(i), i)))
    x, y = low(lambda x, b, h, i: x), low(lambda x, b, h, i: b - h * 1.3)
    right, bottom = high(lambda x, b, h, i: x + i["width"] * v["scale"]), high(lambda x, b, h, i: b + h * 0.35)
    return F.when(F.size(seen) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height")))


def includes_item(start: Column, end: Column, start_char: Column, end_char: Column, index: Column, length: Column) -> Column:
    """Whether a selection takes in an item; a null selection takes in all."""
    out = (index < start) | (index > end) | ((index == start) & (start_char >= length)) | ((index == end) & (end_char <= 0))
    return start.isNull() | ~out


def upper_median(values: Column, default: float = 10.0) -> Column:
    """The middle of an array of numbers, the upper one of two; default where it is empty or 0."""
    s = F.array_sort(values)
    return F.coalesce(F.nullif(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(0.0)), F.lit(default))


def body_height(items: Column) -> Column:
    """Middle height of the items with four letters or more."""
    return upper_median(F.filter(F.transform(F.filter(items, lambda i: letters(i["str"]) >= 4), lambda i: F.abs(F.coalesce(i["height"], F.lit(0.0)))), lambda h: h > 0))


def dominant_font(items: Column) -> Column:
    """The font with the most letters among items of four letters or more; the first seen of equals."""
    told = F.filter(F.transform(items, lambda i, k: F.struct(i["font_name"].alias("f"), letters(i["str"]).alias("n"), k.alias("k"))), lambda t: (t["n"] >= 4) & (F.coalesce(t["f"], F.lit("")) != ""))
    fonts = F.array_distinct(F.transform(told, lambda t: t["f"]))
    weighed = F.transform(fonts, lambda f, k: F.struct(F.aggregate(F.filter(told, lambda t: t["f"] == f), F.lit(0), lambda a, t: a + t["n"]).alias("n"), (-k).alias("k"), f.alias("f")))
    return F.array_max(weighed)["f"]


def paragraph_gap(before: Column, now: Column, line_height: Column) -> Column:
    """Whether a paragraph ends between two items: a new line, and more than one and a half lines down."""
    restart = F.coalesce(before["has_eol"], F.lit(False)) | (now["x"] < before["x"] - line_height)
    return F.coalesce(restart & (before["y"] - now["y"] > line_height * 1.55), F.lit(False))


def region_for_character(regions: Column, rect: Column, x: Column) -> Column:
    """Index of the region a character at x of an item's box belongs to, displays first, then by confidence; null if none."""

    def inside(r: Column) -> Column:
        margin = F.least(F.lit(4.0), F.greatest(F.lit(1.0), r["height"] * 0.15))
        level = rect["baseline"].between(r["y"] - r["height"] * 0.35, r["y"] + r["height"] * 1.35)
        return x.between(r["x"] - margin, r["x"] + r["width"] + margin) & level & (vertical_overlap(rect, r) >= F.least(rect["height"], r["height"]) * 0.1)

    ranked = F.transform(regions, lambda r, k: F.when(inside(r), F.struct((r["kind"] == "display").cast("int").alias("d"), r["confidence"].alias("c"), (-k).alias("k"))))
    return -F.array_max(F.filter(ranked, lambda t: t.isNotNull()))["k"]


def _covers(region: Column, part: Column) -> Column:
    return intersection_area(part, region) / F.greatest(F.lit(1.0), part["width"] * part["height"]) >= SCRIPT["covered"]


def supplement_scripts(items: Column, v: Column, regions: Column, selected: Column | None = None) -> Column:
    """regions with a box for each capital followed by a raised small letter of another font. One that holds both letters already is enough;
    those that hold one give way. selected: array of booleans, the items that count."""
    regions = F.transform(regions, lambda r: F.struct(*(r[k].alias(k) for k in ("x", "y", "width", "height", "kind", "confidence")), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("inferred_text"), F.lit(None).cast("array<int>").alias("source_items")).cast(REGION))

    def raised(k: Column) -> Column:
        a, b = F.get(items, k), F.get(items, k + 1)
        ha, hb = F.abs(F.coalesce(a["height"], F.lit(0.0))), F.abs(F.coalesce(b["height"], F.lit(0.0)))
        rise, gap = b["y"] - a["y"], b["x"] - a["x"] - F.coalesce(a["width"], F.lit(0.0))
        named = (F.coalesce(a["font_name"], F.lit("")) != "") & (F.coalesce(b["font_name"], F.lit("")) != "") & (a["font_name"] != b["font_name"])
        shape = trim(a["str"]).rlike("\\A[A-Z]\\z") & trim(b["str"]).rlike("\\A[a-z]\\z") & named & (ha > 0)
        size = (hb / F.greatest(F.lit(1.0), ha)).between(*SCRIPT["ratio"]) & rise.between(ha * SCRIPT["rise"][0], ha * SCRIPT["rise"][1]) & gap.between(ha * SCRIPT["gap"][0], ha * SCRIPT["gap"][1])
        counted = F.lit(True) if selected is None else F.get(selected, k) & F.get(selected, k + 1)
        return F.coalesce(shape & size & counted, F.lit(False))

    def step(acc: Column, k: Column) -> Column:
        a, b = F.get(items, k), F.get(items, k + 1)
        ra, rb = text_item_rect(a, v), text_item_rect(b, v)
        touched = lambda r: (r["kind"] == "inline") & (_covers(r, ra) | _covers(r, rb))
        sure = F.greatest(F.lit(SCRIPT["confidence"]), F.coalesce(F.array_max(F.transform(F.filter(acc, touched), lambda r: r["confidence"])), F.lit(0.0)))
        box = script_pair_rect(a, b, v)
        new = F.struct(*(box[c].alias(c) for c in ("x", "y", "width", "height")), F.lit("inline").alias("kind"), sure.alias("confidence"), F.lit("script-layout").alias("source"), F.concat(trim(a["str"]), trim(b["str"])).alias("inferred_text"), F.array(k, k + 1).alias("source_items")).cast(REGION)
        done = F.exists(acc, lambda r: (r["kind"] == "inline") & _covers(r, ra) & _covers(r, rb))
        return F.when(done, acc).otherwise(F.array_append(F.filter(acc, lambda r: ~touched(r)), new))

    pairs = F.filter(F.when(F.size(items) > 1, F.sequence(F.lit(0), F.size(items) - 2)).otherwise(F.array().cast("array<int>")), raised)
    return F.aggregate(pairs, regions, step)


def confirm_weak(items: Column, v: Column, regions: Column, automatic: float = 0.8) -> Column:
    """regions that are sure, or that lie on notation: explicit signs, or compact items off the page's font that are small, mixed or alone.
    Then those go that hold the centres of two surer ones of their kind."""
    seen = F.filter(items, lambda i: (trim(F.coalesce(i["str"], F.lit(""))) != "") & (i["height"] > 0))
    font = dominant_font(seen)
    body = upper_median(F.transform(F.filter(seen, lambda i: letters(i["str"]) >= 4), lambda i: F.abs(i["height"] * v["scale"])), 0.0)
    body = F.when(body > 0, body).otherwise(10 * v["scale"])
    boxed = F.transform(seen, lambda i: F.struct(i.alias("i"), text_item_rect(i, v).alias("r")))

    def keep(region: Column) -> Column:
        smaller = lambda r: F.least(r["width"] * r["height"], region["width"] * region["height"])
        over = F.filter(boxed, lambda b: (smaller(b["r"]) > 0) & (intersection_area(b["r"], region) >= 0.12 * smaller(b["r"])))
        short = lambda b: F.length(F.regexp_replace(b["i"]["str"], "[\\s\\x{a0}\\x{feff}]", "")).between(1, 3) & (b["r"]["width"] <= F.greatest(region["width"] * 1.6, body * 2.5))
        compact = F.filter(over, short)
        off_font = F.exists(compact, lambda b: font.isNotNull() & ~b["i"]["font_name"].eqNullSafe(font))
        small = F.exists(compact, lambda b: b["r"]["height"] / 1.5 < body * 0.85)
        mixed = (F.size(compact) >= 2) & (F.size(F.array_distinct(F.transform(compact, lambda b: F.coalesce(b["i"]["font_name"], F.lit(""))))) >= 2)
        weak = F.exists(over, lambda b: b["i"]["str"].rlike(EXPLICIT)) | (off_font & (small | mixed | (F.size(compact) == 1)))
        return (region["confidence"] >= automatic) | weak

    kept = F.filter(regions, keep)
    cx, cy = (lambda o: o["x"] + o["width"] / 2), (lambda o: o["y"] + o["height"] / 2)
    holds = lambda r, o: (o["kind"] == r["kind"]) & (o["confidence"] > r["confidence"]) & cx(o).between(r["x"], r["x"] + r["width"]) & cy(o).between(r["y"], r["y"] + r["height"])
    return F.filter(kept, lambda r: F.size(F.filter(kept, lambda o: holds(r, o))) < 2)


def label_candidates(items: Column, v: Column, start: Column, end: Column) -> Column:
    """Array of (label, wrapped, start, end, rect): one to five items on one baseline that make a label; a bare one only alone, and not inside a bracketed one."""

    def one(k: Column, n: Column) -> Column:
        some = F.slice(items, k + 1, n)
        rect = combined_rect(some, v)
        base = F.transform(some, lambda i: text_item_rect(i, v)["baseline"])
        level = F.array_max(base) - F.array_min(base) <= F.greatest(F.lit(5.0), rect["height"] * 0.45)
        value = F.array_join(F.transform(some, lambda i: trim(i["str"])), "")
        wrapped = equation_label(value)
        label = F.when(n == 1, equation_label(value, bare=True)).otherwise(wrapped)
        whole = F.forall(some, lambda i: F.coalesce(i["str"], F.lit("")) != "")
        return F.when(whole & level & label.isNotNull(), F.struct(label.alias("label"), wrapped.isNotNull().alias("wrapped"), k.alias("start"), (k + n - 1).alias("end"), rect.alias("rect")))

    starts = F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))
    found = F.flatten(F.transform(starts, lambda k: F.transform(F.sequence(F.lit(1), F.least(F.lit(5), end - k + 1)), lambda n: one(k, n))))
    found = F.filter(found, lambda c: c.isNotNull())
    inside = lambda c: F.exists(found, lambda o: o["wrapped"] & (c["start"] >= o["start"]) & (c["end"] <= o["end"]))
    return F.filter(found, lambda c: c["wrapped"] | ~inside(c))


def associate_labels(candidates: Column, regions: Column) -> Column:
    """Array of (region, label, start, end): labels to the right of display regions, the nearest pairs first, each taken once."""

    def pair(c: Column, n: Column, r: Column, k: Column) -> Column:
        b = c["rect"]
        cx, cy, rx, ry = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2, r["x"] + r["width"] / 2, r["y"] + r["height"] / 2
        apart = F.abs(cy - ry)
        right = (cx > rx + r["width"] * 0.2) & (b["x"] >= r["x"] + r["width"] * 0.6)
        clear = c["wrapped"] | (b["x"] >= r["x"] + r["width"] + F.greatest(F.lit(4.0), r["height"] * 0.15))
        near = apart <= F.greatest(b["height"], r["height"]) * 0.7
        cost = apart * 10 + F.greatest(F.lit(0.0), b["x"] - r["x"] - r["width"])
        return F.when((r["kind"] == "display") & right & clear & near, F.struct(cost.alias("cost"), n.alias("n"), k.alias("region"), c["label"].alias("label"), c["start"].alias("start"), c["end"].alias("end")))

    pairs = F.flatten(F.transform(candidates, lambda c, n: F.transform(regions, lambda r, k: pair(c, n, r, k))))
    ranked = F.array_sort(F.filter(pairs, lambda p: p.isNotNull()))
    none = F.array().cast("array<struct<cost:double,n:int,region:int,label:string,start:int,end:int>>")
    taken = lambda acc, p: F.exists(acc, lambda q: (q["region"] == p["region"]) | (q["n"] == p["n"]))
    chosen = F.aggregate(ranked, none, lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.array_append(acc, p)))
    return F.transform(chosen, lambda p: F.struct(p["region"].alias("region"), p["label"].alias("label"), p["start"].alias("start"), p["end"].alias("end")))
