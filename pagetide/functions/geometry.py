"""Boxes and layout as Column arithmetic. A region is a struct with x, y, width, height, kind, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.pacing import rounded

REGION = "struct<x:double,y:double,width:double,height:double,kind:string,confidence:double>"


def _span(a: Column, b: Column, at: str, size: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))


def intersection_area(a: Column, b: Column) -> Column:
    return _span(a, b, "x", "width") * _span(a, b, "y", "height")


def iou(a: Column, b: Column) -> Column:
    shared = intersection_area(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when(union > 0, shared / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def non_max_suppression(regions: Column, threshold: float = 0.45) -> Column:
    """Most confident regions first; one goes if it overlaps a kept one of its kind by more than threshold."""
    ranked = F.array_sort(F.transform(regions, lambda r, i: F.struct((-r["confidence"]).alias("rank"), i.alias("at"), r.alias("r"))))
    none = F.array().cast(f"array<{REGION}>")
    clash = lambda kept, r: F.exists(kept, lambda k: (k["kind"] == r["kind"]) & (iou(k, r) > threshold))
    return F.aggregate(F.transform(ranked, lambda s: s["r"].cast(REGION)), none, lambda kept, r: F.when(clash(kept, r), kept).otherwise(F.array_append(kept, r)))


def model_geometry(width: Column, height: Column, target: int = 768, stride: int = 32) -> Column:
    scale = F.lit(float(target)) / width
    resized = rounded(height * scale)
    return F.struct(scale.alias("scale"), F.lit(target).alias("target_width"), (F.ceil(resized / stride) * stride).alias("target_height"), resized.alias("resized_height"))


def decode_regions(dims: Column, data: Column, scale: Column, least: float = 0.8) -> Column:
    """Regions of a channel-major [1, 6, n] tensor, after suppression; any other channel count is an error."""
    n = dims[2]
    at = lambda channel, i: F.element_at(data, (F.lit(channel) * n + i + 1).cast("int")).cast("double")
    box = lambda i: F.struct(
        ((at(0, i) - at(2, i) / 2) / scale).alias("x"), ((at(1, i) - at(3, i) / 2) / scale).alias("y"), (at(2, i) / scale).alias("width"), (at(3, i) / scale).alias("height"),
        F.when(at(5, i) > at(4, i), "display").otherwise("inline").alias("kind"), F.greatest(at(4, i), at(5, i)).alias("confidence"),
    )
    sure = F.filter(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), box), lambda r: r["confidence"] >= least)
    return F.when(dims[1] != 6, F.raise_error(F.lit("a tensor of 6 channels is expected"))).otherwise(non_max_suppression(sure))


def vertical_distance(region: Column, y: Column) -> Column:
    return F.greatest(F.lit(0.0), region["y"] - y, y - region["y"] - region["height"])


def vertical_overlap(a: Column, b: Column) -> Column:
    return _span(a, b, "y", "height")


def _best(candidates: Column, order, unclear) -> Column:
    """First candidate by order; null if there is none, or if unclear(first, second)."""
    s = F.array_sort(candidates, order)
    return F.when((F.size(s) == 0) | F.coalesce((F.size(s) > 1) & unclear(F.get(s, F.lit(0)), F.get(s, F.lit(1))), F.lit(False)), None).otherwise(F.get(s, F.lit(0))["r"])


def region_for_label(regions: Column, y: Column) -> Column:
    """The display region nearest to a label's height, if it is near and no other is within 2."""
    near = F.filter(F.transform(F.filter(regions, lambda r: r["kind"] == "display"), lambda r: F.struct(vertical_distance(r, y).alias("d"), r.alias("r"))), lambda c: c["d"] <= F.greatest(F.lit(24.0), c["r"]["height"]))
    order = lambda a, b: F.when(a["d"] != b["d"], F.signum(a["d"] - b["d"])).otherwise(F.signum(b["r"]["confidence"] - a["r"]["confidence"])).cast("int")
    return _best(near, order, lambda a, b: F.abs(b["d"] - a["d"]) < 2)


def region_for_rect(regions: Column, rect: Column) -> Column:
    """The region that covers most of the smaller of itself and rect, if it stands out."""
    share = lambda r: intersection_area(r, rect) / F.nullif(F.least(r["width"] * r["height"], rect["width"] * rect["height"]), F.lit(0.0))
    over = F.filter(F.transform(regions, lambda r: F.struct(F.coalesce(share(r), F.lit(0.0)).alias("o"), r.alias("r"))), lambda c: c["o"] >= 0.08)
    order = lambda a, b: F.when(a["o"] != b["o"], F.signum(b["o"] - a["o"])).otherwise(F.signum(b["r"]["confidence"] - a["r"]["confidence"])).cast("int")
    return _best(over, order, lambda a, b: b["o"] >= a["o"] * 0.9)


def crop_bounds(region: Column, width: Column, height: Column, padding: float = 8.0, scale: float = 1.0) -> Column:
    scale = scale if 0 < scale < float("inf") else 1.0
    left, top = (F.greatest(F.lit(0), F.floor((region[k] - padding) * scale)) for k in ("x", "y"))
    right, low = (F.least(edge, F.ceil((region[k] + region[s] + padding) * scale)) for edge, k, s in ((width, "x", "width"), (height, "y", "height")))
    return F.when((right > left) & (low > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (low - top).alias("height")))


def pixel_ratio(width: Column, height: Column, most: float = 16e6, target: float = 2.0) -> Column:
    pixels = (width * height).cast("double")
    return F.when(pixels > 0, F.greatest(F.lit(1.0), F.least(F.lit(target), F.sqrt(F.lit(most) / F.nullif(pixels, F.lit(0.0)))))).otherwise(1.0)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf"))


def _size(c: Column, default: float) -> Column:
    return F.when(_finite(c) & (c > 0), rounded(c)).otherwise(F.lit(default)).cast("double")


def window_layout(parent_width: Column, parent_height: Column, left: Column, top: Column, saved_width: Column, saved_height: Column) -> Column:
    """Size and place of a reader window centred in its parent, with a margin of 40 and 360 x 300 at least where that fits."""
    out = {}
    for size, at, parent, default, saved, usual, least, origin in (("width", "left", parent_width, 1200, saved_width, 1000, 360, left), ("height", "top", parent_height, 800, saved_height, 620, 300, top)):
        room = _size(parent, default)
        most = F.greatest(F.lit(1.0), room - 40)
        out[size] = F.least(most, F.greatest(F.least(F.lit(float(least)), most), _size(saved, usual)))
        out[at] = rounded(F.when(_finite(origin), origin).otherwise(0.0) + (room - out[size]) / 2)
    return F.struct(*(v.cast("long").alias(k) for k, v in out.items()))


def content_scale(viewport_height: Column) -> Column:
    return F.when(_finite(viewport_height), rounded(F.least(F.lit(1.6), 1 + F.greatest(F.lit(0.0), viewport_height - 255) / 500) * 100) / 100).otherwise(1.0)


def image_size(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(_finite(n), F.least(F.lit(180), F.greatest(F.lit(60), rounded(n / 10) * 10))).otherwise(100)


def snapshot_width(natural: Column, scale: Column, ratio: Column) -> Column:
    density = F.when(_finite(ratio) & (ratio > 0), ratio).otherwise(1.0)
    zoom = F.when(_finite(scale), F.least(F.lit(2.4), F.greatest(F.lit(0.6), scale))).otherwise(1.0)
    return F.when(_finite(natural) & (natural > 0), rounded((natural / density + 10) * zoom))


def context_lane(width: Column, count: Column) -> Column:
    ok = _finite(width) & (width > 0) & _finite(count) & (count > 0)
    ratio = F.least(F.lit(0.38), 0.14 + F.least(F.lit(7.0), count) * 0.035)
    most = F.least(F.lit(300.0), F.greatest(F.lit(0.0), width / 2 - 72))
    return F.when(ok, rounded(F.least(most, F.greatest(F.when(count == 1, 72.0).otherwise(96.0), width * ratio)))).otherwise(0)


def search_progress(done: Column, total: Column) -> Column:
    return F.when(_finite(total) & (total > 0), 8 + F.greatest(F.lit(0.0), F.least(total, done)) / total * 62).otherwise(8.0)
