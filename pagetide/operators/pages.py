"""A page's text items as lines, equations by their place, translations and images by key: windows and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pagetide.functions import layout
from pagetide.functions.notation import signal_count
from pagetide.functions.text import trim
from pagetide.operators.locate import ascii_words


def page_lines(items: DataFrame) -> DataFrame:
    """(page_id, text) from items (page_id, item_idx, str, x, y, width, height): lines from top to bottom (heights to the nearest 3),
    items from left to right, a blank where there is a gap and no punctuation forbids it. Blank items do not count."""
    x = items.where(trim(F.coalesce("str", F.lit(""))) != "").withColumn("line", F.floor(F.col("y") / 3 + 0.5) * 3)
    w = W.partitionBy("page_id", "line").orderBy("x", "item_idx")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    open_ = ~F.lag("str").over(w).rlike("[-(/]\\z") & ~F.col("str").rlike("\\A[,.;:!?)]")
    spaced = F.coalesce((gap > F.greatest(F.lit(1.5), F.col("height") * 0.12)) & open_, F.lit(False))
    x = x.withColumn("piece", F.concat(F.when(spaced, " ").otherwise(""), F.col("str")))
    text = lambda rows, f: F.transform(F.array_sort(rows), lambda r: r[f])
    lines = x.groupBy("page_id", "line").agg(trim(F.array_join(text(F.collect_list(F.struct("x", "item_idx", "piece")), "piece"), "")).alias("t"))
    whole = lines.groupBy("page_id").agg(text(F.collect_list(F.struct((-F.col("line")).alias("l"), "t")), "t").alias("ts"))
    return whole.select("page_id", F.array_join(F.filter("ts", lambda t: t != ""), "\n").alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text, pages) from page texts (doc_id, page_no, text), a blank line between pages."""
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return p.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.size("p").alias("pages"))


def paragraph_ends(items: DataFrame, line_height: Column) -> DataFrame:
    """Items with text, with gap_before: whether a paragraph ended before the item. items: page_id, item_idx and an item's fields."""
    w = W.partitionBy("page_id").orderBy("item_idx")
    before = lambda c: F.lag(c).over(w)
    restart = F.coalesce(before("has_eol"), F.lit(False)) | (F.col("x") < before("x") - line_height)
    gap = restart & (before("y") - F.col("y") > line_height * 1.55)
    return items.where(F.coalesce("str", F.lit("")) != "").withColumn("gap_before", F.coalesce(gap, F.lit(False)))


def page_fonts(items: DataFrame) -> DataFrame:
    """(page_id, font, body_height): the font with the most letters, and the upper middle height, of items with four letters or more."""
    x = items.withColumn("n", layout.letters(F.col("str"))).where("n >= 4")
    heights = x.groupBy("page_id").agg(layout.upper_median(F.collect_list(F.when(F.abs("height") > 0, F.abs("height")))).alias("body_height"))  # one page's items
    by_font = x.where("font_name <> ''").groupBy("page_id", "font_name").agg(F.sum("n").alias("n"), F.min("item_idx").alias("first"))
    fonts = by_font.groupBy("page_id").agg(F.max_by("font_name", F.struct("n", -F.col("first"))).alias("font"))
    pages = items.select("page_id").distinct()
    return pages.join(fonts, "page_id", "left").join(heights, "page_id", "left").select("page_id", "font", F.coalesce("body_height", F.lit(10.0)).alias("body_height"))


def equation_cluster(items: DataFrame) -> DataFrame:
    """(page_id, item_idx) of the cluster of items that holds a labelled equation, and the label. items: page_id, item_idx, str, x, width, height, is_label.

    Items are parted where a gap exceeds twice the middle height; the cluster with the most notation, then the widest, then the first wins."""
    content = items.where("not is_label")
    label = items.where("is_label").groupBy("page_id").agg(F.max("height").alias("label_height"))
    middle = content.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("height") > 0, F.col("height")))).alias("hs"))
    middle = middle.join(label, "page_id", "left").select("page_id", (2 * F.coalesce(F.get("hs", F.floor(F.size("hs") / 2).cast("int")), F.nullif("label_height", F.lit(0.0)), F.lit(10.0))).alias("most"))
    by_x = W.partitionBy("page_id").orderBy("x", "item_idx")
    x = content.join(middle, "page_id").withColumn("reach", F.max(F.col("x") + F.col("width")).over(by_x.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("c", F.sum(F.when(F.col("x") - F.col("reach") > F.col("most"), 1).otherwise(0)).over(by_x))
    scored = x.groupBy("page_id", "c").agg((F.sum(signal_count(F.coalesce("str", F.lit("")))) * 100 + F.max(F.col("x") + F.col("width")) - F.min("x")).alias("score"))
    best = scored.groupBy("page_id").agg(F.max_by("c", F.struct("score", -F.col("c"))).alias("c"))
    return x.join(best, ["page_id", "c"]).select("page_id", "item_idx").union(items.where("is_label").select("page_id", "item_idx"))


@F.pandas_udf(IntegerType())
def _word_count(s: pd.Series) -> pd.Series:
    return s.map(lambda t: len(ascii_words(t or "")))


def numbered_equation_items(items: DataFrame) -> DataFrame:
    """The cluster among the items between the paragraphs around a label. items: as for equation_cluster, with y."""
    x = items.withColumn("prose", (F.col("height") > 0) & (_word_count(F.coalesce("str", F.lit(""))) >= 5))
    at = x.where("is_label").groupBy("page_id").agg(F.min("item_idx").alias("at"))
    x = x.join(at, "page_id")
    before = F.max(F.when(F.col("prose") & (F.col("item_idx") < F.col("at")), F.struct("item_idx", "y")))
    behind = F.min(F.when(F.col("prose") & (F.col("item_idx") > F.col("at")), F.struct("item_idx", "y")))
    near = x.groupBy("page_id").agg(before.alias("b"), behind.alias("e"))
    x = x.join(near, "page_id")
    inside = ((F.col("b").isNull()) | ((F.col("item_idx") > F.col("b.item_idx")) & (F.col("y") < F.col("b.y")))) & ((F.col("e").isNull()) | ((F.col("item_idx") < F.col("e.item_idx")) & (F.col("y") > F.col("e.y"))))
    return equation_cluster(x.where((inside & (trim(F.coalesce("str", F.lit(""))) != "")) | F.col("is_label")))


def interpolate(template: Column, values: Column) -> Column:
    """template with each {name} that the map values holds replaced, once."""
    parts = F.regexp_extract_all(template, F.lit("\\{\\w+\\}|\\{|[^{]+"), F.lit(0))
    name = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("\\A\\{\\w+\\}\\z"), F.coalesce(F.try_element_at(values, name(p)), p)).otherwise(p)), "")


def translate(rows: DataFrame, messages: DataFrame, default: str = "fr") -> DataFrame:
    """rows (lang, key, values) with label: the message of the language, else of the default one, else the key. messages: lang, key, template; a dictionary, of counted size."""
    few = F.broadcast if messages.count() <= 100_000 else (lambda df: df)
    own = messages.select("lang", "key", F.col("template").alias("__own"))
    base = messages.where(F.col("lang") == default).select("key", F.col("template").alias("__base"))
    known = messages.select(F.col("lang").alias("__lang")).distinct()
    x = rows.join(few(own), ["lang", "key"], "left").join(few(base), "key", "left").join(few(known), F.col("lang") == F.col("__lang"), "left")
    return x.withColumn("label", interpolate(F.coalesce("__own", "__base", "key"), F.col("values"))).drop("__own", "__base", "__lang")


def equation_images(items: DataFrame, images: DataFrame) -> DataFrame:
    """items (equation_id, manual_image) with image and pixel_ratio: the manual image, else the detected one (equation_id, image, ratio); ratio 1 unless detected."""
    x = items.join(images.select("equation_id", F.col("image").alias("__i"), F.col("ratio").alias("__r")), "equation_id", "left")
    manual = F.coalesce("manual_image", F.lit("")) != ""
    return x.withColumn("image", F.when(manual, F.col("manual_image")).otherwise(F.col("__i"))).withColumn("pixel_ratio", F.when(manual, 1.0).otherwise(F.coalesce("__r", F.lit(1.0)))).drop("__i", "__r")
