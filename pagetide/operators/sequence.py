"""Operators over reading items (doc_id, item_idx, value, kind, paragraph_end), by windows within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.functions.pacing import before_equation, ends_sentence, reading_delay
from pagetide.functions.text import SPACE, words


def _order():
    return W.partitionBy("doc_id").orderBy("item_idx")


def item_array(text: Column) -> Column:
    """Word items (value, kind, paragraph_end) of a whole text as one array; the last word of a line ends a paragraph."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\\n"), lambda v: v.rlike(f"[^{SPACE}]"))
    return F.flatten(F.transform(F.transform(lines, words), lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("value"), F.lit("word").alias("kind"), (i == F.size(ws) - 1).alias("paragraph_end")))))


def reading_items(docs: DataFrame) -> DataFrame:
    """Word items of whole texts."""
    return docs.select("doc_id", F.posexplode(item_array(F.col("text"))).alias("item_idx", "w")).select("doc_id", "item_idx", "w.*")


def with_sentences(items: DataFrame) -> DataFrame:
    """items with sentence_id, and start_idx and end_idx of the sentence."""
    end = ends_sentence(F.col("value"), F.col("paragraph_end"))
    x = items.withColumn("__e", end.cast("int")).withColumn("sentence_id", F.coalesce(F.sum("__e").over(_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("__e")
    s = W.partitionBy("doc_id", "sentence_id")
    return x.withColumn("start_idx", F.min("item_idx").over(s)).withColumn("end_idx", F.max("item_idx").over(s))


def with_replay(items: DataFrame) -> DataFrame:
    """items with sentences and replay_idx: the sentence's start, or from there the start of the one before."""
    x = with_sentences(items)
    before = F.lag("start_idx").over(_order())  # at a sentence's first item, the item before belongs to the sentence before
    return x.withColumn("replay_idx", F.when(F.col("item_idx") > F.col("start_idx"), F.col("start_idx")).otherwise(F.coalesce(before, F.col("start_idx"))))


def with_context(items: DataFrame, k: int) -> DataFrame:
    """items with the k nearest words before and after, equations left out."""
    if k <= 0:
        return items.withColumn("before", F.array().cast("array<string>")).withColumn("after", F.array().cast("array<string>"))
    prose = F.when(F.col("kind") != "equation", 1).otherwise(0)
    x = items.withColumn("__n", F.sum(prose).over(_order()))  # prose items up to here
    own = F.when(F.col("kind") != "equation", F.struct("__n", "value"))
    rank = W.partitionBy("doc_id").orderBy("__n")
    prior = F.collect_list(own).over(rank.rangeBetween(-k, 0))
    later = F.collect_list(own).over(rank.rangeBetween(1, k))
    x = x.withColumn("__b", prior).withColumn("__a", later).withColumn("__u", F.col("__n") - prose)
    text = lambda c: F.transform(F.array_sort(c), lambda s: s["value"])
    x = x.withColumn("before", text(F.filter("__b", lambda s: (s["__n"] <= F.col("__u")) & (s["__n"] > F.col("__u") - k)))).withColumn("after", text("__a"))
    return x.drop("__n", "__b", "__a", "__u")


def with_timeline(items: DataFrame, wpm: float = 300, mode: str | Column = "normal") -> DataFrame:
    """items with delay_ms (a following equation takes the pause of the word before it) and start_ms."""
    to_equation = (F.lead("kind").over(_order()) == "equation") & (F.col("kind") != "equation")
    x = items.withColumn("__q", F.coalesce(to_equation, F.lit(False)))
    plain = reading_delay(F.col("value"), wpm, mode, F.col("kind"), F.col("paragraph_end"))
    short = reading_delay(before_equation(F.col("value")), wpm, mode, F.col("kind"))
    x = x.withColumn("delay_ms", F.when(F.col("__q"), short).otherwise(plain)).drop("__q")
    return x.withColumn("start_ms", F.coalesce(F.sum("delay_ms").over(_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


def equation_counts(items: DataFrame) -> DataFrame:
    """Equations of each document, and those left unresolved (no detected region behind them; column unresolved)."""
    equation = F.col("kind") == "equation"
    return items.groupBy("doc_id").agg(F.count_if(equation).alias("equations"), F.count_if(equation & F.coalesce("unresolved", F.lit(False))).alias("unresolved"))


def sentence_context(items: DataFrame) -> DataFrame:
    """items (with sentences) with sentence: the words of the item's sentence in order, equations left out."""
    s = W.partitionBy("doc_id", "sentence_id").orderBy("item_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return items.withColumn("sentence", F.collect_list(F.when(F.col("kind") != "equation", F.col("value"))).over(s))


def with_next_equation(items: DataFrame) -> DataFrame:
    """items with equation_next: whether the following item is an equation."""
    return items.withColumn("equation_next", F.coalesce(F.lead("kind").over(_order()) == "equation", F.lit(False)))


def insert_items(items: DataFrame, added: DataFrame) -> DataFrame:
    """items with those of added before the item that holds their item_idx, or in its place where replace is set; numbered anew."""
    gone = added.where("replace").select("doc_id", "item_idx")
    names = [c for c in items.columns if c not in ("doc_id", "item_idx")]
    kept = items.join(gone, ["doc_id", "item_idx"], "left_anti").select("doc_id", "item_idx", F.lit(1).alias("__o"), *names)
    both = kept.unionByName(added.select("doc_id", "item_idx", F.lit(0).alias("__o"), *names))
    return both.withColumn("item_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("item_idx", "__o")) - 1).drop("__o")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key, whole; pre-aggregated, so a hot key is no hot task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")
