"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Sources share the total by weight; a source's target stops at `most` times its size, and what is left
over is shared by the others, which is a water level found from sorted cap/weight ratios.
The mix is a run of slots of `block` words (by default the total over 2**18, from 16 to 1024). Slot n has the point (n * golden ratio) mod 1, in integer
arithmetic; the point falls in one source's stretch of the cumulative targets, and its place in that stretch names one cell: `block` words of the
source's documents, laid end to end in shuffled order (by md5 of the id). Points are spread evenly, so slots visit every source, and every
cell of it, nearly as often as its target asks. That number of visits is rounded: each cell goes in as often as the target holds the whole source, and once
more if the schedule visits it most, of equals those visited first, until the source has its target, rounded to a word; the last such cell
gives a part. So the schedule decides which documents go in once more and when a document first comes, while
every source, however small against a slot, gives its target, and its documents are taken equally often up to one.

Nothing large is ordered in one task: the order of cells is made of offsets of ranges plus sums within the
range, word offsets are offsets of hash buckets plus sums within the bucket, and both ranges and
buckets grow in number with the input, whatever source holds how much of it. Only ids and sizes move, never texts.

Defined results: null text or blank text has size 0 and takes no part; a null source is one source, last; rows with one id are
separate rows; no words at all give targets of 0. `taken` counts words, in parts of a document
too; it never exceeds `most` times its size. `slot` is the first slot that brings words of the document, null if none does (then
what it gives, if anything, comes at the mix's end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.op9_quality import words
from pagetide.llm.shared import cut

TURN = 1 << 31
GOLDEN = 1327217885  # odd, TURN / golden ratio
BINS = 1 << 12


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, nth, source_size, target, lo, hi) from (source, size); one row a source, so its windows are over few rows."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("nth", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    everything = W.partitionBy()
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = W.orderBy("ratio", "nth").rowsBetween(W.unboundedPreceding, -1)
    # with the sources before this one at their caps, the level for this one and the rest
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    s = s.withColumn("level", (F.col("total") - before("cap")) / (F.sum("w").over(everything) - before("w")))
    s = s.withColumn("water", F.min_by(F.col("level"), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "nth"))).over(everything))
    s = s.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("water"))))
    upto = F.coalesce(F.sum("target").over(order) / F.nullif(F.sum("target").over(everything), F.lit(0.0)), F.lit(0.0))
    s = s.withColumn("hi", F.floor(TURN * upto + 0.5))
    return s.select("source", "nth", "source_size", "target", F.coalesce(F.lag("hi").over(order), F.lit(0)).alias("lo"), "hi")


def _few(df: DataFrame, most: int = 20_000) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def schedule(plan: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, nth, cell) from targets(): each slot's source, by its number, and the cell of it that the slot brings."""
    # each point meets the sources whose stretch touches its bin
    slots = plan.sparkSession.range(0, -(-total // block)).withColumn("u", F.pmod(F.pmod(F.col("id"), F.lit(TURN)) * GOLDEN, F.lit(TURN)))
    slots = slots.withColumn("bin", F.floor(F.col("u") / (TURN // BINS)))
    spread = plan.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / (TURN // BINS)), F.floor((F.col("hi") - 1) / (TURN // BINS)))))
    spread = spread.withColumn("cells", F.expr(f"(source_size + {block - 1}) div {block}"))
    slots = slots.join(_few(spread), "bin").where("u >= lo and u < hi")
    return slots.select(F.col("id").alias("slot"), "nth", F.expr("(u - lo) * cells div (hi - lo)").alias("cell"))


def once_more(cells: DataFrame, visits: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """(nth, cell, extra, slot) of each row of cells(nth, cell): the words a cell gives beyond whole rounds of its source, and its first slot."""
    met = visits.groupBy("nth", "cell").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    x = cells.join(met, ["nth", "cell"], "left").join(_few(plan.select("nth", "source_size", "rest")), "nth")
    x = x.withColumn("times", F.coalesce("times", F.lit(0))).withColumn("words", F.least(F.lit(block), F.expr(f"source_size - cell * {block}")))
    # by visits, then by the first slot; cells without a slot in a spread order. Ranges hold a few thousand cells
    stray = F.pmod(F.pmod(F.col("cell"), F.lit(TURN)) * GOLDEN, F.lit(TURN))
    x = x.withColumn("turn", F.coalesce("slot", stray)).withColumn("range", F.when(F.col("slot").isNotNull(), F.expr("slot div 4096")).otherwise(F.expr(f"turn * (source_size div {4096 * block} + 1) div {TURN}")))
    x = cut(x)
    upto = W.partitionBy("nth").orderBy(F.col("times").desc(), "range").rowsBetween(W.unboundedPreceding, 0)
    base = x.groupBy("nth", "times", "range").agg(F.sum("words").alias("sum")).withColumn("base", F.sum("sum").over(upto) - F.col("sum")).drop("sum")
    within = W.partitionBy("nth", "times", "range").orderBy("turn", "cell").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("words").over(within)).join(base, ["nth", "times", "range"])
    return x.select("nth", "cell", F.greatest(F.lit(0), F.least("words", F.expr("rest - base - upto + words"))).alias("extra"), "slot")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, slot) of each row, with its source."""
    spark = docs.sparkSession
    key = F.col(id_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("long").alias("size"),
        F.md5(F.coalesce(key, F.lit("")).cast("binary")).alias("k"),
    )
    rows = cut(rows)
    plan = targets(rows, weights, most).withColumn("goal", F.floor(F.col("target") + 0.5))
    plan = cut(plan.withColumn("whole", F.coalesce(F.expr("goal div nullif(source_size, 0)"), F.lit(0))).withColumn("rest", F.expr("goal - whole * source_size")))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block or min(1024, max(16, total >> 18))
    # word offsets: hash buckets of a few thousand rows each
    buckets = n // 2048 + 1
    rows = rows.withColumn("b", (F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
    sums = rows.groupBy("source", "b").agg(F.sum("size").alias("s"))
    sums = sums.select(F.col("source").alias("s_"), F.col("b").alias("b_"), (F.sum("s").over(W.partitionBy("source").orderBy("b")) - F.col("s")).alias("base"))
    within = W.partitionBy("source", "b").orderBy("k", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_")) & (F.col("b") == F.col("b_"))).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
    rows = rows.join(_few(plan.withColumnRenamed("source", "p_")), F.col("source").eqNullSafe(F.col("p_")))
    rows = cut(rows.select("doc_id", "source", "nth", "size", "start", "source_size", "target", "whole"))
    # the cells each document lies in; a cell is its source's by the document that holds its first word
    parts = rows.where("size > 0").select("nth", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("cell"))
    cells = once_more(parts.where(f"cell * {block} >= start").select("nth", "cell"), schedule(plan, total, block), plan, block)
    words_in = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("cell") * block + F.col("extra")) - F.greatest(F.col("start"), F.col("cell") * block))
    more = parts.join(cells, ["nth", "cell"]).groupBy("nth", "start").agg(F.sum(words_in).alias("more"), F.min("slot").alias("slot"))
    # words in whole rounds, and once more; a row without words shares its start with the next one
    out = rows.where("size > 0").join(more, ["nth", "start"]).withColumn("taken", F.col("whole") * F.col("size") + F.col("more"))
    none = rows.where("size = 0").withColumn("taken", F.lit(0)).withColumn("slot", F.lit(None).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "slot"]
    return out.select(*names).union(none.select(*names))


def copies() -> Column:
    """How often a whole document goes into the mix: its taken words over its size, rounded."""
    return F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it. Needs doc_id, text and source; ids must tell rows apart."""
    times = mix(docs, **options).groupBy("doc_id").agg(F.max(copies()).alias("__n")).withColumnRenamed("doc_id", "__id").where("__n > 0")
    out = docs.join(times, docs["doc_id"].eqNullSafe(times["__id"]))
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1), "__n"))).select(*docs.columns)
