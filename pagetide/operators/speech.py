"""Speech: language of a text, choice of voices, chunks of items, and positions back to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.functions.text import locale_prefix, normalized_locale, trim

#: Words that mark French and English.
FRENCH = ("au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "nous", "par", "pour", "que", "qui", "sur", "une")
ENGLISH = ("a", "and", "are", "as", "by", "for", "from", "in", "is", "of", "on", "that", "the", "this", "to", "we", "which", "with")


def speech_locale(text: Column, fallback: Column | str = "fr") -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(low, F.lit("\\p{L}+"), F.lit(0))
    count = lambda marks: F.size(F.filter(found, lambda w: w.isin(*marks)))
    fr, en = count(FRENCH) + F.when(low.rlike("[àâçéèêëîïôùûüÿœ]"), 2).otherwise(0), count(ENGLISH)
    return F.when(en > fr, "en-US").when(fr > en, "fr-FR").otherwise(normalized_locale(F.lit(fallback) if isinstance(fallback, str) else fallback))


def voice_key(name: Column, lang: Column) -> Column:
    return F.concat(F.lower(trim(F.coalesce(name, F.lit("")))), F.lit("\x00"), F.lower(F.coalesce(lang, F.lit(""))))


def unique_voices(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both engines' voices (voice_name, lang, remote, event_types, engine, nth), the first of each name and language."""
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1))).where(trim(F.coalesce("voice_name", F.lit(""))) != "")
    w = W.partitionBy(voice_key(F.col("voice_name"), F.col("lang"))).orderBy("__o", "nth")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__o", "__r")


def choose_voice(voices: list[dict], preferred: Column, locale: Column) -> Column:
    """Name of the preferred voice, else of the best local one; ties go to the first. voices: the installed ones, in order."""
    kept = [v for v in voices if v.get("voice_name")]
    if not kept:
        return F.lit(None).cast("string")
    score = lambda v: 4 * (F.lower(locale) == (v.get("lang") or "").lower()).cast("int") + 8 * (locale_prefix(locale) == (v.get("lang") or "").lower().split("-")[0]).cast("int") + 6 * int("word" in (v.get("event_types") or ()))
    ranked = [F.when(preferred == v["voice_name"], F.struct(F.lit(1000).alias("s"), F.lit(-i).alias("o"), F.lit(v["voice_name"]).alias("n"))) for i, v in enumerate(kept)]
    ranked += [F.struct(score(v).alias("s"), F.lit(-i).alias("o"), F.lit(v["voice_name"]).alias("n")) for i, v in enumerate(kept) if v.get("remote") is not True]
    return F.array_max(F.array(*ranked))["n"]


def boundary_items(entries: DataFrame, events: DataFrame) -> DataFrame:
    """For each event (chunk_id, event_id, position), the last entry (chunk_id, item_idx, start) that starts there or before, else the first: an as-of join on one sorted pass."""
    e = entries.select("chunk_id", F.col("start").cast("long").alias("at"), F.lit(0).alias("side"), F.col("item_idx"), F.lit(None).cast("long").alias("event_id"))
    v = events.select("chunk_id", F.greatest(F.lit(0), F.coalesce("position", F.lit(0))).cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("item_idx"), F.col("event_id").cast("long"))
    w = W.partitionBy("chunk_id").orderBy("at", "side", "item_idx")
    x = e.union(v).withColumn("hit", F.last("item_idx", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("first", F.first("item_idx", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return x.where("side = 1").select("chunk_id", "event_id", F.coalesce("hit", "first").alias("item_idx"))
