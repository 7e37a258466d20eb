"""Latest-wins over a stream: the newest event of each key, kept in the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """A streaming table of each key's newest event (complete or update mode); ties go to the larger row."""
    rest = [c for c in events.columns if c != key]
    newest = F.max(F.struct(ts, *[c for c in rest if c != ts])).alias("r")
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(key).agg(newest).select(key, "r.*")


def playback_states(commands: DataFrame) -> DataFrame:
    """State after each command (session_id, seq, command, n_items): index moves stay within the items; play and pause set playing.

    As a batch: moves between clamps compose to clamp(x + add, low, high), so a running fold over one session's
    commands is an aggregate over its sorted list.
    """
    step = """aggregate(array_sort(collect_list(struct(seq, command, n_items))),
        named_struct('i', 0, 'playing', false, 'o', cast(array() as array<struct<seq:bigint,index:int,playing:boolean>>)),
        (s, c) -> named_struct(
          'i', greatest(0, least(coalesce(c.n_items, 1) - 1, s.i + CASE c.command WHEN 'next' THEN 1 WHEN 'previous' THEN -1 ELSE 0 END)),
          'playing', CASE c.command WHEN 'play' THEN true WHEN 'pause' THEN false WHEN 'toggle' THEN NOT s.playing WHEN 'clear' THEN false ELSE s.playing END,
          'o', array_append(s.o, named_struct('seq', cast(c.seq as bigint),
             'index', greatest(0, least(coalesce(c.n_items, 1) - 1, s.i + CASE c.command WHEN 'next' THEN 1 WHEN 'previous' THEN -1 ELSE 0 END)),
             'playing', CASE c.command WHEN 'play' THEN true WHEN 'pause' THEN false WHEN 'toggle' THEN NOT s.playing WHEN 'clear' THEN false ELSE s.playing END))),
        s -> s.o)"""
    return commands.groupBy("session_id").agg(F.expr(step).alias("o")).select("session_id", F.explode("o").alias("x")).select("session_id", "x.*")
