"""Voting over repeated reads, in batch: evidence, fusion, agreement and sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..formats import GLYPHS


def characters(frames: DataFrame) -> DataFrame:
    """(session_id, pos, ch, weight) of every character of ``frames(session_id, line, weight)``."""
    return frames.select("session_id", "weight", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("pos", "ch"))


def fuse_characters(frames: DataFrame) -> DataFrame:
    """(session_id, fused): at each position the character of most weight, the earlier glyph in a tie.

    The votes are combined before the shuffle: a position of a session has at
    most as many rows as the alphabet.
    """
    votes = characters(frames).groupBy("session_id", "pos", "ch").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("session_id", "pos").agg(F.min(F.struct((-F.col("w")).alias("w"), F.instr(F.lit(GLYPHS), F.col("ch")).alias("g"), "ch")).alias("b"))
    ordered = best.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("b.ch").alias("ch")))).alias("all"))
    return ordered.select("session_id", F.array_join(F.transform("all", lambda x: x["ch"]), "").alias("fused"))


def agreement(frames: DataFrame, fused: DataFrame, percent: int = 92) -> DataFrame:
    """(session_id, frames, agreeing): frames of which ``percent`` of the characters match the fused text."""
    j = frames.join(fused, "session_id")
    same = F.size(F.filter(F.zip_with(F.split("line", ""), F.split("fused", ""), lambda a, b: a.eqNullSafe(b) & (a != "")), lambda x: x))
    return j.groupBy("session_id").agg(F.count("*").alias("frames"), F.count_if(same * 100 >= F.length("fused") * percent).alias("agreeing"))


def rolling_sightings(frames: DataFrame, window: int = 16) -> DataFrame:
    """Sightings of each frame's identity among the last ``window`` frames of its session."""
    recent = Window.partitionBy("session_id").orderBy("frame_no").rowsBetween(1 - window, 0)
    seen = F.collect_list("identity").over(recent)
    return frames.withColumn("_seen", seen).select("session_id", "frame_no", "identity", F.size(F.filter("_seen", lambda x: x == F.col("identity"))).cast("long").alias("sightings"))
