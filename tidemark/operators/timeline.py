"""Edited timelines: words mapped onto played segments, and whether a peak deserves a cold opening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import earlier, over
from tidemark.operators import intervals, series


def once(words: DataFrame, digits: int = 3) -> DataFrame:
    """words without those that repeat a word of their source at the same times, to so many digits; the first place stays."""
    place = F.struct("seg_no", "word_no", "start_s", "end_s")
    rows = words.groupBy("source", "word", F.round("start_s", digits), F.round("end_s", digits)).agg(F.min(place).alias("r"))
    return rows.select("source", "word", "r.*")


def timeline_remap(words: DataFrame, played: DataFrame, clips: DataFrame, gap: float = 0.06, width: float = 20) -> DataFrame:
    """(clip_id, seg_no, word_no, out_start, out_end): each word where it is heard in the edit; a word told twice at the same times is one, a word played twice stays twice, its touching fragments are one."""
    cut = played.select("clip_id", "k", "a", "b").withColumn("out", F.coalesce(F.sum(F.col("b") - F.col("a")).over(earlier("clip_id", by=["k"])), F.lit(0.0)))
    cut = cut.join(clips.select("clip_id", "source", F.col("start_s").alias("zero")), "clip_id").select("clip_id", "source", "k", "out", (F.col("zero") + F.col("a")).alias("from"), (F.col("zero") + F.col("b")).alias("to"))
    said = once(words).select("source", "seg_no", "word_no", F.col("start_s").alias("ws"), F.col("end_s").alias("we"))
    heard = intervals.bucketed_join(cut, said, "source", (F.col("ws") < F.col("to")) & (F.col("from") < F.col("we")), (F.col("from"), F.col("to")), (F.col("ws"), F.col("we")), width)
    rows = heard.select("clip_id", "seg_no", "word_no", "k", (F.col("out") + F.greatest("ws", "from") - F.col("from")).alias("s"), (F.col("out") + F.least("we", "to") - F.col("from")).alias("e"))
    keys = ("clip_id", "seg_no", "word_no")
    last = F.lag("e").over(over(*keys, by=["s", "k"]))
    rows = rows.withColumn("new", F.when(last.isNull() | (F.col("s") - last > gap), 1).otherwise(0)).withColumn("run", F.sum("new").over(over(*keys, by=["s", "k"])))
    return rows.groupBy(*keys, "run").agg(F.round(F.min("s"), 3).alias("out_start"), F.round(F.max("e"), 3).alias("out_end")).drop("run")


def sharp_peak_decision(clips: DataFrame, energy: DataFrame, played: DataFrame, sharp: float = 3.0, before: float = 3, after: float = 2, least_gap: float = 8) -> DataFrame:
    """(clip_id, reason): the first ground against opening a clip with its peak; '' if there is none."""
    shape = series.window_shape(clips, energy, sharp).select("clip_id", "peak_sec", "sharp")
    rows = clips.select("clip_id", "start_s", "end_s").join(shape, "clip_id", "left").join(intervals.payoff_gap(played, clips), "clip_id", "left")
    reason = (
        F.when(F.col("sharp").isNull(), "no shape").when(~F.col("sharp"), "flat").when(F.col("peak_sec") - F.col("start_s") < before, "too early")
        .when(F.col("end_s") - F.col("peak_sec") < after, "too late").when(F.col("gap").isNull(), "peak cut").when(F.col("gap") < least_gap, "too near").otherwise("")
    )
    return rows.select("clip_id", reason.alias("reason"))
