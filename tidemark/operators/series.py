"""Event detection in per-second series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import over
from tidemark.operators.intervals import bucketed_join


def track_mix_rms(signal: DataFrame, window: int = 4) -> DataFrame:
    """(source, win, rms): tracks summed per tick, then root mean square per window of ticks that are all there."""
    mixed = signal.groupBy("source", "sec").agg(F.sum("amp").alias("x"))
    rows = mixed.groupBy("source", F.floor(F.col("sec") / window).cast("long").alias("win")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*") + 1e-9), 2).alias("rms"))
    return rows.where(F.col("n") == window).select("source", "win", "rms")


def _islands(rows: DataFrame) -> DataFrame:
    return rows.withColumn("island", F.col("sec") - F.row_number().over(over("source", by=["sec"])))


def spike_runs(energy: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """(source, start_s, end_s, peak, intensity): runs of seconds louder than mean + sigmas deviations."""
    stats = energy.groupBy("source").agg(F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("sigma"))
    hot = energy.join(stats, "source").where((F.col("sigma") > 0) & (F.col("rms") > F.col("mean") + sigmas * F.col("sigma")))
    z = F.round((F.max("rms") - F.first("mean")) / F.first("sigma"), 2)
    return (
        _islands(hot).groupBy("source", "island")
        .agg(F.min("sec").cast("double").alias("start_s"), (F.max("sec") + 1).cast("double").alias("end_s"), F.min_by("sec", F.struct(-F.col("rms"), F.col("sec"))).cast("double").alias("peak"), z.alias("intensity"))
        .drop("island")
    )


def silence_runs(energy: DataFrame, floor: float = 5.0, least: float = 1.5) -> DataFrame:
    """(source, start_s, end_s): runs of seconds below the floor that last `least` or more."""
    runs = _islands(energy.where(F.col("rms") < floor)).groupBy("source", "island").agg(F.min("sec").cast("double").alias("start_s"), (F.max("sec") + 1).cast("double").alias("end_s"))
    return runs.where(F.col("end_s") - F.col("start_s") >= least).drop("island")


def snap_to_silence(clips: DataFrame, quiet: DataFrame, slack: float = 0.25, hold: float = 0.4, cmax: float = 30, reach: float = 4, width: float = 40) -> DataFrame:
    """(clip_id, new_end): the end moved to `hold` after the next silence's start, within the ceiling; else left."""
    ceiling = F.col("c_start") + cmax + reach
    c = clips.select("clip_id", "source", F.col("start_s").alias("c_start"), F.col("end_s").alias("c_end"))
    found = bucketed_join(c, quiet, "source", (F.col("start_s") >= F.col("c_end") - slack) & (F.col("start_s") < ceiling), (F.col("c_end") - slack, F.greatest(F.col("c_end"), ceiling)), (F.col("start_s"), F.col("start_s")), width)
    first = found.groupBy("clip_id").agg(F.min("start_s").alias("at"))
    return c.join(first, "clip_id", "left").select("clip_id", F.round(F.when(F.col("at").isNotNull(), F.least(F.col("at") + hold, ceiling)).otherwise(F.col("c_end")), 2).alias("new_end"))


def window_shape(clips: DataFrame, energy: DataFrame, sharp: float = 3.0, least: int = 3, width: float = 30) -> DataFrame:
    """(clip_id, peak_rms, peak_sec, median, z, sharp): shape of the energy in each clip against its whole source."""
    sigma = energy.groupBy("source").agg(F.stddev_pop("rms").alias("sigma"))
    c = clips.select("clip_id", "source", F.floor("start_s").alias("lo"), F.round("end_s").cast("long").alias("hi"))
    inside = bucketed_join(c, energy, "source", (F.col("sec") >= F.col("lo")) & (F.col("sec") < F.col("hi")), (F.col("lo"), F.col("hi")), (F.col("sec"), F.col("sec")), width)
    shape = inside.join(sigma, "source").groupBy("clip_id").agg(F.count("*").alias("n"), F.max("rms").alias("peak_rms"), F.min_by("sec", F.struct(-F.col("rms"), F.col("sec"))).alias("peak_sec"), F.expr("percentile(rms, 0.5)").alias("median"), F.first("sigma").alias("sigma"))
    ok = shape.where((F.col("n") >= least) & (F.col("sigma") > 0)).withColumn("z", F.round((F.col("peak_rms") - F.col("median")) / F.col("sigma"), 2))
    return ok.select("clip_id", "peak_rms", "peak_sec", "median", "z", (F.col("z") >= sharp).alias("sharp"))


def moments_union(segments: DataFrame, spikes: DataFrame, peaks: DataFrame) -> DataFrame:
    """(id, source, type, start_s, end_s, peak): spikes, then speech; ids hold source and position within it.

    A running number over all sources would put every moment through one task; a number within the source is as stable.
    """
    speech = segments.join(peaks, ["source", "seg_no"], "left").select("source", F.lit("speech").alias("type"), "start_s", "end_s", F.col("peak").cast("double").alias("peak"))
    both = spikes.select("source", F.lit("audio_spike").alias("type"), "start_s", "end_s", "peak").unionByName(speech)
    nth = F.row_number().over(over("source", by=["type", "start_s", "end_s"])) - 1
    return both.select(F.concat(F.lit("m"), F.col("source").cast("string"), F.lit("_"), F.lpad(nth.cast("string"), 4, "0")).alias("id"), "source", "type", "start_s", "end_s", "peak")
