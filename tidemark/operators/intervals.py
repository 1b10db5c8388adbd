"""Interval algebra over (source, start_s, end_s) rows.

Overlap joins deal both sides into time buckets of a width near the common interval length, join on (key, bucket), and
emit a pair only in the first bucket that both share, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import earlier, joined, over, running


def bucketed_join(left: DataFrame, right: DataFrame, key: str, on: Column, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float) -> DataFrame:
    """Inner join of rows with equal key whose (closed) spans may touch, under the residual predicate `on`.

    Columns of the right side must have names of their own, but for key.
    """

    def dealt(df: DataFrame, span: tuple[Column, Column], first: str) -> DataFrame:
        a, b = (F.floor(x / width).cast("long") for x in span)
        return df.withColumn(first, a).withColumn("_bucket", F.explode(F.sequence(a, F.greatest(a, b))))

    pairs = dealt(left, left_span, "_fl").join(dealt(right, right_span, "_fr"), [key, "_bucket"])
    return pairs.where((F.col("_bucket") == F.greatest("_fl", "_fr")) & on).drop("_bucket", "_fl", "_fr")


def interval_context(moments: DataFrame, segments: DataFrame, before: float = 8, after: float = 4, cut: int = 300, width: float = 20) -> DataFrame:
    """(id, context): for moments without text, the speech from `before` s ahead of the start to `after` s past it."""
    bare = moments.where(F.length(F.trim("text")) == 0).select("id", "source", "start_s", "end_s")
    spoken = segments.select("source", "seg_no", F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col("text").alias("said"))
    near = (F.col("e") >= F.col("start_s") - before) & (F.col("s") <= F.col("start_s") + after)
    found = bucketed_join(bare, spoken, "source", near, (F.col("start_s") - before, F.col("start_s") + after), (F.col("s"), F.col("e")), width)
    text = found.groupBy("id").agg(joined(["s", "seg_no"], "said", " ").alias("context"))
    return bare.select("id").join(text, "id", "left").select("id", F.substring(F.coalesce("context", F.lit("")), 1, cut).alias("context"))


def overlap_anti_join(moments: DataFrame, posted: DataFrame, width: float = 20) -> DataFrame:
    """Moments that overlap no posted interval of their source (half-open)."""
    p = posted.select("source", F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    hit = bucketed_join(moments.select("id", "source", "start_s", "end_s"), p, "source", (F.col("start_s") < F.col("e")) & (F.col("s") < F.col("end_s")), (F.col("start_s"), F.col("end_s")), (F.col("s"), F.col("e")), width)
    return moments.join(hit.select("id").distinct(), "id", "left_anti")


def _best_of_ranges(ranges: DataFrame, frames: DataFrame, base: int = 64, levels: int = 4) -> DataFrame:
    """(id, best): for ranges (id, source, lo, hi), lo <= hi - 1, the struct (-rms, sec) that is least over the frames with lo <= sec < hi.

    Maxima of blocks of base, base^2, ... seconds are made once. A range is cut into whole blocks of each size and what
    is left at both ends, under 2 * base of a size but the largest, so it meets few rows however long it is.
    """
    block = lambda level: F.struct(F.lit(level).alias("level"), F.floor(F.col("sec") / base**level).cast("long").alias("block"))
    dealt = frames.select("source", F.explode(F.array(*map(block, range(levels)))).alias("p"), F.struct((-F.col("rms")).alias("neg"), F.col("sec").alias("sec")).alias("best"))
    table = dealt.select("source", "p.level", "p.block", "best").groupBy("source", "level", "block").agg(F.min("best").alias("best"))
    parts = []
    rows = ranges.select("id", "source", F.col("lo").cast("long").alias("a"), F.col("hi").cast("long").alias("b"))
    run = lambda a, b: F.when(a < b, F.sequence(a, F.greatest(a, b - 1))).otherwise(F.array().cast("array<bigint>"))
    of_level = lambda level: lambda x: F.struct(F.lit(level).alias("level"), x.alias("block"))
    a, b = F.col("a"), F.col("b")
    for level in range(levels):
        up, down = F.ceil(a / base).cast("long"), F.floor(b / base).cast("long")
        whole = run(a, b) if level == levels - 1 else F.when(up < down, F.concat(run(a, up * base), run(down * base, b))).otherwise(run(a, b))
        parts.append(F.transform(whole, of_level(level)))
        a, b = F.when(up < down, up).otherwise(F.lit(0).cast("long")), F.when(up < down, down).otherwise(F.lit(0).cast("long"))
    cut = rows.select("id", "source", F.explode(F.concat(*parts)).alias("p")).select("id", "source", "p.level", "p.block")
    return cut.join(table, ["source", "level", "block"]).groupBy("id").agg(F.min("best").alias("best"))


def energy_peak(segments: DataFrame, energy: DataFrame, scores: DataFrame | None = None, radius: float = 1.0, least: float = 0.2) -> DataFrame:
    """(source, seg_no, peak): the loudest second within each segment, the first of equals; null without energy.

    scores: (source, at, score), if given, adds `opening`: the time of the best score within `radius` seconds of the
    peak and inside the segment, the first of equals; the peak itself if nothing is scored there or that span is shorter
    than `least`.
    """
    last = energy.groupBy("source").agg(F.max("sec").alias("last"))
    spans = segments.select("source", "seg_no", F.floor("start_s").alias("lo"), F.ceil("end_s").alias("hi")).join(last, "source").where("last is not null")
    spans = spans.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.least("lo", "last"))).withColumn("hi", F.greatest(F.col("lo") + 1, F.least("hi", F.col("last") + 1)))
    ranges = spans.select(F.struct("source", "seg_no").alias("id"), "source", "lo", "hi")
    found = _best_of_ranges(ranges, energy.select("source", "sec", "rms")).select("id.source", "id.seg_no", F.col("best.sec").alias("peak"))
    out = segments.select("source", "seg_no", "start_s", "end_s").join(found, ["source", "seg_no"], "left")
    if scores is None:
        return out.select("source", "seg_no", "peak")
    near = out.select("source", "seg_no", F.greatest("start_s", F.col("peak") - radius).alias("lo"), F.least("end_s", F.col("peak") + radius).alias("hi")).where("peak is not null").where(F.col("hi") - F.col("lo") >= least)
    near = near.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / radius).cast("long"), F.floor(F.col("hi") / radius).cast("long"))))
    frames = scores.where("score is not null").select("source", "at", "score", F.floor(F.col("at") / radius).cast("long").alias("cell"))
    best = near.join(frames, ["source", "cell"]).where("at between lo and hi").groupBy("source", "seg_no").agg(F.min(F.struct((-F.col("score")).alias("neg"), F.col("at").alias("at"))).alias("best"))
    told = out.join(best, ["source", "seg_no"], "left")
    return told.select("source", "seg_no", "peak", F.round(F.coalesce(F.col("best.at").cast("double"), F.col("peak").cast("double")), 2).alias("opening"))


def nonspeech_beats(clips: DataFrame, moments: DataFrame, segments: DataFrame, reach: float = 22, guard: float = 0.4, top: int = 3, width: float = 40) -> DataFrame:
    """(clip_id, id, beat_start): per clip the strongest spikes near its peak that no speech covers, by start."""
    spikes = moments.where("type = 'audio_spike'").select("id", "source", F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col("peak").alias("spike_peak"), "intensity")
    said = segments.where(F.length(F.trim("text")) > 0).select("source", F.col("start_s").alias("ss"), F.col("end_s").alias("se"))
    covered = bucketed_join(spikes, said, "source", (F.col("ss") < F.col("e") + guard) & (F.col("se") > F.col("s") - guard), (F.col("s") - guard, F.col("e") + guard), (F.col("ss"), F.col("se")), width)
    quiet = spikes.join(covered.select("id").distinct(), "id", "left_anti")
    c = clips.select("clip_id", "source", "peak")
    near = bucketed_join(c, quiet, "source", F.abs(F.col("spike_peak") - F.col("peak")) <= reach, (F.col("peak") - reach, F.col("peak") + reach), (F.col("spike_peak"), F.col("spike_peak")), width)
    best = near.withColumn("rn", F.row_number().over(over("clip_id", by=[F.desc("intensity"), "s", "id"]))).where(F.col("rn") <= top)
    return best.select("clip_id", "id", F.col("s").alias("beat_start"))


def snap_to_boundary(clips: DataFrame, segments: DataFrame, near: float = 0.35, reach: float = 4, cmax: float = 30, keep: float = 0.6, width: float = 20) -> DataFrame:
    """(clip_id, new_end): the clip's end moved to a speech boundary, or left."""
    c = clips.select("clip_id", "source", "start_s", "end_s")
    b = segments.select("source", F.col("end_s").alias("e"), F.rtrim("text").rlike(r"[.!?]$").alias("final"))
    ceiling = F.least(F.col("end_s") + reach, F.col("start_s") + cmax + reach)
    found = bucketed_join(c, b, "source", F.lit(True), (F.col("start_s"), F.col("end_s") + reach), (F.col("e"), F.col("e")), width)
    later = (F.col("e") > F.col("end_s")) & (F.col("e") < ceiling)
    picks = found.groupBy("clip_id").agg(
        F.max(F.abs(F.col("e") - F.col("end_s")) <= near).alias("there"),
        F.min(F.when(later & F.col("final"), F.col("e"))).alias("sentence"),
        F.min(F.when(later, F.col("e"))).alias("any"),
        F.max(F.when((F.col("e") < F.col("end_s")) & (F.col("e") - F.col("start_s") >= keep * (F.col("end_s") - F.col("start_s"))), F.col("e"))).alias("before"),
    )
    return c.join(picks, "clip_id", "left").select("clip_id", F.when(F.coalesce("there", F.lit(False)), F.col("end_s")).otherwise(F.coalesce("sentence", "any", "before", "end_s")).alias("new_end"))


def min_content_gate(played: DataFrame, teaser: int = 0, least: float = 15) -> DataFrame:
    """(clip_id, content, kept): played seconds without the teaser, and whether they suffice."""
    content = played.groupBy("clip_id").agg(F.round(F.sum(F.when(F.col("k") != teaser, F.col("b") - F.col("a")).otherwise(0.0)), 3).alias("content"))
    return content.withColumn("kept", F.col("content") >= least)


def cap_cumulative(played: DataFrame, cap: float = 12) -> DataFrame:
    """(clip_id, k, a, b): segments in order until their sum is cap; the crossing one is cut; the first stays."""
    spent = F.coalesce(F.sum(F.col("b") - F.col("a")).over(earlier("clip_id", by=["k"])), F.lit(0.0))
    return played.withColumn("spent", spent).where((F.col("spent") < cap) | (F.col("k") == 0)).select("clip_id", "k", "a", F.least(F.col("b"), F.col("a") + cap - F.col("spent")).alias("b"))


def payoff_gap(played: DataFrame, clips: DataFrame, teaser: int = 0) -> DataFrame:
    """(clip_id, gap): output seconds from the teaser's end to where the peak is played in the body; null if cut."""
    rows = played.withColumn("out", F.coalesce(F.sum(F.col("b") - F.col("a")).over(earlier("clip_id", by=["k"])), F.lit(0.0)))
    rows = rows.join(clips.select("clip_id", (F.col("peak") - F.col("start_s")).alias("at")), "clip_id")
    inside = F.when((F.col("k") != teaser) & (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b")), F.col("out") + F.col("at") - F.col("a"))
    return rows.groupBy("clip_id").agg(F.round(F.min(inside) - F.max(F.when(F.col("k") == teaser, F.col("out") + F.col("b") - F.col("a"))), 3).alias("gap"))


def clip_bounds(moments: DataFrame, lead: float = 4, tail: float = 4, cmin: float = 12, cmax: float = 30, duration: float = 90) -> DataFrame:
    """(id, clip_start, clip_end): a moment with lead-in and tail, held between cmin and cmax around its peak."""
    s, e = F.col("start_s") - lead, F.col("end_s") + tail
    mid = F.coalesce("peak", (F.col("start_s") + F.col("end_s")) / 2)
    long, short = e - s > cmax, e - s < cmin
    pad = (F.lit(cmin) - (e - s)) / 2
    a = F.when(long, mid - cmax / 2).when(short, s - pad).otherwise(s)
    b = F.when(long, mid + cmax / 2).when(short, e + pad).otherwise(e)
    left = F.greatest(F.lit(0.0), F.least(a, F.lit(float(duration))))
    return moments.select("id", F.round(left, 2).alias("clip_start"), F.round(F.greatest(left + 1, F.least(b, F.lit(float(duration)))), 2).alias("clip_end"))


def merge_islands(moments: DataFrame, gap: float = 7) -> DataFrame:
    """(source, island, start_s, end_s, n): unions of moments of one source whose gap is at most `gap`."""
    by = ["start_s", "end_s", "id"]
    reach = F.max("end_s").over(earlier("source", by=by))
    rows = moments.withColumn("new", F.when(reach.isNull() | (F.col("start_s") - reach > gap), 1).otherwise(0)).withColumn("island", F.sum("new").over(running("source", by=by)))
    return rows.groupBy("source", F.col("island").cast("long").alias("island")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"))


def keep_intervals(quiet: DataFrame, clips: DataFrame, least: float = 0.1) -> DataFrame:
    """(clip_id, a, b): the parts of each clip outside its silences, longer than `least`; the whole clip if none."""
    c = clips.select("clip_id", "source", "start_s", (F.col("end_s") - F.col("start_s")).alias("len"))
    q = quiet.select("source", F.col("start_s").alias("qs"), F.col("end_s").alias("qe"))
    inside = bucketed_join(c, q, "source", (F.col("qs") < F.col("start_s") + F.col("len")) & (F.col("qe") > F.col("start_s")), (F.col("start_s"), F.col("start_s") + F.col("len")), (F.col("qs"), F.col("qe")), 30)
    cuts = inside.select("clip_id", "len", F.greatest(F.lit(0.0), F.col("qs") - F.col("start_s")).alias("s"), F.least("len", F.col("qe") - F.col("start_s")).alias("e"))
    rows = cuts.unionByName(c.select("clip_id", "len", F.col("len").alias("s"), F.col("len").alias("e")))
    gaps = rows.withColumn("a", F.coalesce(F.max("e").over(earlier("clip_id", by=["s", "e"])), F.lit(0.0))).where(F.col("s") - F.col("a") > least).select("clip_id", "a", F.col("s").alias("b"))
    whole = c.join(gaps.select("clip_id").distinct(), "clip_id", "left_anti").select("clip_id", F.lit(0.0).alias("a"), F.col("len").alias("b"))
    return gaps.unionByName(whole).select("clip_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))
