"""Ranking, budgets, quotas and greedy selection."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import earlier, over
from tidemark.functions.storage import stored
from tidemark.operators.folds import fold_by_key
from tidemark.operators.text import reason_tag


def budget_admit(sources: DataFrame, cap: float = 3600) -> DataFrame:
    """(campaign, ord, duration_sec): sources that start while the time before them is below cap."""
    spent = F.coalesce(F.sum("duration_sec").over(earlier("campaign", by=["ord"])), F.lit(0.0))
    return sources.withColumn("spent", spent).where(F.col("spent") < cap).select("campaign", "ord", F.col("duration_sec").cast("double").alias("duration_sec"))


def batch_floor_walk(attempts: DataFrame, target: int = 10, depth: int = 5) -> DataFrame:
    """(walk, attempt, clips): attempts until their clips reach target, or depth attempts."""
    made = F.coalesce(F.sum("clips").over(earlier("walk", by=["attempt"])), F.lit(0))
    return attempts.withColumn("made", made).where((F.col("made") < target) & (F.col("attempt") <= depth)).select("walk", "attempt", "clips")


def daily_quota_admit(events: DataFrame, quota: int = 3) -> DataFrame:
    """(event_id, user_id, day): the first `quota` events of each user and day."""
    rows = events.select("event_id", "user_id", F.to_date("ts").alias("day"), "ts")
    return rows.withColumn("rn", F.row_number().over(over("user_id", "day", by=["ts", "event_id"]))).where(F.col("rn") <= quota).select("event_id", "user_id", F.col("day").cast("string").alias("day"))


def top_k_per_channel(events: DataFrame, k: int = 3) -> DataFrame:
    """(user_id, event_id, rank): the newest k of each channel."""
    rows = events.withColumn("rank", F.row_number().over(over("user_id", by=[F.desc("ts"), F.desc("event_id")])).cast("long"))
    return rows.where(F.col("rank") <= k).select("user_id", "event_id", "rank")


def rank_and_name(moments: DataFrame, tag: str = "clip") -> DataFrame:
    """(id, rank, name): best first within a source, with a file name of rank, score and slug."""
    rows = moments.withColumn("rank", F.row_number().over(over("source", by=[F.desc("intensity"), "id"])).cast("long"))
    slug = F.trim(F.regexp_replace(F.lower(F.substring("text", 1, 40)), "[^a-z0-9]+", "-"), F.lit("-"))
    return rows.select("id", "rank", F.concat_ws("_", F.lit(tag), F.lpad(F.col("rank").cast("string"), 2, "0"), F.lpad(F.round("intensity").cast("long").cast("string"), 3, "0"), slug).alias("name"))


def content_score(markers: list[str]) -> Column:
    """Words, words a second, markers and questions, and loudness as a weak tie-break."""
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0)))
    length = F.col("end_s") - F.col("start_s")
    hits = F.lit(0)
    for m in markers:
        hits = hits + F.regexp_count(F.lower("text"), F.lit(rf"\b({m})\b"))
    hits = hits + F.regexp_count("text", F.lit(r"\?"))
    return 3 * F.least(words, F.lit(80)) / 80 + 2 * F.least(words / F.greatest(F.lit(1.0), length), F.lit(4.0)) / 4 + F.least(hits, F.lit(8)) + F.least(F.col("intensity"), F.lit(12.0)) / 12


def content_rank_topn(moments: DataFrame, markers: list[str], n: int = 400) -> DataFrame:
    """(id, score): the n best moments by content."""
    return moments.select("id", F.round(content_score(markers), 4).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def spread_topk(moments: DataFrame, apart: float = 60, n: int = 50, width: int = 32, halo: int = 4) -> DataFrame:
    """(id, source, start_s, score): best first, none within `apart` seconds of a taken start of its source; n at most.

    The greedy choice of a source doesn't depend on other sources, so the n best of what each source takes are taken at
    the end. A source is cut into stretches of `width` times `apart` seconds, each with `halo` times `apart` more of its
    neighbours' rows on both sides. In a stretch, best first, a row near a taken one is dropped, one near an undecided
    better one or near what the stretch doesn't see stays undecided, and others are taken: so what is decided is what
    the greedy choice of the whole source decides. What stays open goes on to a round of stretches four times as long,
    cut at other places. Rows stream through in order of rank; taken and open starts are sorted lists.
    """
    scored = moments.where("start_s is not null").select("id", "source", F.col("start_s").cast("double").alias("start_s"), F.round("intensity", 4).alias("score"))
    state = _spread_round(scored.withColumn("taken", F.lit(False)), apart, width * apart, 0.0, halo * apart)
    for k in range(1, 64):
        state = stored(state, f"spread{k}")
        if state.where("not taken").isEmpty():
            break
        long = width * 4**k * apart
        state = _spread_round(state, apart, long, long / 3, halo * apart)
    return state.drop("taken").orderBy(F.desc("score"), "id").limit(n)


def _spread_round(rows: DataFrame, apart: float, long: float, shift: float, halo: float) -> DataFrame:
    """The taken rows and those still open; those dropped are left out."""
    at = F.floor((F.col("start_s") - shift) / long).cast("long")
    place = F.col("start_s") - shift - at * long
    near = F.array_compact(F.array(at, F.when(place < halo, at - 1), F.when(place >= long - halo, at + 1)))
    dealt = rows.select("*", at.alias("own"), F.explode(near).alias("stretch")).withColumn("low", -F.col("score"))

    def step(held, row):
        taken, open_, left, right = held
        if left is None:
            left, right = row.stretch * long + shift - halo, (row.stretch + 1) * long + shift + halo
        s, state = row.start_s, None
        if row.taken:
            state = "taken"
        elif _within(taken, s, apart):
            state = "dropped"
        elif s - apart < left or s + apart > right or _within(open_, s, apart):
            state = "open"
        else:
            state = "taken"
        if state != "dropped":
            insort(taken if state == "taken" else open_, s)
        return (taken, open_, left, right), state

    ordered = dealt.withColumn("last", ~F.col("taken"))  # what is taken stands first
    told = fold_by_key(ordered, ["source", "stretch"], ["last", "low", "id"], "state", "string", lambda: ([], [], None, None), step)
    own = told.where("own = stretch and state <> 'dropped'")
    return own.select("id", "source", "start_s", "score", (F.col("state") == "taken").alias("taken"))


def _within(starts: list[float], s: float, apart: float) -> bool:
    i = bisect_left(starts, s)
    return i > 0 and s - starts[i - 1] < apart or i < len(starts) and starts[i] - s < apart


def review_funnel(moments: DataFrame, alive: float = 1, best: float = 40, pool: float = 40, most: int = 10, apart: float = 60, clear: float = 60) -> DataFrame:
    """(id, source, start_s, score, n_cleared, n_filler): the spread choice of the alive moments of the pool; none if even the best is weak.

    n_cleared: how many of the pool score at least `clear`; n_filler: how many of it don't. moments: as for spread_topk,
    with `junk`.
    """
    rows = moments.where(~F.col("junk") & (F.col("intensity") >= max(alive, pool)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    tally = rows.agg(one(F.col("intensity") >= clear).alias("n_cleared"), one(F.col("intensity") < clear).alias("n_filler"))  # one row
    top = moments.agg(F.max("intensity").alias("top"))
    chosen = spread_topk(rows.crossJoin(F.broadcast(top)).where(F.col("top") >= best), apart, most)
    return chosen.crossJoin(F.broadcast(tally))


def score_batches(moments: DataFrame, size: int = 18, scored: DataFrame | None = None) -> DataFrame:
    """(source, batch, n, open, first_id): batches of a source's moments in rank order that hold ids not scored yet.

    scored: (id), what an earlier run scored. open: how many ids of the batch it left.
    """
    rows = moments.withColumn("batch", F.floor((F.row_number().over(over("source", by=[F.desc("intensity"), "id"])) - 1) / size).cast("long"))
    done = F.lit(None)
    if scored is not None:
        rows = rows.join(scored.select("id").distinct().withColumn("done", F.lit(True)), "id", "left")
        done = F.col("done")
    got = rows.groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum(F.when(done, 0).otherwise(1)).cast("long").alias("open"), F.min("id").alias("first_id"))
    return got.where("open > 0")


def priority_pick(resources: DataFrame, keyword: str = "9", wanted: str | None = None, reference: tuple[str, ...] = ()) -> DataFrame:
    """(campaign, path): one asset a campaign.

    The file of the wanted name, or else with it in its name, first in order; without one, of the files whose names hold
    none of the reference words, those with the keyword come first, then png, then by name.
    """
    name = F.lower("path")
    tier = F.when(name == wanted.lower(), 0).when(name.contains(wanted.lower()), 1).otherwise(2) if wanted else F.lit(2)
    guide = F.lit(False)
    for word in reference:
        guide = guide | name.contains(word)
    assets = resources.where(name.rlike(r"\.(png|pdf)$")).withColumn("tier", tier).where((F.col("tier") < 2) | ~guide)
    order = ["tier", F.when(F.col("tier") < 2, F.col("ord")), F.when(name.contains(keyword), 0).otherwise(1), F.when(name.endswith(".png"), 0).otherwise(1), name, "ord"]
    return assets.withColumn("rn", F.row_number().over(over("campaign", by=order))).where("rn = 1").select("campaign", "path")


def best_variant_pick(formats: DataFrame, cap: int = 1080) -> DataFrame:
    """(item, video, audio, required, reason): the best pair or single variant of each item under the height cap."""
    usable = F.col("height").isNotNull() & (F.col("height") <= cap)
    video = F.struct("height", "tbr", "size", "format_id")
    rows = formats.groupBy("item").agg(
        F.max(F.when(F.col("height").isNotNull(), 1).otherwise(0)).alias("with_video"),
        F.max(F.when(usable, 1).otherwise(0)).alias("under"),
        F.max(F.when(usable & ~F.col("has_audio"), video)).alias("v"),
        F.max(F.when(F.col("height").isNull() & F.col("has_audio"), F.struct("tbr", "size", "format_id"))).alias("a"),
        F.max(F.when(usable & F.col("has_audio"), video)).alias("c"),
    )
    pair = F.col("v").isNotNull() & F.col("a").isNotNull()
    reason = F.when(F.col("with_video") == 0, "no video").when(F.col("under") == 0, "none under the cap").when(~pair & F.col("c").isNull(), "no audio").otherwise("")
    return rows.select(
        "item", F.when(pair, F.col("v.format_id")).otherwise(F.col("c.format_id")).alias("video"), F.when(pair, F.col("a.format_id")).alias("audio"),
        F.round(F.when(pair, 2.2 * (F.col("v.size") + F.col("a.size"))).otherwise(1.5 * F.col("c.size")), 4).alias("required"), reason.alias("reason"),
    )


def primary_per_frame(boxes: DataFrame, preferred: str = "person") -> DataFrame:
    """(clip_id, frame, cx, cy, w, h): per frame the largest box of the preferred class, or one derived from the other's."""
    area = F.col("w") * F.col("h")
    best = boxes.withColumn("rn", F.row_number().over(over("clip_id", "frame", by=[F.when(F.col("class") == preferred, 0).otherwise(1), F.desc(area), "box_id"]))).where("rn = 1")
    own, side = F.col("class") == preferred, F.sqrt(area)
    return best.select("clip_id", "frame", F.round("cx", 4).alias("cx"), F.round(F.when(own, F.col("cy")).otherwise(F.col("cy") + 0.9 * side), 4).alias("cy"), F.round(F.when(own, F.col("w")).otherwise(2.2 * side), 4).alias("w"), F.round(F.when(own, F.col("h")).otherwise(3.2 * side), 4).alias("h"))


def subject_share_decision(detections: DataFrame, single: float = 0.5, multi: float = 0.3, none: float = 0.5, width: float = 1080, still: float = 0.02) -> DataFrame:
    """(clip_id, single, multi, none, verdict, centre, spread, static): whether a clip's subject can be followed, and whether it stands still: its centre's deviation is below `still` of the width."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    n = F.col("n_subjects")
    rows = detections.groupBy("clip_id").agg(share(n == 1).alias("single"), share(n > 1).alias("multi"), share(n == 0).alias("none"), F.round(F.expr("percentile(cx, 0.5)"), 4).alias("centre"), F.round(F.stddev_pop("cx"), 3).alias("spread"))
    verdict = F.when(F.col("none") > none, "no subject").when(F.col("multi") > multi, "several subjects").when(F.col("single") < single, "too few").otherwise("track")
    return rows.withColumn("verdict", verdict).withColumn("static", (F.col("verdict") == "track") & (F.col("spread") / width < still))


def run_tally(attempts: DataFrame) -> DataFrame:
    """(walk, tag, attempts, clips): how a walk's attempts ended: with clips, empty, or by the label of why they failed. attempts: (walk, clips, msg), msg of failed ones."""
    tag = F.when(F.col("msg").isNotNull(), reason_tag(F.col("msg"))).when(F.col("clips") > 0, "clips").otherwise("empty")
    return attempts.groupBy("walk", tag.alias("tag")).agg(F.count("*").alias("attempts"), F.sum("clips").cast("long").alias("clips"))
