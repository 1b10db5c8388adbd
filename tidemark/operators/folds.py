"""Ordered folds by key, for choices in which each step depends on the ones before.

Where a source can be cut into parts that don't touch each other, the fold's key is the part, not the source, so a hot
source is spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from tidemark.functions.ordered import earlier, joined, over, running
from tidemark.operators.captions import leading, opening


def fold_by_key(rows: DataFrame, keys: list[str], order: list[str], out: str, kind: str | DataType, start: Callable, step: Callable) -> DataFrame:
    """rows with a column `out`: what step(state, row) gives beside the next state, row by row of a key in order.

    Rows stream through in the order that Spark sorts them (on disk where need be), and only the state is held, so a
    key may have any number of rows.
    """
    schema = StructType(list(rows.schema.fields)).add(out, kind)
    made, names, at = to_arrow_type(schema[out].dataType), rows.columns, [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = namedtuple("row_of", names, rename=True)
        now, state = None, None
        for batch in batches:
            got = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(values[i] for i in at)
                if now is None or key != now:
                    now, state = key, start()
                state, value = step(state, row_of._make(values))
                got.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, made)], [*names, out])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _parts(rows: DataFrame, by: list[str], apart: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with `part`: numbers runs of a source that start where apart(start, furthest end so far) holds."""
    reach = F.max("end_s").over(earlier("source", by=by))
    marked = rows.withColumn("_new", F.when(reach.isNull() | apart(F.col("start_s"), reach), 1).otherwise(0))
    return marked.withColumn("part", F.sum("_new").over(running("source", by=by)).cast("long")).drop("_new")


def merge_gap_capped(moments: DataFrame, gap: float = 7, cap: float = 60, cut: int = 400) -> DataFrame:
    """(source, start_s, end_s, type, n, text): moments merged in order while the gap is small and the span stays below cap.

    Type is the loudest member's, the first of equals. Only parts longer than the cap are folded.
    """
    by = ["start_s", "end_s", "id"]
    rows = _parts(moments.select("id", "source", "start_s", "end_s", "type", "intensity", "text"), by, lambda s, reach: s - reach > gap)
    span = over("source", "part")
    rows = rows.withColumn("long", F.max("end_s").over(span) - F.min("start_s").over(span) > cap)

    def step(state, row):
        number, a, b = state
        if number < 0 or row.start_s - b > gap or max(b, row.end_s) - a > cap:
            return (number + 1, row.start_s, row.end_s), number + 1
        return (number, a, max(b, row.end_s)), number

    folded = fold_by_key(rows.where("long"), ["source", "part"], by, "member_of", "long", lambda: (-1, 0.0, 0.0), step)
    whole = rows.where("not long").withColumn("member_of", F.lit(0).cast("long"))
    both = folded.unionByName(whole).withColumn("said", F.when(F.col("text") != "", F.col("text")))
    both = both.withColumn("place", F.row_number().over(over("source", "part", "member_of", by=by)))
    merged = both.groupBy("source", "part", "member_of").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max_by("type", F.struct("intensity", -F.col("place"))).alias("type"),
        F.count("*").alias("n"), F.substring(joined(["place"], "said", " "), 1, cut).alias("text"),
    )
    return merged.drop("part", "member_of")


def window_overlap_suppress(clips: DataFrame) -> DataFrame:
    """(clip_id, source): best first, clips whose window overlaps no kept one of their source (half-open)."""
    rows = _parts(clips.select("clip_id", "source", "start_s", "end_s", "score"), ["start_s", "end_s", "clip_id"], lambda s, reach: s >= reach)

    def step(kept, row):
        starts, ends = kept  # of kept windows, which don't overlap, so both are sorted
        i = bisect_left(starts, row.end_s)
        free = i == 0 or ends[i - 1] <= row.start_s
        if free:
            starts.insert(i, row.start_s)
            ends.insert(i, row.end_s)
        return kept, free

    ranked = rows.withColumn("low", -F.col("score"))
    return fold_by_key(ranked, ["source", "part"], ["low", "clip_id"], "kept", "boolean", lambda: ([], []), step).where("kept").select("clip_id", "source")


def deadband_follow(frames: DataFrame, safe: float = 20, easing: float = 0.06, most: float = 8, low: float = 0, high: float = 1000) -> DataFrame:
    """(event_id, position): a follower that moves only when the value leaves its dead zone, by an eased, bounded step.

    frames: (user_id, ts, event_id, value). Each step needs the one before, so a user's frames stream through one task.
    """

    def step(at, row):
        if at is None:
            return row.value, row.value
        away = row.value - at
        if abs(away) > safe:
            at = min(high, max(low, at + min(most, max(-most, away * easing))))
        return at, at

    rows = frames.where("value is not null").select("user_id", "ts", "event_id", "value")
    return fold_by_key(rows, ["user_id"], ["ts", "event_id"], "position", "double", lambda: None, step).select("event_id", F.round("position", 4).alias("position"))


def structure_quota(candidates: DataFrame, score: Column, floor: int = 3, share: int = 5) -> DataFrame:
    """(batch, clip_id, pos, opening): in order of clips each clip's best line whose two-word opening is below its quota, else the least used.

    candidates: (batch, clip_id, pos, text); score: of a line, the greater the better, the first of equals. A batch's
    quota is the larger of floor and a `share`-th of its clips, rounded up. So fewer than `share` openings can be used up
    before the last clip chooses, and a clip's first `share` openings are all that it may need.
    """
    rows = candidates.where("batch is not null").select("batch", "clip_id", "pos", opening(F.col("text")).alias("opening"), (-score).alias("low"))
    clips = leading(rows, ["batch", "clip_id"], share).groupBy("batch", "clip_id").agg(F.array_sort(F.collect_list(F.struct("low", "pos", "opening"))).alias("lines"))
    lines = clips.select("batch", "clip_id", F.count("*").over(over("batch")).alias("n"), F.col("lines")["opening"].alias("openings"), F.col("lines")["pos"].alias("places"))

    def step(used, row):
        quota = max(floor, -(-row.n // share))
        k = next((k for k, o in enumerate(row.openings) if used.get(o, 0) < quota), None)
        if k is None:
            k = min(range(len(row.openings)), key=lambda i: (used.get(row.openings[i], 0), i))
        used[row.openings[k]] = used.get(row.openings[k], 0) + 1
        return used, k

    chosen = fold_by_key(lines, ["batch"], ["clip_id"], "k", "integer", dict, step)
    return chosen.select("batch", "clip_id", F.get("places", "k").alias("pos"), F.get("openings", "k").alias("opening"))
