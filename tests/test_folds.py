"""Folds, selections and plug points against plain Python, on small random and odd inputs."""

import bisect
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import plugs
from tidemark.operators import campaigns, captions, folds, ranking
from tidemark.streaming import replays

MOMENTS = "id string, source int, start_s double, end_s double, type string, intensity double, text string"


def moments(rng, n):
    rows = []
    for i in range(n):
        a = float(rng.randrange(400))
        rows.append((f"m{i:03}", rng.randrange(3), a, a + rng.randrange(1, 40), rng.choice(["speech", "audio_spike"]), float(rng.randrange(20)), rng.choice(["", "some words", "more"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_gap_capped(spark, seed):
    rows = moments(random.Random(seed), 60)
    want, now = [], {}
    for i, k, a, b, kind, loud, said in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        c = now.get(k)
        if c and a - c["b"] <= 7 and max(c["b"], b) - c["a"] <= 60:
            c["b"], c["n"] = max(c["b"], b), c["n"] + 1
            c["said"] += [said] if said else []
            if loud > c["loud"]:
                c["loud"], c["kind"] = loud, kind
        else:
            now[k] = {"k": k, "a": a, "b": b, "n": 1, "kind": kind, "loud": loud, "said": [said] if said else []}
            want.append(now[k])
    got = folds.merge_gap_capped(spark.createDataFrame(rows, MOMENTS)).collect()
    assert sorted((r.source, r.start_s, r.end_s, r.type, r.n, r.text) for r in got) == sorted((c["k"], c["a"], c["b"], c["kind"], c["n"], " ".join(c["said"])[:400]) for c in want)


@pytest.mark.parametrize("seed", [4, 5])
def test_window_overlap_suppress(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(2), a := float(rng.randrange(200)), a + rng.randrange(0, 30), float(rng.randrange(5))) for i in range(90)]
    kept = []
    for i, k, a, b, _ in sorted(rows, key=lambda r: (-r[4], r[0])):
        if all(k != q or b <= s or e <= a for _, q, s, e in kept):
            kept.append((i, k, a, b))
    df = spark.createDataFrame(rows, "clip_id long, source int, start_s double, end_s double, score double")
    assert sorted(r.clip_id for r in folds.window_overlap_suppress(df).collect()) == sorted(x[0] for x in kept)


def test_structure_quota(spark):
    rng = random.Random(6)
    rows = [(i % 2, i, p, f"{rng.choice('ab')} {rng.choice('cd')} tail {p}", rng.randrange(4)) for i in range(24) for p in range(3)]
    frame = spark.createDataFrame(rows, "batch long, clip_id long, pos long, text string, points long")
    got = {r.clip_id: (r.pos, r.opening) for r in folds.structure_quota(frame, F.col("points")).collect()}
    for batch in (0, 1):
        used = {}
        for clip in sorted({r[1] for r in rows if r[0] == batch}):
            lines = [(p, " ".join(t.split(" ")[:2])) for _, c, p, t, _ in sorted(rows, key=lambda r: (-r[4], r[2])) if c == clip]
            free = [x for x in lines if used.get(x[1], 0) < 3]
            pick = free[0] if free else min(lines, key=lambda x: used.get(x[1], 0))
            used[pick[1]] = used.get(pick[1], 0) + 1
            assert got[clip] == pick


@pytest.mark.parametrize("clips", [12, 70])
def test_structure_quota_reads_its_lines_once(spark, clips):
    rng = random.Random(clips)
    rows = [(1 + i % 2, i, p, f"{rng.choice('aab')} {rng.choice('cccdefg')} tail", rng.randrange(3)) for i in range(clips) for p in range(rng.randrange(1, 20))]
    rng.shuffle(rows)  # a clip's lines stand in many of the batches
    frame = spark.createDataFrame([*rows, (None, 999, 0, "a c", 1)], "batch long, clip_id long, pos long, text string, points long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        frame = folds.structure_quota(frame, F.col("points"))
        got = {r.clip_id: (r.pos, r.opening) for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for batch in (1, 2):
        used, own = {}, sorted({r[1] for r in rows if r[0] == batch})
        for clip in own:
            lines = [(p, t[:3]) for _, c, p, t, _ in sorted(rows, key=lambda r: (-r[4], r[2])) if c == clip]
            free = [x for x in lines if used.get(x[1], 0) < max(3, -(-len(own) // 5))]
            want[clip] = free[0] if free else min(lines, key=lambda x: used.get(x[1], 0))
            used[want[clip][1]] = used.get(want[clip][1], 0) + 1
    assert got == want
    physical = frame._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in physical and physical.count("Scan ExistingRDD") == 1


def test_leading_lines_of_a_clip(spark):
    rows = [(c, None if p == 7 else f"o{p % 4}", -(p % 3), p) for c in (1, None) for p in range(12)]
    frame = spark.createDataFrame(rows, "clip_id long, opening string, low long, pos long").coalesce(1)
    got = captions.leading(frame, ["clip_id"], 3).collect()
    for clip in (1, None):
        best = {}
        for _, o, low, p in sorted((r for r in rows if r[0] == clip), key=lambda r: r[2:]):
            best.setdefault(o, (low, p))
        assert sorted((r.low, r.pos, r.opening) for r in got if r.clip_id == clip) == sorted((*v, o) for o, v in best.items())[:3]
    assert captions.leading(frame.where("pos < 0"), ["clip_id"], 3).count() == 0


def test_folds_of_nothing(spark):
    assert folds.merge_gap_capped(spark.createDataFrame([], MOMENTS)).count() == 0
    assert folds.deadband_follow(spark.createDataFrame([(1, None, 1, None)], "user_id long, ts timestamp, event_id long, value double")).count() == 0


def test_common_prefix_twins_agree(spark):
    rows = [(1, "this is it"), (1, "This is not"), (2, "one"), (3, "a b"), (3, "c d"), (4, "same words"), (4, "same words")]
    df = spark.createDataFrame(rows, "clip_id long, text string")
    want = {1: "this is", 2: "one", 3: "", 4: "same words"}
    assert {r.clip_id: r.anchor for r in captions.common_prefix(df).collect()} == want
    assert {r.clip_id: r.anchor for r in plugs.common_prefix_twin(df).collect()} == want


def test_scorer_output_is_checked(spark):
    def wild(batch):
        return pd.DataFrame({"id": [*batch.id, "unknown"], "score": ["1.5"] * (len(batch) - 1) + ["none", "3"]})

    df = spark.createDataFrame(moments(random.Random(7), 5), MOMENTS).coalesce(1)
    got = plugs.batch_scores(df, wild).collect()
    assert len(got) == 4 and all(r.score == 1.5 and r.id != "unknown" for r in got)


def test_unknown_alias_fails_the_job(spark):
    board = spark.createDataFrame([(1, "odd thing")], "id long, category string")
    with pytest.raises(Exception, match="unknown tag: odd"):
        campaigns.alias_resolve(board, spark.createDataFrame([("promo", "p")], "alias string, tag string")).collect()


def test_frontier_stops_at_cycles_and_hops(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    got = campaigns.link_frontier(links, spark.createDataFrame([(1,)], "page_id long")).collect()
    assert {r.page_id: r.hop for r in got} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_quota_goes_on_in_the_next_batch(spark, tmp_path):
    from tidemark.streaming import replays

    rows = [(i, 1, f"2024-01-0{1 + i // 4} 00:00:0{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts")
    for k in range(4):
        df.where(f"event_id % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = replays.replay(replays.daily_quota(stream), spark).groupBy("day").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3]


def greedy(rows, apart):
    """(id, source, start, score): best first over all sources."""
    taken = {}
    for i, k, s, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        near = taken.setdefault(k, [])
        at = bisect.bisect_left(near, s)
        if not (at and s - near[at - 1] < apart or at < len(near) and near[at] - s < apart):
            near.insert(at, s)
            yield i


@pytest.mark.parametrize(("n", "span", "scores", "width"), [(3000, 20_000, 50, 4), (4000, 90_000, None, 8), (600, 60_000, "falling", 2), (2000, 900, 5, 4)])
def test_spread_of_one_source_in_stretches(spark, n, span, scores, width):
    rng = random.Random(n)
    starts = [rng.randrange(-span, span) / 4 for _ in range(n)]
    score = {s: -s for s in starts} if scores == "falling" else {s: float(rng.randrange(scores or 10**6)) for s in starts}  # falling: each choice rests on the one before
    rows = [(f"m{i:05}", 1, s, score[s]) for i, s in enumerate(starts)] + [("z1", 2, 5.0, 1.0), ("z2", None, 5.0, 1.0)]
    frame = spark.createDataFrame(rows, "id string, source int, start_s double, intensity double")
    got = [r.id for r in ranking.spread_topk(frame, 30, 10**6, width=width, halo=2).collect()]
    assert sorted(got) == sorted(greedy(rows, 30))


def test_a_fold_holds_no_group(spark):
    """A follower of many events of one user, whole and in the stream's order, beside users with few."""
    rng = random.Random(9)
    events = [(1, i, i, rng.uniform(0, 900)) for i in range(30_000)] + [(u, 0, 40_000 + u, 5.0) for u in range(2, 9)]
    frame = spark.createDataFrame(events, "user_id long, s long, event_id long, value double").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    at, want = None, {}
    for _, _, i, x in events[:30_000]:
        at = x if at is None else min(1000, max(0, at + min(8, max(-8, (x - at) * 0.06)))) if abs(x - at) > 20 else at
        want[i] = round(at, 4)
    got = {r.event_id: r.position for r in folds.deadband_follow(frame).collect()}
    assert len(got) == len(events) and all(abs(got[i] - p) < 2e-4 for i, p in want.items()) and got[40_003] == 5.0


def test_idle_positions_go(spark, tmp_path):
    """A user unseen for longer than `idle` starts anew; others go on from where they were."""
    schema = "user_id long, event_id long, ts timestamp, value double"
    put = lambda k, rows: spark.createDataFrame([(u, i, pd.Timestamp(t, tz="UTC").to_pydatetime(), v) for u, i, t, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: replays.deadband(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), idle="10 days", late="1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    put(0, [(1, 1, "2024-01-01", 100.0), (2, 2, "2024-01-01", 100.0)])
    run()
    put(1, [(2, 3, "2024-01-08", 500.0)])
    run()
    put(2, [(3, 4, "2024-01-14", 0.0)])
    run()
    put(3, [(1, 5, "2024-01-15", 500.0), (2, 6, "2024-01-15", 500.0)])
    run()
    got = {r.event_id: r.position for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 100.0, 2: 100.0, 3: 108.0, 4: 0.0, 5: 500.0, 6: 116.0}


def test_quota_of_many_users_is_kept_in_few_states(spark, tmp_path):
    rows = [(i, i % 500, f"2024-01-01 00:{i // 500:02d}:00") for i in range(2500)] + [(3000 + i, None, "2024-01-01 10:00:00") for i in range(4)] + [(4000 + i, 7, None) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = replays.daily_quota(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), parts=4)
    run = stream.writeStream.format("memory").queryName("quota_states").trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    got = sorted(r.event_id for r in spark.table("quota_states").collect())
    assert got == [*range(1500), 3000, 3001, 3002, 4000, 4001, 4002]
    assert max(p.stateOperators[0].numRowsTotal for p in run.recentProgress) <= 6  # four parts, one of no user, one of no time
