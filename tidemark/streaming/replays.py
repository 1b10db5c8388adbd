"""Structured Streaming twins of the incremental operators, replayed over the events table with availableNow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.functions.storage import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream, event time in `ts`."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def replay(stream: DataFrame, spark: SparkSession, keep: DataFrame | None = None) -> DataFrame:
    """Run a stream to the end of its input into a table and read the table."""
    folder = _folder(spark)
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def energy_tumbling(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(source, start, n, rms) of tumbling windows that the watermark has closed."""
    rows = stream.withWatermark("ts", late).groupBy(F.col("user_id").alias("source"), F.window("ts", window).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 2).alias("rms")).select("source", F.unix_seconds("w.start").alias("start"), "n", "rms")


def session_merge(stream: DataFrame, gap: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """(source, start, finish, n) of sessions that the watermark has closed."""
    rows = stream.withWatermark("ts", late).groupBy(F.col("user_id").alias("source"), F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count("*").alias("n")).select("source", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("finish"), "n")


def st_energy_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(energy_tumbling(events_stream(spark, sf_dir)), spark)


def st_session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(session_merge(events_stream(spark, sf_dir)), spark)


def st_spike_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above mean + 2 deviations of their user, against a baseline table of an earlier batch."""
    base = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sigma"))
    stream = events_stream(spark, sf_dir).join(base, "user_id").where(F.col("value") > F.col("mean") + 2 * F.col("sigma"))
    return replay(stream.select("event_id", "user_id", F.round("value", 4).alias("value")), spark)


def daily_quota(stream: DataFrame, quota: int = 3, late: str = "2 days", parts: int = 64) -> DataFrame:
    """(event_id, user_id, day): the first events of each user and day that arrive, `quota` at most.

    A day's users are dealt into `parts` by hash, and a part is worked on at once. State of a day's part: how many of
    each of its users were let in, dropped by a timer once the watermark (`late` behind the newest event) has passed the
    day. Events without a user or a time are parts or days of their own; the state of those without a time stays.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = None
        for batch in batches:  # what is held: a quota of each user
            rows = (batch if rows is None else pd.concat([rows, batch])).sort_values(["user_id", "ts", "event_id"])
            rows = rows[rows.groupby("user_id").cumcount() + rows.user_id.map(lambda u: taken.get(u, 0)) < quota]
        for user, n in rows.user_id.value_counts().items():
            taken[user] = taken.get(user, 0) + n
        state.update(([int(u) for u in taken], [int(n) for n in taken.values()]))
        if key[0] is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(key[0], tz="UTC").timestamp() + 86_400) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows.event_id, "user_id": rows.user_id if key[1] is not None else None, "day": rows.day})

    part = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(parts)))
    rows = stream.withWatermark("ts", late).select("event_id", F.coalesce("user_id", F.lit(0)).alias("user_id"), "ts", F.to_date("ts").cast("string").alias("day"), part.alias("part"))
    return rows.groupBy("day", "part").applyInPandasWithState(admit, "event_id long, user_id long, day string", "users array<long>, taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def deadband(stream: DataFrame, safe: float = 20, easing: float = 0.06, most: float = 8, low: float = 0, high: float = 1000, idle: str = "30 days", late: str = "2 days") -> DataFrame:
    """(event_id, position): folds.deadband_follow over events as they arrive.

    State: a user's position, dropped by a timer once the watermark (`late` behind the newest event) is `idle` past the
    user's last event; the next event starts anew.
    """
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, last = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for value in rows.value:
            away = 0.0 if at is None else value - at
            at = value if at is None else at
            if abs(away) > safe:
                at = min(high, max(low, at + min(most, max(-most, away * easing))))
            out.append(at)
        last = max(last, int(rows.ts.iloc[-1].timestamp() * 1000))
        state.update((float(at), last))
        state.setTimeoutTimestamp(max(last + rest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows.event_id, "position": out})

    rows = stream.withWatermark("ts", late).where("value is not null").select("user_id", "event_id", "ts", "value")
    return rows.groupBy("user_id").applyInPandasWithState(follow, "event_id long, position double", "at double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_posted(stream: DataFrame, posted: DataFrame, late: str = "2 hours") -> DataFrame:
    """(event_id, user_id): events once each, though a chunk may be sent again within `late`, without those already posted."""
    fresh = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")
    return fresh.join(posted.select("event_id"), "event_id", "left_anti")


def resumed(stream: DataFrame, spark: SparkSession, runs: int = 2) -> DataFrame:
    """The stream's rows through a sink that replaces a batch's folder, run again from its checkpoint: no row comes twice."""
    folder = _folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for _ in range(runs):
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def st_daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(daily_quota(events_stream(spark, sf_dir)), spark)


def st_deadband_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(deadband(events_stream(spark, sf_dir)), spark).select("event_id", F.round("position", 4).alias("position"))


def st_dedup_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = events_stream(spark, sf_dir).union(events_stream(spark, sf_dir))
    return replay(dedup_posted(again, spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 7 = 0")), spark)


def st_resume_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumed(events_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), spark).select("event_id", "user_id", "event_type")


QUERIES = {f.__name__: f for f in (st_energy_tumbling, st_session_merge, st_spike_alerts, st_daily_quota, st_deadband_follow, st_dedup_posted, st_resume_sink)}
_LAST = "(SELECT max(ts) FROM events)"
ORACLES = {
    "st_energy_tumbling": f"""SELECT user_id AS source, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n, round(sqrt(avg(value * value)), 2) AS rms FROM events
GROUP BY user_id, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_LAST} - INTERVAL 2 HOUR""",
    "st_session_merge": f"""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id AS source, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 6 HOUR)) AS BIGINT) AS finish, count(*) AS n FROM b GROUP BY user_id, s
HAVING max(ts) + INTERVAL 6 HOUR <= {_LAST} - INTERVAL 6 HOUR""",
    "st_daily_quota": "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) t WHERE rn <= 3",
    "st_deadband_follow": """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL),
r AS (SELECT user_id, rn::BIGINT AS rn, event_id, value AS c FROM o WHERE rn = 1
UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN abs(o.value - c) > 20 THEN least(1000.0::DOUBLE, greatest(0.0::DOUBLE, c + least(8.0::DOUBLE, greatest(-8.0::DOUBLE, (o.value - c) * 0.06::DOUBLE)))) ELSE c END FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
SELECT event_id, round(c, 4) AS position FROM r""",
    "st_dedup_posted": "SELECT event_id, user_id FROM events WHERE event_id % 7 <> 0",
    "st_resume_sink": "SELECT event_id, user_id, event_type FROM events",
    "st_spike_alerts": "SELECT e.event_id, e.user_id, round(e.value, 4) AS value FROM events e JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) b ON b.user_id = e.user_id WHERE e.value > b.m + 2 * b.s",
}
