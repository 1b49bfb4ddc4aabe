"""Session analytics over an event log: active time, sample series, latest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.records import accuracy, consistency, wpm

IDLE_S = 6 * 3600  # the sample events are hours apart; a keystroke log uses 5 seconds


def active_time(events: DataFrame, user: str = "user_id", ts: str = "ts", idle_s: int = IDLE_S) -> DataFrame:
    """Sum of the gaps between a user's activities, each clipped at the idle timeout."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(user).orderBy(ts))
    clipped = events.select(user, F.least(gap, F.lit(idle_s * 1_000_000)).alias("_gap"))
    return clipped.groupBy(user).agg(F.count("*").alias("activities"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("active_us"))


def newest(events: DataFrame, user: str = "user_id", ts: str = "ts", keep: int = 64, tie: str = "event_id") -> DataFrame:
    """The newest `keep` records of each user, newest first; equal times by the tie column."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie)))
    return events.select(user, ts, rank.alias("position")).filter(F.col("position") <= keep)


def sample_series(activity: DataFrame, session: str, at: str, key: str, step: int = 1000, idle: int = 5000) -> DataFrame:
    """session, second, keys: a row per full step from the first activity on while the clock runs, steps without keys too.

    activity: session, at (a whole number), key (does it count). A step is a sample if its end lies less than `idle`
    after the last activity before it; the step that the session ends in is none.
    """
    first = F.min(at).over(Window.partitionBy(session))
    bins = activity.select(session, F.col(at).alias("_at"), F.col(key).cast("int").alias("_key"), first.alias("_first"))
    bins = bins.groupBy(session, "_first", F.floor((F.col("_at") - F.col("_first")) / step).alias("second")).agg(F.sum("_key").alias("keys"), F.max("_at").alias("_last"))
    following = F.lead("second").over(Window.partitionBy(session).orderBy("second"))
    rows = bins.withColumn("_next", following).filter("_next is not null")
    # Steps without activity, up to the idle limit or the next activity.
    running = F.floor((F.col("_last") - F.col("_first") + idle - 1) / step) - 1
    upto = F.least(F.col("_next") - 1, F.greatest(F.col("second"), running))
    steps = rows.select(session, "second", "keys", F.explode(F.sequence(F.col("second"), upto)).alias("_s"))
    return steps.select(session, F.col("_s").alias("second"), F.when(F.col("_s") == F.col("second"), F.col("keys")).otherwise(0).cast("long").alias("keys"))


def snapshot(activity: DataFrame, session: str, at: str, key: str, right: str, step: int = 1000, idle: int = 5000) -> DataFrame:
    """session, wpm, raw_wpm, accuracy, consistency, chars, errors, elapsed: everything a finished session reports."""
    gap = F.least(F.col(at) - F.lag(at).over(Window.partitionBy(session).orderBy(at)), F.lit(idle))
    by = activity.select(session, gap.alias("_gap"), F.col(key).alias("_key"), F.col(right).alias("_right"))
    by = by.groupBy(session).agg(F.coalesce(F.sum("_gap"), F.lit(0)).cast("long").alias("elapsed"), F.count_if("_key").alias("chars"), F.count_if(F.col("_key") & F.col("_right")).alias("_ok"))
    even = sample_series(activity, session, at, key, step, idle).groupBy(session).agg(F.count("*").alias("_n"), F.avg("keys").alias("_mean"), F.stddev_pop("keys").alias("_dev"))
    rows = by.join(even, session, "left")
    minutes = F.col("elapsed") * (1000 / step)
    return rows.select(
        session, wpm(F.col("_ok"), minutes).alias("wpm"), wpm(F.col("chars"), minutes).alias("raw_wpm"), accuracy(F.col("_ok"), F.col("chars")).alias("accuracy"),
        consistency(F.coalesce("_n", F.lit(0)), F.col("_mean"), F.col("_dev")).alias("consistency"), "chars", (F.col("chars") - F.col("_ok")).alias("errors"), "elapsed",
    )


def route_totals(runs: DataFrame, route: str) -> DataFrame:
    """route, chars, errors, elapsed, accuracy, consistency weighted by time, peak of scored runs (chars, errors, elapsed, wpm, consistency)."""
    by = runs.filter("chars > 0").groupBy(route).agg(F.sum("chars").alias("chars"), F.sum("errors").alias("errors"), F.sum("elapsed").alias("elapsed"), F.sum(F.col("consistency") * F.col("elapsed")).alias("_c"), F.max("wpm").alias("peak"))
    right = F.greatest(F.lit(0), F.col("chars") - F.col("errors"))
    return by.select(route, "chars", "errors", "elapsed", accuracy(right, F.col("chars")).alias("accuracy"), F.when(F.col("elapsed") > 0, F.col("_c") / F.col("elapsed")).otherwise(0.0).alias("consistency"), "peak")


def w8_active_time(spark, sf_dir):
    return active_time(spark.read.parquet(f"{sf_dir}/events.parquet"))


def w10_newest_records(spark, sf_dir):
    return newest(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


# The sample events are hours apart, so a second is six hours here and the idle limit thirty.
STEP, IDLE = 6 * 3600, 30 * 3600


def _activity(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", seconds.alias("at"), (F.col("event_type") != "view").alias("key"), (F.col("event_type") != "error").alias("right"), F.to_date("ts").alias("day"), "value")


def sample_seconds(spark, sf_dir):
    return sample_series(_activity(spark, sf_dir), "user_id", "at", "key", STEP, IDLE)


def session_snapshot(spark, sf_dir):
    rows = snapshot(_activity(spark, sf_dir), "user_id", "at", "key", "right", STEP, IDLE)
    return rows.select("user_id", "chars", "errors", "elapsed", *[F.round(c, 6).alias(c) for c in ("wpm", "raw_wpm", "accuracy", "consistency")])


def route_summary(spark, sf_dir):
    """A user's days as runs."""
    days = _activity(spark, sf_dir).groupBy("user_id", "day").agg(F.count("*").alias("chars"), F.count_if(~F.col("right")).alias("errors"), (F.max("at") - F.min("at")).alias("elapsed"), F.max("value").alias("wpm"), (F.count("*") * 7 % 100).cast("double").alias("consistency"))
    rows = route_totals(days, "user_id")
    return rows.select("user_id", "chars", "errors", "elapsed", *[F.round(c, 6).alias(c) for c in ("accuracy", "consistency", "peak")])


QUERIES = {"w8_active_time": w8_active_time, "w10_newest_records": w10_newest_records, "sample_seconds": sample_seconds, "session_snapshot": session_snapshot, "route_summary": route_summary}

_SQL_ACTIVITY = "(select user_id, event_id, epoch_us(ts) // 1000000 as at_s, event_type <> 'view' as key, event_type <> 'error' as ok, cast(ts as date) as day, value from events)"
# Every step from the first activity to the last, with the last activity before its end.
_SQL_SAMPLES = f"""
    a as (select * from {_SQL_ACTIVITY}), f as (select user_id, min(at_s) as t0, (max(at_s) - min(at_s)) // {STEP} as n from a group by user_id),
    g as (select user_id, t0, unnest(generate_series(0, n - 1)) as second from f where n > 0),
    s as (select g.user_id, g.second, (select max(a.at_s) from a where a.user_id = g.user_id and a.at_s < t0 + (g.second + 1) * {STEP}) as last, t0,
        (select count(*) from a where a.user_id = g.user_id and a.key and a.at_s >= t0 + g.second * {STEP} and a.at_s < t0 + (g.second + 1) * {STEP}) as keys from g),
    m as (select user_id, cast(second as bigint) as second, cast(keys as bigint) as keys from s where t0 + (second + 1) * {STEP} - last < {IDLE})
"""

ORACLE_SQL = {
    "w8_active_time": f"""
        with g as (select user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events)
        select user_id, count(*) as activities, cast(coalesce(sum(least(gap, {IDLE_S * 1_000_000})), 0) as bigint) as active_us
        from g group by user_id
    """,
    "w10_newest_records": """
        with r as (select user_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events)
        select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, cast(position as int) as position from r where position <= 64
    """,
    "sample_seconds": f"with {_SQL_SAMPLES} select user_id, second, keys from m",
    "session_snapshot": f"""
        with {_SQL_SAMPLES}, g2 as (select user_id, key, ok, at_s - lag(at_s) over (partition by user_id order by at_s) as gap from a),
        b as (select user_id, cast(coalesce(sum(least(gap, {IDLE})), 0) as bigint) as elapsed, count(*) filter (where key) as chars, count(*) filter (where key and ok) as ok from g2 group by user_id),
        e as (select user_id, count(*) as n, avg(keys) as mean, stddev_pop(keys) as dev from m group by user_id)
        select b.user_id, chars, chars - ok as errors, elapsed, round(case when ok > 0 and elapsed > 0 then ok / 5.0 / (elapsed * {1000 / STEP} / 60000.0) else 0 end, 6) as wpm,
            round(case when chars > 0 and elapsed > 0 then chars / 5.0 / (elapsed * {1000 / STEP} / 60000.0) else 0 end, 6) as raw_wpm, round(case when chars > 0 then 100.0 * ok / chars else 100 end, 6) as accuracy,
            round(case when coalesce(n, 0) = 0 then 0 when n = 1 or mean = 0 then 100 else greatest(0, least(100, 100 * (1 - dev / mean))) end, 6) as consistency
        from b left join e on e.user_id = b.user_id
    """,
    "route_summary": f"""
        with d as (select user_id, day, count(*) as chars, count(*) filter (where not ok) as errors, max(at_s) - min(at_s) as elapsed, max(value) as wpm, count(*) * 7 % 100 as c from {_SQL_ACTIVITY} group by user_id, day)
        select user_id, cast(sum(chars) as bigint) as chars, cast(sum(errors) as bigint) as errors, cast(sum(elapsed) as bigint) as elapsed, round(100.0 * (sum(chars) - sum(errors)) / sum(chars), 6) as accuracy,
            round(case when sum(elapsed) > 0 then cast(sum(c * elapsed) as double) / sum(elapsed) else 0 end, 6) as consistency, round(max(wpm), 6) as peak from d group by user_id
    """,
}
