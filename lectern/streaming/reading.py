"""Structured Streaming over activity: session windows, the last state of each key, typing sessions with state.

Time is the event's own. A watermark of `late` drops what comes later than that (the batch forms have no such limit); with
a watermark beyond the data's disorder a stream ends with the same rows as the batch query. Repeated keys of a session are
taken once, by their sequence number.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType

from lectern.functions import typing as T
from lectern.operators import lessons
from lectern.plans.stages import shared
from lectern.sources.store import Store

COMPACT = 8  # deltas of a table until they are merged
TOTALS = "total long, right long, block long, char long, correct long, incorrect long, corrected long, pending long, extras long"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path.removesuffix("t") + "[t]" if path.endswith(".parquet") else path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def session_windows(events: DataFrame, user: str, ts: str, gap: str, late: str) -> DataFrame:
    by = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return by.select(user, F.col("w.start").alias("started"), "events")


def samples(events: DataFrame, user: str, ts: str, key: str, step: str, late: str) -> DataFrame:
    """user, started, keys: activity that counts per tumbling window."""
    by = events.withWatermark(ts, late).groupBy(user, F.window(ts, step).alias("w")).agg(F.count_if(key).alias("keys"))
    return by.select(user, F.col("w.start").alias("started"), "keys")


def without_empty_batches(spark: SparkSession, run: Callable[[], None]) -> None:
    """Runs with no batch for a moved watermark alone: what is due comes with the next rows, so the last run needs such batches."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        run()
    finally:
        spark.conf.set(name, before)


def run_to_end(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], at: str) -> None:
    """All that is there now, batch by batch; the checkpoint at `at` lets a restarted query go on."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def saved(stream: DataFrame, store: Store, table: str, by: str, at: str, mode: str = "append") -> None:
    """Every batch is put into a table of the store, the largest `by` of a key staying; the checkpoint at `at` names the stream.

    The batch's number is committed with its rows: a restart goes on where the last commit stood, and a batch that runs
    again puts nothing. A batch writes rows in proportion to itself; after COMPACT deltas they are merged.
    """

    def put(rows: DataFrame, batch: int) -> None:
        store.commit({table: rows}, by={table: by}, batch=(at, batch))
        if len(store.pointer()["tables"].get(table, {}).get("commits", ())) >= COMPACT:
            store.compact(table)

    run_to_end(stream, mode, put, at)


def saved_checkpoints(stream: DataFrame, store: Store, at: str) -> None:
    """Rows of progress with a column `navigation` (a struct, or null), put into both tables at once: the last by `at` of each
    book and batch. A book whose last row has no navigation loses what it had."""
    names = [c for c in stream.columns if c != "navigation"]

    def put(rows: DataFrame, batch: int) -> None:
        order = F.struct("at", *[c for c in names if c != "at"])
        last = rows.groupBy("book_id").agg(F.max_by(F.struct(*names, "navigation"), order).alias("r")).select("r.*").persist()
        store.checkpoint(last.select(*names), last.filter("navigation is not null").select("book_id", "at", "navigation.*"), batch=(at, batch))
        last.unpersist()

    run_to_end(stream, "append", put, at)


def latest(stream: DataFrame, key: str, order: str, folder: str) -> DataFrame:
    """The row of the largest `order` of each key over all batches, also over those before a restart."""
    store = Store(stream.sparkSession, folder, {"latest": key})
    store.migrate({"latest": stream.schema}, {"latest": order})
    saved(stream, store, "latest", order, f"{folder}-checkpoint", "update")
    return store.read("latest")


def quiet(events: DataFrame, key: str, ts: str, value: str, gap_us: int, late: str) -> DataFrame:
    """key, started, paused, active_us, events, value: idle pause and debounce in one. A stretch of activity ends `gap_us`
    after its last event (the clock pauses there), and what then is saved is the value of that event (the largest of ties).

    Appended once the watermark, `late` behind the newest event, reaches the pause. Times are microseconds. Rows that come out
    of order open, lengthen or join stretches, whichever batch brings them.
    """
    # Session windows that touch are joined; an event just `gap_us` after another one begins a new stretch.
    window = F.session_window(ts, f"{gap_us - 1} microseconds").alias("w")
    rows = events.withWatermark(ts, late).withColumn("last", F.struct(F.unix_micros(ts).alias("us"), F.col(value).cast("long").alias("value")))
    by = rows.groupBy(key, window).agg(F.count("*").alias("events"), F.max("last").alias("last"))
    started, paused = F.unix_micros("w.start"), F.col("last.us") + gap_us
    return by.select(key, started.alias("started"), paused.alias("paused"), (paused - started).alias("active_us"), "events", "last.value")


def with_rocksdb(spark: SparkSession, run: Callable[[], None]) -> None:
    """Runs with the state provider that timers need; a query keeps the provider it was started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run()
    finally:
        spark.conf.set(name, before)


def typing_totals(keys: DataFrame, session: str, stop: str = T.OFF, ttl_ms: int | None = None) -> DataFrame:
    """session, seq (the last key's), TOTALS of a stream of keys (session, seq, key, texts: the session's blocks, or null but in the first batch).

    A row is a key, or a burst of keys where seq and key are arrays: a row costs far more on its way to the fold than a key in it.
    The state is a session's blocks, states and counters; a session without keys for `ttl_ms` is forgotten. With a limit
    the stream makes batches as long as it runs, so it needs a trigger that repeats. Keys count in the order of their batches: one
    whose number is under the last one of an earlier batch comes too late and is left out.
    """
    kind, bursts = keys.schema[session].dataType.simpleString(), isinstance(keys.schema["seq"].dataType, ArrayType)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own, last = pickle.loads(state.get[0]) if state.exists else (None, -1)
        rows = pd.concat(list(parts))
        seqs, typed = ([x for own in rows[c] for x in own.tolist()] if bursts else rows[c].tolist() for c in ("seq", "key"))
        if own is None:
            said = rows["texts"].dropna()
            own = T.Session(list(said.iloc[0]) if len(said) else [], stop)
        for seq, pressed in sorted(zip(seqs, typed, strict=True), key=lambda k: k[0]):
            if seq > last:
                own.key(pressed)
                last = seq
        if own is not None:
            state.update((pickle.dumps((own, last)),))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
            c = own.counts()
            yield pd.DataFrame([(key[0], last, *(c[k] for k in lessons.COUNTS))], columns=[session, "seq", *lessons.COUNTS])

    return keys.groupBy(session).applyInPandasWithState(fold, f"{session} {kind}, seq long, {TOTALS}", "state binary", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


# Queries: streams run until what is there is read, so that their rows can be held against the batch forms.


def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows over the event files; the last batch's complete result."""
    folder = shared(spark, "stream-sessions")
    rows = session_windows(event_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", "30 minutes", "1 hour")
    run_to_end(rows, "complete", lambda out, _: out.write.mode("overwrite").parquet(folder), f"{folder}-checkpoint")
    return spark.read.parquet(folder).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


def stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys per six hours; the last batch's complete result."""
    folder = shared(spark, "stream-samples")
    events = event_stream(spark, f"{sf_dir}/events.parquet").withColumn("key", F.col("event_type") != "view")
    run_to_end(samples(events, "user_id", "ts", "key", "6 hours", "1 hour"), "complete", lambda out, _: out.write.mode("overwrite").parquet(folder), f"{folder}-checkpoint")
    return spark.read.parquet(folder).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "keys")


def stream_last_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, put as it comes."""
    events = event_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type")
    return latest(events, "user_id", "event_id", shared(spark, "stream-last"))


GAP_US, LATE_DAYS = 6 * 3600 * 1_000_000, 8


def stream_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active stretches of each user by idle pauses of six hours, with the event saved at each; events come by eighths of time."""
    folder = shared(spark, "pauses")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    eighth = F.least(F.lit(7), F.floor(8 * (F.unix_micros("ts") - F.unix_micros(F.lit(first))) / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)))))
    # An eighth is a batch, however many files it has: no more batches on larger tables.
    for k in range(8):
        events.filter(eighth == k).write.mode("append").parquet(folder)
        rows = quiet(spark.readStream.schema(events.schema).parquet(folder), "user_id", "ts", "event_id", GAP_US, f"{LATE_DAYS} days")
        one = lambda: run_to_end(rows, "append", lambda out, batch: out.write.mode("overwrite").parquet(f"{folder}-out/batch={batch}"), f"{folder}-checkpoint")  # noqa: B023, E731
        with_rocksdb(spark, one if k == 7 else lambda: without_empty_batches(spark, one))  # noqa: B023
    return spark.read.schema(rows.schema).parquet(f"{folder}-out").select(*rows.columns)


def stream_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as checkpoints of a book: progress, with the lesson's place unless the event is an error."""
    store = Store(spark, shared(spark, "saves"))
    events = event_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("at"), (F.col("event_id") % 1000).alias("chars"), F.when(F.col("event_type") != "error", F.struct((F.col("event_id") % 97).alias("place"))).alias("navigation"))
    saved_checkpoints(events, store, f"{store.root}-checkpoint")
    return store.read("progress").join(store.read("navigation").select("book_id", "place"), "book_id", "left").select("book_id", "at", "chars", "place")


def stateful_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the typing replay in two parts, as bursts, the second part after the first: counters go on from the state."""
    folder = shared(spark, "keys")
    turns = lessons.replay_turns(spark, sf_dir)
    texts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("own")).select("conv_id", F.transform("own", lambda b: b["text"]).alias("texts"))
    # A session's later half begins after the middle of its half turns.
    cut = turns.groupBy("conv_id").agg((F.max(F.col("block") * 2 + (F.length("text") > 40).cast("int")) / 2).alias("_cut"))
    bursts = lessons.replay_bursts(turns.join(cut, "conv_id"), "_cut")
    rows = bursts.select("conv_id", F.col("typed.seq").alias("seq"), F.col("typed.key").alias("key"), (F.col("half") > F.col("_cut")).alias("late"), F.lit(None).cast("array<string>").alias("texts"))
    # A session's blocks come with a row of their own, not with each burst: it has no keys.
    first = texts.select("conv_id", F.array().cast("array<bigint>").alias("seq"), F.array().cast("array<string>").alias("key"), F.lit(False).alias("late"), "texts")
    rows = rows.unionByName(first)
    rows.write.partitionBy("late").parquet(folder)
    stream, out = spark.readStream.schema(rows.drop("late").schema), None
    for late in ("false", "true"):
        spark.read.schema(rows.drop("late").schema).parquet(f"{folder}/late={late}").write.mode("append").parquet(f"{folder}-in")
        with_rocksdb(spark, lambda: latest(typing_totals(stream.parquet(f"{folder}-in"), "conv_id"), "conv_id", "seq", f"{folder}-out"))
    out = Store(spark, f"{folder}-out", {"latest": "conv_id"}).read("latest")
    return out.select("conv_id", "total", "right", "block", T.CORRECT, T.INCORRECT, T.CORRECTED, T.PENDING, "extras")


QUERIES = {"stream_samples": stream_samples, "stream_session_windows": stream_session_windows, "stream_last_progress": stream_last_progress, "stream_pauses": stream_pauses, "stream_checkpoints": stream_checkpoints, "stateful_typing": stateful_typing}

ORACLE_SQL = {
    "stream_session_windows": """
        with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
        s as (select *, sum(new) over (partition by user_id order by ts) as session from g)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as events from s group by user_id, session
    """,
    "stream_samples": """
        select user_id, strftime(make_timestamp(b * 21600000000), '%Y-%m-%d %H:%M:%S') as started, count(*) filter (where event_type <> 'view') as keys
        from (select user_id, event_type, epoch_us(ts) // 21600000000 as b from events) group by user_id, b
    """,
    "stream_last_progress": "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by user_id",
    "stream_checkpoints": """
        select user_id as book_id, max(event_id) as at, max(event_id) % 1000 as chars, case when max_by(event_type, event_id) <> 'error' then max(event_id) % 97 end as place from events group by user_id
    """,
    "stream_pauses": f"""
        with e as (select user_id, event_id, epoch_us(ts) as us from events),
        g as (select *, case when us - lag(us) over (partition by user_id order by us) < {GAP_US} then 0 else 1 end as new from e),
        s as (select *, sum(new) over (partition by user_id order by us) as stretch from g),
        p as (select user_id, min(us) as started, max(us) + {GAP_US} as paused, count(*) as events, max_by(event_id, (us, event_id)) as value from s group by user_id, stretch)
        select user_id, started, paused, paused - started as active_us, events, value from p
        where paused <= (select max(us) from e) - {LATE_DAYS * 86_400_000_000}
    """,
    "stateful_typing": lessons.ORACLE_SQL["typing_replay"],
}
