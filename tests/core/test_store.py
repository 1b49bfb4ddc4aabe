"""The keyed store and the streams that save into it: merged reads, one bucket a get, compaction, restarts, repeated batches."""

import pytest
from pyspark.sql import functions as F

from lectern.sources.store import Store
from lectern.streaming import reading

ROW = "book_id string, at int, said string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4)


def rows(spark, *own):
    return spark.createDataFrame(list(own), ROW)


def said(store, table="books"):
    return {r.book_id: r.said for r in store.read(table).collect()}


def folders(tmp_path, table="books"):
    return sorted(int(p.name.split("=")[1]) for p in (tmp_path / "store" / table).iterdir())


def test_a_put_writes_its_own_rows_only(spark, store, tmp_path):
    store.put(books=spark.range(500).select(F.col("id").cast("string").alias("book_id"), F.lit(1).alias("at"), F.lit("x").alias("said")))
    store.put(books=rows(spark, ("7", 2, "new"), ("7", 3, "newest"), (None, 1, "none")))
    delta = spark.read.parquet(f"{tmp_path}/store/books/commit=2")
    assert delta.count() == 2 and store.read("books").count() == 501
    assert said(store)["7"] == "newest" and said(store)[None] == "none"
    store.put(books=rows(spark, ("7", 1, "later put wins")))
    assert said(store)["7"] == "later put wins"


def test_a_get_reads_one_bucket(spark, store):
    store.put(books=spark.range(500).select(F.col("id").cast("string").alias("book_id"), F.lit(1).alias("at"), F.lit("x").alias("said")))
    store.put(books=rows(spark, ("7", 2, "new")))
    got = store.get("books", "7")
    assert [r.said for r in got.collect()] == ["new"] and store.get("books", None).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    files = {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles()}
    assert "PartitionFilters: [isnotnull(bucket" in plan and len(files) <= 4
    scanned = store._scan("books", store.pointer()["tables"]["books"]).filter(F.col("bucket") == store._bucket(F.lit("7"), 4))
    assert 0 < scanned.count() < 250


def test_deletes_then_puts_then_compaction(spark, store, tmp_path):
    store.put(books=rows(spark, ("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")))
    store.commit({}, {"books": rows(spark, ("a", 0, ""), ("zzz", 0, ""))})
    assert said(store) == {"b": "y", "c": "z"} and store.get("books", "a").count() == 0
    store.commit({"books": rows(spark, ("a", 5, "back"))}, {"books": rows(spark, ("a", 0, ""), ("b", 0, ""))})  # deletions come first
    assert said(store) == {"a": "back", "c": "z"}
    before = store.read("books")
    store.compact("books")
    assert said(store) == {"a": "back", "c": "z"} and before.count() == 2  # readers of the version before go on
    assert "HashAggregate" not in store.read("books")._jdf.queryExecution().executedPlan().toString()
    assert store.vacuum(versions=1) == 0 and folders(tmp_path) == [1, 2, 3, 4]
    assert store.vacuum() == 3 and folders(tmp_path) == [4] and said(store) == {"a": "back", "c": "z"}
    store.put(books=rows(spark, ("d", 1, "new")))
    assert said(store) == {"a": "back", "c": "z", "d": "new"} and store.compact("books") is None and store.read("books").count() == 3


def test_a_lost_writer_leaves_the_version_before(spark, store, tmp_path):
    store.put(books=rows(spark, ("a", 1, "x")))
    store._write(rows(spark, ("a", 2, "lost")).withColumn("_gone", F.lit(False)), "books", 2, store.pointer()["tables"]["books"])
    assert said(store) == {"a": "x"}
    store.put(books=rows(spark, ("b", 1, "y")))
    assert said(store) == {"a": "x", "b": "y"}


def test_puts_by_a_column(spark, store):
    store.commit({"books": rows(spark, ("a", 5, "five"))}, by={"books": "at"})
    store.put(books=rows(spark, ("a", 3, "three"), ("b", 1, "one")))
    assert said(store) == {"a": "five", "b": "one"}
    store.commit({"books": rows(spark, ("a", 1, "again"))}, {"books": rows(spark, ("a", 0, ""))})
    assert said(store) == {"a": "again", "b": "one"}
    store.compact()
    store.put(books=rows(spark, ("b", 0, "older")))
    assert said(store) == {"a": "again", "b": "one"}


def test_a_batch_counts_once(spark, store):
    assert store.commit({"books": rows(spark, ("a", 1, "x"))}, batch=("s", 0))
    assert not store.commit({"books": rows(spark, ("a", 9, "repeated"))}, batch=("s", 0)) and said(store) == {"a": "x"}
    assert store.commit({"books": rows(spark, ("a", 2, "y"))}, batch=("s", 1)) and store.commit({"books": rows(spark, ("b", 2, "z"))}, batch=("t", 0))
    assert said(store) == {"a": "y", "b": "z"}


def arrive(spark, folder, *own):
    spark.createDataFrame(list(own), "k int, n int, v string").write.mode("append").parquet(folder)


def test_last_rows_survive_a_restart(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    arrive(spark, folder, (1, 1, "a"), (2, 5, "b"))
    stream = spark.readStream.schema("k int, n int, v string").parquet(folder)
    assert sorted(map(tuple, reading.latest(stream, "k", "n", out).collect())) == [(1, 1, "a"), (2, 5, "b")]
    arrive(spark, folder, (3, 1, "c"), (2, 4, "older"))
    again = spark.readStream.schema("k int, n int, v string").parquet(folder)  # a new query on the same checkpoint
    assert sorted(map(tuple, reading.latest(again, "k", "n", out).collect())) == [(1, 1, "a"), (2, 5, "b"), (3, 1, "c")]


def test_a_stream_stopped_within_a_batch_ends_the_same(spark, tmp_path):
    """The store has committed, the stream has not: the batch runs again after the restart and changes nothing."""
    folder, at = f"{tmp_path}/in", f"file://{tmp_path}/checkpoint"
    store = Store(spark, f"file://{tmp_path}/store", {"t": "k"})
    arrive(spark, folder, (1, 1, "a"), (2, 2, "b"))
    stream = lambda: spark.readStream.schema("k int, n int, v string").parquet(folder)

    class Lost(Store):
        def commit(self, *args, **kwargs):
            super().commit(*args, **kwargs)
            raise RuntimeError("lost after the commit")

    with pytest.raises(Exception, match="lost after the commit"):
        reading.saved(stream(), Lost(spark, store.root, {"t": "k"}), "t", "n", at)
    assert store.read("t").count() == 2 and store.pointer()["last"] == 1
    arrive(spark, folder, (2, 3, "c"))
    reading.saved(stream(), store, "t", "n", at)
    assert sorted(map(tuple, store.read("t").collect())) == [(1, 1, "a"), (2, 3, "c")]
    assert list(store.pointer()["streams"].values()) == [1] and store.pointer()["last"] == 2


def test_deltas_are_merged_as_they_come(spark, tmp_path):
    folder, at = f"{tmp_path}/in", f"file://{tmp_path}/checkpoint"
    store = Store(spark, f"file://{tmp_path}/store", {"t": "k"}, buckets=2)
    for n in range(reading.COMPACT + 2):
        spark.createDataFrame([(n % 3, n, str(n))], "k int, n int, v string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("k int, n int, v string").option("maxFilesPerTrigger", 1).parquet(folder)
    reading.saved(stream, store, "t", "n", at)
    assert len(store.pointer()["tables"]["t"]["commits"]) < reading.COMPACT and sorted(r.n for r in store.read("t").collect()) == [7, 8, 9]


def test_checkpoints_of_two_tables_from_a_stream(spark, tmp_path, store):
    folder, kind = f"{tmp_path}/in", "book_id string, at int, chars int, navigation struct<frontier: int>"
    put = lambda *own: spark.createDataFrame(list(own), kind).write.mode("append").parquet(folder)
    run = lambda: reading.saved_checkpoints(spark.readStream.schema(kind).parquet(folder), store, f"file://{tmp_path}/c")
    put(("a", 1, 5, (1,)), ("a", 2, 6, (2,)), ("b", 1, 7, None))
    run()
    assert {r.book_id: r.frontier for r in store.read("navigation").collect()} == {"a": 2}
    put(("a", 3, 9, None), ("b", 2, 8, (4,)))
    run()
    assert {r.book_id: r.frontier for r in store.read("navigation").collect()} == {"b": 4}
    assert {r.book_id: r.chars for r in store.read("progress").collect()} == {"a": 9, "b": 8}


def test_pauses_of_rows_out_of_order(spark, tmp_path):
    """Rows of one stretch come in three batches, the middle one last; the watermark of a fourth closes it."""
    folder, second = f"{tmp_path}/in", 1_000_000
    put = lambda *own: spark.createDataFrame([(u, t * second, v) for u, t, v in own], "u string, us long, v long").coalesce(1).write.mode("append").parquet(folder)
    put(("x", 100, 1), ("y", 100, 9))
    put(("x", 108, 3), ("x", 108, 2))
    put(("x", 104, 7))
    put(("x", 113, 4), ("z", 10_000, 0))
    raw = spark.readStream.schema("u string, us long, v long").option("maxFilesPerTrigger", 1).parquet(folder)
    out = reading.quiet(raw.select("u", F.timestamp_micros("us").alias("ts"), "v"), "u", "ts", "v", 5 * second, "100 seconds")
    reading.with_rocksdb(spark, lambda: reading.run_to_end(out, "append", lambda got, b: got.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={b}"), f"file://{tmp_path}/c"))
    got = sorted(tuple(r)[:6] for r in spark.read.parquet(f"{tmp_path}/out").select("u", "started", "paused", "active_us", "events", "value").collect())
    assert got == [("x", 100 * second, 113 * second, 13 * second, 4, 3), ("x", 113 * second, 118 * second, 5 * second, 1, 4), ("y", 100 * second, 105 * second, 5 * second, 1, 9)]


def test_a_payload_in_pieces(spark, tmp_path):
    from lectern.sources.store import read_payload_pieces, write_payload

    n = 100_000
    progress = spark.range(n).select(F.concat(F.lit("b"), "id").alias("book_id"), F.col("id").alias("total"), F.create_map(F.lit("s"), F.col("id") % 2 == 0).alias("overrides"))
    known = spark.createDataFrame([("b7", "T", "A")], "book_id string, title string, author string")
    folder = f"file://{tmp_path}/payload"
    write_payload(progress, known, spark.createDataFrame([("dark",)], "theme string"), 9, folder)
    head, back, names = read_payload_pieces(spark, folder, "book_id string, total long, overrides map<string, boolean>", "theme string")
    assert (head.first().updated_at, head.first().settings.theme) == (9, "dark") and names.first().title == "T"
    assert back.count() == n and back.agg(F.sum("total")).first()[0] == n * (n - 1) // 2 and back.filter("overrides['s']").count() == n // 2
    files = sorted((tmp_path / "payload" / "entries").glob("part-*"))
    assert len(files) == 8 and max(f.stat().st_size for f in files) < 3 * min(f.stat().st_size for f in files if f.stat().st_size)
    files[3].unlink()
    with pytest.raises(ValueError, match="not whole"):
        read_payload_pieces(spark, folder, "book_id string", "theme string")


def test_a_payload_is_parsed_once(spark):
    from lectern.operators import progress

    good = '{"bookId":"a","position":{"sectionIndex":0,"blockIndex":1.0,"charIndex":2},"charsCompleted":1,"totalChars":2,"updatedAt":1e3,"lifetime":{"charsTyped":1,"errors":0,"timeMs":1,"sessions":1},"bestWpm":6.5,"sectionOverrides":{"x":true}}'
    bad = [good.replace('"updatedAt":1e3', f'"updatedAt":{v}') for v in ('"3"', "-1", "1.5", "null", "true")] + [good.replace("true", '"true"'), good.replace('"a"', "7"), good[:-1], "[]", "", None]
    rows = spark.createDataFrame([("a", good), *(("a", b) for b in bad)], "key string, raw string")
    fine, quarantined = progress.sanitized(rows)
    assert fine.count() == 1 and fine.first().updated_at == 1000 and fine.first().position.block == 1 and fine.first().overrides == {"x": True}
    assert sorted(r.raw or "" for r in quarantined.collect()) == sorted(b or "" for b in bad)
    plan = fine._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and "get_json_object" not in plan
