"""What failed or was slow on larger tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import names as N
from lectern.operators import clean, importing, labels, lessons, repair, sections
from lectern.operators.geometry import page_lines
from lectern.streaming import reading


def test_labels_of_large_ids(spark, tmp_path):
    rows = [(i, 21.5) for i in (7, 2_097_151, 2_097_152, 6_000_000, 2**30)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r["size"] for r in labels.display_labels(spark, str(tmp_path)).collect()}
    tb = lambda i: f"{int(i**3 / 1024**4 + 0.5)} TB"
    assert got == {7: "343 B", **{i: tb(i) for i in (2_097_151, 2_097_152, 6_000_000, 2**30)}}


def test_ties_of_width_in_any_unit():
    """25 and 17 are just the share that counts as wide, in characters and in points."""
    for unit in (1.0, 7.0, 0.1):
        lines = [G.Line("a" * n, 0.0, 100.0 - 12 * k, n * unit, 10.0) for k, n in enumerate((25, 17, 17, 17))]
        assert [kind for kind, _ in G.blocks_of(lines)] == ["paragraph"], unit


def times_in_plan(spark, what, name):
    return spark.range(1).select(F.lit("a").alias("t")).select(what(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString().count(name)


def test_sentences_are_marked_once(spark):
    """One pass of the pattern, with the same cuts as the pattern that looks back at every place."""
    assert times_in_plan(spark, clean.sentences, "regexp_replace(") == 1
    old = "(?<!(?<![A-Za-z])(?i:" + "|".join(clean.ABBREVIATIONS) + "|[a-z]) {0,3})([.!?][\"'”’)\\]]*)\\s+(?=[\"'“‘(\\[]*[A-Z0-9])"
    rng = random.Random(5)
    texts = [("".join(rng.choice(["Mr", "vs", "a", "Word", "x.", "!", "?\"", ".)", " ", "  ", "\n", "(A", "'B", "9", "”", "“"]) for _ in range(60)),) for _ in range(300)]
    rows = spark.createDataFrame(texts, "t string")
    ways = [F.regexp_replace("t", old, "$1\u0001"), F.regexp_replace("t", clean.SENTENCE_END, "$1$2\u0001")]
    assert rows.filter(ways[0] != ways[1]).count() == 0 and rows.filter(F.contains(ways[0], F.lit("\u0001"))).count() > 100


def test_blank_texts_have_no_sentence(spark, tmp_path):
    texts = [(1, ""), (2, " \n\t "), (3, "\u00a0"), (4, " One. Two "), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, clean.sentence_split(spark, str(tmp_path)).collect())) == [(4, 0, "One."), (4, 1, "Two")]


def test_long_blocks_are_cut_once(spark):
    assert times_in_plan(spark, clean.short_blocks, "regexp_replace(") == 1


def test_paragraphs_are_found_once(spark):
    assert times_in_plan(spark, repair.paragraphs, "regexp_extract_all(") == 1


def test_trims_without_patterns(spark):
    """The same characters go as by the class of white space, at the ends only."""
    assert times_in_plan(spark, N.any_trim, "regexp") == 0
    chars = [chr(c) for c in range(1, 0xFFFF) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(f"{c}a{c} b{c}",) for c in chars], "t string")
    old = F.regexp_replace("t", f"^{N.ANY_SPACE}+|{N.ANY_SPACE}+$", "")
    assert rows.filter(old != N.any_trim(F.col("t"))).count() == 0


def test_blocks_of_a_session_come_once(spark, tmp_path):
    """Keys bring no copy of their session's blocks; those come with a row of their own, and later batches need none."""
    kind, folder = "s long, seq long, key string, texts array<string>", f"{tmp_path}/in"
    put = lambda *own: spark.createDataFrame(list(own), kind).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: reading.latest(reading.typing_totals(spark.readStream.schema(kind).parquet(folder), "s"), "s", "seq", f"{tmp_path}/out")
    put((1, 0, "a", None), (1, -1, None, ["ab", "c"]), (1, 1, "x", None))
    run()
    put((1, 2, "Enter", None), (1, 3, "c", None))
    assert [(r.seq, r.total, r.right, r.block, r.correct, r.incorrect) for r in run().collect()] == [(3, 4, 3, 1, 2, 1)]


def test_keys_come_in_bursts(spark, tmp_path):
    """A row may bring many keys; a key that comes again or late counts once, whichever burst brings it."""
    kind, folder = "s long, seq array<long>, key array<string>, texts array<string>", f"{tmp_path}/in"
    put = lambda *own: spark.createDataFrame(list(own), kind).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: reading.latest(reading.typing_totals(spark.readStream.schema(kind).parquet(folder), "s"), "s", "seq", f"{tmp_path}/out")
    put((1, [1], ["x"], None), (1, [], [], ["ab", "c"]), (1, [0, 1], ["a", "x"], None))
    run()
    put((1, [1, 2, 3], ["q", "Enter", "c"], None))
    assert [(r.seq, r.total, r.right, r.block, r.correct, r.incorrect) for r in run().collect()] == [(3, 4, 3, 1, 2, 1)]


def test_turns_are_typed_in_bursts(spark, tmp_path):
    """Two rows a turn at most, that hold each key in order."""
    text = "abcdefgh ijk mnopqrstuvwxyz abcdefghijklmnopqrstuv xyz"
    turns = spark.createDataFrame([(1, 7, text), (1, 8, "ab")], "conv_id long, block int, text string")
    rows = sorted(lessons.replay_bursts(turns).collect(), key=lambda r: r.half)
    assert [r.half for r in rows] == [14, 15, 16]
    assert [k.seq for k in rows[2].typed] == [8_000_000_000, 8_000_000_010, 8_000_000_011] and [k.key for k in rows[2].typed] == ["a", "b", "Enter"]
    typed = rows[0].typed + rows[1].typed
    assert rows[1].typed[0].seq == 7_000_000_400 and [k.seq for k in typed] == sorted({k.seq for k in typed})
    for key, at in (("Backspace", [101, 241, 381, 521]), ("~", [30, 100, 170, 240, 310, 380, 450, 520]), ("Enter", [531])):
        assert [k.seq - 7 * 10**9 for k in typed if k.key == key] == at


def test_pauses_take_as_many_batches_of_more_files(spark, tmp_path):
    """An eighth of the time is a batch, of however many files."""
    import glob

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/pauses-*-out/batch=*"))
    reading.stream_pauses(spark, str(tmp_path))
    assert 8 <= len(set(glob.glob(f"{shared}/pauses-*-out/batch=*")) - before) <= 17


def test_pauses_are_windows_and_take_no_empty_batches(spark, tmp_path):
    """A batch for each eighth and one for the last watermark, without Python workers; just the gap after an event a new stretch begins."""
    import glob

    day, gap = 86_400_000_000, reading.GAP_US
    times = [(1, 0), (1, gap - 1), (1, 2 * gap - 1), (1, 3 * gap), (2, 20 * day), (3, day), (3, day), *((4, d * day) for d in range(1, 20))]
    rows = spark.createDataFrame([(i, u, day + t) for i, (u, t) in enumerate(times)], "event_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{shared}/pauses-*-out/batch=*"))
    got = sorted(tuple(r) for r in reading.stream_pauses(spark, str(tmp_path)).select("user_id", F.col("started") - day, F.col("paused") - day, "active_us", "events", "value").collect())
    assert len(set(glob.glob(f"{shared}/pauses-*-out/batch=*")) - before) <= 9
    assert got == [(1, 0, 2 * gap - 1, 2 * gap - 1, 2, 1), (1, 2 * gap - 1, 3 * gap - 1, gap, 1, 2), (1, 3 * gap, 4 * gap, gap, 1, 3), (3, day, day + gap, gap, 2, 6), *((4, d * day, d * day + gap, gap, 1, 6 + d) for d in range(1, 12))]
    assert "WithState" not in reading.quiet(rows, "user_id", "ts", "event_id", gap, "8 days")._jdf.queryExecution().analyzed().toString()


def test_books_are_opened_without_a_frame_each(spark):
    """Books stream through sorted partitions; null and long keys, and sides without the other, as before."""
    big = 2**53 + 1
    blocks = spark.createDataFrame([(b, 0, 0, True, "paragraph", "one two three. " * 20) for b in (big, None, 5)], "book long, section int, block int, included boolean, kind string, text string")
    marks = spark.createDataFrame([(big, 0, 0, 4, "s", None), (None, 0, 0, 9999, "s", None), (8, 1, 2, 3, "s", None)], "book long, section int, block int, char int, signature string, navigation string")
    out = lessons.opened(blocks, marks, "book", 100)
    assert "CoGroup" not in out._jdf.queryExecution().toString()
    assert {r.book: (r.outcome, r.section, r.block, r.char) for r in out.collect()} == {big: ("seeded", 0, 0, 4), None: ("ended", 0, 0, 9999), 8: ("empty", 1, 2, 3)}


def test_books_meet_their_bookmarks_however_these_were_dealt(spark):
    """Both sides come dealt by the book; Spark took their union as dealt, joined small partitions of each side on its own, and no book met its bookmark."""
    blocks = spark.createDataFrame([(k, 0, 0, True, "paragraph", "one two three. " * 20) for k in range(40)], "book long, section int, block int, included boolean, kind string, text string")
    marks = spark.createDataFrame([(k, 0, 0, 4, "s", None) for k in range(40)], "book long, section int, block int, char int, signature string, navigation string")
    out = lessons.opened(blocks.repartition("book"), marks.repartition("book"), "book", 100)
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    assert any("Exchange" in x for x in lines[: next(k for k, x in enumerate(lines) if "Union" in x)])
    assert {r.outcome for r in out.collect()} == {"seeded"}


def test_lines_of_many_pages_are_those_of_each():
    """Columns of many pages give what lines_of() gives page by page: wavering rows, columns, ties, blanks, long rows."""
    rng, pages = random.Random(8), []
    for p in range(300):
        rows = rng.choice([1, 3, 8])
        step = rng.choice([1.0, 2.5, 4.0, 20.0])
        pages.append([
            (p, rng.choice(["a", "bc ", " d", "e\xa0f", " ", "", "wörter"]), rng.choice([0.0, 50.0, 400.0]) + rng.randrange(9) * 12.5, 700 - rng.randrange(rows) * step + rng.random() * rng.choice([0, 1, 3]), rng.choice([0.0, 10.0, 14.5]), rng.choice([10.0, 10.0, -12.0]), k)
            for k in range(rng.choice([0, 1, 5, 40, 200]))
        ])
    expected = [(p, k, *line) for p, own in enumerate(pages) for k, line in enumerate(G.lines_of([G.Item(*i[1:]) for i in own]))]
    columns = list(zip(*[i for own in pages for i in own]))
    got = G.lines_of_pages(np.array(columns[0]), list(columns[1]), *map(np.array, columns[2:]))
    assert list(zip(*(c.tolist() if isinstance(c, np.ndarray) else c for c in got))) == expected


def test_items_in_rows_or_arrays(spark):
    """Null keys are one page; a page goes on over batches; items with a number missing are read as before."""
    rows = [(k, "w%d" % i, float(i * 60 % 7), 500.0 - i * 3, None if i == 5 else 9.0, 10.0, i) for k in (None, 2**53, 2**53 + 1) for i in range(40)]
    kinds = "k long, text string, x double, y double, width double, height double, place long"
    expected = sorted(((k is not None, k or 0, n, *line) for k in (None, 2**53, 2**53 + 1) for n, line in enumerate(G.lines_of([G.Item(*r[1:]) for r in rows if r[0] == k]))))
    items = spark.createDataFrame(rows, kinds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        nested = items.groupBy("k", F.col("place") % 3).agg(F.collect_list(F.struct("text", "x", "y", "width", "height", "place")).alias("items")).select("k", "items")
        for own in (page_lines(items, "k"), page_lines(nested, "k")):
            assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in own.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def exchanges(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_lines_of_books_move_once(spark):
    assert exchanges(sections.text_book_blocks(spark, "/root/testdata/sf0.001")) == 1


@pytest.mark.parametrize("query", ["import_files", "import_warnings"])
def test_texts_of_an_import_move_once(spark, monkeypatch, query):
    """Blocks are written as they are read, normal and mended, and meet what is told of few of them without moving."""
    seen, write = set(), importing.written

    def noted(rows, name):
        seen.add(name)
        return write(rows, name)

    for module in (importing, clean):
        monkeypatch.setattr(module, "written", noted)
    importing.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert not {"raw-blocks", "pieces", "headless-blocks"} & seen
    blocks = spark.createDataFrame([("b", "x")], "book string, text string")
    garbled = write(spark.createDataFrame([("c", True)], "book string, garbled boolean"), "garbled-books")
    assert not re.search("(?<!Broadcast)Exchange ", repair.repaired(blocks, "book", garbled)._jdf.queryExecution().executedPlan().toString())


def test_text_files_move_once_and_are_written_tightly(spark, monkeypatch):
    """From the files to the blocks of text books there is one move by book; stages are written with zstd."""
    moves, files, write = {}, [], importing.written

    def noted(rows, name):
        moves[name] = len(re.findall("(?<!Broadcast)Exchange ", rows._jdf.queryExecution().executedPlan().toString()))
        out = write(rows, name)
        files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(importing, "written", noted)
    importing.import_warnings(spark, "/root/testdata/sf0.001")
    assert moves["text-blocks"] == 1
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_the_least_path_of_equal_files_of_any_format(spark):
    one, two = b"<p>One</p>", b"<p>Two</p>"
    files = spark.createDataFrame([("b.html", one), ("a.txt", one), ("c.txt", one), ("d.txt", two), ("c.html", two), ("a.bin", two)], "path string, content binary")
    raw = importing.parsed(files)
    assert sorted(r.path for r in raw.books.collect()) == ["a.txt", "c.html"]
    assert sorted(r.text for r in raw.blocks.collect()) == ["<p>One</p>", "Two"]
    assert [(r.path, r.why) for r in raw.rejected.collect()] == [("a.bin", "unsupported format")]


def test_books_are_packed_once(spark):
    assert "FlatMapGroupsInPandas" not in importing.epub_sections(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
