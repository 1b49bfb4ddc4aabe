"""Chains over ranges of blocks against the planner of one book; places in anchors; tree digests."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import planner as P
from lectern.operators import lessons, progress

KIND = "book long, section int, block int, included boolean, kind string, text string"


def random_book(rng, sections=3, most=14):
    words = lambda: " ".join("w" * rng.randrange(1, 12) + rng.choice(("", "", "", ".", '."')) for _ in range(rng.randrange(0, 70)))
    return [P.Section(rng.random() < 0.8, [(rng.choice(("paragraph", "paragraph", "verse", "heading")), rng.choice((words(), words(), "   ", "x" * rng.randrange(300), words() + " "))) for _ in range(rng.randrange(1, most))]) for _ in range(sections)]


def rows_of(name, sections):
    return [(name, s, b, sec.included, kind, text) for s, sec in enumerate(sections) for b, (kind, text) in enumerate(sec.blocks)]


@pytest.mark.parametrize("ranges", [1, 9])
def test_chains_of_books_cut_anywhere(spark, ranges):
    rng = random.Random(ranges)
    books = {n: random_book(rng) for n in (None, 2**53 + 1, *range(40))}
    books[99] = random_book(rng, 2, 400)
    rows = spark.createDataFrame([r for n, sec in books.items() for r in rows_of(n, sec)], KIND)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for target in (100, 200):
            got = {}
            for r in sorted(lessons.lessons(rows, "book", target).collect(), key=lambda r: r.lesson):
                got.setdefault(r.book, []).append((r.lesson, (r.start_section, r.start_block, r.start_char), (r.end_section, r.end_block, r.end_char)))
            for n, sections in books.items():
                want = [(i, tuple(a.start), tuple(a.end)) for i, a in enumerate(P.Book(sections).chain((0, 0, 0), target))]
                assert got.get(n, []) == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_recent_lessons_of_any_frontier(spark):
    rng = random.Random(3)
    books = {n: random_book(rng, 4, 9) for n in range(60)}
    own = {n: P.Book(s) for n, s in books.items()}
    frontiers = {n: b.canonical((rng.randrange(4), rng.randrange(9), rng.randrange(60))) for n, b in own.items() if b.open}
    rows = spark.createDataFrame([r for n, sec in books.items() for r in rows_of(n, sec)], KIND)
    asked = spark.createDataFrame([(n, *f) for n, f in frontiers.items()], "book long, f_section int, f_block int, f_char int")
    for limit in (64, 2):
        got = {}
        for r in sorted(lessons.recent(rows, asked, "book", 100, limit).collect(), key=lambda r: r.lesson):
            got.setdefault(r.book, []).append(((r.start_section, r.start_block, r.start_char), (r.end_section, r.end_block, r.end_char)))
        for n, f in frontiers.items():
            assert got.get(n, []) == [(tuple(a.start), tuple(a.end)) for a in own[n].recent(f, 100, limit)], (n, f)


def test_a_book_spreads_over_tasks(spark):
    """One book of many blocks: every range holds some of it, and the chain has no gaps."""
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("book"), F.lit(0).alias("section"), F.col("id").cast("int").alias("block"), F.lit(True).alias("included"), F.lit("paragraph").alias("kind"), F.lit("one two three. four").alias("text"))
    got = lessons.lessons(rows, "book", 100).orderBy("lesson").collect()
    ends = [(r.end_section, r.end_block, r.end_char) for r in got]
    assert [r.lesson for r in got] == list(range(len(got))) and [(r.start_section, r.start_block, r.start_char) for r in got] == [(0, 0, 0), *ends[:-1]] and ends[-1] == (0, 59_999, 19)


def test_places_in_many_anchors(spark):
    rng = random.Random(5)
    at = lambda: (rng.randrange(3), rng.randrange(40), rng.randrange(30))
    places = [(rng.choice((1, 2, None)), at()) for _ in range(400)] + [(1, (2**20, 2**22, 2**30)), (1, None)]
    anchors = [(rng.choice((1, 2, None)), i, *sorted((at(), at()))) for i in range(120)] + [(1, 900, (0, 0, 0), (2**21, 0, 0)), (1, 901, (2, 2, 2), (2, 2, 2)), (2, 902, (5, 0, 0), (1, 0, 0))]
    place = "struct<section: long, block: long, char: long>"
    got = progress.places_in_anchors(spark.createDataFrame(places, f"book int, at {place}"), spark.createDataFrame(anchors, f"book int, id int, start {place}, end {place}"), "book")
    want = sorted((b, p, i) for b, p in places for k, i, s, e in anchors if b is not None and p is not None and b == k and s <= p < e)
    assert sorted((r.book, tuple(r.at), r.id) for r in got.collect()) == want and len(want) > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_tree_digests_show_every_change(spark):
    rows = [(1, s, b, True, "paragraph", f"text {s} {b}") for s in range(3) for b in range(30)]
    digest = lambda own: lessons.tree_digest(spark.createDataFrame(own, KIND).repartition(3), "book", 4).first()
    first = digest(rows)
    assert first.blocks == 90 and digest(list(reversed(rows))) == first
    for i, new in ((0, (1, 0, 0, True, "paragraph", "text 0 1")), (45, (1, 1, 15, False, "paragraph", "text 1 15")), (89, (1, 2, 29, True, "verse", "text 2 29")), (10, (1, 0, 31, True, "paragraph", "text 0 10"))):
        assert digest([new if k == i else r for k, r in enumerate(rows)]).digest != first.digest
    assert digest([*rows, rows[0]]).digest != first.digest
