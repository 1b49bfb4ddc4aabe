"""Ordered folds by key: null keys are one group, long keys stay exact."""

from lectern.operators import geometry, lessons
from lectern.plans.stages import folded

BIG = 2**53 + 1


def test_fold_keeps_null_and_long_keys(spark):
    rows = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), (None, 3, None), (BIG, 1, "x"), (BIG - 1, 1, "y")], "k long, i int, v string")
    got = folded(rows, ["k"], ["i"], lambda own: [("".join(v or "-" for _, v in own), len(own))], "k long, all string, n long").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, "ab-", 3), (BIG, "x", 1), (BIG - 1, "y", 1)], key=repr)
    assert folded(rows.limit(0), ["k"], ["i"], lambda own: [("", 0)], "k long, all string, n long").count() == 0


def test_lessons_of_null_and_long_keys(spark):
    text = "one two three. four five six. " * 12
    rows = spark.createDataFrame([(k, 0, b, True, "paragraph", text) for k in (None, BIG, 7) for b in range(2)], "book long, section int, block int, included boolean, kind string, text string")
    got = lessons.lessons(rows, "book", 100).collect()
    by = {k: [tuple(r)[1:] for r in got if r.book == k] for k in (None, BIG, 7)}
    assert len(by[7]) > 1 and by[None] == by[BIG] == by[7] and len(got) == 3 * len(by[7])


def test_lines_of_null_and_long_keys(spark):
    items = spark.createDataFrame([(k, "ab", float(x), 10.0, 5.0, 9.0, x) for k in (None, BIG) for x in (0, 6)], "page long, text string, x double, y double, width double, height double, place long")
    got = geometry.page_lines(items, "page").collect()
    assert {r.page for r in got} == {None, BIG} and len(got) == 2
