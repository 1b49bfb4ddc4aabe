"""Planner, typing and geometry by plain cases; invariants by random books."""

import random

import pytest

from lectern.functions import geometry as G
from lectern.functions import planner as P
from lectern.functions import typing as T


def book(*blocks, included=True):
    return P.Book([P.Section(included, [b if isinstance(b, tuple) else ("paragraph", b) for b in blocks])])


def words(n, size=9, end=""):
    return " ".join(["w" * size] * n) + end


def test_lesson_ends_where_the_rules_say():
    assert book(words(40)).lesson_end((0, 0, 0), 100) == (0, 0, 120)  # the word that meets it
    sentence = words(11) + " " + "w" * 6 + ". " + words(30)
    assert book(sentence).lesson_end((0, 0, 0), 100) == (0, 0, len(words(11)) + 9)
    assert book(words(12), words(30)).lesson_end((0, 0, 0), 100) == (0, 1, 0)  # a block's end in reach outranks both
    assert book(words(11) + " " + "w" * 5 + ".", words(30)).lesson_end((0, 0, 0), 100) == (0, 1, 0)
    assert book(words(14), words(3)).lesson_end((0, 0, 0), 100)[1] == 0
    assert book(words(3)).lesson_end((0, 0, 0), 100) == (0, 0, 29)
    assert book(("verse", words(30)), words(3)).lesson_end((0, 0, 0), 100) == (0, 1, 0)
    assert book(("heading", words(30)), words(3)).lesson_end((0, 0, 0), 100) == (0, 1, 10)
    assert book(("heading", words(30)), ("verse", "a b"), "x").lesson_end((0, 0, 0), 100) == (0, 2, 0)
    assert book("").lesson_end((0, 0, 0), 100) == (0, 0, 0)


def test_positions():
    b = P.Book([P.Section(False, [("paragraph", "no")]), P.Section(True, [("paragraph", ""), ("paragraph", "ab")]), P.Section(True, [("paragraph", "")]), P.Section(True, [("paragraph", "cd")])])
    assert [b.canonical(p) for p in ((0, 0, 1), (1, 0, 5), (1, 1, 2), (1, 1, 3), (1, 9, 9), (2, 0, 0), (3, 0, 9), (9, 9, 9), (-1, float("nan"), 0))] == [(1, 1, 0), (1, 1, 0), (1, 1, 2), (3, 0, 0), (1, 1, 0), (1, 1, 0), (3, 0, 2), (1, 1, 0), (1, 1, 0)]
    assert b.after(1, 1) == (3, 0) and b.after(3, 0) is None and b.before(3, 0) == (1, 1) and b.before(1, 1) is None
    a = b.anchor((0, 0, 0), 110)
    assert a == P.Anchor((1, 1, 0), (3, 0, 2), 100) and b.is_valid(a) and not b.is_valid(a._replace(target=110)) and not b.is_valid(a._replace(end=a.start)) and not b.is_valid(a._replace(version=2))


@pytest.mark.parametrize("seed", range(8))
def test_lessons_cover_a_book_without_gaps(seed):
    rng = random.Random(seed)
    blocks = [(rng.choice(("paragraph", "paragraph", "verse", "heading")), " ".join("w" * rng.randrange(1, 12) + rng.choice(("", "", ".", '."')) for _ in range(rng.randrange(0, 60)))) for _ in range(12)]
    b, target = book(*blocks), rng.choice((100, 125, 200))
    chain = b.chain((0, 0, 0), target)
    assert all(x.end == y.start for x, y in zip(chain, chain[1:], strict=False)) and all(b.is_valid(a) for a in chain)
    last = b.open[-1]
    assert chain[0].start == (*b.open[0], 0) and chain[-1].end == (*last, len(b.text(last)))
    assert b.recent(chain[-1].end, target) == chain[-P.HISTORY :]
    if len(chain) > 3:
        assert b.recent(chain[2].end, target) == chain[:3] and b.recent(chain[2].end, target, 1) == chain[2:3]
        s, k, c = chain[2].end
        gap = b.recent((s, k, c + 1), target)
        assert gap[-1].end == b.canonical((s, k, c + 1)) and gap[-1].start == chain[2].end or c == len(b.text((s, k)))


def typed(text, keys, stop=T.OFF, floor=(0, 0)):
    s = T.Session([text] if isinstance(text, str) else text, stop, floor)
    for k in keys:
        s.key(k)
    return s


def test_keys():
    s = typed("ab cd", ["a", "x", T.BACKSPACE, "b", "x", " ", T.BACKSPACE, T.BACKSPACE])
    assert (s.total, s.correct, s.at) == (5, 3, (0, 1)) and s.states[0][:3] == [T.CORRECT, T.PENDING, T.CORRECT] and not s.extras[0, 0]
    assert s.word_was_wrong(0, 0, 2) and not s.word_is_right(0, 0, 2)
    assert typed("ab", ["x"], T.LETTER).at == (0, 0) and typed("ab", ["x"], T.LETTER).total == 1
    held = typed("ab c", ["a", "x", " "], T.WORD)
    assert held.at == (0, 2) and held.total == 3
    assert typed("ab c", ["a", "x", T.BACKSPACE, "b", " "], T.WORD).at == (0, 3)
    assert typed(["ab", "c"], ["a", "b", "z", T.BACKSPACE, T.ENTER, "c"]).counts()["total"] == 5
    assert typed(["ab", "c"], [T.ENTER]).correct == 0 and typed(["ab", "c"], ["a", "b", T.ENTER, T.BACKSPACE]).at == (0, 1)
    assert typed("ab cd", ["a", "b", " ", "c", T.DELETE_WORD]).at == (0, 3) and typed("ab cd", ["a", "b", " ", T.DELETE_WORD]).at == (0, 0)
    assert typed("ab cd", ["c", T.BACKSPACE, T.BACKSPACE], floor=(0, 3)).at == (0, 3)


def test_typing_everything_right_is_perfect():
    rng = random.Random(3)
    blocks = [" ".join("w" * rng.randrange(1, 6) for _ in range(9)) for _ in range(4)]
    s = typed(blocks, [k for b in blocks for k in [*b, T.ENTER]][:-1])
    assert s.total == s.correct == sum(map(len, blocks)) + 3 and s.at == (3, len(blocks[3])) and all(x == T.CORRECT for own in s.states for x in own)


def test_clock_and_samples():
    assert T.active_ms([0, 1000, 9000, 9100]) == 1000 + 5000 + 100 and T.active_ms([0, 100], paused=9000) == 5100 and T.active_ms([]) == 0
    assert T.samples([0, 100, 3500], [True, True, True]) == [24.0, 0.0, 0.0] and T.samples([0, 9500], [True, True]) == [12.0, 0.0, 0.0, 0.0]
    assert T.samples([], []) == [] and T.samples([5], [True]) == []


def test_lessons_give_results():
    b = book(words(12), words(40))
    r = T.Reader(b, 100)
    keys = [*words(12), T.ENTER]
    for i, k in enumerate(keys):
        r.key(k, i * 100)
    assert r.results == [((0, 0, 0), (0, 1, 0), len(keys), len(keys), (len(keys) - 1) * 100, "completed")] and r.anchor.start == (0, 1, 0)
    r.key("w", 0)
    r.key("x", 1000)
    assert r.partial(2500) == (2, 1, 2500)
    r.restart()
    assert r.position() == (0, 1, 0) and r.partial(0)[0] == 0
    r.skip()
    assert r.results[-1][5] == "skipped" and r.anchor.start == r.results[-1][1]
    while not r.finished():
        r.skip()
    r.key("w", 0)
    assert r.results[-1][1] == (0, 1, len(words(40)))


def test_opening_books(spark):
    import json

    from lectern.operators import lessons

    text = words(40)
    a = book(text, "tail").anchor((0, 0, 0), 100)
    stored = lambda **k: json.dumps({"signature": "s", "frontier": {"start": a.start, "end": a.end, "target": 100, "version": 1}, "history": [], **k})
    marks = [("kept", 0, 0, 0, "s", stored()), ("snapped", 0, 0, 50, "s", stored()), ("seeded", 0, 0, 130, "s", stored()), ("stale", 0, 0, 0, "other", stored()), ("none", 0, 0, 0, "s", None), ("ended", 0, 1, 4, "s", None), ("empty", 0, 0, 0, "s", None)]
    rows = [(m[0], 0, k, True, "paragraph", "" if m[0] == "empty" else t) for m in marks for k, t in enumerate((text, "tail"))]
    blocks = spark.createDataFrame(rows, "book string, section int, block int, included boolean, kind string, text string")
    got = {r.book: tuple(r)[1:] for r in lessons.opened(blocks, spark.createDataFrame(marks, "book string, section int, block int, char int, signature string, navigation string"), "book", 100).collect()}
    assert got == {"kept": ("kept", 0, 0, 0, 0), "snapped": ("snapped", 0, 0, 0, 0), "seeded": ("seeded", 0, 0, 130, 2), "stale": ("seeded", 0, 0, 0, 0), "none": ("seeded", 0, 0, 0, 0), "ended": ("ended", 0, 1, 4, 0), "empty": ("empty", 0, 0, 0, 0)}


def item(text, x, y, width=None, height=10, place=0):
    return G.Item(text, x, y, width, height, place)


def test_lines_and_columns():
    got = G.lines_of([item("b", 30, 100.4, 10), item("a", 10, 100, 10), item("c", 10, 80, 10), item(" ", 0, 0, 1)])
    assert [line.text for line in got] == ["a b", "c"]
    assert [line.text for line in G.lines_of([item("ab", 0, 0, 10), item("cd", 10.2, 0, 10)])] == ["abcd"]
    page = [item(f"left{k}", 10, 100 - 20 * k, 60) for k in range(3)] + [item(f"right{k}", 300, 100 - 20 * k, 60) for k in range(3)]
    assert [line.text for line in G.lines_of(page)] == ["left0", "left1", "left2", "right0", "right1", "right2"]
    assert G.lines_of([]) == []


def line(text, y, x=0.0, width=None, font=10.0):
    return G.Line(text, x, y, 7.0 * len(text) if width is None else width, font)


def test_paragraphs_of_lines():
    prose = [line("it was a long line of prose that goes", 100), line("on and on to the very end of the", 88), line("page.", 76)]
    assert G.blocks_of(prose) == [("paragraph", " ".join(p.text for p in prose))]
    verse = [line("Roses are red,", 100), line("Violets", 88), line("Sugar is sweet and so on and on", 76)]
    assert G.blocks_of(verse) == [("verse", v.text) for v in verse]
    assert len(G.runs_of([line("a", 100), line("b", 88), line("c", 76), line("d", 40)])) == 2
    assert len(G.runs_of([line("a", 100), line("b", 88, font=20)])) == 2
    assert [len(r) for r in G.runs_of([line("a", 100), line("b", 88), line("c", 76, x=20), line("d", 64)])] == [2, 2]
    assert G.blocks_of([]) == [] and G.height_of(3, 4) == 5
