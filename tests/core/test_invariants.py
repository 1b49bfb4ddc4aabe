"""Invariants over generated input: whatever comes in, the plain functions keep their promises."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import geometry as G
from lectern.functions import planner as P
from lectern.functions import typing as T
from lectern.operators.importing import plain_text
from lectern.sources import epub, html, markdown

TAGS = st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<br>", "<b>", "<li>", "<ul>", "</ul>", "<h2>", "</h2>", "<table>", "<td>", "</b>", "text ", "more", " ", "<script>x", "</script>", "&amp;", "<sup>1</sup>", "<!--", "-->"])
KEYS = st.sampled_from([*"ab x", T.ENTER, T.BACKSPACE, T.DELETE_WORD])
BLOCKS = st.lists(st.tuples(st.sampled_from(["paragraph", "verse", "heading"]), st.text(alphabet="ab. ", max_size=90).map(lambda t: " ".join(t.split()))), max_size=12)


@given(st.lists(TAGS, max_size=40))
@settings(max_examples=200, deadline=None)
def test_pages_never_fail_and_say_only_what_they_hold(parts):
    page = "".join(parts)
    for kind, text in html.document(page).blocks:
        assert kind in ("heading", "paragraph", "verse", "blockquote") and text.strip(html.SPACES)
        assert set("".join(text.split())) <= set("textmore1&->")


@given(st.text(alphabet="#*_`>-= \nab[]()1.~", max_size=80))
@settings(max_examples=200, deadline=None)
def test_markdown_never_fails(source):
    html.document(markdown.rendered(source))


@given(st.text(alphabet="ab/.\\%2eF#?", max_size=20))
@settings(max_examples=200, deadline=None)
def test_archive_paths_are_bare(path):
    out = epub.archive_path(path)
    assert not out.startswith("/") and "//" not in out and all(p not in ("", ".", "..") for p in out.split("/")) or out == ""


@given(st.binary(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_bytes_decode(content):
    assert isinstance(plain_text(content), str)


@given(BLOCKS, st.sampled_from([100, 125, 150, 175, 200]))
@settings(max_examples=150, deadline=None)
def test_lessons_tile_a_book(blocks, target):
    book = P.Book([P.Section(True, blocks)])
    chain = book.chain((0, 0, 0), target)
    assert all(a.end == b.start for a, b in zip(chain, chain[1:], strict=False)) and all(map(book.is_valid, chain))
    assert bool(chain) == bool(book.open)
    if chain:
        assert chain[-1].end == (*book.open[-1], len(book.text(book.open[-1])))
    for a in chain:
        assert book.canonical(a.start) == a.start


@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=12).map(str.strip).filter(bool), min_size=1, max_size=3), st.lists(KEYS, max_size=40), st.sampled_from([T.OFF, T.LETTER, T.WORD]))
@settings(max_examples=200, deadline=None)
def test_typing_counts_add_up(blocks, keys, stop):
    s = T.Session(blocks, stop)
    for k in keys:
        s.key(k)
    block, char = s.at
    assert 0 <= block < len(blocks) and 0 <= char <= len(blocks[block]) and 0 <= s.correct <= s.total <= len(keys)
    c = s.counts()
    assert c[T.CORRECT] + c[T.INCORRECT] + c[T.CORRECTED] + c[T.PENDING] == sum(map(len, blocks))
    if stop == T.LETTER:
        assert c[T.INCORRECT] == c[T.CORRECTED] == c["extras"] == 0


@given(st.lists(st.integers(0, 60_000), max_size=20), st.integers(1, 9000))
@settings(max_examples=200, deadline=None)
def test_active_time_is_bounded(times, idle):
    got = T.active_ms(times, idle)
    assert 0 <= got <= min(idle * max(0, len(times) - 1), max(times, default=0) - min(times, default=0) if times else 0)


@given(st.lists(st.tuples(st.text(alphabet="abc", min_size=1, max_size=6), st.integers(0, 400), st.integers(0, 300)), max_size=15))
@settings(max_examples=150, deadline=None)
def test_lines_hold_every_character(pieces):
    items = [G.Item(t, float(x), float(y), 6.0 * len(t), 10.0, k) for k, (t, x, y) in enumerate(pieces)]
    lines = G.lines_of(items)
    assert sorted("".join(line.text for line in lines).replace(" ", "")) == sorted("".join(t for t, _, _ in pieces))
    assert sum(len(r) for r in G.runs_of(lines)) == len(lines)
    assert sorted("".join(t for _, t in G.blocks_of(lines)).replace(" ", "")) == sorted("".join(t for t, _, _ in pieces))
