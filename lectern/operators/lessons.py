"""Lessons and typing sessions over tables: planning book by book, replaying keys session by session, digests of books.

A book's plan and a session's replay are ordered folds, so one book or one session is a task's unit; books and sessions
are small, and any number of them runs side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import planner as P
from lectern.functions import typing as T
from lectern.plans.stages import folded, written

ANCHORS = "lesson int, start_section long, start_block long, start_char long, end_section long, end_block long, end_char long, target int, version int"
COUNTS = ("total", "right", "block", "char", T.CORRECT, T.INCORRECT, T.CORRECTED, T.PENDING, "extras")


def book_of(rows) -> P.Book:
    """Of rows (section, block, included, kind, text): sections and blocks by their places, none left out."""
    if isinstance(rows, pd.DataFrame):
        rows = rows[["section", "block", "included", "kind", "text"]].itertuples(index=False, name=None)
    by: dict[int, dict] = {}
    for section, block, *own in rows:
        by.setdefault(int(section), {})[int(block)] = own
    sections = []
    for place in range(max(by) + 1):
        own = by.get(place, {})
        blocks = [(own[k][1], own[k][2] or "") if k in own else ("paragraph", "") for k in range(max(own, default=-1) + 1)]
        sections.append(P.Section(bool(own) and bool(own[min(own)][0]), blocks))
    return P.Book(sections)


def last_place(book: P.Book) -> tuple[int, int, int]:
    return (*book.open[-1], len(book.text(book.open[-1]))) if book.open else (0, 0, 0)


def lessons(blocks: DataFrame, book: str, target: int) -> DataFrame:
    """book, ANCHORS: the chain of lessons of each book (book, section, block, included, kind, text; the rows of a section agree on
    included; a null book is one of its own).

    Blocks are dealt by ranges of their order, so a book of any size spreads over tasks. A first pass tells what each range does to a
    lesson in any state; the states at the heads of ranges follow from these; a second pass walks each range from its own.
    At most one book goes on from one range into the next, so the driver meets no more rows than ranges.
    """
    target = P.lesson_target(target)
    steps, kind = P.Steps(target), blocks.schema[book].dataType.simpleString()
    rows = blocks.filter("included and text <> ''").select(F.col(book).alias("book"), F.col("section").cast("long").alias("section"), F.col("block").cast("long").alias("block"), "kind", "text")
    rows = rows.repartitionByRange("book", "section", "block").withColumn("part", F.spark_partition_id())
    rows = written(rows, "ranges")

    # The last book of a range may go on in a later one, and then the first book of that one is the same.
    spans = rows.groupBy(F.col("book").alias("_b")).agg(F.min("part").alias("_first"), F.max("part").alias("_last")).filter("_first < _last")
    spread = rows.join(spans, F.col("book").eqNullSafe(F.col("_b"))).select("book", "section", "block", "kind", "text", "part")

    def through(own):
        made = steps.through(((r[0], r[1]), r[2], r[3]) for r in own)
        return [([own[0][0], own[0][1], 0], [m[0] for m in made], [m[1] for m in made], [m[2] and list(m[2]) for m in made])]

    ways = folded(spread, ["book", "part"], ["section", "block"], through, f"book {kind}, part int, head array<long>, state array<int>, n array<long>, last array<array<long>>")
    # Entries of ranges: one row for each range that begins within a book.
    entries: dict[int, tuple] = {}
    before = None
    for r in ways.orderBy("book", "part").collect():
        state, n, last = (steps.BEGIN, 0, r.head) if before is None or before[0] != r.book else before[1]
        entries[r.part, r.book] = (state, n, last)
        before = (r.book, (r.state[state], n + r.n[state], r.last[state] or last))

    def walk(own):
        key = (own[0][0], own[0][1])
        state, n, last = entries.get(key, (steps.BEGIN, 0, (own[0][2], own[0][3], 0)))
        out = []
        for _, _, section, block, kind_, text in own:
            state, ends = steps.block((section, block), kind_, text)(state)
            for end in ends:
                out.append((n, *last, *end, False))
                n, last = n + 1, end
        out.append((n, *last, own[-1][2], own[-1][3], len(own[-1][5]), True))
        return out

    shape = f"part int, book {kind}, lesson long, start_section long, start_block long, start_char long, end_section long, end_block long, end_char long, rest boolean"
    own = rows.withColumn("_part", F.col("part")).withColumn("_book", F.col("book")).select("part", "book", "_part", "_book", "section", "block", "kind", "text")
    found = folded(own, ["part", "book"], ["section", "block"], walk, shape)
    # What is left at the end of a range counts at the end of the book only.
    found = found.join(spans, F.col("book").eqNullSafe(F.col("_b")), "left").filter("not rest or _b is null or part = _last")
    moves = F.struct("end_section", "end_block", "end_char") > F.struct("start_section", "start_block", "start_char")
    found = found.filter(moves).select(F.col("book").alias(book), F.col("lesson").cast("int").alias("lesson"), "start_section", "start_block", "start_char", "end_section", "end_block", "end_char")
    return found.withColumn("target", F.lit(target)).withColumn("version", F.lit(P.VERSION))


def recent(blocks: DataFrame, frontiers: DataFrame, book: str, target: int, limit: int = P.HISTORY) -> DataFrame:
    """book, ANCHORS: the newest lessons that lead to each book's frontier (book, f_section, f_block, f_char: a canonical place), from the
    start of its section, or of the section before if it stands at that start; the last lesson closes the gap. Numbered from 0."""
    place = lambda x: F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("section", "block", "char")])
    open_ = blocks.filter("included and text <> ''")
    firsts = open_.groupBy(F.col(book).alias("_b"), F.col("section").alias("_s")).agg(F.min("block").alias("_first"))
    own = frontiers.join(firsts, F.col(book).eqNullSafe(F.col("_b")) & (F.col("_s") <= F.col("f_section")))
    by = own.groupBy(book, "f_section", "f_block", "f_char").agg(F.max(F.when(F.col("_s") < F.col("f_section"), F.col("_s"))).alias("_before"), F.min_by("_first", F.struct(F.col("_s") != F.col("f_section"))).alias("_first"))
    begun = F.when((F.col("f_block") == F.col("_first")) & (F.col("f_char") == 0), F.coalesce("_before", F.col("f_section"))).otherwise(F.col("f_section"))
    cut = written(by.select(F.col(book).alias("_book"), *[F.col(f"f_{c}").cast("long").alias(f"f_{c}") for c in ("section", "block", "char")], begun.alias("_from")), "frontiers")
    rows = blocks.join(cut, F.col(book).eqNullSafe(F.col("_book")) & (F.col("section") >= F.col("_from"))).select(blocks["*"])
    chain = lessons(rows, book, target).join(cut, F.col(book).eqNullSafe(F.col("_book")))
    chain = chain.filter(place("start") < place("f"))
    over = place("end") > place("f")
    closed = [F.when(over, F.col(f"f_{c}")).otherwise(F.col(f"end_{c}")).alias(f"end_{c}") for c in ("section", "block", "char")]
    chain = chain.select(book, "lesson", "start_section", "start_block", "start_char", *closed, "target", "version")
    last = chain.groupBy(F.col(book).alias("_b")).agg(F.max("lesson").alias("_last"))
    kept = chain.join(last, F.col(book).eqNullSafe(F.col("_b"))).filter(F.col("lesson") > F.col("_last") - limit)
    return kept.withColumn("lesson", F.col("lesson") - F.greatest(F.lit(0), F.col("_last") - (limit - 1))).drop("_b", "_last")


def canonical_positions(blocks: DataFrame, places: DataFrame, book: str) -> DataFrame:
    """book, place, section, block, char: each place (book, place, section, block, char) where typing can go on."""
    kind = blocks.schema[book].dataType.simpleString()

    def move(rows, own):
        if not len(rows) or not len(own):
            return pd.DataFrame(columns=[book, "place", "section", "block", "char"])
        it = book_of(rows)
        out = [(p.place, *it.canonical((p.section, p.block, p.char))) for p in own.itertuples()]
        return pd.DataFrame([(rows[book].iloc[0], *r) for r in out], columns=[book, "place", "section", "block", "char"])

    left = blocks.select(book, "section", "block", "included", "kind", "text").groupBy(book)
    return left.cogroup(places.select(F.col(book).alias("_b"), "place", "section", "block", "char").groupBy("_b")).applyInPandas(move, f"{book} {kind}, place long, section long, block long, char long")


def usable(book: P.Book, at: tuple, signature: str, navigation: dict | None) -> bool:
    """Is a stored frontier still good: same book text, the place inside it (half-open), and every anchor valid."""
    if not navigation or navigation["signature"] != signature:
        return False
    anchors = [P.Anchor(tuple(a["start"]), tuple(a["end"]), a["target"], a["version"]) for a in (navigation["frontier"], *navigation["history"])]
    return anchors[0].start <= at < anchors[0].end and all(map(book.is_valid, anchors))


def opened(blocks: DataFrame, bookmarks: DataFrame, book: str, target: int) -> DataFrame:
    """What opening each book does to its bookmark (book, section, block, char, signature, navigation as JSON or null).

    book, outcome, section, block, char, history: "kept" where the stored lesson is good and begun at its start, "snapped"
    where the bookmark lay inside it (it moves to the start), "seeded" where a new lesson and history were planned, "ended"
    at the book's end, "empty" without text.
    """
    kind = blocks.schema[book].dataType.simpleString()

    def open_(rows):
        """Rows of a book: (0, section, block, included, kind, text, ...) for blocks, then (1, section, block, ..., char, signature, navigation)."""
        own = [r for r in rows if r[0]]
        if not own:
            return []
        it, out = book_of(r[1:6] for r in rows if not r[0]) if not rows[0][0] else None, []
        for _, section, block, _, _, _, char, signature, navigation in own:
            at, said = (section, block, char), json.loads(navigation) if navigation else None
            if it is None or not it.open:
                out.append(("empty", *at, 0))
            elif usable(it, at, signature, said):
                start = tuple(said["frontier"]["start"])
                out.append(("kept" if at == start else "snapped", *start, len(said["history"])))
            elif at >= last_place(it):
                out.append(("ended", *at, 0))
            else:
                out.append(("seeded", *it.anchor(at, target).start, len(it.recent(at, target))))
        return out

    place = [F.col(c).cast("long").alias(c) for c in ("section", "block")]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    left = blocks.select(book, F.lit(0).alias("_side"), *place, "included", "kind", "text", none("char", "long"), none("signature", "string"), none("navigation", "string"))
    right = bookmarks.select(book, F.lit(1).alias("_side"), *place, none("included", "boolean"), none("kind", "string"), none("text", "string"), F.col("char").cast("long").alias("char"), "signature", "navigation")
    return folded(left.unionByName(right), [book], ["_side", "section", "block"], open_, f"{book} {kind}, outcome string, section long, block long, char long, history long")


def replayed(keys: DataFrame, blocks: DataFrame, session: str, stop: str = T.OFF) -> DataFrame:
    """session and counts after its keys (session, seq, key) over its blocks (session, block, text)."""
    kind = keys.schema[session].dataType.simpleString()

    def run(own, book):
        if not len(book):
            return pd.DataFrame(columns=[session, *COUNTS])
        s = T.Session(list(book.sort_values("block")["text"]), stop)
        for key in own.sort_values("seq")["key"]:
            s.key(key)
        c = s.counts()
        return pd.DataFrame([(book["_s"].iloc[0], *(c[k] for k in COUNTS))], columns=[session, *COUNTS])

    right = blocks.select(F.col(session).alias("_s"), "block", "text").groupBy("_s")
    return keys.select(session, "seq", "key").groupBy(session).cogroup(right).applyInPandas(run, f"{session} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def fnv1a_64(text: Column) -> Column:
    """FNV-1a of 64 bits over code points below 256, as 16 hex digits, in two halves of 32 bits so that nothing overflows."""
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc, char):
        lo = acc["lo"].bitwiseXOR(F.ascii(char).cast("long"))
        low = lo * 435  # the prime is 2^40 + 435
        high = (acc["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(mask)
        return F.struct(high.alias("hi"), low.bitwiseAND(mask).alias("lo"))

    out = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return F.lower(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))


def framed(*values: Column) -> Column:
    """Each value after its length, so that no two lists of values read alike."""
    return F.concat(*[F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"), F.lit(";")) for v in values])


def corpus_signature(blocks: DataFrame, book: str) -> DataFrame:
    """book, signature of what lessons depend on: sections in order, their inclusion, and the kinds and lengths of blocks."""
    own = F.array_sort(F.collect_list(F.struct("block", framed(F.col("kind"), F.length("text")).alias("said"))))
    by = blocks.groupBy(book, "section", "included").agg(F.count("*").alias("n"), own.alias("own"))
    head = framed(F.concat(F.lit("s"), F.col("section").cast("string")), F.col("section"), F.col("included"), F.col("n"))
    said = F.concat(head, F.array_join(F.transform("own", lambda b: b["said"]), ""))
    book_ = by.groupBy(book).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("section", said.alias("said")))).alias("all"))
    whole = F.concat(framed(F.lit("lesson-corpus-v1"), F.col(book), F.col("n")), F.array_join(F.transform("all", lambda s: s["said"]), ""))
    return book_.select(book, fnv1a_64(whole).alias("signature"))


CHUNK = 256  # blocks of a leaf


def tree_digest(blocks: DataFrame, book: str, chunk: int = CHUNK) -> DataFrame:
    """book, digest, blocks of what lessons depend on (book, section, block, included, kind, text), by a tree: blocks to leaves of `chunk`
    places, leaves to sections, sections to the book.

    Each level digests the sorted, framed parts of one below, so a change shows at the top and an edited leaf alone has to be read again.
    No row holds more than a leaf's blocks or a section's leaves; a section of so many leaves that these don't fit a row would
    need another level. Repeated rows count each.
    """
    said = framed(F.coalesce(F.col("kind"), F.lit("")), F.coalesce(F.length("text"), F.lit(0)), F.col("included"), F.coalesce(F.sha2("text", 256), F.lit("")))
    level = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_said").alias("s")))), lambda x: framed(x["o"], x["s"])), ""), 256)
    rows = blocks.select(F.col(book), F.col("section"), F.col("block"), F.floor(F.col("block") / chunk).alias("_leaf"), said.alias("_said"))
    leaves = rows.groupBy(book, "section", "_leaf").agg(level("block").alias("_said"), F.count("*").alias("_n"))
    sections = leaves.groupBy(book, "section").agg(level("_leaf").alias("_said"), F.sum("_n").alias("_n"))
    return sections.groupBy(book).agg(level("section").alias("digest"), F.sum("_n").alias("blocks"))


# Queries. Documents are books of one section and a block a line; conversations are books of a section a turn.

TARGET, REACH = 125, 25


def _books(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", F.lit(0).alias("section"), F.posexplode(F.split("text", "\n")).alias("block", "text"), F.lit(True).alias("included"), F.lit("paragraph").alias("kind"))


def _talks(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select("conv_id", F.col("turn").alias("section"), F.lit(0).alias("block"), ((F.col("conv_id") + F.col("turn")) % 4 != 0).alias("included"), F.when(F.col("turn") == 0, "heading").otherwise("paragraph").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def lesson_chain(spark, sf_dir):
    """All lessons of each document."""
    rows = lessons(_books(spark, sf_dir), "doc_id", TARGET)
    return rows.select("doc_id", F.col("lesson").cast("long").alias("lesson"), "start_block", "start_char", "end_block", "end_char", "target")


def first_lesson(spark, sf_dir):
    rows = lessons(_books(spark, sf_dir), "doc_id", TARGET).filter("lesson = 0")
    return rows.select("doc_id", "end_block", "end_char")


def recent_lessons(spark, sf_dir):
    """The newest lessons before the end of each document: the last 64 of the chain, as the end is the frontier."""
    books = _books(spark, sf_dir)
    last = F.max_by(F.struct(F.col("section").alias("f_section"), F.col("block").alias("f_block"), F.length("text").alias("f_char")), F.struct("section", "block"))
    rows = recent(books, books.filter("text <> ''").groupBy("doc_id").agg(last.alias("l")).select("doc_id", "l.*"), "doc_id", TARGET)
    return rows.select("doc_id", F.col("lesson").cast("long").alias("lesson"), "start_block", "start_char", "end_block", "end_char")


def canonical_places(spark, sf_dir):
    """Places in and beyond each conversation's turns, some of them closed or empty."""
    blocks = _talks(spark, sf_dir)
    places = blocks.select("conv_id", F.col("section").alias("place"), (F.col("section") + F.col("conv_id") % 2).alias("section"), F.lit(0).alias("block"), (F.col("conv_id") * 3 % 50).alias("char"))
    return canonical_positions(blocks, places, "conv_id")


_WRONG = "~"


def replay_turns(spark, sf_dir):
    return _talks(spark, sf_dir).filter("text <> ''").select("conv_id", F.col("section").alias("block"), "text")


def replay_bursts(turns, *kept):
    """conv_id, half (two for a turn, numbered on), typed (an array of seq, key) and the columns `kept`: every turn typed to its end in two bursts, up to its fortieth character
    and after it; each seventh character wrong, put right where its place is even; Enter between turns. Turns are dealt evenly first."""
    dealt = turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id", "block")
    texts = dealt.select("conv_id", "block", *kept, F.length("text").alias("n"), F.filter(F.split("text", ""), lambda c: c != "").alias("chars"))
    parts = F.slice("chars", 1, 40), F.slice("chars", 41, F.greatest(F.col("n"), F.lit(1)))
    halves = texts.select("conv_id", "block", "n", *kept, F.posexplode(F.array(*parts)).alias("part", "chars")).filter("size(chars) > 0")

    def keys(c, i):
        i = i + F.col("part") * 40
        wrong = (i % 7 == 3) & (c != " ")
        own = F.when(wrong & (i % 2 == 0), F.array(F.lit(_WRONG), F.lit(T.BACKSPACE), c)).when(wrong, F.array(F.lit(_WRONG))).otherwise(F.array(c))
        own = F.when(i == F.col("n") - 1, F.concat(own, F.array(F.lit(T.ENTER)))).otherwise(own)
        return F.transform(own, lambda key, k: F.struct((F.col("block").cast("long") * 10**9 + i * 10 + k).alias("seq"), key.alias("key")))

    return halves.select("conv_id", (F.col("block") * 2 + F.col("part")).alias("half"), F.flatten(F.transform("chars", keys)).alias("typed"), *kept)


def typing_replay(spark, sf_dir):
    turns = replay_turns(spark, sf_dir)
    keys = replay_bursts(turns).select("conv_id", F.inline("typed"))
    return replayed(keys, turns, "conv_id").select("conv_id", "total", "right", "block", T.CORRECT, T.INCORRECT, T.CORRECTED, T.PENDING, "extras")


def corpus_digest(spark, sf_dir):
    return corpus_signature(_talks(spark, sf_dir), "conv_id")


def opened_books(spark, sf_dir):
    """Bookmarks of documents with a stored lesson of fifty characters: kept at its start, snapped to it from inside, planned anew beyond it
    or where the text has another signature, ended at the book's end."""
    books = _books(spark, sf_dir)
    first = books.filter("block = 0 and length(text) >= 60").select("doc_id", F.length("text").alias("n"))
    last = books.filter("text <> ''").groupBy("doc_id").agg(F.max_by(F.struct("block", F.length("text").alias("n")), "block").alias("l"))
    char, at_end = F.col("doc_id") % 60, F.col("doc_id") % 7 == 3
    stored = F.lit('{"signature": "s", "frontier": {"start": [0, 0, 0], "end": [0, 0, 50], "target": 100, "version": 1}, "history": []}')
    marks = first.join(last, "doc_id").select("doc_id", F.lit(0).alias("section"), F.when(at_end, F.col("l.block")).otherwise(0).alias("block"), F.when(at_end, F.col("l.n")).otherwise(char).alias("char"),
        F.when(F.col("doc_id") % 5 == 0, "other").otherwise("s").alias("signature"), F.when(F.col("doc_id") % 11 != 0, stored).alias("navigation"))
    return opened(books.join(marks.select("doc_id"), "doc_id", "left_semi"), marks, "doc_id", 100).select("doc_id", "outcome", "block", "char")


def book_digests(spark, sf_dir):
    """Documents as books of a section for each twenty lines, in leaves of eight."""
    rows = _books(spark, sf_dir).withColumn("section", F.floor(F.col("block") / 20)).withColumn("block", F.col("block") % 20)
    return tree_digest(rows, "doc_id", 8)


def word_states(spark, sf_dir):
    """Of each turn's last word: is it right now, was it ever wrong; states are planted by place and letter."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text <> ''")
    states = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c, i: F.when(c == "q", T.PENDING).when(i % 9 == 4, T.INCORRECT).when(i % 9 == 5, T.CORRECTED).otherwise(T.CORRECT))
    n, size = F.length("text"), F.length(F.substring_index("text", " ", -1))
    word = F.slice(states, n - size + 1, size)
    right, wrong = F.forall(word, lambda s: s.isin(T.CORRECT, T.CORRECTED)), F.exists(word, lambda s: s.isin(T.INCORRECT, T.CORRECTED))
    return turns.select("conv_id", "turn", right.alias("right_now"), wrong.alias("ever_wrong"))


QUERIES = {
    "lesson_chain": lesson_chain, "first_lesson": first_lesson, "recent_lessons": recent_lessons, "canonical_places": canonical_places, "typing_replay": typing_replay,
    "corpus_digest": corpus_digest, "book_digests": book_digests, "opened_books": opened_books, "word_states": word_states,
}

# Ends of words and blocks with the characters typed before them; a lesson goes from one to the next that the rules name.
_SQL_CHAIN = f"""
    l as (select doc_id, unnest(generate_series(0, len(parts) - 1)) as b, len(parts) as nb, unnest(parts) as text from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null)),
    f as (select *, coalesce(lead(b) over (partition by doc_id order by b), -1) as nxt from l where text <> ''),
    w as (select doc_id, b, nxt, text, unnest(generate_series(1, len(string_split(text, ' ')))) as k, len(string_split(text, ' ')) as n, unnest(string_split(text, ' ')) as word from f),
    c as (select doc_id, b, k, k = n as at_end, length(word) as size, regexp_matches(word, '[.!?]["''”’)\\]}}]*$') and k < n as ends,
        case when k = n and nxt >= 0 then nxt else b end as eb,
        case when k = n and nxt >= 0 then 0 when k = n then length(text) else sum(length(word) + 1) over (partition by doc_id, b order by k) end as ec from w),
    p as (select *, row_number() over (partition by doc_id order by b, k) as o, sum(size) over (partition by doc_id order by b, k) as typed from c),
    s as (select distinct doc_id, 0 as o, 0 as typed from p union all select doc_id, o, typed from p),
    t as (select s.doc_id, s.o, coalesce(min(case when p.at_end and p.typed <= s.typed + {TARGET + REACH} then p.o end), min(case when p.ends and p.typed <= s.typed + {TARGET + REACH} then p.o end), min(p.o), max(z.last)) as nxt
        from s join (select doc_id, max(o) as last from p group by doc_id) z on z.doc_id = s.doc_id
        left join p on p.doc_id = s.doc_id and p.o > s.o and p.typed >= s.typed + {TARGET} and p.o <= s.o + {TARGET + REACH + 2000} group by s.doc_id, s.o),
    r(doc_id, lesson, o, e) as (
        select doc_id, 0, 0, nxt from t where o = 0
        union all select r.doc_id, lesson + 1, r.e, t.nxt from r join t on t.doc_id = r.doc_id and t.o = r.e where t.nxt > r.e
    ),
    a as (select doc_id, min(b) as b from f group by doc_id),
    x as (select r.doc_id, cast(lesson as bigint) as lesson, cast(coalesce(q.eb, a.b) as bigint) as start_block, cast(coalesce(q.ec, 0) as bigint) as start_char, cast(p.eb as bigint) as end_block, cast(p.ec as bigint) as end_char
        from r join a on a.doc_id = r.doc_id left join p q on q.doc_id = r.doc_id and q.o = r.o join p on p.doc_id = r.doc_id and p.o = r.e)
"""


def _sql_framed(*values: str) -> str:
    return " || ".join(f"cast(length({v}) as varchar) || ':' || {v} || ';'" for v in values)


_SQL_TALKS = "(select conv_id, turn, (conv_id + turn) % 4 <> 0 as included, coalesce(text, '') as text from conversations)"
_SQL_CHARS = "(select conv_id, turn, unnest(generate_series(0, length(text) - 1)) as i, unnest(string_split(text, '')) as c from conversations where text <> '')"

ORACLE_SQL = {
    "lesson_chain": f"with recursive {_SQL_CHAIN} select *, cast({TARGET} as int) as target from x",
    "first_lesson": f"with recursive {_SQL_CHAIN} select doc_id, end_block, end_char from x where lesson = 0",
    "recent_lessons": f"""
        with recursive {_SQL_CHAIN}, n as (select *, max(lesson) over (partition by doc_id) as last from x)
        select doc_id, lesson - greatest(0, last - {P.HISTORY - 1}) as lesson, start_block, start_char, end_block, end_char from n where lesson > last - {P.HISTORY}
    """,
    "canonical_places": f"""
        with t as (select * from {_SQL_TALKS}), o as (select conv_id, turn, length(text) as n from t where included and text <> ''), m as (select conv_id, min(turn) as least from o group by conv_id),
        p as (select conv_id, turn as place, turn + conv_id % 2 as s, conv_id * 3 % 50 as c from t),
        q as (select p.conv_id, place, coalesce(o.turn, least) as s, case when o.turn is null then 0 else c end as c from p left join o on o.conv_id = p.conv_id and o.turn = p.s left join m on m.conv_id = p.conv_id),
        z as (select q.*, o.n, (select min(x.turn) from o x where x.conv_id = q.conv_id and x.turn > q.s) as nxt from q left join o on o.conv_id = q.conv_id and o.turn = q.s)
        select conv_id, place, cast(coalesce(case when c > n and nxt is not null then nxt else s end, 0) as bigint) as section, cast(0 as bigint) as block, cast(coalesce(case when c > n and nxt is not null then 0 else least(c, n) end, 0) as bigint) as char from z
    """,
    "typing_replay": f"""
        with k as (select conv_id, turn, i, c, i % 7 = 3 and c <> ' ' as wrong from {_SQL_CHARS}),
        n as (select conv_id, count(distinct turn) as blocks, count(*) as chars, count(*) filter (where wrong and i % 2 = 0) as fixed, count(*) filter (where wrong and i % 2 = 1) as bad from k group by conv_id)
        select conv_id, chars + fixed + blocks as total, chars - bad + blocks - 1 as "right", blocks - 1 as block, chars - fixed - bad as correct, bad as incorrect, fixed as corrected, cast(0 as bigint) as pending, cast(0 as bigint) as extras from n
    """,
    "corpus_digest": f"""
        with t as (select conv_id, turn, count(*) over (partition by conv_id) as n,
            {_sql_framed("concat('s', cast(turn as varchar))", "cast(turn as varchar)", "cast(included as varchar)", "'1'", "case when turn = 0 then 'heading' else 'paragraph' end", "cast(length(text) as varchar)")} as said from {_SQL_TALKS}),
        b as (select conv_id, {_sql_framed("'lesson-corpus-v1'", "cast(conv_id as varchar)", "cast(max(n) as varchar)")} || string_agg(said, '' order by turn) as s from t group by conv_id),
        h as (select conv_id, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: cast(unicode(c) as hugeint))), lambda a, c: (xor(a, c) * 1099511628211) % 18446744073709551616) as h from b)
        select conv_id, lpad(lower(hex(cast(h as ubigint))), 16, '0') as signature from h
    """,
    "opened_books": """
        with p as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
        b as (select doc_id, unnest(generate_series(0, len(l) - 1)) as block, unnest(l) as text from p),
        e as (select doc_id, max(block) as eb, max_by(length(text), block) as ec from b where text <> '' group by doc_id),
        m as (select e.doc_id, eb, ec, case when e.doc_id % 7 = 3 then eb else 0 end as block, case when e.doc_id % 7 = 3 then ec else e.doc_id % 60 end as c,
            e.doc_id % 5 <> 0 and e.doc_id % 11 <> 0 as fine from e join b on b.doc_id = e.doc_id and b.block = 0 and length(b.text) >= 60),
        o as (select *, fine and block = 0 and c < 50 as usable, block > eb or (block = eb and c >= ec) as ended from m)
        select doc_id, case when usable and c = 0 then 'kept' when usable then 'snapped' when ended then 'ended' else 'seeded' end as outcome, block, case when usable then 0 else c end as "char" from o
    """,
    "book_digests": f"""
        with l as (select doc_id, unnest(generate_series(0, len(parts) - 1)) as i, unnest(parts) as text from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null)),
        b as (select doc_id, i // 20 as section, i % 20 as block, {_sql_framed("'paragraph'", "cast(length(text) as varchar)", "'true'", "sha256(text)")} as said from l),
        f as (select doc_id, section, block // 8 as leaf, count(*) as n, sha256(string_agg({_sql_framed("cast(block as varchar)", "said")}, '' order by block)) as said from b group by all),
        s as (select doc_id, section, sum(n) as n, sha256(string_agg({_sql_framed("cast(leaf as varchar)", "said")}, '' order by leaf)) as said from f group by all)
        select doc_id, sha256(string_agg({_sql_framed("cast(section as varchar)", "said")}, '' order by section)) as digest, cast(sum(n) as bigint) as blocks from s group by doc_id
    """,
    "word_states": """
        with c as (select conv_id, turn, text, length(text) as n, length(string_split(text, ' ')[-1]) as size from conversations where text <> ''),
        e as (select conv_id, turn, n, size, unnest(generate_series(0, n - 1)) as i, unnest(string_split(text, '')) as ch from c),
        w as (select conv_id, turn, case when ch = 'q' then 'pending' when i % 9 = 4 then 'incorrect' when i % 9 = 5 then 'corrected' else 'correct' end as s from e where i >= n - size)
        select c.conv_id, c.turn, coalesce(bool_and(s in ('correct', 'corrected')), true) as right_now, coalesce(bool_or(s in ('incorrect', 'corrected')), false) as ever_wrong from c left join w on w.conv_id = c.conv_id and w.turn = c.turn group by c.conv_id, c.turn
    """,
}
