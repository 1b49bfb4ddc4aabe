"""Sections: text books cut at headings, line groups as prose or verse, section kinds, inclusion and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators.scalar import heading_key
from lectern.sources.store import books_with_content

# Fixed values.
STRONG_HEADING = "(?i)^(?:(?:chapter|book|part|section)\\s+(?:[0-9]+|[ivxlcdm]+|[a-z]+)(?:\\s*[:.\\-]\\s*.*|\\s+.*)?|(?:prologue|epilogue|introduction|preface))$"
FRONT = ("cover", "copyright", "contents", "toc", "dedication", "epigraph", "preface", "foreword", "introduction", "translator s note", "translator note", "maps", "map")
BACK = ("notes", "endnotes", "glossary", "index", "bibliography", "appendix", "appendices", "colophon", "about the author", "about author", "ads", "advertisements")
WIDE, PROSE_WIDE, CONTINUED, CAPITALIZED, RAGGED, VERSE_WIDE, VERSE_WIDTH = 0.68, 0.67, 0.5, 0.75, 0.38, 0.75, 62


def is_strong_heading(line: Column) -> Column:
    return N.any_trim(line).rlike(STRONG_HEADING)


def grouped_lines(lines: DataFrame, book: str, order: str = "line_index") -> DataFrame:
    """Lines that say something, with section (0 before the first heading), group and heading: blank lines and headings end a group."""
    by = Window.partitionBy(book).orderBy(order)
    blank = N.any_trim(F.col("text")) == ""
    rows = lines.withColumn("heading", is_strong_heading(F.col("text"))).withColumn("_blank", blank)
    starts = F.col("heading") | F.col("_blank") | F.coalesce(F.lag("heading").over(by), F.lit(False))
    rows = rows.withColumn("section", F.sum(F.col("heading").cast("int")).over(by)).withColumn("group", F.sum(starts.cast("int")).over(by))
    return rows.filter("not _blank").drop("_blank")


def group_kinds(groups: DataFrame, *keys: str, order: str = "line_index") -> DataFrame:
    """keys, lines, kind of each group of lines: paragraph (to be joined) or verse (a block a line)."""
    said = N.any_trim(F.col("text"))
    last = F.max(F.col(order)).over(Window.partitionBy(*keys))
    widest = F.max(F.length(said)).over(Window.partitionBy(*keys))
    rows = groups.select(*keys, F.length(said).alias("w"), (F.col(order) < last).alias("inside"), widest.alias("most"), N.ends_sentence(F.col("text")).alias("ends"), N.begins_uppercase(F.col("text")).alias("begins"))
    n, inside = F.count("*"), F.greatest(F.lit(1), F.count_if("inside"))
    by = rows.groupBy(*keys).agg(
        n.alias("lines"), F.max("w").alias("most"), F.min("w").alias("least"), (F.count_if(F.col("inside") & (F.col("w") >= F.col("most") * WIDE)) / inside).alias("wide"),
        (F.count_if(F.col("inside") & ~F.col("ends")) / inside).alias("continued"), (F.count_if("begins") / n).alias("capitalized"),
    )
    return by.select(*keys, "lines", _group_kind().alias("kind"))


def _group_kind() -> Column:
    """The kind of a group by its lines, most, least, wide, continued, capitalized."""
    ragged = F.col("most") - F.col("least") > F.col("most") * RAGGED
    verse = ((F.col("lines") >= 2) & (F.col("most") < VERSE_WIDTH)) | ((F.col("lines") >= 3) & (F.col("capitalized") >= CAPITALIZED) & (ragged | (F.col("wide") < VERSE_WIDE)))
    prose = (F.col("wide") >= PROSE_WIDE) & (F.col("continued") >= CONTINUED) & ~verse
    return F.when((F.col("lines") <= 1) | prose, "paragraph").otherwise("verse")


def text_blocks(lines: DataFrame, book: str, order: str = "line_index") -> DataFrame:
    """book, section, block (the place of its first line), kind, text: headings, joined paragraphs, lines of verse.

    A group, which a heading is as well, is put together once; it is dealt by its book as its lines are, so these move once.
    """
    said = N.any_trim(F.col("text"))
    line = F.struct(F.col(order).alias("block"), "text", F.length(said).alias("w"), N.ends_sentence(F.col("text")).alias("ends"))
    by = grouped_lines(lines, book, order).groupBy(book, "section", "group").agg(
        F.array_sort(F.collect_list(line)).alias("own"), F.max("heading").alias("heading"), F.count("*").alias("lines"), F.max(F.length(said)).alias("most"), F.min(F.length(said)).alias("least"),
        (F.count_if(N.begins_uppercase(F.col("text"))) / F.count("*")).alias("capitalized"),
    )
    inside = F.slice("own", F.lit(1), F.size("own") - 1)
    share = lambda holds: F.size(F.filter(inside, holds)) / F.greatest(F.lit(1), F.size("own") - 1)
    by = by.withColumn("wide", share(lambda l: l["w"] >= F.col("most") * WIDE)).withColumn("continued", share(lambda l: ~l["ends"]))
    block = lambda at, kind, text: F.struct(at.alias("block"), F.lit(kind).alias("kind"), text.alias("text"))
    each = lambda kind: F.transform("own", lambda l: block(l["block"], kind, l["text"]))
    one = F.array(block(F.get("own", F.lit(0))["block"], "paragraph", F.array_join(F.transform("own", lambda l: N.any_trim(l["text"])), " ")))
    made = F.when(F.col("heading"), each("heading")).when(F.col("lines") == 1, each("paragraph")).when(_group_kind() == "verse", each("verse")).otherwise(one)
    return by.select(book, "section", F.inline(made))


def numbered_sections(blocks: DataFrame, book: str, prefix: str, title: Column) -> DataFrame:
    """book, section, id, title, blocks of sections that hold any: ids count from 1; a heading names its section, else the book does."""
    head = F.min_by(F.when(F.col("kind") == "heading", N.squeezed(F.col("text"))), "block")
    by = blocks.groupBy(book, "section").agg(head.alias("head"), F.count("*").alias("blocks"), F.first(title).alias("_book"))
    order = F.row_number().over(Window.partitionBy(book).orderBy("section"))
    return by.select(book, "section", F.concat(F.lit(f"{prefix}-"), order.cast("string")).alias("id"), F.coalesce(F.when(F.col("head") != "", F.col("head")), F.col("_book")).alias("title"), "blocks")


def at_headings(blocks: DataFrame, book: str, order: str) -> DataFrame:
    """Blocks with section: each heading starts one; those before the first heading have their own (0)."""
    return blocks.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(Window.partitionBy(book).orderBy(order)))


def section_kind(id_: Column, href: Column, title: Column) -> Column:
    """frontmatter, backmatter or body, by whole words; front wins."""
    name, identity = heading_key(title), heading_key(F.concat_ws(" ", id_, href))
    every = heading_key(F.regexp_replace(F.concat_ws(" ", id_, href, title), "['’]", " "))
    holds = lambda text, terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))
    front = name.isin("title", "title page") | holds(identity, ("title", "title page", "titlepage")) | holds(every, FRONT)
    return F.when(front, "frontmatter").when(holds(every, BACK), "backmatter").otherwise("body")


def included(kind: Column, choice: Column | None = None) -> Column:
    """Body sections by default; a reader's choice wins."""
    return kind == "body" if choice is None else F.coalesce(choice, kind == "body")


def runtime_sections(sections: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with chars and typeable: included and with a block that says something."""
    by = blocks.groupBy(*keys).agg(F.sum(F.length("text")).cast("long").alias("chars"))
    rows = sections.join(by, keys, "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return rows.withColumn("typeable", F.col("included") & (F.col("chars") > 0))


def section_steps(sections: DataFrame, book: str, order: str) -> DataFrame:
    """For each section: the book's first included and typeable ones, and the next and previous of either, by place."""
    by = Window.partitionBy(book).orderBy(order)
    after, before, whole = by.rowsBetween(1, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(book)
    out = [F.col(book), F.col(order)]
    for name in ("included", "typeable"):
        at = F.when(F.col(name), F.col(order))
        out += [F.min(at).over(whole).alias(f"first_{name}"), F.min(at).over(after).alias(f"next_{name}"), F.max(at).over(before).alias(f"previous_{name}")]
    return sections.select(*out)


def chars_at(blocks: DataFrame, places: DataFrame, book: str) -> DataFrame:
    """book, chars: characters of included blocks (book, section, block, included, text) before each book's place (section, block, char)."""
    at = places.select(F.col(book).alias("_b"), F.col("section").alias("_s"), F.col("block").alias("_k"), F.col("char").alias("_c"))
    here, there = F.struct("section", "block"), F.struct("_s", "_k")
    own = F.when(here < there, F.length("text")).when(here == there, F.least(F.greatest("_c", F.lit(0)), F.length("text"))).otherwise(0)
    return blocks.filter("included").join(at, F.col(book) == F.col("_b")).groupBy(book).agg(F.sum(own).cast("long").alias("chars"))


def nonspace_index(blocks: DataFrame, book: str) -> DataFrame:
    """Blocks with base: the characters other than spaces of all included blocks before; null for excluded ones."""
    own = F.when(F.col("included"), F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))))
    before = Window.partitionBy(book).orderBy("section", "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("base", F.when(F.col("included"), F.coalesce(F.sum(own).over(before), F.lit(0))).cast("long"))


def nonspace_at(base: Column, text: Column, char: Column) -> Column:
    """Characters other than spaces before a place in a block of nonspace_index(); 0 in an excluded one."""
    inside = F.left(text, F.greatest(F.lit(0), F.least(char, F.length(text))).cast("int"))
    return F.coalesce(base + F.length(F.replace(inside, F.lit(" "), F.lit(""))), F.lit(0)).cast("long")


def merged_contents(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """keys, title of two tables of contents; the newer kind wins where both name a path."""
    a, b = old.select(*keys, F.col("title").alias("_a")), new.select(*keys, F.col("title").alias("_b"))
    return a.join(b, list(keys), "full").select(*keys, F.coalesce("_b", "_a").alias("title"))


def next_blocks(blocks: DataFrame, book: str) -> DataFrame:
    """Blocks that say something, with the next and previous one: the next stays in the own section if that is included.

    The previous one may lie in the own section even if that isn't included.
    """
    rows = blocks.filter("text <> ''").select(book, "section", "block", "included")
    at = F.struct("section", "block")
    by, own = Window.partitionBy(book).orderBy("section", "block"), Window.partitionBy(book, "section").orderBy("block")
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    inside = F.when(F.col("included"), at)
    rows = rows.select(book, "section", "block", F.first(inside, True).over(after).alias("next"), F.last(inside, True).over(upto).alias("_before"), F.lag(at).over(own).alias("_own"))
    return rows.select(book, "section", "block", "next", F.coalesce("_own", "_before").alias("previous"))


# Queries. Blank lines and headings are planted by the same SQL in both engines; conversations are books, their turns sections.

_PLANTED = "concat(case when doc_id % 3 = 0 then '' else concat('Chapter ', cast(doc_id % 9 + 1 as varchar(9)), chr(10)) end, replace(replace(text, '. ', concat('.', chr(10))), ' of ', concat(chr(10), chr(10), 'of ')), chr(10), 'PART IV: End', chr(10), chr(10), 'The end')"


def _lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", "lang", F.posexplode(F.split(F.expr(_PLANTED), "\n")).alias("line_index", "text"))


def line_group_kind(spark, sf_dir):
    rows = grouped_lines(_lines(spark, sf_dir), "doc_id").filter("not heading")
    return group_kinds(rows, "doc_id", "group").select("doc_id", "group", "lines", "kind")


def text_book_blocks(spark, sf_dir):
    return text_blocks(_lines(spark, sf_dir), "doc_id").select("doc_id", F.col("section").cast("long").alias("section"), F.col("block").cast("long").alias("block"), "kind", "text")


def heading_sections(spark, sf_dir):
    blocks = text_blocks(_lines(spark, sf_dir), "doc_id").withColumn("book", F.concat(F.lit("Book "), F.col("doc_id").cast("string")))
    return numbered_sections(blocks, "doc_id", "text", F.col("book")).select("doc_id", "id", "title", "blocks")


_ID = "concat('s', cast(conv_id as varchar(9)))"
_HREF = "case turn % 5 when 0 then 'titlepage.xhtml' when 1 then 'ch_end-notes.html' else 'x.html' end"
_TITLE = "case (conv_id + turn) % 8 when 0 then 'Translator''s Note' when 1 then 'The Index' when 2 then 'About the Author' when 3 then 'Title' when 4 then 'Mapping' when 5 then 'Notes on Maps' else 'One' end"


def _sections(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = section_kind(F.expr(_ID), F.expr(_HREF), F.expr(_TITLE))
    return t.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind")).withColumn("included", included(F.col("kind"), F.when(F.col("turn") == 3, True)))


def section_kinds(spark, sf_dir):
    return _sections(spark, sf_dir).select("conv_id", "turn", "kind", "included")


def contents_list(spark, sf_dir):
    """Readable included sections in order, with their characters, among the counts of the book."""
    rows = _sections(spark, sf_dir)
    run = runtime_sections(rows.drop("text"), rows.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    whole = Window.partitionBy("conv_id")
    run = run.withColumn("readable", F.count_if(F.col("chars") > 0).over(whole)).withColumn("in_all", F.count("*").over(whole))
    return run.filter("typeable").select("conv_id", "turn", "chars", "readable", "in_all").orderBy("conv_id", "turn")


def section_neighbours(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("typeable", F.col("included") & (F.length("text") > 60))
    return section_steps(rows, "conv_id", "turn")


def chars_at_position(spark, sf_dir):
    rows = _sections(spark, sf_dir).select("conv_id", F.col("turn").alias("section"), F.lit(0).alias("block"), "included", "text")
    at = rows.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 6).alias("section"), F.lit(0).alias("block"), F.lit(25).alias("char"))
    return chars_at(rows, at, "conv_id")


def block_neighbours(spark, sf_dir):
    """Sentence-like blocks of each turn, with the ones before and after."""
    rows = _sections(spark, sf_dir).select("conv_id", F.col("turn").alias("section"), "included", F.posexplode(F.split("text", "\\. ")).alias("block", "text"))
    out = next_blocks(rows, "conv_id")
    return out.select("conv_id", "section", F.col("block").cast("long").alias("block"), F.col("next.section").alias("ns"), F.col("next.block").cast("long").alias("nb"), F.col("previous.section").alias("ps"), F.col("previous.block").cast("long").alias("pb"))


def nonspace_positions(spark, sf_dir):
    """The index of each turn and what it says of a place in it."""
    rows = _sections(spark, sf_dir).select("conv_id", F.col("turn").alias("section"), F.lit(0).alias("block"), "included", "text")
    out = nonspace_index(rows, "conv_id")
    return out.select("conv_id", "section", "base", nonspace_at(F.col("base"), F.col("text"), F.col("conv_id") % 30).alias("at"))


def toc_merge(spark, sf_dir):
    rows = _sections(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("Old "), F.col("turn").cast("string")).alias("title"))
    return merged_contents(rows.filter("turn % 3 <> 2"), rows.filter("turn % 2 = 0").withColumn("title", F.lit("New")), "conv_id", "turn")


def books_whole(spark, sf_dir):
    """Documents as books: the facts of some, the content of others; only those with both."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return books_with_content(docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("book_id"), "lang"), docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("book_id"), F.length("text").alias("size")))


QUERIES = {
    "nonspace_positions": nonspace_positions, "toc_merge": toc_merge, "books_whole": books_whole,
    "line_group_kind": line_group_kind, "text_book_blocks": text_book_blocks, "heading_sections": heading_sections, "section_kinds": section_kinds, "contents_list": contents_list,
    "section_neighbours": section_neighbours, "chars_at_position": chars_at_position, "block_neighbours": block_neighbours,
}

_SQL_STRONG = "regexp_matches(trim(text), '" + STRONG_HEADING + "')"
_SQL_GROUPS = f"""
    l as (select doc_id, unnest(generate_series(0, len(parts) - 1)) as i, unnest(parts) as text from (select doc_id, string_split({_PLANTED}, chr(10)) as parts from documents where text is not null)),
    h as (select *, {_SQL_STRONG} as heading, trim(text) = '' as blank from l),
    s as (select *, heading or blank or coalesce(lag(heading) over (partition by doc_id order by i), false) as starts from h),
    r as (select doc_id, i, text, heading, blank, cast(sum(cast(heading as int)) over (partition by doc_id order by i) as bigint) as section, cast(sum(cast(starts as int)) over (partition by doc_id order by i) as bigint) as grp from s),
    g as (select *, length(trim(text)) as w, max(length(trim(text))) over (partition by doc_id, grp) as most, i < max(i) over (partition by doc_id, grp) as inside from r where not blank and not heading),
    a as (select doc_id, grp, count(*) as n, max(w) as most, min(w) as least, count(*) filter (where inside and w >= most * {WIDE}) / greatest(1.0, count(*) filter (where inside)) as wide,
        count(*) filter (where inside and not regexp_matches(trim(text), '[.!?]["'')\\]]?$')) / greatest(1.0, count(*) filter (where inside)) as cont,
        count(*) filter (where regexp_matches(trim(text), '^["''(\\[]*[A-Z]')) / cast(count(*) as double) as cap from g group by doc_id, grp),
    v as (select *, (n >= 2 and most < {VERSE_WIDTH}) or (n >= 3 and cap >= {CAPITALIZED} and (most - least > most * {RAGGED} or wide < {VERSE_WIDE})) as verse from a),
    k as (select doc_id, grp, n, case when n <= 1 or (wide >= {PROSE_WIDE} and cont >= {CONTINUED} and not verse) then 'paragraph' else 'verse' end as kind from v)
"""
_SQL_BLOCKS = """
    b as (select doc_id, section, cast(i as bigint) as block, 'heading' as kind, text from r where heading
        union all select g.doc_id, section, cast(i as bigint), kind, text from g join k using (doc_id, grp) where n = 1 or kind = 'verse'
        union all select g.doc_id, section, cast(min(i) as bigint), 'paragraph', string_agg(trim(text), ' ' order by i) from g join k using (doc_id, grp) where n > 1 and kind = 'paragraph' group by g.doc_id, section, grp)
"""


def _sql_kind() -> str:
    key = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    holds = lambda x, terms: "(" + " or ".join(f"contains(concat(' ', {x}, ' '), ' {t} ')" for t in terms) + ")"
    name, identity = key.format(f"({_TITLE})"), key.format(f"concat({_ID}, ' ', {_HREF})")
    every = key.format(f"replace(concat({_ID}, ' ', {_HREF}, ' ', {_TITLE}), '''', ' ')")
    return f"case when {name} in ('title', 'title page') or {holds(identity, ('title', 'title page', 'titlepage'))} or {holds(every, FRONT)} then 'frontmatter' when {holds(every, BACK)} then 'backmatter' else 'body' end"


_SQL_SECTIONS = f"(select conv_id, turn, text, kind, kind = 'body' or turn = 3 as included from (select conv_id, turn, coalesce(text, '') as text, {_sql_kind()} as kind from conversations))"


def _sql_steps(name: str) -> str:
    at = f"case when {name} then turn end"
    return f"min({at}) over (partition by conv_id) as first_{name}, min({at}) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next_{name}, max({at}) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous_{name}"


ORACLE_SQL = {
    "nonspace_positions": f"""
        with s as (select conv_id, turn, included, text, length(replace(text, ' ', '')) as n from {_SQL_SECTIONS}),
        b as (select *, case when included then cast(coalesce(sum(case when included then n end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) end as base from s)
        select conv_id, turn as section, base, cast(coalesce(base + length(replace(left(text, cast(conv_id % 30 as int)), ' ', '')), 0) as bigint) as at from b
    """.replace(" as at from b", ' as "at" from b'),
    "toc_merge": "select conv_id, turn, case when turn % 2 = 0 then 'New' else concat('Old ', cast(turn as varchar)) end as title from conversations where turn % 3 <> 2 or turn % 2 = 0",
    "books_whole": "select doc_id as book_id, lang, cast(length(text) as int) as size from documents where doc_id % 3 <> 0 and doc_id % 2 = 0",
    "line_group_kind": f'with {_SQL_GROUPS} select doc_id, grp as "group", n as lines, kind from k',
    "text_book_blocks": f"with {_SQL_GROUPS}, {_SQL_BLOCKS} select doc_id, section, block, kind, text from b",
    "heading_sections": f"""
        with {_SQL_GROUPS}, {_SQL_BLOCKS},
        c as (select doc_id, section, count(*) as blocks, min(case when kind = 'heading' then trim(text) end) as head from b group by doc_id, section)
        select doc_id, concat('text-', cast(row_number() over (partition by doc_id order by section) as varchar)) as id, coalesce(head, concat('Book ', cast(doc_id as varchar))) as title, blocks from c
    """,
    "section_kinds": f"select conv_id, turn, kind, included from {_SQL_SECTIONS}",
    "contents_list": f"""
        with s as (select conv_id, turn, included, cast(length(text) as bigint) as chars, count(*) filter (where text <> '') over (partition by conv_id) as readable, count(*) over (partition by conv_id) as in_all from {_SQL_SECTIONS})
        select conv_id, turn, chars, readable, in_all from s where included and chars > 0 order by conv_id, turn
    """,
    "section_neighbours": f"select conv_id, turn, {_sql_steps('included')}, {_sql_steps('typeable')} from (select *, included and length(text) > 60 as typeable from {_SQL_SECTIONS})",
    "chars_at_position": f"""
        select conv_id, cast(sum(case when turn < conv_id % 6 then length(text) when turn = conv_id % 6 then least(25, length(text)) else 0 end) as bigint) as chars from {_SQL_SECTIONS} where included group by conv_id
    """,
    "block_neighbours": f"""
        with b as (select conv_id, turn, included, unnest(generate_series(0, len(parts) - 1)) as block, unnest(parts) as text from (select *, string_split(text, '. ') as parts from {_SQL_SECTIONS})),
        n as (select conv_id, turn, cast(block as bigint) as block, included, row_number() over (partition by conv_id order by turn, block) as k from b where text <> ''),
        j as (select n.conv_id, n.turn, n.block,
            (select min(m.k) from n m where m.conv_id = n.conv_id and m.included and m.k > n.k) as nk,
            coalesce((select max(m.k) from n m where m.conv_id = n.conv_id and m.turn = n.turn and m.k < n.k), (select max(m.k) from n m where m.conv_id = n.conv_id and m.included and m.k < n.k)) as pk from n)
        select j.conv_id, j.turn as section, j.block, a.turn as ns, a.block as nb, p.turn as ps, p.block as pb
        from j left join n a on a.conv_id = j.conv_id and a.k = nk left join n p on p.conv_id = j.conv_id and p.k = pk
    """,
}
