"""Cleaning of normalized blocks: broken hyphenation, page furniture, verse numbers, oversized blocks.

Blocks have a book, an order within it, a kind (heading, paragraph, verse, blockquote) and a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.bloom import Bloom
from lectern.functions.names import SPACE_CLASS, any_trim, once
from lectern.operators.scalar import heading_key
from lectern.operators.text import is_noise, is_page_number, vocabulary
from lectern.plans.stages import written

# Fixed values.
BREAK = "([A-Za-z]{2,})- ([a-z]{2,})"
SUSPENDED = ("or", "and", "to", "nor", "but")
PAGE_NUMBERS, HEAD_LENGTH = 10, 80
LONGEST, TARGET = 1200, 600
ABBREVIATIONS = (
    "mr mrs ms dr prof st rev hon sr jr capt col gen lt sgt maj adm gov pres vs etc eg ie cf al no vol ch fig jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
VERSE_NUMBER, LEAST_VERSES = f"^([0-9]{{1,4}})[{SPACE_CLASS}]{{2,}}", 3
FOOTNOTE_MARKS = "[†‡§¶]"
# What stands before the mark is looked at only where a mark and what follows it were met.
SENTENCE_END = "([.!?])(?=[\"'”’)\\]]*\\s+[\"'“‘(\\[]*[A-Z0-9])(?<!(?<![A-Za-z])(?i:" + "|".join(ABBREVIATIONS) + "|[a-z]) {0,3}[.!?])([\"'”’)\\]]*)\\s+(?=[\"'“‘(\\[]*[A-Z0-9])"


def held_words(candidates: DataFrame, words: DataFrame, book: str) -> DataFrame:
    """The (book, word) of candidates that the vocabulary holds. Its words pass a Bloom filter of the candidates before they meet
    anything: the filter is on its keys, so it goes below the vocabulary's own aggregation and what isn't asked for isn't shuffled."""
    asked = written(candidates.select(book, "word").distinct(), "asked")
    own = words.filter(Bloom.of(asked).may_hold(book, "word")).select(F.col(book).alias("_b"), F.col("word").alias("_w")).distinct()
    return asked.join(own, F.col(book).eqNullSafe(F.col("_b")) & (F.col("word") == F.col("_w")), "left_semi")


def dehyphenated(blocks: DataFrame, words: DataFrame, book: str, key: str) -> DataFrame:
    """Blocks without hyphens of broken words; `words` is book, word of the vocabulary, `key` names a block.

    A break before or, and, to, nor, but stays; one whose halves make a word of the book is joined; others close the gap.
    """
    breaks = F.coalesce(F.contains("text", F.lit("- ")) & F.col("text").rlike(BREAK), F.lit(False))
    broken, plain = blocks.filter(breaks), blocks.filter(~breaks)  # whole blocks do not move
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(BREAK), 1).alias("a"), F.regexp_extract_all("text", F.lit(BREAK), 2).alias("b"))
    each = broken.select(book, key, F.posexplode(parts).alias("at", "p")).select(book, key, "at", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    each = each.withColumn("word", F.lower(F.concat("a", "b")))
    held = held_words(each.filter(~F.col("b").isin(*SUSPENDED)), words, book).select(F.col(book).alias("_b"), F.col("word").alias("_w"), F.lit(True).alias("held"))
    known = each.join(held, F.col(book).eqNullSafe(F.col("_b")) & (F.col("word") == F.col("_w")), "left")
    put = F.when(F.col("b").isin(*SUSPENDED), F.concat("a", F.lit("- "), "b")).when(F.col("held"), F.concat("a", "b")).otherwise(F.concat("a", F.lit("-"), "b"))
    put = known.select(key, F.struct("at", put.alias("put")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("_puts"))  # at most a block's breaks
    gaps = F.split("text", BREAK, -1)
    mended = F.array_join(F.zip_with(gaps, "_puts", lambda g, p: F.concat(g, F.coalesce(p["put"], F.lit("")))), "")
    done = broken.join(put, key, "left").withColumn("text", F.when(F.col("_puts").isNull(), F.col("text")).otherwise(mended)).drop("_puts")
    return plain.unionByName(done)


def joined_blocks(blocks: DataFrame, words: DataFrame, book: str, section: str, order: str) -> DataFrame:
    """Blocks (book, section, order, kind, text) with a word broken over two of them made whole, in chains.

    Blocks that could join the one before them form islands; only islands of several go on. A block of one unbroken token lengthens the
    word, so its follower may meet the word begun at any earlier token: all these words are looked up at once (at most as many of
    a block as the longest word of the vocabulary has pairs of letters), and a fold over an island's blocks then takes those that count.
    """
    by, text = Window.partitionBy(book, section).orderBy(order), F.col("text")
    # Which blocks could join is told by their ends; only what is found, the islands, meets the blocks.
    ends = blocks.select(book, section, order, "kind", text.rlike("[A-Za-z]{2,}-$").alias("_cut"), text.rlike("^[a-z]{2,}").alias("_goes"))
    may = F.coalesce((F.lag("kind").over(by) == F.col("kind")) & F.lag("_cut").over(by) & F.col("_goes"), F.lit(False))
    ends = ends.select(book, section, order, may.alias("_may")).withColumn("_next", F.coalesce(F.lead("_may").over(by), F.lit(False)))
    ends = ends.withColumn("_island", F.sum((~F.col("_may")).cast("long")).over(by)).filter("_may or _next")
    ends = written(ends.select(F.col(book).alias("_b"), F.col(section).alias("_s"), F.col(order).alias("_o"), "_island"), "islands")
    met = F.col(book).eqNullSafe(F.col("_b")) & F.col(section).eqNullSafe(F.col("_s")) & F.col(order).eqNullSafe(F.col("_o"))
    plain = blocks.join(ends, met, "left_anti").select(book, section, order, "kind", "text")
    marked = written(blocks.join(ends, met).select(book, section, order, "kind", "text", "_island"), "island-blocks")
    block = F.struct(F.col(order).alias("order"), "kind", "text")
    own = marked.groupBy(book, section, "_island").agg(F.array_sort(F.collect_list(block)).alias("bs"))
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    # Of each block: the letters at its end, the ones at its start, and the first block whose word it can go on.
    letters = F.transform("bs", lambda b: F.regexp_extract(b["text"], "([A-Za-z]{2,})-$", 1))
    heads = F.transform("bs", lambda b: F.regexp_extract(b["text"], "^([a-z]{2,})", 1))
    whole = F.transform("bs", lambda b: b["text"].rlike("^[A-Za-z]+-$"))
    own = own.select("*", letters.alias("tails"), heads.alias("heads"), whole.alias("whole"))
    since = F.aggregate(F.sequence(F.lit(0), F.size("bs") - 1), F.array().cast("array<int>"), lambda acc, k: F.concat(acc, F.array(F.when((k < 2) | ~F.get("whole", k - 1), F.greatest(k - 1, F.lit(0))).otherwise(F.get(acc, k - 1)))))
    own = own.withColumn("since", since)
    lowest = lambda k: F.greatest(F.get("since", k), k - F.lit(longest // 2 + 1))
    word = lambda a, k: F.lower(F.concat(F.array_join(F.slice("tails", a + 1, k - a), ""), F.get("heads", k)))
    asked = F.flatten(F.transform(F.sequence(F.lit(1), F.size("bs") - 1), lambda k: F.transform(F.sequence(lowest(k), k - 1), lambda a: F.struct(a.alias("a"), k.alias("k"), word(a, k).alias("word")))))
    asked = own.select(book, section, "_island", F.explode(asked).alias("q")).select(book, section, "_island", "q.a", "q.k", "q.word")
    held = held_words(asked, words, book).select(F.col(book).alias("_b"), F.col("word").alias("_w"))
    met = asked.join(held, F.col(book).eqNullSafe(F.col("_b")) & (F.col("word") == F.col("_w")))
    met = met.groupBy(F.col(book).alias("_b"), F.col(section).alias("_s"), F.col("_island").alias("_i")).agg(F.collect_list(F.struct("a", "k")).alias("met"))
    both = own.join(met, F.col(book).eqNullSafe(F.col("_b")) & F.col(section).eqNullSafe(F.col("_s")) & (F.col("_island") == F.col("_i")), "left")
    begun = F.struct(F.array(F.get("bs", 0)).alias("out"), F.lit(0).alias("a"))

    def step(acc, k):
        here = F.get("bs", k)
        anchor = F.when(F.get("whole", k - 1), acc["a"]).otherwise(k - 1)
        joins = F.coalesce(F.array_contains("met", F.struct(anchor.alias("a"), k.alias("k"))), F.lit(False))
        last = F.element_at(acc["out"], -1)
        longer = F.struct(last["order"].alias("order"), last["kind"].alias("kind"), F.concat(F.substring(last["text"], F.lit(1), F.length(last["text"]) - 1), here["text"]).alias("text"))
        out = F.when(joins, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(longer))).otherwise(F.concat(acc["out"], F.array(here)))
        return F.struct(out.alias("out"), F.when(joins, anchor).otherwise(k).alias("a"))

    done = F.aggregate(F.sequence(F.lit(1), F.size("bs") - 1), begun, step, lambda acc: acc["out"])
    joined = both.select(book, section, F.inline(done)).select(book, section, F.col("order").alias(order), "kind", "text")
    return plain.unionByName(joined)


def page_structured(blocks: DataFrame, book: str) -> DataFrame:
    """book, numbers, structured: books with ten page numbers or more that are no headings."""
    n = F.count_if((F.col("kind") != "heading") & is_page_number(F.col("text")))
    return blocks.groupBy(book).agg(n.alias("numbers")).select(book, "numbers", (F.col("numbers") >= PAGE_NUMBERS).alias("structured"))


def without_noise(blocks: DataFrame) -> DataFrame:
    """Headings stay; others go if empty, without letters and digits, a page number or one character."""
    return blocks.filter((F.col("kind") == "heading") | ~is_noise(F.col("text")))


def without_running_heads(blocks: DataFrame, targets: DataFrame, structured: DataFrame, book: str) -> DataFrame:
    """Blocks of page-structured books without short ones that say a target.

    Targets are book, target (title, author) and may have section: a section's title counts in that section only.
    """
    own = F.col("section") if "section" in targets.columns else F.lit(None)
    keys = targets.filter(F.trim("target") != "").join(structured.filter("structured"), book).select(F.col(book).alias("_b"), heading_key(F.col("target")).alias("_k"), own.alias("_s")).distinct()
    keys = written(keys, "running-heads")  # mostly few, so that blocks need not move to meet them
    says = (F.col(book) == F.col("_b")) & (heading_key(F.col("text")) == F.col("_k")) & (F.col("kind") != "heading") & (F.length("text") <= HEAD_LENGTH)
    if "section" in targets.columns:
        says = says & (F.col("_s").isNull() | (F.col("_s") == F.col("section")))
    return blocks.join(keys, says, "left_anti")


def without_marks(col: Column) -> Column:
    return F.when(col.rlike(FOOTNOTE_MARKS), F.trim(F.regexp_replace(F.regexp_replace(col, FOOTNOTE_MARKS, ""), " {2,}", " "))).otherwise(col)


def without_verse_numbers(blocks: DataFrame, section: str, order: str) -> DataFrame:
    """Raw blocks without leading numbers, where a section has three or more and they strictly ascend; else untouched."""
    number = F.regexp_extract("text", VERSE_NUMBER, 1)
    rows = blocks.withColumn("_n", F.when(number != "", number.cast("int")))
    # The last number before, whatever lies between.
    before = F.last("_n", True).over(Window.partitionBy(section).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_up", F.coalesce(F.col("_n") > before, F.lit(True)))
    whole = Window.partitionBy(section)
    strip = (F.count("_n").over(whole) >= LEAST_VERSES) & F.min("_up").over(whole)
    return rows.withColumn("text", F.when(strip, F.regexp_replace("text", VERSE_NUMBER, "")).otherwise(F.col("text"))).drop("_n", "_up")


def sentences(text: Column) -> Column:
    """Array of sentences; abbreviations and single letters end none."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1$2\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), any_trim), lambda s: s != "")
    return once(parts, lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(text)))


def word_chunks(text: Column, size: int = LONGEST) -> Column:
    """Array of chunks of at most `size`, filled word by word, the space counted; a longer word is cut, its rest goes on."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def flushed(acc):
        return F.when(acc["now"] != "", F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])

    def step(acc, word):
        whole = F.floor(F.length(word) / size).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda k: F.substring(word, (k - 1) * size + 1, F.lit(size)))
        cut = F.struct(F.concat(flushed(acc), pieces).alias("out"), F.substring(word, whole * size + 1, F.length(word)).alias("now"))
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(word) + 1 > size)
        put = F.struct(F.when(full, flushed(acc)).otherwise(acc["out"]).alias("out"), F.when(full | (acc["now"] == ""), word).otherwise(F.concat_ws(" ", acc["now"], word)).alias("now"))
        return F.when(F.length(word) > size, cut).otherwise(put)

    return F.aggregate(F.split(text, " ", -1), start, step, flushed)


def short_blocks(text: Column) -> Column:
    """Array of blocks: up to LONGEST as it is; else sentences filled up to TARGET, the joining space not counted."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def flushed(acc):
        return F.when(acc["now"] != "", F.concat(acc["out"], F.array(F.trim(acc["now"])))).otherwise(acc["out"])

    def step(acc, s):
        alone = F.struct(F.concat(flushed(acc), word_chunks(s)).alias("out"), F.lit("").alias("now"))
        full = (acc["now"] != "") & (F.length(acc["now"]) + F.length(s) > TARGET)
        put = F.struct(F.when(full, flushed(acc)).otherwise(acc["out"]).alias("out"), F.when(full | (acc["now"] == ""), s).otherwise(F.concat_ws(" ", acc["now"], s)).alias("now"))
        return F.when(F.length(s) > LONGEST, alone).otherwise(put)

    split = once(sentences(text), lambda parts: F.when(F.size(parts) < 2, word_chunks(text)).otherwise(F.aggregate(parts, start, step, flushed)))
    return F.when(F.length(text) <= LONGEST, F.array(text)).otherwise(split)


def split_long(blocks: DataFrame) -> DataFrame:
    """One row per block of bearable length, with `part` (from 0); other columns are kept. Blank ones go."""
    rest = [c for c in blocks.columns if c != "text"]
    return blocks.select(*rest, F.posexplode(short_blocks(F.col("text"))).alias("part", "text")).filter(F.trim("text") != "")


# Queries. Defects are planted by the same SQL in both engines; sources are books.

_BROKEN = "replace(replace(replace(text, 'the ', 'th- the '), ' and', ' an- d and'), ' of ', ' off- of or- and ')"
_NUMBERED = "case when i % 3 = 1 or doc_id % 4 = 3 then concat(cast(i * case when doc_id % 5 = 0 then -1 else 1 end + 50 as varchar(9)), '   ', line) else line end"
_HEADED = "concat(text, chr(10), cast(doc_id as varchar(9)), chr(10), upper(source), '!', chr(10), '* * *', chr(10), 'IV')"
_POINTS = "replace(replace(replace(text, ' the ', ' Mr. The '), ' of ', '. Of '), ' and ', '!\" (And ')"
_RUN_ON = "replace(replace(text, chr(10), ' '), '.', case when doc_id % 3 = 0 then '' else '.' end)"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(docs: DataFrame, expr: str = "text") -> DataFrame:
    lines = F.split(F.expr(expr), "\n")
    return docs.select("doc_id", "source", F.posexplode(lines).alias("i", "text")).withColumn("kind", F.lit("paragraph"))


def dehyphenation(spark, sf_dir):
    blocks = _lines(_docs(spark, sf_dir), _BROKEN).withColumn("key", F.concat_ws(":", "doc_id", "i"))
    out = dehyphenated(blocks, vocabulary(blocks, "source"), "source", "key")
    return out.select("doc_id", F.col("i").cast("long").alias("i"), "text")


def hyphen_block_join(spark, sf_dir):
    """Every line cut in two blocks within its fifth word; words of the source's whole lines make them whole again."""
    docs = _docs(spark, sf_dir).filter("text is not null")
    lines = _lines(docs)
    halves = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.when(k == 0, F.concat(F.substring("text", 1, 20), F.lit("-"))).otherwise(F.expr("substring(text, 21)")))
    cut = lines.filter("length(text) > 24").select("source", "doc_id", "i", "kind", F.posexplode(halves).alias("k", "text")).withColumn("o", F.col("i") * 2 + F.col("k"))
    out = joined_blocks(cut, vocabulary(lines, "source"), "source", "doc_id", "o")
    return out.select("doc_id", F.col("o").cast("long").alias("o"), "text")


def page_structure(spark, sf_dir):
    return page_structured(_lines(_docs(spark, sf_dir), _HEADED), "source")


def running_heads(spark, sf_dir):
    """Planted page numbers and heads: the source's name as a block goes, then noise."""
    blocks = _lines(_docs(spark, sf_dir), _HEADED)
    targets = _docs(spark, sf_dir).select("source", F.col("source").alias("target")).distinct()
    out = without_noise(without_running_heads(blocks, targets, page_structured(blocks, "source"), "source"))
    return out.select("doc_id", F.col("i").cast("long").alias("i"), "text")


def verse_number_strip(spark, sf_dir):
    rows = _lines(_docs(spark, sf_dir)).withColumnRenamed("text", "line").withColumn("text", F.expr(_NUMBERED)).drop("line")
    return without_verse_numbers(rows, "doc_id", "i").select("doc_id", F.col("i").cast("long").alias("i"), "text")


def sentence_split(spark, sf_dir):
    """Sentences of each document; one without any has no row."""
    docs = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.expr(_POINTS).alias("text")).filter(any_trim(F.col("text")) != "")
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", F.col("i").cast("long").alias("i"), "sentence")


def long_block_split(spark, sf_dir):
    """Documents as one block each, some without a full stop."""
    docs = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.expr(_RUN_ON).alias("text"))
    return split_long(docs).select("doc_id", F.col("part").cast("long").alias("part"), F.length("text").alias("size"), F.col("text").alias("said"))


def footnote_marks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.expr("replace(replace(text, ' a', ' † a§'), ' b', ' ¶b')").alias("text"))
    return rows.select("doc_id", without_marks(F.col("text")).alias("text"))


QUERIES = {
    "dehyphenation": dehyphenation, "hyphen_block_join": hyphen_block_join, "page_structure": page_structure, "running_heads": running_heads, "verse_number_strip": verse_number_strip,
    "sentence_split": sentence_split, "long_block_split": long_block_split, "footnote_marks": footnote_marks,
}


def _sql_lines(expr: str = "text") -> str:
    return f"(select doc_id, source, unnest(generate_series(0, len(parts) - 1)) as i, unnest(parts) as text from (select doc_id, source, string_split({expr}, chr(10)) as parts from documents))"


def _sql_noise(t: str) -> str:
    return f"(length(trim({t})) <= 1 or not regexp_matches({t}, '[A-Za-z0-9]') or regexp_full_match(trim({t}), '[0-9]{{1,4}}|[IVXLCDMivxlcdm]{{1,6}}'))"


_SQL_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SQL_NUMBERS = f"(select source, count(*) filter (where regexp_full_match(trim(text), '[0-9]{{1,4}}|[IVXLCDMivxlcdm]{{1,6}}')) as numbers from {_sql_lines(_HEADED)} group by source)"
_SQL_WORDS = "(select distinct source, unnest(regexp_extract_all(lower({}), '[a-z]+')) as word from documents)"
# A mark is put before the space, and taken away after an abbreviation or a single letter.
_SQL_SENTENCES = (
    "regexp_replace(regexp_replace({}, '([.!?][\"''”’)\\]]*)(\\s+[\"''“‘(\\[]*[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), "
    f"'(^|[^A-Za-z])((?i:{'|'.join(ABBREVIATIONS)}|[a-z]))( {{{{0,3}}}}[.!?][\"''”’)\\]]*)' || chr(1), '\\1\\2\\3', 'g')"
)

ORACLE_SQL = {
    "dehyphenation": f"""
        with l as (select * from {_sql_lines(_BROKEN)}),
        v as {_SQL_WORDS.format(_BROKEN)},
        m as (select doc_id, source, i, regexp_extract_all(text, '{BREAK}', 1) as a, regexp_extract_all(text, '{BREAK}', 2) as b, regexp_split_to_array(text, '{BREAK}') as gaps from l where regexp_matches(text, '{BREAK}')),
        e as (select doc_id, source, i, unnest(generate_series(1, len(a))) as k, unnest(a) as a, unnest(b) as b, unnest(gaps[1:len(a)]) as gap from m),
        p as (select e.doc_id, e.i, string_agg(gap || case when b in {SUSPENDED} then a || '- ' || b when v.word is not null then a || b else a || '-' || b end, '' order by k) as head
            from e left join v on v.source = e.source and v.word = lower(a || b) group by e.doc_id, e.i)
        select l.doc_id, cast(l.i as bigint) as i, case when head is null then text else head || m.gaps[-1] end as text
        from l left join p on p.doc_id = l.doc_id and p.i = l.i left join m on m.doc_id = l.doc_id and m.i = l.i
    """,
    # Blocks come in pairs here, so each chain is one join.
    "hyphen_block_join": f"""
        with l as (select * from {_sql_lines()} where length(text) > 24),
        h as (select source, doc_id, i, substring(text, 1, 20) as a, substring(text, 21) as b from l),
        f as (select h.doc_id, h.i, a, b, w.word is not null as whole, lag(b) over (partition by h.doc_id order by h.i) as before from h
            left join {_SQL_WORDS.format("text")} w on w.source = h.source and w.word = lower(regexp_extract(a, '([A-Za-z]{{2,}})$', 1) || regexp_extract(b, '^([a-z]{{2,}})', 1))
                and regexp_matches(a, '[A-Za-z]{{2,}}$') and regexp_matches(b, '^[a-z]{{2,}}'))
        select doc_id, cast(i * 2 as bigint) as o, case when whole then a || b else a || '-' end as text from f
        union all select doc_id, cast(i * 2 + 1 as bigint), b from f where not whole
    """,
    "page_structure": f"select source, numbers, numbers >= {PAGE_NUMBERS} as structured from {_SQL_NUMBERS}",
    "running_heads": f"""
        select doc_id, cast(i as bigint) as i, text from {_sql_lines(_HEADED)} l join {_SQL_NUMBERS} n using (source)
        where not (numbers >= {PAGE_NUMBERS} and length(text) <= {HEAD_LENGTH} and {_SQL_KEY.format("text")} = {_SQL_KEY.format("source")}) and not {_sql_noise("text")}
    """,
    "verse_number_strip": f"""
        with r as (select doc_id, i, {_NUMBERED} as text from (select doc_id, i, text as line from {_sql_lines()})),
        n as (select *, try_cast(nullif(regexp_extract(text, '^([0-9]{{1,4}}) {{2,}}', 1), '') as int) as n from r),
        u as (select doc_id, i, n, lag(n) over (partition by doc_id order by i) as before from n where n is not null),
        g as (select doc_id, count(*) >= 3 and bool_and(coalesce(n > before, true)) as strip from u group by doc_id)
        select n.doc_id, cast(n.i as bigint) as i, case when strip then regexp_replace(text, '^[0-9]{{1,4}} {{2,}}', '') else text end as text from n left join g on g.doc_id = n.doc_id
    """,
    "sentence_split": f"""
        with s as (select doc_id, string_split({_SQL_SENTENCES.format(_POINTS)}, chr(1)) as parts from documents where text is not null),
        e as (select doc_id, unnest(generate_series(1, len(parts))) as k, trim(regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g')) as sentence from s)
        select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as bigint) as i, sentence from e where sentence <> ''
    """,
    # A recursive walk over sentences, and over words where a sentence is too long or the only one; a new block where the next doesn't fit.
    "long_block_split": f"""
        with recursive d as (select doc_id, {_RUN_ON} as t from documents where text is not null),
        s as (select doc_id, t, list_filter(list_transform(string_split({_SQL_SENTENCES.format("t")}, chr(1)), lambda x: trim(x)), lambda x: x <> '') as ss from d),
        e as (select doc_id, unnest(generate_series(1, len(ss))) as j, unnest(ss) as s, len(ss) as n from s where length(t) > {LONGEST}),
        i as (
            select doc_id, j, 0 as z, s as x, 0 as g from e where n >= 2 and length(s) <= {LONGEST}
            union all select doc_id, j, unnest(generate_series(1, len(string_split(s, ' ')))), unnest(string_split(s, ' ')), j from e where n < 2 or length(s) > {LONGEST}
        ),
        o as (select doc_id, row_number() over (partition by doc_id order by j, z) as k, x, g from i union all select doc_id, count(*) + 1, cast(null as varchar), -1 from i group by doc_id),
        w(doc_id, k, now, g, piece) as (
            select distinct doc_id, cast(0 as bigint), '', cast(-2 as bigint), cast(null as varchar) from o
            union all
            select o.doc_id, o.k, case when now = '' or o.g <> w.g or length(now) + length(x) + case when o.g > 0 then 1 else 0 end > case when o.g > 0 then {LONGEST} else {TARGET} end then coalesce(x, '') else now || ' ' || x end, o.g,
                case when now <> '' and (o.g <> w.g or length(now) + length(x) + case when o.g > 0 then 1 else 0 end > case when o.g > 0 then {LONGEST} else {TARGET} end) then now end
            from w join o on o.doc_id = w.doc_id and o.k = w.k + 1
        ),
        p as (select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as bigint) as part, piece as said from w where piece is not null)
        select doc_id, part, cast(length(said) as int) as size, said from p
        union all select doc_id, cast(0 as bigint), cast(length(t) as int), t from s where length(t) <= {LONGEST} and trim(t) <> ''
    """,
    "footnote_marks": f"""
        with d as (select doc_id, replace(replace(text, ' a', ' † a§'), ' b', ' ¶b') as t from documents)
        select doc_id, case when regexp_matches(t, '{FOOTNOTE_MARKS}') then trim(regexp_replace(regexp_replace(t, '{FOOTNOTE_MARKS}', '', 'g'), ' {{2,}}', ' ', 'g')) else t end as text from d
    """,
}
