"""Repair of raw text before normalization: mojibake, and paragraphs that were flattened into run-on text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.names import ANY_SPACE, any_trim, once

# Sequences that UTF-8 read as CP1252 shows, and the letters of CP1252 by byte.
SIGNATURES = ["â€™", "â€œ", "â€", "â€”", "â€“", "â€˜", "â€¦", "â€¢", "Ã©", "Ã¨", "Ã¤", "Ã¶", "Ã¼", "Ã±", "Ã§", "Ã ", "Ãº", "Ã­", "Â«", "Â»", "Â£", "Â©", "Â®", "Â°"]
CP1252 = {"€": 0x80, "‚": 0x82, "ƒ": 0x83, "„": 0x84, "…": 0x85, "†": 0x86, "‡": 0x87, "ˆ": 0x88, "‰": 0x89, "Š": 0x8A, "‹": 0x8B, "Œ": 0x8C, "Ž": 0x8E, "‘": 0x91, "’": 0x92, "“": 0x93, "”": 0x94, "•": 0x95, "–": 0x96, "—": 0x97, "˜": 0x98, "™": 0x99, "š": 0x9A, "›": 0x9B, "œ": 0x9C, "ž": 0x9E, "Ÿ": 0x9F}
LEAST_HITS, LEAST_DENSITY, PER = 5, 0.5, 10_000
RECOVER_FROM, LEAST_PARAGRAPH = 2000, 40
INDENT = ANY_SPACE.replace("\\s", " \\t\\x0B\\f") + "{2,}"


def mojibake_hits(text: Column) -> Column:
    """Occurrences of all signatures; each is counted by itself."""
    out = F.lit(0)
    for s in SIGNATURES:
        out = out + (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)
    return out.cast("long")


def undone(text: Column) -> Column:
    """Each character as one byte, read as UTF-8; null where a character has no byte or the bytes aren't valid."""
    codes = F.translate(text, "".join(CP1252), "".join(map(chr, CP1252.values())))
    bytes_ = F.when(codes.rlike("^[\\x{00}-\\x{FF}]*$"), F.encode(codes, "ISO-8859-1"))
    return F.regexp_replace(F.try_validate_utf8(bytes_.cast("string")), "^﻿", "")


def garbled_books(blocks: DataFrame, book: str) -> DataFrame:
    """book, hits, garbled: by hits and their density over the book's joined text."""
    by = blocks.groupBy(book).agg(F.sum(mojibake_hits(F.col("text"))).alias("hits"), (F.sum(F.length("text")) + F.count("*") - 1).alias("size"))
    return by.select(book, "hits", ((F.col("hits") >= LEAST_HITS) & (F.col("hits") / F.greatest(F.lit(1.0), F.col("size") / PER) >= LEAST_DENSITY)).alias("garbled"))


def repaired(blocks: DataFrame, book: str, garbled: DataFrame | None = None) -> DataFrame:
    """Blocks with the text of garbled books undone where it can be; `garbled` are these books, if they are known."""
    flags = (garbled_books(blocks, book) if garbled is None else garbled).select(book, "garbled")
    out = blocks.join(flags, book, "inner" if garbled is None else "left")
    return out.withColumn("text", F.when(F.col("garbled"), F.coalesce(undone(F.col("text")), F.col("text"))).otherwise(F.col("text"))).drop("garbled")


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: a long text is cut at runs of two or more spaces, where the piece so far is long enough."""
    gaps, runs = F.split(text, INDENT, -1), F.regexp_extract_all(text, F.lit(f"({INDENT})"), 1)
    steps = F.zip_with(gaps, runs, lambda g, r: F.struct(F.coalesce(g, F.lit("")).alias("said"), r.alias("run")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def step(acc, s):
        last = s["run"].isNull()

        def put(p):
            piece, done = p["piece"], p["done"]
            return F.struct(F.when(done, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"), F.when(done | last, F.lit("")).otherwise(F.concat(piece, s["run"])).alias("now"))

        enough = lambda p: F.length(any_trim(p)) >= F.when(last, 1).otherwise(LEAST_PARAGRAPH)
        return once(once(F.concat(acc["now"], s["said"]), lambda p: F.struct(p.alias("piece"), enough(p).alias("done"))), put)

    cut = F.aggregate(steps, start, step)["out"]
    whole = F.array(text)
    return F.when(F.length(text) >= RECOVER_FROM, once(cut, lambda own: F.when(F.size(own) >= 2, own).otherwise(whole))).otherwise(whole)


def recovered(blocks: DataFrame) -> DataFrame:
    """One row per paragraph, with `part` (from 0) of its block; other columns are kept."""
    rest = [c for c in blocks.columns if c != "text"]
    return blocks.select(*rest, F.posexplode(paragraphs(F.col("text"))).alias("part", "text"))


def repair(blocks: DataFrame, book: str) -> DataFrame:
    """Both repairs, in order."""
    return recovered(repaired(blocks, book))


# Queries. Each accented letter of every third document is planted as its own mojibake; sources are books.

_LETTERS = "éèäöüñç"
_GARBLE = "text"
for _c in _LETTERS:
    _GARBLE = f"replace({_GARBLE}, '{_c}', '{_c.encode().decode('cp1252')}')"
_PLANT = f"case when doc_id % 3 = 0 then {_GARBLE} when doc_id % 3 = 1 then replace(text, ' a', ' â€™a') else text end"
_RUNS = "concat('   ', replace(replace(text, chr(10), '   '), ' e', concat('  ', 'e')))"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _garbled(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source", F.expr(_PLANT).alias("text"))


def mojibake_gate(spark, sf_dir):
    return garbled_books(_garbled(spark, sf_dir), "source")


def mojibake_repair(spark, sf_dir):
    """Documents as books of one block: what was garbled reads as before."""
    return repaired(_garbled(spark, sf_dir).withColumn("book", F.col("doc_id")), "book").select("doc_id", "text")


def paragraph_recovery(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_RUNS).alias("text"))
    return recovered(rows).select("doc_id", "part", "text")


QUERIES = {"mojibake_gate": mojibake_gate, "mojibake_repair": mojibake_repair, "paragraph_recovery": paragraph_recovery}

_SQL_HITS = " + ".join(f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}" for s in SIGNATURES)
_SQL_GATE = f"(hits >= {LEAST_HITS} and hits / greatest(1.0, size / {PER}.0) >= {LEAST_DENSITY})"
_SQL_UNDONE = "t"
for _c in _LETTERS:
    _SQL_UNDONE = f"replace({_SQL_UNDONE}, '{_c.encode().decode('cp1252')}', '{_c}')"

ORACLE_SQL = {
    "mojibake_gate": f"""
        with d as (select source, {_PLANT} as text from documents), h as (select source, cast(sum({_SQL_HITS}) as bigint) as hits, sum(length(text)) + count(*) - 1 as size from d group by source)
        select source, hits, {_SQL_GATE} as garbled from h
    """,
    # Only letters were planted, so putting them back is the repair; a text with letters beyond them stays, as they have no valid bytes.
    "mojibake_repair": f"""
        with d as (select doc_id, {_PLANT} as text from documents), h as (select doc_id, text as t, {_SQL_HITS} as hits, length(text) as size from d)
        select doc_id, case when {_SQL_GATE} and doc_id % 3 = 0 and not regexp_matches({_SQL_UNDONE}, '[^\\x00-\\x7F{_LETTERS}]') then {_SQL_UNDONE}
            when {_SQL_GATE} and doc_id % 3 = 1 and not regexp_matches(replace(t, 'â€™', ''), '[^\\x00-\\x7F]') then replace(t, 'â€™', '’') else t end as text from h
    """,
    # The ends of pieces by a recursive walk over the runs of spaces: a piece ends where it is long enough.
    "paragraph_recovery": f"""
        with recursive d as (select doc_id, {_RUNS} as t from documents),
        g as (select doc_id, t, string_split(regexp_replace(t, ' {{2,}}', chr(1), 'g'), chr(1)) as gaps, regexp_extract_all(t, ' {{2,}}') as runs from d),
        w(doc_id, i, now, piece) as (
            select doc_id, 0, '', cast(null as varchar) from g where length(t) >= {RECOVER_FROM}
            union all
            select w.doc_id, i + 1,
                case when i + 1 = len(gaps) or length(trim(now || gaps[i + 1])) >= {LEAST_PARAGRAPH} then '' else now || gaps[i + 1] || runs[i + 1] end,
                case when (i + 1 = len(gaps) and length(trim(now || gaps[i + 1])) > 0) or (i + 1 < len(gaps) and length(trim(now || gaps[i + 1])) >= {LEAST_PARAGRAPH}) then now || gaps[i + 1] end
            from w join g using (doc_id) where i < len(gaps)
        ),
        p as (select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as part, piece as text, count(*) over (partition by doc_id) as n from w where piece is not null)
        select doc_id, part, text from p where n >= 2
        union all select doc_id, cast(0 as int), t from g where doc_id not in (select doc_id from p where n >= 2)
    """,
}
