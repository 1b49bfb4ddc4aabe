"""Line splitting, normalization to typeable ASCII, noise and spacing rules, vocabulary.

Null text gives no lines. All expressions stay in the JVM; every step is one projection over the exploded lines.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
INVISIBLE = "​‌‍﻿­"
MARKS = "†‡§¶"
SINGLE_QUOTES = "‘’‛′"
DOUBLE_QUOTES = "“”„″«»"
DASHES = "—–‒−"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
LETTERS = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l"}
SPACES = " \t\n\r                 　"


def _folds() -> tuple[dict[str, str], str, dict[str, str]]:
    """By full canonical decomposition: characters with a base of ASCII or of LETTERS (to that base), all marks, and
    characters that decompose into several others, by how many more than one."""
    bases, marks, many = {}, [], {}
    for c in map(chr, range(0x80, 0x30000)):
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
            continue
        if (d := unicodedata.normalize("NFD", c)) != c:
            plain = [x for x in d if unicodedata.category(x)[0] != "M"]
            if len(plain) == 1 and (plain[0].isascii() or plain[0] in LETTERS):
                bases[c] = plain[0]
            elif len(plain) > 1:
                many[len(plain) - 1] = many.get(len(plain) - 1, "") + c
    return bases, "".join(marks), many


_BASES, _MARKS, _MANY = _folds()

# The fixtures hold almost nothing to repair, so these views plant it, by the same SQL in both engines.
DIRTY = """
    case doc_id % 5
        when 0 then replace(text, 'er', 'e­r†')
        when 1 then replace(text, ' a', ' “a’')
        when 2 then replace(text, ', ', ' —… ')
        when 3 then replace(replace(text, 'fi', 'ﬁ'), 'o', 'œ')
        else replace(text, 'n', 'nжø') end
"""


def _tables(accents: bool) -> tuple[str, str, str]:
    """(characters, their replacements one by one, characters that go): all folds that give one character or none."""
    to = dict(zip(SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + SPACES, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(SPACES), strict=True))
    single = {c: plain for c, plain in LETTERS.items() if len(plain) == 1}
    gone = INVISIBLE + MARKS
    if accents:
        to = {c: single.get(base, base) for c, base in _BASES.items()} | single | to
        gone += _MARKS
    return "".join(to), "".join(to.values()), gone


def folded(col: Column, accents: bool = True) -> Column:
    """All folds that come before unsupported characters are counted."""
    known, plain, gone = _tables(accents)
    out = F.translate(col, known + gone, plain)
    longer = LIGATURES | {"…": "..."} | ({c: to for c, to in LETTERS.items() if len(to) > 1} if accents else {})
    some = out.rlike("[" + "".join(longer) + "]")
    long = out
    for c, to in longer.items():
        long = F.replace(long, F.lit(c), F.lit(to))
    return F.when(some, long).otherwise(out)


def _once(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """The column computed in a step of its own, so that later filters don't compute it again."""
    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, F.inline(F.array(F.struct(value.alias(column)))))


def normalized(lines: DataFrame, accents: bool = True) -> DataFrame:
    """Column text normalized to 0x20-0x7E, with `dropped`: the characters that had to go, as they are decomposed."""
    odd = F.col("text").rlike("[^\\x20-\\x7E]")
    more = F.lit(0)
    if accents:
        for extra, chars in _MANY.items():
            more = more + extra * (F.length("text") - F.length(F.translate("text", chars, "")))
        some = "".join(f"\\x{{{ord(min(c)):X}}}-\\x{{{ord(max(c)):X}}}" for c in _MANY.values())
        more = F.when(F.col("text").rlike(f"[{some}]"), more).otherwise(0)
    lines = lines.withColumn("_more", more) if accents else lines.withColumn("_more", F.lit(0))
    lines = _once(lines, "text", F.when(odd, folded(F.col("text"), accents)).otherwise(F.col("text")))
    kept = _once(lines.withColumn("_size", F.length("text")), "text", F.when(F.col("text").rlike("[^\\x20-\\x7E]"), F.regexp_replace("text", "[^\\x20-\\x7E]", "")).otherwise(F.col("text")))
    kept = kept.withColumn("dropped", (F.col("_size") - F.length("text") + F.col("_more")).cast("long"))
    order = [c for c in lines.columns if c != "_more"]
    return _once(kept, "text", F.trim(F.when(F.contains("text", F.lit("  ")), F.regexp_replace("text", "  +", " ")).otherwise(F.col("text")))).select(*order, "dropped")


def lines_of(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, line_index, text: one row per line."""
    return docs.select(*keys, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_index", "text"))


def fix_spacing(col: Column) -> Column:
    """Spaces before , . ; : ! ? go."""
    return F.regexp_replace(col, " +([,.;:!?])", "$1")


def is_page_number(col: Column) -> Column:
    """One to four digits or one to six roman letters."""
    return F.trim(col).rlike("^([0-9]{1,4}|[IVXLCDMivxlcdm]{1,6})$")


def is_noise(col: Column) -> Column:
    """Empty, without letters and digits, a page number, or one character."""
    t = F.trim(col)
    return (F.length(t) <= 1) | ~t.rlike("[A-Za-z0-9]") | is_page_number(col)


def vocabulary(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, word, n: lower-case runs of letters."""
    words = lines.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _dirty(spark, sf_dir, *keys):
    return lines_of(_docs(spark, sf_dir).select("doc_id", *keys, F.expr(DIRTY).alias("text")), "doc_id", *keys)


def text_lines(spark, sf_dir):
    return lines_of(_docs(spark, sf_dir), "doc_id")


def normalized_lines(spark, sf_dir):
    return normalized(_dirty(spark, sf_dir)).filter("text <> ''")


def accent_fold_off(spark, sf_dir):
    return normalized(_dirty(spark, sf_dir), accents=False).filter("text <> ''")


def dropped_char_report(spark, sf_dir):
    rows = normalized(_dirty(spark, sf_dir, "lang"))
    return rows.groupBy("lang").agg(F.sum("dropped").alias("dropped"), F.count_if(F.col("text") == "").alias("empty_lines"))


def vocabulary_by_lang(spark, sf_dir):
    return vocabulary(normalized(lines_of(_docs(spark, sf_dir), "lang")), "lang")


def top_words_by_lang(spark, sf_dir):
    """The 20 commonest words of each language; the rank is a window over counted words only."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return vocabulary_by_lang(spark, sf_dir).withColumn("rank", rank).filter("rank <= 20")


def punctuation_spacing(spark, sf_dir):
    spaced = _docs(spark, sf_dir).select("doc_id", F.expr("replace(replace(text, ',', '  ,'), '.', ' .')").alias("text"))
    return spaced.select("doc_id", fix_spacing(F.col("text")).alias("text"))


def noise_filter(spark, sf_dir):
    """Lines with page numbers, ornaments and single letters planted after each; the planted ones go."""
    planted = _docs(spark, sf_dir).select("doc_id", F.expr("concat(replace(text, chr(10), concat(chr(10), '* * *', chr(10), 'xiv', chr(10))), chr(10), cast(doc_id % 10000 as varchar(9)), chr(10), 'q')").alias("text"))
    return lines_of(planted, "doc_id").filter(~is_noise(F.col("text")))


QUERIES = {
    "text_lines": text_lines, "normalized_lines": normalized_lines, "accent_fold_off": accent_fold_off, "dropped_char_report": dropped_char_report,
    "vocabulary": vocabulary_by_lang, "top_words_by_lang": top_words_by_lang, "punctuation_spacing": punctuation_spacing, "noise_filter": noise_filter,
}


def _sql_lines(source: str, keys: str) -> str:
    """Lines of a select that gives keys and text; the keys must name a row."""
    return f"(select {keys}, unnest(generate_series(0, len(parts) - 1)) as line_index, unnest(parts) as text from (select {keys}, string_split(text, chr(10)) as parts from ({source})))"


def _sql_folded(accents: bool) -> str:
    out = f"translate(text, '{INVISIBLE}{MARKS}', '')"
    for a, b in LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    if accents:
        out = f"strip_accents({out})"
        for a, b in LETTERS.items():
            out = f"replace({out}, '{a}', '{b}')"
    marks = "''" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES)
    out = f"translate({out}, '{SINGLE_QUOTES}{DOUBLE_QUOTES}{DASHES}', '{marks}')"
    return f"translate(replace({out}, '…', '...'), '{SPACES}', '{' ' * len(SPACES)}')"


def _sql_normalized(source: str, keys: str, accents: bool = True) -> str:
    kept = "regexp_replace(f, '[^\\x20-\\x7E]', '', 'g')"
    return f"(select {keys}, line_index, length(f) - length({kept}) as dropped, trim(regexp_replace({kept}, ' +', ' ', 'g')) as text from (select {keys}, line_index, {_sql_folded(accents)} as f from {_sql_lines(source, keys)}))"


_DIRTY = f"select doc_id, lang, {DIRTY} as text from documents"
_WORDS = f"(select lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from {_sql_normalized('select doc_id, lang, text from documents', 'doc_id, lang')})"
_PLANTED = "select doc_id, concat(replace(text, chr(10), concat(chr(10), '* * *', chr(10), 'xiv', chr(10))), chr(10), cast(doc_id % 10000 as varchar), chr(10), 'q') as text from documents"

ORACLE_SQL = {
    "text_lines": f"select doc_id, cast(line_index as int) as line_index, text from {_sql_lines('select doc_id, text from documents', 'doc_id')}",
    "normalized_lines": f"select doc_id, cast(line_index as int) as line_index, text, dropped from {_sql_normalized(_DIRTY, 'doc_id')} where text <> ''",
    "accent_fold_off": f"select doc_id, cast(line_index as int) as line_index, text, dropped from {_sql_normalized(_DIRTY, 'doc_id', False)} where text <> ''",
    "dropped_char_report": f"select lang, cast(sum(dropped) as bigint) as dropped, count(*) filter (where text = '') as empty_lines from {_sql_normalized(_DIRTY, 'doc_id, lang')} group by lang",
    "vocabulary": f"select lang, word, count(*) as n from {_WORDS} group by all",
    "top_words_by_lang": f"select lang, word, n, cast(rank as int) as rank from (select *, row_number() over (partition by lang order by n desc, word) as rank from (select lang, word, count(*) as n from {_WORDS} group by all)) where rank <= 20",
    "punctuation_spacing": "select doc_id, regexp_replace(replace(replace(text, ',', '  ,'), '.', ' .'), ' +([,.;:!?])', '\\1', 'g') as text from documents",
    "noise_filter": f"""
        select doc_id, cast(line_index as int) as line_index, text from {_sql_lines(_PLANTED, 'doc_id')}
        where length(trim(text)) > 1 and regexp_matches(text, '[A-Za-z0-9]') and not regexp_full_match(trim(text), '[0-9]{{1,4}}|[IVXLCDMivxlcdm]{{1,6}}')
    """,
}
