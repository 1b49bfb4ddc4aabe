"""Queries over names, labels, display strings and small maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators.records import book_format


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# File names built from ids by the same SQL in both engines, as the fixtures hold none.
_NAME = "concat(case page_id % 4 when 0 then 'My_old--book%20no' when 1 then 'A+B_' when 2 then '100%_' else '' end, cast(page_id as varchar(9)), case page_id % 3 when 0 then '.tar.EPUB' when 1 then '.html' else '.xyz' end)"
_SECTION = "concat(case page_id % 3 when 0 then 'chapterOne_part-' when 1 then 'xHTMLNotes' else '_-_' end, case when page_id % 3 = 2 then '' else cast(page_id as varchar(9)) end)"


def file_titles(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.expr(_NAME).alias("name"), F.expr(_SECTION).alias("section"))
    return pages.select("page_id", N.file_title(F.col("name")).alias("title"), N.section_title(F.col("section")).alias("section"))


def supported_files(spark, sf_dir):
    """The predicate over names and MIME types: files of a known format stay."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.expr(_NAME).alias("name"))
    return pages.filter(book_format(F.col("name"), F.when(F.col("page_id") % 5 == 0, "text/plain;x=y")).isNotNull()).select("page_id", "name")


def edge_keys(spark, sf_dir):
    """Line keys and line predicates of page geometry, over the first lines of documents."""
    line = F.concat(F.lit("  "), F.substring_index("text", "\n", 1), F.lit("\t"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    return rows.select("doc_id", N.edge_key(F.col("line")).alias("key"), N.ends_sentence(F.col("line")).alias("ends"), N.begins_uppercase(F.col("line")).alias("begins"), N.is_edge_number(F.col("doc_id").cast("string")).alias("number"))


def raw_trim(spark, sf_dir):
    """Raw text with planted white space at its ends, trimmed and squeezed."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.expr("concat(' 　 ', replace(text, ' a', '   a'), '  ')").alias("text"))
    return rows.select("doc_id", N.trim_class(F.col("text")).alias("trimmed"), N.squeezed(F.col("text")).alias("squeezed"))


def display_labels(spark, sf_dir):
    """Sizes, durations, per cents and a clamped, floored and squared number of each event."""
    wide = F.col("event_id").cast("decimal(19,0)").cast("decimal(38,0)")  # the cube of an id past 2,097,151 is no long
    e = _t(spark, sf_dir, "events").select("event_id", (wide * F.col("event_id") * F.col("event_id")).cast("decimal(38,0)").alias("n"), F.col("value"))
    return e.select(
        "event_id", N.size_label(F.col("n")).alias("size"), N.duration_label(F.col("event_id") * 997).alias("duration"), N.percent_label(F.col("event_id") % 1000 / 7).alias("share"),
        N.percent_done(F.col("event_id"), F.lit(5000)).alias("done"), N.whole(F.col("value") - 20).alias("whole"), N.clamped(F.col("event_id") % 50, 10, 30).alias("clamped"),
        F.round(N.distance(F.col("event_id") % 7, F.col("event_id") % 11), 6).alias("distance"),
    )


def settings_limits(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9 * 25 + 75).alias("length"), (F.col("event_id") % 12).alias("lines"))
    return e.select("event_id", N.lesson_length(F.col("length")).alias("length"), N.visible_lines(F.col("lines")).alias("lines"))


def word_starts(spark, sf_dir):
    """Where the word before a place in each turn begins."""
    t = _t(spark, sf_dir, "conversations").filter("text is not null").withColumn("at", F.col("conv_id") % 40)
    return t.select("conv_id", "turn", N.word_start(F.col("text"), F.col("at").cast("int")).cast("long").alias("start"))


def override_choices(spark, sf_dir):
    """Section choices as maps: one set or cleared, and the touched ones merged. A map is shown as its sorted entries."""
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    flag = lambda k: (F.col("conv_id") + F.lit(k)) % 2 == 0
    ids = [F.lit(f"s{k}") for k in range(3)]
    existing = F.create_map(*[x for k in (0, 1) for x in (ids[k], flag(k))])
    defaults = F.create_map(*[x for k in range(3) for x in (ids[k], F.lit(k != 1))])
    choices = F.create_map(ids[1], F.col("conv_id") % 3 == 0, ids[2], F.col("conv_id") % 5 == 0)
    one = N.with_override(existing, F.lit("s0"), F.col("conv_id") % 3 == 0, F.lit(True))
    many = N.with_choices(existing, defaults, choices, F.array(ids[0], ids[1], F.lit("s9")))
    shown = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return rows.select("conv_id", shown(one).alias("one"), shown(many).alias("many"))


def command_search(spark, sf_dir):
    """Turns as commands: those that hold every term of a query, underscores as spaces, the first 40 by place."""
    t = _t(spark, sf_dir, "conversations").filter("text is not null")
    label = F.replace(F.lower(F.concat_ws(" ", "role", "text")), F.lit("_"), F.lit(" "))
    terms = F.split(F.lit(" ".join("the_USER of".lower().replace("_", " ").split())), " ")
    found = t.withColumn("label", label).filter(F.forall(terms, lambda q: F.contains(F.col("label"), q)))
    return found.select("conv_id", "turn").orderBy("conv_id", "turn").limit(40)


QUERIES = {
    "file_titles": file_titles, "supported_files": supported_files, "edge_keys": edge_keys, "raw_trim": raw_trim, "display_labels": display_labels, "settings_limits": settings_limits,
    "word_starts": word_starts, "override_choices": override_choices, "command_search": command_search,
}

_SQL_SPACES = "[ \\t\\n\\r   -     　]"


def _sql_squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SQL_SPACES}+', ' ', 'g'))"


def _sql_size(n: str) -> str:
    arms = []
    for k in range(4, 0, -1):
        own = f"({n} / {float(1024**k)})"
        tenths = f"cast(floor({own} * 10 + 0.5) as bigint)"
        arms.append(f"when {n} >= {1024**k} then concat(case when {own} >= 10 then cast(cast(floor({own} + 0.5) as bigint) as varchar) else concat(cast({tenths} // 10 as varchar), '.', cast({tenths} % 10 as varchar)) end, ' {N.UNITS[k - 1]}')")
    return f"case {' '.join(arms)} else concat(cast({n} as varchar), ' B') end"


ORACLE_SQL = {
    "file_titles": f"""
        with n as (select page_id, regexp_replace({_NAME}, '\\.[^.]+$', '') as stem, {_SECTION} as section from pages),
        d as (select page_id, section, case when stem like '100%' then stem else url_decode(replace(stem, '+', '%2B')) end as stem from n),
        t as (select page_id, {_sql_squeezed("regexp_replace(stem, '[_-]+', ' ', 'g')")} as title,
            {_sql_squeezed("regexp_replace(regexp_replace(section, '[_-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')")} as section from d)
        select page_id, case when title = '' then 'Untitled book' else title end as title, case when section = '' then 'Untitled section' else section end as section from t
    """,
    "supported_files": f"select page_id, {_NAME} as name from pages where page_id % 3 < 2 or page_id % 5 = 0",
    "edge_keys": f"""
        with l as (select doc_id, {_sql_squeezed("string_split(text, chr(10))[1]")} as line from documents)
        select doc_id, lower(line) as key, regexp_matches(line, '[.!?]["'')\\]]?$') as ends, regexp_matches(line, '^["''(\\[]*[A-Z]') as begins, doc_id < 100000 as number from l
    """,
    "raw_trim": f"""
        with p as (select doc_id, concat(' 　 ', replace(text, ' a', '   a'), '  ') as text from documents)
        select doc_id, regexp_replace(text, '^{_SQL_SPACES}+|{_SQL_SPACES}+$', '', 'g') as trimmed, {_sql_squeezed("text")} as squeezed from p
    """,
    "display_labels": f"""
        with e as (select event_id, event_id * event_id * event_id as n, value, cast(floor(event_id * 997 / 1000.0 + 0.5) as bigint) as s from events)
        select event_id, {_sql_size("n")} as size,
            case when s < 60 then concat(cast(s as varchar), 's') else concat(cast(s // 60 as varchar), 'm ', lpad(cast(s % 60 as varchar), 2, '0'), 's') end as duration,
            concat(cast(cast(floor(event_id % 1000 / 7.0 + 0.5) as bigint) as varchar), '%') as share, cast(least(100, floor(100.0 * event_id / 5000 + 0.5)) as int) as done,
            cast(case when value > 20 then floor(value - 20) else 0 end as bigint) as whole, greatest(10, least(30, event_id % 50)) as clamped,
            round(sqrt((event_id % 7) * (event_id % 7) + (event_id % 11) * (event_id % 11)), 6) as distance
        from e
    """,
    "settings_limits": """
        select event_id, cast(case when event_id % 9 between 1 and 5 then event_id % 9 * 25 + 75 else 100 end as int) as length,
            cast(case when event_id % 12 between 2 and 8 then event_id % 12 else 3 end as int) as lines from events
    """,
    "word_starts": """
        with t as (select conv_id, turn, left(text, cast(conv_id % 40 as int)) as before from conversations where text is not null)
        select conv_id, turn, cast(length(before) - length(string_split(before, ' ')[-1]) as bigint) as start from t
    """,
    "override_choices": """
        with c as (select conv_id, conv_id % 2 = 0 as e0, conv_id % 2 = 1 as e1, conv_id % 3 = 0 as third from conversations group by conv_id)
        select conv_id, concat(case when not third then 's0=false,' else '' end, 's1=', cast(e1 as varchar)) as one, case when third then 's1=true' else '' end as many from c
    """,
    "command_search": """
        select conv_id, turn from (select conv_id, turn, replace(lower(concat_ws(' ', role, text)), '_', ' ') as label from conversations where text is not null)
        where contains(label, 'the') and contains(label, 'user') and contains(label, 'of') order by conv_id, turn limit 40
    """,
}
