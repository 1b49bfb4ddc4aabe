"""Session statistics, neighbours, inclusion and the merge of progress records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = {"epub": "epub", "pdf": "pdf", "txt": "txt", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html"}
MIME_TYPES = {
    "application/epub+zip": "epub", "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "markdown",
    "text/x-markdown": "markdown", "text/html": "html", "application/xhtml+xml": "html",
}
VERSE_WIDTH = 90


def wpm(chars: Column, millis: Column) -> Column:
    """Five characters are a word; 0 without characters or time."""
    return F.when((chars > 0) & (millis > 0), chars / 5.0 / (millis / 60000.0)).otherwise(0.0)


def accuracy(correct: Column, total: Column) -> Column:
    """Per cent, 0 to 100; 100 without keystrokes."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * correct / total))).otherwise(100.0)


def consistency(n: Column, mean: Column, deviation: Column) -> Column:
    """100 * (1 - population deviation / mean), 0 to 100; none: 0, one or mean 0: 100."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1 - deviation / mean)))
    return F.when(n == 0, 0.0).when((n == 1) | (mean == 0), 100.0).otherwise(score)


def book_format(name: Column, mime: Column) -> Column:
    """By extension first, then by MIME type without its parameters; null if neither is known."""
    tables = [F.create_map(*(F.lit(x) for pair in t.items() for x in pair)) for t in (EXTENSIONS, MIME_TYPES)]
    extension = F.regexp_extract(F.lower(F.trim(name)), "\\.([^.]+)$", 1)
    kind = F.trim(F.substring_index(F.lower(F.coalesce(mime, F.lit(""))), ";", 1))
    return F.coalesce(F.try_element_at(tables[0], extension), F.try_element_at(tables[1], kind))


def merge_progress(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One record a key: position of the newer (ties: left), counters by their maxima."""
    l, r = (d.select(F.col(key), F.struct("updated_at", "position", "chars", "best").alias(s)) for d, s in ((left, "l"), (right, "r")))
    both = l.join(r, key, "full")
    newer = F.when(F.col("r").isNull() | (F.col("l.updated_at") >= F.col("r.updated_at")), F.col("l")).otherwise(F.col("r"))
    return both.select(key, newer["updated_at"].alias("updated_at"), newer["position"].alias("position"), F.greatest("l.chars", "r.chars").alias("chars"), F.greatest("l.best", "r.best").alias("best"))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def session_stats(spark, sf_dir):
    """A user's events as keystrokes; those of type error are wrong; each takes a second."""
    by = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("typed"), F.count_if(F.col("event_type") != "error").alias("correct"))
    return by.select("user_id", "typed", "correct", F.round(wpm(F.col("correct"), F.col("typed") * 1000), 6).alias("wpm"), F.round(accuracy(F.col("correct"), F.col("typed")), 6).alias("accuracy"))


def consistency_by_user(spark, sf_dir):
    """Over a user's daily event counts."""
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    by = days.groupBy("user_id").agg(F.count("*").alias("samples"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("dev"))
    return by.select("user_id", "samples", F.round(consistency(F.col("samples"), F.col("mean"), F.col("dev")), 6).alias("consistency"))


def sessions_by_gap(spark, sf_dir, gap: str = "30 minutes"):
    """Sessions that end after half an hour without events."""
    events = _events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return rows.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


def progress_merge(spark, sf_dir):
    """Events of even ids are one device, those of odd ids another."""
    events = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    halves = [events.filter(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max("us").alias("updated_at"), F.max_by("event_id", "us").alias("position"), F.count("*").alias("chars"), F.max("value").alias("best")) for k in (0, 1)]
    return merge_progress(*halves, "user_id")


def included_chars(spark, sf_dir):
    """Characters by source, with labels as overrides of the default, which takes English."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "lang", "source", F.length("text").alias("chars")).join(labels.select("doc_id", "quality"), "doc_id", "left")
    included = F.coalesce(F.col("quality") == 1, F.col("lang") == "en")
    return rows.groupBy("source").agg(F.sum(F.when(included, F.col("chars")).otherwise(0)).alias("chars"), F.count_if(included).alias("included"))


def section_verse_share(spark, sf_dir):
    """A conversation is verse when over half of its turns are narrow."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null")
    narrow = F.count_if(F.length(F.trim("text")) < VERSE_WIDTH)
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), narrow.alias("narrow"), F.when(narrow * 2 > F.count("*"), "verse").otherwise("paragraph").alias("kind"))


def neighbours(spark, sf_dir):
    """The turns with text before and after each turn with text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text <> ''")
    by = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.lag("turn").over(by).alias("previous"), F.lead("turn").over(by).alias("next"))


def weighted_route_totals(spark, sf_dir):
    """Mean value of a user's event types, weighted by their counts, and the peak."""
    kinds = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return kinds.groupBy("user_id").agg(F.sum("n").alias("events"), F.round(F.sum(F.col("n") * F.col("value")) / F.sum("n"), 6).alias("weighted"), F.round(F.max("value"), 6).alias("peak"))


def format_detection(spark, sf_dir):
    """Page ids as file names of seven shapes, with a MIME type for some."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    name = F.concat(F.lit("Book"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".EPUB", ".pdf", ".txt", ".md", ".htm", ".bin", ""))), (F.col("page_id") % 7 + 1).cast("int")))
    mime = F.when(F.col("page_id") % 2 == 0, F.lit("Text/HTML; charset=utf-8"))
    return pages.select("page_id", book_format(name, mime).alias("format"))


QUERIES = {
    "session_stats": session_stats, "consistency": consistency_by_user, "sessions_by_gap": sessions_by_gap, "progress_merge": progress_merge, "included_chars": included_chars,
    "section_verse_share": section_verse_share, "neighbours": neighbours, "weighted_route_totals": weighted_route_totals, "format_detection": format_detection,
}


def _half(k: int) -> str:
    return f"(select user_id, max(epoch_us(ts)) as updated_at, max_by(event_id, ts) as position, count(*) as chars, max(value) as best from events where event_id % 2 = {k} group by user_id)"


ORACLE_SQL = {
    "session_stats": """
        select user_id, typed, correct, round(case when correct > 0 then correct / 5.0 / (typed / 60.0) else 0 end, 6) as wpm, round(100.0 * correct / typed, 6) as accuracy
        from (select user_id, count(*) as typed, count(*) filter (where event_type <> 'error') as correct from events group by user_id)
    """,
    "consistency": """
        select user_id, samples, round(case when samples = 1 or mean = 0 then 100 else greatest(0, least(100, 100 * (1 - dev / mean))) end, 6) as consistency from
        (select user_id, count(*) as samples, avg(n) as mean, stddev_pop(n) as dev from (select user_id, cast(ts as date) as day, count(*) as n from events group by all) group by user_id)
    """,
    "sessions_by_gap": """
        with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
        s as (select *, sum(new) over (partition by user_id order by ts) as session from g)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as events from s group by user_id, session
    """,
    "progress_merge": f"""
        select user_id, case when r.user_id is null or l.updated_at >= r.updated_at then l.updated_at else r.updated_at end as updated_at,
            case when r.user_id is null or l.updated_at >= r.updated_at then l.position else r.position end as position,
            greatest(l.chars, r.chars) as chars, greatest(l.best, r.best) as best
        from {_half(0)} l full join {_half(1)} r using (user_id)
    """,
    "included_chars": """
        select source, cast(sum(case when included then length(text) else 0 end) as bigint) as chars, count(*) filter (where included) as included
        from (select source, text, coalesce(quality = 1, lang = 'en') as included from documents left join labels using (doc_id)) group by source
    """,
    "section_verse_share": f"""
        select conv_id, turns, narrow, case when narrow * 2 > turns then 'verse' else 'paragraph' end as kind
        from (select conv_id, count(*) as turns, count(*) filter (where length(trim(text)) < {VERSE_WIDTH}) as narrow from conversations where text is not null group by conv_id)
    """,
    "neighbours": """
        select conv_id, turn, lag(turn) over w as previous, lead(turn) over w as next from conversations where text <> ''
        window w as (partition by conv_id order by turn)
    """,
    "weighted_route_totals": """
        select user_id, cast(sum(n) as bigint) as events, round(sum(n * value) / sum(n), 6) as weighted, round(max(value), 6) as peak
        from (select user_id, event_type, count(*) as n, avg(value) as value from events group by all) group by user_id
    """,
    "format_detection": """
        select page_id, case page_id % 7 when 0 then 'epub' when 1 then 'pdf' when 2 then 'txt' when 3 then 'markdown' when 4 then 'html'
            else case when page_id % 2 = 0 then 'html' end end as format from pages
    """,
}
