"""Pages of positioned text: lines, repeated edges, paragraphs, outline ranges. One page or one line is a row's scope."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import names as N
from lectern.plans.stages import folded, folded_tables

# Fixed values.
EDGE, EDGE_LENGTH, LEAST_PAGES, SHARE_OF_PAGES = 2, 120, 3, 0.6
OUTLINE, RANGE = 80, 20
ITEM = (("text", "string"), ("x", "double"), ("y", "double"), ("width", "double"), ("height", "double"), ("place", "long"))
RUN = 64  # words
LINE = "text string, x double, y double, width double, font double"


def _number(value) -> float:
    return math.nan if value is None else value


def page_lines(items: DataFrame, *keys: str, gathered: bool = False) -> DataFrame:
    """keys, line (from 0), text, x, y, width, font of items (keys, place, text, x, y, width, height); a page is a task's unit.

    Items may come as rows or as rows of several (keys, items: an array of the other columns). `gathered`: those of a page
    already lie one after the other in one partition.
    """

    def fold(table, groups):
        if "items" in table.column_names:
            lists = table["items"].combine_chunks()
            groups = np.repeat(groups, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            table = pa.Table.from_arrays(lists.flatten().flatten(), names=[name for name, _ in ITEM])
        numbers = [table[c].combine_chunks() for c in ("x", "y", "width", "height")]
        values = [pc.fill_null(n, math.nan).to_numpy(zero_copy_only=False) for n in numbers]
        # Pages with a number that is missing or none go one by one.
        odd = np.unique(groups[~np.logical_and.reduce([np.isfinite(v) for v in values]) | pc.is_null(table["place"]).to_numpy()])
        text = table["text"].to_numpy().tolist()
        own = np.flatnonzero(~np.isin(groups, odd)) if len(odd) else np.arange(len(groups))
        texts = text if len(own) == len(text) else [text[k] for k in own.tolist()]
        page, *out = G.lines_of_pages(groups[own], texts, *(v[own] for v in values), pc.fill_null(table["place"], 0).to_numpy()[own])
        if not len(odd):
            return page, *out
        made = []
        for g in odd.tolist():
            rows = [(text[k], *(_number(n[k].as_py()) for n in numbers[:2]), numbers[2][k].as_py(), _number(numbers[3][k].as_py()), table["place"][k].as_py()) for k in np.flatnonzero(groups == g).tolist()]
            made += [(g, k, *line) for k, line in enumerate(G.lines_of([G.Item(*r) for r in rows]))]
        more = list(zip(*made, strict=True)) or [()] * (len(out) + 1)
        return np.r_[page, np.array(more[0], int)], *([*a, *b] for a, b in zip(out, more[1:], strict=True))

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "line int", LINE])
    if "items" in items.columns:
        rows = items.select(*keys, F.col("items").cast(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in ITEM)}>>").alias("items"))
    else:
        rows = items.select(*keys, *(F.col(name).cast(kind).alias(name) for name, kind in ITEM))
    return folded_tables(rows, list(keys), fold, schema, gathered)


def page_blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, block (from 0), kind, text of lines (keys, text, x, y, width, font)."""

    def fold(rows):
        return [(k, *block) for k, block in enumerate(G.blocks_of([G.Line(text, *map(_number, own)) for text, *own in rows]))]

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "block int, kind string, text string"])
    return folded(lines.select(*keys, "text", "x", "y", "width", "font"), list(keys), ["y", "x"], fold, schema)


def at_edges(lines: DataFrame, book: str, page: str, line: str) -> DataFrame:
    """Lines with edge: among the first or last two of their page."""
    down, up = (Window.partitionBy(book, page).orderBy(o) for o in (F.col(line), F.col(line).desc()))
    return lines.withColumn("edge", (F.row_number().over(down) <= EDGE) | (F.row_number().over(up) <= EDGE))


def repeated_edges(lines: DataFrame, book: str, page: str) -> DataFrame:
    """book, key, pages: edge keys on enough of the book's pages. Lines come from at_edges()."""
    key = N.edge_key(F.col("text"))
    pages = lines.groupBy(book).agg(F.count_distinct(page).alias("_all"))
    held = lines.filter("edge").select(book, page, key.alias("key")).filter((F.col("key") != "") & (F.length("key") <= EDGE_LENGTH) & ~N.is_edge_number(F.col("key")))
    by = held.distinct().groupBy(book, "key").agg(F.count("*").alias("pages"))
    return by.join(pages, book).filter(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("_all") * SHARE_OF_PAGES))).select(book, "key", "pages")


def without_edges(lines: DataFrame, book: str, page: str, line: str) -> DataFrame:
    """Lines without page numbers and repeated heads and feet at the edges of pages; inside a page they stay."""
    rows = at_edges(lines, book, page, line)
    again = repeated_edges(rows, book, page).select(F.col(book).alias("_b"), F.col("key").alias("_k"))
    rows = rows.filter(~(F.col("edge") & N.is_edge_number(F.col("text"))))
    return rows.join(again, F.col("edge") & (F.col(book) == F.col("_b")) & (N.edge_key(F.col("text")) == F.col("_k")), "left_anti").drop("edge")


def outline_ranges(entries: DataFrame, pages: DataFrame, book: str) -> DataFrame:
    """book, title, start, stop of the outline (book, place, title, page): the first 80 entries, the first of each page, pages before them as their own range."""
    first = entries.withColumn("_r", F.row_number().over(Window.partitionBy(book).orderBy("place"))).filter(F.col("_r") <= OUTLINE)
    first = first.withColumn("title", N.squeezed(F.col("title"))).join(pages.select(book, F.col("pages").alias("_n")), book).filter((F.col("title") != "") & F.col("page").between(0, F.col("_n") - 1))
    one = first.withColumn("_k", F.row_number().over(Window.partitionBy(book, "page").orderBy("place"))).filter("_k = 1")
    opening = one.groupBy(book).agg(F.min("page").alias("least"), F.first("_n").alias("_n")).filter("least > 0").select(book, F.lit("Opening pages").alias("title"), F.lit(0).cast("long").alias("page"), "_n")
    rows = one.select(book, "title", F.col("page").cast("long").alias("page"), "_n").unionByName(opening)
    return rows.select(book, "title", F.col("page").alias("start"), F.coalesce(F.lead("page").over(Window.partitionBy(book).orderBy("page")), F.col("_n")).cast("long").alias("stop"))


def fixed_range(page: Column) -> Column:
    """The range of a page where there is no outline."""
    return F.floor(page / RANGE).cast("long")


# Queries. A document is a page, a source a book; lines get places and words widths by the same rule in both engines.

_PAGE = "concat(upper(source), chr(10), text, case when doc_id % 4 = 0 then '' else concat(chr(10), 'The  FOOT') end, chr(10), cast(doc_id % 3000 as varchar(9)))"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split(F.expr(_PAGE), "\n")).alias("line", "text"))


def edge_artifacts(spark, sf_dir):
    return without_edges(_lines(spark, sf_dir), "source", "doc_id", "line").select("doc_id", F.col("line").cast("long").alias("line"), "text")


def repeated_edge_keys(spark, sf_dir):
    return repeated_edges(at_edges(_lines(spark, sf_dir), "source", "doc_id", "line"), "source", "doc_id")


def _begun(words: Column) -> Column:
    """Where each word begins, a space after each: by runs of words, so that a long line is not copied for every word."""
    begun = lambda sizes, at: F.aggregate(sizes, F.struct(F.array().cast("array<int>").alias("out"), at.alias("at")), lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + n).alias("at")), lambda acc: acc["out"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / RUN).cast("int")), lambda k: F.transform(F.slice(words, k * RUN + 1, RUN), lambda w: F.length(w) + 1))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    return N.once(runs, lambda own: F.flatten(F.zip_with(own, begun(F.transform(own, total), F.lit(0)), begun)))


def lines_of_items(spark, sf_dir):
    """Each word a piece at its own place, rows wavering by less than the slack; the lines come out again."""
    docs = _docs(spark, sf_dir).repartition("doc_id").sortWithinPartitions("doc_id")  # dealt as whole texts; what comes of one stays together
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "said"))

    def pieces(words):
        item = lambda w, k, at: F.struct(w.alias("text"), (at * 7.0).alias("x"), (F.lit(1e6) - F.col("i") * 20 + k % 2).alias("y"), (F.length(w) * 7.0).alias("width"), F.lit(10.0).alias("height"), (F.col("i") * 100_000 + k).cast("long").alias("place"))
        return N.once(_begun(words), lambda begun: F.transform(words, lambda w, k: item(w, k, F.get(begun, k))))

    items = lines.select("doc_id", N.once(F.split("said", " "), pieces).alias("items"))
    return page_lines(items, "doc_id", gathered=True).select("doc_id", F.col("line").cast("long").alias("line"), "text", "x", "width")


def blocks_of_lines(spark, sf_dir):
    """Lines 14 apart, 40 after one that ends a sentence: runs, as prose or verse."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.expr("replace(text, ', ', concat(',', chr(10)))"), "\n")).alias("i", "text")).filter("trim(text) <> ''")
    by = Window.partitionBy("doc_id").orderBy("i")
    step = F.when(N.ends_sentence(F.lag("text").over(by)), 40).otherwise(14)
    rows = rows.withColumn("_s", step).withColumn("y", (1e6 - F.sum("_s").over(by)).cast("double"))
    lines = rows.select("doc_id", "text", F.lit(5.0).alias("x"), "y", (F.length("text") * 7.0).alias("width"), F.lit(10.0).alias("font"))
    return page_blocks(lines, "doc_id").select("doc_id", F.col("block").cast("long").alias("block"), "kind", "text")


def outline(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    entries = docs.select("source", F.col("doc_id").alias("place"), F.when(F.col("doc_id") % 6 == 0, " ").otherwise(F.concat(F.lit("At  "), F.col("doc_id").cast("string"))).alias("title"), (F.col("doc_id") * 7 % 60 + 1).alias("page"))
    return outline_ranges(entries, docs.groupBy("source").agg(F.lit(55).alias("pages")), "source")


def page_medians(spark, sf_dir):
    """Median width of a document's lines and their fixed range of pages."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return rows.groupBy("doc_id").agg(F.median(F.length("text")).alias("median"), F.first(fixed_range(F.col("doc_id"))).alias("range"))


QUERIES = {
    "edge_artifacts": edge_artifacts, "repeated_edge_keys": repeated_edge_keys, "lines_of_items": lines_of_items, "blocks_of_lines": blocks_of_lines, "outline": outline, "page_medians": page_medians,
}

_SQL_EDGES = f"""
    l as (select source, doc_id, unnest(generate_series(0, len(parts) - 1)) as line, len(parts) as n, unnest(parts) as text from (select source, doc_id, string_split({_PAGE}, chr(10)) as parts from documents where text is not null)),
    e as (select *, line < {EDGE} or line >= n - {EDGE} as edge, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as key, regexp_full_match(trim(text), '[0-9]{{1,5}}|[IVXLCDMivxlcdm]{{1,8}}') as number from l),
    r as (select e.source, key, count(distinct doc_id) as pages from e where edge and key <> '' and length(key) <= {EDGE_LENGTH} and not number group by e.source, key
        having count(distinct doc_id) >= greatest({LEAST_PAGES}, ceil((select count(distinct f.doc_id) from l f where f.source = e.source) * {SHARE_OF_PAGES})))
"""

ORACLE_SQL = {
    "edge_artifacts": f"""
        with {_SQL_EDGES} select doc_id, cast(line as bigint) as line, text from e left join r on r.source = e.source and r.key = e.key where not edge or (not number and r.key is null)
    """,
    "repeated_edge_keys": f"with {_SQL_EDGES} select source, key, pages from r",
    "lines_of_items": """
        with l as (select doc_id, unnest(generate_series(0, len(parts) - 1)) as i, unnest(parts) as text from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null))
        select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) as line, trim(regexp_replace(text, ' +', ' ', 'g')) as text,
            7.0 * (length(text) - length(ltrim(text)))::double as x, 7.0 * length(trim(text))::double as width from l where trim(text) <> ''
    """,
    "blocks_of_lines": f"""
        with l as (select doc_id, unnest(generate_series(0, len(parts) - 1)) as i, unnest(parts) as text from (select doc_id, string_split(replace(text, ', ', concat(',', chr(10))), chr(10)) as parts from documents where text is not null)),
        s as (select doc_id, i, text, length(text) as w, regexp_matches(trim(text), '[.!?]["'')\\]]?$') as ends, regexp_matches(trim(text), '^["''(\\[]*[A-Z]') as begins from l where trim(text) <> ''),
        b as (select *, coalesce(lag(ends) over (partition by doc_id order by i), false) as parted, case when lag(ends) over (partition by doc_id order by i) then 40 when lag(ends) over (partition by doc_id order by i) is null then null else 14 end as gap from s),
        m as (select doc_id, coalesce(median(gap), 0) as usual from b group by doc_id),
        r as (select b.*, sum(cast(parted and 40 > greatest(usual * {G.GAP_RATIO}, 10 * {G.GAP_FONTS}) as int)) over (partition by b.doc_id order by i) as run from b join m using (doc_id)),
        g as (select *, max(w) over (partition by doc_id, run) as most, i < max(i) over (partition by doc_id, run) as inside from r),
        a as (select doc_id, run, count(*) as n, max(w) - min(w) > max(w) * {G.RAGGED} as ragged, count(*) filter (where inside and w >= most * {G.WIDE}) / greatest(1.0, count(*) filter (where inside)) as wide,
            count(*) filter (where inside and not ends) / greatest(1.0, count(*) filter (where inside)) as cont, count(*) filter (where begins) / cast(count(*) as double) as cap from g group by doc_id, run),
        k as (select doc_id, run, n, n > 1 and wide >= {G.PROSE_WIDE} and cont >= {G.CONTINUED} and not (n >= 3 and cap >= {G.CAPITALIZED} and (ragged or wide < {G.VERSE_WIDE})) as prose from a),
        o as (select doc_id, min(i) as i, 'paragraph' as kind, string_agg(text, ' ' order by i) as text from g join k using (doc_id, run) where prose group by doc_id, run
            union all select doc_id, i, case when n = 1 then 'paragraph' else 'verse' end, text from g join k using (doc_id, run) where not prose)
        select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) as block, kind, text from o
    """,
    "outline": f"""
        with f as (select source, doc_id, doc_id * 7 % 60 + 1 as page, row_number() over (partition by source order by doc_id) as r from documents where text is not null),
        v as (select *, row_number() over (partition by source, page order by doc_id) as k from f where r <= {OUTLINE} and doc_id % 6 <> 0 and page < 55),
        u as (select source, concat('At ', cast(doc_id as varchar)) as title, page from v where k = 1 union all select source, 'Opening pages', 0 from v group by source having min(page) > 0)
        select source, title, page as start, coalesce(lead(page) over (partition by source order by page), 55) as stop from u
    """,
    "page_medians": f"select doc_id, median(length(text))::double as median, doc_id // {RANGE} as range from (select doc_id, unnest(string_split(text, chr(10))) as text from documents where text is not null) group by doc_id",
}
