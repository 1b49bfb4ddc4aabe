"""Import: files of any supported format to raw blocks, and raw blocks to clean ones.

Files are rows (path, content), as the binaryFile source reads them. Raw blocks have book, section, block, kind, text;
a book's facts and its sections' names come beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators import clean, geometry, repair, text
from lectern.operators.records import book_format
from lectern.operators.sections import included, numbered_sections, section_kind, text_blocks
from lectern.plans.stages import written
from lectern.sources import epub, html, markdown, pdf

PARSED = (
    "book string, path string, title string, author string, language string, failed string, "
    "sections array<struct<id: string, href: string, title: string, blocks: array<struct<kind: string, text: string>>>>, warnings array<struct<code: string, section: string>>"
)


def content_id(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a file's bytes."""
    return F.substring(F.sha2(content, 256), 1, 16)


def plain_text(content: bytes) -> str:
    """By byte order mark, else UTF-8, else windows-1252 with its undefined bytes as control characters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in content)


def decoded(content) -> Column:
    """The text of a file's bytes."""

    @F.arrow_udf("string")
    def run(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else plain_text(c) for c in content.to_pylist()], pa.string())

    return run(content)


def at_headings(blocks: list[tuple[str, str]], prefix: str, title: str) -> list[dict]:
    """Sections of a page: each heading begins one, what comes before has the page's title; a page without blocks has one, empty."""
    out: list[dict] = []
    for kind, raw in blocks:
        if kind == "heading" or not out:
            out.append({"title": (html.squeezed(raw) if kind == "heading" else "") or title, "blocks": []})
        out[-1]["blocks"].append({"kind": kind, "text": raw})
    out = out or [{"title": title, "blocks": []}]
    return [{"id": f"{prefix}-{k + 1}", "href": f"#{prefix}-{k + 1}", **s} for k, s in enumerate(out)]


def structured(files: DataFrame) -> DataFrame:
    """PARSED rows of HTML, Markdown and EPUB files (path, content, format, title); a file that can't be read says why in `failed`."""

    def one(kind: str, content: bytes, title: str) -> dict:
        if kind == "epub":
            b = epub.book(content, title)
            sections = [{"id": s.id, "href": s.href, "title": s.title, "blocks": [{"kind": k, "text": t} for k, t in s.blocks]} for s in b.sections]
            return {"title": b.title, "author": b.author, "language": b.language, "sections": sections, "warnings": [{"code": c, "section": s} for c, s in b.warnings]}
        source = plain_text(content)
        page = html.document(markdown.rendered(source) if kind == "markdown" else source, title)
        warnings = [{"code": "verse-numbers-stripped", "section": None}] if page.stripped else []
        return {"title": page.title, "author": page.author, "language": page.language, "sections": at_headings(page.blocks, kind, page.title), "warnings": warnings}

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                row = {"book": r.book, "path": r.path, "failed": None}
                try:
                    row |= one(r.format, r.content, r.title)
                except ValueError as e:
                    row |= {"title": r.title, "author": None, "language": None, "sections": [], "warnings": [], "failed": str(e)}
                out.append(row)
            yield pd.DataFrame(out, columns=["book", "path", "title", "author", "language", "failed", "sections", "warnings"])

    return files.select("book", "path", "content", "format", "title").mapInPandas(run, PARSED)


PDF_ITEMS = "book string, page int, place long, text string, x double, y double, width double, height double"
ITEMS = 5000  # of many pages go on together
PDF_FACTS = "book string, path string, title string, author string, pages int, failed string, outline array<struct<title: string, page: int>>"


def pdf_facts(files: DataFrame) -> DataFrame:
    """PDF_FACTS of PDF files (book, path, content, title)."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    own = pdf.read(r.content)
                    out.append((r.book, r.path, own.title or r.title, own.author or None, len(own.pages), None, [{"title": t, "page": k} for t, k in own.outline]))
                except ValueError as e:
                    out.append((r.book, r.path, r.title, None, 0, str(e), []))
            yield pd.DataFrame(out, columns=["book", "path", "title", "author", "pages", "failed", "outline"])

    return files.select("book", "path", "content", "title").mapInPandas(run, PDF_FACTS)


def pdf_items(files: DataFrame) -> DataFrame:
    """PDF_ITEMS of PDF files that can be read: each shown string with its place."""

    def run(batches):
        names, out = ["book", "page", "place", "text", "x", "y", "width", "height"], []
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    own = pdf.read(r.content)
                except ValueError:
                    continue
                for k, page in enumerate(own.pages):
                    out += [(r.book, k, i, *item) for i, item in enumerate(page.items)]
                    if len(out) >= ITEMS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return files.select("book", "content").mapInPandas(run, PDF_ITEMS)


def pdf_sections(facts: DataFrame) -> DataFrame:
    """book, title, start, stop (pages): by the outline, else twenty pages each, a short book as one."""
    known = facts.filter("failed is null and pages > 0")
    entries = known.select("book", F.posexplode("outline").alias("place", "o")).select("book", "place", "o.title", "o.page")
    named = geometry.outline_ranges(entries, known.select("book", "pages"), "book")
    rest = known.join(named.select("book").distinct(), "book", "left_anti")
    starts = rest.select("book", F.col("title").alias("_t"), "pages", F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(geometry.RANGE))).alias("start"))
    stop = F.least(F.col("start") + geometry.RANGE, F.col("pages"))
    label = F.when(F.col("pages") <= geometry.RANGE, F.col("_t")).otherwise(F.concat(F.lit("Pages "), (F.col("start") + 1).cast("string"), F.lit("-"), stop.cast("string")))
    return named.unionByName(starts.select("book", label.alias("title"), F.col("start").cast("long").alias("start"), stop.cast("long").alias("stop")))


def pdf_blocks(files: DataFrame) -> DataFrame:
    """book, page, block, kind, text of PDF files: lines of pages without repeated edges, as paragraphs and verse."""
    lines = written(geometry.page_lines(pdf_items(files), "book", "page"), "pdf-lines")
    return geometry.page_blocks(geometry.without_edges(lines, "book", "page", "line"), "book", "page")


class Imported:
    """books (book, path, title, author, language), sections (book, section, id, title, kind, included), blocks, warnings, rejected files.

    Sections and blocks are made, and what they need is written, when they are first asked for.
    """

    def __init__(self, books: DataFrame, texts: Callable[[], tuple[DataFrame, DataFrame]], warnings: DataFrame, rejected: DataFrame):
        self.books, self.warnings, self.rejected, self._texts = books, warnings, rejected, texts

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        return self._texts()

    @property
    def sections(self) -> DataFrame:
        return self._both[0]

    @property
    def blocks(self) -> DataFrame:
        return self._both[1]


def parsed(files: DataFrame, mime: Column | None = None) -> Imported:
    """Raw books of files (path, content), each by its format; unknown formats and what can't be read are rejected.

    Files of equal content are one book: that of the least path. Which file stands for a book is told by names and hashes only;
    a content moves once, with those of its format.
    """
    name = F.substring_index("path", "/", -1)
    rows = files.select("path", "content", book_format(name, F.lit("") if mime is None else mime).alias("format"), N.file_title(name).alias("title"), content_id(F.col("content")).alias("book"))
    unknown = rows.filter("format is null").select("path")
    rows = rows.filter("format is not null")
    chosen = written(rows.groupBy("book").agg(F.min_by(F.struct("path", "format", "title"), "path").alias("f")).select("book", "f.*"), "chosen-files")

    def of(*formats: str, content: Column | None = None) -> DataFrame:
        """Each book of these formats that is the least of all its files; the least of a format is that one or none. `content`: what moves in its place."""
        own = rows.filter(F.col("format").isin(*formats)).withColumn("content", F.col("content") if content is None else content)
        own = own.groupBy("book").agg(F.min_by(F.struct("path", "content", "format", "title"), "path").alias("f")).select("book", "f.*")
        return own.join(chosen.filter(F.col("format").isin(*formats)).select("book"), "book", "left_semi")

    tree = written(structured(of("epub", "html", "markdown")), "parsed-files")  # each file is parsed once
    pdfs = of("pdf")
    read = written(pdf_facts(pdfs), "pdf-facts")
    none = F.lit(None).cast("string")

    def texts() -> tuple[DataFrame, DataFrame]:
        said = of("txt", content=decoded("content"))  # read before it moves: after an Arrow function rows no longer count as dealt by book
        lines = said.select("book", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("line_index", "text"))
        txt = written(text_blocks(lines, "book"), "text-blocks")
        named = numbered_sections(txt, "book", "text", none).join(chosen.select("book", F.col("title").alias("_t")), "book")
        named = named.select("book", "section", "id", F.coalesce("title", "_t").alias("title"), F.concat(F.lit("#"), F.col("id")).alias("href"))

        ranges = pdf_sections(read).withColumn("section", F.row_number().over(Window.partitionBy("book").orderBy("start")) - 1)
        paged = written(pdf_blocks(pdfs), "pdf-blocks").join(ranges.select(F.col("book").alias("_b"), "section", "start", "stop"), (F.col("book") == F.col("_b")) & (F.col("page") >= F.col("start")) & (F.col("page") < F.col("stop")))
        paged = paged.select("book", F.col("section").cast("long").alias("section"), (F.col("page") * 100_000 + F.col("block")).cast("long").alias("block"), "kind", "text")
        place = (F.col("start") + 1).cast("string")
        marked = ranges.select("book", F.col("section").cast("long").alias("section"), F.concat(F.lit("pdf-"), place).alias("id"), "title", F.concat(F.lit("#page="), place).alias("href"))

        spread = tree.filter("failed is null").select("book", F.posexplode("sections").alias("section", "s"))
        sections = spread.select("book", F.col("section").cast("long").alias("section"), "s.id", "s.title", "s.href").unionByName(named).unionByName(marked)
        kind = section_kind(F.col("id"), F.col("href"), F.col("title"))
        sections = sections.withColumn("kind", F.when(F.col("href").startswith("#"), "body").otherwise(kind)).withColumn("included", included(F.col("kind")))
        blocks = spread.select("book", F.col("section").cast("long").alias("section"), F.posexplode("s.blocks").alias("block", "b")).select("book", "section", F.col("block").cast("long").alias("block"), "b.kind", "b.text")
        return sections, blocks.unionByName(txt.select("book", "section", F.col("block").cast("long").alias("block"), "kind", "text")).unionByName(paged)

    facts = tree.filter("failed is null").select("book", "path", "title", "author", "language").unionByName(chosen.filter("format = 'txt'").select("book", "path", "title", none.alias("author"), none.alias("language")))
    facts = facts.unionByName(read.filter("failed is null").select("book", "path", "title", "author", none.alias("language")))
    books = facts.withColumn("author", F.coalesce("author", F.lit("Unknown author"))).withColumn("language", F.coalesce("language", F.lit("und")))
    rejected = unknown.select("path", F.lit("unsupported format").alias("why"))
    for d in (tree, read):
        rejected = rejected.unionByName(d.filter("failed is not null").select("path", F.col("failed").alias("why")))
    warnings = tree.select("book", F.explode("warnings").alias("w")).select("book", "w.section", "w.code")
    return Imported(books, texts, warnings, rejected)


def finalized(raw: Imported, accents: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean blocks: book, section, block, kind, text; warnings: book, section, code, n), from repair to the last split."""
    blocks = raw.blocks.filter("text is not null")
    garbled = written(repair.garbled_books(blocks, "book").filter("garbled"), "garbled-books")  # few: blocks need not move to meet them
    pieces = repair.recovered(repair.repaired(blocks, "book", garbled))
    order = F.col("block") * 1_000_000 + F.col("part")
    normal = written(text.normalized(pieces.withColumn("block", order).drop("part"), accents), "normal-blocks")
    dropped = normal.groupBy("book", "section").agg(F.sum("dropped").alias("n")).filter("n > 0").withColumn("code", F.lit("dropped-chars"))
    lines = normal.filter("text <> ''").drop("dropped")
    words, paged = text.vocabulary(lines, "book"), clean.page_structured(lines, "book")
    joined = clean.joined_blocks(lines, words, "book", "section", "block")
    keyed = joined.withColumn("key", F.concat_ws(":", "book", "section", "block"))
    mended = clean.dehyphenated(keyed, words, "book", "key").drop("key").withColumn("text", clean.without_marks(text.fix_spacing(F.col("text"))))
    mended = written(mended, "mended-blocks")
    quiet = clean.without_noise(mended)
    targets = raw.books.select("book", F.explode(F.array("title", "author")).alias("target")).withColumn("section", F.lit(None).cast("long"))
    targets = targets.unionByName(raw.sections.select("book", F.col("title").alias("target"), "section"))
    headless = clean.without_running_heads(quiet, targets, paged, "book")
    last = clean.split_long(headless).withColumn("block", F.col("block") * 1000 + F.col("part")).drop("part")

    def fewer(before: DataFrame, after: DataFrame, code: str, sign: int = 1) -> DataFrame:
        count = lambda d, c: d.groupBy("book", "section").agg(F.count("*").alias(c))
        both = count(before, "x").join(count(after, "y"), ["book", "section"], "left")
        return both.select("book", "section", (sign * (F.col("x") - F.coalesce("y", F.lit(0)))).alias("n")).filter("n > 0").withColumn("code", F.lit(code))

    moji = garbled.select("book", F.lit(None).cast("long").alias("section"), F.col("hits").alias("n"), F.lit("mojibake-repaired").alias("code"))
    empty = raw.sections.select("book", "section").join(last, ["book", "section"], "left_anti").select("book", "section", F.lit(1).cast("long").alias("n"), F.lit("empty-section").alias("code"))
    parts = [dropped, fewer(blocks, normal, "paragraphs-recovered", -1), fewer(mended, quiet, "noise-dropped"), fewer(quiet, headless, "running-heads-removed"), fewer(headless, last, "blocks-split", -1), moji, empty]
    warnings = parts[0].select("book", "section", "code", F.col("n").cast("long").alias("n"))
    for p in parts[1:]:
        warnings = warnings.unionByName(p.select("book", "section", "code", F.col("n").cast("long").alias("n")))
    return last.select("book", "section", "block", "kind", "text"), warnings


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as rows (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


# Queries. Files are made of the tables: documents in several encodings, pages, and conversations packed as e-books.


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _encoded(text_: pa.Array, how: pa.Array) -> pa.Array:
    ways = [lambda t: t.encode(), lambda t: b"\xef\xbb\xbf" + t.encode(), lambda t: b"\xff\xfe" + t.encode("utf-16-le"), lambda t: b"\xfe\xff" + t.encode("utf-16-be"), lambda t: t.encode("cp1252", "replace")]
    return pa.array([None if t is None else ways[k](t) for t, k in zip(text_.to_pylist(), how.to_pylist(), strict=True)], pa.binary())


def decoded_texts(spark, sf_dir):
    """Texts written in five encodings, read back. A text of ASCII in windows-1252 is UTF-8 as well."""
    docs = _t(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", decoded(F.arrow_udf(_encoded, "binary")("text", F.pmod("doc_id", F.lit(5)))).alias("text"))


def page_titles(spark, sf_dir):
    """Title, language and number of headings of each page."""
    files = _t(spark, sf_dir, "pages").filter("html is not null")
    rows = files.select(F.col("page_id").cast("string").alias("path"), F.col("page_id").cast("string").alias("book"), F.encode("html", "UTF-8").alias("content"), F.lit("html").alias("format"), F.lit("none").alias("title"))
    out = structured(rows)
    heads = F.size(F.filter(F.flatten(F.transform("sections", lambda s: s["blocks"])), lambda b: b["kind"] == "heading"))
    return out.select(F.col("path").cast("long").alias("page_id"), "title", "language", heads.cast("long").alias("headings"))


def html_blocks(spark, sf_dir):
    """Every block of every page, with the section that a heading begins."""
    files = _t(spark, sf_dir, "pages").filter("html is not null")
    rows = files.select(F.col("page_id").cast("string").alias("path"), F.col("page_id").cast("string").alias("book"), F.encode("html", "UTF-8").alias("content"), F.lit("html").alias("format"), F.lit("none").alias("title"))
    s = structured(rows).select(F.col("path").cast("long").alias("page_id"), F.posexplode("sections").alias("section", "s"))
    b = s.select("page_id", F.col("section").cast("long").alias("section"), F.posexplode("s.blocks").alias("block", "b"))
    return b.select("page_id", "section", F.col("block").cast("long").alias("block"), "b.kind", N.squeezed(F.col("b.text")).alias("text"))


def _packed(talks: DataFrame) -> DataFrame:
    """Conversations as e-book files: a turn is a spine item with its role as heading; every third item is not in the tables of contents."""

    def run(rows):
        import io
        import zipfile
        from html import escape

        own, out = rows.sort_values("turn"), io.BytesIO()
        items = [(f"t{r.turn}", f"text/turn%20{r.turn}.xhtml", f"text/turn {r.turn}.xhtml", r) for r in own.itertuples()]
        with zipfile.ZipFile(out, "w") as z:

            def put(name, said):
                z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), said, zipfile.ZIP_DEFLATED)  # the same bytes each time

            put("META-INF/container.xml", "<container><rootfiles><rootfile full-path='OPS/book.opf' media-type='application/oebps-package+xml'/></rootfiles></container>")
            listed = "".join(f"<item id='{i}' href='{h}' media-type='application/xhtml+xml'/>" for i, h, _, _ in items)
            spine = "".join(f"<itemref idref='{i}'/>" for i, *_ in items)
            put("OPS/book.opf", f"<package xmlns:dc='urn:dc'><metadata><dc:title>Talk {rows['conv_id'].iloc[0]}</dc:title></metadata><manifest>{listed}<item id='ncx' href='toc.ncx' media-type='application/x-dtbncx+xml'/><item id='nav' href='nav.xhtml' media-type='application/xhtml+xml' properties='nav'/></manifest><spine toc='ncx'>{spine}</spine></package>")
            put("OPS/toc.ncx", "<ncx><navMap>" + "".join(f"<navPoint><navLabel><text>Old {r.turn}</text></navLabel><content src='{h}#x'/></navPoint>" for _, h, _, r in items if r.turn % 3 != 2) + "</navMap></ncx>")
            put("OPS/nav.xhtml", "<html xmlns:epub='urn:e'><body><nav epub:type='toc'>" + "".join(f"<a href='{h}'>New {r.turn}</a>" for _, h, _, r in items if r.turn % 3 == 1) + "</nav></body></html>")
            for _, _, path, r in items:
                put(f"OPS/{path}", f"<?xml version='1.0' encoding='utf-8'?><html><body><h1>{escape(r.role)}</h1><p>{escape(r.text)}</p></body></html>".encode())
        return pd.DataFrame({"path": [f"{rows['conv_id'].iloc[0]}.epub"], "content": [out.getvalue()]})

    return talks.groupBy("conv_id").applyInPandas(run, "path string, content binary")


def epub_sections(spark, sf_dir):
    talks = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = parsed(written(_packed(talks), "packed-files"))  # read several times
    said = raw.blocks.groupBy("book", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: N.squeezed(b["text"])), "|").alias("said"))
    rows = raw.books.join(raw.sections, "book").select("book", "section", F.regexp_extract("path", "([0-9]+)\\.epub$", 1).cast("long").alias("conv_id"), "id", raw.sections["title"].alias("title"), "kind")
    return rows.join(said, ["book", "section"], "left").select("conv_id", "section", "id", "title", "kind", F.coalesce("said", F.lit("")).alias("said"))


def import_files(spark, sf_dir):
    """Text files, pages and files of no known kind, imported to the end: clean blocks with their sections."""
    docs, pages = _sample_files(spark, sf_dir)
    blocks, _ = finalized(parsed(docs.unionByName(pages)))
    return blocks.select("book", "section", "block", "kind", "text")


def _sample_files(spark, sf_dir, said: str = "text"):
    """Documents as text files, every tenth of an unknown kind, and pages."""
    docs = _t(spark, sf_dir, "documents").filter("text is not null").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 3, ".bin").otherwise(".txt")).alias("path"), F.encode(F.expr(said), "UTF-8").alias("content"))
    pages = _t(spark, sf_dir, "pages").filter("html is not null").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return docs, pages


def import_books(spark, sf_dir):
    """What becomes of each file: a book with its title and language, or the reason why not; equal files are one book."""
    docs, pages = _sample_files(spark, sf_dir)
    raw = parsed(docs.unionByName(pages))
    none = F.lit(None).cast("string")
    return raw.books.select("path", "title", "author", "language", none.alias("why")).unionByName(raw.rejected.select("path", none.alias("title"), none.alias("author"), none.alias("language"), "why"))


def import_warnings(spark, sf_dir):
    """Characters dropped from each text file with planted ones, told by the whole import."""
    docs, _ = _sample_files(spark, sf_dir, text.DIRTY)
    raw = parsed(docs)
    _, warnings = finalized(raw)
    rows = warnings.filter("code = 'dropped-chars'").groupBy("book").agg(F.sum("n").alias("n"))
    return rows.join(raw.books.select("book", "path"), "book").select("path", "n")


def metadata_texts(spark, sf_dir):
    """Titles as strings, lists, and objects with a language."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), "lang", F.lit(" \n "), "source", F.lit(" ")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('["'), "lang", F.lit('", " ", {"#text": "'), "source", F.lit('"}]')))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"value": "'), "source", F.lit('", "x-default": "'), "lang", F.lit('"}')))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('"'), "lang", F.lit(' \\"x\\""'))).otherwise(F.lit("[]")).alias("said"))
    return docs.select("doc_id", N.metadata_text(F.col("said")).alias("title"))


def cover_facts(spark, sf_dir):
    """Sizes and data URLs of picture files made of each document's numbers and first words."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(1900)).alias("w"), (F.coalesce("n_chars", F.lit(0)) % 70000 + 1).alias("h"), F.coalesce(F.substring("text", 1, 30), F.lit("")).alias("own"))
    number = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("w") + 1, 8), number(F.col("h"), 8))
    jpeg = F.concat(F.lit("FFD8FFE000041111FFC2001108"), number(F.col("h") % 60000 + 1, 4), number(F.col("w") + 1, 4))
    head = F.when(F.col("doc_id") % 3 == 0, png).when(F.col("doc_id") % 3 == 1, jpeg).otherwise(F.lit("00FF"))
    files = docs.select("doc_id", F.concat(F.unhex(head), F.encode("own", "UTF-8")).alias("content"), F.when(F.col("doc_id") % 3 == 0, "image/png").otherwise("image/jpeg").alias("kind"))
    size = N.cover_size(F.col("content"))
    return files.select("doc_id", size["width"].alias("width"), size["height"].alias("height"), F.replace(N.data_url(F.col("content"), F.col("kind")), F.lit("\r\n"), F.lit("")).alias("url"))


def content_ids(spark, sf_dir):
    """Ids of files by their bytes: texts in two encodings."""
    docs = _t(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", content_id(F.encode("text", "UTF-8")).alias("id"), content_id(F.encode(F.translate("text", "éèêàçùâîôûäöüßñáíóúÉÈ", ""), "UTF-16LE")).alias("wide"))


def _printed(docs: DataFrame) -> DataFrame:
    """Documents as PDF files of one font: twelve lines a page, a head and a page number on each."""

    def run(batches):
        import zlib

        for batch in batches:
            out = []
            for r in batch.itertuples():
                lines = [x for x in r.text.split("\n") if x.strip()]
                parts = [lines[k : k + 12] for k in range(0, len(lines), 12)] or [[]]
                objects = ["<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Count %d/Kids[%s]>>" % (len(parts), " ".join(f"{4 + 2 * k} 0 R" for k in range(len(parts)))), "<</Type/Font/Subtype/Type1/BaseFont/Courier/FirstChar 0/Widths[%s]/Encoding/WinAnsiEncoding>>" % " ".join(["600"] * 256)]
                files = [o.encode() for o in objects]
                for k, own in enumerate(parts):
                    shown = [(800, "THE HEAD"), *((760 - 20 * i, x) for i, x in enumerate(own)), (20, str(k + 1))]
                    escape = lambda x: x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
                    body = zlib.compress(b"BT /F 10 Tf " + b" ".join(b"1 0 0 1 50 %d Tm (%s) Tj" % (y, escape(x)) for y, x in shown) + b" ET")
                    files += [b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (5 + 2 * k), b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(body), body)]
                out.append((f"{r.doc_id}.pdf", b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(files)) + b"trailer<</Root 1 0 R>>"))
            yield pd.DataFrame(out, columns=["path", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


def pdf_lines(spark, sf_dir):
    """Documents printed to PDF and read back: their lines, without the heads and numbers of pages."""
    docs = _t(spark, sf_dir, "documents").filter("text is not null")
    files = _printed(docs).withColumn("book", F.regexp_extract("path", "([0-9]+)", 1))
    lines = geometry.page_lines(pdf_items(files), "book", "page").filter("y > 400 and y < 780")
    return lines.select(F.col("book").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), "text")


QUERIES = {"pdf_lines": pdf_lines, "content_ids": content_ids, "decoded_texts": decoded_texts, "page_titles": page_titles, "html_blocks": html_blocks, "epub_sections": epub_sections, "import_books": import_books, "import_warnings": import_warnings, "metadata_texts": metadata_texts, "cover_facts": cover_facts, "import_files": import_files}

# Marks for the tags of the sample pages: what begins with h, p, l or d is a block, \x02 is a break.
_SQL_MARKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'),
    '<br[^>]*>', chr(2), 'g'), '<h1[^>]*>', chr(1) || 'h', 'g'), '<p( [^>]*)?>', chr(1) || 'p', 'g'), '<li[^>]*>', chr(1) || 'l', 'g'), '<div[^>]*>', chr(1) || 'd', 'g'),
    '</?(html|body|article|nav|ul|footer|main|section)[^>]*>|</(p|h1|li|div)>', chr(1) || 'x', 'g'), '<[^>]*>', '', 'g')"""
_SQL_ENTITIES = "{}"
for _from, _to in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
    _SQL_ENTITIES = f"replace({_SQL_ENTITIES}, '{_from}', '{_to}')"

_SQL_LANGUAGE = "regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1)"

ORACLE_SQL = {
    "import_books": f"""
        with t as (select min(concat('d/', cast(doc_id as varchar), '.txt')) as path from documents where text is not null and doc_id % 10 <> 3 group by text),
        h as (select html, min(concat('p/', cast(page_id as varchar), '.html')) as path from pages where html is not null group by html)
        select path, replace(replace(path, 'd/', ''), '.txt', '') as title, 'Unknown author' as author, 'und' as language, null as why from t
        union all select path, trim({_SQL_ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}), 'Unknown author', {_SQL_LANGUAGE}, null from h
        union all select concat('d/', cast(doc_id as varchar), '.bin'), null, null, null, 'unsupported format' from documents where text is not null and doc_id % 10 = 3
    """,
    "import_warnings": f"""
        with d as (select doc_id, {text.DIRTY} as text from documents where text is not null and doc_id % 10 <> 3),
        o as (select min(concat('d/', cast(doc_id as varchar), '.txt')) as path, text from d group by text),
        n as (select path, cast(sum(dropped) as bigint) as n from {text._sql_normalized("select path, text from o", "path")} group by path)
        select path, n from n where n > 0
    """,
    "metadata_texts": """
        select doc_id, case doc_id % 5 when 0 then concat(lang, ' ', source) when 1 then concat(lang, ', ', source) when 2 then lang when 3 then concat(lang, ' "x"') end as title from documents
    """,
    "cover_facts": """
        with d as (select doc_id, doc_id % 1900 + 1 as w, coalesce(n_chars, 0) % 70000 + 1 as h, coalesce(substring(text, 1, 30), '') as own from documents),
        f as (select *, case doc_id % 3 when 0 then concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'))
            when 1 then concat('FFD8FFE000041111FFC2001108', lpad(hex(h % 60000 + 1), 4, '0'), lpad(hex(w), 4, '0')) else '00FF' end as head from d)
        select doc_id, cast(case when doc_id % 3 < 2 then w end as int) as width, cast(case doc_id % 3 when 0 then h when 1 then h % 60000 + 1 end as int) as height,
            concat('data:image/', case when doc_id % 3 = 0 then 'png' else 'jpeg' end, ';base64,', to_base64(unhex(head) || encode(own))) as url from f
    """,
    "pdf_lines": """
        with l as (select doc_id, unnest(generate_series(1, len(parts))) as i, unnest(parts) as text from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null)),
        k as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as k, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from l where trim(text) <> '')
        select doc_id, k // 12 as page, cast(1 + k % 12 as bigint) as line, text from k
    """,
    "content_ids": """
        with d as (select doc_id, encode(text) as b, translate(text, 'éèêàçùâîôûäöüßñáíóúÉÈ', '') as t from documents where text is not null)
        select doc_id, substring(sha256(b), 1, 16) as id, substring(sha256(unhex(array_to_string(list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: lpad(hex(unicode(c) % 256), 2, '0') || lpad(hex(unicode(c) // 256), 2, '0')), ''))), 1, 16) as wide from d
    """,
    "decoded_texts": "select doc_id, text from documents where text is not null",
    "page_titles": f"""
        select page_id, trim({_SQL_ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) as title, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) as language,
            cast(len(regexp_extract_all(html, '<h1[^>]*>')) as bigint) as headings from pages where html is not null
    """,
    "html_blocks": f"""
        with m as (select page_id, string_split({_SQL_MARKED}, chr(1)) as parts from pages where html is not null),
        e as (select page_id, unnest(generate_series(1, len(parts))) as k, unnest(parts) as part from m),
        s as (select page_id, k, left(part, 1) as tag, unnest(generate_series(1, len(string_split(part, chr(2))))) as j, unnest(string_split(substring(part, 2), chr(2))) as raw from e where left(part, 1) in ('h', 'p', 'l', 'd')),
        b as (select page_id, k, j, tag, {_SQL_ENTITIES.format("raw")} as raw from s),
        f as (select *, row_number() over (partition by page_id order by k, j) as o, count(*) filter (where tag = 'p') over (partition by page_id) as ps,
            count(*) filter (where tag = 'p' and length(trim(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'))) < 90) over (partition by page_id) as narrow from b where regexp_matches(raw, '\\S')),
        g as (select *, sum(cast(tag = 'h' as int)) over (partition by page_id order by o) as heads, min(case when tag = 'h' then 0 else 1 end) filter (where o = 1) over (partition by page_id) as lead from f)
        select page_id, cast(heads - case when lead = 1 then 0 else 1 end as bigint) as section,
            cast(row_number() over (partition by page_id, heads order by o) - 1 as bigint) as block,
            case tag when 'h' then 'heading' when 'p' then case when narrow * 2 > ps then 'verse' else 'paragraph' end else 'paragraph' end as kind, trim(regexp_replace(raw, '\\s+', ' ', 'g')) as text from g
    """,
    "epub_sections": """
        with t as (select conv_id, turn, coalesce(role, '') as role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as text, row_number() over (partition by conv_id order by turn) - 1 as section from conversations)
        select conv_id, section, concat('t', cast(turn as varchar)) as id, case turn % 3 when 0 then concat('Old ', cast(turn as varchar)) when 1 then concat('New ', cast(turn as varchar)) else role end as title, 'body' as kind,
            case when text = '' then role when role = '' then text else concat(role, '|', text) end as said from t
    """,
}
