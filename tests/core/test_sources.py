"""Files, pages, e-books, the store: what SQL can't say, by literals and round trips."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.operators import importing, progress
from lectern.sources import epub, html, markdown, pdf
from lectern.sources.store import Store, books_with_content, payload_json, read_payload


def blocks(page):
    return [(k, html.squeezed(t)) for k, t in html.document(page).blocks]


def test_blocks_of_pages():
    assert blocks("<body><h1>A</h1><p>one<p>two<br>three<blockquote><p>q</p></blockquote><ul><li>x<li>y</ul>") == [("heading", "A"), ("verse", "one"), ("verse", "two"), ("verse", "three"), ("blockquote", "q"), ("paragraph", "x"), ("paragraph", "y")]
    assert blocks("<div>lost<div>kept <b>bold</b></div></div><span>lost</span>") == [("paragraph", "kept bold")]
    assert blocks("<p>a<sup>12</sup>b<sup>x</sup></p><p style='display : none'>no</p><p><script>no</script>c</p><figure><p>no</p></figure>") == [("verse", "abx"), ("verse", "c")]
    assert blocks("<p>" + "w" * 95 + "</p><p>short</p>") == [("paragraph", "w" * 95), ("paragraph", "short")]
    assert blocks("") == [] and blocks("<html><head><title>t</title>") == []


def test_verse_numbers():
    page = "".join(f"<p>{n}   line {n}</p>" for n in (5, 10, 15))
    assert [t for _, t in blocks(page)] == ["line 5", "line 10", "line 15"] and html.document(page).stripped
    for numbers in ((5, 10), (5, 15, 10)):
        page = "".join(f"<p>{n}   line</p>" for n in numbers)
        assert [t for _, t in blocks(page)] == [f"{n} line" for n in numbers] and not html.document(page).stripped


def test_page_facts():
    page = "<html lang=' de '><head><title> A\n b </title><meta name='Author' content=''><meta property='dc.creator' content='Me'></head><p>x"
    assert html.document(page, "f")[:3] == ("A b", "Me", "de")
    assert html.document("<p>x", "f")[:3] == ("f", None, None)
    assert html.document("<html lang=de><meta name=dc.language content=fr>")[2] == "fr"


def test_markdown():
    source = "# One *two*\n\nA line\nand **more** [link](http://x) `a*b*c`\n\n- first\n- second\n\n> quoted\n\nUnder\n=====\n\n```\ncode <x>\n```\n***\nend"
    assert blocks(markdown.rendered(source)) == [("heading", "One two"), ("verse", "A line and more link a*b*c"), ("paragraph", "first"), ("paragraph", "second"), ("blockquote", "quoted"), ("heading", "Under"), ("verse", "end")]


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 40) + b"rest"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 9) + b"rest"


def book_files(**more):
    return {
        "META-INF/container.xml": "<container><rootfiles><rootfile full-path='x.opf'/><rootfile full-path='O/b.opf' media-type='application/oebps-package+xml'/></rootfiles></container>",
        "O/b.opf": """<package xmlns:dc='d'><metadata><dc:title>T &amp; U</dc:title><dc:creator> A  B </dc:creator><meta name='cover' content='img'/></metadata><manifest>
            <item id='c1' href='ch%201.xhtml' media-type='application/xhtml+xml'/><item id='c2' href='../C2.xhtml#a' media-type='application/xhtml+xml'/><item id='c3' href='broken.xhtml' media-type='application/xhtml+xml'/>
            <item id='img' href='i.png' media-type='image/png'/><item id='n' href='toc.ncx' media-type='application/x-dtbncx+xml'/></manifest><spine><itemref idref='c1'/><itemref idref='c2'/><itemref idref='c3'/><itemref idref='gone'/></spine></package>""",
        "O/toc.ncx": "<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src='ch 1.xhtml'/></navPoint></navMap></ncx>",
        "O/ch 1.xhtml": "<?xml version='1.0' encoding='iso-8859-1'?><html><body><p>caf\xe9&nbsp;x</p></body></html>".encode("latin-1"),
        "c2.XHTML": "<html><head><title>Two</title></head><body><p>zwei</p></body></html>",
        "O/broken.xhtml": "<html><p>open",
        "O/i.png": PNG,
        **more,
    }


def test_ebooks():
    b = epub.book(archive(book_files()))
    assert (b.title, b.author, b.language, b.cover) == ("T & U", "A B", "und", ("image/png", PNG))
    said = [(s.id, s.title, [html.squeezed(t) for _, t in s.blocks]) for s in b.sections]
    assert said == [("c1", "First", ["café x"]), ("c2", "Two", ["zwei"]), ("c3", "broken", []), ("gone", "gone", [])]
    assert b.warnings == [("decode-fallback", "c2"), ("decode-fallback", "c3")]
    nav = "<html xmlns:epub='e'><nav><a href='x'>no</a></nav><nav epub:type='toc'><a href='ch 1.xhtml#s'>Newer</a></nav></html>"
    opf = book_files()["O/b.opf"].replace("<item id='n'", "<item id='nav' href='nav.xhtml' properties='nav' media-type='application/xhtml+xml'/><item id='n'")
    assert epub.book(archive(book_files(**{"O/nav.xhtml": nav, "O/b.opf": opf}))).sections[0].title == "Newer"
    for content in (b"no archive", archive({"a": "b"}), archive({"META-INF/container.xml": "<container/>"})):
        with pytest.raises(ValueError):
            epub.book(content)
    no_spine = epub.book(archive(book_files(**{"O/b.opf": "<package><manifest/></package>"})), "Name")
    assert (no_spine.title, no_spine.sections, no_spine.warnings) == ("Name", [], [("no-spine", None)])


def pdf_file(objects, trailer="<</Root 1 0 R>>"):
    return b"%PDF-1.7\n" + b"".join(f"{k} 0 obj ".encode() + (o if isinstance(o, bytes) else o.encode()) + b" endobj\n" for k, o in objects.items()) + f"trailer{trailer}".encode()


def test_pdf_files():
    page = b"<</Length 999>>stream\nq 2 0 0 2 10 0 cm BT /F 12 Tf 14 TL 1 0 0 1 5 700 Tm [(He) -50 (llo) -400 (you)] TJ T* (\\(a\\) \\101%no) Tj /G 10 Tf <00010002> Tj ET Q\nendstream"
    cmap = b"<<>>stream\n1 beginbfrange <0001> <0002> <0058> endbfrange\nendstream"
    packed = zlib.compress(b"6 0 7 60 " + b"<</Type/Font/Subtype/Type1>>".ljust(60) + b"<</Type/Font/Subtype/Type0/ToUnicode 8 0 R>>")
    objects = {
        1: "<</Type/Catalog/Pages 2 0 R/Outlines 10 0 R>>", 2: "<</Kids[3 0 R 4 0 R]/Resources<</Font<</F 6 0 R/G 7 0 R>>>>>>", 3: "<</Type/Page/Contents[5 0 R]>>", 4: "<</Type/Page>>", 5: page,
        8: cmap, 9: b"<</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length %d>>stream\n" % len(packed) + packed + b"\nendstream",
        10: "<</First 11 0 R>>", 11: "<</Title(One)/Dest[3 0 R/Fit]/Next 12 0 R>>", 12: "<</Title<FEFF0054>/A<</D[4 0 R]>>/Next 11 0 R>>", 13: "<</Title( My  Title )/Author(Me)>>",
    }
    own = pdf.read(pdf_file(objects, "<</Root 1 0 R/Info 13 0 R>>"))
    assert (own.title, own.author, own.outline, len(own.pages), own.pages[1].items) == ("My Title", "Me", [("One", 0), ("T", 1)], 2, [])
    said = [(t, round(x, 2), round(y, 2), h) for t, x, y, _, h in own.pages[0].items]
    assert said[0] == ("Hello you", 20.0, 1400.0, 24.0) and said[1] == ("(a) A%no", 20.0, 1372.0, 24.0) and said[2][0] == "XY" and said[2][3] == 20.0
    assert abs(own.pages[0].items[0][3] - 2 * (8 * 6 + 0.45 * 12)) < 1e-6
    for content in (b"", b"%PDF-1.4 nothing", pdf_file({1: "<</Type/Catalog>>"}), pdf_file(objects, "<</Root 1 0 R/Encrypt 13 0 R>>")):
        with pytest.raises(ValueError):
            pdf.read(content)


def test_pdf_import(spark):
    head = lambda k: f"BT /F 10 Tf 1 0 0 1 50 800 Tm (HEAD) Tj 1 0 0 1 50 700 Tm (Some prose of page {k} that fills the line) Tj 1 0 0 1 50 688 Tm (very end {k}.) Tj 1 0 0 1 50 20 Tm ({k}) Tj ET"
    objects = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: "<</Kids[%s]/Resources<</Font<</F 3 0 R>>>>>>" % " ".join(f"{10 + 2 * k} 0 R" for k in range(22)), 3: "<</Type/Font/Subtype/Type1>>"}
    for k in range(22):
        objects |= {10 + 2 * k: f"<</Type/Page/Contents {11 + 2 * k} 0 R>>", 11 + 2 * k: f"<</Length 1>>stream\n{head(k + 1)}\nendstream"}
    raw = importing.parsed(spark.createDataFrame([("x/my_file.pdf", pdf_file(objects))], "path string, content binary"))
    assert [(r.id, r.title) for r in raw.sections.orderBy("section").collect()] == [("pdf-1", "Pages 1-20"), ("pdf-21", "Pages 21-22")]
    assert [(r.section, r.kind, r.text) for r in raw.blocks.orderBy("section", "block").collect()] == [(k // 20, "paragraph", f"Some prose of page {k + 1} that fills the line very end {k + 1}.") for k in range(22)]
    assert raw.books.first().title == "my file"


def test_archive_paths():
    assert [epub.archive_path(p) for p in ("a/./b/../c%20d?x#y", "\\a\\b", "%2e%2e/a", "a%2Fb", "%zz", "../../x")] == ["a/c d", "a/b", "%2e%2e/a", "a%2Fb", "%zz", "x"]
    assert [epub.resolved("O/b/x.opf", r) for r in ("../c.html#a", "/r.html", "http://x/y", "d e.html")] == ["O/c.html", "r.html", "", "O/b/d e.html"]


def test_decoding():
    assert [importing.plain_text(c) for c in (b"\xef\xbb\xbfa", "é".encode("utf-16"), b"\xfe\xff\0a", b"caf\xe9 \x93q\x94 \x81", "ü".encode(), b"")] == ["a", "é", "a", "café “q” \x81", "ü", ""]


def test_cover_sizes_and_labels(spark):
    rows = spark.createDataFrame([(0, PNG), (1, JPEG), (2, b"GIF89a"), (3, b""), (4, None)], "i int, content binary")
    got = {r.i: r.s for r in rows.select("i", N.cover_size(F.col("content")).alias("s")).collect()}
    assert tuple(got[0]) == (30, 40) and tuple(got[1]) == (9, 7) and got[2] is got[3] is got[4] is None
    assert spark.range(1).select(N.data_url(F.lit(b"ab"), F.lit("image/png"))).first()[0] == "data:image/png;base64,YWI="
    values = spark.createDataFrame([(' a  b ',), ('["x", " ", "y z"]',), ('{"value": "v", "x-default": "d"}',), ("[]",), (None,)], "v string")
    assert [r[0] for r in values.select(N.metadata_text(F.col("v"))).collect()] == ["a b", "x, y z", "d", None, None]


def test_whole_import(spark, tmp_path):
    """Files of every kind, from disk to clean blocks, with what was warned about."""
    words = "The quick brown fox jumps over the lazy dog again and again until the evening comes"
    text = f"Chapter 1\n{words} and com-\n{words}\n\n" + "\n\n".join(f"{n}" for n in range(1, 13)) + f"\n\nMy Book\n\nIt was com- plete , he said… café Ж complete\n\nChapter 2\n* * *"
    (tmp_path / "my_book.txt").write_text(text, encoding="utf-8")
    (tmp_path / "page.html").write_text(f"<html lang=en><title>Page</title><h1>Head</h1><p>{words}</p>", encoding="utf-8")
    (tmp_path / "note.md").write_text("# Top\n\nsome words\n", encoding="utf-8")
    (tmp_path / "b.epub").write_bytes(archive(book_files()))
    (tmp_path / "bad.epub").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "a.xyz").write_bytes(b"x")
    raw = importing.parsed(importing.read_files(spark, str(tmp_path)))
    assert {(r.path.rsplit("/", 1)[-1], r.why) for r in raw.rejected.collect()} == {("a.pdf", "damaged PDF file"), ("a.xyz", "unsupported format"), ("bad.epub", "not an EPUB archive")}
    clean, warnings = importing.finalized(raw)
    names = {r.book: r.title for r in raw.books.collect()}
    assert sorted(names.values()) == ["Page", "T & U", "my book", "note"]
    said = {}
    for r in sorted(clean.collect(), key=lambda r: (r.book, r.section, r.block)):
        said.setdefault(names[r.book], []).append((r.kind, r.text))
    assert said["my book"][0] == ("heading", "Chapter 1") and said["my book"][-1] == ("heading", "Chapter 2")
    assert ("paragraph", "It was complete, he said... cafe complete") in said["my book"]
    assert not any(t in ("7", "My Book", "* * *") for _, t in said["my book"])
    assert said["Page"] == [("heading", "Head"), ("verse", words)] and said["T & U"] == [("verse", "cafe x"), ("verse", "zwei")]
    codes = {(names[r.book], r.code) for r in warnings.collect()}
    assert {("my book", "dropped-chars"), ("my book", "noise-dropped"), ("my book", "running-heads-removed"), ("T & U", "empty-section")} <= codes


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    row = lambda *rows: spark.createDataFrame(list(rows), "book_id string, at int, said string")
    assert store.read("books") is None and store.get("books", "a") is None
    store.put(books=row(("a", 1, "x"), ("b", 1, "y")), book_meta=row(("a", 1, "m")))
    store.put(books=row(("a", 2, "z"), ("a", 3, "newest")))
    got = lambda name: {r.book_id: r.said for r in store.read(name).collect()}
    assert got("books") == {"a": "newest", "b": "y"} and got("book_meta") == {"a": "m"} and store.get("books", "b").count() == 1
    store.checkpoint(row(("a", 4, "p"), ("b", 4, "p")), row(("a", 4, "n")))
    assert got("navigation") == {"a": "n"}
    store.checkpoint(row(("a", 5, "q")), row())
    assert got("navigation") == {} and got("progress") == {"a": "q", "b": "p"}
    with pytest.raises(ValueError):
        store.checkpoint(row(("a", 6, "r")), row(("zzz", 6, "n")))
    assert got("progress") == {"a": "q", "b": "p"}
    store.delete_books(row(("a", 0, "")))
    assert (got("books"), got("book_meta"), got("progress")) == ({"b": "y"}, {}, {"b": "p"})
    store.migrate({"settings": "key string, at int", "books": "other string"})
    assert store.read("settings").count() == 0 and got("books") == {"b": "y"}
    assert books_with_content(row(("a", 1, "x")), spark.createDataFrame([("b", 1)], "book_id string, n int")).count() == 0


def test_payload_round_trip(spark, tmp_path):
    record = progress.initial(spark.createDataFrame([("a", 9, None, 5)], "book_id string, total long, overrides map<string, boolean>, at long"))
    known = spark.createDataFrame([("a", "T", "A")], "book_id string, title string, author string")
    settings = spark.createDataFrame([("x", 2.0)], "theme string, font_size double")
    text = payload_json(record, known, settings, 77).first().payload
    (tmp_path / "p.json").write_text(text, encoding="utf-8")
    back = read_payload(spark, str(tmp_path / "p.json"), "version int, updated_at long, progress map<string, struct<book_id: string, total: bigint>>, known_books map<string, struct<title: string, author: string>>, settings struct<theme: string>").first()
    assert "\n" in text and (back.version, back.updated_at, back.progress["a"].total, back.known_books["a"].title, back.settings.theme) == (1, 77, 9, "T", "x")
    (tmp_path / "bad.json").write_text("{", encoding="utf-8")
    assert read_payload(spark, str(tmp_path / "bad.json"), "version int").first().version is None
