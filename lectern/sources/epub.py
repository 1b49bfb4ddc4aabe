"""EPUB archives: package, manifest, tables of contents, spine and cover, as plain functions over the file's bytes."""

from __future__ import annotations

import io
import re
import zipfile
from typing import NamedTuple
from urllib.parse import unquote_to_bytes
from xml.etree import ElementTree

from lectern.sources import html as H

# Fixed values.
PACKAGE, NCX, COVERS = "application/oebps-package+xml", "application/x-dtbncx+xml", ("image/jpeg", "image/png")
LARGEST_COVER = 8 << 20
COVER_WORDS = frozenset(("cover", "frontcover"))  # words of an id or file name
DECLARED = re.compile(rb"<\?xml[^>]*\bencoding\s*=\s*[\"']([^\"']+)[\"']", re.I)
META_CHARSET = re.compile(rb"<meta[^>]*\bcharset\s*=\s*[\"']?([a-zA-Z0-9_-]+)", re.I)


class Item(NamedTuple):
    id: str
    href: str
    path: str
    kind: str
    properties: frozenset


class SpineSection(NamedTuple):
    id: str
    href: str
    title: str
    blocks: list[tuple[str, str]]
    guessed: bool


class Book(NamedTuple):
    title: str
    author: str
    language: str
    sections: list[SpineSection]
    cover: tuple[str, bytes] | None
    warnings: list[tuple[str, str | None]]  # (code, section id)


def bare(reference: str) -> str:
    return re.split(r"[#?]", reference, maxsplit=1)[0]


def decoded_part(part: str) -> str:
    """Percent-decoded, unless that is no UTF-8 or would change the path."""
    try:
        out = unquote_to_bytes(part).decode("utf-8")
    except UnicodeDecodeError:
        return part
    broken = re.search(r"%(?![0-9A-Fa-f]{2})", part)
    return part if broken or "/" in out or "\\" in out or out in (".", "..") else out


def archive_path(value: str) -> str:
    """Without fragment, query, empty and dot parts; backslashes are slashes."""
    out: list[str] = []
    for part in map(decoded_part, bare(value).replace("\\", "/").split("/")):
        if part == "..":
            del out[-1:]
        elif part and part != ".":
            out.append(part)
    return "/".join(out)


def resolved(base: str, reference: str) -> str:
    """A reference from a file of the archive; empty for other schemes."""
    to = bare(reference).replace("\\", "/")
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", to):
        return ""
    return archive_path(to if to.startswith("/") or "/" not in base else f"{base.rsplit('/', 1)[0]}/{to}")


def decoded(content: bytes) -> tuple[str, bool]:
    """(text, was the encoding guessed): as declared in the first 1024 bytes, else UTF-8."""
    found = DECLARED.search(content[:1024]) or META_CHARSET.search(content[:1024])
    if found:
        try:
            return content.decode(found[1].decode("ascii"), "replace").removeprefix("﻿"), False
        except (LookupError, UnicodeDecodeError):
            pass
    return content.decode("utf-8", "replace").removeprefix("﻿"), True


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower() if isinstance(tag, str) else ""


def elements(root, name: str) -> list:
    return [e for e in root.iter() if e is not root and local(e.tag) == name] if root is not None else []


def first(root, name: str):
    return next(iter(elements(root, name)), None)


def said(element) -> str:
    return H.squeezed("".join(element.itertext())) if element is not None else ""


def attribute(element, name: str) -> str:
    """By its local name."""
    return next((v for k, v in element.attrib.items() if local(k) == name), "") if element is not None else ""


def xml(text: str):
    """The root element; undefined entities of XHTML are allowed. Raises ValueError."""
    from html.entities import html5

    known = lambda m: m[0] if m[1] in ("amp", "lt", "gt", "quot", "apos") else html5.get(m[1] + ";", m[0])
    try:
        return ElementTree.fromstring(re.sub(r"&([A-Za-z][A-Za-z0-9]*);", known, re.sub(r"^\s*<\?xml[^>]*\?>", "", text)))
    except ElementTree.ParseError as e:
        raise ValueError("not well-formed XML") from e


class Archive:
    """Files by normalized path, the first of a path wins; else by its lower case."""

    def __init__(self, content: bytes):
        self.files: dict[str, bytes] = {}
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    self.files.setdefault(archive_path(info.filename), z.read(info))
        self.lower = {}
        for path in self.files:
            self.lower.setdefault(path.lower(), path)

    def get(self, path: str) -> bytes | None:
        path = archive_path(path)
        return self.files.get(path, self.files.get(self.lower.get(path.lower(), "")))


def manifest_of(package, path: str) -> dict[str, Item]:
    out = {}
    for e in elements(first(package, "manifest"), "item"):
        id_, href = H.squeezed(attribute(e, "id")), H.squeezed(attribute(e, "href"))
        if id_ and href:
            out[id_] = Item(id_, bare(href), resolved(path, href), H.squeezed(attribute(e, "media-type")).lower(), frozenset(attribute(e, "properties").split()))
    return out


def put_entries(entries) -> dict[str, str]:
    """path to title, the first of a path wins."""
    out: dict[str, str] = {}
    for path, title in entries:
        if path and title:
            out.setdefault(path, title)
    return out


def contents(package, manifest: dict[str, Item], archive: Archive) -> tuple[dict[str, str], dict[str, str]]:
    """Tables of contents of both kinds, path to title: (NCX, EPUB 3)."""

    def root_of(item: Item | None):
        content = archive.get(item.path) if item else None
        try:
            return xml(decoded(content)[0]) if content else None
        except ValueError:
            return None

    old = manifest.get(H.squeezed(attribute(first(package, "spine"), "toc"))) or next((i for i in manifest.values() if i.kind == NCX), None)
    points = elements(root_of(old), "navpoint")
    label = lambda p: said(first(first(p, "navlabel") if first(p, "navlabel") is not None else p, "text"))
    ncx = put_entries((resolved(old.path, attribute(first(p, "content"), "src")), label(p)) for p in points if attribute(first(p, "content"), "src"))
    new = next((i for i in manifest.values() if "nav" in i.properties), None)
    navs = elements(root_of(new), "nav")
    is_toc = lambda n: "toc" in attribute(n, "type").lower().split() or attribute(n, "role").lower() == "doc-toc"
    nav = next(filter(is_toc, navs), navs[0] if navs else None)
    return ncx, put_entries((resolved(new.path, attribute(a, "href")), said(a)) for a in elements(nav, "a") if attribute(a, "href"))


def merged_contents(ncx: dict[str, str], nav: dict[str, str]) -> dict[str, str]:
    return ncx | nav


def cover_of(package, path: str, manifest: dict[str, Item], archive: Archive) -> tuple[str, bytes] | None:
    """(media type, bytes) of the first candidate that can be read: by property, by meta, by guide, by name."""
    items = [i for i in manifest.values() if i.kind in COVERS]
    named = next((H.squeezed(attribute(m, "content")) for m in elements(first(package, "metadata"), "meta") if attribute(m, "name").strip().lower() == "cover"), "")
    guide = next((resolved(path, attribute(r, "href")) for r in elements(first(package, "guide"), "reference") if attribute(r, "type").strip().lower() in ("cover", "cover-image")), "")
    wrapped = ""
    if guide and not any(i.path == guide for i in items) and (page := archive.get(guide)):
        try:
            root = xml(decoded(page)[0])
            image = next((e for n in ("img", "image") if (e := first(root, n)) is not None), None)
            wrapped = resolved(guide, attribute(image, "src") or attribute(image, "href"))
        except ValueError:
            pass
    wanted = [
        next((i for i in items if "cover-image" in i.properties), None), manifest.get(named), next((i for i in items if i.path in (guide, wrapped)), None),
        next((i for i in items if COVER_WORDS & set(re.split("[^a-z]+", f"{i.id} {i.href}".lower()))), None),
    ]
    for item in wanted:
        content = archive.get(item.path) if item and item.kind in COVERS else None
        if content and len(content) <= LARGEST_COVER:
            return item.kind, content
    return None


def section_name(href: str, id_: str) -> str:
    name = re.sub(r"\.[^.]+$", "", (href or id_).rsplit("/", 1)[-1])
    return H.squeezed(re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[_-]+", " ", name))) or "Untitled section"


def book(content: bytes, fallback: str = "Untitled book") -> Book:
    """The whole book, raw. Raises ValueError where the archive or its package can't be read."""
    try:
        archive = Archive(content)
    except (zipfile.BadZipFile, OSError) as e:
        raise ValueError("not an EPUB archive") from e
    container = archive.get("META-INF/container.xml")
    if not container:
        raise ValueError("no container")
    roots = elements(xml(decoded(container)[0]), "rootfile")
    root = next((r for r in roots if H.squeezed(attribute(r, "media-type")) == PACKAGE), roots[0] if roots else None)
    path = archive_path(attribute(root, "full-path"))
    if not path or not archive.get(path):
        raise ValueError("no package document")
    package = xml(decoded(archive.get(path))[0])
    about, manifest = first(package, "metadata"), manifest_of(package, path)
    toc, spine = merged_contents(*contents(package, manifest, archive)), elements(first(package, "spine"), "itemref")
    warnings: list[tuple[str, str | None]] = [] if spine else [("no-spine", None)]
    sections = []
    for k, ref in enumerate(spine):
        id_ = H.squeezed(attribute(ref, "idref")) or f"section-{k + 1}"
        item = manifest.get(id_)
        page = archive.get(item.path) if item and item.path else None
        blocks, title, guessed = [], None, False
        if page is not None:
            text, guessed = decoded(page)
            try:
                xml(text)  # what isn't well-formed keeps its place, without text
                tree = H.Tree(text).root
                blocks, stripped = H.without_verse_numbers(H.raw_blocks(tree.first("body") or tree))
                blocks, title = H.kinds(blocks), H.heading_title(tree)
                warnings += [("verse-numbers-stripped", id_)] * stripped
            except ValueError:
                pass
            warnings += [("decode-fallback", id_)] * guessed
        href = item.href if item else ""
        sections.append(SpineSection(id_, href, (toc.get(item.path) if item else None) or title or section_name(href, id_), blocks, guessed))
    text_of = lambda name: said(first(about, name))
    return Book(text_of("title") or fallback, text_of("creator") or "Unknown author", text_of("language") or "und", sections, cover_of(package, path, manifest, archive), warnings)
