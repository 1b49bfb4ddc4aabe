"""HTML documents as raw blocks: a tolerant tree on the standard tokenizer, and the rules that read blocks off it."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

# Elements by what they do.
SKIPPED = frozenset("script style head img svg figure".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LEAVES = frozenset(("p", "blockquote", "li", *HEADINGS))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
SCOPES = frozenset("table td th caption button body html".split())
SPACES = " \t\n\r                 　"
AUTHOR, LANGUAGE = ("author", "dc.creator", "dcterms.creator"), ("language", "dc.language", "dcterms.language")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self):
        """All elements below, in document order, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node is not self:
                yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)


class Tree(HTMLParser):
    """Builds nodes; a paragraph ends where a block begins, list items and cells end each other, stray ends are ignored."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        endless = source.find("<!--", source.rfind("-->") + 1)  # a comment that never ends
        self.feed(source if endless < 0 else source[:endless])
        self.close()

    def _close(self, tag: str, scopes: frozenset = SCOPES) -> bool:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return True
            if self.open[k].tag in scopes:
                return False
        return False

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close("p")
        if tag == "li":
            self._close("li", SCOPES | {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close("dt", SCOPES | {"dl"}) or self._close("dd", SCOPES | {"dl"})
        elif tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag == "body":
            self._close("head", frozenset({"html"}))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close(tag, frozenset({"table"}) if tag in ENDS_P else SCOPES | (ENDS_P - {tag}))

    def handle_data(self, data):
        self.open[-1].children.append(data)


class Document(NamedTuple):
    title: str
    author: str | None
    language: str | None
    blocks: list[tuple[str, str]]  # (kind, raw text)
    stripped: bool  # verse numbers went


def squeezed(value: str | None) -> str:
    return " ".join((value or "").replace("﻿", " ").split())


def hidden(node: Node) -> bool:
    return bool(re.search(r"display\s*:\s*none", node.attributes.get("style", ""), re.I))


def skipped(node: Node) -> bool:
    return node.tag in SKIPPED or hidden(node)


def segments(node: Node) -> list[str]:
    """The text below, cut at breaks; footnote numbers, hidden and skipped elements say nothing."""
    out, todo = [""], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out[-1] += child
        elif skipped(child):
            continue
        elif child.tag == "br":
            out.append("")
        elif not (child.tag in ("sup", "sub") and re.fullmatch(r"[0-9]+", child.text().strip())):
            todo += reversed(child.children)
    return out


def raw_blocks(root: Node) -> list[tuple[str, str]]:
    """(tag, raw text): paragraphs, headings, quotes and items, and divisions without any of these inside."""
    out, todo = [], [c for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if skipped(node):
            continue
        leaf = node.tag in LEAVES or node.tag == "div" and not any(n.tag in LEAVES or n.tag == "div" for n in node.walk())
        if leaf:
            out += [(node.tag, s) for s in segments(node) if s.strip(SPACES)]
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def without_verse_numbers(blocks: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], bool]:
    """Three or more leading numbers that strictly ascend go, all or none."""
    number = re.compile(rf"([0-9]{{1,4}})[{SPACES}]{{2,}}")
    found = {k: m for k, (_, raw) in enumerate(blocks) if (m := number.match(raw))}
    numbers = [int(m[1]) for m in found.values()]
    if len(numbers) < 3 or any(a >= b for a, b in zip(numbers, numbers[1:], strict=False)):
        return blocks, False
    return [(tag, raw[found[k].end() :] if k in found else raw) for k, (tag, raw) in enumerate(blocks)], True


def kinds(blocks: list[tuple[str, str]], narrow: int = 90) -> list[tuple[str, str]]:
    """(kind, raw): a document whose paragraphs are mostly narrow is verse."""
    widths = [len(raw.strip(SPACES)) for tag, raw in blocks if tag == "p"]
    verse = sum(w < narrow for w in widths) * 2 > len(widths)
    kind = {"blockquote": "blockquote", **dict.fromkeys(HEADINGS, "heading"), "p": "verse" if verse else "paragraph"}
    return [(kind.get(tag, "paragraph"), raw) for tag, raw in blocks]


def meta(root: Node, names: tuple[str, ...]) -> str | None:
    for node in root.walk():
        if node.tag == "meta":
            key = node.attributes.get("name", node.attributes.get("property", "")).lower()
            if key in names and (content := squeezed(node.attributes.get("content"))):
                return content
    return None


def document(source: str, fallback: str = "") -> Document:
    root = Tree(source).root
    title = root.first("title")
    page, body = root.first("html"), root.first("body")
    blocks, stripped = without_verse_numbers(raw_blocks(body or root))
    language = meta(root, LANGUAGE) or squeezed(page.attributes.get("lang") if page else None) or None
    return Document(squeezed(title.text() if title else "") or fallback, meta(root, AUTHOR), language, kinds(blocks), stripped)


def heading_title(root: Node) -> str | None:
    """The title element, else the first heading that says something, by level."""
    for tag in ("title", *HEADINGS):
        node = root.first(tag)
        if node and (said := squeezed(node.text())):
            return said
    return None
