"""HTML extraction by line-block distribution.

Markup is stripped in one pass into lines, one per block of text, each with its place among the page's containers. Boilerplate told by
element, role or hiding leaves empty lines in its place, and so do containers whose class or id says so: comments, adverts,
menus, notices and the like always, looser names (share, social, widget) only where the container has no surge of its own.

Each line weighs its characters outside links, and the weights are summed over sliding windows of lines of one container: text
surges where a sum reaches SURGE (or the page's largest sum, if that is less) and dives where windows fall below it. The text is
what lies between surge and dive: the innermost container of several lines that holds SHARE of the surging weight is taken whole,
with its short lines, and so is the last main heading before it and what surges elsewhere. Where no container holds the text
together, windows run over container edges, and short lines between surges stay. A run of lines of links only is a dive
wherever it lies, but not in an article element. Where a page has an article or main element with text, lines outside
count nothing and any text inside is a surge.

If names leave no text, they count nothing; a form that wraps the whole page is no boilerplate. Null or empty html gives an empty
text; repeated rows have a result each; an empty table gives no rows; very long pages are read whole, in time that grows with
their length; a page's other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from html import unescape
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do to text.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title select option".split())
ASIDE = frozenset("nav header footer aside form button dialog menu head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
CONTAINER = frozenset("div section ul ol dl table details fieldset figure center".split())  # class and id tell on these only
PLACES = frozenset("div section fieldset details center td th".split())  # containers that part the text, outside an article
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words of class and id names.
# Each of these tells comments or adverts as a part of a name.
PARTS = frozenset("comments commentlist commentform replies disqus ad ads adslot adbox adunit advert adverts advertisement advertisements advertising adsense".split())
# A name whose words are all known, one of them of these, tells boilerplate ...
BOILERPLATE = frozenset(
    "cookie cookies consent gdpr popup newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar related recommended recommendations respond footer pagination pager"
    " copyright skip sponsor sponsored sponsors".split()
)
# ... and of these only where it holds no surge of its own.
LOOSE = frozenset("banner promo promotion notice modal overlay widget widgets share sharing social comment header masthead toolbar".split())
NEUTRAL = frozenset("site page main top bottom left right global primary secondary box bar list container wrapper wrap block area section slot unit link links item items inner outer content post posts article thread form bg row reader user".split())
NAME_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=\d)|\d+x?\d*").split
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NEXT_IN_TAG = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WINDOW, SURGE, SHARE = 3, 80, 0.8  # lines in a window; characters outside links that make a surge; share of the main container


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "" or "/", tag name, attributes) in turn; the last has no name. Comments and raw elements are left out.

    A search that finds no end is not made again, so time grows with the length.
    """
    at, start, n, missing = 0, 0, len(html), set()
    pieces = []

    def find(what: str, since: int) -> int:
        if what in missing:
            return -1
        if (k := html.find(what, since)) < 0:
            missing.add(what)
        return k

    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            pieces.append(html[start:at])
            end = find("-->", at + 4)
            at = start = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            pieces.append(html[start:at])
            end = find("]]>", at) if html.startswith("<![CDATA[", at) else -1
            end = end + 2 if end >= 0 else find(">", at)
            at = start = n if end < 0 else end + 1
            continue
        m = OPEN.match(html, at)
        if not m:
            at += 1
            continue
        end = m.end()
        while (q := NEXT_IN_TAG.search(html, end)) and q[0] != ">":
            close = find(q[0], q.end())
            end = q.end() if close < 0 else close + 1
        pieces.append(html[start:at])
        if not q:  # the page ends inside a tag
            at = start = n
            break
        name, attributes = m[2].lower(), html[m.end() : q.start()]
        at = start = q.end()
        if not m[1] and name in RAW:
            if name not in missing:
                close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if close:
                    at = start = close.end()
                    continue
                missing.add(name)
            if name in ("script", "style"):
                at = start = n
                break
            continue
        yield "".join(pieces), m[1], name, attributes
        pieces.clear()
    pieces.append(html[start:])
    yield "".join(pieces), "", "", ""


SURE, MAYBE = 2, 1


def named(value: str) -> int:
    """SURE for boilerplate, MAYBE for what is if it holds no surge, 0 for others."""
    found = 0
    for token in value.lower().split():
        words = [w for w in NAME_WORDS(token) if w]
        if any(w in PARTS for w in words) or words[-2:] == ["comment", "list"]:
            return SURE
        if words and all(w in BOILERPLATE or w in LOOSE or w in NEUTRAL for w in words):
            found = max(found, SURE if any(w in BOILERPLATE for w in words) else MAYBE if any(w in LOOSE for w in words) else 0)
    return found


def boilerplate(name: str, attributes: str, names: bool) -> int:
    if name in ASIDE:
        return SURE
    if not attributes.strip() or name in ("html", "body", "article", "main"):
        return 0
    values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in (values.get("style") or "").replace(" ", "").lower():
        return SURE
    if (values.get("role") or "").lower() in ROLES:
        return SURE
    return max(named(values.get(k) or "") for k in ("class", "id")) if names and name in CONTAINER else 0


class Place:
    """A container: its parent, its depth, and how many came before it."""

    __slots__ = ("parent", "depth", "serial")

    def __init__(self, parent: Place | None, serial: int):
        self.parent, self.serial, self.depth = parent, serial, parent.depth + 1 if parent else 1


class Line(NamedTuple):
    text: str
    linked: int = 0  # characters of it in links
    main: bool = False  # inside article or main
    article: bool = False
    heading: bool = False
    place: Place | None = None  # the innermost container around it
    element: str = ""  # the innermost block element

    @property
    def weight(self) -> int:
        return len(self.text) - self.linked

    def joins(self, other: Line, across: bool) -> bool:
        """May a window hold both? In one container, or, across edges, as texts of like elements in containers side by side."""
        if self.place is other.place:
            return True
        return across and self.place is not None and other.place is not None and self.place.parent is other.place.parent and self.element == other.element


class Lines:
    """The stack of open elements, and the lines so far."""

    def __init__(self, keep: frozenset, names: bool):
        self.keep, self.names, self.out, self.own, self.linked = keep, names, [], [], 0
        self.stack, self.where, self.blocks = [], defaultdict(list), []  # (name, drops, line at its start); places by name, of blocks
        self.dropped = self.inside = self.articles = self.links = self.heads = self.serial = 0
        self.places: list[Place] = []
        self.surge = -1  # the last line known to begin a stretch that surges

    def add(self, text: str) -> None:
        if text and not self.dropped:
            self.own.append(text)
            self.linked += len(text) if self.links else 0

    def flush(self) -> None:
        if self.own and (text := " ".join(unescape("".join(self.own)).split())):
            self.out.append(Line(text, min(self.linked, len(text)), self.inside > 0, self.articles > 0, self.heads > 0, self.places[-1] if self.places else None, self.stack[self.blocks[-1]][0] if self.blocks else ""))
        self.own.clear()
        self.linked = 0

    def gap(self) -> None:
        """Empty lines as deep as the window; one gap is as good as many."""
        if self.out and self.out[-1].text:
            self.out.extend([Line("")] * WINDOW)

    def pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            if self.stack[-1][0] in BLOCK:
                self.flush()
                self.blocks.pop()
            name, drops, start = self.stack.pop()
            self.where[name].pop()
            self.dropped -= drops == SURE
            self.inside -= name in ("article", "main")
            self.articles -= name == "article"
            self.links -= name == "a"
            self.heads -= name in ("h1", "h2")
            if name in PLACES:
                self.places.pop()
            if drops == MAYBE and not self.dropped and self.surge < start:  # else one inside surges already
                if any(surging(self.out[start:], SURGE)):
                    self.surge = start
                else:
                    del self.out[start:]
                    self.gap()
            elif drops == SURE:
                self.gap()

    def last(self, *names: str) -> int:
        return max((self.where[n][-1] for n in names if self.where[n]), default=-1)

    def close(self, name: str) -> None:
        known = self.last(name)
        if known >= 0 and (name in BLOCK or name in ASIDE or not self.blocks or self.blocks[-1] <= known):
            self.pop(known)
        elif name in BLOCK and not self.dropped:
            self.flush()

    def open(self, name: str, attributes: str) -> None:
        if name == "body" and (head := self.last("head")) >= 0:
            self.pop(head)  # </head> may be left out
        if name in BLOCK and not self.dropped:
            self.flush()
        if name in CLOSES_P and (p := self.last("p")) > self.last("table", "div", "section"):
            self.pop(p)
        if self.stack and self.stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
            self.pop(len(self.stack) - 1)
        if name == "a" and (a := self.last("a")) >= 0 and a == len(self.stack) - 1:
            self.pop(a)
        if name in VOID or attributes.endswith("/"):
            return
        drops = 0 if name in self.keep else boilerplate(name, attributes, self.names)
        if not (drops or name in BLOCK or name == "a"):
            return  # other inline elements change nothing
        if drops == SURE and not self.dropped:
            self.flush()
            self.gap()
        self.dropped += drops == SURE
        self.inside += name in ("article", "main")
        self.articles += name == "article"
        self.links += name == "a"
        self.heads += name in ("h1", "h2")
        if name in PLACES:
            self.serial += 1
            self.places.append(Place(self.places[-1] if self.places else None, self.serial))
        self.where[name].append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, drops, len(self.out)))


def lines_of(html: str, keep: frozenset = frozenset(), names: bool = True) -> list[Line]:
    """The lines of a page; boilerplate leaves empty ones."""
    lines = Lines(keep, names)
    for text, slash, name, attributes in tokens(html):
        lines.add(text)
        if slash:
            lines.close(name)
        elif name:
            lines.open(name, attributes)
    lines.pop(0)
    lines.flush()
    return lines.out


def surged(weights: list[int], surge: int, joined: Callable[[int, int], bool] = lambda i, j: True) -> list[bool]:
    """Which lines lie between a surge and the dive that ends it: those of any window whose sum reaches `surge`. A window ends where
    neighbours aren't joined."""
    on = [False] * len(weights)
    for i in range(len(weights)):
        total, j = weights[i], i
        while j > 0 and i - j + 1 < WINDOW and joined(j - 1, j):
            j -= 1
            total += weights[j]
        if total >= surge:
            on[j : i + 1] = [True] * (i + 1 - j)
    return on


def surging(lines: list[Line], surge: int, across: bool = False) -> list[bool]:
    return surged([line.weight for line in lines], surge, lambda i, j: lines[i].joins(lines[j], across))


def inside_main(lines: list[Line], on: list[bool]) -> list[bool] | None:
    """Which lines lie in the innermost container of several lines that holds SHARE of the surging weight; none if there is none."""
    weight, count, places = defaultdict(int), defaultdict(int), {}
    for line, surges in zip(lines, on, strict=True):
        place = line.place
        if line.text and place is not None:
            count[place.serial] += 1
            weight[place.serial] += line.weight if surges else 0
        while place is not None and place.serial not in places:
            places[place.serial] = place
            place = place.parent
    for serial in sorted(places, reverse=True):  # a parent comes before its children
        if (parent := places[serial].parent) is not None:
            count[parent.serial] += count[serial]
            weight[parent.serial] += weight[serial]
    least = SHARE * sum(line.weight for line, surges in zip(lines, on, strict=True) if surges)
    held = [p for s, p in places.items() if weight[s] >= max(1, least) and count[s] > 1]
    if not held:
        return None
    inner, within = max(held, key=lambda p: p.depth), set()
    for serial in sorted(places):
        if serial == inner.serial or places[serial].parent is not None and places[serial].parent.serial in within:
            within.add(serial)
    return [line.place is not None and line.place.serial in within for line in lines]


def chosen(lines: list[Line]) -> list[bool]:
    """Which lines are the text, of a page without article and main."""
    on, surge = surging(lines, SURGE), SURGE
    if not any(on):  # the most that any window holds
        low, surge = 1, SURGE - 1
        while low < surge:
            mid = (low + surge + 1) // 2
            low, surge = (mid, surge) if any(surging(lines, mid)) else (low, mid - 1)
        on = surging(lines, surge)
    inner = inside_main(lines, on)
    if inner:
        on = [kept or within for kept, within in zip(on, inner, strict=True)]
    else:
        on, last = surging(lines, surge, across=True), None
        for i, line in enumerate(lines):
            if on[i]:
                if last is not None:
                    on[last:i] = [True] * (i - last)
                last = i
            elif not line.text:
                last = None
    first = on.index(True) if True in on else 0
    head = next((i for i in range(first - 1, -1, -1) if lines[i].heading), None)
    if head is not None:
        on[head] = True
    return on


def main_text(html: str) -> str:
    for keep, names in ((frozenset(), True), (frozenset(), False), (frozenset({"form"}), False)):
        lines = lines_of(html, keep, names)
        if any(line.text for line in lines):
            break
    else:
        return ""
    if any(line.main and line.text for line in lines):
        on = [line.main for line in lines]
    else:
        on = chosen(lines)
    only_links = [bool(line.text) and not line.weight and not line.article for line in lines]
    for i in range(len(lines) - WINDOW + 1):
        if all(only_links[i : i + WINDOW]):
            on[i : i + WINDOW] = [False] * WINDOW
    return "\n".join(line.text for line, kept in zip(lines, on, strict=True) if kept and line.text)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    @F.arrow_udf("string")
    def text(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in html:
            yield pa.array([main_text(h or "") for at in range(0, len(part), 64) for h in part.slice(at, 64).to_pylist()], pa.string())

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
