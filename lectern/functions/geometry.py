"""Page geometry: positioned pieces of text to lines, lines to paragraphs or verse. Plain functions over one page."""

from __future__ import annotations

import math
import re
from statistics import median
from typing import NamedTuple

import numpy as np

# Fixed values.
ROW_SLACK, LEAST_SLACK, SPACE_SHARE, LEAST_SPACE = 0.35, 1.5, 0.12, 0.5
COLUMN_GAP, COLUMN_FONTS, ORDER_GAP, ORDER_FONTS, WIDTH_PER_CHAR = 48, 5, 80, 6, 0.5
GAP_RATIO, GAP_FONTS, FONT_RATIO, INDENT_FONTS, ALIGN_FONTS = 1.55, 1.45, 1.28, 1.2, 0.9
WIDE, PROSE_WIDE, CONTINUED, CAPITALIZED, RAGGED, VERSE_WIDE = 0.68, 0.67, 0.5, 0.75, 0.38, 0.75
LONG_ROW = 64  # items; the sums of longer rows are made one by one
ROUNDING = 1e-9  # of the widest line: a width that is just its share is not parted from it by the unit it is measured in


class Item(NamedTuple):
    text: str
    x: float
    y: float
    width: float | None
    height: float
    place: int

    @property
    def font(self) -> float:
        return max(1.0, abs(self.height))

    @property
    def right(self) -> float:
        return self.x + max(0.0, len(self.text) * self.font * WIDTH_PER_CHAR if self.width is None else self.width)


class Line(NamedTuple):
    text: str
    x: float
    y: float
    width: float
    font: float


def middle(values) -> float:
    values = list(values)
    return median(values) if values else 0.0


def said(items: list[Item]) -> str:
    """Items from left to right, with a space where the gap is wide enough for one."""
    out, before = "", None
    for item in sorted(items, key=lambda i: (i.x, i.place)):
        if before is not None and out:
            gap = item.x - (before.x + max(0.0, before.width or 0.0))
            apart = gap > max(LEAST_SPACE, min(before.font, item.font) * SPACE_SHARE)
            if apart and not out[-1].isspace() and not item.text[0].isspace():
                out += " "
        out, before = out + item.text, item
    return " ".join(out.split())


def columns(items: list[Item]) -> list[list[Item]]:
    out: list[list[Item]] = []
    for item in sorted(items, key=lambda i: (i.x, i.place)):
        if out and item.x - out[-1][-1].right <= max(COLUMN_GAP, max(out[-1][-1].font, item.font) * COLUMN_FONTS):
            out[-1].append(item)
        else:
            out.append([item])
    return out


def lines_of(items: list[Item]) -> list[Line]:
    """Baseline rows with a running mean, cut at column gaps; a page of two columns reads the left one first."""
    items = [i for i in items if i.text and i.text.strip()]
    if not items:
        return []
    slack = max(LEAST_SLACK, middle(i.font for i in items) * ROW_SLACK)
    rows: list[list] = []  # [mean y, items, sum of y], from top to bottom
    for item in sorted(items, key=lambda i: (-i.y, i.x, i.place)):
        # Items come from the top, so only the last rows can be near; of those within the slack the first counts.
        row, k = None, len(rows) - 1
        while k >= 0 and rows[k][0] - item.y <= 3 * slack:
            if abs(rows[k][0] - item.y) <= slack:
                row = rows[k]
            k -= 1
        if row is None:
            rows.append([item.y, [item], item.y])
        else:
            row[1].append(item)
            row[2] += item.y
            row[0] = row[2] / len(row[1])
    lines, parted = [], False
    for y, own, _ in rows:
        groups = columns(own)
        parted |= len(groups) > 1
        for g in groups:
            left = min(i.x for i in g)
            lines.append(Line(said(g), left, y, max(i.right for i in g) - left, middle(i.font for i in g)))
    return in_order([line for line in lines if line.text], parted)


def in_order(lines: list[Line], parted: bool) -> list[Line]:
    """Lines as they are read: from the top, of two columns (some row was parted) the left one first."""
    if parted and len(lines) >= 4:
        xs = sorted(line.x for line in lines)
        gap, at = max(((b - a, -k) for k, (a, b) in enumerate(zip(xs, xs[1:], strict=False))), default=(0, 0))
        if gap > max(ORDER_GAP, middle(line.font for line in lines) * ORDER_FONTS):
            cut = (xs[-at] + xs[1 - at]) / 2
            return sorted(lines, key=lambda line: (line.x >= cut, -line.y))
    return sorted(lines, key=lambda line: (-line.y, line.x))


def middles(values: np.ndarray, groups: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The median of each group; groups are numbered and lie together."""
    if values[0] == values.min() == values.max():
        return np.full(len(starts), values[0])
    own = values[np.lexsort((values, groups))]
    low, high = own[starts + (sizes - 1) // 2], own[starts + sizes // 2]
    return np.where(sizes % 2 == 1, low, (low + high) / 2)


def sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each group, added from its first value on, as a running sum has it."""
    by = np.argsort(-sizes, kind="stable")
    out, begin, size = np.zeros(len(starts)), starts[by], sizes[by]
    for k in range(min(int(size[0]), LONG_ROW)):
        n = int(np.searchsorted(-size, -k))  # those of more than k
        out[:n] += values[begin[:n] + k]
    for k in range(int(np.searchsorted(-size, -LONG_ROW))):
        out[k] = np.cumsum(np.concatenate((out[k : k + 1], values[begin[k] + LONG_ROW : begin[k] + size[k]])))[-1]
    back = np.empty_like(out)
    back[by] = out
    return back


def lines_of_pages(page: np.ndarray, text: list, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, place: np.ndarray):
    """(page, line, text, x, y, width, font) as columns: lines_of() of many pages, whose items lie together; no value is NaN.

    Where rows are far apart and each within the slack, a row is a run of items from the top; pages with other rows go through
    lines_of() one by one, and of pages with several columns the order of their lines.
    """
    keep = np.fromiter((bool(t) and not t.isspace() for t in text), bool, len(text))
    at = np.flatnonzero(keep)
    if not len(at):
        return page[:0], page[:0], [], x[:0], x[:0], x[:0], x[:0]
    page, x, y, width, height, place = (c[at] for c in (page, x, y, width, height, place))
    font, n = np.maximum(1.0, np.abs(height)), len(at)
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    sizes = np.diff(np.r_[starts, n])
    own = np.repeat(np.arange(len(starts)), sizes)
    slack = np.maximum(LEAST_SLACK, middles(font, own, starts, sizes) * ROW_SLACK)
    order = np.lexsort((place, x, -y, own))
    down = y[order]
    # A running mean may leave its values by so much, through rounding.
    doubt = (4e-16 * (sizes + 4) * np.maximum.reduceat(np.abs(y), starts))[own]
    gap, most = np.r_[np.inf, down[:-1] - down[1:]], slack[own]
    gap[starts] = np.inf
    top = np.flatnonzero(gap > most)
    many = np.diff(np.r_[top, n])
    spread = down[top] - down[top + many - 1]
    odd = np.zeros(len(starts), bool)
    odd[own[np.abs(gap - most) <= doubt]] = True
    odd[own[top[spread > most[top] - doubt[top]]]] = True
    mean = sums(down, top, many) / many
    row = np.repeat(np.arange(len(top)), many)
    # `order` lists items by row; now from left to right in it.
    order = order[np.lexsort((place[order], x[order], row))]
    left, right, size = x[order], (x + np.maximum(0.0, width))[order], font[order]
    begins = np.r_[True, row[1:] != row[:-1]]
    away, larger, smaller = np.r_[np.inf, left[1:] - right[:-1]], np.r_[1.0, np.maximum(size[1:], size[:-1])], np.r_[1.0, np.minimum(size[1:], size[:-1])]
    begins |= away > np.maximum(COLUMN_GAP, larger * COLUMN_FONTS)
    apart = ~begins & (away > np.maximum(LEAST_SPACE, smaller * SPACE_SHARE))
    first = np.flatnonzero(begins)
    length = np.diff(np.r_[first, n])
    of = np.repeat(np.arange(len(first)), length)
    said_ = [f" {text[k]}" if a else text[k] for k, a in zip(at[order].tolist(), apart.tolist(), strict=True)]
    texts = [" ".join("".join(said_[a:b]).split()) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
    lines_page, lines_x, lines_y = own[first], left[first], mean[row[first]]
    lines_width, lines_font = np.maximum.reduceat(right, first) - lines_x, middles(size, of, first, length)
    several = np.bincount(lines_page, minlength=len(starts)) > np.bincount(own[top], minlength=len(starts))
    special = np.flatnonzero(odd | several)
    if len(special):
        ends = np.searchsorted(lines_page, np.arange(len(starts) + 1))
        line_of = lambda k: Line(texts[k], float(lines_x[k]), float(lines_y[k]), float(lines_width[k]), float(lines_font[k]))
        made = {}
        for p in special.tolist():
            if odd[p]:
                rows = range(starts[p], starts[p] + sizes[p])
                made[p] = lines_of([Item(text[at[k]], float(x[k]), float(y[k]), float(width[k]), float(height[k]), int(place[k])) for k in rows])
            else:
                made[p] = in_order([line_of(k) for k in range(ends[p], ends[p + 1])], True)
        plain = ~(odd | several)[lines_page]
        texts = [t for t, p in zip(texts, plain.tolist(), strict=True) if p] + [line.text for lines in made.values() for line in lines]
        more = np.array([line[1:] for lines in made.values() for line in lines], float).reshape(-1, 4)
        lines_page = np.r_[lines_page[plain], np.repeat(np.array(list(made)), [len(lines) for lines in made.values()])]
        lines_x, lines_y, lines_width, lines_font = (np.r_[c[plain], more[:, k]] for k, c in enumerate((lines_x, lines_y, lines_width, lines_font)))
        by = np.argsort(lines_page, kind="stable")
        texts, lines_page, lines_x, lines_y, lines_width, lines_font = [texts[k] for k in by.tolist()], lines_page[by], lines_x[by], lines_y[by], lines_width[by], lines_font[by]
    begun = np.searchsorted(lines_page, lines_page)
    return page[starts][lines_page], np.arange(len(lines_page)) - begun, texts, lines_x, lines_y, lines_width, lines_font


def runs_of(lines: list[Line]) -> list[list[Line]]:
    """Lines from top to bottom, cut at wide gaps, changes of font and, from the third line on, indents."""
    lines = sorted(lines, key=lambda line: (-line.y, line.x))
    gaps = [max(0.0, a.y - b.y) for a, b in zip(lines, lines[1:], strict=False)]
    usual, out = middle(g for g in gaps if g > 0), []
    for line in lines:
        if out:
            own, before = out[-1], out[-1][-1]
            fonts = max(before.font, line.font) / max(1.0, min(before.font, line.font))
            indent = len(own) >= 2 and line.x - before.x > max(before.font, line.font) * INDENT_FONTS
            if not (before.y - line.y > max(usual * GAP_RATIO, before.font * GAP_FONTS) or fonts > FONT_RATIO or indent):
                own.append(line)
                continue
        out.append([line])
    return out


def is_prose(run: list[Line]) -> bool:
    spread = lambda values: max(values) - min(values)
    aligned = spread([line.x for line in (run[1:] if len(run) > 2 else run)]) <= middle(line.font for line in run) * ALIGN_FONTS
    most, inside = max(line.width for line in run), run[:-1]
    wide = sum(line.width >= most * (WIDE - ROUNDING) for line in inside) / max(1, len(inside))
    continued = sum(not re.search(r"[.!?][\"')\]]?$", line.text.strip()) for line in inside) / max(1, len(inside))
    capital = sum(bool(re.match(r"[\"'(\[]*[A-Z]", line.text.strip())) for line in run) / len(run)
    ragged = spread([line.width for line in run]) > most * (RAGGED + ROUNDING)
    verse = len(run) >= 3 and capital >= CAPITALIZED and (ragged or wide < VERSE_WIDE)
    return aligned and wide >= PROSE_WIDE and continued >= CONTINUED and not verse


def blocks_of(lines: list[Line]) -> list[tuple[str, str]]:
    """(kind, text): a run of prose is one paragraph, others a block a line."""
    out = []
    for run in runs_of(lines):
        if len(run) == 1:
            out.append(("paragraph", run[0].text))
        elif is_prose(run):
            out.append(("paragraph", " ".join(line.text for line in run)))
        else:
            out += [("verse", line.text) for line in run]
    return out


def height_of(c: float, d: float) -> float:
    """Height of an item from its transform, where it has none of its own."""
    return math.hypot(c, d)
