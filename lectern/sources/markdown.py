"""Markdown to HTML, the parts that say text: headings, paragraphs, lists, quotes, rules, code, emphasis, links, images."""

from __future__ import annotations

import html
import re

SPAN = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"<img alt='\1'>"),
    (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"<a>\1</a>"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"<strong>\2</strong>"),
    (re.compile(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])"), r"<em>\2</em>"),
    (re.compile(r"~~(.+?)~~"), r"<del>\1</del>"),
]
ITEM = re.compile(r"^\s{0,3}(?:[-*+]|[0-9]{1,9}[.)])\s+(.*)$")
RULE = re.compile(r"^\s{0,3}([-*_])(?:\s*\1){2,}\s*$")


def spans(text: str) -> str:
    """Inline marks; code stays as written."""
    parts = re.split(r"(`+)(.+?)\1", text)
    out = []
    for k in range(0, len(parts), 3):
        said = html.escape(parts[k], quote=False)
        for pattern, put in SPAN:
            said = pattern.sub(put, said)
        out.append(re.sub(r" {2,}\n|\\\n", "<br>\n", said))
        if k + 2 < len(parts):
            out.append(f"<code>{html.escape(parts[k + 2], quote=False)}</code>")
    return "".join(out)


def rendered(source: str) -> str:
    lines = re.split(r"\r\n?|\n", source)
    out, paragraph, items, at = [], [], [], 0

    def flush():
        if paragraph:
            out.append(f"<p>{spans(chr(10).join(paragraph))}</p>")
            paragraph.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{spans(i)}</li>" for i in items) + "</ul>")
            items.clear()

    while at < len(lines):
        line = lines[at]
        if fence := re.match(r"^\s{0,3}(```+|~~~+)", line):
            flush()
            stop = next((k for k in range(at + 1, len(lines)) if lines[k].strip().startswith(fence[1])), len(lines))
            out.append("<pre><code>" + html.escape("\n".join(lines[at + 1 : stop])) + "</code></pre>")
            at = stop + 1
            continue
        if not line.strip():
            flush()
        elif heading := re.match(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            out.append(f"<h{len(heading[1])}>{spans(heading[2])}</h{len(heading[1])}>")
        elif paragraph and (under := re.match(r"^\s{0,3}(=+|-+)\s*$", line)):
            said = spans("\n".join(paragraph))
            paragraph.clear()
            out.append(f"<h{1 if under[1][0] == '=' else 2}>{said}</h{1 if under[1][0] == '=' else 2}>")
        elif RULE.match(line):
            flush()
            out.append("<hr>")
        elif line.lstrip().startswith(">"):
            flush()
            quoted = []
            while at < len(lines) and lines[at].strip():
                quoted.append(re.sub(r"^\s{0,3}> ?", "", lines[at]))
                at += 1
            out.append("<blockquote>" + rendered("\n".join(quoted)) + "</blockquote>")
            continue
        elif item := ITEM.match(line):
            if paragraph:
                flush()
            items.append(item[1])
        elif items:
            items[-1] += "\n" + line.strip()
        elif line.startswith("    ") and not paragraph:
            out.append(f"<pre><code>{html.escape(line[4:])}</code></pre>")
        else:
            paragraph.append(line.strip() if not line.endswith("  ") else line.lstrip())
        at += 1
    flush()
    return "\n".join(out)
