"""HTML to Markdown, and Markdown put in order: Arrow UDFs over whole columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "nav", "form", "iframe"}


class _Markdown(HTMLParser):
    """Builds Markdown from tags as they come: blocks end lines, a cell ends with a bar, fences keep text as it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = self.pre = self.quote = 0
        self.lists: list[int | None] = []
        self.links: list[tuple[int, str]] = []
        self.cells = 0

    def block(self, lines: int = 2) -> None:
        self.parts.append("\0" * lines)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        get = dict(attrs).get
        if tag in _SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif tag == "pre":
            self.pre += 1
            self.block()
            self.parts.append("```\n")
        elif tag == "code" and not self.pre:
            self.parts.append("`")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")
        elif tag == "br":
            self.block(1)
        elif tag == "img" and get("src"):
            self.parts.append(f"![{get('alt') or ''}]({get('src')})")
        elif tag == "a":
            self.links.append((len(self.parts), get("href") or ""))
        elif re.fullmatch("h[1-6]", tag):
            self.block()
            self.parts.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.block(1 if self.lists else 2)
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            self.block(1)
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}. "
            self.parts.append("  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "blockquote":
            self.block()
            self.quote += 1
            self.parts.append("\1")
        elif tag == "tr":
            self.block(1)
            self.cells = 0
        elif tag in ("td", "th"):
            self.parts.append(" | " if self.cells else "| ")
            self.cells += 1
        elif tag in ("p", "div", "article", "section", "table", "hr"):
            self.block()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.parts.append("\n```")
            self.block()
        elif tag == "code" and not self.pre:
            self.parts.append("`")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            label = "".join(self.parts[at:]).replace("\0", " ").strip()
            del self.parts[at:]
            self.parts.append(label if not href or href.startswith("#") else href if label in ("", href) else f"[{label}]({href})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.block(1 if self.lists else 2)
        elif tag == "blockquote" and self.quote:
            self.quote -= 1
            self.parts.append("\2")
            self.block()
        elif tag == "tr" and self.cells:
            self.parts.append(" |")
        elif re.fullmatch("h[1-6]|p|div|article|section|table", tag):
            self.block()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data if self.pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        out, depth, fenced = [], 0, False
        raw = re.sub("[ \0]*\0[ \0]*", lambda m: "\n\n" if m[0].count("\0") > 1 else "\n", "".join(self.parts))
        for line in raw.split("\n"):
            depth += line.count("\1")
            fenced ^= line.startswith("```")
            body = line.replace("\1", "").replace("\2", "")
            out.append("> " * depth + (body if fenced else body.strip(" ") if not re.match(r" *(- |\d+\. )", body) else body.rstrip()))
            depth -= line.count("\2")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in out)).strip()


def to_markdown(html: str | None) -> str | None:
    """HTML as Markdown (F6): headings, lists, quotes, code, links, images and table rows."""
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return parser.text()


def tidy_markdown(text: str | None, base: str = "") -> str | None:
    """Outside fences: relative links made absolute, lines of images or badges alone dropped, blank runs clamped."""
    if text is None:
        return None
    out, fence = [], ""
    for line in text.split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (not fence or line.strip().startswith(fence)):
            fence = "" if fence else mark[1]
        elif not fence:
            if re.fullmatch(r"\s*(\[?!\[[^\]]*\]\([^)]*\)(\]\([^)]*\))?\s*)+", line):
                continue
            if base:
                line = re.sub(r"\]\((?![a-z][a-z0-9+.-]*:|#|/)([^)]+)\)", lambda m: f"]({base.rstrip('/')}/{m[1].removeprefix('./')})", line)
        out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


#: Rows that are Python strings at a time; the rest of a batch stays in Arrow's buffers.
ROWS = 64


def _texts(said: Callable[..., str | None], *columns: pa.Array) -> pa.Array:
    """said() of each row, a few rows at a time."""
    parts = []
    for i in range(0, len(columns[0]), ROWS):
        rows = zip(*(c.slice(i, ROWS).to_pylist() for c in columns), strict=True)
        parts.append(pa.array([said(*r) for r in rows], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def markdown_of(html: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(c: pa.Array) -> pa.Array:
        return _texts(to_markdown, c)

    return run(html)


def tidy_of(text: Column, base: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def run(c: pa.Array, b: pa.Array) -> pa.Array:
        return _texts(lambda x, y: tidy_markdown(x, y or ""), c, b)

    return run(text, base)
