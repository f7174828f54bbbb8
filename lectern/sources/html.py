"""HTML to blocks.  Tag soup needs a parser, so pages go through Arrow batches once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.library import document_text

# Tags without readable text, heading levels, and the block-level tags.
IGNORED = {"script", "style", "head", "meta", "link", "title", "nav", "noscript", "svg", "iframe"}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
BLOCK_LEVEL = {*HEADINGS, "p", "div", "section", "article", "li", "blockquote", "pre", "figcaption"}
PLAIN = {"p", "div", "section", "article", "td", "dd", "dt"}
FLAGGED = {"blockquote": "quote", "pre": "preformatted", "figcaption": "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Open elements a start tag implicitly ends, and the elements that search stops at.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
}
PARAGRAPH_SCOPE = {"td", "th", "table", "li", "button"}
ENDS_PARAGRAPH = BLOCK_LEVEL | {"ul", "ol", "table", "dl"}

BLOCK_COLUMNS = "type string, level int, content string, metadata string"


class _Blocks(HTMLParser):
    """Collects block-level elements that hold no further block-level element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.starts = [], [], 0
        self.muted, self.saw_heading = 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, PARAGRAPH_SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        self.starts += 1
        if tag in BLOCK_LEVEL:
            for element in self.open:
                element[2] = True
        if tag in VOID:
            self._void(tag, dict(attrs))
            return
        self.open.append([tag, self.starts, False, []])
        self.muted += tag in IGNORED

    def _void(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
        elif tag == "img" and not self.muted:
            alt, src = attrs.get("alt") or "", attrs.get("src") or ""
            self._add(self.starts, "image", alt or src, 0, {"src": src, **({"alt": alt} if alt else {})})

    def handle_data(self, data):
        if not self.muted:
            for element in self.open:
                element[3].append(data)

    def handle_endtag(self, tag):
        self._end({tag}, set())

    def _end(self, names, scope):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                while len(self.open) > at:
                    self._close(len(self.open) - 1)
                return
            if self.open[at][0] in scope:
                return

    def _close(self, at):
        tag, start, has_blocks, text = self.open.pop(at)
        if tag in IGNORED:
            self.muted -= 1
        if self.muted or tag in IGNORED or has_blocks:
            return
        text = "".join(text)
        if tag in HEADINGS:
            self.saw_heading = True
            self._add(start, "heading", text, HEADINGS[tag], {})
        elif tag == "li":
            self._add(start, "list", "• " + text, 0, {})
        elif tag in FLAGGED:
            self._add(start, "paragraph", text, 0, {FLAGGED[tag]: True})
        elif tag in PLAIN:
            self._add(start, "paragraph", text, 0, {})

    def _add(self, start, kind, text, level, metadata):
        text = squeeze(text)
        if text:
            self.found.append((start, kind, level, text, json.dumps(metadata, separators=(",", ":"), ensure_ascii=False)))

    def result(self):
        self.close()
        while self.open:
            self._close(len(self.open) - 1)
        return [row[1:] for row in sorted(self.found, key=lambda row: row[0])]


def squeeze(text: str) -> str:
    return re.sub("\n{2,}", "\n", re.sub("[ \t\r\f\v]+", " ", text)).strip()


def blocks_of(html: str, title: str | None = None) -> list[tuple]:
    """``(type, level, content, metadata)`` rows of one page."""
    parser = _Blocks()
    parser.feed(html)
    rows = parser.result()
    if title and title.strip() and not parser.saw_heading:
        rows.insert(0, ("title", 1, squeeze(title), "{}"))
    return rows


def frames(rows: Iterable[tuple], columns: list[str], size: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """Frames of about ``size`` characters or bytes, so that a task never holds the output of a whole batch."""
    part, weight = [], 0
    for row in rows:
        part.append(row)
        weight += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if weight >= size:
            yield pd.DataFrame(part, columns=columns)
            part, weight = [], 0
    if part:
        yield pd.DataFrame(part, columns=columns)


def html_to_blocks(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """``(id, ord, type, level, content, metadata)`` in document order."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id, "ord", "type", "level", "content", "metadata"]
        for batch in batches:
            yield from frames(
                (
                    (key, ord_, *row)
                    for key, source in zip(batch[id], batch[html])
                    for ord_, row in enumerate(blocks_of(source or ""))
                ),
                names,
            )

    key = pages.schema[id].dataType.simpleString()
    return pages.select(id, html).mapInPandas(parse, f"{id} {key}, ord int, {BLOCK_COLUMNS}")


def html_plain_text(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """Readable text of each page: its blocks without images, joined by blank lines."""
    blocks = html_to_blocks(pages, id, html).filter(F.col("type") != "image")
    return document_text(blocks.withColumnRenamed(id, "document_id")).withColumnRenamed("document_id", id)
