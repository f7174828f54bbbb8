"""Plain text and Markdown to blocks.

Both cut a document inside its own row, so ingest runs at scan speed: one stage, no
shuffle, no Python.  Block order is the array position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import INLINE, fold_newlines, trim

MAX_HEADING_LEVEL = 3
LINE_START, LINE_END = "(?<=\\n|\\A)", "(?=\\n|\\z)"
FENCE_LINE = f"{LINE_START}[{INLINE}]*(?:```|~~~)[^\\n]*(?:\\n|\\z)"
HEADING = f"(#{{1,6}})[{INLINE}]+([^\\n]+)"
LIST_MARKER = f"[{INLINE}]*(?:[-*+]|[0-9]{{1,3}}[.)])[{INLINE}]+"
QUOTE = "> "
IMAGE = f"[{INLINE}]*!\\[([^\\]\\n]*)\\]\\(([^)\\n]+)\\)"


def decode_text(content: Column | str) -> Column:
    """UTF-8 without its byte-order mark, else Latin-1; null for UTF-16."""
    content = F.col(content) if isinstance(content, str) else content
    utf8 = content.cast("string")
    return F.when(
        ~F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"),
        F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "\\A\\uFEFF", "")).otherwise(
            F.decode(content, "ISO-8859-1")
        ),
    )


def _trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"[{INLINE}]++{LINE_END}", "")


def _block(kind: str | Column, content: Column, level: int | Column = 0, metadata: str | Column = "{}") -> Column:
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        wrap(kind).alias("type"), wrap(level).cast("int").alias("level"),
        content.alias("content"), wrap(metadata).alias("metadata"),
    )


def text_to_blocks(df: DataFrame, id: str = "document_id", text: str = "text") -> DataFrame:
    """Blank-line separated runs of lines become paragraph blocks."""
    runs = F.split(_trim_line_ends(fold_newlines(text)), "\\n{2,}")
    kept = F.filter(F.transform(runs, trim), lambda p: p != "")
    return df.select(id, F.posexplode(kept).alias("ord", "content")).select(
        id, "ord", F.lit("paragraph").alias("type"), F.lit(0).alias("level"), "content",
        F.lit("{}").alias("metadata"),
    )


def _prose(piece: Column) -> Column:
    """The block of one isolated Markdown line or one soft-wrapped paragraph."""
    whole = lambda pattern: piece.rlike(f"\\A{pattern}\\z")
    marks = F.length(F.regexp_extract(piece, f"\\A{HEADING}\\z", 1))
    return (
        F.when(
            whole(HEADING),
            _block(
                "heading", trim(F.regexp_extract(piece, f"\\A{HEADING}\\z", 2)),
                F.least(marks, F.lit(MAX_HEADING_LEVEL)),
            ),
        )
        .when(
            whole(f"{LIST_MARKER}[^\\n]+"),
            _block("list", F.concat(F.lit("• "), trim(F.regexp_replace(piece, f"\\A{LIST_MARKER}", "")))),
        )
        .when(
            whole(f"{QUOTE}[^\\n]+"),
            _block("paragraph", trim(F.substring(piece, 3, 2**31 - 1)), metadata='{"quote":true}'),
        )
        .when(
            whole(IMAGE),
            _block(
                "image", F.regexp_extract(piece, f"\\A{IMAGE}\\z", 1),
                metadata=F.to_json(F.struct(F.regexp_extract(piece, f"\\A{IMAGE}\\z", 2).alias("src"))),
            ),
        )
        .otherwise(
            _block("paragraph", F.regexp_replace(trim(piece), f"[{INLINE}]*\\n[{INLINE}]*", " "))
        )
    )


def markdown_to_blocks(df: DataFrame, id: str = "document_id", text: str = "text") -> DataFrame:
    """Headings, lists, quotes, images, code and soft-wrapped paragraphs in document order.

    The text is cut at fence lines, which puts code in the odd sections; inside prose every
    single-line construct is isolated by blank lines and the rest are paragraphs.
    """
    alone = f"{HEADING}|{LIST_MARKER}[^\\n]+|{QUOTE}[^\\n]+|{IMAGE}".replace("(#", "(?:#").replace(
        "([^", "(?:[^"
    )
    sections = F.split(fold_newlines(text), FENCE_LINE)

    def blocks(section: Column, i: Column) -> Column:
        closed = i < F.size("_sections") - 1
        code = F.array(
            _block("paragraph", trim(section), metadata=F.when(closed, F.lit('{"preformatted":true}')).otherwise(F.lit("{}")))
        )
        isolated = F.regexp_replace(
            _trim_line_ends(section), f"{LINE_START}({alone}){LINE_END}", "\n$1\n"
        )
        pieces = F.transform(F.split(isolated, "\\n{2,}"), lambda p: F.regexp_replace(p, "\\A\\n+|\\n+\\z", ""))
        return F.when(i % 2 == 1, code).otherwise(F.transform(pieces, _prose))

    rows = F.filter(
        F.flatten(F.transform("_sections", blocks)),
        lambda b: (b["content"] != "") | (b["type"] == "image"),
    )
    return (
        df.select(id, sections.alias("_sections"))
        .select(id, F.posexplode(rows).alias("ord", "b"))
        .select(id, "ord", "b.*")
    )
