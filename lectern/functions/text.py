"""Text expressions.  Every function maps a Column to a Column and stays in the JVM.

Spark counts code points where the semantics being reproduced count UTF-16 units;
the two agree for the Basic Multilingual Plane.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import read_number_tokens

# The Unicode spaces a trim removes, and the narrower set regex `\s` means.
SPACE = "\\t-\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
TRIM = SPACE + "\\x85"
TRIM_CHARS = "".join(
    chr(n) for n in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
# The same set without the line feed.
INLINE = "\\t\\x0B-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"

# A private-use character stands for a dot that does not end a sentence.
DOT_MASK = "\ue000"
# Unicode noncharacters, reserved for internal use, fence tokens inside one string.
FENCE = "\ufdd0"
CUT = "\ufdd1"

# Abbreviations whose dot never ends a sentence.
ABBREVIATIONS = (
    "etc", "vs", "cf", "mr", "mrs", "ms", "dr", "prof", "vol", "fig",
    "tp", "ks", "ts", "gs", "ths", "bs", "gv", "đh", "khtn",
)
# Fixed value: letters whose following dot is read as an initial.
INITIALS = "A-ZÀÁẢÃẠĂÂĐÊÉÈẺẼẸÔƠÙÚỦŨỤƯỲÝỶỸỴ"
# Fixed value: marks that end a sentence and quotes or brackets that may close it.
TERMINATORS = ".!?…"
CLOSERS = "\"”’'»)\\]"

# Addresses, grouped thousands, numbers and paragraph breaks as they have to be found.
URL_OR_EMAIL = (
    f"(?i)(?:https?://[^{SPACE}]+|www\\.[^{SPACE}]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+)"
)
GROUPED_THOUSANDS = "(?<![0-9])[0-9]{1,3}(?:\\.[0-9]{3})+(?![0-9])"
NUMBER = "[0-9]+(?:[.,][0-9]+)?"
PARAGRAPH_BREAK = f"\\n[{SPACE}]*\\n+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(TRIM_CHARS))


def trim_right(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(TRIM_CHARS))


def is_blank(c: Column | str) -> Column:
    return ~_col(c).rlike(f"[^{TRIM}]")


def has_text(c: Column | str) -> Column:
    """True where there is something to read; null counts as no text."""
    return F.coalesce(_col(c).rlike(f"[^{TRIM}]"), F.lit(False))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"[{SPACE}]+", " ")


def fold_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\\r\\n?", "\n")


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def contains_any_case(text: Column, word: str) -> Column:
    """A byte search for every upper and lower case spelling: a cheap test before a costly regex."""
    spellings = {"".join(c) for c in product(*[(c.lower(), c.upper()) for c in word])}
    return reduce(or_, [F.contains(text, F.lit(s)) for s in sorted(spellings)])


def fenced(text: Column, pattern: str) -> Column:
    """The text as an array whose odd elements are the matches of ``pattern``."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{FENCE}$1{FENCE}"), FENCE)


def rewrite_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace every match of ``pattern`` by ``rewrite(match)``, a Column expression.

    ``text`` is referenced once, so nested rewrites stay linear in plan size.
    """
    pieces = fenced(text, pattern)
    return F.array_join(
        F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, rewrite(piece)).otherwise(piece)), ""
    )


# -- normalization for speech ------------------------------------------------------


def normalize_whitespace(c: Column | str) -> Column:
    """Fold line endings, trim every line, keep paragraph breaks, squeeze runs of spaces."""
    text = F.translate(fold_newlines(c), "\t", " ")
    text = F.regexp_replace(text, PARAGRAPH_BREAK, "\n\n")
    text = F.array_join(F.transform(F.split(text, "\n"), trim), "\n")
    return trim(F.regexp_replace(text, " {2,}", " "))


def expand_units(c: Column | str) -> Column:
    """Percent signs after a digit and the currency marks become words."""
    raw = _col(c)
    percent = F.regexp_replace(raw, f"(?<=[0-9])[{SPACE}]*%", " phần trăm")
    text = F.replace(F.when(F.contains(raw, F.lit("%")), percent).otherwise(raw), F.lit("₫"), F.lit(" đồng"))
    money = F.regexp_replace(text, f"(?i)(?<=[0-9])[{SPACE}]*VND", " đồng")
    return F.when(contains_any_case(raw, "vnd"), money).otherwise(text)


def ungroup_thousands(c: Column | str) -> Column:
    return rewrite_matches(_col(c), GROUPED_THOUSANDS, lambda token: F.translate(token, ".", ""))


def read_numbers(c: Column | str) -> Column:
    return F.array_join(read_number_tokens(fenced(_col(c), NUMBER)), "")


def normalize_speech(c: Column | str) -> Column:
    """Whitespace, then units, then grouped thousands, then numbers: the order matters."""
    text = bind(normalize_whitespace(c), lambda t: read_numbers(ungroup_thousands(expand_units(t))))
    return F.coalesce(trim(text), F.lit(""))


# -- paragraphs and sentences ------------------------------------------------------


def paragraph_array(c: Column | str) -> Column:
    pieces = F.transform(F.split(_col(c), PARAGRAPH_BREAK), trim)
    return F.filter(pieces, lambda p: p != "")


# Every rule stands behind the dot, so that the text is scanned for dots alone: between digits, after
# an abbreviation that begins a word, after an initial that a space follows.
INNER_DOT = (
    f"\\.(?:(?<=[0-9]\\.)(?=[0-9])|(?<=(?<![\\p{{L}}\\p{{N}}])(?iu:{'|'.join(ABBREVIATIONS)})\\.)|(?<=[{INITIALS}]\\.)(?=[{SPACE}]))"
)


def mask_dots(c: Column | str) -> Column:
    """Hide every dot that does not end a sentence: first those of addresses, then those inside and after words."""
    text = _col(c)
    addresses = rewrite_matches(
        text, URL_OR_EMAIL, lambda token: F.regexp_replace(token, f"\\.(?=[^{SPACE}])", DOT_MASK)
    )
    maybe = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | contains_any_case(text, "www.")
    return F.regexp_replace(F.when(maybe, addresses).otherwise(text), INNER_DOT, DOT_MASK)


def sentence_array(paragraph: Column | str) -> Column:
    """The sentences of one trimmed paragraph, in order."""
    cut = F.regexp_replace(
        mask_dots(paragraph), f"([{TERMINATORS}]+[{CLOSERS}]*)(?=[{SPACE}]|\\z)", f"$1{CUT}"
    )
    pieces = F.transform(F.split(cut, CUT), lambda s: trim(F.translate(s, DOT_MASK + "\n", ". ")))
    return F.filter(pieces, lambda s: s != "")


# -- names and keys ----------------------------------------------------------------


def title_from_text(c: Column | str, words: int = 8, fallback: str = "Văn bản") -> Column:
    parts = F.split(trim(collapse_spaces(c)), " ")
    head = F.array_join(F.slice(parts, 1, words), " ")
    return (
        F.when(~has_text(c), fallback)
        .when(F.size(parts) <= words, head)
        .otherwise(F.concat(head, F.lit("…")))
    )


def slug(c: Column | str, extension: Column | str, fallback: str = "van-ban") -> Column:
    """A file name: lower case, illegal characters out, spaces to single dashes, at most 60."""
    stem = F.lower(trim(c))
    stem = F.regexp_replace(stem, "[\\\\/:*?\"<>|\\x00-\\x1F]", "")
    stem = F.regexp_replace(stem, f"[{SPACE}]+", "-")
    stem = F.regexp_replace(stem, "-{2,}", "-")
    stem = F.regexp_replace(stem, "^[.\\-]+|[.\\-]+\\z", "")
    stem = F.when(stem == "", fallback).otherwise(stem)
    suffix = F.lit(extension) if isinstance(extension, str) else extension
    return F.concat(F.substring(stem, 1, 60), F.lit("."), suffix)


def display_name(file_name: Column | str, title: Column | str, cap: int = 100) -> Column:
    """The extracted title when it is short enough, else the file stem."""
    clean = trim(title)
    stem = F.substring(F.regexp_replace(_col(file_name), "(?s)\\.[^.]*\\z", ""), 1, cap)
    return F.when(has_text(title) & (F.length(clean) <= cap), clean).otherwise(stem)


def page_number_of(page_id: Column | str) -> Column:
    """The number after the last ``-p`` of a page id, null when there is none."""
    tail = F.regexp_extract(_col(page_id), "(?s)^.*-p(.*)\\z", 1)
    return F.when(tail.rlike("^[+-]?[0-9]+\\z"), tail.try_cast("int"))


def page_id_of(document_id: Column | str, page_number: Column | str) -> Column:
    number = _col(page_number)
    return F.when(
        number.isNotNull(), F.concat(_col(document_id).cast("string"), F.lit("-p"), number.cast("string"))
    )


def repeat_key(c: Column | str) -> Column:
    """Two margin lines that differ only in a number get one key."""
    return trim(collapse_spaces(F.regexp_replace(F.lower(_col(c)), "[0-9]+", "#")))


def cache_key(text: Column | str, voice: Column, speed: Column, fmt: Column) -> Column:
    return F.concat_ws(
        "|",
        F.coalesce(voice, F.lit("null")),
        F.format_string("%.2f", speed.cast("double")),
        fmt,
        _col(text),
    )


def cache_hash(text: Column | str, voice: Column, speed: Column, fmt: Column) -> Column:
    return F.sha2(F.encode(cache_key(text, voice, speed, fmt), "UTF-8"), 256)


def text_digest(c: Column | str) -> Column:
    """Length, line count and a 32-bit FNV-1a hash, all over UTF-16 units."""
    text = _col(c)
    points = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("bigint"))

    def step(acc: Column, unit: Column) -> Column:
        return (acc.bitwiseXOR(unit) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))

    def units(acc: Column, point: Column) -> Column:
        high = F.lit(0xD7C0) + F.shiftright(point, 10)
        low = F.lit(0xDC00) + point.bitwiseAND(F.lit(0x3FF))
        return F.when(point > 0xFFFF, step(step(acc, high), low)).otherwise(step(acc, point))

    digest = F.aggregate(points, F.lit(0x811C9DC5).cast("bigint"), units)
    astral = F.length(F.regexp_replace(text, "[\\x{0}-\\x{FFFF}]", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return F.when(text.isNull() | (text == ""), F.lit("len=0")).otherwise(
        F.concat(
            F.lit("len="), (F.length(text) + astral).cast("string"),
            F.lit(" lines="), lines.cast("string"),
            F.lit(" hash="), F.lower(F.hex(digest)),
        )
    )
