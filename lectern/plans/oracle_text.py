"""The text rules restated in DuckDB SQL, whose regular expressions have no lookaround.

Neighbours are captured and restored instead, so these are independent of the Spark side.
"""

from __future__ import annotations

from ..functions.numbers import DIGITS, TWO_DIGITS
from ..functions.text import ABBREVIATIONS, INITIALS

W = "\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
T = W + "\\x{85}"
H = W.replace("\\t-\\r", "\\t\\x{0B}-\\r")
MASK, FENCE, CUT = "\ue000", "\ufdd0", "\ufdd1"


def rx(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def trim(x: str) -> str:
    return rx(x, f"^[{T}]+|[{T}]+$", "")


def has_text(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{T}]'), false)"


def paragraphs(x: str) -> str:
    cut = f"string_split_regex({x}, '\\n[{W}]*\\n+')"
    return f"list_filter(list_transform({cut}, lambda p: {trim('p')}), lambda p: p <> '')"


def _rewrite_fenced(fenced: str, f) -> str:
    pieces = f"string_split({fenced}, '{FENCE}')"
    return f"array_to_string(list_transform({pieces}, lambda t, i: case when i % 2 = 0 then {f('t')} else t end), '')"


def rewrite(x: str, pattern: str, f) -> str:
    return _rewrite_fenced(rx(x, f"({pattern})", f"{FENCE}\\1{FENCE}"), f)


def whitespace(x: str) -> str:
    x = f"replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ')"
    x = f"regexp_replace({x}, '\\n[{W}]*\\n+', chr(10) || chr(10), 'g')"
    x = rx(rx(x, f"(^|\\n)[{H}]+", "\\1"), f"[{H}]+(\\n|$)", "\\1")
    return trim(rx(x, " {2,}", " "))


def units(x: str) -> str:
    x = rx(x, f"([0-9])[{W}]*%", "\\1 phần trăm")
    return rx(rx(x, "₫", " đồng"), f"(?i)([0-9])[{W}]*VND", "\\1 đồng")


def ungroup(x: str) -> str:
    """Twice, because neighbouring groups share the dot between them."""
    grouped = "(^|[^0-9])([0-9]{1,3}(?:\\.[0-9]{3})+)([^0-9]|$)"
    for _ in range(2):
        x = _rewrite_fenced(rx(x, grouped, f"\\1{FENCE}\\2{FENCE}\\3"), lambda t: f"replace({t}, '.', '')")
    return x


def _word(words, i: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][cast({i} as int) + 1]"


def _below(n: str, pad: str) -> str:
    h, r = f"({n} // 100)", f"({n} % 100)"
    return (
        f"concat_ws(' ', case when {h} > 0 then {_word(DIGITS, h)} || ' trăm' when {pad} and {r} >= 10 then 'không trăm'"
        f" when {pad} and {r} > 0 then 'lẻ' end, case when {h} > 0 and {r} between 1 and 9 then 'lẻ' end,"
        f" case when {r} > 0 then {_word(TWO_DIGITS, r)} end)"
    )


def integer(n: str) -> str:
    groups = [
        f"case when {n} // {s} % 1000 > 0 then {_below(f'({n} // {s} % 1000)', f'({n} >= {s * 1000})')} || ' {u}' end"
        for s, u in ((10**9, "tỷ"), (10**6, "triệu"), (10**3, "nghìn"))
    ]
    tail = f"case when {n} % 1000 > 0 then {_below(f'({n} % 1000)', f'({n} >= 1000)')} end"
    return f"case when {n} = 0 then 'không' else concat_ws(' ', {', '.join(groups)}, {tail}) end"


def spell(d: str) -> str:
    return f"array_to_string(list_transform(string_split({d}, ''), lambda c: {_word(DIGITS, 'c')}), ' ')"


def number(t: str) -> str:
    digits = f"replace(replace({t}, '.', ''), ',', '')"
    head = f"try_cast(regexp_extract({t}, '^[0-9]+') as bigint)"
    tail = f"regexp_extract({t}, '[.,]([0-9]+)$', 1)"
    return (
        f"case when length({digits}) > 15 or {head} >= 1000000000000 then {spell(digits)}"
        f" when not regexp_matches({t}, '[.,]') then {integer(head)}"
        f" else {integer(head)} || ' phẩy ' || {spell(tail)} end"
    )


def numbers(x: str) -> str:
    return rewrite(x, "[0-9]+(?:[.,][0-9]+)?", number)


def speech(x: str) -> str:
    return trim(numbers(ungroup(units(whitespace(x)))))


def sentences(p: str) -> str:
    """The list of sentences of one trimmed paragraph."""
    url = f"(?i)(?:https?://[^{W}]+|www\\.[^{W}]+|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+)"
    inside = lambda t: f"replace({t}[:-2], '.', '{MASK}') || {t}[-1:]"
    x = rewrite(p, url, inside)
    for _ in range(2):
        x = rx(x, "([0-9])\\.([0-9])", f"\\1{MASK}\\2")
    for _ in range(2):
        x = rx(x, f"(?i)(^|[^\\p{{L}}\\p{{N}}])({'|'.join(ABBREVIATIONS)})\\.", f"\\1\\2{MASK}")
    x = rx(x, f"([{INITIALS}])\\.([{W}])", f"\\1{MASK}\\2")
    x = rx(x, f"([.!?…]+[\"”’''»)\\]]*)([{W}]|$)", f"\\1{CUT}\\2")
    clean = trim(f"replace(replace(s, '{MASK}', '.'), chr(10), ' ')")
    return f"list_filter(list_transform(string_split({x}, '{CUT}'), lambda s: {clean}), lambda s: s <> '')"


def sentence_rows(text: str = "text", key: str = "doc_id", table: str = "{documents}", extra: str = "") -> str:
    """``key, idx, paragraph, position, text`` of every document."""
    return f"""
select {key}{extra}, row_number() over (partition by {key} order by paragraph, position) - 1 as idx, paragraph, position, text
from (select {key}{extra}, paragraph, unnest(range(len(ss))) as position, unnest(ss) as text
  from (select {key}{extra}, paragraph, {sentences('p')} as ss
    from (select {key}{extra}, unnest(range(len(ps))) as paragraph, unnest(ps) as p
      from (select {key}{extra}, {paragraphs(text)} as ps from {table}))))"""
