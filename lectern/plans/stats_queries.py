"""Grouped statistics, score filters and tokens over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import tokens as K
from .base import SHARED, _both, query

_both("lib_levels", "select l_suppkey as g, cast(floor(l_extendedprice) as int) % 256 as v, l_quantity as x, l_extendedprice / 1000 as y from {lineitem}")


@query(
    "d20_otsu",
    """with h as (select g, v, count(*) as n from {lib_levels} group by 1, 2),
       c as (select g, v, n, sum(n) over b as w0, sum(n * v) over b as s0, sum(n) over (partition by g) as total, sum(n * v) over (partition by g) as s from h window b as (partition by g order by v)),
       d as (select *, case when total > w0 then w0::double * (total - w0) * pow(s0::double / w0 - (s - s0)::double / (total - w0), 2) end as between_,
         n * pow(v - s::double / total, 2) as dev from c)
       select g, case when sum(dev) > 0 then coalesce(arg_max(v, between_), 127) else 127 end as threshold,
         round(case when sum(dev) > 0 then least(greatest(coalesce(max(between_) / (max(total)::double * max(total)) / (sum(dev) / max(total)), 0), 0), 1) else 0 end, 6) as separability from d group by g""",
)
def d20(lib):
    return S.otsu(lib["lib_levels"], ["g"], "v").select("g", "threshold", F.round("separability", 6).alias("separability"))


@query(
    "d20_histogram_of_prices",
    """select l_returnflag, least(greatest(cast(floor((l_extendedprice - 1000) / ((50000.0 - 1000) / 256)) as int), 0), 255) as bin, count(*) as n
       from {lineitem} group by 1, 2""",
)
def d20_prices(lib):
    return S.histogram(lib["lineitem"], ["l_returnflag"], "l_extendedprice", 1000.0, 50000.0)


_MID = "list_sort(list({0}))[count({0}) // 2 + 1]"


@query(
    "d21_mad_filter",
    f"""with m as (select l_suppkey, {_MID.format('l_quantity')} as c from {{lineitem}} group by 1),
        d as (select l.l_suppkey, {_MID.format('abs(l.l_quantity - m.c)')} as mad from {{lineitem}} l join m using (l_suppkey) group by 1)
        select l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity from {{lineitem}} l join m using (l_suppkey) join d using (l_suppkey)
        where l.l_quantity <= greatest(m.c + 0.8::double * greatest(d.mad * 1.4826::double, 0.001), 2)""",
)
def d21(lib):
    kept = S.mad_filter(lib["lineitem"], ["l_suppkey"], "l_quantity", 0.8, 2.0)
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


_LINE = """(select g, count(*) as n, avg(x) as mx, avg(y) as my, 0.5::double * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) as t from {lib_levels} group by 1
  having count(*) >= 2 and var_pop(x) + var_pop(y) > 0)"""
_AB = f"(select *, case when -sin(t) < 0 or (sin(t) = 0 and cos(t) < 0) then -1 else 1 end as sgn from {_LINE})"


@query(
    "d22_fit_line",
    f"""select g, n, round(a, 6) as a, round(b, 6) as b, round(-(a * mx + b * my), 4) as c from (select *, -sin(t) * sgn as a, cos(t) * sgn as b from {_AB})""",
)
def d22(lib):
    line = S.fit_line(lib["lib_levels"], ["g"], "x", "y")
    return line.select("g", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"))


@query(
    "d22_line_distance",
    f"""select l.g, count(*) as n, round(avg(abs(a * x + b * y - (a * mx + b * my))), 5) as mean_distance from {{lib_levels}} l
        join (select *, -sin(t) * sgn as a, cos(t) * sgn as b from {_AB}) f using (g) group by 1""",
)
def d22_distance(lib):
    lines = S.fit_line(lib["lib_levels"], ["g"], "x", "y")
    far = S.line_distance(lib["lib_levels"], lines, ["g"], "x", "y")
    return far.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 5).alias("mean_distance"))


@query(
    "d23_trimmed_spread",
    """with h as (select event_type, least(greatest(cast(floor(value + 0.5) as int), 0), 255) as v, count(*) as n from {events} group by 1, 2),
       c as (select event_type, v, sum(n) over (partition by event_type order by v) as up, sum(n) over (partition by event_type order by v desc) as down, sum(n) over (partition by event_type) as total from h)
       select event_type, (max(v) filter (where down >= total * 0.02::double) - min(v) filter (where up >= total * 0.02::double)) / 255 as spread from c group by 1""",
)
def d23(lib):
    return S.trimmed_spread(lib["events"], ["event_type"], "value")


# -- score filters -------------------------------------------------------------------


SHARED["lib_scores"] = (
    "select vec_id as g, label as channel, cast(pos as bigint) as item, cast(round(cast(e as double) * 20, 3) as double) as score from (select vec_id, label, posexplode(embedding) as (pos, e) from {embeddings})",
    "select vec_id as g, label as channel, cast(pos as bigint) as item, cast(round(cast(e as double) * 20, 3) as double) as score from (select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding) as e from {embeddings})",
)
_both("lib_history", "select cast(user_id % 10 as int) as channel, event_id as seq, (event_id * 31) % 97 as item from {events}")


@query(
    "e12_repetition_penalty",
    """with h as (select distinct channel, item from (select *, row_number() over (partition by channel order by seq desc) as r from {lib_history}) where r <= 64)
       select s.g, s.item, h.item is not null as repeated, round(case when h.item is null then score when score < 0 then score * 1.3::double else score / 1.3::double end, 6) as score
       from {lib_scores} s left join h on h.channel = s.channel and h.item = s.item""",
)
def e12(lib):
    damped = S.repetition_penalty(lib["lib_scores"], lib["lib_history"], 1.3)
    return damped.select("g", "item", "repeated", F.round("score", 6).alias("score"))


def _nucleus(k: int, p: float) -> str:
    return f"""(with r as (select g, item, score / 0.8::double as z, row_number() over (partition by g order by score desc, item) - 1 as rank from {{lib_scores}}),
      t as (select * from r where {k} = 0 or rank < {k}), m as (select *, exp(z - max(z) over (partition by g)) as e from t),
      c as (select *, e / sum(e) over (partition by g) as q, coalesce(sum(e) over (partition by g order by rank rows between unbounded preceding and 1 preceding), 0) / sum(e) over (partition by g) as before from m)
      select g, item, rank, e / sum(e) over (partition by g) as probability from c where before < {p}::double or rank = 0)"""


@query("e13_nucleus", f"select g, item, rank, round(probability, 6) as probability from {_nucleus(20, 0.9)}")
def e13(lib):
    return S.nucleus(lib["lib_scores"], ["g"], 0.8, 20, 0.9).select("g", "item", "rank", F.round("probability", 6).alias("probability"))


@query("e13_nucleus_of_all", f"select g, item, rank, round(probability, 6) as probability from {_nucleus(0, 0.7)}")
def e13_all(lib):
    return S.nucleus(lib["lib_scores"], ["g"], 0.8, 0, 0.7).select("g", "item", "rank", F.round("probability", 6).alias("probability"))


@query("e13_greedy", "select g, arg_max(item, score * 1000000 - item) as item from {lib_scores} group by 1")
def e13_greedy(lib):
    return S.nucleus(lib["lib_scores"], ["g"], 0.0).select("g", "item")


@query(
    "e14_draw",
    f"""with c as (select g, item, rank, sum(probability) over (partition by g order by rank) as mass, ('0x' || substr(md5(g || '|11'), 1, 12))::bigint::double / 281474976710656 as u from {_nucleus(20, 0.9)})
        select g, coalesce(arg_min(item, rank) filter (where mass >= u), arg_max(item, rank)) as item from c group by g""",
)
def e14(lib):
    return S.draw(S.nucleus(lib["lib_scores"], ["g"], 0.8, 20, 0.9), ["g"], 11)


# -- tokens --------------------------------------------------------------------------


def vocabulary() -> K.Vocabulary:
    """Byte symbols and a few merges by rule; the pairs share no letter, so merges never compete."""
    pairs = [("t", "h"), ("i", "n"), ("e", "r"), ("o", "u"), ("th", "er")]
    ids = {symbol: i for i, symbol in enumerate(K.byte_symbols())}
    for left, right in pairs:
        ids[left + right] = len(ids)
    return K.Vocabulary(ids, pairs, {"<|pause|>": len(ids)})


_PIECES = "'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[^\\r\\n\\p{L}\\p{N}]?\\p{L}+|\\p{N}| ?[^\\s\\p{L}\\p{N}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+".replace("'", "''")


# Merged pairs become private-use letters from U+E100 on, in the order of their ids; all else is one id a byte.
_MERGED_TEXT = "p"
for _letters, _code in (("ther", 0xE104), ("th", 0xE100), ("in", 0xE101), ("er", 0xE102), ("ou", 0xE103)):
    _MERGED_TEXT = f"replace({_MERGED_TEXT}, '{_letters}', chr({_code}))"


@query(
    "h25_bpe_tokenize",
    f"""with p as (select doc_id, unnest(regexp_extract_all(text, '{_PIECES}')) as p, unnest(range(len(regexp_extract_all(text, '{_PIECES}')))) as place from {{documents}}),
        c as (select doc_id, place, unnest(string_split({_MERGED_TEXT}, '')) as c, unnest(range(length({_MERGED_TEXT}))) as k from p),
        i as (select doc_id, place, k, case when unicode(c) between 57600 and 57604 then [unicode(c) - 57344]
            else list_transform(range(strlen(c)), lambda j: cast('0x' || substr(hex(encode(c)), 2 * j + 1, 2) as int)) end as ids from c)
        select d.doc_id, cast(coalesce(n, 0) as int) as n_tokens, md5(coalesce(ids, '')) as ids_md5 from {{documents}} d
        left join (select doc_id, sum(len(ids)) as n, string_agg(array_to_string(ids, ','), ',' order by place, k) as ids from i group by 1) x using (doc_id)""",
)
def h25(lib):
    tokens = K.bpe_tokenize(lib.wide("documents").select("doc_id", "text"), vocabulary())
    return tokens.select("doc_id", "n_tokens", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("h26_bpe_round_trip", "select doc_id, text as decoded from {documents}")
def h26(lib):
    words = vocabulary()
    encoded = K.bpe_tokenize(
        lib.wide("documents").select("doc_id", F.concat(F.lit("<|pause|>"), "text", F.lit("<|pause|>")).alias("text")), words
    )
    return K.bpe_decode(encoded.select("doc_id", "ids"), words).select("doc_id", "decoded")
