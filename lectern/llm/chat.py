"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn belongs to the
half-budget in which it starts, so a span needs no look at the turns before it.  Every window
holds the system turn, as much of the turns before it as the history allows, and its own
turns; only the assistant's texts among its own turns are targets, so each is one exactly once.

A window is ``<s>`` and for each turn ``[INST]role[/INST]text</s>``.  These control strings
inside roles and texts get one more backslash after their first character, and lose it when
they are read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running

BUDGET = 2048
HISTORY = 512
SLICE_TURNS = 4096
START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_FORMS = ((r"<(\\*)(/?s>)", "<"), (r"\[(\\*)(/?INST\])", "["))
SPANS = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    """Control strings with one more backslash after their first character."""
    for pattern, first in _FORMS:
        text = F.regexp_replace(text, pattern, first + r"\\$1$2")
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for pattern, first in _FORMS:
        text = F.regexp_replace(text, pattern.replace(r"(\\*)", r"\\(\\*)"), first + "$1$2")
    return text


def turn_tokens(text: Column) -> Column:
    """An estimate of a turn's tokens: one for four characters begun, and four for its marks."""
    return F.floor((F.length(text) + 3) / 4).cast("long") + 4


def windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None,
) -> DataFrame:
    """``conv, first_turn, n_repeated, formatted, loss, n_tokens``: one row per window.

    ``first_turn`` is the position of the window's first own turn and orders the windows;
    ``n_repeated`` turns at the head are repeated and masked; ``loss`` lists the spans
    ``(start, length)`` of ``formatted``, in characters from 0, that are targets.  History and own turns
    together stay within ``budget`` tokens (the retained system turn comes on top) unless a
    single turn is longer, which then has a window of its own.

    Turns go by ``turn``, then role and text; a null turn number comes first.  Null roles and texts are empty,
    a null conversation id is a conversation of its own, repeated rows are turns of their own,
    and an empty table has no windows.  Other columns are not looked at.
    """
    half = max(1, (budget - history) // 2)
    first = F.lit(-(1 << 62)).cast("long")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null")).alias("_key"), F.col(conv).alias("_conv"),
        F.coalesce(F.col(turn).cast("long"), first).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        (F.lit(None) if tokens is None else tokens).cast("long").alias("_given"),
    ).withColumn("_tokens", F.when(F.col("_given").isNotNull(), F.greatest("_given", F.lit(1))).otherwise(turn_tokens(F.col("_text")))).drop("_given")
    order, cut = ["_turn", "_role", "_text"], [F.floor(F.col("_turn") / SLICE_TURNS)]
    placed = running(rows, ["_key"], order, cut, {"_pos": ("sum", F.lit(1).cast("long")), "_sum": ("sum", F.col("_tokens"))})
    head = (F.col("_pos") == 0) & (F.col("_role") == "system")
    placed = placed.withColumn("_system", head).withColumn("_bucket", F.floor(F.col("_sum") / half))
    placed = placed.withColumn("_alone", (F.col("_tokens") > half) & ~F.col("_system"))
    own = ["_key", "_bucket", "_alone"]
    item = F.struct(
        "_pos", F.col("_fresh").alias("fresh"), F.col("_role").alias("role"),
        F.concat(F.lit(OPEN), escape(F.col("_role")), F.lit(CLOSE)).alias("mark"), escape(F.col("_text")).alias("body"),
        F.col("_tokens").alias("tokens"),
    )
    fresh = placed.withColumn("_fresh", F.lit(True)).select("_conv", *own, item.alias("item"))
    spans = placed.groupBy(*own).agg(F.first("_conv").alias("_conv"), F.min("_pos").alias("_from"), F.min("_sum").alias("_start"))
    reach = placed.where(~head).withColumn(
        "_bucket", F.explode(F.sequence("_bucket", F.floor((F.col("_sum") + history) / half)))
    ).withColumn("_fresh", F.lit(False)).select("_key", "_bucket", "_pos", "_sum", item.alias("item"))
    before = reach.join(spans, ["_key", "_bucket"]).where(
        (F.col("_pos") < F.col("_from")) & (F.col("_start") - F.col("_sum") <= history)
    ).select("_conv", *own, "item")
    system = placed.where(head).withColumn("_fresh", F.lit(False)).select("_key", item.alias("item"))
    retained = spans.where("_from > 0").join(system, "_key").select("_conv", *own, "item")

    made = (
        fresh.unionByName(before).unionByName(retained)
        .groupBy(*own).agg(F.first("_conv").alias("_conv"), F.array_sort(F.collect_list("item")).alias("items"))
    )
    size = lambda i: F.length(i["mark"]) + F.length(i["body"]) + len(END)
    walk = F.aggregate(
        "items",
        F.struct(F.lit(len(START)).cast("long").alias("at"), F.array().cast(SPANS).alias("loss")),
        lambda s, i: F.struct(
            (s["at"] + size(i)).cast("long").alias("at"),
            F.when(
                i["fresh"] & (i["role"] == "assistant"),
                F.concat(s["loss"], F.array(F.struct(
                    (s["at"] + F.length(i["mark"])).cast("long").alias("start"), F.length(i["body"]).cast("long").alias("length")))),
            ).otherwise(s["loss"]).alias("loss"),
        ),
        lambda s: s["loss"],
    )
    is_fresh = F.filter("items", lambda i: i["fresh"])
    return made.select(
        F.col("_conv").alias(conv),
        F.array_min(F.transform(is_fresh, lambda i: i["_pos"])).alias("first_turn"),
        (F.size("items") - F.size(is_fresh)).cast("long").alias("n_repeated"),
        F.concat(F.lit(START), F.array_join(F.transform("items", lambda i: F.concat(i["mark"], i["body"], F.lit(END))), "")).alias("formatted"),
        walk.alias("loss"),
        F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["tokens"]).alias("n_tokens"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Add ``turns array<struct<role, text>>``, each window's own turns, and ``targets array<string>``, read from ``formatted``."""
    body = F.substring("formatted", len(START) + 1, 1 << 30)
    pieces = F.split(body, END)
    own = F.slice(pieces, F.col("n_repeated").cast("int") + 1, F.size(pieces) - 1 - F.col("n_repeated").cast("int"))
    turn = lambda p: F.split(p, r"\[/INST\]", 2)
    return made.withColumn(
        "turns",
        F.transform(own, lambda p: F.struct(
            unescape(F.substring(turn(p)[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescape(turn(p)[1]).alias("text"))),
    ).withColumn(
        "targets",
        F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))),
    )


def digests(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its windows: counts and digests of turns and targets."""
    parts = read_back(made).select(
        conv, "first_turn", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("target"),
    )
    whole = parts.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct("first_turn", "said", "target"))).alias("w"),
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
    )
    joined = lambda f: F.array_join(F.transform("w", lambda w: w[f]), "")
    return whole.select(
        conv, "n_turns", F.sha2(joined("said").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("target")).cast("long").alias("loss_chars"),
        F.sha2(joined("target").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


# Sums, spans and repeated turns by the same rules, for DuckDB.
ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, (length(text) + 3) // 4 + 4 as tokens,
    17 + length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
       + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) as chars
  from c),
p as (
  select *, row_number() over w - 1 as pos, sum(tokens) over w - tokens as before
  from e window w as (partition by conv_id order by turn, role, text rows unbounded preceding)),
b as (
  select *, pos = 0 and role = 'system' as head, before // 768 as bucket,
    tokens > 768 and not (pos = 0 and role = 'system') as alone from p),
s as (select conv_id, bucket, alone, min(pos) as first_pos, min(before) as start from b group by all),
again as (
  select b.conv_id, sum(b.chars) as chars
  from s join b on b.conv_id = s.conv_id and b.pos < s.first_pos and (b.head or s.start - b.before <= 512) group by 1),
n as (select conv_id, count(*) as n from s group by 1)
select b.conv_id as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(b.chars) + 3 * any_value(n.n) + coalesce(any_value(again.chars), 0))::bigint as formatted_chars
from b join n using (conv_id) left join again using (conv_id) group by b.conv_id
"""
