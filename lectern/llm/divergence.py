"""How the sources of a language differ in their terms: pairs of sources, and the terms a source over-uses.

Shares of terms are smoothed integers, so that all arithmetic is exact.  The difference of a term grows
with its count in the source and falls with its count in the language.  Every partition therefore
keeps only terms that fewer than ``k`` others dominate (at least as many in the source, at most as many in
the language, earlier in UTF-8): a dominated term can't rank before its dominators, whatever
the totals turn out to be.  What is kept is merged by the same rule and then ranked.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, saved, slices

# Letters are A-Z, a-z and every byte of a character beyond ASCII; all else separates.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
ENTRIES = 300_000  # counted terms after which a task passes its counts on
PIECE = 4 << 20  # bytes of a text cut into terms at once
MERGES = (32, 1)  # parts in which the kept terms of a source are merged, one after the other
UNIT = 1_000_000_000


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text in lists of bounded size; only A-Z is lower-cased."""
    data, at = data.translate(_LOWER), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents; one row with a null term for every group.

    Null text, lang and source read as empty.  Rows that repeat count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        d: dict = defaultdict(Counter)
        new = 0
        for batch in slices(batches):
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, data in zip(keys, byte_texts(batch.column(2))):
                own, seen, before = n[key], set(), len(n[key])
                for part in terms(data):
                    own.update(part)
                    seen.update(part)
                d[key].update(seen)
                new += len(own) - before
                if new >= ENTRIES:
                    yield from out(n, d)
                    n, d, new = defaultdict(Counter), defaultdict(Counter), 0
        yield from out(n, d)

    def out(n: dict, d: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            seen, size = d[lang, source], len(own) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), pa.array([source] * size), pa.array([None, *(t.decode("utf-8", "replace") for t in own)], pa.string()),
                 pa.array([0, *own.values()], pa.int64()), pa.array([0, *(seen[t] for t in own)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    read = docs.select(F.coalesce(lang, F.lit("")), F.coalesce(source, F.lit("")), text)
    return read.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """The smoothed share of a count, in units of 10^-9 and at least 1; exact for counts beyond 64 bits of product."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(19,0))) div cast({total} + 2 * {terms} as decimal(19,0))")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """The rows of each partition that fewer than ``k`` rows of their group in it dominate.

    Rows are ``lang, source, term, n, lang_n``.  Read by falling count, every dominator of a row comes before
    it, and dominators that were left out have ``k`` kept ones that dominate the row too.  A task holds the kept rows of one group.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in batches:
            keep = []
            for at, (lang, source, term, own) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))):
                if (lang, source) != group:
                    group, kept = (lang, source), []
                # Kept rows stand by their count in the language: those up to the row's own are asked.
                dominators = 0
                for _, earlier in islice(kept, bisect_right(kept, own, key=lambda r: r[0])):
                    dominators += earlier < term
                    if dominators == k:
                        break
                else:
                    insort(kept, (own, term))
                    keep.append(at)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.sortWithinPartitions("lang", "source", F.desc("n"), "lang_n", "term").mapInArrow(scan, rows.schema)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, k: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far sources of a language lie apart, and by which terms.

    The kept terms of a language stand in at least ``least`` of its documents.  With V of them, and N
    occurrences of them in a group, the share of one that occurs c times is ``1 + floor(10^9 (c + 2) / (N + 2 V))``
    and the difference of two shares is ``floor((p - q)^2 / (p + q))``.

    Part ``pair`` has a row for each other source of the language: the sum of the differences over all
    kept terms (0 if there are none), all ranks.  Part ``term`` has the ``k`` kept terms that occur in the source and have a
    larger share there than in the language, by their difference.  Ranks start at 1 and ties go to the earlier item in UTF-8.

    Null text, lang and source read as empty, groups without terms take part, rows that repeat count
    again, other columns are not read, and an empty table gives no rows.
    """
    counts = saved(term_counts(docs, text, lang, source), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    cells = saved(counts.where("term is not null").drop("docs").join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "cells")
    by_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
    by_term = cells.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = (
        counts.where("term is null").select("lang", "source").join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "own_terms", "terms", "lang_total")])
    )
    groups = saved(groups.withColumn("none", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "groups")
    return _ranked(_pairs(cells, groups)).unionByName(_ranked(_terms(cells, groups, k)).where(F.col("rank") <= k))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Differences of all pairs of sources of a language, summed over its kept terms.

    A term that one source lacks adds what depends on the other's count alone, so counts are first
    gathered to how many terms have each.  Only terms that both have are looked at one by one.
    """
    shared = groups.select("lang", "source", "total", "terms", "none")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.col("own_terms").alias("item_terms"))
    pairs = groups.join(other, "lang").where("source <> item")
    common = cells.groupBy("lang", "source", "n").count().join(shared, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
    alone = (
        common.join(other, "lang").where("source <> item").groupBy("lang", "source", "item")
        .agg(F.sum(F.col("count") * difference("p", "item_none")).alias("alone"))
    )
    shares = cells.join(shared, ["lang", "source"]).select("lang", "term", "source", share("n", "total", "terms").alias("p"), "none")
    second = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("item_none"))
    both = (
        shares.join(second, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item")
        .agg(F.count("*").alias("both"), F.sum(difference("p", "q") - difference("p", "item_none") - difference("none", "q")).alias("more"))
    )
    turned = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("item_alone"))
    either = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both", "more"))
    key, zero = ["lang", "source", "item"], F.lit(0)
    neither = F.col("terms") - F.col("own_terms") - F.col("item_terms") + F.coalesce("both", zero)
    value = F.coalesce("alone", zero) + F.coalesce("item_alone", zero) + F.coalesce("more", zero) + neither * difference("none", "item_none")
    return (
        pairs.join(alone, key, "left").join(turned, key, "left").join(either, key, "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("terms") > 0, value).otherwise(zero).cast("long").alias("value"))
    )


def _terms(cells: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """The kept terms of every source that can be among its first ``k``, with their differences from the language."""
    band = skyband(cells, k)
    for parts in MERGES:
        by = [F.col("lang"), F.col("source"), *([F.pmod(F.xxhash64("term"), F.lit(parts))] if parts > 1 else [])]
        band = skyband(band.repartition(*by), k)
    judged = band.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    return judged.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))


ORACLE = r"""
with d as (
    select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), occ as (
    select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
    select lang, term from occ group by lang, term having count(distinct id) >= 10
), size as (select lang, count(*) as v from kept group by lang),
cells as (select lang, source, term, count(*) as n from occ semi join kept using (lang, term) group by all),
g as (
    select lang, source, coalesce(v, 0) as v, coalesce((select sum(n) from cells c where c.lang = x.lang and c.source = x.source), 0)::hugeint as total
    from (select distinct lang, source from d) x left join size using (lang)
), dense as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) as p
    from g join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
), whole as (
    select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(t) + 2 * any_value(v)) as q
    from cells join (select lang, any_value(v) as v, sum(total) as t from g group by lang) using (lang) group by lang, term
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item,
        coalesce((select sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) from dense x join dense y on x.lang = y.lang and x.term = y.term
                  where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
), single as (
    select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value
    from dense join whole using (lang, term) where n > 0 and p > q
), ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from (select * from pairs union all select * from single)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
