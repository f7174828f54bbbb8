"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

The mix has a size of its own, shared by weight.  A source is repeated a bounded number of times at
most; sources above that are clamped and what they leave is shared among the others by weight, until
none is above.  Inside a source every document is repeated the whole number of times, and documents in
the order of a seeded draw once more, until the target is met; the last of these gives its first words
only, so that a source meets its target to the word.

The draw is cut into cells, and sizes are summed by cell first: only the documents of the one
cell in which the target is met are put in order, in whatever source all the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WORD = r"[^\x20\x09-\x0D]+"
CELL_DIGITS = 3  # hexadecimal digits of the draw that name a cell of a level
LEVELS = 2
RUNNING = "sum({0}) over (partition by source order by {1} rows between unbounded preceding and 1 preceding)"


def words(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, *columns: str) -> Column:
    """A number of 32 hexadecimal digits that the seed and the values decide; null is told apart from empty."""
    return F.md5(F.concat(F.lit(f"{seed}"), *[F.coalesce(F.concat(F.lit("|"), F.col(c).cast("string")), F.lit("-")) for c in columns]))


def cycle_weights(docs: DataFrame, weights: list[int], source: str = "source") -> DataFrame:
    """``source, weight``: the weights in turn, by the code points of the sources, null last."""
    order = Window.orderBy(F.col(source).asc_nulls_last())  # one row for each source, not for each document
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return docs.select(F.col(source).alias("source")).distinct().select(
        "source", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, percent: int, epochs: int) -> DataFrame:
    """Add ``weight``'s share of ``percent`` of all sizes as ``target double`` and exactly as ``share / whole``.

    ``sizes`` has ``source, source_size, weight`` with positive whole weights, one row a source, and is read
    once a round.  Clamped sources have ``epochs`` times their size.  A round is one aggregate of three numbers: the level at
    which the others would stand without those above it only rises, so that the clamped ones stay so.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # Sizes count in hundredths here, so that all comparisons are of whole numbers.
    clamped, level = F.lit(False), None
    while True:
        state = sizes.agg(
            F.sum(F.when(~clamped, big("weight"))).alias("weight"),
            (F.coalesce(F.sum(big("source_size")), F.lit(0)) * percent - 100 * epochs * F.coalesce(F.sum(F.when(clamped, big("source_size"))), F.lit(0))).alias("left"),
            F.count(F.when(clamped, 1)).alias("clamped"),
        ).first()
        if state["weight"] is None or (level is not None and state["clamped"] == level):
            break
        level, whole, left = state["clamped"], int(state["weight"]), int(state["left"])
        share = (F.lit(left).cast("decimal(25,0)") * F.col("weight").cast("decimal(9,0)"))
        clamped = share > F.col("source_size").cast("decimal(19,0)") * F.lit(100 * epochs * whole).cast("decimal(18,0)")
    if level is None:  # no source at all, or none that may have more
        share, whole, clamped = F.lit(0).cast("decimal(35,0)"), 1, F.lit(True)
    cap = (big("source_size") * epochs)
    return sizes.select(
        "*",
        F.when(clamped, cap.cast("double")).otherwise(share.cast("double") / F.lit(100 * whole).cast("double")).alias("target"),
        F.when(clamped, cap.cast("long")).otherwise(F.expr("0")).alias("_cap"),
        F.floor(share / F.lit(100 * whole).cast("decimal(18,0)")).cast("long").alias("_share"),
        clamped.alias("_clamped"),
    ).select("source", "source_size", "weight", "target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("_share")).alias("whole_target"))


def _cut(rows: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """``source, need, cell``: the cell of a level in which the sizes reach what a source still needs, and what is needed from there.

    ``plan`` has what is needed and the cells of the levels above.
    """
    at = F.substring("draw", 1, CELL_DIGITS * level)
    inside = rows.select("source", "size", at.alias("cell"), F.substring("draw", 1, CELL_DIGITS * (level - 1)).alias("above"))
    if level > 1:
        asked = plan.select(F.col("source").alias("_source"), F.col("cell").alias("_above"))
        inside = inside.join(asked, inside["source"].eqNullSafe(asked["_source"]) & (F.col("above") == F.col("_above")), "left_semi")
    cells = inside.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = cells.withColumn("before", F.expr(f"coalesce({RUNNING.format('cell_size', 'cell')}, 0)"))
    need = plan.select(F.col("source").alias("_source"), "need")
    return (
        before.join(need, before["source"].eqNullSafe(need["_source"]))
        .where("before < need").groupBy("source").agg(F.max_by(F.struct("cell", (F.col("need") - F.col("before")).alias("need")), "cell").alias("last"))
        .select("source", "last.need", "last.cell")
    )


def allot(rows: DataFrame, weights: DataFrame, percent: int = 150, epochs: int = 2) -> DataFrame:
    """Add ``source_size, target, taken``: the words that the mix takes of each row, repeats counted.

    ``rows`` has ``source``, ``size`` (words, not negative) and ``draw`` (hexadecimal, for instance of ``draw``), is
    read several times and therefore best a written table; ``weights`` has one row for each source,
    null among them, with a positive whole ``weight``.  The mix is ``percent`` of all sizes; no source, and no row, is taken more than
    ``epochs`` times.  The words taken of a source are its target rounded down.  Rows of one draw are
    ordered by their other columns, so that reruns agree.  Null is a source of its own.  Rows of an unlisted source go.
    Columns of the added names are replaced; an empty table gives no rows.
    """
    own = [c for c in rows.columns if c not in ("source_size", "target", "taken")]
    rows = rows.select(*own)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = weights.select(F.col("source").alias("_source"), "weight")
    sizes = saved(sizes.join(listed, sizes["source"].eqNullSafe(listed["_source"])).drop("_source"), "sizes")
    plan = targets(sizes, percent, epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.expr("whole_target div source_size")).otherwise(F.lit(0).cast("long"))
    ).withColumn("need", F.col("whole_target") - F.col("whole") * F.col("source_size"))
    plan = saved(plan, "plan")
    cut = plan.where("need > 0").select("source", "need")
    for level in range(1, LEVELS + 1):
        cut = saved(_cut(rows, cut, level), "cut")
    cut = cut.select(F.col("source").alias("_cut_source"), F.col("need").alias("_rest"), F.col("cell").alias("_cell"))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"))
    plan = saved(plan.join(cut, plan["_source"].eqNullSafe(cut["_cut_source"]), "left").drop("_cut_source"), "plan")

    at = F.substring("draw", 1, CELL_DIGITS * LEVELS)
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).withColumn("_at", at)
    once = F.when(F.col("_at") < F.col("_cell"), F.col("size")).otherwise(F.lit(0))
    # The cell where the target is met: its rows in order, the last one in part.
    order = ", ".join(f"`{c}`" for c in ("draw", *[c for c in own if c != "draw"]))
    before = F.expr(f"coalesce({RUNNING.format('size', order)}, 0)")
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    inside = F.coalesce(F.col("_at") == F.col("_cell"), F.lit(False))
    whole = F.col("_whole") * F.col("size")
    out = [*own, "source_size", "target"]
    return placed.where(~inside).select(*out, (whole + once).cast("long").alias("taken")).unionByName(
        placed.where(inside).select(*out, (whole + some).cast("long").alias("taken")))


def mix(docs: DataFrame, weights: DataFrame, percent: int = 150, epochs: int = 2, seed: int = 13, key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``; columns of these names are replaced.

    The seed and the values of ``key`` decide which documents are repeated once more.  ``text`` and ``source`` are the columns read.
    """
    own = [c for c in docs.columns if c not in ("size", "draw", "source_size", "target", "taken")]
    rows = saved(docs.select(*own, words("text").alias("size"), draw(seed, *key).alias("draw")), "rows")
    return allot(rows, weights, percent, epochs).drop("draw")


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a mix: a row for each repetition with its number ``copy``, the last one cut to the words that are taken."""
    size = F.greatest(F.col("size"), F.lit(1))
    copies = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int"))))
    rest = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    first = F.array_join(F.slice(F.split(F.ltrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), F.lit(1), F.greatest(rest, F.lit(1)).cast("int")), " ")
    return copies.withColumn(text, F.when(rest < F.col("size"), first).otherwise(F.col(text)))


ORACLE = r"""
with recursive d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        md5('13' || coalesce('|' || doc_id::varchar, '-') || coalesce('|' || text, '-')) as draw
    from documents
), s as (
    select source, sum(size)::hugeint as source_size,
        ([5, 2, 1])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight
    from d group by source
), levels as (
    select 0 as round, (select 150 * sum(source_size) from s) as rest, (select sum(weight) from s) as w, 0::bigint as clamped
    union all
    select round + 1,
        (select 150 * sum(source_size) from s) - (select coalesce(sum(200 * source_size), 0) from s where l.rest * weight > 200 * source_size * l.w),
        (select sum(weight) from s where not l.rest * weight > 200 * source_size * l.w),
        (select count(*) from s where l.rest * weight > 200 * source_size * l.w)
    from levels l where round < 40
), final as (select rest, w from levels order by round desc limit 1),
t as (
    select source, source_size, rest * weight > 200 * source_size * w as full_up,
        case when rest * weight > 200 * source_size * w then (2 * source_size)::double else (rest * weight)::double / (100 * w)::double end as target,
        case when rest * weight > 200 * source_size * w then 2 * source_size else (rest * weight) // (100 * w) end as whole_target
    from s, final
), p as (
    select *, case when source_size > 0 then whole_target // source_size else 0 end as whole from t
), o as (
    select d.doc_id, d.size, d.draw, p.*, coalesce(sum(d.size) over (
        partition by p.source order by d.draw, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
    from d join p on d.source is not distinct from p.source
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
    (whole * size + greatest(0, least(size, whole_target - whole * source_size - before)))::bigint as taken
from o
"""
