"""Ordered operators that survive a hot group.

A window over ``partition by document`` puts a whole document in one task.  Here every
group is cut into *slices* - columns that grow with the order, such as ``idx div 65536`` -
and a running value is the carry of the earlier slices plus the running value inside one
slice.  The carries come from a pre-aggregated table with one row per slice, so the only
rows that meet in a task are those of one slice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DateType,
    IntegralType,
    NumericType,
    StringType,
    TimestampType,
)

SLICE_ROWS = 65_536
RANGE_LETTERS = 256  # letters of a text that tell ranges apart
SPLITS, FAN = 1024, 32  # slices of a large group, and how many cuts are searched at once


def slice_of(order: Column | str, rows: int = SLICE_ROWS) -> Column:
    """The slice of a dense integer order column."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(rows))


def as_number(df: DataFrame, column: str) -> Column:
    """A number that never falls where the column rises: the value itself, or the first bytes of a text."""
    kind = df.schema[column].dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    if isinstance(kind, BooleanType):
        return F.col(column).cast("int")
    if isinstance(kind, (DateType, TimestampType)):
        return F.unix_date(column).cast("bigint") if isinstance(kind, DateType) else F.unix_micros(column)
    return F.col(column).cast("double") if isinstance(kind, NumericType) and not isinstance(kind, IntegralType) else F.col(column)


def _between(cuts: str, value: Column) -> Column:
    """How many of the sorted cuts lie below a value: first by every ``FAN``-th cut, then inside one run of them."""
    runs = F.sequence(F.lit(FAN), F.lit(SPLITS - 1), F.lit(FAN))
    run = F.size(F.filter(F.transform(runs, lambda i: F.element_at(cuts, i)), lambda c: c < value))
    return FAN * run + F.size(F.filter(F.slice(F.col(cuts), FAN * run + 1, FAN), lambda c: c < value))


def equal_slices(df: DataFrame, by: list[str], order: list[str], rows: int = SLICE_ROWS) -> tuple[DataFrame, list[Column]]:
    """``df`` with slice columns of about equal weight, whatever the distribution of the order's values.

    A group of up to ``rows`` rows is one slice.  A larger one is cut at ``SPLITS`` weighted quantiles of its
    first order column; where one value alone fills more than a slice, its rows are cut at those of the next column, and
    so on.  The cuts are kept for large groups only, so that ordinary rows meet no shuffle for them.
    """
    numbers = [f"_number{i}" for i in range(len(order))]
    at = [f"_part{i}" for i in range(len(order))]
    fractions = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    rows_of = df.select("*", *[as_number(df, c).alias(n) for c, n in zip(order, numbers)])
    outer: list[str] = []
    for i, (number, part) in enumerate(zip(numbers, at)):
        keys = [*by, *outer]
        asked = rows_of if i == 0 else rows_of.filter("_heavy")
        asked = asked.select(number, *[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)])
        own = [f"_key{j}" for j in range(len(keys))]
        large = asked.groupBy(*own).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > rows).drop("_size")
        large = large.toDF(*[f"_large{j}" for j in range(len(keys))])
        same = F.lit(True)
        for j in range(len(keys)):
            same = same & F.col(f"_key{j}").eqNullSafe(F.col(f"_large{j}"))
        inside = asked.join(large, same, "left_semi") if keys else asked
        cuts = inside.groupBy(*own).agg(
            F.count(F.lit(1)).alias("_size"), F.percentile_approx(number, fractions, F.lit(8 * SPLITS)).alias("_cuts")
        ).filter((F.col("_size") > rows) & F.col("_cuts").isNotNull()).drop("_size")
        match = F.lit(True) if i == 0 else F.col("_heavy")
        for j, k in enumerate(keys):
            match = match & F.col(k).eqNullSafe(F.col(f"_key{j}"))
        found = rows_of.join(cuts, match, "left") if keys or i else rows_of.join(F.broadcast(cuts), match, "left")
        value = F.col(number)
        # Two cuts at one value: its rows alone are more than a slice.
        heavy = F.coalesce(F.size(F.filter("_cuts", lambda c: c == value)) > 1, F.lit(False))
        split = F.when(F.col("_cuts").isNull(), 0).when(value.isNull(), -1).otherwise(_between("_cuts", value))
        kept = [c for c in rows_of.columns if c != "_heavy"]
        rows_of = found.select(*kept, split.cast("int").alias(part), heavy.alias("_heavy"))
        outer = [*outer, part, number]
    return rows_of.drop("_heavy", *numbers), [F.col(p) for p in at]


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    return (F.greatest if kind == "max" else F.least)(carry, local)


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    slices: list[Column],
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    coarse=None,
    level: int = 0,
) -> DataFrame:
    """Add running values per group.

    ``specs`` maps a new column to ``(kind, value)`` with kind ``sum``, ``max``, ``min`` or
    ``last`` (the latest non-null value).  ``slices`` compared left to right must be monotone
    in ``order``.  Exclusive running sums start at 0; the other kinds start at null.

    With no slices each group is one window: for groups whose size is known to be bounded.
    Where even the slices of one group are too many for one task, ``coarse`` maps the slice
    columns to coarser slices and the carries are computed the same way.
    """
    over = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}
    if not slices:
        frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )
        plain = lambda kind, v: F.coalesce(F.sum(v).over(frame), F.lit(0)) if kind == "sum" else over[kind](v).over(frame)
        return df.select("*", *[plain(kind, v).alias(name) for name, (kind, v) in specs.items()])

    cuts = [f"_slice{level}_{i}" for i in range(len(slices))]
    values = {name: f"_value{level}_{name}" for name in specs}
    rows = df.select(
        "*",
        *[s.alias(c) for s, c in zip(slices, cuts)],
        *[value.alias(values[name]) for name, (_, value) in specs.items()],
    )

    position = F.struct(*order)
    total = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), position)),
    }
    totals = rows.groupBy(*by, *cuts).agg(
        *[total[kind](values[name]).alias(f"_total_{name}") for name, (kind, _) in specs.items()]
    )
    if coarse is None:
        before = Window.partitionBy(*by).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)
        carries = totals.select(
            *by, *cuts,
            *[over[kind](f"_total_{name}").over(before).alias(f"_carry_{name}") for name, (kind, _) in specs.items()],
        )
    else:
        carries = running(
            totals, by, cuts, coarse([F.col(c) for c in cuts]),
            {f"_carry_{name}": (kind, F.col(f"_total_{name}")) for name, (kind, _) in specs.items()},
            level=level + 1,
        ).drop(*[f"_total_{name}" for name in specs])

    frame = (
        Window.partitionBy(*by, *cuts)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return rows.join(carries, [*by, *cuts], "left").select(
        *df.columns,
        *[
            _combine(kind, F.col(f"_carry_{name}"), over[kind](values[name]).over(frame)).alias(name)
            for name, (kind, _) in specs.items()
        ],
    )


def number_rows(
    df: DataFrame, by: list[str], order: list[str], slices: list[Column], name: str = "idx", coarse=None
) -> DataFrame:
    """Gapless 0-based position inside each group."""
    return running(df, by, order, slices, {name: ("sum", F.lit(1).cast("bigint"))}, coarse=coarse)


def _range_keys(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Keys whose ranges never cut against the order; a long text stands as its first letters.

    Texts that agree in them tell nothing about the columns behind, so these are left out there.
    """
    keys, whole = [], F.lit(True)
    for column, up in order:
        key, kind = F.col(column), df.schema[column].dataType
        shown = F.when(whole, F.substring(column, 1, RANGE_LETTERS) if isinstance(kind, StringType) else key)
        keys.append(shown.asc_nulls_first() if up else shown.desc_nulls_last())
        if isinstance(kind, StringType):
            whole = whole & F.coalesce(F.length(column) < RANGE_LETTERS, F.lit(True))
    return keys


def positions(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank", rows: int = SLICE_ROWS) -> DataFrame:
    """The 0-based place of every row in a total order of ``(column, ascending)`` pairs.

    Nulls come first where the order rises and last where it falls.  No task orders the whole table: its
    rows are dealt to ranges of the order and sorted there, written to the shared folder in files of at most ``rows``
    rows, and a range begins where the counts of the ranges before it end.
    """
    spark = df.sparkSession
    sort = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]
    # The number holds the range in its upper bits and the place inside it in the lower 33.
    cut = df.repartitionByRange(*_range_keys(df, order)).sortWithinPartitions(*sort)
    cut = cut.select("*", F.monotonically_increasing_id().alias("_at"))
    path = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    cut.write.option("maxRecordsPerFile", rows).parquet(path)
    written = spark.read.schema(cut.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    sizes = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    place = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(F.broadcast(begins), "_range").select(*df.columns, place.alias(name))


def previous(
    df: DataFrame, by: list[str], order: list[str], slices: list[Column], columns: list[str],
    name: str = "previous",
) -> DataFrame:
    """Add the columns of the preceding row of the group as one struct, null on the first row."""
    return running(df, by, order, slices, {name: ("last", F.struct(*columns))})


def parts(
    df: DataFrame, by: list[str], order: list[str], slices: list[Column], weight: Column, budget: int
) -> DataFrame:
    """Number consecutive parts of about ``budget`` weight each.

    Grouping by the part bounds what one aggregate row holds: an ordinary group is part 0
    alone, a huge one becomes several rows whose concatenation is the whole value.
    """
    weighed = running(df, by, order, slices, {"_before": ("sum", weight.cast("bigint"))})
    return weighed.withColumn("part", F.floor(F.col("_before") / budget)).drop("_before")


def with_totals(df: DataFrame, by: list[str], totals: dict[str, Column], bounded: bool) -> DataFrame:
    """Add aggregates of the whole group to its rows.

    Bounded groups use a window, which shares the exchange of other windows over the same
    keys; others use an aggregate with map-side combine and a join.
    """
    if bounded:
        group = Window.partitionBy(*by)
        return df.select("*", *[c.over(group).alias(name) for name, c in totals.items()])
    return df.join(df.groupBy(*by).agg(*[c.alias(name) for name, c in totals.items()]), by)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back, so that what reads it several times doesn't repeat the work above."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's checkpoint folder, so a lost executor costs one read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
