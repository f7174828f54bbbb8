"""Human-readable labels.  The wording of every label is a fixed value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_label(ms: Column | str) -> Column:
    """``4:52`` or ``1:02:07`` from milliseconds."""
    seconds = F.floor(_col(ms) / 1000)
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(
        F.format_string("%d:%02d", m, s)
    )


def speed_label(speed: Column | str) -> Column:
    return F.concat(_col(speed).cast("double").cast("string"), F.lit("×"))


def _one_decimal(n: Column, unit: int) -> Column:
    tenths = F.floor((n * 20 + unit) / F.lit(2 * unit))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def bytes_label(n: Column | str) -> Column:
    """1024-based size."""
    n = _col(n)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(_one_decimal(n, 1024), F.lit(" KB")))
        .otherwise(F.concat(_one_decimal(n, 1024**2), F.lit(" MB")))
    )


def model_bytes_label(n: Column | str) -> Column:
    """1000-based size."""
    n = _col(n)
    whole = lambda unit: F.floor((n * 2 + unit) / F.lit(2 * unit)).cast("string")
    return (
        F.when(n >= 10**9, F.concat(_one_decimal(n, 10**9), F.lit(" GB")))
        .when(n >= 10**6, F.concat(whole(10**6), F.lit(" MB")))
        .when(n >= 10**3, F.concat(whole(10**3), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def age_label(at: Column | str, now: Column) -> Column:
    seconds = F.unix_seconds(now) - F.unix_seconds(_col(at))
    days, hours, minutes = (F.floor(seconds / n) for n in (86_400, 3_600, 60))
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} trước"))
    return (
        F.when(days > 0, ago(days, "ngày"))
        .when(hours > 0, ago(hours, "giờ"))
        .when(minutes > 0, ago(minutes, "phút"))
        .otherwise(F.lit("Vừa xong"))
    )


def error_label(c: Column | str, cap: int = 200) -> Column:
    first = F.substring_index(_col(c), "\n", 1)
    return F.when(F.length(first) > cap, F.concat(F.substring(first, 1, cap), F.lit("…"))).otherwise(first)
