"""NULL is the only missing value. These helpers keep it that way under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Sentinel written for missing pixels.
NODATA = -9999.0


def to_null(c: Column, nodata: float | None = NODATA) -> Column:
    """Sentinel, NaN and infinities become NULL."""
    v = c.cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    if nodata is not None:
        bad = bad | (v == F.lit(float(nodata)))
    return F.when(~bad, v)


def is_observed(c: Column) -> Column:
    """True for a present, finite number; never NULL."""
    v = c.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def to_nodata(c: Column, nodata: float = NODATA) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float(nodata)))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bounded value; NULL stays NULL (least/greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or missing."""
    return F.try_divide(a, b)


def spread_or_one(sd: Column, floor: float = 0.0) -> Column:
    """Standard deviation usable as a divisor: missing or <= floor becomes 1."""
    return F.when(sd.isNotNull() & ~F.isnan(sd) & (sd > F.lit(floor)), sd).otherwise(F.lit(1.0))


def zero_as_missing(c: Column) -> Column:
    return F.nullif(c, F.lit(0))
