"""Season windows, representative dates and acquisition-date rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Composite windows (month, first day, last day), S30 start date, season.
TIMESTEPS = ((4, 1, 30), (5, 1, 31), (6, 1, 30), (7, 1, 31),
             (8, 1, 31), (9, 1, 30), (10, 1, 31), (11, 1, 15))
S30_START = "2015-11-28"
SEASON_START, SEASON_END = (4, 1), (11, 15)


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def month_end(year: Column, month: Column) -> Column:
    """Last day of the composite window; November stops on the 15th."""
    first = month_start(year, month)
    return F.when(month == 11, F.date_add(first, 14)).otherwise(F.last_day(first))


def in_season(day: Column) -> Column:
    d = day.cast("date")
    lo = F.make_date(F.year(d), F.lit(SEASON_START[0]), F.lit(SEASON_START[1]))
    hi = F.make_date(F.year(d), F.lit(SEASON_END[0]), F.lit(SEASON_END[1]))
    return (d >= lo) & (d <= hi)


def in_month_window(day: Column, year: Column, month: Column) -> Column:
    d = day.cast("date")
    return (d >= month_start(year, month)) & (d <= month_end(year, month))


def collections_for(end_date: Column) -> Column:
    """Sensor collections available up to ``end_date``."""
    from .spectral import L30_COLLECTION, S30_COLLECTION
    both = F.array(F.lit(L30_COLLECTION), F.lit(S30_COLLECTION))
    return F.when(end_date.cast("date") >= F.lit(S30_START).cast("date"), both) \
        .otherwise(F.array(F.lit(L30_COLLECTION)))


def representative_dates(year: Column, n: int | None = None) -> Column:
    """Midpoint date of each composite window, first ``n`` windows."""
    steps = TIMESTEPS[:n] if n else TIMESTEPS
    return F.array(*[F.make_date(year.cast("int"), F.lit(m), F.lit(max(1, (a + b) // 2)))
                     for m, a, b in steps])


def temporal_coords(year: Column, n: int | None = None) -> Column:
    """Array of (year, day of year) pairs, one per composite window."""
    return F.transform(representative_dates(year, n), lambda d: F.struct(
        year.cast("int").alias("year"), F.dayofyear(d).alias("doy")))
