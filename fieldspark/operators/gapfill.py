"""Filling months without data in per-pixel series.

A season has a fixed, small number of months, so a series is one wide row and
the fill is plain column arithmetic: one partial aggregate, no sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def wide_series(df: DataFrame, keys: Sequence[str], month: str, value: str,
                months: Sequence[int]) -> DataFrame:
    """One row per key with a column ``m<month>`` per month (mean of duplicates)."""
    return df.filter(F.col(month).isin(*months)).groupBy(*keys).agg(
        *[F.avg(F.when(F.col(month) == m, F.col(value))).alias(f"m{m}") for m in months])


def _known(cols: Sequence[Column], order: Sequence[int]) -> tuple[Column, Column]:
    """Value and position of the first present column along ``order``."""
    none = F.lit(None).cast("double")
    if not order:
        return none, none
    value = F.coalesce(*[cols[i] for i in order], none)
    at = F.coalesce(*[F.when(cols[i].isNotNull(), F.lit(float(i))) for i in order], none)
    return value, at


def fill_columns(cols: Sequence[Column], policy: str) -> list[Column]:
    """Filled series. ``linear`` holds the ends flat, ``nearest`` prefers the earlier month
    on ties, ``zero`` writes 0, ``drop`` leaves gaps NULL. An all-missing series becomes 0."""
    out = []
    for i, c in enumerate(cols):
        if policy == "drop":
            out.append(c)
            continue
        if policy == "zero":
            out.append(F.coalesce(c, F.lit(0.0)))
            continue
        v0, t0 = _known(cols, range(i - 1, -1, -1))
        v1, t1 = _known(cols, range(i + 1, len(cols)))
        if policy == "linear":
            between = v0 + (v1 - v0) * (F.lit(float(i)) - t0) / (t1 - t0)
            fill = F.coalesce(between, v0, v1)
        elif policy == "nearest":
            fill = F.when(t1.isNull() | (i - t0 <= t1 - i), F.coalesce(v0, v1)).otherwise(v1)
        else:
            raise ValueError(f"unknown missing-month policy {policy!r}")
        out.append(F.coalesce(c, fill, F.lit(0.0)))
    return out


def fill_months(df: DataFrame, keys: Sequence[str], month: str, value: str,
                months: Sequence[int], policy: str = "linear") -> DataFrame:
    """Long series with gaps to a long series without: (keys, month, value, was_missing)."""
    wide = wide_series(df, keys, month, value, months)
    cols = [F.col(f"m{m}") for m in months]
    filled = fill_columns(cols, policy)
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias(month), f.alias(value), c.isNull().alias("was_missing"))
        for m, f, c in zip(months, filled, cols)])).alias("_r")
    return wide.select(*keys, rows).select(*keys, f"_r.{month}", f"_r.{value}", "_r.was_missing")
