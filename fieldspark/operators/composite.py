"""Clear-sky composites. Every reduction here is a partial + final aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, spectral
from ..functions.nulls import is_observed
from ..functions.spectral import BAND_ORDER, INDICES
from ..plans import grouped_percentiles, sized_join

PIXEL = ("state", "year", "row", "col")


def clear_observations(scenes: DataFrame, bands: Sequence[str] = BAND_ORDER, qa: str = "fmask",
                       **mask_options: bool) -> DataFrame:
    """Scene pixels that count: clear, and every band finite and above the fill value."""
    ok = spectral.clear_mask(F.col(qa), **mask_options)
    for b in bands:
        ok = ok & is_observed(F.col(b)) & (F.col(b) > spectral.FILL_THRESHOLD)
    return scenes.filter(ok)


def monthly_composite(scenes: DataFrame, bands: Sequence[str] = BAND_ORDER,
                      keys: Sequence[str] = (*PIXEL[:2], "month", *PIXEL[2:]), qa: str = "fmask",
                      method: str = "mean", day: str | None = None, **mask_options: bool) -> DataFrame:
    """Mean (or median) of each band over clear scenes with the observation count.

    With ``day``, the acquisition date, only scenes inside the composite window of their
    (year, month) count; November stops on the 15th.
    """
    clear = clear_observations(scenes, bands, qa, **mask_options)
    if day is not None:
        clear = clear.filter(dates.in_month_window(F.col(day), F.col("year"), F.col("month")))
    count = F.count(F.lit(1)).cast("int").alias("OBS_COUNT")
    if method == "mean":
        return clear.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands], count)
    if method == "median":
        return grouped_percentiles(clear, keys, {b: (b, 0.5) for b in bands}, also=[count], bounded=True)
    raise ValueError(f"unknown composite method {method!r}")


def failed_chips(scene_chips: DataFrame, scene_status: DataFrame, chip_keys: Sequence[str]) -> DataFrame:
    """Chips touched by a scene that could not be read."""
    bad = scene_status.filter(~F.col("ok")).select("scene_id")
    return sized_join(scene_chips, bad, ["scene_id"], "left_semi").select(*chip_keys).distinct()


def composite_for_chips(chips: DataFrame, composite: DataFrame, chip_keys: list[str],
                        failed: DataFrame | None = None) -> DataFrame:
    """Chip table with its composite rows.

    A chip no scene covers stays, with count 0 (``left`` join). With ``failed`` the
    policy is fail-closed: chips with any unreadable scene are left out entirely.
    """
    if failed is not None:
        chips = chips.join(failed, chip_keys, "left_anti")
    out = chips.join(composite, chip_keys, "left")
    return out.withColumn("OBS_COUNT", F.coalesce("OBS_COUNT", F.lit(0)))


def scene_indices(scenes: DataFrame, reflectance: dict[str, Column], clear: Column,
                  variant: str = "season") -> DataFrame:
    """Scene pixels with one column per vegetation index."""
    vi = spectral.vegetation_indices(**reflectance, clear=clear, variant=variant)
    return scenes.withColumns(vi)


def season_composite(scenes: DataFrame, keys: Sequence[str] = PIXEL, min_obs: int = 3,
                     also: Sequence[Column] = ()) -> DataFrame:
    """Index first, then mean over scenes; each index keeps its own count.

    A pixel is valid when its smallest count reaches ``min_obs``. ``also`` are further
    aggregates per pixel, such as its crop flag.
    """
    agg = scenes.groupBy(*keys).agg(
        *[F.avg(v).alias(f"{v}_mean") for v in INDICES],
        *[F.count(v).cast("int").alias(f"{v}_obsCount") for v in INDICES], *also)
    low = F.least(*[F.col(f"{v}_obsCount") for v in INDICES])
    return agg.withColumn("min_index_obsCount", low).withColumn("valid_vi_mask", low >= min_obs)


def median_composite(scenes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact per-pixel median over scenes; a pixel has at most one row per scene."""
    return grouped_percentiles(scenes, keys, {c: (c, 0.5) for c in columns}, bounded=True)


def season_range(monthly: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, max, min and range over monthly composites."""
    out = monthly.groupBy(*keys).agg(*[
        a for c in columns for a in (F.avg(c).alias(f"{c}_season_mean"), F.max(c).alias(f"{c}_season_max"),
                                     F.min(c).alias(f"{c}_season_min"))])
    return out.withColumns({f"{c}_season_range": F.col(f"{c}_season_max") - F.col(f"{c}_season_min")
                            for c in columns})
