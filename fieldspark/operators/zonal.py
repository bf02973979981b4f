"""County statistics over pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.nulls import ratio
from ..functions.spectral import INDICES
from ..plans import grouped_percentiles


def zonal_statistics(counties: DataFrame, pixels: DataFrame, keys: list[str], value: str,
                     crop: str = "crop_mask") -> DataFrame:
    """Mean, median, std, min, max, counts and valid fraction of crop pixels per county.

    Pixels are reduced before the join, so a county without pixels appears with
    zero counts and a hot county costs one partial aggregate per task.
    """
    on_crop = pixels.filter(F.col(crop))
    stats = grouped_percentiles(on_crop, keys, {"median": (value, 0.5)}, also=[
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count(value).alias("valid_pixel_count"),
        F.count(F.lit(1)).alias("crop_pixel_count")])
    out = counties.join(stats, keys, "left")
    n = F.coalesce("valid_pixel_count", F.lit(0))
    crop_n = F.coalesce("crop_pixel_count", F.lit(0))
    return out.withColumn("valid_pixel_count", n).withColumn("crop_pixel_count", crop_n) \
        .withColumn("valid_fraction", F.coalesce(
            ratio(F.col("valid_pixel_count").cast("double"), F.col("crop_pixel_count")), F.lit(0.0)))


def county_vi_summary(vi_pixels: DataFrame, keys: list[str], crop: str = "crop_mask") -> DataFrame:
    """County-year index means over valid crop pixels, with pixel counts and valid fraction."""
    valid = F.col(crop) & F.col("valid_vi_mask")
    out = vi_pixels.filter(F.col(crop)).groupBy(*keys).agg(
        *[F.avg(F.when(valid, F.col(f"{v}_mean"))).alias(f"{v}_mean") for v in INDICES],
        F.avg(F.when(valid, F.col("min_index_obsCount"))).alias("min_index_obsCount"),
        F.count(F.lit(1)).alias("crop_pixel_count"),
        F.count(F.when(valid, 1)).alias("valid_pixel_count"))
    return out.withColumn("valid_pixel_fraction",
                          ratio(F.col("valid_pixel_count").cast("double"), F.col("crop_pixel_count")))


def month_features(pixels: DataFrame, keys: list[str], columns: Sequence[str],
                   months: Sequence[int]) -> DataFrame:
    """Wide county table: ``<column>_month_MM_mean`` and counts, one aggregate pass."""
    aggs = []
    for m in months:
        here = F.col("month") == m
        for c in columns:
            aggs += [F.avg(F.when(here, F.col(c))).alias(f"{c}_month_{m:02d}_mean"),
                     F.count(F.when(here, F.col(c))).alias(f"{c}_month_{m:02d}_valid_pixel_count")]
    return pixels.groupBy(*keys).agg(*aggs)


def county_mean_prediction(pixels: DataFrame, county: str = "geoid", pred: str = "pred",
                           crop: str = "crop_mask") -> DataFrame:
    """Mean prediction over crop pixels of each real county."""
    from ..functions.codes import clean_fips
    ok = F.col(crop) & F.col(pred).isNotNull() & (F.col(county).try_cast("int") > 0)
    return pixels.filter(ok).groupBy(clean_fips(F.col(county)).alias("geoid")) \
        .agg(F.avg(pred).alias("pred"))
