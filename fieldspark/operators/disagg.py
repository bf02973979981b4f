"""Spreading a county's yield over its pixels while keeping the county mean.

County statistics are tiny next to the pixels. They are reduced map-side,
written once and joined back by size, so pixels are scanned but not shuffled
and a county holding a third of all pixels is just more partial aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import clip, spread_or_one
from ..plans import grouped_percentiles, materialise, sized_join

FEATURES = ("NDVI_mean", "EVI_mean", "GCVI_mean", "NDWI_mean")
COUNTY = ("county_fips", "year")

# Redistribution settings.
STRENGTH, WEIGHT_MIN, WEIGHT_MAX = 0.15, 0.50, 1.50
MIN_VALID_PIXELS = 10


def valid_pixel(features: Sequence[str] = FEATURES) -> Column:
    ok = F.col("crop_mask") & F.col("valid_vi_mask")
    for f in features:
        ok = ok & F.col(f).isNotNull()
    return F.coalesce(ok, F.lit(False))


def zscore_parameters(pixels: DataFrame, features: Sequence[str] = FEATURES,
                      keys: Sequence[str] = COUNTY) -> DataFrame:
    """Mean and usable spread of each index over the valid pixels of a county-year."""
    ok = valid_pixel(features)
    return pixels.filter(F.col("crop_mask")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("crop_pixel_count"), F.count(F.when(ok, 1)).alias("valid_vi_pixel_count"),
        *[a for f in features for a in (
            F.avg(F.when(ok, F.col(f))).alias(f"{f}_mu"),
            spread_or_one(F.stddev_pop(F.when(ok, F.col(f)))).alias(f"{f}_sd"))])


def county_zscores(pixels: DataFrame, features: Sequence[str] = FEATURES,
                   keys: Sequence[str] = COUNTY) -> DataFrame:
    """Crop pixels with ``<index>_z``: statistics from valid pixels, applied to all."""
    params = zscore_parameters(pixels, features, keys)
    joined = sized_join(pixels.filter(F.col("crop_mask")), params, list(keys))
    return joined.withColumns({f"{f}_z": (F.col(f) - F.col(f"{f}_mu")) / F.col(f"{f}_sd")
                               for f in features})


def weights_from_table(table: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """Weights of a coefficient table: the normalised column, else raw ones normalised here.

    Reduced to a single row before it reaches the driver.
    """
    stored = "gee_weight_normalized" in table.columns
    column = "gee_weight_normalized" if stored else "ridge_coef_standardized"
    if column not in table.columns:
        raise ValueError("coefficient table needs gee_weight_normalized or ridge_coef_standardized")
    row = table.agg(*[F.min(F.when(F.col("feature") == f, F.col(column).try_cast("double"))).alias(f)
                      for f in features]).first()
    missing = [f for f in features if row[f] is None]
    if missing:
        raise ValueError(f"coefficient table is missing features: {missing}")
    total = 1.0 if stored else sum(abs(row[f]) for f in features)
    if total == 0:
        raise ValueError("cannot normalise zero coefficients")
    return {f: row[f] / total for f in features}


def vegetation_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum of county z-scores."""
    terms = [F.lit(float(w)) * F.col(f"{f}_z") for f, w in weights.items()]
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    return score


def disaggregate(pixels: DataFrame, yields: DataFrame, weights: Mapping[str, float],
                 strength: float = STRENGTH, lo: float = WEIGHT_MIN, hi: float = WEIGHT_MAX,
                 min_valid: int = MIN_VALID_PIXELS, fill_invalid: bool = True) -> DataFrame:
    """Pixel yields whose mean over each county's output pixels is the county yield.

    ``yields`` has (county_fips, year, yield_bu_ac); several rows of a county-year count as
    their mean, so pixels never double. Counties
    without a yield, with too few valid pixels or with a zero mean weight are left out.
    """
    features = list(weights)
    keys = list(COUNTY)
    params = materialise(
        zscore_parameters(pixels, features).filter(F.col("valid_vi_pixel_count") >= min_valid)
        .join(yields.filter(F.col("yield_bu_ac").isNotNull()).groupBy(*keys).agg(F.avg("yield_bu_ac").alias("yield_bu_ac")), keys),
        "county_params")
    ok = valid_pixel(features)
    raw = sized_join(pixels.filter(F.col("crop_mask") if fill_invalid else ok), params, keys, written=True)
    raw = raw.withColumns({f"{f}_z": (F.col(f) - F.col(f"{f}_mu")) / F.col(f"{f}_sd") for f in features})
    raw = raw.withColumn("is_valid", ok).withColumn(
        "raw_weight", F.when(ok, clip(F.lit(1.0) + F.lit(strength) * vegetation_score(weights), lo, hi))
        .otherwise(F.lit(1.0)))
    raw = raw.drop(*[f"{f}_z" for f in features])
    means = raw.groupBy(*keys).agg(F.avg("raw_weight").alias("mean_raw_weight"),
                                   F.count(F.lit(1)).alias("output_pixel_count")) \
        .filter(F.col("mean_raw_weight") != 0)
    out = sized_join(raw, means, keys)
    return out.withColumn("pseudo_yield",
                          F.col("yield_bu_ac") * (F.col("raw_weight") / F.col("mean_raw_weight")))


def diagnostics(spread: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Per-county profile of a disaggregated table, including the kept-mean check."""
    keys = list(COUNTY)
    y = "pseudo_yield"
    once = ["crop_pixel_count", "valid_vi_pixel_count", "output_pixel_count", "mean_raw_weight",
            *[f"{f}_{s}" for f in features for s in ("mu", "sd")]]
    out = grouped_percentiles(spread, keys, {"pseudo_yield_median_bu_ac": (y, 0.5)}, also=[
        F.min("state").alias("state"), F.min("yield_bu_ac").alias("nass_yield_bu_ac"),
        *[F.min(c).alias(c) for c in once],
        F.avg(y).alias("pseudo_yield_mean_bu_ac"), F.min(y).alias("pseudo_yield_min_bu_ac"),
        F.max(y).alias("pseudo_yield_max_bu_ac"), F.stddev_pop(y).alias("pseudo_yield_std_bu_ac")])
    return out.withColumn(
        "mean_difference_from_nass", F.col("pseudo_yield_mean_bu_ac") - F.col("nass_yield_bu_ac"))
