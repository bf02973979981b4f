"""Chip manifests and the gates that decide which chips are worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes, dates, geo
from ..functions.nulls import ratio
from ..plans import sized_join
from .grid import tile_windows
from .tables import exclude


def chip_crop_fraction(pixels: DataFrame, keys: list[str], chip: int, crop: str = "crop_mask") -> DataFrame:
    """Share of crop pixels in each whole-tile chip. Absent pixels are not crop."""
    return pixels.filter(F.col(crop)).groupBy(
        *keys, geo.chip_of(F.col("row"), chip).alias("row_off"), geo.chip_of(F.col("col"), chip).alias("col_off")) \
        .agg(F.count(F.lit(1)).alias("crop_px")) \
        .withColumn("crop_fraction", F.col("crop_px") / F.lit(float(chip * chip)))


def qualifying_chips(pixels: DataFrame, grids: DataFrame, keys: list[str], chip: int,
                     min_crop_fraction: float, crop: str = "crop_mask") -> DataFrame:
    """Chips at or above the crop share that lie wholly inside their raster."""
    frac = chip_crop_fraction(pixels, keys, chip, crop).filter(F.col("crop_fraction") >= min_crop_fraction)
    return sized_join(frac, grids.select(*keys, "height", "width"), keys).filter(
        (F.col("row_off") + chip <= F.col("height")) & (F.col("col_off") + chip <= F.col("width"))) \
        .drop("height", "width")


def build_manifest(grids: DataFrame, crop: str, variant: str, chip: int = geo.CHIP,
                   stride: int = geo.CHIP, units: str = "kg/ha",
                   source: str = "ridge_distributed_county_yield") -> DataFrame:
    """One row per chip window of every labelled (state, year) raster."""
    tiles = tile_windows(grids, chip, stride)
    half = F.lit(chip / 2)
    x, y = geo.pixel_xy(F.col("row_off") + half, F.col("col_off") + half, F.col("a"), F.col("b"),
                        F.col("c"), F.col("d"), F.col("e"), F.col("f"))
    lon, lat = geo.lonlat(x, y)
    none = F.lit(None)
    return tiles.select(
        geo.sample_id(F.lit(crop), F.col("state"), F.col("year"), F.col("row_off"), F.col("col_off")).alias("sample_id"),
        F.lit(crop).alias("crop"), "year", "state", codes.state_fips(F.col("state")).alias("state_fips"),
        F.lit(variant).alias("label_variant"), F.lit(units).alias("label_units"), F.lit(source).alias("label_source"),
        "row_off", "col_off", F.lit(chip).alias("chip_size"), F.lit(stride).alias("stride"), "crs",
        F.abs("a").alias("resolution_m"), lat.alias("center_lat"), lon.alias("center_lon"),
        dates.representative_dates(F.col("year")).alias("dates"),
        none.cast("bigint").alias("n_valid_crop_px"), none.cast("double").alias("valid_hls_fraction"),
        none.cast("double").alias("valid_label_fraction"), none.cast("string").alias("split"),
        F.lit("").alias("qc_flags"))


def semi_join_chips(manifest: DataFrame, chips: DataFrame, keys: tuple[str, ...] = ("state", "year")) -> DataFrame:
    """Manifest rows whose window qualifies. A state-year without inputs keeps nothing."""
    on = [*keys, "row_off", "col_off"]
    return sized_join(manifest, chips.select(*on).distinct(), on, "left_semi")


def filter_manifest(manifest: DataFrame, crop_pixels: DataFrame, grids: DataFrame, chip: int,
                    min_crop_fraction: float, excluded: DataFrame | None = None) -> DataFrame:
    """Chip gate on the label grid, then the exclusion list.

    ``crop_pixels`` are crop pixels already aligned to the label grid and clipped to the state.
    """
    good = qualifying_chips(crop_pixels, grids, ["state", "year"], chip, min_crop_fraction)
    kept = semi_join_chips(manifest, good)
    return exclude(kept, excluded, "sample_id") if excluded is not None else kept


def coverage_counts(df: DataFrame, keys: list[str], kept: Column) -> DataFrame:
    """Kept and total units with the kept share."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(kept, 1)).alias("kept")) \
        .withColumn("kept_share", ratio(F.col("kept").cast("double"), F.col("total")))
