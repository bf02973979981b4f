"""Explicit schemas of the stored tables. Codes stay text; counts are integers."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR = T.StringType()

SURVEY_RECORD = _s(("state_alpha", STR), ("state_fips_code", STR), ("county_name", STR), ("county_code", STR),
                   ("year", STR), ("Value", STR))
COUNTY_YIELD_TEXT = _s(("state", STR), ("geoid", STR), ("year", STR), ("county_name", STR), ("state_fips", STR),
                       ("yield_bu_ac", STR), ("yield_kg_ha", STR))
COUNTY_VI_TEXT = _s(*[(n, STR) for n in (
    "state", "state_fips", "county_fips", "county_name", "year", "crop", "season_start", "season_end", "NDVI_mean",
    "EVI_mean", "GCVI_mean", "NDWI_mean", "min_index_obsCount", "crop_pixel_count", "valid_pixel_count",
    "valid_pixel_fraction")])
COUNTY_VI_TYPES = {"year": "int", "NDVI_mean": "double", "EVI_mean": "double", "GCVI_mean": "double",
                   "NDWI_mean": "double", "min_index_obsCount": "double", "crop_pixel_count": "double",
                   "valid_pixel_count": "double", "valid_pixel_fraction": "double"}
