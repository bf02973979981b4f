"""What file names say about rasters, and which rasters are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Label and crop-mask file-name patterns.
LABEL_NAME = r"nass_.+_yield_([A-Z]{2})_(\d{4})_"
MASK_NAME = r"cdl_.+_([A-Z]{2})_(\d{4})\.tif"


def parse_raster_name(path: Column) -> dict[str, Column]:
    """crop, state, year and, when the fourth part is a 5-digit code, county and name."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    has_county = F.rlike(F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")), F.lit(r"^\d{5}$"))
    return {
        "crop": F.try_element_at(parts, F.lit(1)), "state": F.try_element_at(parts, F.lit(2)),
        "year": F.try_element_at(parts, F.lit(3)).try_cast("int"),
        "county_fips": F.when(has_county, F.try_element_at(parts, F.lit(4))),
        "county_name": F.when(has_county, F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("county"))),
    }


def inventory(files: DataFrame) -> DataFrame:
    """Label and mask rasters per state and year, from paths alone."""
    name = F.substring_index("path", "/", -1)

    def found(pattern: str, kind: str) -> Column:
        state = F.regexp_extract(name, pattern, 1)
        return F.when(state != "", F.struct(F.lit(kind).alias("kind"), state.alias("state"),
                                            F.regexp_extract(name, pattern, 2).cast("int").alias("year")))
    hit = files.select(F.coalesce(found(LABEL_NAME, "label"), found(MASK_NAME, "mask")).alias("_h")) \
        .filter(F.col("_h").isNotNull())
    return hit.groupBy("_h.state", "_h.year").agg(
        F.max(F.col("_h.kind") == "label").alias("has_label"), F.max(F.col("_h.kind") == "mask").alias("has_mask"))


def inventory_gaps(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (state, year) pairs that lack a label or a mask."""
    j = expected.join(found, ["state", "year"], "left") \
        .withColumn("has_label", F.coalesce("has_label", F.lit(False))) \
        .withColumn("has_mask", F.coalesce("has_mask", F.lit(False)))
    return j.filter(~(F.col("has_label") & F.col("has_mask")))


def sample_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata of one sample raster per kind (label, mask): the first of its kind by path."""
    name = F.substring_index("file", "/", -1)
    kind = F.when(name.rlike(LABEL_NAME), "label").when(name.rlike(MASK_NAME), "mask")
    rest = [c for c in metadata.columns if c != "file"]
    tagged = metadata.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return tagged.groupBy("kind").agg(F.min("file").alias("file"), *[F.min_by(c, "file").alias(c) for c in rest])
