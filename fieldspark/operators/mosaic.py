"""Combining overlapping rasters or tiles into one surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import hann
from ..plans import materialise, sized_join
from ..plans.quantiles import order_key

# What stops a merge, what only deserves a warning, and how close resolutions must be.
MUST_AGREE = ("crs", "bands", "dtype")
SHOULD_AGREE = ("res", "nodata", "band_names")
RES_RTOL, RES_ATOL = 1e-5, 1e-8


def input_mismatches(metadata: DataFrame, name: str = "file") -> DataFrame:
    """(file, property, severity, found, expected) where a raster differs from the first one by name.

    ``metadata`` has one row per raster with ``crs, bands, dtype, res, nodata, band_names``.
    Other CRS, band counts or types are errors; resolution, nodata and band names warnings.
    """
    first = metadata.agg(*[F.min_by(c, name).alias(c) for c in (*MUST_AGREE, *SHOULD_AGREE)]).first()
    if first is None:
        return metadata.select(name).limit(0)
    tests = []
    for c in (*MUST_AGREE, *SHOULD_AGREE):
        value = F.lit(first[c]).cast(metadata.schema[c].dataType)
        differs = ~F.col(c).eqNullSafe(value)
        if c == "res":
            differs = F.when(F.col(c).isNotNull() & value.isNotNull(),
                             F.abs(F.col(c) - value) > RES_ATOL + RES_RTOL * F.abs(value)).otherwise(differs)
        shown = [F.concat_ws(",", x) if c == "band_names" else x.cast("string") for x in (F.col(c), value)]
        tests.append(F.when(differs, F.struct(
            F.lit(c).alias("property"), F.lit("error" if c in MUST_AGREE else "warning").alias("severity"),
            shown[0].alias("found"), shown[1].alias("expected"))))
    hits = F.filter(F.array(*tests), lambda t: t.isNotNull())
    return metadata.select(name, F.explode(hits).alias("_m")).select(name, "_m.*")


def require_compatible(metadata: DataFrame, name: str = "file") -> DataFrame:
    """The warnings of ``input_mismatches``; an error there is raised with its first example."""
    found = input_mismatches(metadata, name)
    worst = found.filter("severity = 'error'").orderBy("property", name).first()
    if worst is not None:
        raise ValueError(f"{worst[name]}: {worst['property']} is {worst['found']}, expected {worst['expected']}")
    return found


def overlap(df: DataFrame, keys: Sequence[str], value: str, source: str,
            method: str = "first") -> DataFrame:
    """One value per pixel from overlapping sources, missing values never win.

    ``first``/``last`` follow source-name order and keep the winning source.
    """
    valid = df.filter(F.col(value).isNotNull())
    if method in ("first", "last"):
        # a row per source
        ranks = materialise(valid.select(source).distinct().withColumn(
            "_rank", F.row_number().over(Window.orderBy(source))), "source_ranks")
        # rank and value in one fixed-width number, so that both aggregates are hash aggregates
        order = F.col("_rank").cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + order_key(F.col(value)).cast("decimal(20,0)")
        ranked = sized_join(valid.select(*keys, value, source), ranks, [source], written=True).withColumn("_order", order)
        pick = F.min_by if method == "first" else F.max_by
        out = ranked.groupBy(*keys).agg(pick(value, "_order").alias(value), pick("_rank", "_order").alias("_rank"))
        return sized_join(out, ranks, ["_rank"], written=True).select(*keys, value, source)
    plain = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "mean": F.avg}
    if method not in plain:
        raise ValueError(f"unknown merge method {method!r}")
    return valid.groupBy(*keys).agg(plain[method](value).alias(value))


def blend(tiles: DataFrame, keys: Sequence[str], value: str, chip: int,
          tile_row: str = "tile_row", tile_col: str = "tile_col", floor: float = 0.05) -> DataFrame:
    """Weighted mean of overlapping tiles under a floored Hann window, with the weight surface."""
    w = hann(F.col(tile_row), chip, floor) * hann(F.col(tile_col), chip, floor)
    out = tiles.select(*keys, w.alias("_w"), F.col(value).alias("_v")).groupBy(*keys).agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_acc"), F.sum("_w").alias("weight"))
    return out.select(*keys, F.when(F.col("weight") > 1e-6, F.try_divide("_acc", "weight"))
                      .alias(value), "weight")
