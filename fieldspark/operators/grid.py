"""Raster grids: tiles, alignment between grids, regridding, splitting by county."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import CHIP
from ..plans import sized_join


def _offsets(size: Column, chip: int, stride: int) -> Column:
    """Start positions along one axis; a clamped last tile covers a remainder."""
    last = F.greatest(size - F.lit(chip), F.lit(0))
    regular = F.sequence(F.lit(0), last, F.lit(stride))
    return F.when(F.element_at(regular, -1) + chip < size,
                  F.concat(regular, F.array(last))).otherwise(regular)


def tile_windows(grids: DataFrame, chip: int = CHIP, stride: int = CHIP) -> DataFrame:
    """Chip windows of every raster; the last row and column are clamped to the edge.

    A raster smaller than a chip gives one short tile.
    """
    h, w = F.col("height"), F.col("width")
    return grids.withColumn("row_off", F.explode(_offsets(h, chip, stride))) \
        .withColumn("col_off", F.explode(_offsets(w, chip, stride))) \
        .withColumn("tile_height", F.least(F.lit(chip), h)).withColumn("tile_width", F.least(F.lit(chip), w))


def whole_tiles(grids: DataFrame, chip: int = CHIP) -> DataFrame:
    """Full tiles only; a raster smaller than a chip has none."""
    big = grids.filter((F.col("height") >= chip) & (F.col("width") >= chip))
    return big.withColumn("row_off", F.explode(F.sequence(F.lit(0), F.col("height") - chip, F.lit(chip)))) \
        .withColumn("col_off", F.explode(F.sequence(F.lit(0), F.col("width") - chip, F.lit(chip))))


def grid_offset(a_grid: DataFrame, b_grid: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Whole-pixel shift (dr, dc) that turns a pixel of ``a`` into the same ground of ``b``.

    Different projections or resolutions, or a fractional shift, are errors.
    """
    cols = ["a", "e", "c", "f", "crs"]
    left = a_grid.select(*keys, *[F.col(c).alias(f"{c}1") for c in cols])
    right = b_grid.select(*keys, *[F.col(c).alias(f"{c}2") for c in cols])
    j = left.join(right, keys)
    dc = (F.col("c1") - F.col("c2")) / F.col("a2")
    dr = (F.col("f1") - F.col("f2")) / F.col("e2")
    same = (F.col("crs1") == F.col("crs2")) & (F.abs(F.col("a1") - F.col("a2")) <= tolerance) \
        & (F.abs(F.col("e1") - F.col("e2")) <= tolerance)
    whole = (F.abs(dc - F.rint(dc)) <= tolerance) & (F.abs(dr - F.rint(dr)) <= tolerance)

    def checked(v: Column) -> Column:
        return F.when(~same, F.raise_error(F.lit("grids differ in projection or resolution"))) \
            .when(~whole, F.raise_error(F.lit("grids are offset by a fractional pixel"))) \
            .otherwise(F.rint(v).cast("int"))
    return j.select(*keys, checked(dr).alias("dr"), checked(dc).alias("dc"))


def shift_to(pixels: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Move pixel indices onto the other grid. One row per raster pair is joined in."""
    return sized_join(pixels, offsets, keys) \
        .withColumn("row", (F.col("row") + F.col("dr")).cast("int")) \
        .withColumn("col", (F.col("col") + F.col("dc")).cast("int")).drop("dr", "dc")


def aligned_join(a: DataFrame, b: DataFrame, offsets: DataFrame, keys: list[str],
                 how: str = "inner") -> DataFrame:
    """Join two pixel tables on the same ground; result rows carry the indices of ``a``.

    ``offsets`` maps ``a`` to ``b``; ``b`` is shifted back so both share one key.
    """
    back = offsets.select(*keys, (-F.col("dr")).alias("dr"), (-F.col("dc")).alias("dc"))
    return a.join(shift_to(b, back, keys), [*keys, "row", "col"], how)


def source_position(grids: DataFrame) -> tuple[Column, Column]:
    """Fractional source (row, col) of a target pixel centre, from columns of both grids."""
    x = F.col("t_c") + F.col("t_a") * (F.col("col") + 0.5)
    y = F.col("t_f") + F.col("t_e") * (F.col("row") + 0.5)
    return (y - F.col("s_f")) / F.col("s_e"), (x - F.col("s_c")) / F.col("s_a")


def regrid_nearest(targets: DataFrame, source: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """Value of the source pixel that contains each target centre; outside gives NULL.

    ``grids`` has t_a,t_e,t_c,t_f (target) and s_a,s_e,s_c,s_f (source) per key.
    """
    r, c = source_position(grids)
    placed = sized_join(targets, grids, keys) \
        .withColumn("_sr", F.floor(r).cast("int")).withColumn("_sc", F.floor(c).cast("int"))
    src = source.withColumnRenamed("row", "_sr").withColumnRenamed("col", "_sc")
    grid_cols = [x for x in grids.columns if x not in keys]
    return placed.drop(*grid_cols).join(src, [*keys, "_sr", "_sc"], "left").drop("_sr", "_sc")


#: Rows and columns of a source block.
BLOCK = 256


def regrid_bilinear(targets: DataFrame, source: DataFrame, grids: DataFrame, keys: list[str],
                    value: str, block: int = BLOCK) -> DataFrame:
    """Bilinear mean of the four nearest source centres, renormalised over valid ones.

    ``targets`` and ``source`` have one row per (keys, row, col). The source is cut into
    blocks that also hold the first row and column of their neighbours, so the four centres of
    a target lie in one block: each target moves once, each source pixel once plus the borders,
    and the stencil is evaluated on the block's array.
    """
    r, c = source_position(grids)
    placed = sized_join(targets.select(*keys, "row", "col"), grids, keys).select(
        *keys, "row", "col", (r - 0.5).alias("_r"), (c - 0.5).alias("_c")) \
        .withColumns({"_br": F.floor(F.floor("_r") / block), "_bc": F.floor(F.floor("_c") / block)})

    def homes(at: str) -> Column:
        own = F.floor(F.col(at) / block)
        return F.explode(F.when(F.col(at) % block == 0, F.array(own, own - 1)).otherwise(F.array(own)))

    # names of their own, since both sides may come from one table
    pixels = source.filter(F.col(value).isNotNull()).select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], F.col("row").cast("long").alias("_sr"), F.col("col").cast("long").alias("_sc"), F.col(value).cast("double").alias("_v"))
    pixels = pixels.withColumn("_sbr", homes("_sr")).withColumn("_sbc", homes("_sc"))
    kept = placed.select(*keys, "row", "col").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{value}` double"

    def stencil(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if t.empty:
            return t[[*keys, "row", "col"]].assign(**{value: np.empty(0)})
        r0, c0 = int(t["_br"].iloc[0]) * block, int(t["_bc"].iloc[0]) * block
        area = np.full((block + 1, block + 1), np.nan)
        area[s["_sr"].to_numpy() - r0, s["_sc"].to_numpy() - c0] = s["_v"].to_numpy()
        y, x = t["_r"].to_numpy(), t["_c"].to_numpy()
        i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        fy, fx = y - i, x - j
        total, weight = np.zeros(len(t)), np.zeros(len(t))
        for di in (0, 1):
            for dj in (0, 1):
                v = area[i - r0 + di, j - c0 + dj]
                w = np.where(np.isnan(v), 0.0, (fy if di else 1 - fy) * (fx if dj else 1 - fx))
                total += np.where(w > 0, w * np.nan_to_num(v), 0.0)
                weight += w
        out = t[[*keys, "row", "col"]].copy()
        mean = np.divide(total, weight, out=np.zeros(len(t)), where=weight > 0)
        out[value] = pd.array(mean, dtype="Float64")
        out.loc[weight == 0, value] = pd.NA
        return out
    return placed.groupBy(*keys, "_br", "_bc").cogroup(pixels.groupBy(*[f"_s_{k}" for k in keys], "_sbr", "_sbc")) \
        .applyInPandas(stencil, schema)


def county_boxes(pixels: DataFrame, keys: list[str], county: str = "county_fips") -> DataFrame:
    """Smallest window holding all pixels of each county (half-open)."""
    return pixels.filter(F.col(county).isNotNull()).groupBy(*keys, county).agg(
        F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"),
        F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"))


def split_by_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str], county: str = "county_fips",
                   cell: int = 64) -> DataFrame:
    """All pixels inside each county's box. Boxes overlap, so a pixel may appear in several.

    Boxes are listed per coarse cell; pixels meet only the boxes of their own cell.
    """
    listed = boxes.withColumnRenamed(county, "piece") \
        .withColumn("_cr", F.explode(F.sequence(F.floor(F.col("row0") / cell), F.floor((F.col("row1") - 1) / cell)))) \
        .withColumn("_cc", F.explode(F.sequence(F.floor(F.col("col0") / cell), F.floor((F.col("col1") - 1) / cell))))
    tagged = pixels.withColumn("_cr", F.floor(F.col("row") / cell)).withColumn("_cc", F.floor(F.col("col") / cell))
    inside = (F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row1")) \
        & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col1"))
    return sized_join(tagged, listed, [*keys, "_cr", "_cc"]).filter(inside) \
        .drop("_cr", "_cc", "row0", "row1", "col0", "col1")


def snap_extent(df: DataFrame, res: float, chip: int = CHIP) -> DataFrame:
    """Extent (left, right, top, bottom) grown outward to whole chips of origin (ox, oy)."""
    step = F.lit(float(res) * chip)
    c0 = (F.floor((F.col("left") - F.col("ox")) / step) * chip).cast("int")
    r0 = (F.floor((F.col("oy") - F.col("top")) / step) * chip).cast("int")
    out = df.withColumn("col0", c0).withColumn("row0", r0)
    out = out.withColumn("x0", F.col("ox") + F.col("col0") * res).withColumn("y0", F.col("oy") - F.col("row0") * res)
    return out.withColumn("ncols", (F.ceil((F.col("right") - F.col("x0")) / step) * chip).cast("int")) \
              .withColumn("nrows", (F.ceil((F.col("y0") - F.col("bottom")) / step) * chip).cast("int"))


def covering_window(df: DataFrame) -> DataFrame:
    """Pixel window over box (xmin..ymax) on grid (a, e, c, f): floor/ceil, at least 1 x 1."""
    col0 = F.floor((F.col("xmin") - F.col("c")) / F.col("a"))
    col1 = F.ceil((F.col("xmax") - F.col("c")) / F.col("a"))
    row0 = F.floor((F.col("ymax") - F.col("f")) / F.col("e"))
    row1 = F.ceil((F.col("ymin") - F.col("f")) / F.col("e"))
    return df.withColumn("row_off", row0.cast("int")).withColumn("col_off", col0.cast("int")) \
        .withColumn("win_height", F.greatest(F.lit(1), row1 - row0).cast("int")) \
        .withColumn("win_width", F.greatest(F.lit(1), col1 - col0).cast("int"))


def preview(pixels: DataFrame, max_dim: int, height: int, width: int) -> DataFrame:
    """Decimated preview: every n-th row and column so the longer side fits ``max_dim``."""
    step = max(1, -(-max(height, width) // max_dim))
    return pixels.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))


def pseudo_region(measured: DataFrame, value: str, keys: Sequence[str] = ("year",)) -> tuple[DataFrame, DataFrame]:
    """Mask and label of a region defined by where a measured value exists, and a loss check.

    The check compares valid input pixels with pixels kept inside the padded grid
    (``nrows`` x ``ncols`` columns of the input).
    """
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("nrows")) \
        & (F.col("col") >= 0) & (F.col("col") < F.col("ncols"))
    valid = measured.filter(F.col(value).isNotNull())
    label = valid.filter(inside).select(*keys, "row", "col", F.col(value).alias("label"),
                                        F.lit(True).alias("crop_mask"))
    check = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_px"),
                                     F.count(F.when(inside, 1)).alias("kept_px"))
    return label, check.withColumn("lost_pixels", F.col("source_px") != F.col("kept_px"))
