"""Yield label surfaces: one value per county, and a smooth variant blended across borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import materialise
from .grid import regrid_bilinear
from .spatial import burn

COARSE_RES_M = 10_000


def with_centres(pixels: DataFrame, grid: dict[str, float]) -> DataFrame:
    """Pixel centre x, y on affine (a, e, c, f)."""
    return pixels.withColumn("x", F.lit(grid["c"]) + F.lit(grid["a"]) * (F.col("col") + 0.5)) \
                 .withColumn("y", F.lit(grid["f"]) + F.lit(grid["e"]) * (F.col("row") + 0.5))


def coarse_grid(grid: dict[str, float], coarse_res: float) -> dict[str, float]:
    """Coarse grid over the same bounds, roughly ``coarse_res`` wide."""
    factor = max(1, int(coarse_res // abs(grid["a"])))
    h, w = max(1, int(grid["height"]) // factor), max(1, int(grid["width"]) // factor)
    return {"height": h, "width": w, "c": grid["c"], "f": grid["f"],
            "a": grid["a"] * grid["width"] / w, "e": grid["e"] * grid["height"] / h}


def label_surfaces(crop_pixels: DataFrame, with_yield: DataFrame, all_shapes: DataFrame, value: str,
                   grid: dict[str, float], coarse_res: float = COARSE_RES_M) -> DataFrame:
    """Nearest and bilinear labels of the crop pixels (row, col) inside the region outline.

    The outline comes from all shapes, not only those with a yield. Pixels outside it get
    no label in either variant.
    """
    spark = crop_pixels.sparkSession
    pts = with_centres(crop_pixels.select("row", "col").distinct(), grid)
    outline = burn(pts, all_shapes.withColumn("_in", F.lit(1)), "_in", ["row", "col"])
    nearest = burn(pts, with_yield, value, ["row", "col"]).withColumnRenamed(value, "nearest")

    low = coarse_grid(grid, coarse_res)
    n = int(low["height"] * low["width"])
    squares = spark.range(n).select(F.expr(f"cast(id div {int(low['width'])} as int)").alias("row"),
                                    (F.col("id") % int(low["width"])).cast("int").alias("col"))
    blocks = burn(with_centres(squares, low), with_yield, value, ["row", "col"])
    pair = {f"t_{k}": float(grid[k]) for k in "aecf"} | {f"s_{k}": float(low[k]) for k in "aecf"}
    grids = spark.range(1).select(F.lit(1).alias("_g"), *[F.lit(v).alias(k) for k, v in pair.items()])
    smooth = regrid_bilinear(outline.select(F.lit(1).alias("_g"), "row", "col"),
                             materialise(blocks.withColumn("_g", F.lit(1)), "coarse_labels"),
                             grids, ["_g"], value).drop("_g").withColumnRenamed(value, "bilinear")
    return outline.select("row", "col").join(nearest, ["row", "col"], "left").join(smooth, ["row", "col"], "left")
