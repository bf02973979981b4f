"""The physical plans that matter at scale: pruned scans, pushed filters, no pixel shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import spectral
from fieldspark.operators import disagg, folds, gapfill, metrics, spatial
from fieldspark.plans import first_by, materialise

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pixels(spark):
    from checks import fixtures as fx
    return materialise(fx.vi_pixel(spark, SF), "vi_pixel")


def test_disaggregation_shuffles_no_pixels(spark, pixels):
    from checks import fixtures as fx
    y = materialise(fx.county_yield(spark, SF), "yield")
    text = plan(disagg.disaggregate(pixels, y, {"NDVI_mean": .5, "EVI_mean": .5}))
    assert "hashpartitioning" not in text and "SortMergeJoin" not in text and "Window" not in text
    assert "GCVI_mean#" not in plan(disagg.disaggregate(pixels, y, {"NDVI_mean": 1.0}).select("row", "col", "pseudo_yield"))


def test_index_columns_read_only_their_bands_inside_codegen(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    c = F.col
    vi = spectral.vegetation_indices(c("l_tax"), c("l_discount"), c("l_quantity"), c("l_extendedprice"), c("l_tax"), F.lit(True))
    text = plan(df.filter(c("l_quantity") < 10).select(vi["NDVI"].alias("v")))
    assert "ReadSchema: struct<" in text and "l_shipdate" not in text and "l_partkey" not in text
    assert "PushedFilters: [" in text and "LessThan(l_quantity,10.0)" in text


@pytest.mark.parametrize("build", [
    lambda p: metrics.regression_metrics(p, ["county_fips"], "EVI_mean", "NDWI_mean"),
    lambda p: folds.band_statistics(p, ["county_fips"], ["EVI_mean", "NDWI_mean"]),
    lambda p: disagg.zscore_parameters(p),
    lambda p: gapfill.wide_series(p, ["row", "col"], "month", "EVI_mean", range(4, 12)),
    lambda p: first_by(p.select("row", "col", "year", "EVI_mean"), ["row", "col"], ["year"]),
])
def test_groups_are_reduced_before_the_shuffle(pixels, build):
    text = plan(build(pixels))
    assert text.count("partial_") >= 1 and "Window" not in text


def test_burn_is_a_hash_aggregate_behind_a_broadcast(spark, pixels):
    from checks import fixtures as fx
    pts = pixels.select("row", "col").distinct().withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)
    text = plan(spatial.burn(pts, fx.shapes(spark, SF), "shape_order", ["row", "col"]))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SortAggregate" not in text


def test_no_query_uses_a_cross_product(spark):
    from checks import CHECKS
    for name in ("J03_point_in_polygon_burn", "J04_scene_chips", "J05_bbox_overlaps", "T05_split_by_county", "A17_leave_one_year_out", "L05_fold_statistics"):
        text = plan(CHECKS[name].run(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_region_clip_lists_no_positions(spark, pixels):
    from checks import fixtures as fx
    text = plan(spatial.clip_to_region(pixels, fx.shapes(spark, SF), F.col("col") + 0.5, F.col("row") + 0.5))
    assert "BroadcastHashJoin" in text and ("ExistenceJoin" in text or "LeftSemi" in text)
    assert "HashAggregate" not in text and "hashpartitioning" not in text and "NestedLoop" not in text


def test_first_and_last_source_are_hash_aggregates(pixels):
    from fieldspark.operators import mosaic
    tiles = pixels.select("row", "col", F.concat(F.lit("s"), F.col("month").cast("string")).alias("source"), F.col("EVI_mean").alias("v"))
    for method in ("first", "last"):
        text = plan(mosaic.overlap(tiles, ["row", "col"], "v", "source", method))
        assert "SortAggregate" not in text and "HashAggregate" in text


def test_bilinear_moves_pixels_once(spark):
    from fieldspark.operators import grid
    src = spark.range(100).selectExpr("1 AS g", "cast(id div 10 as int) AS row", "cast(id % 10 as int) AS col", "1.0D AS v")
    pair = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 4.0, 4.0, 0.0, 0.0)],
                                 "g int, t_a double, t_e double, t_c double, t_f double, s_a double, s_e double, s_c double, s_f double")
    text = plan(grid.regrid_bilinear(src.select("g", "row", "col"), src, pair, ["g"], "v"))
    assert text.count("hashpartitioning") == 2 and "CoGroup" in text


def test_bootstrap_sends_sums_only(pixels):
    df = pixels.select("county_fips", F.col("EVI_mean").alias("pred"), F.col("NDWI_mean").alias("target"))
    text = plan(metrics.bootstrap_ci(df, "county_fips", n_boot=20))
    assert "Join" not in text and "partial_sum" in text
