"""Operators on small literal tables, against brute force or known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import (composite, disagg, folds, gapfill, grid, labels, manifest, metrics, mosaic, quality,
                                  ridge, scoring, spatial, tables)
from fieldspark.sources import readers, sinks
from fieldspark.streaming import incremental


# --- metrics ---------------------------------------------------------------------------------------

def test_perfect_prediction(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("pred"), F.col("id").cast("double").alias("target"))
    m = metrics.regression_metrics(df).first()
    assert (m["n"], m["mae"], m["rmse"], m["r2"]) == (11, 0.0, 0.0, 1.0) and math.isclose(m["pearson_r"], 1.0)


def test_mask_excludes_and_undefined_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.0, True), (0.0, 0.0, True), (100.0, 0.0, False)], "pred double, target double, m boolean")
    m = metrics.regression_metrics(df, mask=F.col("m")).first()
    assert (m["n"], m["rmse"]) == (2, 0.0) and m["r2"] is None and m["pearson_r"] is None and m["pct_mae"] is None


def test_bias_sign(spark):
    df = spark.createDataFrame([(5.0, 3.0), (5.0, 3.0)], "pred double, target double")
    assert metrics.regression_metrics(df).first()["bias"] == 2.0


def test_metrics_match_numpy_and_levels_agree(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 400), "h": rng.integers(0, 3, 400), "target": rng.normal(50, 9, 400)})
    pdf["pred"] = pdf.target * .7 + rng.normal(10, 3, 400)
    df = spark.createDataFrame(pdf)
    whole = metrics.regression_metrics(df).first()
    e = pdf.pred - pdf.target
    assert math.isclose(whole["rmse"], math.sqrt((e**2).mean())) and math.isclose(whole["mae"], e.abs().mean())
    assert math.isclose(whole["r2"], 1 - (e**2).sum() / ((pdf.target - pdf.target.mean())**2).sum())
    assert math.isclose(whole["pearson_r"], np.corrcoef(pdf.pred, pdf.target)[0, 1])
    lv = metrics.multi_level(df, {"all": [], "g": ["g"], "gh": ["g", "h"]}).collect()
    by = {(r["level"], r["g"], r["h"]): r for r in lv}
    assert len(by) == 1 + 4 + 12
    for r in metrics.regression_metrics(df, ["g"]).collect():
        for name in metrics.METRICS:
            assert math.isclose(by[("g", r["g"], None)][name], r[name], rel_tol=1e-9)
    assert math.isclose(by[("all", None, None)]["r2"], whole["r2"], rel_tol=1e-9)


def test_bootstrap_interval_holds_the_mean_and_repeats(spark):
    df = spark.range(600).select((F.col("id") % 30).alias("g"), F.col("id").cast("double").alias("target"),
                                 (F.col("id") + F.col("id") % 30).cast("double").alias("pred"))
    a = metrics.bootstrap_ci(df, "g", "mae", 200, 3).first()
    b = metrics.bootstrap_ci(df.repartition(9), "g", "mae", 200, 3).first()
    assert a["n_boot"] == 200 and a["lo"] < 14.5 < a["hi"] and abs(a["mean"] - 14.5) < 1.0
    assert math.isclose(a["mean"], b["mean"]) and a["lo"] == pytest.approx(b["lo"])


def test_field_summary_against_numpy(spark):
    pdf = pd.DataFrame({"pred_mean": [50., 55, 48, 60], "actual_mean": [45., 58, 40, 66]})
    s = metrics.field_summary(spark.createDataFrame(pdf)).first()
    assert math.isclose(s["pearson_r"], np.corrcoef(pdf.pred_mean, pdf.actual_mean)[0, 1])
    assert math.isclose(s["constant_rmse"], pdf.actual_mean.std(ddof=0)) and s["beats_constant"] is True


# --- ridge -----------------------------------------------------------------------------------------

def ridge_numpy(x, y, alpha=1.0):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / np.where(sd == 0, 1, sd)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return w, mu, np.where(sd == 0, 1, sd), y.mean()


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4)) * [1, .2, 3, 10] + [5, 0, 2, 100]
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["year"] = np.repeat(np.arange(2000, 2006), 20)
    pdf["y"] = x @ [1, 2, -1, .1] + rng.normal(size=120)
    return pdf, spark.createDataFrame(pdf)


def test_ridge_equals_direct_solution(training):
    pdf, df = training
    w, mu, sd, b = ridge_numpy(pdf[list("abcd")].values, pdf.y.values)
    got = {r["feature"]: r for r in ridge.fit(df, list("abcd"), "y").collect()}
    for i, f in enumerate("abcd"):
        assert math.isclose(got[f]["ridge_coef_standardized"], w[i], rel_tol=1e-9)
        assert math.isclose(got[f]["x_std"], sd[i], rel_tol=1e-9) and math.isclose(got[f]["ridge_intercept"], b, rel_tol=1e-12)


def test_held_out_scores_equal_refits(training):
    pdf, df = training
    for r in ridge.leave_one_out_scores(df, list("abcd"), "y").collect():
        tr, te = pdf[pdf.year != r["year"]], pdf[pdf.year == r["year"]]
        w, mu, sd, b = ridge_numpy(tr[list("abcd")].values, tr.y.values)
        e = te.y - (b + (te[list("abcd")].values - mu) / sd @ w)
        assert math.isclose(r["mae"], e.abs().mean(), rel_tol=1e-8)
        assert math.isclose(r["r2"], 1 - (e**2).sum() / ((te.y - te.y.mean())**2).sum(), rel_tol=1e-8)


def test_zero_weights_are_refused(spark):
    c = spark.createDataFrame([("a", -1.0), ("b", -2.0)], "feature string, ridge_coef_standardized double")
    got = {r["feature"]: r["gee_weight_normalized"] for r in ridge.normalise_weights(c).collect()}
    assert math.isclose(got["a"], -1 / 3) and math.isclose(got["b"], -2 / 3)
    with pytest.raises(ValueError, match="zero"):
        ridge.normalise_weights(c, nonnegative=True)


# --- disaggregation ----------------------------------------------------------------------------------

def disagg_inputs(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"county_fips": np.where(np.arange(n) < 500, "00001", np.where(np.arange(n) < 895, "00002", "00003")),
                        "row": np.arange(n), "col": 0, "NDVI_mean": rng.random(n), "EVI_mean": rng.random(n) * 3,
                        "crop_mask": rng.random(n) < .8, "valid_vi_mask": rng.random(n) < .7})
    pdf["state"], pdf["year"] = "IA", 2020
    y = spark.createDataFrame([("00001", 2020, 50.0), ("00002", 2020, 61.5), ("00003", 2020, 40.0)], "county_fips string, year int, yield_bu_ac double")
    df = spark.createDataFrame(pdf).withColumn("year", F.col("year").cast("int"))
    return pdf, df, y


def test_county_mean_is_kept_and_small_counties_are_skipped(spark):
    pdf, df, y = disagg_inputs(spark)
    w = {"NDVI_mean": .6, "EVI_mean": .4}
    for fill in (True, False):
        out = disagg.disaggregate(df, y, w, fill_invalid=fill)
        got = {r["county_fips"]: r["m"] for r in out.groupBy("county_fips").agg(F.avg("pseudo_yield").alias("m")).collect()}
        assert set(got) == {"00001", "00002"} and abs(got["00001"] - 50) < 1e-9 and abs(got["00002"] - 61.5) < 1e-9
    wide = disagg.diagnostics(disagg.disaggregate(df, y, w), list(w)).collect()
    assert all(abs(r["mean_difference_from_nass"]) < 1e-9 for r in wide)


def test_disaggregation_matches_numpy(spark):
    pdf, df, y = disagg_inputs(spark)
    out = disagg.disaggregate(df, y, {"NDVI_mean": .6, "EVI_mean": .4}).filter("county_fips = '00001'").toPandas().sort_values("row")
    g = pdf[(pdf.county_fips == "00001") & pdf.crop_mask]
    ok = g.valid_vi_mask
    z = sum(w * (g[f] - g[f][ok].mean()) / g[f][ok].std(ddof=0) for f, w in (("NDVI_mean", .6), ("EVI_mean", .4)))
    raw = np.where(ok, np.clip(1 + .15 * z, .5, 1.5), 1.0)
    assert np.allclose(out.pseudo_yield, 50 * raw / raw.mean())


def test_weight_table_prefers_the_stored_column(spark):
    t = spark.createDataFrame([("a", 2.0, .9), ("b", -2.0, .1)], "feature string, ridge_coef_standardized double, gee_weight_normalized double")
    assert disagg.weights_from_table(t, ["a", "b"]) == {"a": .9, "b": .1}
    assert disagg.weights_from_table(t.drop("gee_weight_normalized"), ["a", "b"]) == {"a": .5, "b": -.5}
    with pytest.raises(ValueError, match="missing"):
        disagg.weights_from_table(t, ["a", "c"])


# --- gaps and mosaics ----------------------------------------------------------------------------------

def fill(spark, series, policy):
    rows = [(0, i + 4, v) for i, v in enumerate(series)]
    df = spark.createDataFrame(rows, "k int, month int, v double")
    return [r["v"] for r in gapfill.fill_months(df, ["k"], "month", "v", range(4, 4 + len(series)), policy).orderBy("month").collect()]


def test_linear_fill_holds_the_ends(spark):
    assert fill(spark, [None, 2.0, None, None, 8.0, None], "linear") == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_nearest_fill_prefers_the_earlier_month(spark):
    assert fill(spark, [None, 1.0, None, 3.0, None, None, 6.0], "nearest") == [1.0, 1.0, 1.0, 3.0, 3.0, 6.0, 6.0]


def test_zero_drop_and_empty_series(spark):
    assert fill(spark, [5.0, None, None], "zero") == [5.0, 0.0, 0.0]
    assert fill(spark, [5.0, None], "drop") == [5.0, None]
    assert fill(spark, [None, None], "linear") == [0.0, 0.0]


def tiles(spark, size, chip, stride, value):
    g = spark.createDataFrame([("r", size, size)], "raster_id string, height int, width int")
    w = grid.tile_windows(g, chip, stride).select("row_off", "col_off")
    axis = F.sequence(F.lit(0), F.lit(chip - 1))
    return w.withColumn("tile_row", F.explode(axis)).withColumn("tile_col", F.explode(axis)) \
        .withColumn("row", F.col("row_off") + F.col("tile_row")).withColumn("col", F.col("col_off") + F.col("tile_col")).withColumn("v", value)


def test_constant_and_gradient_mosaics_are_reconstructed(spark):
    flat = mosaic.blend(tiles(spark, 320, 128, 64, F.lit(7.0)), ["row", "col"], "v", 128)
    s = flat.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("weight").alias("w"), F.count(F.lit(1)).alias("n")).first()
    assert abs(s["lo"] - 7) < 1e-9 and abs(s["hi"] - 7) < 1e-9 and s["w"] > 0 and s["n"] == 320 * 320
    slope = mosaic.blend(tiles(spark, 256, 128, 64, F.col("row") * 0.5 + F.col("col")), ["row", "col"], "v", 128)
    assert slope.agg(F.max(F.abs(F.col("v") - F.col("row") * 0.5 - F.col("col"))).alias("e")).first()["e"] < 1e-6


def test_first_valid_source_wins(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", None), (1, "c", 3.0), (2, "a", None)], "k int, s string, v double")
    assert mosaic.overlap(df, ["k"], "v", "s", "first").collect() == [(1, 2.0, "b")]
    assert mosaic.overlap(df, ["k"], "v", "s", "last").collect() == [(1, 3.0, "c")]
    assert mosaic.overlap(df, ["k"], "v", "s", "sum").first()["v"] == 5.0


def test_composite_counts_and_failure_policies(spark):
    rows = [("s1", 1, 100.0, 0), ("s2", 1, 300.0, 0), ("s2", 2, 500.0, 2), ("s3", 3, -9999.0, 0)]
    df = spark.createDataFrame(rows, "scene_id string, k int, RED double, fmask int")
    comp = composite.monthly_composite(df, ["RED"], ["k"])
    assert comp.collect() == [(1, 200.0, 2)]
    chips = spark.createDataFrame([(1,), (2,), (9,)], "k int")
    got = {r["k"]: (r["RED"], r["OBS_COUNT"]) for r in composite.composite_for_chips(chips, comp, ["k"]).collect()}
    assert got == {1: (200.0, 2), 2: (None, 0), 9: (None, 0)}
    status = spark.createDataFrame([("s1", True), ("s2", False)], "scene_id string, ok boolean")
    failed = composite.failed_chips(df, status, ["k"])
    assert {r["k"] for r in composite.composite_for_chips(chips, comp, ["k"], failed).collect()} == {9}


# --- grids and shapes ---------------------------------------------------------------------------------

def test_tiles_are_whole_and_inside(spark):
    g = spark.createDataFrame([("a", 500, 500), ("b", 500, 460), ("c", 100, 300)], "raster_id string, height int, width int")
    w = grid.tile_windows(g, 224, 224).collect()
    for t in w:
        assert t["row_off"] + t["tile_height"] <= t["height"] and t["col_off"] + t["tile_width"] <= t["width"]
        assert t["raster_id"] == "c" or (t["tile_height"], t["tile_width"]) == (224, 224)
    assert sorted((t["row_off"], t["col_off"]) for t in w if t["raster_id"] == "c") == [(0, 0), (0, 76)]
    assert {(t["row_off"], t["col_off"]) for t in grid.whole_tiles(g, 224).filter("raster_id = 'a'").collect()} == {(0, 0), (0, 224), (224, 0), (224, 224)}


def grids_at(spark, c1, c2, crs2="EPSG:5070"):
    cols = "k int, a double, e double, c double, f double, crs string"
    return (spark.createDataFrame([(1, 30.0, -30.0, c1, 600.0, "EPSG:5070")], cols),
            spark.createDataFrame([(1, 30.0, -30.0, c2, 600.0, crs2)], cols))


def test_offset_grids_meet_on_the_same_ground(spark):
    off = grid.grid_offset(*grids_at(spark, 30.0, 0.0), ["k"])
    assert off.first()[1:] == (0, 1)
    ground = spark.range(40 * 50).select(F.lit(1).alias("k"), F.expr("cast(id div 50 as int)").alias("row"), (F.col("id") % 50).cast("int").alias("col"), F.col("id").alias("g"))
    label = ground.filter("col >= 1").withColumn("col", F.col("col") - 1).withColumnRenamed("g", "lg")
    out = grid.aligned_join(label, ground, off, ["k"])
    assert out.count() == 40 * 49 and out.filter("lg <> g").isEmpty()


def test_fractional_offset_and_other_projection_are_refused(spark):
    with pytest.raises(Exception, match="fractional"):
        grid.grid_offset(*grids_at(spark, 0.0, 15.0), ["k"]).collect()
    with pytest.raises(Exception, match="projection"):
        grid.grid_offset(*grids_at(spark, 0.0, 0.0, "EPSG:4326"), ["k"]).collect()


def square(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


SHAPE = "shape_order int, value double, rings array<array<struct<x:double,y:double>>>"


def test_shared_edge_has_one_owner_and_later_shape_wins(spark):
    s = spark.createDataFrame([(0, 1.0, square(0., 0., 5.5, 10.)), (1, 2.0, square(5.5, 0., 10., 10.)), (2, 3.0, square(2., 2., 4., 4.)), (3, None, square(0., 0., 10., 10.)), (4, 9.0, None)], SHAPE)
    pts = spark.range(100).select((F.col("id") % 10 + 0.5).alias("x"), (F.floor(F.col("id") / 10) + 0.5).alias("y"))
    got = {(r["x"], r["y"]): r["value"] for r in spatial.burn(pts, s, "value", ["x", "y"]).collect()}
    assert len(got) == 100
    for (x, y), v in got.items():
        assert v == (3.0 if 2 < x < 4 and 2 < y < 4 else 1.0 if x < 5.5 else 2.0)


def test_holes_and_concave_shapes(spark):
    ring = [square(0., 0., 10., 10.)[0], square(3., 3., 7., 7.)[0]]
    s = spark.createDataFrame([(0, 1.0, ring)], SHAPE)
    pts = spark.range(100).select((F.col("id") % 10 + 0.5).alias("x"), (F.floor(F.col("id") / 10) + 0.5).alias("y"))
    assert spatial.burn(pts, s, "value", ["x", "y"]).count() == 100 - 16


def test_bilinear_reproduces_a_plane_and_skips_missing(spark):
    src = spark.range(100).select(F.lit(1).alias("g"), F.expr("cast(id div 10 as int)").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    src = src.withColumn("v", F.col("row") * 10.0 + F.col("col"))
    pair = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 4.0, 4.0, 0.0, 0.0)], "g int, t_a double, t_e double, t_c double, t_f double, s_a double, s_e double, s_c double, s_f double")
    t = spark.range(28 * 28).select(F.lit(1).alias("g"), F.expr("cast(id div 28 as int) + 6").alias("row"), (F.col("id") % 28 + 6).cast("int").alias("col"))
    out = grid.regrid_bilinear(t, src, pair, ["g"], "v")
    want = ((F.col("row") + 0.5) / 4 - 0.5) * 10 + (F.col("col") + 0.5) / 4 - 0.5
    assert out.agg(F.max(F.abs(F.col("v") - want)).alias("e")).first()["e"] < 1e-9
    gaps = src.withColumn("v", F.when(F.col("col") != 5, F.lit(2.0)))
    assert {r["v"] for r in grid.regrid_bilinear(t, gaps, pair, ["g"], "v").select(F.round("v", 9).alias("v")).distinct().collect()} <= {2.0, None}


def test_clamped_chip_never_qualifies(spark):
    g = spark.createDataFrame([("IA", 2020, 10, 10)], "state string, year int, height int, width int")
    px = spark.range(100).select(F.lit("IA").alias("state"), F.lit(2020).alias("year"), F.expr("cast(id div 10 as int)").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.lit(True).alias("crop_mask"))
    good = manifest.qualifying_chips(px, g, ["state", "year"], 4, 0.05)
    man = grid.tile_windows(g, 4, 4)
    kept = {(r["row_off"], r["col_off"]) for r in manifest.semi_join_chips(man, good).collect()}
    assert kept == {(0, 0), (0, 4), (4, 0), (4, 4)} and man.count() == 9


def test_counties_kept_for_external_testing_are_dropped(spark):
    df = spark.createDataFrame([("24033",), ("24031",), ("24033.0",)], "geoid string")
    assert [r[0] for r in tables.exclude_geoids(df).collect()] == ["24031"]


def test_exclusion_and_its_report(spark):
    df = spark.createDataFrame([(c,) for c in "abcd"], "sample_id string")
    ids = spark.createDataFrame([(c,) for c in "bdz"], "sample_id string")
    assert sorted(r[0] for r in tables.exclude(df, ids, "sample_id").collect()) == ["a", "c"]
    assert {r[0]: r[1] for r in tables.exclusion_report(df, ids, "sample_id").collect()} == {"b": 1, "d": 1, "z": 0}


# --- folds ---------------------------------------------------------------------------------------------

def years(spark, lo=2018, hi=2022):
    return spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))


def test_fold_policies(spark):
    prev = {r["test_year"]: r for r in folds.make_folds(years(spark), "previous_year", on_error="keep").collect()}
    assert prev[2020]["val_years"] == [2019] and prev[2020]["train_years"] == [2018, 2021, 2022] and prev[2018]["error"]
    pool = {r["test_year"]: r["val_years"] for r in folds.make_folds(years(spark), "fixed_pool", pool=[2019, 2020]).collect()}
    assert pool[2019] == [2020] and pool[2018] == [2019, 2020]
    with pytest.raises(Exception, match="no validation years"):
        folds.make_folds(years(spark), "previous_year").collect()
    with pytest.raises(Exception, match="no training years"):
        folds.make_folds(years(spark, 2018, 2019), "fixed_pool", pool=[2018, 2019]).collect()


def test_overlapping_folds_raise(spark):
    bad = spark.createDataFrame([(2020, [2020], [2018])], "test_year int, val_years array<int>, train_years array<int>")
    with pytest.raises(Exception, match="overlap"):
        folds.assert_disjoint(bad).collect()


def test_audit_hit_and_clean(spark):
    fold = spark.createDataFrame([(2018, "test"), (2019, "val"), (2020, "train")], "year int, split string")
    cols = "sample_id string, state string, year int, row_off int, col_off int, split string"
    clean = spark.createDataFrame([("a", "IA", 2018, 0, 0, "test"), ("b", "IA", 2020, 0, 0, None), ("c", "IA", 1990, 0, 0, "train")], cols)
    assert folds.leakage_audit(clean, fold).isEmpty()
    bad = spark.createDataFrame([("a", "IA", 2018, 0, 0, "train"), ("a", "IA", 2020, 0, 0, "train")], cols)
    assert {r["issue"] for r in folds.leakage_audit(bad, fold).collect()} == {"declared_split", "duplicate_id"}


def test_stored_statistics_are_guarded(spark):
    f = spark.createDataFrame([(2020, [2018, 2019])], "test_year int, train_years array<int>")
    cols = "test_year int, train_years array<int>, mode string"
    assert folds.reuse_statistics(f, spark.createDataFrame([(2020, [2019, 2018], "fold")], cols), "fold").count() == 1
    for stored in ((2020, [2018, 2020], "fold"), (2020, [2018, 2019], "official"), (2021, [2018, 2019], "fold")):
        with pytest.raises(Exception, match="stored|training years|other mode"):
            folds.reuse_statistics(f, spark.createDataFrame([stored], cols), "fold").collect()


# --- scoring, integrity, labels --------------------------------------------------------------------------

def test_flips_move_everything_together(spark):
    px = spark.range(2 * 16).select((F.col("id") % 2).cast("string").alias("sample_id"), F.expr("cast(id div 8 as int)").alias("row"), (F.floor(F.col("id") / 2) % 4).cast("int").alias("col"), F.col("id").cast("double").alias("b"), F.col("id").alias("label"))
    out = scoring.augment(px, "sample_id", 4, 4, 3, ["b"], hflip_p=1.0, vflip_p=0.0)
    j = out.join(px.select("label", F.col("row").alias("r"), F.col("col").alias("c")), "label")
    assert j.filter("row <> r or col <> 3 - c or b <> label").isEmpty()
    noisy = scoring.augment(px, "sample_id", 4, 4, 3, ["b"], 0.0, 0.0, noise_p=1.0, noise_std=0.1)
    s = noisy.agg(F.stddev_pop(F.col("b") - F.col("label")).alias("sd"), F.max(F.abs(F.col("b") - F.col("label"))).alias("m")).first()
    assert 0.05 < s["sd"] < 0.2 and s["m"] < 0.6


def test_predictor_runs_on_batches(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, v array<double>")
    out = scoring.score_chips(df, "v", lambda x: x * 2, ["id"]).collect()
    assert all(r["prediction"] == [2.0 * r["id"], 2.0] for r in out) and len(out) == 20


def test_occlusion_uses_the_unmasked_mean_without_a_mask(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>")
    out = {r["slice"]: r["delta"] for r in scoring.occlusion(df, "v", 2, lambda v: v[0] + 10 * v[1], F.lit(False)).collect()}
    assert out == {0: 2.0, 1: 30.0}


def test_stored_chips_are_decoded(spark, tmp_path):
    good, nan = np.ones(16, "<f4"), np.ones(16, "<f4")
    nan[3] = np.nan
    for name, data in (("a.bin", good.tobytes()), ("b.bin", nan.tobytes()), ("c.bin", b"123")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-5]: r["status"] for r in readers.read_chip_files(spark, str(tmp_path), 16).collect()}
    assert got == {"a": "ok", "b": "non_finite", "c": "bad_size"}


def test_label_surfaces_stay_inside_and_blend(spark):
    s = spark.createDataFrame([(0, 10.0, square(0., 0., 32., 64.)), (1, 20.0, square(32., 0., 64., 64.))], SHAPE)
    px = spark.range(70 * 70).select(F.expr("cast(id div 70 as int)").alias("row"), (F.col("id") % 70).cast("int").alias("col"))
    out = labels.label_surfaces(px, s, s, "value", {"a": 1.0, "e": 1.0, "c": 0.0, "f": 0.0, "height": 64, "width": 64}, coarse_res=8).toPandas()
    assert len(out) == 64 * 64 and set(out.nearest) == {10.0, 20.0}
    assert out.bilinear.between(10, 20).all() and out[(out.col > 29) & (out.col < 34)].bilinear.between(10.01, 19.99).all()


def test_quality_profile_of_an_empty_raster(spark):
    g = spark.createDataFrame([("a", 2, 2, 30.0, "EPSG:5070"), ("b", 2, 2, 10.0, "EPSG:4326")], "raster_id string, height int, width int, a double, crs string")
    px = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "raster_id string, value double")
    p = quality.label_profile(px, g)
    got = {r["raster_id"]: r for r in p.collect()}
    assert got["a"]["median"] == 2.0 and got["a"]["pct_valid"] == 50.0 and got["b"]["valid_px"] == 0 and got["b"]["mean"] is None
    assert {(r["raster_id"], r["reason"]) for r in quality.quality_flags(p).collect()} == {("b", x) for x in ("low_valid", "empty", "crs", "resolution")}


# --- sinks and incremental jobs ---------------------------------------------------------------------------

def test_fingerprint_is_stable_under_key_order():
    assert sinks.fingerprint({"b": 1, "a": [1, 2]}) == sinks.fingerprint({"a": [1, 2], "b": 1}) != sinks.fingerprint({"a": [2, 1], "b": 1})
    assert len(sinks.fingerprint({})) == 16


def test_ledger_refuses_other_settings(spark, tmp_path):
    path = str(tmp_path / "ledger")
    units = spark.range(10).withColumnRenamed("id", "unit")
    incremental.record_done(units.filter("unit < 4"), path, "s1", "b1")
    incremental.record_done(units.filter("unit < 4"), path, "s1", "b1")
    ledger = spark.read.parquet(path)
    assert ledger.count() == 4 and incremental.remaining_work(units, ledger, ["unit"], "s1").count() == 6
    with pytest.raises(ValueError, match="other settings"):
        incremental.remaining_work(units, ledger, ["unit"], "s2")


def test_composite_from_several_batches_equals_one_pass(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("double").alias("v"))
    df.repartition(6).write.parquet(src)
    stream = incremental.stream_table(spark, src, df.schema, files_per_batch=2)
    out = str(tmp_path / "out")
    incremental.update_composite(stream, ["k"], ["v"], out)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    got = {r["k"]: (r["v"], r["OBS_COUNT"]) for r in incremental.read_composite(spark, out, ["k"], ["v"]).collect()}
    want = {r["k"]: (r["v"], r["n"]) for r in df.groupBy("k").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).collect()}
    assert all(math.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_composite_goes_on_after_a_restart(spark, tmp_path):
    """A later call, with a fresh query and another batch size, adds only new files."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def deliver(value):
        spark.createDataFrame([("a", value)], "k string, v double").coalesce(1).write.mode("append").parquet(src)

    def run(files):
        stream = incremental.stream_table(spark, src, spark.read.parquet(src).schema, files_per_batch=files)
        incremental.update_composite(stream, ["k"], ["v"], out)
        row = incremental.read_composite(spark, out, ["k"], ["v"]).first()
        return row["v"], row["OBS_COUNT"]
    deliver(1.0)
    assert run(1) == (1.0, 1)
    deliver(3.0)
    assert run(5) == (2.0, 2) and run(1) == (2.0, 2)


def test_scenes_are_kept_whatever_their_age(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, ts timestamp"

    def deliver(*rows):
        spark.createDataFrame(rows, "id string, ts string").select("id", F.col("ts").cast("timestamp")) \
            .coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = incremental.stream_table(spark, src, spark.createDataFrame([], schema).schema, files_per_batch=1)
        return sorted(r["id"] for r in incremental.intake_scenes(stream, out).collect())
    deliver(("c", "2024-06-01"))
    deliver(("a", "2020-01-01"))
    deliver(("b", "2022-01-01"), ("c", "2024-06-01"))
    assert run() == ["a", "b", "c"]
    deliver(("d", "2019-01-01"), ("a", "2020-01-01"))
    assert run() == ["a", "b", "c", "d"]


def test_running_statistics_go_on_after_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for values, want in (([1.0, 2.0], (2, 1.5)), ([6.0], (3, 3.0)), ([], (3, 3.0))):
        if values:
            spark.createDataFrame([("x", v) for v in values], "k string, v double").coalesce(1).write.mode("append").parquet(src)
        stream = incremental.stream_table(spark, src, spark.read.parquet(src).schema)
        row = incremental.running_band_statistics(stream, ["k"], "v", out).first()
        assert (row["n"], row["mean"]) == want


def test_flat_and_far_targets_have_no_r2_at_any_level(spark):
    for value in (0.1, 1e9 + 0.1):
        df = spark.range(210).select((F.col("id") % 7).alias("g"), F.lit(value).alias("target"), (F.sin("id") + value).alias("pred"))
        rows = metrics.multi_level(df, {"all": [], "g": ["g"]}).collect()
        assert len(rows) == 8 and all(r["r2"] is None and r["pearson_r"] is None for r in rows)
    far = spark.range(210).select((F.col("id") % 7).alias("g"), (F.sin("id") + 1e8).alias("target"), (F.sin("id") * .5 + 1e8).alias("pred"))
    row = metrics.multi_level(far, {"all": []}).first()
    assert math.isclose(row["pearson_r"], 1.0, rel_tol=1e-6) and math.isclose(row["r2"], metrics.regression_metrics(far).first()["r2"], rel_tol=1e-5)


def test_incomplete_rows_do_not_count_in_a_fit(spark):
    rows = [(float(i), i * 2.0 + (i % 3), 2000 + i % 4) for i in range(12)]
    gaps = [(None, 5.0, 2000), (3.0, None, 2001), (float("nan"), 1.0, 2002), (1.0, float("inf"), 2003)]
    a = spark.createDataFrame(rows, "x double, y double, year int")
    b = spark.createDataFrame(rows + gaps, "x double, y double, year int")
    want, got = ridge.fit(a, ["x"], "y").first(), ridge.fit(b, ["x"], "y").first()
    assert got["n_rows"] == 12 and math.isclose(got["ridge_coef_standardized"], want["ridge_coef_standardized"])
    assert sorted(ridge.leave_one_out_scores(b, ["x"], "y").collect()) == sorted(ridge.leave_one_out_scores(a, ["x"], "y").collect())


def test_non_finite_scene_pixels_do_not_count(spark):
    rows = [("s", 1, 1, 0, 0, 10.0), ("s", 1, 1, 0, 0, float("nan")), ("s", 1, 1, 0, 0, float("inf")), ("s", 1, 1, 0, 0, None)]
    df = spark.createDataFrame(rows, "state string, year int, month int, row int, col int, b double").withColumn("fmask", F.lit(0))
    got = composite.monthly_composite(df, ["b"]).first()
    assert (got["b"], got["OBS_COUNT"]) == (10.0, 1)


def test_composites_keep_to_their_month_window(spark):
    rows = [(2020, 11, "2020-11-15", 1.0), (2020, 11, "2020-11-16", 9.0), (2020, 6, "2020-06-30", 2.0), (2020, 6, "2020-07-01", 9.0)]
    df = spark.createDataFrame(rows, "year int, month int, day string, b double").withColumns(
        {"state": F.lit("s"), "row": F.lit(0), "col": F.lit(0), "fmask": F.lit(0)})
    got = {r["month"]: (r["b"], r["OBS_COUNT"]) for r in composite.monthly_composite(df, ["b"], day="day").collect()}
    assert got == {11: (1.0, 1), 6: (2.0, 1)}


def test_summaries_with_other_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("county_fips,year,NDVI_mean\n1001.0,2020,0.5\n1002,2020,bad\n")
    (tmp_path / "y.csv").write_text("year,county_fips,EVI_mean\n2021,1003,0.25\n")
    (tmp_path / "z.csv").write_text("")
    got = {r["county_fips"]: (r["year"], r["NDVI_mean"], r["EVI_mean"], r["source_file"]) for r in readers.read_vi_summaries(spark, str(tmp_path)).collect()}
    assert got == {"01001": (2020, .5, None, "x.csv"), "01002": (2020, None, None, "x.csv"), "01003": (2021, None, .25, "y.csv")}


def test_compaction_keeps_the_composite_and_bounds_the_folders(spark, tmp_path):
    from fieldspark.streaming import commits
    src, out = str(tmp_path / "in"), str(tmp_path / "sums")
    df = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").cast("double").alias("v"))
    for part in range(4):
        df.filter(F.col("id") % 4 == part).coalesce(1).write.mode("append").parquet(src)
        incremental.update_composite(incremental.stream_table(spark, src, df.schema, files_per_batch=1), ["k"], ["v"], out, compact_every=2)
        assert len(commits.live(commits.history(spark, out))) <= 2
    got = {r["k"]: (r["v"], r["OBS_COUNT"]) for r in incremental.read_composite(spark, out, ["k"], ["v"]).collect()}
    assert got == {k: (18.0 + k, 10) for k in range(4)}
    assert commits.expire(spark, out) > 0
    assert {r["k"]: r["OBS_COUNT"] for r in incremental.read_composite(spark, out, ["k"], ["v"]).collect()} == {k: 10 for k in range(4)}


def test_statistics_of_the_last_checkpoint_answer(spark, tmp_path):
    out = str(tmp_path / "stats")
    for name, values in (("a", (0.0, 1.0, 2.0)), ("b", (9.0,))):
        src = str(tmp_path / name)
        for v in values:
            spark.createDataFrame([("x", v)], "band string, v double").coalesce(1).write.mode("append").parquet(src)
        stream = incremental.stream_table(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
        got = incremental.running_band_statistics(stream, ["band"], "v", out, checkpoint=str(tmp_path / f"{name}-state")).collect()
    assert [(r["n"], r["mean"]) for r in got] == [(1, 9.0)]


def test_block_files_tell_missing_cut_and_changed_files(spark, tmp_path):
    from fieldspark.operators import quality as q
    from fieldspark.sources import blocks
    root = str(tmp_path / "img")
    px = spark.range(4 * 900).selectExpr("concat('m/t', id div 900, '.fsb') AS file", "(id % 900) div 30 AS row", "id % 30 AS col", "cast(id AS double) AS v")
    grids = px.select("file").distinct().selectExpr("file", "30L AS height", "30L AS width", "'EPSG:5070' AS crs", "30.0D AS res", "-9999.0D AS nodata")
    assert sorted(r["blocks"] for r in blocks.write_blocks(px, grids, root, ["v"], 16).collect()) == [4] * 4
    data = (tmp_path / "img/m/t1.fsb").read_bytes()
    (tmp_path / "img/m/t1.fsb").write_bytes(data[:len(data) // 2])
    spot = bytearray((tmp_path / "img/m/t2.fsb").read_bytes())
    spot[10] ^= 255  # in the first block
    (tmp_path / "img/m/t2.fsb").write_bytes(bytes(spot))
    plan = spark.range(5 * 4).selectExpr("concat('m/t', id div 4, '.fsb') AS file", "id AS sample_id", "(id % 4) div 2 * 16 AS row_off", "id % 2 * 16 AS col_off", "16L AS size")
    reads = blocks.read_windows(plan, root, values=True).collect()
    status = {(r["file"], r["row_off"], r["col_off"]): r["status"] for r in reads}
    assert len(reads) == 20
    for (file, row, col), s in status.items():
        assert s == {"m/t1.fsb": "unreadable", "m/t4.fsb": "missing"}.get(file, "corrupt" if file == "m/t2.fsb" and row == col == 0 else "ok")
    edge = next(r for r in reads if r["file"] == "m/t0.fsb" and r["row_off"] == 16 and r["col_off"] == 16)
    assert edge["finite_share"] == 14 * 14 / 256 and edge["values"][0] == 16 * 30 + 16
    report = {r["file"]: (r["state"], r["window_reads"], r["bad_reads"], r["affected_chips"]) for r in q.planned_report(blocks.read_windows(plan, root)).collect()}
    assert report["m/t2.fsb"] == ("corrupt", 4, 1, 1) and report["m/t4.fsb"] == ("missing", 4, 0, 0) and report["m/t0.fsb"][0] == "ok"
    meta = {r["file"]: (r["height"], r["bands"], r["crs"], r["error"]) for r in blocks.raster_metadata(spark, root).collect()}
    assert meta["m/t0.fsb"] == (30, 1, "EPSG:5070", None) and meta["m/t1.fsb"][3] is not None


def test_merge_inputs_must_agree(spark):
    schema = "file string, crs string, bands int, dtype string, res double, nodata double, band_names array<string>"
    same = ("EPSG:5070", 1, "float32", 30.0, -9999.0, ["y"])
    near = spark.createDataFrame([("a", *same), ("b", *same[:3], 30.00001, None, ["z"])], schema)
    assert sorted(r["property"] for r in mosaic.require_compatible(near).collect()) == ["band_names", "nodata"]
    with pytest.raises(ValueError, match="b: crs"):
        mosaic.require_compatible(spark.createDataFrame([("a", *same), ("b", "EPSG:4326", *same[1:])], schema))
    assert mosaic.input_mismatches(near.limit(0)).count() == 0


def test_csv_files_are_read_once_and_keep_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('yields 2020\nGEOID,Year,yield_bu_ac,County_Name\n19001,2020,50.5,"Adair,\nsouth"\n,,,\nGEOID,Year,yield_bu_ac,County_Name\n19001,2020,1,late\n')
    (tmp_path / "b.csv").write_text('county_name,"yield_bu_ac",year,geoid,extra\n"say ""x""",7,2021,17003,9\n,(D),2021,17005,9\n')
    (tmp_path / "c.csv").write_text("no header here\n1,2,3\n")
    df = readers.read_county_yield(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["geoid"], r["year"]): (r["county_name"], r["yield_bu_ac"]) for r in df.collect()}
    assert got == {("19001", 2020): ("Adair,\nsouth", 50.5), ("17003", 2021): ('say "x"', 7.0)}


def test_boxes_of_all_sizes_meet(spark):
    rng = np.random.default_rng(3)
    box = "xmin double, ymin double, xmax double, ymax double"
    counties = [(f"c{i}{j}", 10.0 * i, 10.0 * j, 10.0 * i + 10, 10.0 * j + 10) for i in range(8) for j in range(8)]
    scenes = [("all", -500.0, -500.0, 500.0, 500.0), ("none", None, None, None, None), ("point", 20.0, 20.0, 20.0, 20.0)]
    scenes += [(f"s{k}", x, y, x + w, y + w) for k, (x, y, w) in enumerate(zip(rng.uniform(-20, 90, 40), rng.uniform(-20, 90, 40), 3.0 ** rng.uniform(-2, 4, 40)))]
    scenes = [tuple(float(v) if isinstance(v, (float, np.floating)) else v for v in s) for s in scenes]
    out = spatial.bbox_overlaps(spark.createDataFrame(scenes, f"scene_id string, {box}"), spark.createDataFrame(counties, f"geoid string, {box}"), 1.0)
    got = [(r["scene_id"], r["geoid"]) for r in out.collect()]
    want = [(s[0], c[0]) for s in scenes for c in counties
            if s[1] is None or (s[3] >= c[1] and s[1] <= c[3] and s[4] >= c[2] and s[2] <= c[4])]
    assert sorted(got) == sorted(want)


def test_full_cells_are_dealt_to_several_tasks(spark):
    box = "xmin double, ymin double, xmax double, ymax double"
    scenes = [(f"s{i}", *((None,) * 4 if i % 3 == 0 else (i % 5, i % 4, i % 5 + 2.0, i % 4 + 1.0))) for i in range(60)]
    counties = [(f"c{i}", float(i % 7), float(i % 5), i % 7 + 1.0, i % 5 + 1.5) for i in range(40)]
    scenes = [(s, *[v if v is None else float(v) for v in b]) for s, *b in scenes]
    want = sorted((s, c) for s, a, b, x, y in scenes for c, p, q, u, v in counties
                  if a is None or (x >= p and a <= u and y >= q and b <= v))
    frames = spark.createDataFrame(scenes, f"scene_id string, {box}"), spark.createDataFrame(counties, f"geoid string, {box}")
    for share in (7, 100, 1 << 26):
        out = spatial.bbox_overlaps(*frames, 1.0, share=share)
        assert sorted(map(tuple, out.collect())) == want


def test_repeated_boxes_meet_as_lists(spark):
    box = "xmin double, ymin double, xmax double, ymax double"
    here, there, gone = (0.0, 0.0, 2.0, 2.0), (50.0, 50.0, 51.0, 51.0), (None,) * 4
    scenes = [(i // 2, *(gone if i % 10 == 0 else there if i % 10 == 1 else here)) for i in range(600)]
    counties = [(f"c{i // 2}", *(there if i % 8 == 0 else here)) for i in range(600)]
    # as in the SQL, only a missing xmin means no box, and counties without a key or box meet boxless scenes
    scenes += [(1000, None, 0.0, 2.0, 2.0), (1001, 0.0, None, 2.0, 2.0)]
    counties += [("none", *gone), ("none", *gone), (None, *here)]
    want = sorted((s[0], c[0] or "") for s in scenes for c in counties if s[1] is None or (
        None not in s and c[1] is not None and s[3] >= c[1] and s[1] <= c[3] and s[4] >= c[2] and s[2] <= c[4]))
    frames = spark.createDataFrame(scenes, f"scene_id long, {box}"), spark.createDataFrame(counties, f"geoid string, {box}")
    for share in (1000, 1 << 24):
        lists = [(r["scene_ids"], r["geoids"]) for r in spatial.overlapping_lists(*frames, 1.0, share).collect()]
        assert sum(len(s) * len(c) for s, c in lists) == len(want) and len(lists) < len(want) / 1000
        assert max(len(s) for s, _ in lists) <= 64 and max(len(c) for _, c in lists) <= 256
        out = spatial.bbox_overlaps(*frames, 1.0, share)
        assert sorted((r["scene_id"], r["geoid"] or "") for r in out.collect()) == want


def test_lists_of_a_frequent_key_are_dealt_and_bounded(spark):
    rows = [("a" if i % 3 else None, i % 700 if i % 5 else None) for i in range(3000)]
    out = spatial.in_lists(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", 16, deal=100).collect()
    got = sorted((r["k"] or "", -1 if v is None else v) for r in out for v in r["vs"])
    assert got == sorted((k or "", -1 if v is None else v) for k, v in rows)
    assert max(len(r["vs"]) for r in out) <= 16
