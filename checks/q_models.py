"""Ridge weights, metrics, folds, scoring and integrity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fieldspark.functions import targets
from fieldspark.functions.geo import chip_of
from fieldspark.operators import folds, metrics, quality, ridge, scoring
from fieldspark.plans import materialise

from . import fixtures as fx
from .fixtures import with_
from .registry import R, check, r, rounded

# --- ridge ---------------------------------------------------------------------------------------

F2 = ["NDVI_mean", "EVI_mean"]
_ROWS = """FROM county_vi v JOIN county_yield y ON y.county_fips = v.county_fips AND y.year = v.year
 WHERE CAST(v.county_fips AS INTEGER) * 3 % 7 <> v.year % 7 AND CAST(v.county_fips AS INTEGER) % 5 <> v.year % 5"""
_TRAIN = f"SELECT v.county_fips, v.year, v.NDVI_mean AS x1, v.EVI_mean AS x2, y.yield_bu_ac AS y {_ROWS}"
_STAT = """count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2"""
_SOLVE = """SELECT *, (n * c1 / s1 * (n + 1) - n * c12 / (s1 * s2) * (n * c2 / s2)) / ((n + 1) * (n + 1) - (n * c12 / (s1 * s2)) ** 2) AS w1,
 (n * c2 / s2 * (n + 1) - n * c12 / (s1 * s2) * (n * c1 / s1)) / ((n + 1) * (n + 1) - (n * c12 / (s1 * s2)) ** 2) AS w2 FROM st"""
_WITH_FIT = with_("county_vi", "county_yield", tr=_TRAIN, st=f"SELECT {_STAT} FROM tr", fit=_SOLVE)
_COEF = "SELECT 'NDVI_mean' AS feature, w1 AS w, m1 AS m, s1 AS s, my, n FROM fit UNION ALL SELECT 'EVI_mean', w2, m2, s2, my, n FROM fit"
_PRED = "my + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2"


def _training(spark, d):
    """County-years with gaps: some yields are NULL and some indices NaN; only complete rows may count."""
    t = fx.county_vi(spark, d).drop("state").join(fx.county_yield(spark, d), ["county_fips", "year"])
    county, year = F.col("county_fips").cast("int"), F.col("year")
    return materialise(t.withColumns({
        "yield_bu_ac": F.when(county * 3 % 7 != year % 7, F.col("yield_bu_ac")),
        "NDVI_mean": F.when(county % 5 == year % 5, F.lit(float("nan"))).otherwise(F.col("NDVI_mean"))}), "training")


@check("A14_ridge_fit", _WITH_FIT + f"""SELECT feature, {R('w')} AS ridge_coef_standardized, {R('m')} AS x_mean, {R('s')} AS x_std, {R('my')} AS ridge_intercept, CAST(n AS DOUBLE) AS n_rows FROM ({_COEF})""")
def a14(spark, d):
    return rounded(ridge.fit(_training(spark, d), F2, "yield_bu_ac"), "ridge_coef_standardized", "x_mean", "x_std", "ridge_intercept")


F4 = ["NDVI_mean", "EVI_mean", "GCVI_mean", "NDWI_mean"]


def _sql_four() -> str:
    """Four elimination steps on the standardised normal equations, one CTE each."""
    n4 = range(1, 5)
    st = "SELECT count(*) AS n, avg(y) AS my, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in n4) + ", " + ", ".join(
        f"count(*) * covar_pop(x{i}, x{j}) / (stddev_pop(x{i}) * stddev_pop(x{j}))" + (" + 1" if i == j else "") + f" AS a{i}{j}" for i in n4 for j in n4) + ", " + ", ".join(
        f"count(*) * covar_pop(x{i}, y) / stddev_pop(x{i}) AS a{i}5" for i in n4) + " FROM tr4"
    steps = {"e0": st}
    for k in n4:
        cells = [f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" if i != k else f"a{k}{j} / a{k}{k} AS a{k}{j}" for i in n4 for j in range(1, 6)]
        steps[f"e{k}"] = "SELECT n, my, " + ", ".join(f"m{i}, s{i}" for i in n4) + ", " + ", ".join(cells) + f" FROM e{k - 1}"
    train = "SELECT " + ", ".join(f"v.{f} AS x{i}" for i, f in enumerate(F4, 1)) + f", y.yield_bu_ac AS y {_ROWS}"
    return with_("county_vi", "county_yield", tr4=train, **steps) + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {R(f'a{i}5')} AS ridge_coef_standardized, {R(f'm{i}')} AS x_mean, {R(f's{i}')} AS x_std, {R('my')} AS ridge_intercept, CAST(n AS DOUBLE) AS n_rows FROM e4"
        for i, f in enumerate(F4, 1))


@check("A14b_ridge_fit_four_features", _sql_four())
def a14b(spark, d):
    return rounded(ridge.fit(_training(spark, d), F4, "yield_bu_ac"), "ridge_coef_standardized", "x_mean", "x_std", "ridge_intercept")


@check("A15_ridge_predictions", _WITH_FIT + f"SELECT county_fips, year, {R(_PRED)} AS predicted, {R(f'y - ({_PRED})')} AS residual FROM tr, fit")
def a15(spark, d):
    t = _training(spark, d)
    out = ridge.predict(ridge.complete_rows(t, [*F2, "yield_bu_ac"]), ridge.fit(t, F2, "yield_bu_ac"), F2, "yield_bu_ac")
    return rounded(out.select("county_fips", "year", "predicted", "residual"), "predicted", "residual")


@check("A16_fit_quality", _WITH_FIT + f"""SELECT count(*) AS n, {R('avg(abs(y - p))')} AS mae, {R('1 - avg((y - p) ** 2) / var_pop(y)')} AS r2, {R('covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p))')} AS corr FROM (SELECT y, {_PRED} AS p FROM tr, fit)""")
def a16(spark, d):
    t = _training(spark, d)
    out = ridge.predict(ridge.complete_rows(t, [*F2, "yield_bu_ac"]), ridge.fit(t, F2, "yield_bu_ac"), F2, "yield_bu_ac")
    return rounded(ridge.fit_quality(out, "yield_bu_ac"), "mae", "r2", "corr")


_WITH_CV = with_("county_vi", "county_yield", tr=_TRAIN, ys="SELECT DISTINCT year AS held FROM tr", st=f"SELECT held, {_STAT} FROM tr JOIN ys ON tr.year <> held GROUP BY held", fit=_SOLVE,
                 sc=f"SELECT tr.year, count(*) AS n, avg(abs(y - ({_PRED}))) AS mae, 1 - avg((y - ({_PRED})) ** 2) / var_pop(y) AS r2 FROM tr JOIN fit ON held = tr.year GROUP BY 1")


@check("A17_leave_one_year_out", _WITH_CV + f"SELECT year, n, {R('mae')} AS mae, {R('r2')} AS r2 FROM sc")
def a17(spark, d):
    return rounded(ridge.leave_one_out_scores(_training(spark, d), F2, "yield_bu_ac"), "mae", "r2")


@check("A17b_leave_one_year_out_summary", _WITH_CV + f"SELECT {R('avg(r2)')} AS mean_r2, {R('median(r2)')} AS median_r2, {R('avg(mae)')} AS mean_mae, {R('median(mae)')} AS median_mae FROM sc")
def a17b(spark, d):
    out = ridge.score_summary(ridge.leave_one_out_scores(_training(spark, d), F2, "yield_bu_ac"))
    return rounded(out, "mean_r2", "median_r2", "mean_mae", "median_mae")


@check("A18_normalise_weights", _WITH_FIT + f"""SELECT feature, {R('w / (SELECT sum(abs(w)) FROM coef)')} AS gee_weight_normalized, {R('greatest(w, 0) / (SELECT sum(greatest(w, 0)) FROM coef)')} AS nonnegative FROM coef""".replace("FROM coef)", f"FROM ({_COEF}))") .replace("FROM coef", f"FROM ({_COEF})"))
def a18(spark, d):
    c = materialise(ridge.fit(_training(spark, d), F2, "yield_bu_ac"), "coefficients")
    a = ridge.normalise_weights(c).select("feature", "gee_weight_normalized")
    b = ridge.normalise_weights(c, nonnegative=True).select("feature", F.col("gee_weight_normalized").alias("nonnegative"))
    return rounded(a.join(b, "feature"), "gee_weight_normalized", "nonnegative")


@check("A18b_coefficient_table", _WITH_FIT + f"""SELECT feature, {R('w')} AS ridge_coef_standardized, {R('greatest(w, 0) / t')} AS gee_weight_normalized, {R('m')} AS x_mean, {R('s')} AS x_std,
 {R('my')} AS ridge_intercept, 1.0::DOUBLE AS ridge_alpha, true AS force_nonnegative_weights, 0.15::DOUBLE AS redist_strength, 0.5::DOUBLE AS raw_weight_min, 1.5::DOUBLE AS raw_weight_max,
 0.3::DOUBLE AS min_valid_pixel_fraction, CAST(20 AS BIGINT) AS min_crop_pixel_count FROM ({_COEF}), (SELECT sum(greatest(w, 0)) AS t FROM ({_COEF}))""")
def a18b(spark, d):
    """Written, read back with its settings, and returned."""
    c = materialise(ridge.fit(_training(spark, d), F2, "yield_bu_ac"), "coefficients")
    table = materialise(ridge.coefficient_table(c, nonnegative=True, min_valid_fraction=0.3, min_crop_pixels=20), "coefficient_table")
    assert ridge.settings_of(table)["redist_strength"] == 0.15
    return rounded(table, "ridge_coef_standardized", "gee_weight_normalized", "x_mean", "x_std", "ridge_intercept")


# --- metrics -------------------------------------------------------------------------------------

_FLOATS = [m for m in metrics.METRICS if m != "n"]


def _sql_metrics(p: str = "pred", t: str = "target", prefix: str = "") -> str:
    e = f"({p} - {t})"
    rr = f"(covar_pop({p}, {t}) / nullif(sqrt(var_pop({p})) * sqrt(var_pop({t})), 0))"
    rr = f"(CASE WHEN count({e}) > 1 THEN {rr} END)"
    cols = {"mae": f"avg(abs({e}))", "rmse": f"sqrt(avg({e} * {e}))", "bias": f"avg({e})", "r2": f"1 - avg({e} * {e}) / nullif(var_pop({t}), 0)",
            "pearson_r": rr, "pearson_r2": f"{rr} * {rr}", "pct_mae": f"avg(abs({e})) / avg(abs({t})) * 100"}
    return f"count({e}) AS {prefix}n, " + ", ".join(f"{R(c)} AS {prefix}{n}" for n, c in cols.items())


@check("A19_regression_metrics", with_("predictions") + f"SELECT {_sql_metrics()} FROM predictions WHERE crop_mask")
def a19(spark, d):
    return rounded(metrics.regression_metrics(fx.predictions(spark, d), mask=F.col("crop_mask")), *_FLOATS)


@check("A20_group_metrics", with_("predictions") + f"SELECT state, year, {_sql_metrics()} FROM predictions GROUP BY 1, 2")
def a20(spark, d):
    return rounded(metrics.regression_metrics(fx.predictions(spark, d), ["state", "year"]), *_FLOATS)


LEVELS = {"global": [], "year": ["year"], "state_year": ["state", "year"], "county_year": ["county_fips", "state", "year"], "chip": ["sample_id"]}


@check("A21_multi_level_metrics", with_("predictions") + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, " + ", ".join((f"CAST({c} AS VARCHAR)" if c in cols else "NULL::VARCHAR") + f" AS {c}" for c in ("county_fips", "sample_id", "state", "year")) +
    f", {_sql_metrics()} FROM predictions" + (f" GROUP BY {', '.join(cols)}" if cols else "") for lv, cols in LEVELS.items()))
def a21(spark, d):
    out = metrics.multi_level(fx.predictions(spark, d), LEVELS)
    return rounded(out.withColumn("year", F.col("year").cast("string")), *_FLOATS)


@check("A21b_multi_level_flat_target", with_("predictions") + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, " + ", ".join((f"CAST({c} AS VARCHAR)" if c in cols else "NULL::VARCHAR") + f" AS {c}" for c in ("county_fips", "sample_id", "state", "year")) +
    ", count(*) AS n, NULL::DOUBLE AS r2, NULL::DOUBLE AS pearson_r FROM predictions WHERE pred IS NOT NULL AND target IS NOT NULL" + (f" GROUP BY {', '.join(cols)}" if cols else "")
    for lv, cols in LEVELS.items()))
def a21b(spark, d):
    """A target without spread, far from zero: r2 and r are undefined at every level."""
    flat = fx.predictions(spark, d).withColumn("target", F.when(F.col("target").isNotNull(), F.lit(1234567.1)))
    out = metrics.multi_level(flat, LEVELS)
    return out.select("level", "county_fips", "sample_id", "state", F.col("year").cast("string").alias("year"), "n", "r2", "pearson_r")


@check("A22_macro_average", with_("predictions", g="SELECT county_fips, avg(abs(pred - target)) AS mae, sqrt(avg((pred - target) ** 2)) AS rmse, 1 - avg((pred - target) ** 2) / var_pop(target) AS r2, covar_pop(pred, target) / (stddev_pop(pred) * stddev_pop(target)) AS r FROM predictions GROUP BY 1") +
       f"SELECT {R('avg(mae)')} AS macro_mae, {R('avg(rmse)')} AS macro_rmse, {R('avg(r2)')} AS macro_r2, {R('avg(r)')} AS macro_pearson_r FROM g")
def a22(spark, d):
    out = metrics.macro_average(metrics.regression_metrics(fx.predictions(spark, d), ["county_fips"]))
    return rounded(out, *out.columns)


_POISSON = ", ".join(repr(p) for p in metrics.POISSON_ONE)


@check("A23_group_bootstrap", with_("predictions", g="SELECT sample_id, sqrt(avg((pred - target) ** 2)) AS rmse FROM predictions GROUP BY 1",
       dr="SELECT *, CAST(CAST('0x' || substr(md5('11|' || CAST(rep AS VARCHAR) || '|' || sample_id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM (SELECT *, unnest(range(500)) AS rep FROM g)",
       w=f"SELECT rep, rmse, len([p for p in [{_POISSON}]::DOUBLE[] if u >= p]) AS w FROM dr",
       st="SELECT rep, sum(w * rmse) / sum(w) AS s FROM w GROUP BY 1") +
       f"SELECT {R('avg(s)')} AS mean, {R('quantile_cont(s, 0.025)')} AS lo, {R('quantile_cont(s, 0.975)')} AS hi, count(*) AS n_boot FROM st")
def a23(spark, d):
    return rounded(metrics.bootstrap_ci(fx.predictions(spark, d), "sample_id", n_boot=500, seed=11), "mean", "lo", "hi")


@check("A25_chip_metrics", with_("predictions") + f"SELECT sample_id, state, year, {R('avg(pred)')} AS pred, {R('avg(target)')} AS target, {_sql_metrics(prefix='chip_')} FROM predictions WHERE crop_mask GROUP BY 1, 2, 3")
def a25(spark, d):
    return rounded(metrics.chip_metrics(fx.predictions(spark, d), mask=F.col("crop_mask")), "pred", "target", *[f"chip_{m}" for m in _FLOATS])


_FIELDS = "SELECT field_id, count(*) AS n_px, avg(pred) AS pm, avg(target) AS am FROM predictions WHERE field_id > 0 GROUP BY 1 HAVING count(*) >= 5"


@check("A26_field_means", with_("predictions", f=_FIELDS) + f"SELECT field_id, n_px, {R('pm')} AS pred_mean, {R('am')} AS actual_mean, {R('pm - am')} AS residual FROM f")
def a26(spark, d):
    p = fx.predictions(spark, d).withColumnRenamed("target", "actual")
    return rounded(metrics.field_means(p), "pred_mean", "actual_mean", "residual")


@check("A26b_field_summary", with_("predictions", f=_FIELDS) + f"""SELECT count(*) AS n_fields, {R('covar_pop(pm, am) / (stddev_pop(pm) * stddev_pop(am))')} AS pearson_r, {R('avg(pm) - avg(am)')} AS bias, {R('sqrt(avg((pm - am) ** 2))')} AS rmse,
 {R('stddev_pop(am)')} AS constant_rmse, {R('stddev_pop(pm) / stddev_pop(am)')} AS spread_ratio, sqrt(avg((pm - am) ** 2)) < stddev_pop(am) AS beats_constant FROM f""")
def a26b(spark, d):
    p = fx.predictions(spark, d).withColumnRenamed("target", "actual")
    return rounded(metrics.field_summary(metrics.field_means(p)), "pearson_r", "bias", "rmse", "constant_rmse", "spread_ratio")


@check("A27_compare_runs", with_("predictions") + f"""SELECT run_id, {_sql_metrics()}, {R('avg(pred)')} AS pred_mean, {R('avg(target)')} AS target_mean, {R('stddev_pop(pred)')} AS pred_std, {R('stddev_pop(target)')} AS target_std,
 {R('stddev_pop(pred) / stddev_pop(target)')} AS spread_ratio, CASE WHEN stddev_pop(pred) / stddev_pop(target) < 0.9 THEN 'compressed' ELSE 'comparable' END AS verdict FROM predictions GROUP BY 1""")
def a27(spark, d):
    return rounded(metrics.compare_runs(fx.predictions(spark, d)), *_FLOATS, "pred_mean", "target_mean", "pred_std", "target_std", "spread_ratio")


@check("A28_masked_losses", with_("predictions", e="SELECT sample_id, (pred - target) / 20 AS e, crop_mask AND sample_id <> 'chip_7' AS m FROM predictions") + f"""SELECT sample_id, {R('coalesce(avg(CASE WHEN m THEN e * e END), 0)')} AS mse, {R('coalesce(avg(CASE WHEN m THEN abs(e) END), 0)')} AS mae,
 {R('coalesce(avg(CASE WHEN m THEN CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END END), 0)')} AS huber, {R('coalesce(avg(CASE WHEN m THEN 0.5 * (exp(-0.3::DOUBLE) * e * e + 0.3::DOUBLE) END), 0)')} AS gaussian FROM e GROUP BY 1""")
def a28(spark, d):
    p = fx.predictions(spark, d).withColumn("m", F.col("crop_mask") & (F.col("sample_id") != "chip_7"))
    a, b = F.col("pred") / 20, F.col("target") / 20
    out = p.groupBy("sample_id").agg(*[targets.masked_mean(targets.loss_term(n, a, b, log_var=F.lit(0.3)), F.col("m")).alias(n) for n in ("mse", "mae", "huber", "gaussian")])
    return rounded(out, "mse", "mae", "huber", "gaussian")


@check("A29_band_statistics", f"""SELECT label, band, {R('avg(v)')} AS mean, {R('CASE WHEN stddev_pop(v) > 1e-6 THEN stddev_pop(v) ELSE 1 END')} AS std, count(v) AS n FROM (
 SELECT label, unnest(range(64)) AS band, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2""")
def a29(spark, d):
    e = fx.table(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("band", "v")).withColumn("v", F.col("v").cast("double")).withColumn("band", F.col("band").cast("long"))
    out = folds.band_statistics(long, ["label", "band"], ["v"])
    return out.select("label", "band", r("v_mean").alias("mean"), r("v_std").alias("std"), F.col("v_n").alias("n"))


@check("A30_target_scaler", with_("predictions") + f"""SELECT 'zscore' AS mode, state, {R('avg(target)')} AS center, {R('stddev_pop(target)')} AS scale FROM predictions GROUP BY state UNION ALL
 SELECT 'robust', state, {R('median(target)')}, {R('quantile_cont(target, 0.75) - quantile_cont(target, 0.25)')} FROM predictions GROUP BY state UNION ALL SELECT DISTINCT 'none', state, 0.0::DOUBLE, 1.0::DOUBLE FROM predictions""")
def a30(spark, d):
    p = fx.predictions(spark, d)
    parts = [folds.target_scaler(p, "target", m, ["state"]).select("mode", "state", "center", "scale") for m in ("zscore", "robust", "none")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "center", "scale")


@check("A34_residual_histogram", with_("predictions", e="SELECT pred - target AS r FROM predictions", x="SELECT min(r) AS lo, max(r) AS hi FROM e") + """SELECT CAST(CASE WHEN r = hi THEN 60 ELSE floor((r - lo) / (hi - lo) * 60) + 1 END AS INTEGER) AS bin, count(*) AS n FROM e, x GROUP BY 1""")
def a34(spark, d):
    p = fx.predictions(spark, d)
    lo, hi = metrics.residual_range(p)
    return metrics.residual_histogram(p, lo, hi)


@check("A34b_density", with_("predictions") + "SELECT CAST(floor(target / 7.5) AS INTEGER) AS target_bin, CAST(floor(pred / 7.5) AS INTEGER) AS pred_bin, count(*) AS n FROM predictions GROUP BY 1, 2")
def a34b(spark, d):
    return metrics.density(fx.predictions(spark, d), 7.5)


@check("A34c_residual_limit", with_("predictions") + f'SELECT state, {R("quantile_cont(abs(pred - target), 0.98)")} AS "limit" FROM predictions GROUP BY 1')
def a34c(spark, d):
    return rounded(metrics.residual_limit(fx.predictions(spark, d), ["state"]), "limit")


# --- folds -----------------------------------------------------------------------------------------

def _years(spark, d):
    return fx.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()


def _text(df, *cols):
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in cols})


_YS = "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders"
_FOLD = """f AS (SELECT t.y AS test_year, coalesce((SELECT max(y) FROM ys WHERE y < t.y), NULL) AS v FROM ys t)"""
_TRAINS = "(SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM ys WHERE y <> test_year AND y <> {v})"


@check("L01_folds_previous_year", f"WITH ys AS ({_YS}), {_FOLD} SELECT test_year, coalesce(CAST(v AS VARCHAR), '') AS val_years, {_TRAINS.format(v='coalesce(v, -1)')} AS train_years, CASE WHEN v IS NULL THEN 'no validation years' END AS error FROM f")
def l01(spark, d):
    return _text(folds.make_folds(_years(spark, d), "previous_year", on_error="keep"), "val_years", "train_years")


@check("L01b_folds_fixed_pool", f"WITH ys AS ({_YS}) SELECT y AS test_year, CASE y WHEN 1996 THEN '1998' WHEN 1998 THEN '1996' ELSE '1996,1998' END AS val_years, (SELECT string_agg(CAST(z.y AS VARCHAR), ',' ORDER BY z.y) FROM ys z WHERE z.y NOT IN (ys.y, 1996, 1998)) AS train_years FROM ys")
def l01b(spark, d):
    return _text(folds.make_folds(_years(spark, d), "fixed_pool", pool=[1996, 1998]), "val_years", "train_years")


def _map(spark, d):
    y = _years(spark, d)
    lo = y.agg(F.min("year").alias("m")).first()["m"]
    return y.select(F.col("year").alias("test_year"), F.array(F.when(F.col("year") == lo, F.col("year") + 1).otherwise(F.col("year") - 1)).alias("val_years"))


_MAPPED = """mp AS (SELECT y AS test_year, CASE WHEN y = (SELECT min(y) FROM ys) THEN y + 1 ELSE y - 1 END AS v FROM ys)"""


@check("L01c_folds_explicit_map", f"WITH ys AS ({_YS}), {_MAPPED} SELECT test_year, CAST(v AS VARCHAR) AS val_years, {_TRAINS.format(v='v')} AS train_years FROM mp")
def l01c(spark, d):
    return _text(folds.assert_disjoint(folds.make_folds(_years(spark, d), "explicit_map", _map(spark, d))), "val_years", "train_years")


@check("U04_assert_disjoint", f"WITH ys AS ({_YS}), {_MAPPED} SELECT test_year, CAST(1 AS BIGINT) AS n_val, (SELECT count(*) FROM ys) - 2 AS n_train FROM mp")
def u04(spark, d):
    f = folds.assert_disjoint(folds.make_folds(_years(spark, d), "explicit_map", _map(spark, d)))
    return f.select("test_year", F.size("val_years").cast("long").alias("n_val"), F.size("train_years").cast("long").alias("n_train"))


@check("L02_assign_split", with_("predictions", ys=_YS).rstrip() + f""", {_MAPPED} SELECT test_year, p.year, CASE WHEN p.year = test_year THEN 'test' WHEN p.year = v THEN 'val' ELSE 'train' END AS split, count(*) AS n
 FROM predictions p JOIN mp ON true WHERE p.year IN (SELECT y FROM ys) GROUP BY 1, 2, 3""")
def l02(spark, d):
    f = folds.make_folds(_years(spark, d), "explicit_map", _map(spark, d))
    return folds.assign_split(fx.predictions(spark, d), f).groupBy("test_year", "year", "split").agg(F.count(F.lit(1)).alias("n"))


_REC = """SELECT DISTINCT sample_id, state, year, CAST(floor("row" / 128) * 128 AS INTEGER) AS row_off, CAST(floor(col / 128) * 128 AS INTEGER) AS col_off,
 CASE WHEN sample_id = 'chip_3' THEN 'train' WHEN year = 1999 THEN 'test' WHEN year = 1998 THEN 'val' ELSE 'train' END AS split, CASE WHEN year = 1999 THEN 'test' WHEN year = 1998 THEN 'val' ELSE 'train' END AS ex FROM predictions WHERE year BETWEEN 1995 AND 2000"""


@check("L03_leakage_audit", with_("predictions", rec=_REC) + """SELECT 'declared_split' AS issue, sample_id AS key FROM rec WHERE split <> ex UNION ALL SELECT 'duplicate_id', sample_id FROM rec GROUP BY sample_id HAVING min(ex) <> max(ex)
 UNION ALL SELECT 'shared_window', key FROM (SELECT concat_ws('/', state, year, row_off, col_off) AS key, min(split) AS a, max(split) AS b FROM rec GROUP BY 1) WHERE a <> b""")
def l03(spark, d):
    p = fx.predictions(spark, d)
    declared = F.when(F.col("sample_id") == "chip_3", F.lit("train")).when(F.col("year") == 1999, F.lit("test")).when(F.col("year") == 1998, F.lit("val")).otherwise(F.lit("train"))
    rec = p.select("sample_id", "state", "year", chip_of(F.col("row"), 128).alias("row_off"), chip_of(F.col("col"), 128).alias("col_off"), declared.alias("split")).distinct()
    universe = p.select("year").distinct().filter("year between 1995 and 2000")
    fold = universe.withColumn("split", F.when(F.col("year") == 1999, F.lit("test")).when(F.col("year") == 1998, F.lit("val")).otherwise(F.lit("train")))
    return folds.leakage_audit(rec, fold)


@check("L04_all_folds_sweep", with_("predictions", ys="SELECT DISTINCT year AS y FROM predictions").rstrip() + f""", {_MAPPED.replace("mp AS", "mq AS")}, mp AS (SELECT test_year, CASE WHEN test_year = (SELECT min(y) FROM ys) THEN (SELECT max(y) FROM ys) ELSE v END AS v FROM mq), tm AS (SELECT test_year, avg(target) AS m FROM predictions JOIN mp ON year <> test_year AND year <> v GROUP BY 1)
 SELECT test_year, {_sql_metrics('(pred * 0.5 + m * 0.5)')} FROM predictions JOIN tm ON year = test_year GROUP BY 1""")
def l04(spark, d):
    p = fx.predictions(spark, d)
    years = p.select("year").distinct()
    lo = years.agg(F.min("year").alias("m")).first()["m"]
    m = years.select(F.col("year").alias("test_year"), F.array(F.when(F.col("year") == lo, F.col("year")).otherwise(F.col("year") - 1)).alias("val_years"))
    # the first year is mapped to itself, so its fold has to fall back to the latest other year
    out = folds.sweep(p, folds.make_folds(years, "explicit_map", m, on_error="keep"), "target",
                      lambda row, mean: row["pred"] * 0.5 + mean * 0.5)
    return rounded(out, *_FLOATS)


@check("L05_fold_statistics", with_("predictions", ys="SELECT DISTINCT year AS y FROM predictions").rstrip() + f""", {_MAPPED} SELECT test_year, count(target) AS target_n, {R('avg(target)')} AS target_mean, {R('stddev_pop(target)')} AS target_std, count(pred) AS pred_n, {R('avg(pred)')} AS pred_mean, {R('stddev_pop(pred)')} AS pred_std
 FROM predictions JOIN mp ON year <> test_year AND year <> v GROUP BY 1""")
def l05(spark, d):
    p = fx.predictions(spark, d)
    years = p.select("year").distinct()
    lo = years.agg(F.min("year").alias("m")).first()["m"]
    m = years.select(F.col("year").alias("test_year"), F.array(F.when(F.col("year") == lo, F.col("year") + 1).otherwise(F.col("year") - 1)).alias("val_years"))
    return rounded(folds.fold_statistics(p, folds.make_folds(years, "explicit_map", m), ["target", "pred"]), "target_mean", "target_std", "pred_mean", "pred_std")


@check("L06_reuse_statistics", f"""WITH ys AS ({_YS}), {_MAPPED} SELECT test_year, CASE WHEN test_year = 1997 THEN 'no stored statistics' WHEN test_year % 2 = 0 THEN 'other training years' WHEN test_year = 1999 THEN 'other mode' END AS refused FROM mp""")
def l06(spark, d):
    f = folds.make_folds(_years(spark, d), "explicit_map", _map(spark, d))
    stored = f.filter("test_year <> 1997").select("test_year", F.when(F.col("test_year") % 2 == 0, F.slice("train_years", 1, 2)).otherwise(F.reverse("train_years")).alias("train_years"),
                                                  F.when(F.col("test_year") == 1999, F.lit("official")).otherwise(F.lit("fold")).alias("mode"))
    return folds.reuse_statistics(f, stored, "fold", on_error="keep").select("test_year", "refused")


@check("L06b_nearest_statistics", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'runs/' || p_brand || '/v' || p_size WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN 'runs/' || p_brand END AS folder FROM part""")
def l06b(spark, d):
    p = fx.table(spark, d, "part")
    root, deep = F.concat(F.lit("runs/"), "p_brand"), F.concat(F.lit("runs/"), "p_brand", F.lit("/v"), F.col("p_size").cast("string"))
    ck = p.select("p_partkey", F.concat(deep, F.lit("/checkpoints/"), F.col("p_partkey").cast("string"), F.lit(".ckpt")).alias("path"))
    stored = p.filter("p_size = 50").select(root.alias("folder")).union(p.filter("p_size < 10").select(deep.alias("folder")))
    return folds.nearest_statistics(ck, stored).select("p_partkey", "folder")


# --- scoring ----------------------------------------------------------------------------------------

_W64 = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]
_W64_SQL = "[" + ", ".join(f"{w}" for w in _W64) + "]::DOUBLE[]"


@check("M01_score_chips", f"SELECT vec_id, label, {R(f'list_inner_product(CAST(embedding AS DOUBLE[]), {_W64_SQL})')} AS score FROM embeddings")
def m01(spark, d):
    w = np.array(_W64)
    out = scoring.score_chips(fx.table(spark, d, "embeddings"), "embedding", lambda x: x @ w, ["vec_id", "label"])
    return out.select("vec_id", "label", r(F.col("prediction")[0]).alias("score"))


@check("M01b_score_linear_columns", with_("pixel") + f"""SELECT scene_id, "row", col, ln, {R('0.5 + blue * 2 + green * -1 + red * 0.25')} AS score FROM pixel""")
def m01b(spark, d):
    s = scoring.linear_score([F.col("blue"), F.col("green"), F.col("red")], [2.0, -1.0, 0.25], 0.5)
    return fx.pixel(spark, d).select("scene_id", "row", "col", "ln", r(s).alias("score"))


@check("M02_surfaces", with_("predictions", o="""SELECT state, year, "row", col, max(struct_pack(s := sample_id, p := pred)).p AS pred FROM predictions GROUP BY 1, 2, 3, 4""",
       a="""SELECT state, year, "row", col, avg(CASE WHEN ln <> 7 THEN target END) AS label, bool_or(crop_mask) AS crop, CAST(count(*) - 1 AS INTEGER) AS mths FROM predictions GROUP BY 1, 2, 3, 4""",
       j="""SELECT o.*, label, coalesce(crop, false) AS crop, coalesce(crop AND label IS NOT NULL AND mths >= 0, false) AS sh FROM o LEFT JOIN a USING (state, year, "row", col)""") +
       f"""SELECT state, year, "row", col, CASE WHEN crop THEN {R('pred')} END AS prediction_full, CASE WHEN sh THEN {R('pred')} END AS prediction, CASE WHEN sh THEN {R('label')} END AS actual, CASE WHEN sh THEN {R('pred - label')} END AS residual, sh AS comparison_mask FROM j""")
def m02(spark, d):
    p = fx.predictions(spark, d)
    keys = ["state", "year", "row", "col"]
    actual = p.groupBy(*keys).agg(F.avg(F.when(F.col("ln") != 7, F.col("target"))).alias("label"), F.bool_or("crop_mask").alias("crop_mask"), (F.count(F.lit(1)) - 1).cast("int").alias("n_valid_months"))
    out = scoring.surfaces(p.select(*keys, "sample_id", "pred"), actual, keys, k=0)
    return rounded(out, "prediction_full", "prediction", "actual", "residual")


@check("M03_occlusion", f"""SELECT i AS slice, {R('abs(avg(CASE WHEN label < 5 THEN w * v END))')} AS delta FROM (SELECT label, CAST(unnest(range(64)) AS INTEGER) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest({_W64_SQL}) AS w FROM embeddings) GROUP BY 1""")
def m03(spark, d):
    w = F.array(*[F.lit(x) for x in _W64])
    e = fx.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))

    def score(v):
        return F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rounded(scoring.occlusion(e, "v", 64, score, F.col("label") < 5), "delta")


_BROKEN = """SELECT vec_id, label, CASE WHEN vec_id % 50 = 9 THEN NULL WHEN vec_id % 7 = 3 THEN 'bad_size' WHEN vec_id % 11 = 5 THEN 'non_finite' ELSE 'ok' END AS s FROM embeddings"""


def _broken(spark, d):
    v, k = F.col("embedding"), F.col("vec_id")
    bad = F.transform(v, lambda x, i: F.when(i == 2, F.lit(float("nan")).cast("float")).otherwise(x))
    return fx.table(spark, d, "embeddings").select(
        "vec_id", "label", F.when(k % 50 == 9, F.lit(None)).when(k % 7 == 3, F.slice(v, 1, 63)).when(k % 11 == 5, bad).otherwise(v).alias("v"))


@check("M04_chip_integrity", f"SELECT vec_id, label, coalesce(s, 'missing') AS status FROM ({_BROKEN})")
def m04(spark, d):
    return quality.chip_integrity(_broken(spark, d), "v", 64, "vec_id")


@check("M04b_integrity_report", f"SELECT label, CAST(count(*) AS BIGINT) AS window_reads, CAST(count(CASE WHEN coalesce(s, 'missing') <> 'ok' THEN 1 END) AS BIGINT) AS bad_reads, count(CASE WHEN coalesce(s, 'missing') <> 'ok' THEN 1 END) AS affected_chips FROM ({_BROKEN}) GROUP BY 1")
def m04b(spark, d):
    return quality.integrity_report(quality.chip_integrity(_broken(spark, d), "v", 64, "vec_id"), "label", "vec_id")
