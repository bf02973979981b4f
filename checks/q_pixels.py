"""Pixel composites, zonal statistics, disaggregation, gap filling and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import spectral
from fieldspark.operators import composite, disagg, gapfill, mosaic, quality, zonal
from fieldspark.plans import materialise
from . import fixtures as fx
from .fixtures import with_
from .q_sources import SQL_INDICES, _CLEAR
from .registry import R, check, r, rounded

BANDS = spectral.BAND_ORDER
_CLEAR_OBS = f"SELECT * FROM scene_pixel WHERE {_CLEAR.format(bits=30)} AND " + " AND ".join(f"{b} > -9990" for b in BANDS)
_MONTHLY = 'SELECT state, year, month, "row", col, ' + ", ".join(f"avg({b}) AS {b}" for b in BANDS) + \
    ", CAST(count(*) AS INTEGER) AS OBS_COUNT FROM obs GROUP BY 1, 2, 3, 4, 5"


@check("A03_monthly_composite", with_("scene_pixel", obs=_CLEAR_OBS, m=_MONTHLY) +
       f"""SELECT state, year, month, "row", col, OBS_COUNT, {', '.join(f"{R(b)} AS {b}" for b in BANDS)} FROM m""")
def a03(spark, d):
    return rounded(composite.monthly_composite(fx.scene_pixel(spark, d)), *BANDS)


@check("A05b_monthly_composite_median", with_("scene_pixel", obs=_CLEAR_OBS) + f"""SELECT state, year, month, "row", col, CAST(count(*) AS INTEGER) AS OBS_COUNT, {R('median(RED)')} AS RED, {R('median(NIR_NARROW)')} AS NIR_NARROW FROM obs GROUP BY 1, 2, 3, 4, 5""")
def a05b(spark, d):
    out = composite.monthly_composite(fx.scene_pixel(spark, d), method="median")
    return rounded(out.select("state", "year", "month", "row", "col", "OBS_COUNT", "RED", "NIR_NARROW"), "RED", "NIR_NARROW")


@check("A03b_composite_for_chips", with_("scene_pixel", obs=_CLEAR_OBS, m="""SELECT state, year, month, CAST(floor("row" / 4) * 4 AS INTEGER) AS row_off, CAST(floor(col / 4) * 4 AS INTEGER) AS col_off,
 avg(RED) AS RED, CAST(count(*) AS INTEGER) AS n FROM obs GROUP BY 1, 2, 3, 4, 5""", chips="""SELECT DISTINCT state, year, month, CAST(floor("row" / 4) * 4 AS INTEGER) AS row_off, CAST(floor(col / 4) * 4 AS INTEGER) AS col_off FROM scene_pixel""",
       bad="""SELECT DISTINCT state, year, month, CAST(floor("row" / 4) * 4 AS INTEGER) AS row_off, CAST(floor(col / 4) * 4 AS INTEGER) AS col_off FROM scene_pixel WHERE scene_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500)""") +
       f"""SELECT state, year, month, row_off, col_off, {R('RED')} AS RED, coalesce(n, 0) AS OBS_COUNT FROM chips LEFT JOIN m USING (state, year, month, row_off, col_off)
 WHERE (state, year, month, row_off, col_off) NOT IN (SELECT state, year, month, row_off, col_off FROM bad)""")
def a03b(spark, d):
    from fieldspark.functions.geo import chip_of
    keys = ["state", "year", "month", "row_off", "col_off"]
    p = fx.scene_pixel(spark, d).withColumn("row_off", chip_of(F.col("row"), 4)).withColumn("col_off", chip_of(F.col("col"), 4))
    status = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene_id"), (F.col("s_acctbal") >= -500).alias("ok"))
    failed = composite.failed_chips(p.select("scene_id", *keys), status, keys)
    comp = composite.clear_observations(p).groupBy(*keys).agg(F.avg("RED").alias("RED"), F.count(F.lit(1)).cast("int").alias("OBS_COUNT"))
    return rounded(composite.composite_for_chips(p.select(*keys).distinct(), comp, keys, failed), "RED")


_REFL = "SELECT *, " + ", ".join(f"CASE WHEN {b} > -9990 THEN {b} * 0.0001 END AS {n}" for b, n in (
    ("BLUE", "blue_r"), ("GREEN", "green_r"), ("RED", "red_r"), ("NIR_NARROW", "nir_r"), ("SWIR1", "swir1_r"))) + " FROM scene_pixel"
_OK2 = f"({_CLEAR.format(bits=30)} AND " + " AND ".join(f"{b} BETWEEN 0 AND 1.2" for b in ("nir", "red", "green", "blue", "swir1")) + ")"
_VI2 = "SELECT state, year, month, \"row\", col, crop_mask, county_fips, " + ", ".join(f"{q.format(ok=_OK2)} AS {v}" for v, q in SQL_INDICES.items()) + \
    " FROM (SELECT state, year, month, \"row\", col, crop_mask, county_fips, fmask, blue_r AS blue, green_r AS green, red_r AS red, nir_r AS nir, swir1_r AS swir1 FROM refl)"
_SEASON = "SELECT state, year, \"row\", col, " + ", ".join(f"avg({v}) AS {v}_mean, CAST(count({v}) AS INTEGER) AS {v}_obsCount" for v in spectral.INDICES) + " FROM vi GROUP BY 1, 2, 3, 4"


def _scene_vi(spark, d):
    s = fx.scene_pixel(spark, d)
    refl = {n: spectral.scale_reflectance(F.col(b)) for n, b in (("blue", "BLUE"), ("green", "GREEN"), ("red", "RED"), ("nir", "NIR_NARROW"), ("swir1", "SWIR1"))}
    return composite.scene_indices(s, refl, spectral.clear_mask(F.col("fmask")))


@check("A04_season_composite", with_("scene_pixel", refl=_REFL, vi=_VI2, s=_SEASON) +
       f"""SELECT state, year, "row", col, {', '.join(f"{R(f'{v}_mean')} AS {v}_mean, {v}_obsCount" for v in spectral.INDICES)},
 least(NDVI_obsCount, EVI_obsCount, GCVI_obsCount, NDWI_obsCount) AS min_index_obsCount, least(NDVI_obsCount, EVI_obsCount, GCVI_obsCount, NDWI_obsCount) >= 3 AS valid_vi_mask FROM s""")
def a04(spark, d):
    return rounded(composite.season_composite(_scene_vi(spark, d)), *[f"{v}_mean" for v in spectral.INDICES])


@check("A05_median_composite", with_("scene_pixel", refl=_REFL, vi=_VI2) + f"""SELECT state, year, month, "row", col, {R('median(NDVI)')} AS NDVI, {R('median(GCVI)')} AS GCVI FROM vi GROUP BY 1, 2, 3, 4, 5""")
def a05(spark, d):
    return rounded(composite.median_composite(_scene_vi(spark, d), ["state", "year", "month", "row", "col"], ["NDVI", "GCVI"]), "NDVI", "GCVI")


@check("A06_season_range", with_("scene_pixel", refl=_REFL, vi=_VI2, m="""SELECT state, year, month, "row", col, avg(NDVI) AS NDVI FROM vi GROUP BY 1, 2, 3, 4, 5""") +
       f"""SELECT state, year, "row", col, {R('avg(NDVI)')} AS NDVI_season_mean, {R('max(NDVI)')} AS NDVI_season_max, {R('min(NDVI)')} AS NDVI_season_min, {R('max(NDVI) - min(NDVI)')} AS NDVI_season_range FROM m GROUP BY 1, 2, 3, 4""")
def a06(spark, d):
    m = _scene_vi(spark, d).groupBy("state", "year", "month", "row", "col").agg(F.avg("NDVI").alias("NDVI"))
    out = composite.season_range(m, ["state", "year", "row", "col"], ["NDVI"])
    return rounded(out, *[f"NDVI_season_{s}" for s in ("mean", "max", "min", "range")])


@check("A07_zonal_statistics", with_("vi_pixel", s="""SELECT county_fips, year, avg(NDVI_mean) AS mean, median(NDVI_mean) AS median, stddev_pop(NDVI_mean) AS std, min(NDVI_mean) AS min, max(NDVI_mean) AS max,
 count(NDVI_mean) AS valid_pixel_count, count(*) AS crop_pixel_count FROM vi_pixel WHERE crop_mask GROUP BY 1, 2""", k="SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS county_fips, CAST(unnest(range(1995, 2002)) AS INTEGER) AS year FROM nation") + f"""SELECT k.county_fips, k.year,
 {', '.join(f"{R(c)} AS {c}" for c in ('mean', 'median', 'std', 'min', 'max'))}, coalesce(valid_pixel_count, 0) AS valid_pixel_count, coalesce(crop_pixel_count, 0) AS crop_pixel_count,
 {R('coalesce(valid_pixel_count / crop_pixel_count, 0)')} AS valid_fraction FROM k LEFT JOIN s ON s.county_fips = k.county_fips AND s.year = k.year""")
def a07(spark, d):
    counties = fx.table(spark, d, "nation").select(fx.code5(F.col("n_nationkey")).alias("county_fips"),
                                                   F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
    out = zonal.zonal_statistics(counties, fx.vi_pixel(spark, d), ["county_fips", "year"], "NDVI_mean")
    return rounded(out, "mean", "median", "std", "min", "max", "valid_fraction")


@check("A07b_county_vi_summary", with_("scene_pixel", refl=_REFL, vi=_VI2.replace("county_fips,", "county_fips,"), s="SELECT county_fips, year, \"row\", col, bool_or(crop_mask) AS crop, " +
       ", ".join(f"avg({v}) AS {v}_mean, CAST(count({v}) AS INTEGER) AS {v}_n" for v in spectral.INDICES) + " FROM vi GROUP BY 1, 2, 3, 4",
       k="SELECT *, least(NDVI_n, EVI_n, GCVI_n, NDWI_n) AS mo FROM s WHERE crop") + f"""SELECT county_fips, year, {', '.join(f"{R(f'avg(CASE WHEN mo >= 1 THEN {v}_mean END)')} AS {v}_mean" for v in spectral.INDICES)},
 {R('avg(CASE WHEN mo >= 1 THEN mo END)')} AS min_index_obsCount, count(*) AS crop_pixel_count, count(CASE WHEN mo >= 1 THEN 1 END) AS valid_pixel_count,
 {R('count(CASE WHEN mo >= 1 THEN 1 END) / count(*)')} AS valid_pixel_fraction FROM k GROUP BY 1, 2""")
def a07b(spark, d):
    keys = ["county_fips", "year", "row", "col"]
    px = composite.season_composite(_scene_vi(spark, d), keys, min_obs=1, also=[F.bool_or("crop_mask").alias("crop_mask")])
    out = zonal.county_vi_summary(px, ["county_fips", "year"])
    return rounded(out, *[f"{v}_mean" for v in spectral.INDICES], "min_index_obsCount", "valid_pixel_fraction")


@check("A08_month_features", with_("vi_pixel") + "SELECT county_fips, year, " + ", ".join(
    f"{R(f'avg(CASE WHEN month = {m} THEN {v} END)')} AS {v}_month_{m:02d}_mean, count(CASE WHEN month = {m} THEN {v} END) AS {v}_month_{m:02d}_valid_pixel_count"
    for m in (6, 7, 8) for v in ("NDVI_mean", "EVI_mean")) + " FROM vi_pixel WHERE crop_mask GROUP BY 1, 2")
def a08(spark, d):
    out = zonal.month_features(fx.vi_pixel(spark, d).filter("crop_mask"), ["county_fips", "year"], ["NDVI_mean", "EVI_mean"], (6, 7, 8))
    return rounded(out, *[c for c in out.columns if c.endswith("_mean")])


@check("A24_county_mean_prediction", with_("predictions") + f"""SELECT county_fips AS geoid, {R('avg(pred)')} AS pred FROM predictions WHERE crop_mask AND ln <> 7 AND county_fips <> '00000' GROUP BY 1""")
def a24(spark, d):
    p = fx.predictions(spark, d).withColumn("pred", F.when(F.col("ln") != 7, F.col("pred"))).withColumn("geoid", F.col("county_fips").cast("int"))
    return rounded(zonal.county_mean_prediction(p), "pred")


@check("A11_band_report", with_("vi_pixel", long="""SELECT 'NDVI_mean' AS band, NDVI_mean AS v FROM vi_pixel UNION ALL SELECT 'EVI_mean', EVI_mean FROM vi_pixel UNION ALL SELECT 'NDWI_mean', NDWI_mean FROM vi_pixel""") +
       f"""SELECT band, count(*) AS total_px, count(v) AS valid_px, count(*) - count(v) AS missing_px, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('avg(v)')} AS mean, {R('median(v)')} AS median,
 {R('stddev_pop(v)')} AS std, {R('quantile_cont(v, 0.02)')} AS p02, {R('quantile_cont(v, 0.98)')} AS p98 FROM long GROUP BY 1""")
def a11(spark, d):
    out = quality.band_report(fx.vi_pixel(spark, d), ["NDVI_mean", "EVI_mean", "NDWI_mean"])
    return rounded(out, "min", "max", "mean", "median", "std", "p02", "p98")


_LABELS = "SELECT 'r' || CAST(scene_id AS VARCHAR) AS raster_id, CASE WHEN ln <> 7 THEN floor(nir * 1000) END AS value FROM pixel WHERE scene_id % 3 <> 1 OR ln = 7"
_PROFILE = f"""SELECT g.raster_id, year, CASE WHEN height % 2 = 0 THEN 'nearest' ELSE 'bilinear10km' END AS variant, CAST(height AS BIGINT) * width AS total_px, coalesce(n, 0) AS valid_px, CAST(height AS BIGINT) * width - coalesce(n, 0) AS nodata_px,
 round(round_even(100.0::DOUBLE * coalesce(n, 0) / (CAST(height AS BIGINT) * width), 4), 4) AS pct_valid, mn, p25, md, p75, mx, mean, std, crs = 'EPSG:5070' AS crs_ok, true AS res_ok
 FROM grids g LEFT JOIN (SELECT raster_id, count(value) AS n, min(value) AS mn, quantile_cont(value, 0.25) AS p25, median(value) AS md, quantile_cont(value, 0.75) AS p75, max(value) AS mx, avg(value) AS mean, stddev_pop(value) AS std FROM lab GROUP BY 1) s USING (raster_id)"""


def _profile(spark, d):
    p = fx.pixel(spark, d).filter("scene_id % 3 <> 1 OR ln = 7").select(
        F.concat(F.lit("r"), F.col("scene_id").cast("string")).alias("raster_id"), F.when(F.col("ln") != 7, F.floor(F.col("nir") * 1000).cast("double")).alias("value"))
    g = fx.grids(spark, d).withColumn("variant", F.when(F.col("height") % 2 == 0, F.lit("nearest")).otherwise(F.lit("bilinear10km")))
    return quality.label_profile(p, g)


@check("A09_label_profile", with_("pixel", "grids", lab=_LABELS, p=_PROFILE) + f"""SELECT raster_id, total_px, valid_px, nodata_px, pct_valid, {', '.join(f'{R(c, 3)} AS "{n}"' for c, n in (
    ('mn', 'min'), ('p25', 'p25'), ('md', 'median'), ('p75', 'p75'), ('mx', 'max')))}, round(round_even(mean, 3), 3) AS mean, round(round_even(std, 3), 3) AS std, crs_ok, res_ok FROM p""")
def a09(spark, d):
    out = _profile(spark, d).select("raster_id", "total_px", "valid_px", "nodata_px", "pct_valid", "min", "p25", "median", "p75", "max", "mean", "std", "crs_ok", "res_ok")
    return rounded(out, "min", "p25", "median", "p75", "max", "mean", "std", digits=3)


@check("A10_quality_flags", with_("pixel", "grids", lab=_LABELS, p=_PROFILE) + """SELECT raster_id, 'low_valid' AS reason FROM p WHERE pct_valid < 0.1 UNION ALL SELECT raster_id, 'empty' FROM p WHERE valid_px = 0
 UNION ALL SELECT raster_id, 'crs' FROM p WHERE NOT crs_ok""")
def a10(spark, d):
    return quality.quality_flags(_profile(spark, d))


@check("A10b_profile_summary", with_("pixel", "grids", lab=_LABELS, p=_PROFILE) + f"""SELECT year, variant, round(round_even(avg(valid_px), 2), 2) AS valid_px, {R('avg(pct_valid)', 2)} AS pct_valid FROM p GROUP BY 1, 2""")
def a10b(spark, d):
    out = quality.profile_summary(_profile(spark, d))
    return out.select("year", "variant", r("valid_px", 2).alias("valid_px"), r("pct_valid", 2).alias("pct_valid"))


# --- disaggregation ---------------------------------------------------------------------------

W4 = {"NDVI_mean": 0.4, "EVI_mean": 0.3, "GCVI_mean": 0.2, "NDWI_mean": 0.1}
_F4 = list(W4)
_OKP = "(crop_mask AND valid_vi_mask AND NDVI_mean IS NOT NULL)"
_PARAMS = "SELECT county_fips, year, count(*) AS crop_pixel_count, count(CASE WHEN " + _OKP + " THEN 1 END) AS valid_vi_pixel_count, " + ", ".join(
    f"avg(CASE WHEN {_OKP} THEN {f} END) AS {f}_mu, CASE WHEN stddev_pop(CASE WHEN {_OKP} THEN {f} END) > 0 THEN stddev_pop(CASE WHEN {_OKP} THEN {f} END) ELSE 1 END AS {f}_sd"
    for f in _F4) + " FROM vi_pixel WHERE crop_mask GROUP BY 1, 2"
_RAW = f"""SELECT v.*, p.* EXCLUDE (county_fips, year), y.yield_bu_ac, CASE WHEN {_OKP} THEN greatest(0.5, least(1.5, 1 + 0.15 * ({' + '.join(f'{w} * ({f} - {f}_mu) / {f}_sd' for f, w in W4.items())}))) ELSE 1.0 END AS raw_weight
 FROM vi_pixel v JOIN params p USING (county_fips, year) JOIN county_yield y USING (county_fips, year) WHERE crop_mask AND valid_vi_pixel_count >= 10"""
_SPREAD = """SELECT *, yield_bu_ac * raw_weight / avg(raw_weight) OVER w AS pseudo_yield, avg(raw_weight) OVER w AS mean_raw_weight, count(*) OVER w AS output_pixel_count
 FROM raw WINDOW w AS (PARTITION BY county_fips, year)"""
_WITH_SPREAD = with_("vi_pixel", "county_yield", params=_PARAMS, raw=_RAW, spread=_SPREAD)


def _spread(spark, d):
    return disagg.disaggregate(fx.vi_pixel(spark, d), fx.county_yield(spark, d), W4)


@check("A12_zscore_parameters", with_("vi_pixel", params=_PARAMS) + f"""SELECT county_fips, year, crop_pixel_count, valid_vi_pixel_count, {', '.join(f"{R(f'{f}_{s}')} AS {f}_{s}" for f in _F4 for s in ('mu', 'sd'))} FROM params""")
def a12(spark, d):
    out = disagg.zscore_parameters(fx.vi_pixel(spark, d))
    return rounded(out, *[f"{f}_{s}" for f in _F4 for s in ("mu", "sd")])


@check("W01_county_zscores", with_("vi_pixel", params=_PARAMS) + f"""SELECT county_fips, year, "row", col, {', '.join(f"{R(f'({f} - {f}_mu) / {f}_sd')} AS {f}_z" for f in _F4)}
 FROM vi_pixel JOIN params USING (county_fips, year) WHERE crop_mask""")
def w01(spark, d):
    out = disagg.county_zscores(fx.vi_pixel(spark, d))
    return rounded(out.select("county_fips", "year", "row", "col", *[f"{f}_z" for f in _F4]), *[f"{f}_z" for f in _F4])


@check("W02_disaggregate", _WITH_SPREAD + f"""SELECT state, county_fips, year, "row", col, {_OKP} AS is_valid, {R('raw_weight')} AS raw_weight, {R('pseudo_yield')} AS pseudo_yield FROM spread""")
def w02(spark, d):
    return rounded(_spread(spark, d).select("state", "county_fips", "year", "row", "col", "is_valid", "raw_weight", "pseudo_yield"), "raw_weight", "pseudo_yield")


@check("W02b_disaggregate_valid_only", with_("vi_pixel", "county_yield", params=_PARAMS, raw=_RAW + f" AND {_OKP}", spread=_SPREAD) + f"""SELECT county_fips, year, "row", col, {R('pseudo_yield')} AS pseudo_yield FROM spread""")
def w02b(spark, d):
    out = disagg.disaggregate(fx.vi_pixel(spark, d), fx.county_yield(spark, d), W4, fill_invalid=False)
    return rounded(out.select("county_fips", "year", "row", "col", "pseudo_yield"), "pseudo_yield")


_DIAG = ("pseudo_yield_mean_bu_ac", "pseudo_yield_min_bu_ac", "pseudo_yield_median_bu_ac", "pseudo_yield_max_bu_ac", "pseudo_yield_std_bu_ac", "mean_difference_from_nass")


@check("A13_disaggregation_diagnostics", _WITH_SPREAD + f"""SELECT county_fips, year, min(state) AS state, {R('min(yield_bu_ac)')} AS nass_yield_bu_ac, min(crop_pixel_count) AS crop_pixel_count,
 min(valid_vi_pixel_count) AS valid_vi_pixel_count, min(output_pixel_count) AS output_pixel_count, {R('min(mean_raw_weight)')} AS mean_raw_weight, {', '.join(f"{R(f'min({f}_{s})')} AS {f}_{s}" for f in _F4 for s in ('mu', 'sd'))},
 {R('avg(pseudo_yield)')} AS pseudo_yield_mean_bu_ac, {R('min(pseudo_yield)')} AS pseudo_yield_min_bu_ac, {R('median(pseudo_yield)')} AS pseudo_yield_median_bu_ac, {R('max(pseudo_yield)')} AS pseudo_yield_max_bu_ac,
 {R('stddev_pop(pseudo_yield)')} AS pseudo_yield_std_bu_ac, {R('avg(pseudo_yield) - min(yield_bu_ac)')} AS mean_difference_from_nass FROM spread GROUP BY 1, 2""")
def a13(spark, d):
    out = disagg.diagnostics(_spread(spark, d))
    return rounded(out, "nass_yield_bu_ac", "mean_raw_weight", *[f"{f}_{s}" for f in _F4 for s in ("mu", "sd")], *_DIAG)


@check("J14_apply_weights", _WITH_SPREAD + f"""SELECT county_fips, year, "row", col, {R(' + '.join(f'{w * 2 / 2} * ({f} - {f}_mu) / {f}_sd' for f, w in W4.items()))} AS score FROM vi_pixel JOIN params USING (county_fips, year) WHERE crop_mask""")
def j14(spark, d):
    # a stored coefficient file
    t = materialise(spark.createDataFrame([(f, 10 * w) for f, w in W4.items()], "feature string, ridge_coef_standardized double"), "coefficients")
    weights = disagg.weights_from_table(t)
    out = disagg.county_zscores(fx.vi_pixel(spark, d)).withColumn("score", disagg.vegetation_score(weights))
    return rounded(out.select("county_fips", "year", "row", "col", "score"), "score")


# --- gap filling -------------------------------------------------------------------------------

MONTHS = list(range(4, 12))
_SERIES = f"""SELECT l_partkey AS part, CAST(month(l_shipdate) AS INTEGER) AS month, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS v FROM lineitem WHERE month(l_shipdate) BETWEEN 4 AND 11 GROUP BY 1, 2"""
_FILL = """SELECT g.part, g.month, s.v, last_value(s.v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN s.v IS NOT NULL THEN g.month END IGNORE NULLS) OVER p AS t0,
 first_value(s.v IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN s.v IS NOT NULL THEN g.month END IGNORE NULLS) OVER n AS t1
 FROM (SELECT part, CAST(unnest(range(4, 12)) AS INTEGER) AS month FROM (SELECT DISTINCT part FROM series)) g LEFT JOIN series s ON s.part = g.part AND s.month = g.month
 WINDOW p AS (PARTITION BY g.part ORDER BY g.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY g.part ORDER BY g.month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
_WITH_FILL = f"WITH series AS ({_SERIES}), f AS ({_FILL}) "


def _fill(spark, d, policy):
    s = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.month("l_shipdate").alias("month"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("v"))
    return rounded(gapfill.fill_months(s, ["part"], "month", "v", MONTHS, policy), "v")


@check("W03_fill_linear", _WITH_FILL + f"""SELECT part, month, v IS NULL AS was_missing, {R('CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN coalesce(v1, 0) WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (month - t0) / (t1 - t0) END')} AS v FROM f""")
def w03(spark, d):
    return _fill(spark, d, "linear")


@check("W04_fill_nearest", _WITH_FILL + f"""SELECT part, month, v IS NULL AS was_missing, {R('CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN coalesce(v1, 0) WHEN v1 IS NULL THEN v0 WHEN month - t0 <= t1 - month THEN v0 ELSE v1 END')} AS v FROM f""")
def w04(spark, d):
    return _fill(spark, d, "nearest")


@check("W04b_fill_zero", _WITH_FILL + f"SELECT part, month, v IS NULL AS was_missing, {R('coalesce(v, 0)')} AS v FROM f")
def w04b(spark, d):
    return _fill(spark, d, "zero")


@check("W04c_fill_drop", _WITH_FILL + f"SELECT part, month, v IS NULL AS was_missing, {R('v')} AS v FROM f")
def w04c(spark, d):
    return _fill(spark, d, "drop")


# --- mosaics -----------------------------------------------------------------------------------

_MOS = """SELECT "row", col, year, lpad(CAST(scene_id AS VARCHAR), 6, '0') AS source, CASE WHEN ln <> 7 THEN nir END AS v FROM pixel"""


def _sources(spark, d):
    return fx.pixel(spark, d).select("row", "col", "year", F.lpad(F.col("scene_id").cast("string"), 6, "0").alias("source"), F.when(F.col("ln") != 7, F.col("nir")).alias("v"))


def _overlap_sql(agg: str) -> str:
    return with_("pixel", mos=_MOS) + f'SELECT "row", col, year, {agg} FROM mos WHERE v IS NOT NULL GROUP BY 1, 2, 3'


@check("W05_mosaic_first", _overlap_sql(f"{R('min(struct_pack(s := source, v := v)).v')} AS v, min(source) AS source"))
def w05(spark, d):
    return rounded(mosaic.overlap(_sources(spark, d), ["row", "col", "year"], "v", "source", "first"), "v")


@check("W05b_mosaic_last", _overlap_sql(f"{R('max(struct_pack(s := source, v := v)).v')} AS v, max(source) AS source"))
def w05b(spark, d):
    return rounded(mosaic.overlap(_sources(spark, d), ["row", "col", "year"], "v", "source", "last"), "v")


def _plain(method, agg):
    @check(f"W05_mosaic_{method}", _overlap_sql(agg))
    def run(spark, d):
        out = mosaic.overlap(_sources(spark, d), ["row", "col", "year"], "v", "source", method)
        return out if method == "count" else rounded(out, "v")


for _m in ("min", "max", "sum"):
    _plain(_m, f"{R(f'{_m}(v)')} AS v")
_plain("count", "count(v) AS v")

_HANN = "greatest(0.5 - 0.5 * cos(2 * pi() / 63 * {i}), 0.05)"


@check("A36_overlap_blend", with_("predictions", base="""SELECT year, "row", col, pred, unnest([0, 1]) AS i FROM predictions""", b2="SELECT *, unnest([0, 1]) AS j FROM base",
       t="""SELECT year, "row", col, pred, "row" - (floor("row" / 32) - i) * 32 AS tr, col - (floor(col / 32) - j) * 32 AS tc FROM b2 WHERE floor("row" / 32) - i >= 0 AND floor(col / 32) - j >= 0
 AND (floor("row" / 32) - i) * 32 + 64 <= 512 AND (floor(col / 32) - j) * 32 + 64 <= 512""", w=f"SELECT *, {_HANN.format(i='tr')} * {_HANN.format(i='tc')} AS w FROM t") +
       f"""SELECT year, "row", col, {R('sum(w * (pred + tr * 0.01)) / sum(w)')} AS v, {R('sum(w)')} AS weight FROM w GROUP BY 1, 2, 3""")
def a36(spark, d):
    p = fx.predictions(spark, d).select("year", "row", "col", "pred")
    both = F.array(F.lit(0), F.lit(1))
    t = p.withColumn("i", F.explode(both)).withColumn("j", F.explode(both)) \
        .withColumn("r0", (F.floor(F.col("row") / 32) - F.col("i")) * 32).withColumn("c0", (F.floor(F.col("col") / 32) - F.col("j")) * 32) \
        .filter("r0 >= 0 and c0 >= 0 and r0 + 64 <= 512 and c0 + 64 <= 512") \
        .withColumn("tile_row", F.col("row") - F.col("r0")).withColumn("tile_col", F.col("col") - F.col("c0")) \
        .withColumn("v", F.col("pred") + F.col("tile_row") * 0.01)
    return rounded(mosaic.blend(t, ["year", "row", "col"], "v", 64), "v", "weight")
