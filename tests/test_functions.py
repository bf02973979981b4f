"""Scalar rules: codes, NULL handling, masks, indices, dates, projection."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import codes, dates, geo, nulls, scaling, spectral, targets


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def values(spark, data, schema, **cols):
    return [row.asDict() for row in spark.createDataFrame(data, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_codes_are_padded_but_never_cut(spark):
    got = values(spark, [("1001",), ("1001.0",), (" 01001 ",), ("123456",), (None,)], "c string", v=codes.clean_fips(F.col("c")))
    assert [g["v"] for g in got] == ["01001", "01001", "01001", "123456", None]


def test_survey_numbers(spark):
    got = values(spark, [("1,234.5",), ("(D)",), ("",), (None,)], "c string", v=codes.parse_number(F.col("c")))
    assert [g["v"] for g in got] == [1234.5, None, None, None]


def test_unit_factor_rounds_half_to_even(spark):
    got = values(spark, [(1.0, "soybeans"), (2.0, "Corn"), (1.0, "rice")], "v double, crop string", k=codes.to_kg_ha(F.col("v"), F.col("crop")))
    assert [g["k"] for g in got] == [67.251, 125.54, None]


def test_clip_keeps_missing(spark):
    got = values(spark, [(None,), (0.1,), (9.0,), (1.2,)], "v double", k=nulls.clip(F.col("v"), 0.5, 1.5))
    assert [g["k"] for g in got] == [None, 0.5, 1.5, 1.2]


def test_sentinel_and_non_finite_become_null(spark):
    got = values(spark, [(-9999.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (3.0,)], "v double", k=nulls.to_null(F.col("v")))
    assert [g["k"] for g in got] == [None, None, None, None, 3.0]


@pytest.mark.parametrize("strict,water", [(True, False), (False, False), (True, True)])
def test_clear_mask_truth_table(spark, strict, water):
    got = spark.range(256).select("id", spectral.clear_mask(F.col("id").cast("int"), strict, strict, water).alias("k")).collect()
    for row in got:
        q = row["id"]
        bits = [1, 3, 4] + ([2] if strict else []) + ([5] if water else [])
        bad = q == 255 or any(q >> b & 1 for b in bits) or (strict and (q >> 6) & 3 == 3)
        assert row["k"] == (not bad), q


def test_missing_quality_byte_is_not_clear(spark):
    assert one(spark, k=spectral.clear_mask(F.lit(None).cast("int")))["k"] is False


def test_index_guards(spark):
    rows = [(0.05, 0.1, 0.1, 0.5, 0.2), (0.05, 0.01, 0.1, 0.5, 0.2), (0.05, 0.1, 0.0, 0.0, 0.0), (0.05, 0.1, 0.1, 1.3, 0.2)]
    c = F.col
    vi = spectral.vegetation_indices(c("b"), c("g"), c("r"), c("n"), c("s"), F.lit(True))
    got = values(spark, rows, "b double, g double, r double, n double, s double", **vi)
    assert math.isclose(got[0]["NDVI"], 0.4 / 0.6) and math.isclose(got[0]["GCVI"], 4.0)
    assert math.isclose(got[0]["EVI"], 2.5 * 0.4 / (0.5 + 0.6 - 0.375 + 1)) and math.isclose(got[0]["NDWI"], 0.3 / 0.7)
    assert got[1]["GCVI"] is None and got[1]["NDVI"] is not None
    assert got[2]["NDVI"] is None and got[2]["NDWI"] is None and got[2]["EVI"] is not None
    assert all(v is None for v in got[3].values())


def test_target_mask_cases(spark):
    rows = [(True, 10.0, 1), (True, None, 1), (True, 12.0, 0), (False, 13.0, 1), (True, -9999.0, 1), (True, 42.0, 1), (None, 1.0, 1)]
    got = values(spark, rows, "crop boolean, label double, m int", k=targets.target_valid(F.col("crop"), F.col("label"), F.col("m")))
    assert [g["k"] for g in got] == [True, False, False, False, False, True, False]


def test_scaler_round_trip(spark):
    z = scaling.target_scale(F.col("y"), "zscore", F.lit(3000.0), F.lit(400.0))
    got = values(spark, [(2600.0,), (3000.0,), (3400.0,)], "y double", z=z, back=scaling.target_inverse(z, "zscore", F.lit(3000.0), F.lit(400.0)))
    assert [g["z"] for g in got] == [-1.0, 0.0, 1.0] and [g["back"] for g in got] == [2600.0, 3000.0, 3400.0]


def test_band_constants():
    assert spectral.BAND_ORDER == ("BLUE", "GREEN", "RED", "NIR_NARROW", "SWIR1", "SWIR2")
    assert len(scaling.OFFICIAL_BAND_MEAN) == len(scaling.OFFICIAL_BAND_STD) == 6


def test_unknown_sensor_raises(spark):
    df = spark.createDataFrame([("X", None)], "id string, c string")
    with pytest.raises(Exception, match="cannot identify sensor"):
        df.select(spectral.sensor_of(F.col("id"), F.col("c"))).collect()


def test_season_windows(spark):
    got = one(spark, a=dates.month_end(F.lit(2020), F.lit(11)), b=dates.month_end(F.lit(2020), F.lit(2)), n=F.size(dates.representative_dates(F.lit(2021), 3)),
              i=dates.in_season(F.lit("2020-11-15").cast("date")), o=dates.in_season(F.lit("2020-11-16").cast("date")))
    assert got == {"a": dt.date(2020, 11, 15), "b": dt.date(2020, 2, 29), "n": 3, "i": True, "o": False}


def test_projection_origin_and_symmetry(spark):
    lon, lat = geo.lonlat(F.lit(0.0), F.lit(0.0))
    got = one(spark, lon=lon, lat=lat)
    assert abs(got["lon"] + 96) < 1e-9 and abs(got["lat"] - 23) < 1e-7
    e, w = geo.lonlat(F.lit(5e5), F.lit(1.5e6)), geo.lonlat(F.lit(-5e5), F.lit(1.5e6))
    got = one(spark, a=e[0], b=w[0], c=e[1], d=w[1])
    assert abs((got["a"] + got["b"]) / 2 + 96) < 1e-9 and abs(got["c"] - got["d"]) < 1e-12


def test_projection_inverts_the_forward_formula(spark):
    k = geo.albers_constants()
    for lon, lat in ((-75.5, 39.0), (-100.2, 45.1), (-96.0, 31.0)):
        q = geo._q(math.radians(lat))
        rho, theta = geo.A_AXIS * math.sqrt(k["c"] - k["n"] * q) / k["n"], k["n"] * math.radians(lon - geo.LON0)
        x, y = geo.lonlat(F.lit(rho * math.sin(theta)), F.lit(k["rho0"] - rho * math.cos(theta)))
        got = one(spark, lon=x, lat=y)
        assert abs(got["lon"] - lon) < 1e-9 and abs(got["lat"] - lat) < 1e-7


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 0.0, True), (0.5, 0.0, True), (3.0, 0.0, True), (100.0, 0.0, False)], "p double, t double, m boolean")
    got = df.agg(*[targets.masked_mean(targets.loss_term(n, F.col("p"), F.col("t"), log_var=F.lit(0.0)), F.col("m")).alias(n)
                   for n in ("mse", "mae", "huber", "gaussian")]).first()
    assert math.isclose(got["mse"], 9.25 / 3) and math.isclose(got["mae"], 3.5 / 3)
    assert math.isclose(got["huber"], (0.125 + 2.5) / 3) and math.isclose(got["gaussian"], 9.25 / 6)
    assert df.agg(targets.masked_mean(targets.loss_term("mse", F.col("p"), F.col("t")), F.lit(False)).alias("z")).first()["z"] == 0.0


def test_hann_matches_numpy(spark):
    got = [row["w"] for row in spark.range(64).select("id", geo.hann(F.col("id"), 64).alias("w")).orderBy("id").collect()]
    assert np.allclose(got, np.clip(np.hanning(64), 0.05, None))
