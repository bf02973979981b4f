"""Quality profiles of label rasters and multi-band tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans import grouped_percentiles

# Expected grid and the low-coverage limit in percent.
TARGET_CRS, TARGET_RES, MIN_VALID_PCT = "EPSG:5070", 30.0, 0.1


def label_profile(pixels: DataFrame, grids: DataFrame, key: str = "raster_id", value: str = "value") -> DataFrame:
    """Counts, percentiles, moments and grid checks per raster. Absent rows are nodata."""
    wanted = {"p25": (value, .25), "median": (value, .5), "p75": (value, .75)}
    stats = grouped_percentiles(pixels, [key], wanted, also=[
        F.count(value).alias("valid_px"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")])
    out = grids.join(stats, key, "left") \
        .withColumn("valid_px", F.coalesce("valid_px", F.lit(0))) \
        .withColumn("total_px", F.col("height").cast("long") * F.col("width"))
    out = out.withColumn("nodata_px", F.col("total_px") - F.col("valid_px")) \
        .withColumn("pct_valid", F.bround(F.lit(100.0) * F.col("valid_px") / F.col("total_px"), 4)) \
        .withColumns({c: F.bround(c, 3) for c in ("min", "p25", "median", "p75", "max", "mean", "std")}) \
        .withColumn("res_m", F.abs("a"))
    return out.withColumn("crs_ok", F.col("crs") == TARGET_CRS) \
        .withColumn("res_ok", F.abs(F.col("res_m") - TARGET_RES) < 1)


def quality_flags(profile: DataFrame, key: str = "raster_id") -> DataFrame:
    """One (raster, reason) row per failed check, in a single pass over the profile."""
    reasons = F.filter(F.array(
        F.when(F.col("pct_valid") < MIN_VALID_PCT, F.lit("low_valid")),
        F.when(F.col("valid_px") == 0, F.lit("empty")),
        F.when(~F.col("crs_ok"), F.lit("crs")), F.when(~F.col("res_ok"), F.lit("resolution"))),
        lambda r: r.isNotNull())
    return profile.select(key, F.explode(reasons).alias("reason"))


def profile_summary(profile: DataFrame, keys: Sequence[str] = ("year", "variant")) -> DataFrame:
    cols = ["valid_px", "mean", "std", "pct_valid"]
    return profile.groupBy(*keys).agg(*[F.bround(F.avg(c), 2).alias(c) for c in cols])


def band_report(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Per band: total, valid, missing, min, max, mean, median, std, 2nd and 98th percentile.

    Moments come from one aggregate over the wide rows; nothing is unpivoted.
    """
    aggs = [F.count(F.lit(1)).alias("_total")]
    for b in bands:
        aggs += [F.count(b).alias(f"{b}__n"), F.min(b).alias(f"{b}__min"), F.max(b).alias(f"{b}__max"),
                 F.avg(b).alias(f"{b}__mean"), F.stddev_pop(b).alias(f"{b}__std")]
    wanted = {f"{b}__{n}": (b, p) for b in bands for n, p in (("median", .5), ("p02", .02), ("p98", .98))}
    one = grouped_percentiles(pixels, [], wanted, also=aggs)
    rows = one.select(F.explode(F.array(*[F.struct(
        F.lit(b).alias("band"), F.col("_total").alias("total_px"), F.col(f"{b}__n").alias("valid_px"),
        (F.col("_total") - F.col(f"{b}__n")).alias("missing_px"),
        *[F.col(f"{b}__{s}").cast("double").alias(s)
          for s in ("min", "max", "mean", "median", "std", "p02", "p98")]) for b in bands])).alias("_b"))
    return rows.select("_b.*")


def chip_integrity(chips: DataFrame, values: str, expected: int, sample: str) -> DataFrame:
    """Verdict per chip read: missing, wrong size, non-finite values, or ok."""
    bad_value = F.exists(F.col(values), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return chips.withColumn("status", F.when(F.col(values).isNull(), F.lit("missing"))
                            .when(F.size(values) != expected, F.lit("bad_size"))
                            .when(bad_value, F.lit("non_finite")).otherwise(F.lit("ok"))) \
        .select(sample, *[c for c in chips.columns if c not in (sample, values)], "status")


def integrity_report(checked: DataFrame, file: str, sample: str) -> DataFrame:
    """Reads, bad reads and distinct affected chips per file."""
    bad = F.col("status") != "ok"
    per_chip = checked.groupBy(file, sample).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("b"))
    return per_chip.groupBy(file).agg(
        F.sum("n").alias("window_reads"), F.sum("b").alias("bad_reads"),
        F.count(F.when(F.col("b") > 0, 1)).alias("affected_chips"))


def planned_report(reads: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Per file of a windowed scan: its state, planned and bad reads, their share, chips they hit.

    A file that is missing or unreadable counts as one finding; its windows are not bad reads.
    """
    bad = F.col("status") == "corrupt"
    per_chip = reads.groupBy("file", sample).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("b"),
        F.bool_or(F.col("status") == "missing").alias("gone"), F.bool_or(F.col("status") == "unreadable").alias("shut"))
    out = per_chip.groupBy("file").agg(
        F.sum("n").alias("window_reads"), F.sum("b").alias("bad_reads"), F.count(F.when(F.col("b") > 0, 1)).alias("affected_chips"),
        F.bool_or("gone").alias("gone"), F.bool_or("shut").alias("shut"))
    state = F.when(F.col("gone"), "missing").when(F.col("shut"), "unreadable").when(F.col("bad_reads") > 0, "corrupt").otherwise("ok")
    return out.select("file", state.alias("state"), "window_reads", "bad_reads",
                      (F.lit(100.0) * F.col("bad_reads") / F.col("window_reads")).alias("bad_pct"), "affected_chips")


def affected_samples(reads: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Distinct chips with a corrupt window, with the number of files in which it is: the list to exclude."""
    return reads.filter(F.col("status") == "corrupt").groupBy(sample).agg(F.countDistinct("file").alias("files"))
