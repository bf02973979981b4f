"""Scoring chips, prediction surfaces, occlusion and augmentation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, targets
from .mosaic import overlap

Predictor = Callable[[np.ndarray], np.ndarray]


def linear_score(bands: Sequence[Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    """The default predictor: a linear model as plain columns."""
    out = F.lit(float(bias))
    for b, w in zip(bands, weights):
        out = out + b * F.lit(float(w))
    return out


def score_chips(chips: DataFrame, values: str, predictor: Predictor, keep: Sequence[str],
                rows_per_call: int = 256) -> DataFrame:
    """Score array-valued chips with any batch predictor: (n, k) in, (n, m) or (n,) out.

    Runs per Arrow batch inside tasks. Chips of many megabytes need a small
    ``spark.sql.execution.arrow.maxRecordsPerBatch``; the predictor itself sees at most
    ``rows_per_call`` chips at a time. All chips must have one length (see the integrity scan).
    """
    kept = chips.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["prediction array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), rows_per_call):
                part = pdf.iloc[start:start + rows_per_call]
                x = np.stack([np.asarray(v, dtype="float64") for v in part[values]])
                out = part[list(keep)].copy()
                out["prediction"] = list(np.asarray(predictor(x), dtype="float64").reshape(len(part), -1))
                yield out
    return chips.select(*keep, values).mapInPandas(run, schema)


def surfaces(pred: DataFrame, actual: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """Full prediction, and prediction, actual and residual on one shared footprint.

    Overlapping chips are resolved to the last chip by id. ``pred`` has (keys, sample_id,
    pred), ``actual`` (keys, label, crop_mask, n_valid_months).
    """
    one = overlap(pred, keys, "pred", "sample_id", "last")
    j = one.join(actual, keys, "left")
    on_crop = F.coalesce("crop_mask", F.lit(False))
    shared = targets.target_valid(F.col("crop_mask"), F.col("label"), F.col("n_valid_months"), k) & F.col("pred").isNotNull()
    return j.select(*keys, F.when(on_crop, F.col("pred")).alias("prediction_full"),
                    F.when(shared, F.col("pred")).alias("prediction"), F.when(shared, F.col("label")).alias("actual"),
                    F.when(shared, F.col("pred") - F.col("label")).alias("residual"), shared.alias("comparison_mask"))


def residuals(df: DataFrame, shared: Column, pred: str = "pred", target: str = "target") -> DataFrame:
    """Residual where both surfaces exist on the shared footprint, and the unrestricted one."""
    both = shared & F.col(pred).isNotNull() & F.col(target).isNotNull()
    return df.withColumn("prediction_full", F.col(pred)).withColumn("prediction", F.when(both, F.col(pred))) \
        .withColumn("actual", F.when(both, F.col(target))) \
        .withColumn("residual", F.when(both, F.col(pred) - F.col(target)))


def extreme_predictions(pixels: DataFrame, min_valid: float, crop: str, chip: int = geo.CHIP,
                        county: str = "county") -> DataFrame:
    """Pixels predicted below a limit, with chip, coordinates and county."""
    low = pixels.filter(F.col("pred") < min_valid)
    r0, c0 = geo.chip_of(F.col("row"), chip), geo.chip_of(F.col("col"), chip)
    x, y = geo.pixel_xy(F.col("row"), F.col("col"), *[F.col(k) for k in "abcdef"])
    lon, lat = geo.lonlat(x, y)
    return low.select(
        "row", "col", r0.alias("chip_row_off"), c0.alias("chip_col_off"),
        geo.sample_id(F.lit(crop), F.col("state"), F.col("year"), r0, c0).alias("sample_id"),
        F.col("pred").alias("predicted"), F.col("target").alias("actual"), lat.alias("lat"), lon.alias("lon"),
        F.coalesce(F.col(county), F.lit("OUTSIDE_COUNTIES")).alias("county"), "county_geoid")


def extreme_summary(extremes: DataFrame, by: str) -> DataFrame:
    return extremes.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.min("predicted").alias("min_pred"),
        F.avg("predicted").alias("mean_pred"), F.avg("actual").alias("mean_actual"))


def occlusion(chips: DataFrame, values: str, n_slices: int, score: Callable[[Column], Column],
              mask: Column, slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Change of the masked mean score when one slice (month or band) is set to zero.

    ``score`` maps the value array to a number; ``slice_of`` maps a position to its slice.
    With an empty mask the unmasked mean is used.
    """
    slice_of = slice_of or (lambda i: i)

    def without(s: int) -> Column:
        return F.transform(F.col(values), lambda v, i: F.when(slice_of(i) == s, F.lit(0.0)).otherwise(v))
    # one row carries all occluded scores, so chips are read once and never multiplied
    variants = [score(F.col(values)), *[score(without(s)) for s in range(n_slices)]]

    def mean(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(mask, c)), F.avg(c))
    row = chips.agg(*[mean(v).alias(f"_{i}") for i, v in enumerate(variants)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("slice"), F.abs(F.col(f"_{s + 1}") - F.col("_0")).alias("delta"))
        for s in range(n_slices)])).alias("_d")).select("_d.*")


def unit_hash(seed: int, salt: str, key: Column) -> Column:
    """Reproducible number in [0, 1) from (seed, salt, key)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key)), 1, 8), 16, 10) \
        .cast("double") / F.lit(4294967296.0)


def augment(pixels: DataFrame, sample: str, height: int, width: int, seed: int, bands: Sequence[str],
            hflip_p: float = 0.5, vflip_p: float = 0.5, noise_p: float = 0.0, noise_std: float = 0.0) -> DataFrame:
    """Mirror whole samples and add band noise.

    The flip is one decision per sample, so bands, months, labels and masks move together;
    noise touches bands only and is a hash-driven normal draw.
    """
    key = F.col(sample).cast("string")
    flip_w, flip_h = unit_hash(seed, "w", key) < hflip_p, unit_hash(seed, "h", key) < vflip_p
    out = pixels.withColumn("_r", F.when(flip_h, F.lit(height - 1) - F.col("row")).otherwise(F.col("row"))) \
                .withColumn("_c", F.when(flip_w, F.lit(width - 1) - F.col("col")).otherwise(F.col("col")))
    if noise_p > 0 and noise_std > 0:
        noisy = unit_hash(seed, "n", key) < noise_p
        where = F.concat_ws("|", key, F.col("row").cast("string"), F.col("col").cast("string"))
        for b in bands:
            u1 = F.greatest(unit_hash(seed, b + "1", where), F.lit(1e-12))
            u2 = unit_hash(seed, b + "2", where)
            normal = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * np.pi) * u2)
            out = out.withColumn(b, F.when(noisy, F.col(b) + F.lit(noise_std) * normal).otherwise(F.col(b)))
    return out.drop("row", "col").withColumnRenamed("_r", "row").withColumnRenamed("_c", "col")
