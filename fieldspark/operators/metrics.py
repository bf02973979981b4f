"""Masked regression metrics at every level, from mergeable aggregates."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import ratio
from ..plans import grouped_percentiles, materialise

METRICS = ("n", "mae", "rmse", "bias", "r2", "pearson_r", "pearson_r2", "pct_mae")


def _aggregates(pred: Column, target: Column) -> list[Column]:
    e = pred - target
    both = e.isNotNull()
    p, t = F.when(both, pred), F.when(both, target)
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("_mse"), F.avg(e).alias("bias"),
            F.var_pop(t).alias("_vt"), F.var_pop(p).alias("_vp"), F.covar_pop(p, t).alias("_cpt"),
            F.avg(F.abs(t)).alias("_abs_t")]


def _finish(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    r = F.when(F.col("n") > 1, ratio(F.col("_cpt"), F.sqrt(F.col("_vp")) * F.sqrt(F.col("_vt"))))
    out = df.withColumn("rmse", F.sqrt("_mse")) \
        .withColumn("r2", F.lit(1.0) - ratio(F.col("_mse"), F.col("_vt"))) \
        .withColumn("pearson_r", r).withColumn("pearson_r2", F.col("pearson_r") * F.col("pearson_r")) \
        .withColumn("pct_mae", F.when(F.col("_abs_t") > 0, F.col("mae") / F.col("_abs_t") * 100.0))
    return out.select(*keep, *METRICS)


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred", target: str = "target",
                       mask: Column | None = None) -> DataFrame:
    """n, MAE, RMSE, bias, R2 about the 1:1 line, Pearson r, r2 and percent MAE per group.

    Undefined values are NULL. Variances are built-in merging aggregates, so the sums are
    centred and a hot group is reduced map-side.
    """
    live = df.filter(mask) if mask is not None else df
    return _finish(live.groupBy(*keys).agg(*_aggregates(F.col(pred), F.col(target))), list(keys))


def _partials(df: DataFrame, keys: Sequence[str], pred: str, target: str) -> DataFrame:
    return df.groupBy(*keys).agg(*_aggregates(F.col(pred), F.col(target)),
                                 F.avg(pred).alias("_mp"), F.avg(target).alias("_mt"))


def multi_level(df: DataFrame, levels: dict[str, Sequence[str]], pred: str = "pred",
                target: str = "target") -> DataFrame:
    """Pixel-weighted metrics at several levels from one pass over the pixels.

    Pixels are reduced once to the finest key set. Every level then takes its means from those
    few rows, joins them back and sums spreads about the level's own mean, so nothing large
    cancels. A side that is constant over a level has no spread at all.
    """
    dims = sorted({c for cols in levels.values() for c in cols})
    p, t = F.col(pred), F.col(target)
    live = df.filter(p.isNotNull() & t.isNotNull())
    fine = materialise(live.groupBy(*dims).agg(
        *_aggregates(p, t), F.avg(pred).alias("_mp"), F.avg(target).alias("_mt"),
        F.min(p).alias("_lp"), F.max(p).alias("_hp"), F.min(t).alias("_lt"), F.max(t).alias("_ht")), "metric_partials")
    at = F.explode(F.array(*[
        F.struct(F.lit(name).alias("level"), *[
            (F.col(c) if c in cols else F.lit(None).cast(fine.schema[c].dataType)).alias(f"_at_{c}") for c in dims])
        for name, cols in levels.items()])).alias("_at")
    each = fine.select(*[c for c in fine.columns if c not in dims], at).select("*", "_at.*").drop("_at")
    keys = ["level", *[f"_at_{c}" for c in dims]]

    def mean(c: str) -> Column:
        return F.sum(F.col("n") * F.col(c)) / F.sum("n")
    centre = each.groupBy(*keys).agg(mean("_mp").alias("_cp"), mean("_mt").alias("_ct")) \
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cp", "_ct")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    dp, dt = F.col("_mp") - F.col("_cp"), F.col("_mt") - F.col("_ct")
    n = F.col("n")
    merged = each.join(centre, same).groupBy(*keys).agg(
        F.sum("n").alias("total"), *[mean(c).alias(f"w{c}") for c in ("mae", "_mse", "bias", "_abs_t")],
        (F.sum(n * (F.col("_vp") + dp * dp)) / F.sum(n)).alias("w_vp"),
        (F.sum(n * (F.col("_vt") + dt * dt)) / F.sum(n)).alias("w_vt"),
        (F.sum(n * (F.col("_cpt") + dp * dt)) / F.sum(n)).alias("w_cpt"),
        (F.min("_lp") == F.max("_hp")).alias("_flat_p"), (F.min("_lt") == F.max("_ht")).alias("_flat_t"))
    flat = F.col("_flat_p") | F.col("_flat_t")
    return _finish(merged.select(
        "level", *[F.col(f"_at_{c}").alias(c) for c in dims], F.col("total").alias("n"), F.col("wmae").alias("mae"),
        F.col("w_mse").alias("_mse"), F.col("wbias").alias("bias"), F.col("w_abs_t").alias("_abs_t"),
        F.when(F.col("_flat_p"), 0.0).otherwise(F.col("w_vp")).alias("_vp"),
        F.when(F.col("_flat_t"), 0.0).otherwise(F.col("w_vt")).alias("_vt"),
        F.when(flat, 0.0).otherwise(F.col("w_cpt")).alias("_cpt")), ["level", *dims])


def macro_average(per_group: DataFrame, metrics: Sequence[str] = ("mae", "rmse", "r2", "pearson_r")) -> DataFrame:
    return per_group.agg(*[F.avg(m).alias(f"macro_{m}") for m in metrics])


def chip_metrics(df: DataFrame, keys: Sequence[str] = ("sample_id", "state", "year"), pred: str = "pred",
                 target: str = "target", mask: Column | None = None) -> DataFrame:
    """Per-chip metrics with mean prediction and target; chips without a valid pixel are absent."""
    live = df.filter(F.col(pred).isNotNull() & F.col(target).isNotNull())
    live = live.filter(mask) if mask is not None else live
    part = _partials(live, keys, pred, target)
    out = _finish(part, [*keys, "_mp", "_mt"])
    return out.select(*keys, F.col("_mp").alias("pred"), F.col("_mt").alias("target"),
                      *[F.col(m).alias(f"chip_{m}") for m in METRICS])


# P(X <= k) of the Poisson distribution with mean one, k = 0..15.
POISSON_ONE = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(16))


def bootstrap_ci(df: DataFrame, group: str, metric: str = "rmse", n_boot: int = 1000, seed: int = 0,
                 alpha: float = 0.05) -> DataFrame:
    """Mean and percentile interval of a metric under resampling of whole groups.

    In every replicate a group counts as often as a Poisson(1) draw from a hash of (seed,
    replicate, group), the form of resampling with replacement that needs no common
    numbering: groups are neither indexed nor joined with draws, and each task sends one
    pair of sums per replicate. The result does not depend on partitioning.
    """
    per = regression_metrics(df, [group]).select(F.col(group).cast("string").alias("_g"), F.col(metric).alias("_m"))
    drawn = per.filter(F.col("_m").isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), "_g"))
    u = F.conv(F.substring(text, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    times = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON_ONE), F.lit(0))
    stat = drawn.withColumn("_w", times).groupBy("rep").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("_m")), F.sum("_w")).alias("stat"))
    # n_boot rows from here on
    return stat.agg(F.avg("stat").alias("mean"), F.percentile("stat", F.lit(alpha / 2)).alias("lo"),
                    F.percentile("stat", F.lit(1 - alpha / 2)).alias("hi"), F.count(F.lit(1)).alias("n_boot"))


def field_means(pixels: DataFrame, field: str = "field_id", pred: str = "pred", actual: str = "actual",
                min_px: int = 5) -> DataFrame:
    """Mean prediction and measurement per field with enough comparable pixels."""
    ok = F.col(pred).isNotNull() & F.col(actual).isNotNull() & (F.col(field) > 0)
    return pixels.filter(ok).groupBy(field).agg(
        F.count(F.lit(1)).alias("n_px"), F.avg(pred).alias("pred_mean"), F.avg(actual).alias("actual_mean")) \
        .filter(F.col("n_px") >= min_px).withColumn("residual", F.col("pred_mean") - F.col("actual_mean"))


def field_summary(fields: DataFrame) -> DataFrame:
    """r, bias, RMSE over fields against the best constant, with the spread ratio."""
    p, a = F.col("pred_mean"), F.col("actual_mean")
    out = fields.agg(
        F.count(F.lit(1)).alias("n_fields"),
        ratio(F.covar_pop(p, a), F.stddev_pop(p) * F.stddev_pop(a)).alias("pearson_r"),
        (F.avg(p) - F.avg(a)).alias("bias"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.stddev_pop(a).alias("constant_rmse"), ratio(F.stddev_pop(p), F.stddev_pop(a)).alias("spread_ratio"))
    return out.withColumn("beats_constant", F.col("rmse") < F.col("constant_rmse"))


def compare_runs(df: DataFrame, run: str = "run_id", pred: str = "pred", target: str = "target") -> DataFrame:
    """One row per run with its prediction spread relative to the truth."""
    base = regression_metrics(df, [run], pred, target)
    spread = df.groupBy(run).agg(
        F.avg(pred).alias("pred_mean"), F.avg(target).alias("target_mean"),
        F.stddev_pop(pred).alias("pred_std"), F.stddev_pop(target).alias("target_std"))
    out = base.join(spread, run).withColumn("spread_ratio", ratio(F.col("pred_std"), F.col("target_std")))
    return out.withColumn("verdict", F.when(F.col("spread_ratio") < 0.9, F.lit("compressed"))
                          .when(F.col("spread_ratio").isNotNull(), F.lit("comparable")))


def residual_histogram(df: DataFrame, lo: float, hi: float, bins: int = 60, pred: str = "pred",
                       target: str = "target") -> DataFrame:
    """Counts of pred - target in equal bins; the last bin is closed on the right."""
    r = F.col(pred) - F.col(target)
    b = F.when(r == hi, F.lit(bins)).otherwise(F.width_bucket(r, F.lit(lo), F.lit(hi), F.lit(bins)))
    return df.filter(r.isNotNull() & (r >= lo) & (r <= hi)).groupBy(b.cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))


def residual_range(df: DataFrame, pred: str = "pred", target: str = "target") -> tuple[float, float]:
    row = df.agg(F.min(F.col(pred) - F.col(target)).alias("lo"), F.max(F.col(pred) - F.col(target)).alias("hi")).first()
    return row["lo"], row["hi"]


def density(df: DataFrame, step: float, pred: str = "pred", target: str = "target") -> DataFrame:
    """Binned observed-against-predicted counts."""
    return df.groupBy(F.floor(F.col(target) / step).cast("int").alias("target_bin"),
                      F.floor(F.col(pred) / step).cast("int").alias("pred_bin")).agg(F.count(F.lit(1)).alias("n"))


def residual_limit(df: DataFrame, keys: Sequence[str], pred: str = "pred", target: str = "target",
                   fraction: float = 0.98) -> DataFrame:
    """Symmetric colour limit: a high percentile of the absolute residual."""
    r = df.withColumn("_r", F.abs(F.col(pred) - F.col(target)))
    return grouped_percentiles(r, keys, {"limit": ("_r", fraction)})
