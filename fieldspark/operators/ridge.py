"""Ridge regression on standardised features from mergeable statistics.

One pass over the training rows yields counts, means and centred cross products
per group (year). Any fold is a combination of those few rows; only the p x p
solve runs in Python, inside tasks, one fold per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import is_observed, ratio
from ..plans import materialise, sized_join
from .disagg import STRENGTH, WEIGHT_MAX, WEIGHT_MIN

ALPHA = 1.0


def _pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def complete_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with a finite value in every one of ``names``."""
    ok = F.lit(True)
    for c in names:
        ok = ok & is_observed(F.col(c))
    return df.filter(ok)


def group_statistics(df: DataFrame, features: Sequence[str], target: str, group: str) -> DataFrame:
    """n, means and centred cross products of features and target per group, over complete rows."""
    names = [*features, target]
    return complete_rows(df, names).groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names],
        *[(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"cp_{a}__{b}") for a, b in _pairs(names)])


def combine(stats: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Merge group statistics: means by weight, cross products with the between-group part.

    A second look at the few group rows keeps the sums centred on the merged mean.
    """
    names = [*features, target]
    keys = list(keys)
    means = stats.groupBy(*keys).agg(
                *[ratio(F.sum(F.col("n") * F.col(f"mean_{c}")), F.sum("n")).alias(f"all_{c}") for c in names])
    both = stats.join(means, keys)

    def moved(a: str, b: str) -> Column:
        da, db = (F.col(f"mean_{c}") - F.col(f"all_{c}") for c in (a, b))
        return F.sum(F.col(f"cp_{a}__{b}") + F.col("n") * da * db).alias(f"cp_{a}__{b}")
    return both.groupBy(*keys).agg(
        F.sum("n").alias("n"), *[F.min(f"all_{c}").alias(f"mean_{c}") for c in names],
        *[moved(a, b) for a, b in _pairs(names)])


def solve(stats: DataFrame, features: Sequence[str], target: str, keys: Sequence[str],
          alpha: float = ALPHA) -> DataFrame:
    """Coefficients on population-standardised features, one row per fold and feature."""
    features, keys = list(features), list(keys)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stats.select(*keys).schema]
                       + ["feature string, ridge_coef_standardized double, x_mean double, "
                          "x_std double, ridge_intercept double, n_rows double"])

    def solve_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                n = rec["n"]
                sd = np.sqrt(np.array([rec[f"cp_{f}__{f}"] for f in features]) / n)
                sd = np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
                gram = np.zeros((len(features), len(features)))
                for i, a in enumerate(features):
                    for j in range(i, len(features)):
                        gram[i, j] = gram[j, i] = rec[f"cp_{a}__{features[j]}"] / (sd[i] * sd[j])
                zy = np.array([rec[f"cp_{f}__{target}"] for f in features]) / sd
                w = np.linalg.solve(gram + alpha * np.eye(len(features)), zy)
                for i, f in enumerate(features):
                    rows.append([rec[k] for k in keys] + [f, w[i], rec[f"mean_{f}"], sd[i],
                                                          rec[f"mean_{target}"], n])
            yield pd.DataFrame(rows, columns=[*keys, "feature", "ridge_coef_standardized", "x_mean",
                                              "x_std", "ridge_intercept", "n_rows"])

    return stats.mapInPandas(solve_rows, schema)


def fit(df: DataFrame, features: Sequence[str], target: str, group: str = "year",
        alpha: float = ALPHA) -> DataFrame:
    """Coefficient table of one fit over all rows."""
    stats = group_statistics(df, features, target, group)
    total = combine(stats.withColumn("_all", F.lit(1)), features, target, ["_all"])
    return solve(total, features, target, ["_all"], alpha).drop("_all")


def predict(df: DataFrame, coefficients: DataFrame, features: Sequence[str], target: str,
            keys: Sequence[str] = ()) -> DataFrame:
    """Rows with ``predicted`` and ``residual``; ``keys`` pick the fold of each row."""
    keys = list(keys)
    terms = [F.sum(F.when(F.col("feature") == f, F.col(c))).alias(f"{p}_{f}")
             for f in features for p, c in (("w", "ridge_coef_standardized"), ("m", "x_mean"), ("s", "x_std"))]
    wide = coefficients.groupBy(*keys).agg(F.min("ridge_intercept").alias("_b"), *terms)
    if keys:
        joined = sized_join(df, wide, keys)
    else:
        one = wide.first()
        joined = df.withColumns({c: F.lit(one[c]) for c in wide.columns})
    pred = F.col("_b")
    for f in features:
        pred = pred + F.col(f"w_{f}") * (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")
    return joined.withColumn("predicted", pred).withColumn("residual", F.col(target) - F.col("predicted")) \
        .drop("_b", *[f"{p}_{f}" for f in features for p in "wms"])


def leave_one_out_folds(df: DataFrame, features: Sequence[str], target: str, group: str = "year",
                        alpha: float = ALPHA) -> DataFrame:
    """Coefficients of every fold, keyed by the held-out group.

    A fold is the total with one group taken out again, so the cost is one row per group.
    """
    names = [*features, target]
    stats = materialise(group_statistics(df, features, target, group), "group_statistics")
    total = combine(stats.withColumn("_all", F.lit(1)), features, target, ["_all"]).first()
    n_fold = F.lit(total["n"]) - F.col("n")
    rest = {c: (F.lit(total["n"] * total[f"mean_{c}"]) - F.col("n") * F.col(f"mean_{c}")) / n_fold
            for c in names}
    weight = n_fold * F.col("n") / F.lit(total["n"])
    folds = stats.filter(n_fold > 0).select(
        F.col(group).alias("held_out"), n_fold.alias("n"),
        *[rest[c].alias(f"mean_{c}") for c in names],
        *[(F.lit(total[f"cp_{a}__{b}"]) - F.col(f"cp_{a}__{b}")
           - weight * (rest[a] - F.col(f"mean_{a}")) * (rest[b] - F.col(f"mean_{b}"))).alias(f"cp_{a}__{b}")
          for a, b in _pairs(names)])
    return solve(folds, features, target, ["held_out"], alpha)


def leave_one_out_scores(df: DataFrame, features: Sequence[str], target: str, group: str = "year",
                         alpha: float = ALPHA) -> DataFrame:
    """R2 and MAE of each held-out group under a model fitted without it."""
    folds = leave_one_out_folds(df, features, target, group, alpha).withColumnRenamed("held_out", group)
    scored = predict(complete_rows(df, [*features, target]), folds, features, target, [group])
    return scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("residual")).alias("mae"),
        (F.lit(1.0) - ratio(F.avg(F.col("residual") ** 2), F.var_pop(target))).alias("r2"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and median over folds; one row per fold goes in."""
    return scores.agg(F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"),
                      F.avg("mae").alias("mean_mae"), F.median("mae").alias("median_mae"))


def safe_correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson r; NULL for fewer than two rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.when(F.count(a) >= 2, r)


def fit_quality(df: DataFrame, target: str = "target", pred: str = "predicted") -> DataFrame:
    e = F.col(target) - F.col(pred)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                  (F.lit(1.0) - ratio(F.avg(e * e), F.var_pop(target))).alias("r2"),
                  safe_correlation(F.col(target), F.col(pred)).alias("corr"))


def normalise_weights(coefficients: DataFrame, nonnegative: bool = False) -> DataFrame:
    """Coefficients divided by the sum of their absolute values; an all-zero table is an error."""
    w = F.col("ridge_coef_standardized")
    w = F.greatest(w, F.lit(0.0)) if nonnegative else w
    raw = coefficients.withColumn("_w", w)
    total = raw.agg(F.sum(F.abs("_w")).alias("t")).first()["t"]
    if not total:
        raise ValueError("all coefficients are zero; weights cannot be normalised")
    return raw.withColumn("gee_weight_normalized", F.col("_w") / F.lit(total)).drop("_w")


def coefficient_table(coefficients: DataFrame, alpha: float = ALPHA, nonnegative: bool = False, strength: float = STRENGTH,
                      weight_min: float = WEIGHT_MIN, weight_max: float = WEIGHT_MAX, min_valid_fraction: float | None = None,
                      min_crop_pixels: int | None = None) -> DataFrame:
    """The table that a fit hands on: a row per feature with its weights and every setting that made or will use them.

    A job that spreads yields by these weights reads strength and limits from here, so fit
    and use cannot disagree; ``settings_of`` returns them and refuses mixed tables.
    """
    settings = {"ridge_alpha": F.lit(float(alpha)), "force_nonnegative_weights": F.lit(nonnegative),
                "redist_strength": F.lit(float(strength)), "raw_weight_min": F.lit(float(weight_min)),
                "raw_weight_max": F.lit(float(weight_max)), "min_valid_pixel_fraction": F.lit(min_valid_fraction).cast("double"),
                "min_crop_pixel_count": F.lit(min_crop_pixels).cast("long")}
    return normalise_weights(coefficients, nonnegative).select(
        "feature", "ridge_coef_standardized", "gee_weight_normalized", "x_mean", "x_std", "ridge_intercept",
        *[c.alias(n) for n, c in settings.items()])


def settings_of(table: DataFrame) -> dict:
    """Settings of a coefficient table; one made from several runs is refused."""
    names = ["ridge_alpha", "force_nonnegative_weights", "redist_strength", "raw_weight_min", "raw_weight_max",
             "min_valid_pixel_fraction", "min_crop_pixel_count"]
    rows = table.select(*names).distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a coefficient table needs exactly one set of settings")
    return rows[0].asDict()
