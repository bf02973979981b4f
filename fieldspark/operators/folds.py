"""Year-based folds, leakage audits and train-only statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import ratio, spread_or_one
from ..functions.scaling import band_std
from ..plans import grouped_percentiles, sized_join



def _years_array(years: DataFrame) -> DataFrame:
    return years.agg(F.sort_array(F.collect_set(F.col("year").cast("int"))).alias("_years"))


def make_folds(years: DataFrame, policy: str = "previous_year", split_map: DataFrame | None = None,
               pool: Sequence[int] = (), on_error: str = "raise") -> DataFrame:
    """One fold per year: test_year, val_years, train_years (disjoint).

    ``explicit_map`` reads (test_year, val_years) from ``split_map``; ``fixed_pool`` uses
    ``pool`` without the test year; ``previous_year`` the year before, else the latest
    earlier one. A fold without validation or training years is an error; with
    ``on_error="keep"`` it is kept with the reason in ``error``.
    """
    base = _years_array(years).withColumn("test_year", F.explode("_years"))
    test, universe = F.col("test_year"), F.col("_years")
    if policy == "explicit_map":
        if split_map is None:
            raise ValueError("explicit_map needs a split map")
        base = base.join(split_map.select(F.col("test_year").cast("int").alias("test_year"),
                                          F.col("val_years").cast("array<int>").alias("_val")), "test_year", "left")
        val = F.coalesce(F.col("_val"), F.array().cast("array<int>"))
    elif policy == "fixed_pool":
        val = F.array(*[F.lit(int(y)) for y in pool]).cast("array<int>")
    elif policy == "previous_year":
        earlier = F.array_max(F.filter(universe, lambda y: y < test))
        val = F.filter(F.array(earlier), lambda y: y.isNotNull())
    else:
        raise ValueError(f"unknown split policy {policy!r}")
    out = base.withColumn("val_years", F.sort_array(F.filter(val, lambda y: y != test)))
    out = out.withColumn("train_years", F.array_except(universe, F.concat(F.col("val_years"), F.array(test))))
    error = F.when(F.size("val_years") == 0, F.lit("no validation years")) \
        .when(F.size("train_years") == 0, F.lit("no training years"))
    if on_error == "raise":
        checked = F.when(error.isNotNull(), F.raise_error(F.concat(
            error, F.lit(" for test year "), test.cast("string")))).otherwise(F.col("train_years"))
        return out.withColumn("train_years", checked).select("test_year", "val_years", "train_years")
    return out.withColumn("error", error).select("test_year", "val_years", "train_years", "error")


def assert_disjoint(folds: DataFrame) -> DataFrame:
    """Pass folds through; overlapping year sets raise."""
    test = F.array("test_year")
    overlap = F.arrays_overlap("val_years", "train_years") | F.arrays_overlap(test, F.col("val_years")) \
        | F.arrays_overlap(test, F.col("train_years"))
    return folds.withColumn("test_year", F.when(overlap, F.raise_error(F.lit("year overlap across splits")))
                            .otherwise(F.col("test_year")))


def fold_years(folds: DataFrame) -> DataFrame:
    """Long form: (test_year, year, split)."""
    def rows(years: Column, split: str) -> Column:
        return F.transform(years, lambda y: F.struct(y.alias("year"), F.lit(split).alias("split")))
    parts = F.concat(rows(F.col("train_years"), "train"), rows(F.col("val_years"), "val"),
                     rows(F.array("test_year"), "test"))
    return folds.select("test_year", F.explode(parts).alias("_p")).select("test_year", "_p.year", "_p.split")


def assign_split(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold with its split; years outside a fold get no row for it."""
    return sized_join(df.drop("split"), fold_years(folds), ["year"])


def leakage_audit(records: DataFrame, fold: DataFrame) -> DataFrame:
    """(issue, key) rows: declared split differs, id in two splits, window in two splits.

    ``fold`` is the long form of one fold (year, split). Years outside it are ignored.
    """
    expected = fold.select(F.col("year"), F.col("split").alias("_expected"))
    r = sized_join(records, expected, ["year"])
    declared = r.filter(F.col("split").isNotNull() & (F.col("split") != F.col("_expected"))) \
        .select(F.lit("declared_split").alias("issue"), F.col("sample_id").alias("key"))

    def in_two(label: str, key: Column, split: str) -> DataFrame:
        return r.filter(F.col(split).isNotNull()).groupBy(key.alias("key")) \
            .agg(F.min(split).alias("_a"), F.max(split).alias("_b")).filter("_a <> _b") \
            .select(F.lit(label).alias("issue"), "key")
    window = F.concat_ws("/", "state", "year", "row_off", "col_off")
    return declared.unionAll(in_two("duplicate_id", F.col("sample_id"), "_expected")) \
        .unionAll(in_two("shared_window", window, "split"))


def band_statistics(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Mergeable mean and population spread per band; tiny spread becomes 1."""
    return df.groupBy(*keys).agg(*[a for b in bands for a in (
        F.avg(b).alias(f"{b}_mean"), band_std(F.stddev_pop(b)).alias(f"{b}_std"), F.count(b).alias(f"{b}_n"))])


def target_scaler(df: DataFrame, target: str, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """(mode, center, scale): mean and spread, median and interquartile range, or none."""
    keys = list(keys)
    if mode == "none":
        return df.groupBy(*keys).agg(F.lit(0.0).alias("center"), F.lit(1.0).alias("scale")) \
            .withColumn("mode", F.lit("none"))
    if mode == "zscore":
        out = df.groupBy(*keys).agg(F.avg(target).alias("center"),
                                    spread_or_one(F.stddev_pop(target)).alias("scale"))
    elif mode == "robust":
        q = grouped_percentiles(df, keys, {"q1": (target, .25), "center": (target, .5), "q3": (target, .75)})
        out = q.withColumn("scale", spread_or_one(F.col("q3") - F.col("q1"))).drop("q1", "q3")
    else:
        raise ValueError(f"unknown target scaling {mode!r}")
    return out.withColumn("mode", F.when(F.col("center").isNull(), F.lit("none")).otherwise(F.lit(mode))) \
        .withColumn("center", F.coalesce("center", F.lit(0.0)))


def fold_statistics(df: DataFrame, folds: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Train-only band statistics of every fold from one pass over the data.

    Rows are reduced per year; folds combine the year rows they train on.
    """
    years = df.groupBy("year").agg(*[a for b in bands for a in (
        F.count(b).cast("double").alias(f"n_{b}"), F.avg(b).alias(f"m_{b}"), F.var_pop(b).alias(f"v_{b}"))])
    train = fold_years(folds).filter(F.col("split") == "train").select("test_year", "year")
    rows = train.join(years, "year")
    means = rows.groupBy("test_year").agg(*[
        ratio(F.sum(F.col(f"n_{b}") * F.col(f"m_{b}")), F.sum(f"n_{b}")).alias(f"all_{b}") for b in bands])
    return rows.join(means, "test_year").groupBy("test_year").agg(*[a for b in bands for a in (
        F.sum(f"n_{b}").cast("long").alias(f"{b}_n"), F.min(f"all_{b}").alias(f"{b}_mean"),
        band_std(F.sqrt(ratio(F.sum(F.col(f"n_{b}") * (
            F.col(f"v_{b}") + F.pow(F.col(f"m_{b}") - F.col(f"all_{b}"), F.lit(2)))),
            F.sum(f"n_{b}")))).alias(f"{b}_std"))])


def reuse_statistics(folds: DataFrame, stored: DataFrame, mode: str, on_error: str = "raise") -> DataFrame:
    """Stored statistics for each fold; other training years or another mode are refused.

    ``stored`` has (test_year, train_years, mode, ...).
    """
    want = folds.select("test_year", F.sort_array("train_years").alias("_want"))
    j = want.join(stored, "test_year", "left")
    problem = F.when(F.col("mode").isNull(), F.lit("no stored statistics")) \
        .when(F.sort_array("train_years") != F.col("_want"), F.lit("other training years")) \
        .when(F.col("mode") != mode, F.lit("other mode"))
    if on_error == "raise":
        guard = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("mode"))
        return j.withColumn("mode", guard).drop("_want")
    return j.withColumn("refused", problem).drop("_want")


def nearest_statistics(checkpoints: DataFrame, stored: DataFrame) -> DataFrame:
    """Closest ancestor folder of each checkpoint path that holds statistics.

    ``checkpoints.path`` is a file path, ``stored.folder`` a folder.
    """
    parts = F.split("path", "/")
    depth = F.size(parts)
    up = F.transform(F.sequence(F.lit(1), depth - 1), lambda n: F.struct(
        n.alias("level"), F.concat_ws("/", F.slice(parts, F.lit(1), n)).alias("folder")))
    tried = checkpoints.select("path", F.explode(up).alias("_u")).select("path", "_u.level", "_u.folder")
    hit = sized_join(tried, stored.select("folder").distinct(), ["folder"], "left_semi")
    best = hit.groupBy("path").agg(F.max_by("folder", "level").alias("folder"))
    return checkpoints.join(best, "path", "left")


def with_fallback_validation(folds: DataFrame) -> DataFrame:
    """Folds left without validation years take the latest other year for it, out of their training years."""
    train, none = F.col("train_years"), F.size("val_years") == 0
    latest = F.array(F.array_max(train))
    moved = none & (F.size(train) > 1)
    new = {"val_years": F.when(moved, latest).otherwise(F.col("val_years")),
           "train_years": F.when(moved, F.array_except(train, latest)).otherwise(train)}
    if "error" in folds.columns:
        new["error"] = F.when(~moved, F.col("error"))
    return folds.withColumns(new)


def sweep(df: DataFrame, folds: DataFrame, target: str,
          predictor: Callable[[DataFrame, Column], Column]) -> DataFrame:
    """Metrics of every fold's test year in one job.

    ``predictor(row, train_mean)`` may use the row and the fold's train-only target mean.
    A fold without validation years falls back to the latest other year. Folds still marked
    with an error are left out, so one bad fold does not stop the others.
    """
    from .metrics import regression_metrics
    folds = with_fallback_validation(folds)
    live = folds.filter(F.col("error").isNull()) if "error" in folds.columns else folds
    stats = fold_statistics(df, live, [target]).select(F.col("test_year").alias("year"),
                                                       F.col(f"{target}_mean").alias("_train_mean"))
    scored = sized_join(df, stats, ["year"]).withColumnRenamed("year", "test_year")
    scored = scored.withColumn("pred", predictor(scored, F.col("_train_mean")))
    return regression_metrics(scored, ["test_year"], "pred", target)
