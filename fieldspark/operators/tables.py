"""County-table operators: cleaning, joining, de-duplication and set algebra."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes
from ..plans import first_by, sized_join


def clean_survey(raw: DataFrame, crop: Column) -> DataFrame:
    """Survey records to typed county-year rows; rows without a number are dropped."""
    bu = codes.parse_number(F.col("Value"))
    out = raw.select(
        F.col("state_alpha").alias("state"),
        codes.zfill(F.col("state_fips_code"), 2).alias("state_fips"),
        codes.geoid(F.col("state_fips_code"), F.col("county_code")).alias("geoid"),
        "county_name", F.col("year").try_cast("int").alias("year"),
        bu.alias("yield_bu_ac"), codes.to_kg_ha(bu, crop).alias("yield_kg_ha"))
    return out.filter(F.col("yield_bu_ac").isNotNull())


def mean_duplicates(yields: DataFrame) -> DataFrame:
    """One row per (state, geoid, year): mean yields, first names."""
    return yields.groupBy("state", "geoid", "year").agg(
        F.min("county_name").alias("county_name"), F.min("state_fips").alias("state_fips"),
        F.avg("yield_bu_ac").alias("yield_bu_ac"), F.avg("yield_kg_ha").alias("yield_kg_ha"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_by(df, keys, order)


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not on the exclusion list."""
    return sized_join(df, ids.select(key).distinct(), [key], "left_anti")


def exclude_geoids(df: DataFrame, geoids: Sequence[str] = codes.EXCLUDED_GEOIDS, column: str = "geoid") -> DataFrame:
    """Rows outside the counties kept for external testing."""
    return df.filter(~codes.clean_fips(F.col(column)).isin(*geoids))


def exclusion_report(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Every requested id with the number of rows it removed; 0 means it matched nothing."""
    hits = sized_join(df.select(key), ids.select(key).distinct(), [key], "left_semi") \
        .groupBy(key).agg(F.count(F.lit(1)).alias("removed"))
    return ids.select(key).distinct().join(hits, key, "left") \
        .select(key, F.coalesce("removed", F.lit(0)).alias("removed"))


def quality_filter(vi: DataFrame, min_valid_fraction: float = 0.5, min_crop_pixels: int = 10) -> DataFrame:
    """Each rule applies only where its column exists."""
    if "valid_pixel_fraction" in vi.columns:
        vi = vi.filter(F.col("valid_pixel_fraction") >= min_valid_fraction)
    if "crop_pixel_count" in vi.columns:
        vi = vi.filter(F.col("crop_pixel_count") >= min_crop_pixels)
    return vi


def select_region(df: DataFrame, year: int | None = None, **code_columns: int) -> DataFrame:
    """Rows of one year and of the given numeric codes, however the codes are padded."""
    if year is not None:
        df = df.filter(F.col("year") == year)
    for column, value in code_columns.items():
        df = df.filter(codes.same_code(F.col(column), value))
    return df


def join_vi_yield(vi: DataFrame, yields: DataFrame, features: Sequence[str],
                  target: str = "yield_bu_ac") -> DataFrame:
    """County summaries with their yield; clashing yield columns get suffix ``_nass``."""
    clash = (set(vi.columns) & set(yields.columns)) - {"year"}
    right = yields.select(*[F.col(c).alias(f"{c}_nass") if c in clash else F.col(c)
                            for c in yields.columns])
    geoid = "geoid_nass" if "geoid" in clash else "geoid"
    right = right.withColumn("county_fips", F.col(geoid))
    joined = sized_join(vi, right, ["county_fips", "year"])
    return joined.dropna(subset=[*features, target])


def shapes_with_yield(shapes: DataFrame, yields: DataFrame, year: int,
                      value: str = "yield_kg_ha") -> DataFrame:
    """Every shape of the region left-joined to one year's yield, then those with a value."""
    one = yields.filter(F.col("year") == year).select("geoid", value)
    return shapes.join(one, "geoid", "left").filter(F.col(value).isNotNull())


def name_lookup(df: DataFrame, names: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """Left join to a name table with a default text for unknown keys."""
    return sized_join(df, names.select(key, name), [key], "left") \
        .withColumn(name, F.coalesce(F.col(name), default))


def compare_county(pred: DataFrame, yields: DataFrame, year: int) -> DataFrame:
    """County predictions next to the original yield of one year, matched on clean codes."""
    n = yields.filter(F.col("year") == year).select(
        codes.clean_fips(F.col("geoid")).alias("geoid"), F.col("yield_kg_ha").alias("nass"))
    p = pred.select(codes.clean_fips(F.col("geoid")).alias("geoid"), "pred")
    return p.join(n, "geoid")


def count_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(F.count("geoid").alias("counties"))


def distinct_years(df: DataFrame) -> DataFrame:
    return df.agg(F.sort_array(F.collect_set("year")).alias("years"))


def expected_grid(states: DataFrame, first_year: int, last_year: int,
                  variants: Sequence[str]) -> DataFrame:
    """All (state, year, variant) combinations that should exist, by expanding each state."""
    return (states.select("state").distinct()
            .withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
            .withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants]))))


def coverage_gaps(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select(*expected.columns).distinct(), expected.columns, "left_anti")


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """Union by name; a column missing from one table is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def missing_from(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.subtract(found)


def shared_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def covers(done: DataFrame, planned: DataFrame, keys: list[str]) -> bool:
    """True when every planned unit is done."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti").isEmpty()


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
