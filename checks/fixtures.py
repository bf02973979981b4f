"""Virtual earth-observation tables derived from the given tables, as DataFrames and as SQL.

Each ``SQL`` entry is the body of a common table expression with the same columns.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STATES = ("IL", "IA", "IN", "MN", "NE")
FIPS = ("17", "19", "18", "27", "31")


@lru_cache(maxsize=None)
def _schema(path: str):
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; its schema is looked up once per path."""
    path = f"{d.rstrip('/')}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def state_of(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (k % 5 + 1).cast("int"))


def code5(k: Column) -> Column:
    return F.lpad(k.cast("string"), 5, "0")


SQL_STATE = "(['IL','IA','IN','MN','NE'])[{k} % 5 + 1]"
SQL_FIPS = "(['17','19','18','27','31'])[{k} % 5 + 1]"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))


_BASE = dict(
    state=lambda: state_of(F.col("s_nationkey")), county_fips=lambda: code5(F.col("s_nationkey")),
    year=lambda: F.year("l_shipdate"), month=lambda: F.month("l_shipdate"))
_SQL_BASE = f"""{SQL_STATE.format(k='s_nationkey')} AS state, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS county_fips,
 CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month"""
_SQL_FROM = "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"


def pixel(spark: SparkSession, d: str) -> DataFrame:
    """512 x 512 pixels with reflectance-like bands and masks."""
    return lines(spark, d).select(
        *[f().alias(n) for n, f in _BASE.items()],
        (F.col("l_orderkey") % 512).cast("int").alias("row"), (F.col("l_partkey") % 512).cast("int").alias("col"),
        F.col("l_suppkey").alias("scene_id"), F.col("l_linenumber").alias("ln"),
        F.col("l_tax").alias("blue"), (0.03 + F.col("l_discount")).alias("green"),
        (F.col("l_quantity") / 100).alias("red"), (F.col("l_extendedprice") / 100000).alias("nir"),
        ((F.col("l_suppkey") % 100) / 100.0).alias("swir1"),
        (F.col("l_partkey") % 256).cast("int").alias("fmask"),
        (F.col("l_returnflag") != "N").alias("crop_mask"),
        ((F.col("l_returnflag") != "N") & (F.col("l_linenumber") < 6)).alias("valid_vi_mask"))


def vi_pixel(spark: SparkSession, d: str) -> DataFrame:
    """Index pixels; NDVI is missing on line 7."""
    return lines(spark, d).select(
        *[f().alias(n) for n, f in _BASE.items()],
        (F.col("l_orderkey") % 512).cast("int").alias("row"), (F.col("l_partkey") % 512).cast("int").alias("col"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / 100000).alias("NDVI_mean"),
        (F.col("l_quantity") / 50).alias("EVI_mean"), (F.col("l_discount") * 10).alias("GCVI_mean"),
        (F.col("l_tax") * 5).alias("NDWI_mean"),
        (F.col("l_returnflag") != "N").alias("crop_mask"),
        ((F.col("l_returnflag") != "N") & (F.col("l_linenumber") < 6)).alias("valid_vi_mask"))


def scene_pixel(spark: SparkSession, d: str) -> DataFrame:
    """16 x 16 pixels per state seen by many scenes, raw digital numbers, fill on line 7."""
    def dn(c: Column) -> Column:
        return F.when(F.col("l_linenumber") == 7, F.lit(-9999.0)).otherwise(F.floor(c * 10000 + 0.5).cast("double"))
    return lines(spark, d).select(
        *[f().alias(n) for n, f in _BASE.items()],
        (F.col("l_orderkey") % 16).cast("int").alias("row"), (F.col("l_partkey") % 16).cast("int").alias("col"),
        F.col("l_suppkey").alias("scene_id"), F.to_date("l_shipdate").alias("day"),
        dn(F.col("l_tax")).alias("BLUE"), dn(0.03 + F.col("l_discount")).alias("GREEN"),
        dn(F.col("l_quantity") / 100).alias("RED"), dn(F.col("l_extendedprice") / 100000).alias("NIR_NARROW"),
        dn((F.col("l_suppkey") % 100) / 100.0).alias("SWIR1"), dn(F.col("l_discount")).alias("SWIR2"),
        F.when(F.col("l_quantity") <= 30, F.col("l_suppkey") % 4 * 64)
        .otherwise((F.col("l_orderkey") * 31 + F.col("l_suppkey")) % 256).cast("int").alias("fmask"),
        (F.col("l_returnflag") != "N").alias("crop_mask"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(
        *[f().alias(n) for n, f in _BASE.items()],
        (F.col("l_orderkey") % 512).cast("int").alias("row"), (F.col("l_partkey") % 512).cast("int").alias("col"),
        F.concat(F.lit("chip_"), (F.col("l_partkey") % 50).cast("string")).alias("sample_id"),
        (F.col("l_extendedprice") / 1000).alias("target"),
        (F.col("l_quantity") * 1.5 + F.col("l_tax") * 10).alias("pred"),
        (F.col("l_returnflag") != "N").alias("crop_mask"), F.col("l_linenumber").alias("ln"),
        F.col("l_linestatus").alias("run_id"), (F.col("l_suppkey") % 40).cast("int").alias("field_id"))


def survey(spark: SparkSession, d: str) -> DataFrame:
    """Text survey records per nation, year and segment; one segment is withheld as (D)."""
    k = F.col("c_nationkey")
    agg = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .groupBy(k.alias("k"), F.year("o_orderdate").alias("y"), "c_mktsegment").agg(
            F.floor((F.sum("o_totalprice") + 0.003) / 100).alias("v"))
    fips = F.element_at(F.array(*[F.lit(s) for s in FIPS]), (F.col("k") % 5 + 1).cast("int"))
    return agg.select(
        state_of(F.col("k")).alias("state_alpha"), fips.alias("state_fips_code"),
        F.concat(F.lit("COUNTY "), F.col("k").cast("string")).alias("county_name"),
        F.col("k").cast("string").alias("county_code"), F.col("y").cast("string").alias("year"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("(D)")).otherwise(F.format_number("v", 0)).alias("Value"),
        F.col("c_mktsegment").alias("segment"))


def county_yield(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_nationkey")
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .groupBy(state_of(k).alias("state"), code5(k).alias("county_fips"), F.year("o_orderdate").alias("year")) \
        .agg((F.avg("o_totalprice") / 1000).alias("yield_bu_ac"))


def county_vi(spark: SparkSession, d: str) -> DataFrame:
    """County-year index means of crop pixels."""
    p = vi_pixel(spark, d).filter("crop_mask")
    return p.groupBy("state", "county_fips", "year").agg(
        F.avg("NDVI_mean").alias("NDVI_mean"), F.avg("EVI_mean").alias("EVI_mean"),
        F.avg("GCVI_mean").alias("GCVI_mean"), F.avg("NDWI_mean").alias("NDWI_mean"),
        F.count(F.lit(1)).alias("crop_pixel_count"),
        F.avg(F.col("valid_vi_mask").cast("double")).alias("valid_pixel_fraction"))


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scene catalogue from events: repeated ids, cloud as value, some missing clouds and boxes."""
    e = table(spark, d, "events")
    x, y = (F.col("user_id") % 36 * 10 - 180).cast("double"), (F.col("event_id") % 17 * 10 - 85).cast("double")
    no_box = F.col("event_id") % 501 == 0
    return e.select(
        F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("HLS.L30.")).otherwise(F.lit("HLS.S30.")),
                 F.floor(F.col("event_id") / 4).cast("string")).alias("id"),
        "ts", F.col("user_id").alias("tile"),
        F.when(F.col("event_type") != "error", F.least(F.col("value"), F.lit(100.0))).alias("cloud_cover"),
        F.when(~no_box, x).alias("xmin"), F.when(~no_box, y).alias("ymin"),
        F.when(~no_box, x + 12).alias("xmax"), F.when(~no_box, y + 8).alias("ymax"), "event_id")


def grids(spark: SparkSession, d: str) -> DataFrame:
    """One raster per supplier."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("r"), k.cast("string")).alias("raster_id"), state_of(F.col("s_nationkey")).alias("state"),
        (1995 + k % 7).cast("int").alias("year"), (150 + k % 500).cast("int").alias("height"),
        (150 + k * 7 % 500).cast("int").alias("width"), F.lit(30.0).alias("a"), F.lit(0.0).alias("b"),
        (k % 10 * 6720.0 - 300000).alias("c"), F.lit(0.0).alias("d"), F.lit(-30.0).alias("e"),
        (2000000 - k % 8 * 6720.0).alias("f"),
        F.when(k % 41 == 3, F.lit("EPSG:4326")).otherwise(F.lit("EPSG:5070")).alias("crs"))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """One concave, slightly overlapping polygon per nation on the 512 x 512 grid."""
    k = F.col("n_nationkey")
    x0, y0 = (k % 5).cast("double") * 102.4, F.floor(k / 5).cast("double") * 102.4

    def p(dx: float, dy: float) -> Column:
        return F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    ring = F.array(p(0.3, 0.7), p(120.3, 0.7), p(120.3, 110.7), p(60.3, 50.7), p(0.3, 110.7))
    return table(spark, d, "nation").select(
        F.lit("17").alias("STATEFP"), F.lpad(k.cast("string"), 3, "0").alias("COUNTYFP"),
        code5(k).alias("GEOID"), F.col("n_name").alias("NAME"), F.array(ring).alias("rings"),
        k.cast("int").alias("shape_order"))


SQL = {
    "pixel": f"""SELECT {_SQL_BASE}, CAST(l_orderkey % 512 AS INTEGER) AS "row", CAST(l_partkey % 512 AS INTEGER) AS col,
 l_suppkey AS scene_id, l_linenumber AS ln, l_tax AS blue, 0.03 + l_discount AS green, l_quantity / 100 AS red,
 l_extendedprice / 100000 AS nir, (l_suppkey % 100) / 100.0::DOUBLE AS swir1, CAST(l_partkey % 256 AS INTEGER) AS fmask,
 l_returnflag <> 'N' AS crop_mask, (l_returnflag <> 'N' AND l_linenumber < 6) AS valid_vi_mask {_SQL_FROM}""",
    "vi_pixel": f"""SELECT {_SQL_BASE}, CAST(l_orderkey % 512 AS INTEGER) AS "row", CAST(l_partkey % 512 AS INTEGER) AS col,
 CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 100000 END AS NDVI_mean, l_quantity / 50 AS EVI_mean,
 l_discount * 10 AS GCVI_mean, l_tax * 5 AS NDWI_mean, l_returnflag <> 'N' AS crop_mask,
 (l_returnflag <> 'N' AND l_linenumber < 6) AS valid_vi_mask {_SQL_FROM}""",
    "scene_pixel": f"""SELECT {_SQL_BASE}, CAST(l_orderkey % 16 AS INTEGER) AS "row", CAST(l_partkey % 16 AS INTEGER) AS col,
 l_suppkey AS scene_id, CAST(l_shipdate AS DATE) AS day,
 {', '.join(f"CASE WHEN l_linenumber = 7 THEN -9999.0::DOUBLE ELSE CAST(floor(({x}) * 10000 + 0.5) AS DOUBLE) END AS {n}" for n, x in (
     ('BLUE', 'l_tax'), ('GREEN', '0.03 + l_discount'), ('RED', 'l_quantity / 100'), ('NIR_NARROW', 'l_extendedprice / 100000'),
     ('SWIR1', '(l_suppkey % 100) / 100.0::DOUBLE'), ('SWIR2', 'l_discount')))},
 CAST(CASE WHEN l_quantity <= 30 THEN l_suppkey % 4 * 64 ELSE (l_orderkey * 31 + l_suppkey) % 256 END AS INTEGER) AS fmask,
 l_returnflag <> 'N' AS crop_mask {_SQL_FROM}""",
    "predictions": f"""SELECT {_SQL_BASE}, CAST(l_orderkey % 512 AS INTEGER) AS "row", CAST(l_partkey % 512 AS INTEGER) AS col,
 'chip_' || CAST(l_partkey % 50 AS VARCHAR) AS sample_id, l_extendedprice / 1000 AS target,
 l_quantity * 1.5 + l_tax * 10 AS pred, l_returnflag <> 'N' AS crop_mask, l_linenumber AS ln, l_linestatus AS run_id,
 CAST(l_suppkey % 40 AS INTEGER) AS field_id {_SQL_FROM}""",
    "survey": f"""SELECT {SQL_STATE.format(k='k')} AS state_alpha, {SQL_FIPS.format(k='k')} AS state_fips_code,
 'COUNTY ' || CAST(k AS VARCHAR) AS county_name, CAST(k AS VARCHAR) AS county_code, CAST(y AS VARCHAR) AS year,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN '(D)' ELSE format('{{:,}}', v) END AS Value, c_mktsegment AS segment
 FROM (SELECT c_nationkey AS k, year(o_orderdate) AS y, c_mktsegment,
  CAST(floor((sum(o_totalprice) + 0.003) / 100) AS BIGINT) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) g""",
    "county_yield": f"""SELECT {SQL_STATE.format(k='c_nationkey')} AS state, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county_fips,
 CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) / 1000 AS yield_bu_ac
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "county_vi": """SELECT state, county_fips, year, avg(NDVI_mean) AS NDVI_mean, avg(EVI_mean) AS EVI_mean,
 avg(GCVI_mean) AS GCVI_mean, avg(NDWI_mean) AS NDWI_mean, count(*) AS crop_pixel_count,
 avg(CAST(valid_vi_mask AS DOUBLE)) AS valid_pixel_fraction FROM vi_pixel WHERE crop_mask GROUP BY 1, 2, 3""",
    "scenes": """SELECT CASE WHEN event_id % 2 = 0 THEN 'HLS.L30.' ELSE 'HLS.S30.' END ||
  CAST(CAST(floor(event_id / 4) AS BIGINT) AS VARCHAR) AS id, ts, user_id AS tile,
 CASE WHEN event_type <> 'error' THEN least(value, 100.0) END AS cloud_cover,
 CASE WHEN event_id % 501 <> 0 THEN CAST(user_id % 36 * 10 - 180 AS DOUBLE) END AS xmin,
 CASE WHEN event_id % 501 <> 0 THEN CAST(event_id % 17 * 10 - 85 AS DOUBLE) END AS ymin,
 CASE WHEN event_id % 501 <> 0 THEN CAST(user_id % 36 * 10 - 180 AS DOUBLE) + 12 END AS xmax,
 CASE WHEN event_id % 501 <> 0 THEN CAST(event_id % 17 * 10 - 85 AS DOUBLE) + 8 END AS ymax, event_id FROM events""",
    "grids": f"""SELECT 'r' || CAST(s_suppkey AS VARCHAR) AS raster_id, {SQL_STATE.format(k='s_nationkey')} AS state,
 CAST(1995 + s_suppkey % 7 AS INTEGER) AS year, CAST(150 + s_suppkey % 500 AS INTEGER) AS height,
 CAST(150 + s_suppkey * 7 % 500 AS INTEGER) AS width, 30.0::DOUBLE AS a, 0.0::DOUBLE AS b,
 s_suppkey % 10 * 6720.0::DOUBLE - 300000 AS c, 0.0::DOUBLE AS d, -30.0::DOUBLE AS e,
 2000000 - s_suppkey % 8 * 6720.0::DOUBLE AS f,
 CASE WHEN s_suppkey % 41 = 3 THEN 'EPSG:4326' ELSE 'EPSG:5070' END AS crs FROM supplier""",
    "edges": """SELECT k, geoid, name, x0 + p[1] AS x1, y0 + p[2] AS y1, x0 + p[3] AS x2, y0 + p[4] AS y2 FROM (
 SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geoid, n_name AS name,
  (n_nationkey % 5) * 102.4::DOUBLE AS x0, floor(n_nationkey / 5) * 102.4::DOUBLE AS y0,
  unnest([[0.3, 0.7, 120.3, 0.7], [120.3, 0.7, 120.3, 110.7], [120.3, 110.7, 60.3, 50.7],
          [60.3, 50.7, 0.3, 110.7], [0.3, 110.7, 0.3, 0.7]]::DOUBLE[][]) AS p FROM nation) s""",
}
_NEEDS = {"county_vi": ["vi_pixel"]}


def with_(*names: str, **extra: str) -> str:
    """``WITH`` prefix that defines the named virtual tables and further expressions."""
    done: dict[str, str] = {}
    for n in names:
        for need in (*_NEEDS.get(n, []), n):
            done[need] = SQL[need]
    done.update(extra)
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in done.items()) + " "
