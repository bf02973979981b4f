"""County tables: aggregation, joins, de-duplication, set algebra, sort and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import grid, tables
from fieldspark.plans import dense_index, sample_n

from . import fixtures as fx
from .fixtures import with_
from .q_sources import _CLEAN
from .registry import R, check, r, rounded


def _survey_clean(spark, d):
    return tables.clean_survey(fx.survey(spark, d), F.lit("SOYBEANS"))


_KG = "round(round_even(bu * 67.251::DOUBLE, 4), 4)"


@check("A01_mean_duplicate_counties", with_("survey", c=_CLEAN) + f"""SELECT state, geoid, year, min(county_name) AS county_name, {R('avg(bu)')} AS yield_bu_ac,
 {R(f'avg({_KG})', 3)} AS yield_kg_ha FROM c WHERE bu IS NOT NULL GROUP BY 1, 2, 3""")
def a01(spark, d):
    out = tables.mean_duplicates(_survey_clean(spark, d)).drop("state_fips")
    return out.withColumn("yield_bu_ac", r("yield_bu_ac")).withColumn("yield_kg_ha", r("yield_kg_ha", 3))


@check("A02_count_by_year", with_("county_yield") + "SELECT year, count(county_fips) AS counties FROM county_yield GROUP BY year")
def a02(spark, d):
    return tables.count_by_year(fx.county_yield(spark, d).withColumnRenamed("county_fips", "geoid"))


@check("A02b_distinct_years", with_("county_yield") + "SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM (SELECT DISTINCT year FROM county_yield)")
def a02b(spark, d):
    return tables.distinct_years(fx.county_yield(spark, d)).select(F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@check("J01_join_vi_yield", with_("county_vi", "county_yield") + f"""SELECT v.county_fips, v.year, v.state, y.state AS state_nass, {R('NDVI_mean')} AS NDVI_mean, {R('yield_bu_ac')} AS yield_bu_ac
 FROM county_vi v JOIN county_yield y ON v.county_fips = y.county_fips AND v.year = y.year WHERE NDVI_mean IS NOT NULL AND yield_bu_ac IS NOT NULL""")
def j01(spark, d):
    y = fx.county_yield(spark, d).withColumnRenamed("county_fips", "geoid")
    out = tables.join_vi_yield(fx.county_vi(spark, d), y, ["NDVI_mean"])
    return rounded(out.select("county_fips", "year", "state", "state_nass", "NDVI_mean", "yield_bu_ac"), "NDVI_mean", "yield_bu_ac")


@check("J02_shapes_with_yield", with_("county_yield") + f"""SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geoid, n_name AS name, {R('yield_bu_ac')} AS yield_bu_ac
 FROM nation LEFT JOIN county_yield ON county_fips = lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AND year = 1998 WHERE yield_bu_ac IS NOT NULL""")
def j02(spark, d):
    s = fx.shapes(spark, d).withColumnRenamed("GEOID", "geoid")
    y = fx.county_yield(spark, d).withColumnRenamed("county_fips", "geoid")
    out = tables.shapes_with_yield(s, y, 1998, "yield_bu_ac")
    return rounded(out.select("geoid", F.col("NAME").alias("name"), "yield_bu_ac"), "yield_bu_ac")


@check("J07_name_lookup", """SELECT l_partkey, l_orderkey, l_linenumber, coalesce(p_name, 'part_' || CAST(l_partkey AS VARCHAR)) AS p_name FROM lineitem
 LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def j07(spark, d):
    names = fx.table(spark, d, "part").filter("p_size > 10").withColumnRenamed("p_partkey", "l_partkey")
    rows = fx.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return tables.name_lookup(rows, names, "l_partkey", "p_name", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")))


@check("J08_compare_county", with_("predictions", "county_yield") + f"""SELECT p.county_fips AS geoid, {R('p.pred')} AS pred, {R('yield_bu_ac')} AS nass
 FROM (SELECT county_fips, avg(pred) AS pred FROM predictions GROUP BY 1) p JOIN county_yield y ON p.county_fips = y.county_fips AND y.year = 1999""")
def j08(spark, d):
    p = fx.predictions(spark, d).groupBy(F.col("county_fips").cast("int").alias("geoid")).agg(F.avg("pred").alias("pred"))
    y = fx.county_yield(spark, d).select(F.concat("county_fips", F.lit(".0")).alias("geoid"), "year", F.col("yield_bu_ac").alias("yield_kg_ha"))
    return rounded(tables.compare_county(p, y, 1999), "pred", "nass")


@check("J10_remaining_work", "SELECT o_orderkey AS unit FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j10(spark, d):
    planned = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"))
    done = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"))
    return tables.remaining(planned, done, ["unit"])


_COV = """e AS (SELECT n_name AS state, y AS year, v AS variant FROM nation, (SELECT unnest(range(1995, 2002)) AS y), (SELECT unnest(['nearest', 'bilinear10km']) AS v)),
 f AS (SELECT n_name, year(o_orderdate) AS y, CASE WHEN o_orderstatus = 'O' THEN 'nearest' ELSE 'bilinear10km' END AS v FROM orders
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3 HAVING count(*) % 3 <> 0)"""


def _coverage(spark, d):
    n = fx.table(spark, d, "nation").withColumnRenamed("n_name", "state")
    expected = tables.expected_grid(n, 1995, 2001, ["nearest", "bilinear10km"])
    found = fx.table(spark, d, "orders") \
        .join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("state", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "O", F.lit("nearest")).otherwise(F.lit("bilinear10km")).alias("variant")) \
        .groupBy("state", "year", "variant").agg(F.count(F.lit(1)).alias("n")).filter("n % 3 <> 0").drop("n")
    return expected, found


@check("J11_coverage_gaps", f"WITH {_COV} SELECT state, CAST(year AS INTEGER) AS year, variant FROM e WHERE (state, year, variant) NOT IN (SELECT n_name, y, v FROM f)")
def j11(spark, d):
    return tables.coverage_gaps(*_coverage(spark, d))


@check("U01_union_tables", """SELECT o_orderkey AS k, o_totalprice AS price, NULL::VARCHAR AS name FROM orders UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer
 UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""")
def u01(spark, d):
    return tables.union_tables([
        fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")),
        fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price"), F.col("c_name").alias("name")),
        fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))])


@check("U02_expected_minus_found", f"WITH {_COV} SELECT state, CAST(year AS INTEGER) AS year, variant FROM e EXCEPT SELECT n_name, CAST(y AS INTEGER), v FROM f")
def u02(spark, d):
    return tables.missing_from(*_coverage(spark, d))


@check("U03_shared_windows", with_("pixel") + """SELECT DISTINCT CAST(floor("row" / 8) AS BIGINT) AS r, CAST(floor(col / 8) AS BIGINT) AS c FROM pixel WHERE year < 1998
 INTERSECT SELECT CAST(floor("row" / 8) AS BIGINT), CAST(floor(col / 8) AS BIGINT) FROM pixel WHERE year >= 1998""")
def u03(spark, d):
    w = fx.pixel(spark, d).select("year", F.floor(F.col("row") / 8).alias("r"), F.floor(F.col("col") / 8).alias("c"))
    return tables.shared_rows(w.filter("year < 1998").drop("year"), w.filter("year >= 1998").drop("year"))


@check("U05_covers_planned", """SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) = 0 AS all_parts,
 (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0 AS all_orders, count(*) AS n FROM orders""")
def u05(spark, d):
    li = fx.table(spark, d, "lineitem")
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    return o.agg(F.lit(tables.covers(li, p, ["l_partkey"])).alias("all_parts"), F.lit(tables.covers(li, o, ["l_orderkey"])).alias("all_orders"), F.count(F.lit(1)).alias("n"))


_SEQ = "SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, l_quantity, l_linenumber, l_extendedprice FROM lineitem"


@check("W06_keep_first", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_linenumber, l_extendedprice) AS rn FROM ({_SEQ})) WHERE rn = 1""")
def w06(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_extendedprice")
    return tables.keep_first(rows, ["l_orderkey"], ["l_shipdate"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@check("W06b_keep_last", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM ({_SEQ})) WHERE rn = 1""")
def w06b(spark, d):
    from fieldspark.plans import last_by
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber", "l_extendedprice")
    return last_by(rows, ["l_orderkey"], ["l_shipdate"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@check("W07_dense_county_index", """SELECT g AS geoid, row_number() OVER (ORDER BY g) AS county_idx FROM (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS g FROM customer)""")
def w07(spark, d):
    g = fx.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("geoid")).distinct()
    return dense_index(g, ["geoid"], "county_idx")


@check("Tk1_order_scenes", with_("scenes") + "SELECT id, event_id, CAST(ts AS VARCHAR) AS ts FROM scenes ORDER BY ts, id")
def tk1(spark, d):
    s = fx.scenes(spark, d).orderBy("ts", "id")
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return s.select("id", "event_id", F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "").alias("ts"))


@check("Tk2_top_k_chips", with_("predictions") + f"""SELECT sample_id, count(*) AS n_pixels, {R('min(pred)')} AS min_pred FROM predictions WHERE pred < 10
 GROUP BY 1 ORDER BY n_pixels DESC, sample_id LIMIT 15""")
def tk2(spark, d):
    g = fx.predictions(spark, d).filter("pred < 10").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.min("pred").alias("min_pred"))
    return rounded(tables.top_k(g, [F.desc("n_pixels"), F.asc("sample_id")], 15), "min_pred")


@check("Tk3_first_n", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40")
def tk3(spark, d):
    return tables.top_k(fx.table(spark, d, "customer").select("c_custkey", "c_name"), [F.asc("c_custkey")], 40)


@check("Tk4_seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 250")
def tk4(spark, d):
    return sample_n(fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 250, "o_orderkey", 42)


@check("Tk4b_sample_uncapped", "SELECT o_orderkey, o_totalprice FROM orders")
def tk4b(spark, d):
    return sample_n(fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), None, "o_orderkey", 42)


@check("Tk5_preview_decimation", with_("pixel") + f"""SELECT "row", col, year, count(*) AS n, {R('avg(nir)')} AS nir FROM pixel WHERE "row" % 6 = 0 AND col % 6 = 0 GROUP BY 1, 2, 3""")
def tk5(spark, d):
    out = grid.preview(fx.pixel(spark, d), 100, 512, 512)
    return rounded(out.groupBy("row", "col", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("nir").alias("nir")), "nir")


@check("A37_coverage_counts", with_("scenes") + f"""SELECT left(id, 7) AS sensor, count(*) AS total, count(CASE WHEN cloud_cover <= 70 THEN 1 END) AS kept,
 {R('count(CASE WHEN cloud_cover <= 70 THEN 1 END) / count(*)')} AS kept_share FROM scenes GROUP BY 1""")
def a37(spark, d):
    from fieldspark.operators.manifest import coverage_counts
    s = fx.scenes(spark, d).withColumn("sensor", F.substring("id", 1, 7))
    return rounded(coverage_counts(s, ["sensor"], F.col("cloud_cover") <= 70), "kept_share")
