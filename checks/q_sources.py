"""Sources, sinks, and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import codes, dates, geo, nulls, scaling, spectral, targets
from fieldspark.operators import scoring, tables
from fieldspark.plans import materialise, shared_path
from fieldspark.sources import names, readers, sinks

from . import fixtures as fx
from .fixtures import with_
from .registry import R, check, r, rounded

_GEOID = "lpad(state_fips_code, 2, '0') || lpad(county_code, 3, '0')"
_CLEAN = f"""SELECT state_alpha AS state, state_fips_code AS state_fips, {_GEOID} AS geoid, county_name,
 CAST(year AS INTEGER) AS year, TRY_CAST(replace(Value, ',', '') AS DOUBLE) AS bu FROM survey"""


@check("S01_read_survey_records", with_("survey") +
       "SELECT state_alpha, state_fips_code, county_name, county_code, year, Value FROM survey")
def s01(spark, d):
    path = shared_path(spark, "survey")
    fx.survey(spark, d).drop("segment").write.json(path)
    return readers.read_survey_records(spark, path)


@check("S02_read_county_yield", with_("survey", c=_CLEAN) +
       f"SELECT state, geoid, year, county_name, {R('min(bu)')} AS yield_bu_ac FROM c WHERE bu IS NOT NULL GROUP BY 1, 2, 3, 4")
def s02(spark, d):
    path = shared_path(spark, "yield")
    t = fx.survey(spark, d).select(
        F.col("state_alpha").alias("state"), F.concat("state_fips_code", F.lpad("county_code", 3, "0"), F.lit(".0")).alias("GEOID"),
        "year", "county_name", F.regexp_replace("Value", ",", "").alias("yield_bu_ac"))
    # smallest yield first, so that the first row of a county-year is known; two column orders; and in the later file a second row of every county-year, which must not count
    even = F.col("year").cast("int") % 2 == 0
    t = t.repartitionByRange(4, "GEOID", "year").sortWithinPartitions("GEOID", "year", F.col("yield_bu_ac").try_cast("double"))
    t.filter(even).write.option("header", True).csv(f"{path}/a")
    t.filter(~even).select("yield_bu_ac", "county_name", "GEOID", "state", "year").write.option("header", True).csv(f"{path}/b")
    t.filter(F.col("yield_bu_ac").try_cast("double").isNotNull()).withColumn("yield_bu_ac", F.lit("1")) \
        .select("year", "GEOID", "yield_bu_ac").write.option("header", True).csv(f"{path}/c")
    out = readers.read_county_yield(spark, path).select("state", "geoid", "year", "county_name", "yield_bu_ac")
    return rounded(out, "yield_bu_ac")


@check("S03_read_vi_summaries", with_("county_vi") +
       f"""SELECT county_fips, year, CASE WHEN year < 1998 THEN NULL ELSE {R('NDVI_mean')} END AS NDVI_mean,
 {R('EVI_mean')} AS EVI_mean, CAST(crop_pixel_count AS DOUBLE) AS crop_pixel_count FROM county_vi""")
def s03(spark, d):
    root = shared_path(spark, "vi_summaries")
    vi = materialise(fx.county_vi(spark, d), "county_vi").withColumn("county_fips", F.regexp_replace("county_fips", "^0+(?=.)", ""))
    old, new = vi.filter("year < 1998"), vi.filter("year >= 1998")
    cols = ["state", "county_fips", "year", "NDVI_mean", "EVI_mean", "crop_pixel_count"]
    old.select(*[c for c in cols if c != "NDVI_mean"]).write.option("header", True).csv(f"{root}/old")
    new.select(*cols).write.option("header", True).csv(f"{root}/new/deep")
    return rounded(readers.read_vi_summaries(spark, root), "NDVI_mean", "EVI_mean") \
        .select("county_fips", "year", "NDVI_mean", "EVI_mean", "crop_pixel_count")


@check("S04_read_county_shapes", """SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS GEOID, n_name AS NAME, 5 AS points
 FROM nation WHERE contains(lower(n_name), 'nation_1')""")
def s04(spark, d):
    out = readers.read_county_shapes(fx.shapes(spark, d), state="IL", name_contains="Nation_1")
    return out.select("GEOID", "NAME", F.size(F.element_at("rings", 1)).alias("points"))


@check("S05_read_pixels", with_("vi_pixel") +
       f"""SELECT state, year, "row", col, {R('NDVI_mean')} AS NDVI_mean, {R('EVI_mean')} AS EVI_mean,
 {R('GCVI_mean')} AS GCVI_mean, {R('NDWI_mean')} AS NDWI_mean FROM vi_pixel""")
def s05(spark, d):
    p = fx.vi_pixel(spark, d)
    raw = p.select("state", "year", "row", "col", F.coalesce("NDVI_mean", F.lit(-9999.0)).alias("band_1"),
                   F.col("EVI_mean").alias("band_2"), F.col("GCVI_mean").alias("band_3"), F.col("NDWI_mean").alias("band_4"))
    return rounded(readers.read_pixels(raw, ["state", "year", "row", "col"]), *readers.STACK_4)


@check("S06_raster_inventory", with_("grids", g="SELECT DISTINCT state, year FROM grids") + """SELECT s.state, CAST(y AS INTEGER) AS year, g.year IS NOT NULL AS has_label, g.year IS NOT NULL AND g.year % 3 <> 0 AS has_mask
 FROM (SELECT DISTINCT state FROM g) s JOIN (SELECT unnest(range(1995, 2002)) AS y) ON true LEFT JOIN g ON g.state = s.state AND g.year = y WHERE NOT (g.year IS NOT NULL AND g.year % 3 <> 0)""")
def s06(spark, d):
    root = shared_path(spark, "rasters")
    g = fx.grids(spark, d).select("state", "year").distinct()
    for kind, name in (("label", "nass_soybeans_yield_"), ("mask", "cdl_soybeans_")):
        tail = F.lit("_nearest_30m.tif") if kind == "label" else F.lit(".tif")
        g.filter(F.lit(kind == "label") | (F.col("year") % 3 != 0)) \
            .select(F.concat(F.lit(name), "state", F.lit("_"), F.col("year").cast("string"), tail).alias("p")) \
            .withColumn("value", F.lit("x")).write.partitionBy("p").text(f"{root}/{kind}")
    files = spark.read.text(root, recursiveFileLookup=True).select(
        F.regexp_extract("_metadata.file_path", r"p=([^/]+)", 1).alias("path"))
    found = names.inventory(files)
    states = g.select("state").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    return names.inventory_gaps(states, found).select("state", "year", "has_label", "has_mask")


@check("S07_parse_raster_name", """SELECT 'soybeans' AS crop, 'N' || CAST(p_size AS VARCHAR) AS state, CAST(1990 + p_partkey % 30 AS INTEGER) AS year,
 CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS county_fips,
 CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) END AS county_name, p_partkey FROM part""")
def s07(spark, d):
    p = fx.table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 2 == 0, F.concat(fx.code5(F.col("p_partkey")), F.lit("_"), F.split("p_name", " ")[0],
                                                        F.lit("_vi_pixels.tif"))).otherwise(F.lit("vi_stack_minimal.tif"))
    path = F.concat(F.lit("/data/soybeans_N"), F.col("p_size").cast("string"), F.lit("_"),
                    (1990 + F.col("p_partkey") % 30).cast("string"), F.lit("_"), tail)
    return p.select(*[c.alias(n) for n, c in names.parse_raster_name(path).items()], "p_partkey")


_SCENES = """SELECT id, max(struct_pack(ts := ts, cloud := cloud_cover, e := event_id)) AS s FROM scenes
 WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 23:59:59'
 AND (xmin IS NULL OR (xmax >= -100 AND xmin <= 100 AND ymax >= -40 AND ymin <= 60)) GROUP BY id"""
_SCENE_ARGS = dict(t0="2024-01-05 00:00:00", t1="2024-01-25 23:59:59", bbox=(-100, -40, 100, 60))


@check("S08_scan_scenes", with_("scenes", one=_SCENES) +
       f"SELECT id, s.e AS event_id, {R('s.cloud')} AS cloud_cover FROM one WHERE s.cloud IS NULL OR s.cloud <= 70")
def s08(spark, d):
    return rounded(readers.scan_scenes(fx.scenes(spark, d), **_SCENE_ARGS).select("id", "event_id", "cloud_cover"), "cloud_cover")


@check("S08b_scan_scenes_null_cloud_dropped", with_("scenes", one=_SCENES) +
       f"SELECT id, s.e AS event_id, {R('s.cloud')} AS cloud_cover FROM one WHERE coalesce(s.cloud, 999) <= 70")
def s08b(spark, d):
    return rounded(readers.scan_scenes(fx.scenes(spark, d), null_cloud="drop", **_SCENE_ARGS)
                   .select("id", "event_id", "cloud_cover"), "cloud_cover")


_STACK_MONTHS = range(4, 12)


@check("S09_read_chip_stack", with_("scene_pixel", lab="""SELECT state, year, "row", col, avg(CASE WHEN RED > 0 THEN RED END) AS label
 FROM scene_pixel GROUP BY 1, 2, 3, 4""", m="""SELECT state, year, "row", col, month, BLUE, NIR_NARROW
 FROM scene_pixel WHERE BLUE > -9990 AND NIR_NARROW > -9990""", w=f"""SELECT state, year, "row", col,
 {', '.join(f"max(CASE WHEN month = {m} THEN BLUE * 0.0001 END) AS b{m}, max(CASE WHEN month = {m} THEN NIR_NARROW * 0.0001 END) AS n{m}, count(CASE WHEN month = {m} THEN 1 END) > 0 AS v{m}" for m in _STACK_MONTHS)}
 FROM m GROUP BY 1, 2, 3, 4""", c="""SELECT state, year, "row", col, bool_or(crop_mask) AS crop FROM scene_pixel WHERE crop_mask GROUP BY 1, 2, 3, 4""")
       + f"""SELECT lab.state, lab.year, lab."row", lab.col, {R('label')} AS label, coalesce(crop, false) AS crop_mask,
 {', '.join(f"{R(f'b{m}')} AS BLUE_{m:02d}, {R(f'n{m}')} AS NIR_NARROW_{m:02d}, coalesce(v{m}, false) AS valid_{m:02d}" for m in _STACK_MONTHS)}
 FROM lab LEFT JOIN w USING (state, year, "row", col) LEFT JOIN c USING (state, year, "row", col)""")
def s09(spark, d):
    s = fx.scene_pixel(spark, d)
    keys = ["state", "year", "row", "col"]
    labels = s.groupBy(*keys).agg(F.avg(F.when(F.col("RED") > 0, F.col("RED"))).alias("label"))
    crop = s.filter("crop_mask").select(*keys, "crop_mask").distinct()
    out = readers.read_chip_stack(labels, s, crop, keys, _STACK_MONTHS, ("BLUE", "NIR_NARROW"))
    return rounded(out, "label", *[f"{b}_{m:02d}" for b in ("BLUE", "NIR_NARROW") for m in _STACK_MONTHS])


@check("K01_write_pixels", with_("vi_pixel") + f"""SELECT state, year, "row", col, {R('coalesce(NDVI_mean, -9999)')} AS NDVI_mean FROM vi_pixel""")
def k01(spark, d):
    path = shared_path(spark, "pixels")
    p = fx.vi_pixel(spark, d).select("state", "year", "row", "col", "NDVI_mean")
    even = F.crc32(F.col("state").cast("binary")) % 2 == 0
    # two sets of states in two calls, one of them again: neither write may touch the other's partitions
    for part in (p.filter(even).withColumn("NDVI_mean", F.lit(0.5)), p.filter(~even), p.filter(even)):
        sinks.write_pixels(part, path, ["NDVI_mean"], -9999.0)
    return rounded(spark.read.parquet(path), "NDVI_mean").select("state", "year", "row", "col", "NDVI_mean")


@check("K02_write_vi_pixels", with_("vi_pixel") + f"""SELECT state, year, "row", col, ln,
 CASE WHEN crop_mask AND valid_vi_mask THEN {R('NDVI_mean')} END AS NDVI_mean, CASE WHEN crop_mask THEN ln ELSE 0 END AS EVI_obsCount,
 crop_mask, crop_mask AND valid_vi_mask AS valid_vi_mask FROM (SELECT *, CAST(abs(hash_ln) AS INTEGER) AS ln FROM (
 SELECT *, CAST(floor(EVI_mean * 50 + 0.5) AS INTEGER) % 7 AS hash_ln FROM vi_pixel))""")
def k02(spark, d):
    p = fx.vi_pixel(spark, d).withColumn("ln", F.floor(F.col("EVI_mean") * 50 + 0.5).cast("int") % 7)
    for v in spectral.INDICES:
        p = p.withColumn(f"{v}_obsCount", F.col("ln"))
    p = p.withColumn("min_index_obsCount", F.col("ln"))
    path = shared_path(spark, "vi_pixels")
    even = F.crc32(F.col("state").cast("binary")) % 2 == 0
    for part in (p.filter(even).withColumn("crop_mask", F.lit(False)), p.filter(~even), p.filter(even)):
        sinks.write_vi_pixels(part, path, ["state", "year", "row", "col", "ln"])
    return rounded(spark.read.parquet(path), "NDVI_mean").select(
        "state", "year", "row", "col", "ln", "NDVI_mean", "EVI_obsCount", "crop_mask", "valid_vi_mask")


@check("K03_write_summary", with_("county_yield") + f"SELECT year, 'county' AS unit, fmt, count(*) AS n, {R('avg(yield_bu_ac)')} AS mean FROM county_yield, (VALUES ('csv'), ('parquet'), ('json')) AS f(fmt) GROUP BY 1, 3")
def k03(spark, d):
    path = shared_path(spark, "summary")
    out = fx.county_yield(spark, d).groupBy("year").agg(F.avg("yield_bu_ac").alias("mean"), F.count(F.lit(1)).alias("n"))
    for fmt in ("csv", "parquet", "json"):
        sinks.write_summary(out, f"{path}/{fmt}", fmt, unit="county")
    read = spark.read.schema("year int, mean double, n bigint, unit string")
    back = spark.read.parquet(f"{path}/parquet").withColumn("fmt", F.lit("parquet"))
    for fmt, other in (("csv", read.option("header", True).csv(f"{path}/csv")), ("json", read.json(f"{path}/json"))):
        back = back.unionByName(other.withColumn("fmt", F.lit(fmt)))
    return rounded(back, "mean")


@check("K04_append_log", with_("grids") + "SELECT CASE WHEN crs = 'EPSG:5070' THEN 'run-1' ELSE 'run-2' END AS run_id, crs = 'EPSG:5070' AS ok, raster_id AS unit FROM grids")
def k04(spark, d):
    path = shared_path(spark, "log")
    units = fx.grids(spark, d).select(F.col("raster_id").alias("unit"), (F.col("crs") == "EPSG:5070").alias("ok"))
    sinks.append_log(units.filter("ok"), path, "run-1")
    sinks.append_log(units.filter("not ok"), path, "run-2")
    return spark.read.schema("unit string, ok boolean, run_id string").json(path).select("run_id", "ok", "unit")


@check("K05_fingerprint", """SELECT p_partkey, substr(sha256('{"brand": "' || p_brand || '", "name": "' || p_name || '", "size": "' || CAST(p_size AS VARCHAR) || '"}'), 1, 16) AS fp FROM part""")
def k05(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", sinks.fingerprint_column(
        size=F.col("p_size"), name=F.col("p_name"), brand=F.col("p_brand")).alias("fp"))


# --- projections and predicates -------------------------------------------------------------

@check("P01_clean_fips", """SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0')
 ELSE CAST(c_custkey AS VARCHAR) END AS fips FROM customer""")
def p01(spark, d):
    c = F.col("c_custkey").cast("string")
    messy = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), c, F.lit(".0 "))).when(F.col("c_custkey") % 3 == 1, F.concat(c, F.lit(".0"))).otherwise(c)
    return fx.table(spark, d, "customer").select("c_custkey", codes.clean_fips(messy).alias("fips"))


@check("P02_geoid", with_("survey") + f"SELECT DISTINCT county_name, {_GEOID} AS geoid FROM survey")
def p02(spark, d):
    return fx.survey(spark, d).select("county_name", codes.geoid(F.col("state_fips_code"), F.col("county_code")).alias("geoid")).distinct()


@check("P03_parse_number", with_("survey") +
       "SELECT county_code, year, segment, TRY_CAST(replace(Value, ',', '') AS DOUBLE) AS value FROM survey")
def p03(spark, d):
    return fx.survey(spark, d).select("county_code", "year", "segment", codes.parse_number(F.col("Value")).alias("value"))


@check("P04_to_kg_ha", f"""SELECT l_orderkey, l_linenumber, l_returnflag, round(round_even(l_quantity * CASE l_returnflag WHEN 'A' THEN 67.251::DOUBLE
 WHEN 'N' THEN 62.77::DOUBLE ELSE 67.25::DOUBLE END, 4), 4) + 0.0 AS kg_ha FROM lineitem""")
def p04(spark, d):
    crop = F.when(F.col("l_returnflag") == "A", F.lit("soybeans")).when(F.col("l_returnflag") == "N", F.lit("Corn")).otherwise(F.lit("WHEAT"))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", codes.to_kg_ha(F.col("l_quantity"), crop).alias("kg_ha"))


@check("P05_exclude", with_("pixel") + """SELECT scene_id, county_fips, count(*) AS n FROM pixel WHERE scene_id NOT IN
 (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) GROUP BY 1, 2""")
def p05(spark, d):
    ids = fx.table(spark, d, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("scene_id"))
    return tables.exclude(fx.pixel(spark, d), ids, "scene_id").groupBy("scene_id", "county_fips").agg(F.count(F.lit(1)).alias("n"))


@check("P05b_exclusion_report", """SELECT p_partkey AS part, coalesce(n, 0) AS removed FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem
 GROUP BY 1) h ON l_partkey = p_partkey WHERE p_size > 25""")
def p05b(spark, d):
    ids = fx.table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("part"))
    rows = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"))
    return tables.exclusion_report(rows, ids, "part")


@check("P06_quality_filter", with_("county_vi") +
       "SELECT county_fips, year, crop_pixel_count FROM county_vi WHERE valid_pixel_fraction >= 0.7 AND crop_pixel_count >= 100")
def p06(spark, d):
    return tables.quality_filter(fx.county_vi(spark, d), 0.7, 100).select("county_fips", "year", "crop_pixel_count")


@check("P07_select_region", with_("county_yield") + f"""SELECT county_fips, year, {R('yield_bu_ac')} AS yield_bu_ac FROM county_yield
 WHERE year = 1997 AND CAST(county_fips AS INTEGER) = 7""")
def p07(spark, d):
    return rounded(tables.select_region(fx.county_yield(spark, d), year=1997, county_fips=7).select("county_fips", "year", "yield_bu_ac"), "yield_bu_ac")


@check("P08_scale_reflectance", with_("scene_pixel") + f"""SELECT scene_id, "row", col, {R('CASE WHEN RED > -9990 THEN RED * 0.0001 END')} AS red,
 {R('CASE WHEN NIR_NARROW > -9990 AND NIR_NARROW * 0.0001 BETWEEN 0.2 AND 0.8 THEN NIR_NARROW * 0.0001 END')} AS nir FROM scene_pixel""")
def p08(spark, d):
    return fx.scene_pixel(spark, d).select("scene_id", "row", "col", r(spectral.scale_reflectance(F.col("RED"))).alias("red"),
                                           r(spectral.scale_reflectance(F.col("NIR_NARROW"), (0.2, 0.8))).alias("nir"))


_CLEAR = "(fmask <> 255 AND (fmask & {bits}) = 0 AND ((fmask >> 6) & 3) <> 3)"


@check("P09_clear_mask", with_("pixel") + f"""SELECT fmask, count(*) AS n, bool_and({_CLEAR.format(bits=30)}) AS strict,
 bool_and({_CLEAR.format(bits=62)}) AS water, bool_and(fmask <> 255 AND (fmask & 26) = 0) AS loose FROM pixel GROUP BY fmask""")
def p09(spark, d):
    q = F.col("fmask")
    return fx.pixel(spark, d).groupBy("fmask").agg(
        F.count(F.lit(1)).alias("n"), F.every(spectral.clear_mask(q)).alias("strict"), F.every(spectral.clear_mask(q, mask_water=True)).alias("water"),
        F.every(spectral.clear_mask(q, mask_adjacent=False, mask_aerosol=False)).alias("loose"))


_OK = " AND ".join(f"{b} BETWEEN 0 AND 1.2" for b in ("nir", "red", "green", "blue", "swir1"))
_DEN = "(nir + 6.0 * red - 7.5 * blue + 1.0)"
SQL_INDICES = {
    "NDVI": "CASE WHEN {ok} AND abs(nir + red) > 1e-6 THEN (nir - red) / (nir + red) END",
    "EVI": f"CASE WHEN {{ok}} AND abs{_DEN} > 0.05 THEN 2.5 * (nir - red) / {_DEN} END",
    "GCVI": "CASE WHEN {ok} AND green > 0.02 AND green < 1.0 THEN nir / green - 1.0 END",
    "NDWI": "CASE WHEN {ok} AND abs(nir + swir1) > 1e-6 THEN (nir - swir1) / (nir + swir1) END"}


def _sql_indices(ok: str) -> str:
    return ", ".join(f"{R(q.format(ok=ok))} AS {v}" for v, q in SQL_INDICES.items())


@check("P10_vegetation_indices", with_("pixel") +
       f"""SELECT scene_id, "row", col, ln, {_sql_indices(f"(ln < 6 AND {_OK})")} FROM pixel""")
def p10(spark, d):
    c = F.col
    vi = spectral.vegetation_indices(c("blue"), c("green"), c("red"), c("nir"), c("swir1"), c("ln") < 6)
    return fx.pixel(spark, d).select("scene_id", "row", "col", "ln", *[r(x).alias(n) for n, x in vi.items()])


@check("P11_crop_mask", """SELECT p_partkey, p_size > 0 AS binary_mask, p_size = 5 AS raw_mask, p_size IN (5, 26) AS double_mask,
 (p_size / 50) > 0.5 AS fraction_mask FROM part""")
def p11(spark, d):
    c = F.col("p_size")
    return fx.table(spark, d, "part").select(
        "p_partkey", spectral.crop_mask(c).alias("binary_mask"), spectral.crop_mask(c, "raw").alias("raw_mask"),
        spectral.crop_mask(c, "raw", True).alias("double_mask"), spectral.crop_mask(c / 50, "fraction").alias("fraction_mask"))


@check("P12_target_valid", with_("pixel") + """SELECT scene_id, "row", col, ln, CAST((ln > 1)::INT + (ln > 3)::INT + (ln > 5)::INT AS INTEGER) AS months,
 crop_mask AND ln <> 7 AND (ln > 3) AS valid FROM pixel""")
def p12(spark, d):
    ln = F.col("ln")
    n = targets.month_count([ln > 1, ln > 3, ln > 5])
    label = F.when(ln == 7, F.lit(-9999.0)).otherwise(F.col("nir"))
    return fx.pixel(spark, d).select("scene_id", "row", "col", "ln", n.alias("months"),
                                     targets.target_valid(F.col("crop_mask"), label, n, 2).alias("valid"))


@check("P13_normalize", with_("scene_pixel", s="SELECT avg(RED) AS m, stddev_pop(RED) AS sd, avg(SWIR1) AS m1, stddev_pop(SWIR1) AS sd1 FROM scene_pixel WHERE RED > -9990") +
       f"""SELECT scene_id, "row", col, day::VARCHAR AS day, {R('(RED - m) / sd')} AS red_z, {R('(SWIR1 - m1) / sd1')} AS swir1_z, {R('(BLUE - 1087) / 2248.0')} AS blue_official
 FROM scene_pixel, s WHERE RED > -9990""")
def p13(spark, d):
    from fieldspark.operators.folds import band_statistics
    p = fx.scene_pixel(spark, d).filter("RED > -9990")
    s = band_statistics(p, [], ["RED", "SWIR1"]).first()
    z = scaling.normalize([F.col("RED"), F.col("SWIR1")], "fold", [s["RED_mean"], s["SWIR1_mean"]], [s["RED_std"], s["SWIR1_std"]])
    b = scaling.normalize([F.col("BLUE")], "official")
    return p.select("scene_id", "row", "col", F.col("day").cast("string").alias("day"), r(z[0]).alias("red_z"), r(z[1]).alias("swir1_z"), r(b[0]).alias("blue_official"))


@check("P14_target_scale", with_("county_yield", s="SELECT avg(yield_bu_ac) AS m, stddev_pop(yield_bu_ac) AS sd FROM county_yield") +
       f"""SELECT county_fips, year, {R('(yield_bu_ac - m) / sd')} AS z, {R('yield_bu_ac')} AS back, {R('yield_bu_ac - 3')} AS unit_scale FROM county_yield, s""")
def p14(spark, d):
    from fieldspark.operators.folds import target_scaler
    y = materialise(fx.county_yield(spark, d), "yield")
    s = target_scaler(y, "yield_bu_ac", "zscore").first()
    z = scaling.target_scale(F.col("yield_bu_ac"), "zscore", F.lit(s["center"]), F.lit(s["scale"]))
    return y.select("county_fips", "year", r(z).alias("z"), r(scaling.target_inverse(z, "zscore", F.lit(s["center"]), F.lit(s["scale"]))).alias("back"),
                    r(scaling.target_scale(F.col("yield_bu_ac"), "robust", F.lit(3.0), F.lit(0.0))).alias("unit_scale"))


@check("P15_pixel_xy_chip_sample_id", with_("pixel") + f"""SELECT "row", col, year, state, {R('500000 + 30 * (col + 0.5)')} AS x, {R('2000000 - 30 * ("row" + 0.5)')} AS y,
 CAST(floor("row" / 64) * 64 AS INTEGER) AS chip_row, 'soybeans_' || state || '_' || year || '_r' || CAST(floor("row" / 64) * 64 AS INTEGER) || '_c' || CAST(floor(col / 64) * 64 AS INTEGER) AS sample_id FROM pixel""")
def p15(spark, d):
    x, y = geo.pixel_xy(F.col("row"), F.col("col"), *[F.lit(v) for v in (30.0, 0.0, 500000.0, 0.0, -30.0, 2000000.0)])
    r0, c0 = geo.chip_of(F.col("row"), 64), geo.chip_of(F.col("col"), 64)
    return fx.pixel(spark, d).select("row", "col", "year", "state", r(x).alias("x"), r(y).alias("y"), r0.alias("chip_row"),
                                     geo.sample_id(F.lit("SOYBEANS"), F.col("state"), F.col("year"), r0, c0).alias("sample_id"))


_K = geo.albers_constants()
SQL_ALBERS = f"""lon_lat AS (SELECT *, degrees(atan2(x, {_K['rho0']!r}::DOUBLE - y) / {_K['n']!r}::DOUBLE) - 96.0 AS lon,
 degrees(beta + {_K['s2']!r}::DOUBLE * sin(2 * beta) + {_K['s4']!r}::DOUBLE * sin(4 * beta) + {_K['s6']!r}::DOUBLE * sin(6 * beta)) AS lat FROM (
 SELECT *, asin((({_K['c']!r}::DOUBLE - (x * x + ({_K['rho0']!r}::DOUBLE - y) * ({_K['rho0']!r}::DOUBLE - y)) * {_K['n'] ** 2 / geo.A_AXIS ** 2!r}::DOUBLE) / {_K['n']!r}::DOUBLE) / {_K['qp']!r}::DOUBLE) AS beta FROM xy))"""


@check("P16_chip_center_lonlat", with_("grids", xy="SELECT raster_id, c + a * (112 + 0.5) AS x, f + e * (112 + 0.5) AS y FROM grids").rstrip() + ", " + SQL_ALBERS +
       f" SELECT raster_id, {R('lon')} AS lon, {R('lat')} AS lat FROM lon_lat")
def p16(spark, d):
    x, y = geo.pixel_xy(F.lit(112), F.lit(112), *[F.col(k) for k in "abcdef"])
    lon, lat = geo.lonlat(x, y)
    return fx.grids(spark, d).select("raster_id", r(lon).alias("lon"), r(lat).alias("lat"))


@check("P17_canonical_bands", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'B05' ELSE 'B8A' END AS nir_key,
 CASE WHEN event_id % 2 = 0 THEN 'B05' ELSE 'B8A' END || '_' || CAST(event_id AS VARCHAR) || '.tif' AS nir_file FROM events WHERE event_type <> 'error'""")
def p17(spark, d):
    e = fx.scenes(spark, d)
    keys = sorted({*spectral.L30_ASSETS.values(), *spectral.S30_ASSETS.values()})
    entries = [v for k in keys for v in (F.lit(k), F.concat(F.lit(f"https://host/a/{k}_"), F.col("event_id").cast("string"), F.lit(".tif?sig=1")))]
    assets = F.create_map(*entries)
    # scenes without a cloud value also miss one asset
    assets = F.when(F.col("cloud_cover").isNull(), F.map_filter(assets, lambda k, v: k != "B04")).otherwise(assets)
    catalogue = materialise(e.select("id", "event_id", assets.alias("assets")), "catalogue")
    out = catalogue.withColumn("bands", spectral.canonical_bands(F.col("id"), F.lit(None).cast("string"), F.col("assets"))).filter(F.col("bands").isNotNull())
    nir = F.col("bands")["NIR_NARROW"]
    return out.select("event_id", nir["asset_key"].alias("nir_key"), nir["filename"].alias("nir_file"))


@check("P18_collections_for", """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) + INTERVAL 17 YEAR >= DATE '2015-11-28' THEN 'HLSL30_2.0,HLSS30_2.0' ELSE 'HLSL30_2.0' END AS collections FROM orders""")
def p18(spark, d):
    later = F.add_months(F.col("o_orderdate").cast("date"), 17 * 12)
    return fx.table(spark, d, "orders").select("o_orderkey", F.array_join(dates.collections_for(later), ",").alias("collections"))


@check("P19_month_window", """SELECT DISTINCT y AS year, m AS month, CAST(make_date(y, m, 1) AS VARCHAR) AS first_day,
 CAST(CASE WHEN m = 11 THEN make_date(y, 11, 15) ELSE CAST(last_day(make_date(y, m, 1)) AS DATE) END AS VARCHAR) AS last_day FROM (
 SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders)""")
def p19(spark, d):
    ym = fx.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return ym.select("year", "month", dates.month_start(F.col("year"), F.col("month")).cast("string").alias("first_day"),
                     dates.month_end(F.col("year"), F.col("month")).cast("string").alias("last_day"))


_MID = [(m, max(1, (a + b) // 2)) for m, a, b in dates.TIMESTEPS]


@check("P20_representative_dates", f"""SELECT y AS year, CAST(dayofyear(day) AS INTEGER) AS doy, CAST(day AS VARCHAR) AS day FROM (SELECT y, unnest([{', '.join(f'make_date(y, {m}, {a})' for m, a in _MID)}]) AS day
 FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders))""")
def p20(spark, d):
    years = fx.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    z = F.arrays_zip(dates.temporal_coords(F.col("year")).alias("t"), dates.representative_dates(F.col("year")).alias("day"))
    return years.select(F.explode(z).alias("z")).select(F.col("z.t.year").alias("year"), F.col("z.t.doy").alias("doy"), F.col("z.day").cast("string").alias("day"))


@check("P21_location_coords", with_("grids") + f"SELECT raster_id, {R('f')} AS lat, {R('c')} AS lon FROM grids")
def p21(spark, d):
    return fx.grids(spark, d).select("raster_id", geo.location_coords(F.col("f"), F.col("c")).alias("p")) \
        .select("raster_id", r(F.col("p")[0]).alias("lat"), r(F.col("p")[1]).alias("lon"))


@check("P22_zero_as_missing", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('nullif(l_tax, 0)')} AS tax FROM lineitem")
def p22(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(nulls.zero_as_missing(F.col("l_tax"))).alias("tax"))


_EXT = with_("predictions", low="""SELECT *, CAST(floor("row" / 64) * 64 AS INTEGER) AS r0, CAST(floor(col / 64) * 64 AS INTEGER) AS c0,
 500000 + 30.0::DOUBLE * (col + 0.5) AS x, 2000000 - 30.0::DOUBLE * ("row" + 0.5) AS y FROM predictions WHERE pred < 10""", xy="SELECT * FROM low").rstrip() + ", " + SQL_ALBERS


def _extremes(spark, d):
    p = fx.predictions(spark, d).withColumns({k: F.lit(v) for k, v in zip("abcdef", (30.0, 0.0, 500000.0, 0.0, -30.0, 2000000.0))})
    p = p.withColumn("county_geoid", F.when(F.col("county_fips") != "00003", F.col("county_fips"))) \
        .withColumn("county", F.when(F.col("county_geoid").isNotNull(), F.concat(F.lit("NAME "), F.col("county_geoid"))))
    return scoring.extreme_predictions(p, 10.0, "soybeans", 64)


@check("P23_extreme_predictions", _EXT + f""" SELECT "row", col, 'soybeans_' || state || '_' || year || '_r' || r0 || '_c' || c0 AS sample_id, {R('pred')} AS predicted,
 {R('target')} AS actual, {R('lat')} AS lat, {R('lon')} AS lon, CASE WHEN county_fips = '00003' THEN 'OUTSIDE_COUNTIES' ELSE 'NAME ' || county_fips END AS county FROM lon_lat""")
def p23(spark, d):
    return rounded(_extremes(spark, d), "predicted", "actual", "lat", "lon").select("row", "col", "sample_id", "predicted", "actual", "lat", "lon", "county")


@check("A33_extreme_summary", _EXT + f""" SELECT CASE WHEN county_fips = '00003' THEN 'OUTSIDE_COUNTIES' ELSE 'NAME ' || county_fips END AS county, count(*) AS n_pixels,
 {R('min(pred)')} AS min_pred, {R('avg(pred)')} AS mean_pred, {R('avg(target)')} AS mean_actual FROM lon_lat GROUP BY 1""")
def a33(spark, d):
    return rounded(scoring.extreme_summary(_extremes(spark, d), "county"), "min_pred", "mean_pred", "mean_actual")


@check("P24_residual", with_("predictions") + f"""SELECT "row", col, sample_id, year, {R('pred')} AS prediction_full, CASE WHEN crop_mask AND ln <> 7 THEN {R('pred')} END AS prediction,
 CASE WHEN crop_mask AND ln <> 7 THEN {R('target')} END AS actual, CASE WHEN crop_mask AND ln <> 7 THEN {R('pred - target')} END AS residual FROM predictions""")
def p24(spark, d):
    p = fx.predictions(spark, d)
    out = scoring.residuals(p, F.col("crop_mask") & (F.col("ln") != 7))
    return rounded(out, "prediction_full", "prediction", "actual", "residual").select("row", "col", "sample_id", "year", "prediction_full", "prediction", "actual", "residual")


def _sql_unit(seed, salt, key):
    return f"(CAST(('0x' || substr(md5('{seed}|{salt}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@check("P25_augment_flips", with_("predictions") + f"""SELECT sample_id, year, CASE WHEN {_sql_unit(7, 'h', 'sample_id')} < 0.5 THEN 511 - "row" ELSE "row" END AS "row",
 CASE WHEN {_sql_unit(7, 'w', 'sample_id')} < 0.5 THEN 511 - col ELSE col END AS col, {R('pred')} AS pred, {R('target')} AS target FROM predictions""")
def p25(spark, d):
    p = fx.predictions(spark, d).select("sample_id", "year", "row", "col", "pred", "target")
    return rounded(scoring.augment(p, "sample_id", 512, 512, 7, ["pred"]), "pred", "target")


_WHERE = """sample_id || '|' || CAST("row" AS VARCHAR) || '|' || CAST(col AS VARCHAR)"""


@check("P25b_augment_noise", with_("predictions") + f"""SELECT sample_id, year, CASE WHEN {_sql_unit(7, 'h', 'sample_id')} < 0.5 THEN 511 - "row" ELSE "row" END AS "row",
 CASE WHEN {_sql_unit(7, 'w', 'sample_id')} < 0.5 THEN 511 - col ELSE col END AS col, {R('target')} AS target,
 {R(f"pred + CASE WHEN {_sql_unit(7, 'n', 'sample_id')} < 0.5 THEN 0.1 * sqrt(-2 * ln(greatest({_sql_unit(7, 'pred1', _WHERE)}, 1e-12))) * cos(2 * pi() * {_sql_unit(7, 'pred2', _WHERE)}) ELSE 0 END")} AS pred FROM predictions""")
def p25b(spark, d):
    p = fx.predictions(spark, d).select("sample_id", "year", "row", "col", "pred", "target")
    return rounded(scoring.augment(p, "sample_id", 512, 512, 7, ["pred"], noise_p=0.5, noise_std=0.1), "pred", "target")


@check("P26_lookups", f"""SELECT s_suppkey, {fx.SQL_FIPS.format(k='s_nationkey')} AS fips, CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 22 END AS crop_code FROM supplier""")
def p26(spark, d):
    crop = F.element_at(F.array(F.lit("Soybeans"), F.lit("corn"), F.lit("WHEAT")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return fx.table(spark, d, "supplier").select("s_suppkey", codes.state_fips(fx.state_of(F.col("s_nationkey"))).alias("fips"), codes.crop_code(crop).alias("crop_code"))


@check("F10_text_functions", """SELECT p_partkey, trim(regexp_replace('_' || p_name || ' #' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS safe FROM part""")
def f10(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", codes.safe_name(F.concat(F.lit("_"), "p_name", F.lit(" #"), "p_brand")).alias("safe"))
