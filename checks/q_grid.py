"""Grids, spatial joins, tiles, manifests and label surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions.geo import chip_of
from fieldspark.operators import grid, labels, manifest, metrics, spatial
from fieldspark.plans import materialise

from . import fixtures as fx
from .fixtures import with_
from .q_sources import SQL_ALBERS
from .registry import R, check, rounded

_CROSS = "((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)"
_PX = """SELECT DISTINCT "row", col, col + 0.5::DOUBLE AS px, "row" + 0.5::DOUBLE AS py FROM pixel"""
_HITS = f"""SELECT "row", col, k, any_value(geoid) AS geoid, any_value(name) AS name FROM px JOIN edges ON true GROUP BY 1, 2, k HAVING count(CASE WHEN {_CROSS} THEN 1 END) % 2 = 1"""


def _centres(spark, d):
    return fx.pixel(spark, d).select("row", "col").distinct() \
        .withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)


@check("J03_point_in_polygon_burn", with_("pixel", "edges", px=_PX, hits=_HITS) +
       f"""SELECT "row", col, {R('max_by(k, k) * 1.5')} AS value, max_by(name, k) AS name FROM hits WHERE k <> 7 GROUP BY 1, 2""")
def j03(spark, d):
    s = fx.shapes(spark, d).withColumn("value", F.when(F.col("shape_order") != 7, F.col("shape_order") * 1.5)).withColumnRenamed("NAME", "name")
    return rounded(spatial.burn(_centres(spark, d), s, "value", ["row", "col"], extra=["name"]), "value")


@check("A35_alignment_audit", with_("pixel", "edges", px=_PX, hits=_HITS, inside='SELECT DISTINCT "row", col FROM hits') +
       f"""SELECT year, count(CASE WHEN i."row" IS NOT NULL THEN 1 END) AS inside_px, count(CASE WHEN i."row" IS NULL THEN 1 END) AS outside_px,
 {R('min(p.col + 0.5)')} AS "left", {R('max(p.col + 0.5)')} AS "right", {R('min(p."row" + 0.5)')} AS bottom, {R('max(p."row" + 0.5)')} AS top
 FROM pixel p LEFT JOIN inside i ON p."row" = i."row" AND p.col = i.col GROUP BY 1""")
def a35(spark, d):
    burned = spatial.burn(_centres(spark, d), fx.shapes(spark, d), "shape_order", ["row", "col"], order="shape_order")
    p = fx.pixel(spark, d).join(burned, ["row", "col"], "left") \
        .withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)
    return rounded(spatial.alignment_audit(p, F.col("shape_order").isNotNull(), ["year"]), "left", "right", "bottom", "top")


_CHIPS = """SELECT CAST(floor("row" / 64) * 64 AS INTEGER) AS row_off, CAST(floor(col / 64) * 64 AS INTEGER) AS col_off, count(*) AS n FROM pixel WHERE crop_mask GROUP BY 1, 2 HAVING count(*) % 3 <> 0"""
_EXTENT = """SELECT s_suppkey AS scene_id, greatest(0, CAST(s_suppkey * 37 % 600 - 50 AS INTEGER)) AS row0, least(512, CAST(s_suppkey * 37 % 600 - 50 + s_suppkey % 3 * 60 AS INTEGER)) AS row1,
 greatest(0, CAST(s_suppkey * 53 % 560 - 40 AS INTEGER)) AS col0, least(512, CAST(s_suppkey * 53 % 560 - 40 + 70 AS INTEGER)) AS col1 FROM supplier"""


def _chips_extents(spark, d):
    p = fx.pixel(spark, d).filter("crop_mask")
    chips = p.groupBy(chip_of(F.col("row"), 64).alias("row_off"), chip_of(F.col("col"), 64).alias("col_off")).agg(F.count(F.lit(1)).alias("n")).filter("n % 3 <> 0")
    k = F.col("s_suppkey")
    r0, c0 = k * 37 % 600 - 50, k * 53 % 560 - 40
    e = fx.table(spark, d, "supplier").select(
        k.alias("scene_id"), F.greatest(F.lit(0), r0).cast("int").alias("row0"), F.least(F.lit(512), r0 + k % 3 * 60).cast("int").alias("row1"),
        F.greatest(F.lit(0), c0).cast("int").alias("col0"), F.least(F.lit(512), c0 + 70).cast("int").alias("col1"))
    return chips, e


_OVER = "row1 > row0 AND col1 > col0 AND row_off < row1 AND row_off + 64 > row0 AND col_off < col1 AND col_off + 64 > col0"


@check("J04_scene_chips", with_("pixel", chips=_CHIPS, e=_EXTENT) + f"SELECT scene_id, row_off, col_off FROM e JOIN chips ON {_OVER}")
def j04(spark, d):
    chips, e = _chips_extents(spark, d)
    return spatial.scene_chips(e, chips, 64, []).select("scene_id", "row_off", "col_off")


@check("J04b_scenes_over_chips", with_("pixel", chips=_CHIPS, e=_EXTENT) + f"SELECT DISTINCT scene_id, row0, row1, col0, col1 FROM e JOIN chips ON {_OVER}")
def j04b(spark, d):
    chips, e = _chips_extents(spark, d)
    return spatial.scenes_over_chips(e, chips, 64, []).select("scene_id", "row0", "row1", "col0", "col1")


@check("J05_bbox_overlaps", with_("scenes", c="""SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS geoid, CAST(s_suppkey * 13 % 340 - 170 AS DOUBLE) AS cx0, CAST(s_suppkey * 7 % 160 - 80 AS DOUBLE) AS cy0 FROM supplier""") +
       """SELECT event_id AS scene_id, geoid FROM scenes JOIN c ON xmin IS NULL OR (xmax >= cx0 AND xmin <= cx0 + 3 AND ymax >= cy0 AND ymin <= cy0 + 2)""")
def j05(spark, d):
    k = F.col("s_suppkey")
    c = fx.table(spark, d, "supplier").select(fx.code5(k).alias("geoid"), (k * 13 % 340 - 170).cast("double").alias("xmin"), (k * 7 % 160 - 80).cast("double").alias("ymin")) \
        .withColumn("xmax", F.col("xmin") + 3).withColumn("ymax", F.col("ymin") + 2)
    s = fx.scenes(spark, d).select(F.col("event_id").alias("scene_id"), "xmin", "ymin", "xmax", "ymax")
    return spatial.bbox_overlaps(s, c, 10.0)


def _two_grids(spark, d):
    g = fx.table(spark, d, "supplier").select(fx.state_of(F.col("s_nationkey")).alias("state")).distinct()
    base = g.withColumns({"a": F.lit(30.0), "e": F.lit(-30.0), "f": F.lit(2000000.0), "crs": F.lit("EPSG:5070")})
    return base.withColumn("c", F.lit(500030.0)), base.withColumn("c", F.lit(500000.0))


_LAB = 'SELECT state, "row", col, avg(nir) AS nir FROM pixel GROUP BY 1, 2, 3'
_CROPPX = 'SELECT DISTINCT state, "row", col FROM pixel WHERE crop_mask'


@check("J06_aligned_join", with_("pixel", lab=_LAB, cr=_CROPPX) + f"""SELECT l.state, l."row", l.col, {R('nir')} AS nir, c.state IS NOT NULL AS crop_mask FROM lab l
 LEFT JOIN cr c ON c.state = l.state AND c."row" = l."row" AND c.col = l.col + 1""")
def j06(spark, d):
    p = fx.pixel(spark, d)
    lab = p.groupBy("state", "row", "col").agg(F.avg("nir").alias("nir"))
    crop = p.filter("crop_mask").select("state", "row", "col").distinct().withColumn("crop_mask", F.lit(True))
    off = grid.grid_offset(*_two_grids(spark, d), ["state"])
    out = grid.aligned_join(lab, crop, off, ["state"], "left")
    return rounded(out.withColumn("crop_mask", F.coalesce("crop_mask", F.lit(False))), "nir")


@check("J15_pixel_field_join", with_("predictions", f="""SELECT state, "row", col, min(field_id) AS field_id FROM predictions GROUP BY 1, 2, 3""") + f"""SELECT f.field_id, count(*) AS n_px, {R('avg(pred)')} AS pred_mean
 FROM predictions p JOIN f ON f.state = p.state AND f."row" = p."row" AND f.col = p.col + 1 WHERE f.field_id > 0 GROUP BY 1 HAVING count(*) >= 5""")
def j15(spark, d):
    p = fx.predictions(spark, d)
    zones = p.groupBy("state", "row", "col").agg(F.min("field_id").alias("field_id"))
    off = grid.grid_offset(*_two_grids(spark, d), ["state"])
    j = grid.aligned_join(p.select("state", "row", "col", "pred", F.col("target").alias("actual")), zones, off, ["state"])
    return rounded(metrics.field_means(j).select("field_id", "n_px", "pred_mean"), "pred_mean")


_GRID2 = {"t_a": 30.0, "t_e": -30.0, "t_c": 500000.0, "t_f": 2000000.0, "s_a": 110.0, "s_e": -110.0, "s_c": 499950.0, "s_f": 2000040.0}
_SRC = """SELECT state, CAST("row" % 100 AS INTEGER) AS "row", CAST(col % 130 AS INTEGER) AS col, avg(pred) AS v FROM predictions WHERE ("row" + col) % 7 <> 0 GROUP BY 1, 2, 3"""
_TGT = 'SELECT DISTINCT state, "row", col FROM predictions'


def _regrid_inputs(spark, d):
    p = fx.predictions(spark, d)
    src = p.filter("(row + col) % 7 <> 0").groupBy("state", (F.col("row") % 100).cast("int").alias("row"), (F.col("col") % 130).cast("int").alias("col")).agg(F.avg("pred").alias("v"))
    g = p.select("state").distinct().withColumns({k: F.lit(v) for k, v in _GRID2.items()})
    return p.select("state", "row", "col").distinct(), src, g


_SR = '((2000000 - 30.0::DOUBLE * ("row" + 0.5)) - 2000040) / -110.0::DOUBLE'
_SC = "((500000 + 30.0::DOUBLE * (col + 0.5)) - 499950) / 110.0::DOUBLE"


@check("J12_regrid_nearest", with_("predictions", src=_SRC, tgt=_TGT, t=f"SELECT *, CAST(floor({_SR}) AS INTEGER) AS sr, CAST(floor({_SC}) AS INTEGER) AS sc FROM tgt") +
       f"""SELECT t.state, t."row", t.col, {R('v')} AS v FROM t LEFT JOIN src s ON s.state = t.state AND s."row" = sr AND s.col = sc""")
def j12(spark, d):
    t, s, g = _regrid_inputs(spark, d)
    return rounded(grid.regrid_nearest(t, s, g, ["state"]), "v")


@check("J13_regrid_bilinear", with_("predictions", src=_SRC, tgt=_TGT, t=f"SELECT *, {_SR} - 0.5 AS fr, {_SC} - 0.5 AS fc FROM tgt",
       n="""SELECT state, "row", col, CAST(floor(fr) AS INTEGER) + i AS sr, CAST(floor(fc) AS INTEGER) + j AS sc,
 (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""") +
       f"""SELECT n.state, n."row", n.col, {R('sum(CASE WHEN v IS NOT NULL THEN w * v END) / sum(CASE WHEN v IS NOT NULL THEN w END)')} AS v FROM n
 LEFT JOIN src s ON s.state = n.state AND s."row" = sr AND s.col = sc WHERE w > 0 GROUP BY 1, 2, 3""")
def j13(spark, d):
    t, s, g = _regrid_inputs(spark, d)
    return rounded(grid.regrid_bilinear(t, s, g, ["state"], "v"), "v")


def _tiles(h: str, chip: int, stride: int) -> str:
    return f"unnest(list_distinct(list_concat(range(0, greatest({h} - {chip}, 0) + 1, {stride}), [greatest({h} - {chip}, 0)])))"


_T1 = with_("grids", t0=f"SELECT *, CAST({_tiles('height', 224, 112)} AS INTEGER) AS row_off FROM grids", t=f"SELECT *, CAST({_tiles('width', 224, 112)} AS INTEGER) AS col_off FROM t0")


@check("T01_tile_windows", _T1 + "SELECT raster_id, row_off, col_off, least(224, height) AS tile_height, least(224, width) AS tile_width FROM t")
def t01(spark, d):
    return grid.tile_windows(fx.grids(spark, d), 224, 112).select("raster_id", "row_off", "col_off", "tile_height", "tile_width")


@check("T02_whole_tiles", with_("grids", t="SELECT *, unnest(range(0, height - 224 + 1, 224)) AS r FROM grids WHERE height >= 224 AND width >= 224") +
       "SELECT raster_id, CAST(r AS INTEGER) AS row_off, CAST(unnest(range(0, width - 224 + 1, 224)) AS INTEGER) AS col_off FROM t")
def t02(spark, d):
    return grid.whole_tiles(fx.grids(spark, d), 224).select("raster_id", "row_off", "col_off")


@check("T03_build_manifest", (_T1.rstrip() + ", xy AS (SELECT *, c + a * (col_off + 112 + 0.5) AS x, f + e * (row_off + 112 + 0.5) AS y FROM t), " + SQL_ALBERS +
       f""" SELECT 'soybeans_' || state || '_' || year || '_r' || row_off || '_c' || col_off AS sample_id, year, state, (['17','19','18','27','31'])[list_position(['IL','IA','IN','MN','NE'], state)] AS state_fips,
 row_off, col_off, crs, {R('lat')} AS center_lat, {R('lon')} AS center_lon, year || '-04-15,' || year || '-05-16,' || year || '-06-15,' || year || '-07-16,' || year || '-08-16,' || year || '-09-15,' || year || '-10-16,' || year || '-11-08' AS dates FROM lon_lat"""))
def t03(spark, d):
    m = manifest.build_manifest(fx.grids(spark, d), "soybeans", "nearest", 224, 112)
    m = m.withColumn("dates", F.array_join(F.col("dates").cast("array<string>"), ","))
    return rounded(m.select("sample_id", "year", "state", "state_fips", "row_off", "col_off", "crs", "center_lat", "center_lon", "dates"), "center_lat", "center_lon")


_STATE_CROP = 'SELECT DISTINCT state, year, "row", col FROM pixel WHERE crop_mask'
_FRAC = """SELECT state, year, CAST(floor("row" / 64) * 64 AS INTEGER) AS row_off, CAST(floor(col / 64) * 64 AS INTEGER) AS col_off, count(*) AS crop_px, count(*) / 4096.0::DOUBLE AS crop_fraction FROM cp GROUP BY 1, 2, 3, 4"""


def _label_grids(spark, d):
    """Raster metadata is a small stored table, so it is written once."""
    years = materialise(fx.pixel(spark, d).select("state", "year").distinct(), "label_grids")
    return years.withColumns({
        "height": F.lit(500), "width": F.lit(460), "a": F.lit(30.0), "b": F.lit(0.0), "c": F.lit(500000.0), "d": F.lit(0.0),
        "e": F.lit(-30.0), "f": F.lit(2000000.0), "crs": F.lit("EPSG:5070")})


@check("A31_chip_crop_gate", with_("pixel", cp=_STATE_CROP, f=_FRAC) + f"""SELECT state, year, row_off, col_off, crop_px, {R('crop_fraction')} AS crop_fraction FROM f
 WHERE crop_px >= 14 AND row_off + 64 <= 500 AND col_off + 64 <= 460""")
def a31(spark, d):
    cp = fx.pixel(spark, d).filter("crop_mask").select("state", "year", "row", "col", "crop_mask").distinct()
    out = manifest.qualifying_chips(cp, _label_grids(spark, d), ["state", "year"], 64, 14 / 4096)
    return rounded(out.select("state", "year", "row_off", "col_off", "crop_px", "crop_fraction"), "crop_fraction")


_MAN = f"""SELECT state, year, CAST({_tiles('500', 64, 64)} AS INTEGER) AS row_off FROM (SELECT DISTINCT state, year FROM pixel)"""
_MAN2 = f"SELECT *, CAST({_tiles('460', 64, 64)} AS INTEGER) AS col_off FROM man0"


@check("J09_manifest_semi_join", with_("pixel", cp=_STATE_CROP, f=_FRAC, man0=_MAN, man=_MAN2) + """SELECT 'soybeans_' || state || '_' || year || '_r' || row_off || '_c' || col_off AS sample_id FROM man
 WHERE (state, year, row_off, col_off) IN (SELECT state, year, row_off, col_off FROM f WHERE crop_px >= 14)""")
def j09(spark, d):
    m = manifest.build_manifest(_label_grids(spark, d), "soybeans", "nearest", 64, 64)
    cp = fx.pixel(spark, d).filter("crop_mask").select("state", "year", "row", "col", "crop_mask").distinct()
    good = manifest.chip_crop_fraction(cp, ["state", "year"], 64).filter("crop_px >= 14")
    return manifest.semi_join_chips(m, good).select("sample_id")


@check("T04_filter_manifest", with_("pixel", "edges", px=_PX, hits=_HITS, inside='SELECT DISTINCT "row", col FROM hits',
       cp="""SELECT DISTINCT p.state, p.year, p."row", p.col - 1 AS col FROM pixel p JOIN inside i ON i."row" = p."row" AND i.col = p.col WHERE p.crop_mask AND p.col >= 1""",
       f=_FRAC, man0=_MAN, man=_MAN2, m="SELECT *, 'soybeans_' || state || '_' || year || '_r' || row_off || '_c' || col_off AS sample_id FROM man") +
       """SELECT sample_id, state, year, row_off, col_off FROM m WHERE (state, year, row_off, col_off) IN (SELECT state, year, row_off, col_off FROM f WHERE crop_px >= 11 AND row_off + 64 <= 500 AND col_off + 64 <= 460)
 AND sample_id NOT IN (SELECT sample_id FROM m WHERE row_off = 64 AND year % 2 = 0)""")
def t04(spark, d):
    grids = _label_grids(spark, d)
    m = manifest.build_manifest(grids, "soybeans", "nearest", 64, 64)
    crop = fx.pixel(spark, d).filter("crop_mask").select("state", "year", "row", "col")
    crop = spatial.clip_to_region(crop, fx.shapes(spark, d), F.col("col") + 0.5, F.col("row") + 0.5).distinct()
    label, mask = _two_grids(spark, d)
    on_label = grid.shift_to(crop, grid.grid_offset(mask, label, ["state"]), ["state"]).filter("col >= 0").withColumn("crop_mask", F.lit(True))
    out = m.filter("row_off = 64 and year % 2 = 0").select("sample_id")
    kept = manifest.filter_manifest(m, on_label, grids, 64, 11 / 4096, out)
    return kept.select("sample_id", "state", "year", "row_off", "col_off")


@check("T05_split_by_county", with_("pixel", b="""SELECT state, year, county_fips AS piece, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pixel WHERE crop_mask GROUP BY 1, 2, 3""") +
       f"""SELECT p.state, p.year, piece, count(*) AS n, {R('avg(nir)')} AS nir FROM pixel p JOIN b ON b.state = p.state AND b.year = p.year AND "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY 1, 2, 3""")
def t05(spark, d):
    p = fx.pixel(spark, d)
    boxes = grid.county_boxes(p.filter("crop_mask"), ["state", "year"])
    out = grid.split_by_boxes(p.select("state", "year", "row", "col", "nir"), boxes, ["state", "year"])
    return rounded(out.groupBy("state", "year", "piece").agg(F.count(F.lit(1)).alias("n"), F.avg("nir").alias("nir")), "nir")


@check("T06_snap_extent", with_("grids", e="SELECT raster_id, c + 17 AS l, c + 17 + 30 * width AS r, f AS t, f - 30 * height AS b FROM grids",
       s="""SELECT *, CAST(floor((l + 306720) / 6720) * 224 AS INTEGER) AS col0, CAST(floor((2100000 - t) / 6720) * 224 AS INTEGER) AS row0 FROM e""") +
       f"""SELECT raster_id, row0, col0, CAST(ceil((r - (-306720 + col0 * 30)) / 6720) * 224 AS INTEGER) AS ncols, CAST(ceil(((2100000 - row0 * 30) - b) / 6720) * 224 AS INTEGER) AS nrows, {R('-306720 + col0 * 30')} AS x0 FROM s""")
def t06(spark, d):
    g = fx.grids(spark, d).select("raster_id", (F.col("c") + 17).alias("left"), (F.col("c") + 17 + 30 * F.col("width")).alias("right"), F.col("f").alias("top"),
                                  (F.col("f") - 30 * F.col("height")).alias("bottom"), F.lit(-306720.0).alias("ox"), F.lit(2100000.0).alias("oy"))
    return rounded(grid.snap_extent(g, 30.0, 224).select("raster_id", "row0", "col0", "ncols", "nrows", "x0"), "x0")


@check("T07_pseudo_region", with_("pixel") + """SELECT year, count(*) AS source_px, count(CASE WHEN "row" < 448 AND col < 448 THEN 1 END) AS kept_px, count(*) <> count(CASE WHEN "row" < 448 AND col < 448 THEN 1 END) AS lost_pixels,
 count(CASE WHEN "row" < 448 AND col < 448 THEN 1 END) AS label_px FROM pixel WHERE ln <> 7 GROUP BY 1""")
def t07(spark, d):
    p = fx.pixel(spark, d).select("year", "row", "col", F.when(F.col("ln") != 7, F.col("nir")).alias("v"), F.lit(448).alias("nrows"), F.lit(448).alias("ncols"))
    label, lost = grid.pseudo_region(p, "v")
    return lost.join(label.groupBy("year").agg(F.count("label").alias("label_px")), "year")


_Y99 = "SELECT CAST(county_fips AS INTEGER) AS k, yield_bu_ac AS v FROM county_yield WHERE year = 1999 AND county_fips <> '00007'"

@check("T08_label_surfaces", with_("pixel", "edges", "county_yield", y=_Y99, px=_PX, hits=_HITS, cr='SELECT DISTINCT "row", col FROM pixel WHERE crop_mask AND year = 1999',
       near="""SELECT h."row", h.col, max_by(v, h.k) AS nearest FROM hits h JOIN y ON y.k = h.k GROUP BY 1, 2""",
       sq="""SELECT r, c, (c + 0.5) * (512.0::DOUBLE / 12) AS px, (r + 0.5) * (512.0::DOUBLE / 12) AS py FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS r), (SELECT CAST(unnest(range(12)) AS INTEGER) AS c)""",
       sh=f"""SELECT r, c, k FROM sq, edges GROUP BY 1, 2, k HAVING count(CASE WHEN {_CROSS} THEN 1 END) % 2 = 1""", lo="SELECT r, c, max_by(v, sh.k) AS v FROM sh JOIN y ON y.k = sh.k GROUP BY 1, 2",
       tgt="""SELECT DISTINCT cr."row", cr.col FROM cr JOIN hits h ON h."row" = cr."row" AND h.col = cr.col""",
       t="""SELECT *, ("row" + 0.5) / (512.0::DOUBLE / 12) - 0.5 AS fr, (col + 0.5) / (512.0::DOUBLE / 12) - 0.5 AS fc FROM tgt""",
       n="""SELECT "row", col, CAST(floor(fr) AS INTEGER) + i AS sr, CAST(floor(fc) AS INTEGER) + j AS sc,
 (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""",
       sm="""SELECT n."row", n.col, sum(CASE WHEN v IS NOT NULL THEN w * v END) / sum(CASE WHEN v IS NOT NULL THEN w END) AS bilinear FROM n LEFT JOIN lo ON lo.r = sr AND lo.c = sc WHERE w > 0 GROUP BY 1, 2""") +
       f"""SELECT tgt."row", tgt.col, {R('nearest')} AS nearest, {R('bilinear')} AS bilinear FROM tgt LEFT JOIN near USING ("row", col) LEFT JOIN sm USING ("row", col)""")
def t08(spark, d):
    crop = fx.pixel(spark, d).filter("crop_mask and year = 1999")
    y = materialise(fx.county_yield(spark, d).filter("year = 1999 and county_fips <> '00007'").select(F.col("county_fips").alias("GEOID"), F.col("yield_bu_ac").alias("v")), "yield")
    s = fx.shapes(spark, d)
    g = {"a": 1.0, "e": 1.0, "c": 0.0, "f": 0.0, "height": 512, "width": 512}
    return rounded(labels.label_surfaces(crop, s.join(y, "GEOID"), s, "v", g, coarse_res=42), "nearest", "bilinear")


@check("T09_covering_window", """SELECT s_suppkey, CAST(floor((2000000 - (1990000 + s_suppkey * 11.5::DOUBLE)) / 30) AS INTEGER) AS row_off, CAST(floor((s_suppkey * 13.25::DOUBLE + 500100 - 500000) / 30) AS INTEGER) AS col_off,
 greatest(1, CAST(ceil((2000000 - (1990000 + s_suppkey * 11.5::DOUBLE - s_suppkey % 50)) / 30) - floor((2000000 - (1990000 + s_suppkey * 11.5::DOUBLE)) / 30) AS INTEGER)) AS win_height,
 greatest(1, CAST(ceil((s_suppkey * 13.25::DOUBLE + 500100 + s_suppkey % 90 - 500000) / 30) - floor((s_suppkey * 13.25::DOUBLE + 500100 - 500000) / 30) AS INTEGER)) AS win_width FROM supplier""")
def t09(spark, d):
    k = F.col("s_suppkey")
    b = fx.table(spark, d, "supplier").select(
        "s_suppkey", (k * 13.25 + 500100).alias("xmin"), (k * 13.25 + 500100 + k % 90).alias("xmax"), (1990000 + k * 11.5).alias("ymax"),
        (1990000 + k * 11.5 - k % 50).alias("ymin"), F.lit(30.0).alias("a"), F.lit(-30.0).alias("e"), F.lit(500000.0).alias("c"), F.lit(2000000.0).alias("f"))
    return grid.covering_window(b).select("s_suppkey", "row_off", "col_off", "win_height", "win_width")


@check("A32_envelope", _T1 + """SELECT state, year, min(row_off) AS row0, max(row_off + least(224, height)) AS row1, min(col_off) AS col0, max(col_off + least(224, width)) AS col1 FROM t GROUP BY 1, 2""")
def a32(spark, d):
    return spatial.envelope(grid.tile_windows(fx.grids(spark, d), 224, 112), ["state", "year"], F.col("tile_height"), F.col("tile_width"))
