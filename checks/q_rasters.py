"""Blocked raster files: planned reads against found files, header metadata, merge inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from fieldspark.operators import mosaic, quality
from fieldspark.plans import materialise, shared_path
from fieldspark.sources import blocks, names

from . import fixtures as fx
from .fixtures import with_
from .registry import R, check, rounded

# 64 embeddings make a raster of 8 x 8 windows of 8 x 8 pixels, one file per month; blocks hold four windows.
_SIDE, _BLOCK = 8, 16
_MONTHS = ("APR", "MAY")
_PLAN = """SELECT m || '/tile_' || CAST(vec_id // 64 AS VARCHAR) || '.fsb' AS file, 'chip_' || CAST(vec_id AS VARCHAR) AS sample_id,
 CASE WHEN m = 'MAY' AND (vec_id // 64) % 3 = 0 THEN 'missing' WHEN (vec_id // 64) % 7 = 2 THEN 'unreadable'
      WHEN (vec_id // 64) % 5 = 1 AND (vec_id % 64) // 16 = 1 AND (vec_id % 8) // 2 = 2 THEN 'corrupt' ELSE 'ok' END AS status
 FROM embeddings, (SELECT unnest(['APR', 'MAY']) AS m)"""


def _planned(spark, d):
    tile, slot = F.expr("vec_id div 64"), F.col("vec_id") % 64
    return fx.table(spark, d, "embeddings").select(
        F.explode(F.array(*[F.lit(m) for m in _MONTHS])).alias("month"), "vec_id", tile.alias("tile"), slot.alias("slot"), "embedding"
    ).select(F.concat("month", F.lit("/tile_"), F.col("tile").cast("string"), F.lit(".fsb")).alias("file"),
             F.concat(F.lit("chip_"), F.col("vec_id").cast("string")).alias("sample_id"), "month", "tile",
             (F.floor(F.col("slot") / _SIDE) * _SIDE).alias("row_off"), (F.col("slot") % _SIDE * _SIDE).alias("col_off"),
             F.lit(_SIDE).cast("long").alias("size"), "embedding")


def _damage(root: str):
    """Cut some files in half and change one byte of a block in others, as a failing disk would."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                tile = int(name.rsplit("_", 1)[1].split(".")[0])
                files, path = blocks._file_system(f"{root}/{name}")
                with files.open_input_file(path) as f:
                    data = bytearray(f.read())
                if tile % 7 == 2:
                    data = data[:len(data) // 2]
                elif tile % 5 == 1:
                    index = blocks.BlockFile(blocks._Ranges(f"{root}/{name}")).index
                    if "1,2" in index:
                        data[index["1,2"][0] + 5] ^= 255
                with files.open_output_stream(path) as f:
                    f.write(bytes(data))
            yield batch
    return run


def _written(spark, d):
    """Root of the written and damaged files; a third of the second month never came."""
    root = shared_path(spark, "imagery")
    plan = _planned(spark, d).filter(~((F.col("month") == "MAY") & (F.col("tile") % 3 == 0)))
    px = plan.select("file", "row_off", "col_off", F.posexplode("embedding").alias("i", "v")).select(
        "file", (F.col("row_off") + F.floor(F.col("i") / _SIDE)).alias("row"), (F.col("col_off") + F.col("i") % _SIDE).alias("col"), "v")
    grids = plan.select("file").distinct().withColumns({
        "height": F.lit(64).cast("long"), "width": F.lit(64).cast("long"), "crs": F.lit("EPSG:5070"), "res": F.lit(30.0),
        "nodata": F.lit(float("nan"))})
    stored = materialise(blocks.write_blocks(px, grids, root, ["v"], _BLOCK), "stored_files")
    materialise(stored.select("file").mapInArrow(_damage(root), "file string"), "damaged_files")
    return root


@check("M04c_planned_scan", f"""SELECT file, CASE WHEN bool_or(status = 'missing') THEN 'missing' WHEN bool_or(status = 'unreadable') THEN 'unreadable'
 WHEN bool_or(status = 'corrupt') THEN 'corrupt' ELSE 'ok' END AS state, count(*) AS window_reads, count(*) FILTER (status = 'corrupt') AS bad_reads,
 {R("100.0 * count(*) FILTER (status = 'corrupt') / count(*)")} AS bad_pct, count(*) FILTER (status = 'corrupt') AS affected_chips FROM ({_PLAN}) GROUP BY file""")
def m04c(spark, d):
    reads = blocks.read_windows(_planned(spark, d).select("file", "sample_id", "row_off", "col_off", "size"), _written(spark, d))
    return rounded(quality.planned_report(reads), "bad_pct")


@check("M04d_affected_chips", f"SELECT sample_id, count(DISTINCT file) AS files FROM ({_PLAN}) WHERE status = 'corrupt' GROUP BY 1")
def m04d(spark, d):
    reads = blocks.read_windows(_planned(spark, d).select("file", "sample_id", "row_off", "col_off", "size"), _written(spark, d))
    return quality.affected_samples(reads)


@check("S09b_read_chip_windows", f"""SELECT p.file, p.sample_id, {R('sum(v)')} AS total, {R('max(v)')} AS largest
 FROM ({_PLAN}) p JOIN (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) e ON p.sample_id = 'chip_' || CAST(e.vec_id AS VARCHAR)
 WHERE status = 'ok' GROUP BY 1, 2""")
def s09b(spark, d):
    plan = _planned(spark, d).select("file", "sample_id", "row_off", "col_off", "size")
    got = blocks.read_windows(plan, _written(spark, d), values=True).filter("status = 'ok'")
    v = F.col("values").cast("array<double>")
    return rounded(got.select("file", "sample_id", F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"),
                              F.array_max(v).alias("largest")), "total", "largest")


@check("S06b_sample_metadata", with_("grids", g="SELECT DISTINCT state, year FROM grids") + """SELECT kind, min(file) AS file, CAST(64 AS BIGINT) AS height,
 CAST(48 AS BIGINT) AS width, CAST(1 AS INTEGER) AS bands, 'float32' AS dtype, 'EPSG:5070' AS crs, 30.0::DOUBLE AS res, -9999.0::DOUBLE AS nodata, 'value' AS band_names
 FROM (SELECT 'label' AS kind, 'label/nass_soybeans_yield_' || state || '_' || CAST(year AS VARCHAR) || '_nearest_30m.tif.fsb' AS file FROM g
  UNION ALL SELECT 'mask', 'mask/cdl_soybeans_' || state || '_' || CAST(year AS VARCHAR) || '.tif.fsb' FROM g WHERE year % 3 <> 0) GROUP BY kind""")
def s06b(spark, d):
    root = shared_path(spark, "rasters")
    g = fx.grids(spark, d).select("state", "year").distinct()
    tail = F.concat("state", F.lit("_"), F.col("year").cast("string"))
    label = g.select(F.concat(F.lit("label/nass_soybeans_yield_"), tail, F.lit("_nearest_30m.tif.fsb")).alias("file"))
    mask = g.filter("year % 3 <> 0").select(F.concat(F.lit("mask/cdl_soybeans_"), tail, F.lit(".tif.fsb")).alias("file"))
    files = label.union(mask).withColumns({
        "height": F.lit(64).cast("long"), "width": F.lit(48).cast("long"), "crs": F.lit("EPSG:5070"), "res": F.lit(30.0), "nodata": F.lit(-9999.0)})
    px = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(63), F.lit(9))).alias("row")).withColumns(
        {"row": F.col("row").cast("long"), "col": (F.col("row") % 48).cast("long"), "value": F.col("row") * 1.0})
    materialise(blocks.write_blocks(px, files, root, ["value"], 32), "stored_files")
    return names.sample_metadata(blocks.raster_metadata(spark, root)).drop("error").withColumn("band_names", F.concat_ws(",", "band_names"))


_META = with_("grids", m="""SELECT raster_id AS file, crs, CAST(1 + height % 11 // 10 AS INTEGER) AS bands, CASE WHEN width % 13 = 5 THEN 'float64' ELSE 'float32' END AS dtype,
 a + CASE WHEN width % 17 = 3 THEN 1.0 WHEN width % 17 = 4 THEN 0.0001 ELSE 0.0 END AS res, CASE WHEN width % 19 <> 1 THEN -9999.0 END::DOUBLE AS nodata FROM grids""",
              f="SELECT * FROM m ORDER BY file LIMIT 1")


@check("W05v_merge_inputs", _META + """SELECT m.file, 'crs' AS property, 'error' AS severity, m.crs AS found, f.crs AS expected FROM m, f WHERE m.crs <> f.crs
 UNION ALL SELECT m.file, 'bands', 'error', CAST(m.bands AS VARCHAR), CAST(f.bands AS VARCHAR) FROM m, f WHERE m.bands <> f.bands
 UNION ALL SELECT m.file, 'dtype', 'error', m.dtype, f.dtype FROM m, f WHERE m.dtype <> f.dtype
 UNION ALL SELECT m.file, 'res', 'warning', CAST(m.res AS VARCHAR), CAST(f.res AS VARCHAR) FROM m, f WHERE abs(m.res - f.res) > 1e-8 + 1e-5 * abs(f.res)
 UNION ALL SELECT m.file, 'nodata', 'warning', CAST(m.nodata AS VARCHAR), CAST(f.nodata AS VARCHAR) FROM m, f WHERE m.nodata IS DISTINCT FROM f.nodata""")
def w05v(spark, d):
    w = F.col("width")
    meta = fx.grids(spark, d).select(
        F.col("raster_id").alias("file"), "crs", (1 + F.floor(F.col("height") % 11 / 10)).cast("int").alias("bands"),
        F.when(w % 13 == 5, "float64").otherwise("float32").alias("dtype"),
        (F.col("a") + F.when(w % 17 == 3, 1.0).when(w % 17 == 4, 0.0001).otherwise(0.0)).alias("res"),
        F.when(w % 19 != 1, F.lit(-9999.0)).alias("nodata"), F.array(F.lit("yield")).alias("band_names"))
    return mosaic.input_mismatches(meta)
