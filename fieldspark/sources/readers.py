"""Readers with explicit schemas. Text becomes typed by ``try_cast``; sentinels become NULL."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import codes, nulls, spectral
from ..functions.spectral import BAND_ORDER
from ..plans import first_by, last_by

# Band positions of the eight- and four-band index stacks.
STACK_8 = ("NDVI_mean", "EVI_mean", "GCVI_mean", "NDWI_mean", "min_index_obsCount", "county_fips",
           "crop_mask", "valid_vi_mask")
STACK_4 = ("NDVI_mean", "EVI_mean", "GCVI_mean", "NDWI_mean")


def read_survey_records(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON survey records, one object per line, all text."""
    return spark.read.schema(schemas.SURVEY_RECORD).json(path)


def _rows_by_name(spark: SparkSession, path: str, marker: str, known: Sequence[str], pattern: str = "*") -> DataFrame:
    """Text columns ``known`` of CSV files that may each have a column order of their own.

    A file is read once, by one task, which finds its header (the first row with a cell
    ``marker``; case does not count) and yields the rows after it; quoted cells may hold
    line breaks. Columns absent from a file and empty cells are NULL, later rows that repeat
    the header are not data, and files without one give no rows. ``_file`` and ``_at`` give
    the file name and the place of a row in reading order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern) \
        .option("ignoreCorruptFiles", True).load(path).select("path", "content")
    wanted = {c.lower(): i for i, c in enumerate(known)}
    place = pa.struct([("path", pa.string()), ("row", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                text = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline="")
                names, out = None, []
                for n, cells in enumerate(csv.reader(text)):
                    low = [c.strip().lower() for c in cells]
                    if marker.lower() in low:
                        names = names or [wanted.get(c) for c in low]
                    elif names is not None and any(low):
                        row: list = [None] * len(known)
                        for at, cell in zip(names, cells):
                            if at is not None and cell != "" and row[at] is None:
                                row[at] = cell
                        out.append((*row, name.rsplit("/", 1)[-1], {"path": name, "row": n}))
                    if len(out) == 8192:
                        yield as_batch(out)
                        out = []
                if out:
                    yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * (len(known) + 1), place]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [*known, "_file", "_at"])

    schema = ", ".join(f"`{c}` string" for c in known) + ", _file string, _at struct<path:string,row:long>"
    return files.mapInArrow(rows, schema)


def read_county_yield(spark: SparkSession, path: str) -> DataFrame:
    """County-year yields from CSV: clean codes, numbers or NULL, rows without a yield dropped.

    Columns go by name, file by file. Of rows that share (geoid, year) the first in reading
    order stays. ``state`` and ``county_name`` may be missing; the others may not.
    """
    known = [f.lower() for f in schemas.COUNTY_YIELD_TEXT.fieldNames()]
    raw = _rows_by_name(spark, path, "geoid", known)
    typed = raw.withColumn("geoid", codes.clean_fips(F.col("geoid"))) \
        .withColumn("year", F.col("year").try_cast("int")) \
        .withColumns({c: F.col(c).try_cast("double") for c in ("yield_bu_ac", "yield_kg_ha")})
    whole = typed.dropna(subset=["geoid", "year", "yield_bu_ac"])
    return first_by(whole, ["geoid", "year"], ["_at"]).select(*known)


def read_vi_summaries(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """All county summary CSVs below a folder with ``source_file``; unreadable files are skipped."""
    known = schemas.COUNTY_VI_TEXT.fieldNames()
    raw = _rows_by_name(spark, root, "county_fips", known, pattern).withColumnRenamed("_file", "source_file")
    typed = raw.withColumns({c: F.col(c).try_cast(t) for c, t in schemas.COUNTY_VI_TYPES.items()})
    return typed.withColumn("county_fips", codes.clean_fips(F.col("county_fips"))).select(*known, "source_file")


def read_county_shapes(shapes: DataFrame, state: str | None = None, county_fips: str | None = None,
                       name_contains: str | None = None) -> DataFrame:
    """Shapes of a state, of one county or by part of a name, in GEOID order."""
    out = shapes
    if "GEOID" not in out.columns:
        out = out.withColumn("GEOID", codes.geoid(F.col("STATEFP"), F.col("COUNTYFP")))
    if state is not None:
        out = out.filter(F.col("STATEFP") == codes.STATE_FIPS.get(state, state))
    if county_fips is not None:
        out = out.filter(F.col("COUNTYFP") == county_fips.zfill(3))
    if name_contains is not None:
        out = out.filter(F.lower("NAME").contains(name_contains.lower()))
    return out.orderBy("GEOID")


def read_pixels(raw: DataFrame, keys: Sequence[str], bands: Sequence[str] = STACK_8,
                nodata: float | None = nulls.NODATA) -> DataFrame:
    """Pixel bands by name, else by position ``band_1``..; sentinel and non-finite become NULL.

    With only four positional bands the four-band layout is used.
    """
    by_name = [b for b in bands if b in raw.columns]
    if len(by_name) == len(bands):
        source = {b: b for b in bands}
    else:
        n = sum(1 for c in raw.columns if c.startswith("band_"))
        layout = bands if n >= len(bands) else STACK_4
        if n < len(layout):
            raise ValueError(f"pixel table has {n} bands, expected at least {len(layout)}")
        source = {b: f"band_{i}" for i, b in enumerate(layout, 1)}
    return raw.select(*keys, *[nulls.to_null(F.col(c), nodata).alias(b) for b, c in source.items()])


def scan_scenes(scenes: DataFrame, t0: str, t1: str, bbox: tuple[float, float, float, float] | None = None,
                max_cloud: float = 70.0, null_cloud: str = "keep") -> DataFrame:
    """Scene catalogue query: one row per id, cloud, date and box filters, ordered by (ts, id).

    ``null_cloud="keep"`` keeps scenes without a cloud value; ``"drop"`` reads it as 999
    and orders by cloud.
    """
    live = scenes.filter((F.col("ts") >= F.lit(t0).cast("timestamp_ntz"))
                         & (F.col("ts") <= F.lit(t1).cast("timestamp_ntz")))
    if bbox is not None:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in bbox)
        live = live.filter(F.col("xmin").isNull() | ((F.col("xmax") >= x0) & (F.col("xmin") <= x1)
                                                     & (F.col("ymax") >= y0) & (F.col("ymin") <= y1)))
    one = last_by(live, ["id"], ["ts"])
    if null_cloud == "drop":
        one = one.withColumn("cloud_cover", F.coalesce("cloud_cover", F.lit(999.0)))
        return one.filter(F.col("cloud_cover") <= max_cloud).orderBy("cloud_cover", "id")
    return one.filter(F.col("cloud_cover").isNull() | (F.col("cloud_cover") <= max_cloud)).orderBy("ts", "id")


def read_chip_stack(labels: DataFrame, months: DataFrame, crop: DataFrame, keys: list[str],
                    month_numbers: Sequence[int], bands: Sequence[str] = BAND_ORDER) -> DataFrame:
    """Label pixels with their month series and crop flag on one grid.

    The label table is canonical. A month is valid where all bands are present; a missing
    month is NULL and invalid. Month rows are pivoted by one aggregate before the join.
    """
    whole = F.lit(True)
    for b in bands:
        whole = whole & nulls.is_observed(F.col(b)) & (F.col(b) > spectral.FILL_THRESHOLD)
    aggs = []
    for m in month_numbers:
        here = (F.col("month") == m) & whole
        aggs += [F.max(F.when(here, F.col(b) * spectral.REFLECTANCE_SCALE)).alias(f"{b}_{m:02d}") for b in bands]
        aggs.append(F.max(F.coalesce(here, F.lit(False))).alias(f"valid_{m:02d}"))
    wide = months.groupBy(*keys).agg(*aggs)
    out = labels.join(wide, keys, "left").join(crop.select(*keys, "crop_mask"), keys, "left")
    return out.withColumn("crop_mask", F.coalesce("crop_mask", F.lit(False))) \
        .withColumns({f"valid_{m:02d}": F.coalesce(f"valid_{m:02d}", F.lit(False)) for m in month_numbers})


def read_chip_files(spark: SparkSession, root: str, pixels: int, pattern: str = "*.bin") -> DataFrame:
    """Decode check of stored float32 chips: path, status, share of finite values.

    Each task decodes whole files from Arrow batches; nothing is gathered. For large chips
    lower ``spark.sql.execution.arrow.maxRecordsPerBatch`` so a batch fits a Python worker.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", pattern).load(root).select("path", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if len(content) != 4 * pixels:
                    rows.append((path, "bad_size", None))
                    continue
                share = float(np.isfinite(np.frombuffer(content, dtype="<f4")).mean())
                rows.append((path, "ok" if share == 1.0 else "non_finite", share))
            yield pd.DataFrame(rows, columns=["path", "status", "finite_share"])
    return files.mapInPandas(check, "path string, status string, finite_share double")

