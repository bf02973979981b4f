"""Writers. Tables are partitioned by region and year and clustered by chip."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, nulls
from ..functions.spectral import INDICES


def write_pixels(df: DataFrame, path: str, bands: Sequence[str], nodata: float | None = None,
                 partition_by: Sequence[str] = ("state", "year"), chip: int = geo.CHIP,
                 mode: str = "overwrite") -> None:
    """Pixel rows clustered by chip, so a chip query skips row groups.

    With ``nodata`` missing values are written as the sentinel. ``overwrite`` replaces the
    partitions that ``df`` has rows for and leaves the others alone.
    """
    out = df if nodata is None else df.withColumns({b: nulls.to_nodata(F.col(b), nodata) for b in bands})
    _write_clustered(out, path, partition_by, chip, mode)


def _write_clustered(out: DataFrame, path: str, partition_by: Sequence[str], chip: int, mode: str) -> None:
    out = out.withColumn("_cr", geo.chip_of(F.col("row"), chip)).withColumn("_cc", geo.chip_of(F.col("col"), chip))
    order = [*partition_by, "_cr", "_cc", "row", "col"]
    # ranges include row and col, so one large region still spreads over many files
    out.repartitionByRange(*order).sortWithinPartitions(*order).drop("_cr", "_cc") \
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def vi_pixel_bands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The eleven index-stack bands: means only on valid pixels, counts only on crop pixels."""
    crop, valid = F.coalesce("crop_mask", F.lit(False)), F.coalesce("valid_vi_mask", F.lit(False))
    valid = crop & valid
    return df.select(
        *keys, *[F.when(valid, F.col(f"{v}_mean")).alias(f"{v}_mean") for v in INDICES],
        *[F.when(crop, F.col(f"{v}_obsCount")).otherwise(F.lit(0)).cast("int").alias(f"{v}_obsCount") for v in INDICES],
        F.when(crop, F.col("min_index_obsCount")).otherwise(F.lit(0)).cast("int").alias("min_index_obsCount"),
        crop.alias("crop_mask"), valid.alias("valid_vi_mask"))


def write_vi_pixels(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite",
                    partition_by: Sequence[str] = ("state", "year"), chip: int = geo.CHIP) -> None:
    """Index-stack bands in the layout of ``write_pixels``; ``keys`` include row and col."""
    _write_clustered(vi_pixel_bands(df, keys), path, partition_by, chip, mode)


def write_summary(df: DataFrame, path: str, fmt: str = "parquet", unit: str | None = None,
                  mode: str = "overwrite") -> None:
    """Metric table as csv, parquet or json; ``unit`` names what its ``n`` counts."""
    out = df if unit is None else df.withColumn("unit", F.lit(unit))
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("parquet", "json"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"unknown summary format {fmt!r}")


def append_log(records: DataFrame, path: str, run_id: str) -> None:
    """Append success and failure records, one folder per run."""
    records.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def fingerprint(config: dict[str, Any]) -> str:
    """First 16 hex digits of SHA-256 over the configuration as key-sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint_column(**parts: Column) -> Column:
    """Row-wise fingerprint of named text values, keys in sorted order."""
    fields = [F.concat(F.lit(f'"{k}": "'), parts[k].cast("string"), F.lit('"')) for k in sorted(parts)]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return F.substring(F.sha2(text, 256), 1, 16)
