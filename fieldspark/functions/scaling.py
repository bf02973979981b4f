"""Band normalisation and target scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .nulls import spread_or_one

# Published pretraining band statistics.
OFFICIAL_BAND_MEAN = (1087.0, 1342.0, 1433.0, 2734.0, 1958.0, 1363.0)
OFFICIAL_BAND_STD = (2248.0, 2179.0, 2178.0, 1850.0, 1242.0, 1049.0)


def zscore(c: Column, mean: Column, std: Column) -> Column:
    return (c - mean) / std


def normalize(bands: Sequence[Column], mode: str, means: Sequence | None = None,
              stds: Sequence | None = None) -> list[Column]:
    """Per-band z-scores: ``fold`` (given statistics), ``official`` or ``identity``."""
    if mode == "identity":
        return list(bands)
    if mode == "official":
        means, stds = OFFICIAL_BAND_MEAN, OFFICIAL_BAND_STD
    elif mode != "fold":
        raise ValueError(f"unknown normalisation mode {mode!r}")

    def col(v):
        return v if isinstance(v, Column) else F.lit(float(v))
    return [zscore(b, col(m), col(s)) for b, m, s in zip(bands, means, stds)]


def band_std(sd: Column) -> Column:
    """Band spread usable as a divisor; tiny or missing becomes 1."""
    return spread_or_one(sd, 1e-6)


def target_scale(y: Column, mode: Column | str, center: Column, scale: Column) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "none", y).otherwise(
        (y - center) / F.when(scale != 0, scale).otherwise(F.lit(1.0)))


def target_inverse(y: Column, mode: Column | str, center: Column, scale: Column) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(mode == "none", y).otherwise(y * scale + center)
