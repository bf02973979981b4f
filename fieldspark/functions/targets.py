"""Which pixels count, and what a miss costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .nulls import NODATA


def label_valid(label: Column, nodata: float = NODATA) -> Column:
    return F.coalesce(~F.isnan(label) & (label != F.lit(nodata)), F.lit(False))


def month_count(months: Sequence[Column]) -> Column:
    """How many of the month flags are true."""
    total = F.lit(0)
    for m in months:
        total = total + F.coalesce(m.cast("int"), F.lit(0))
    return total


def target_valid(crop: Column, label: Column, n_valid_months: Column, k: int = 1,
                 nodata: float = NODATA) -> Column:
    """The one definition of a usable target: crop, valid label, enough months."""
    return F.coalesce(crop, F.lit(False)) & label_valid(label, nodata) & \
        (F.coalesce(n_valid_months, F.lit(0)) >= k)


def loss_term(name: str, pred: Column, target: Column, delta: float = 1.0,
              log_var: Column | None = None) -> Column:
    """Per-pixel loss: mse, mae, huber or gaussian (needs ``log_var``)."""
    e = pred - target
    if name == "mse":
        return e * e
    if name == "mae":
        return F.abs(e)
    if name == "huber":
        return F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))
    if name == "gaussian":
        if log_var is None:
            raise ValueError("gaussian loss needs log_var")
        return 0.5 * (F.exp(-log_var) * e * e + log_var)
    raise ValueError(f"unknown loss {name!r}")


def masked_mean(term: Column, mask: Column) -> Column:
    """Aggregate: mean over masked rows, 0 when there are none."""
    return F.coalesce(F.avg(F.when(mask, term)), F.lit(0.0))
